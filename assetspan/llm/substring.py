"""Substring dedup: relative Lempel-Ziv factors of every document against indexed reference blocks.

A run of WINDOW words has an anchor: the least hash of its stretches of GRAM words, at the first place where it stands.  Equal runs have equal
anchors, so only runs whose anchor occurs in a second document can repeat.  The runs of a document whose anchor stands at one place are one segment,
taken with its words: at most WINDOW - GRAM + 1 runs, cut by what the text says and not by where it stands, so that a text that repeats
a phrase without end has few different segments.

Equal segments are met before any words are shuffled: all but those of the least document are one factor.  The different segments of an anchor meet
in one task, and anchors are gathered to reference blocks of about BLOCK_BYTES.  A suffix array over a block's words is its index.
Each segment is parsed greedily from left to right against the segments of earlier documents: at a word the factor is the longest match
that any of them has; the next one begins at the first word behind it whose run is found at all, tried from WINDOW - 1 words before the
factor's end on, so that runs across the boundary of two factors are checked too.  Factors of WINDOW words or more are the
duplicate spans; their words are exactly the words of runs that start in an earlier document.

An anchor whose different segments hold more than HOT bytes deals them anew by the anchors of longer stretches, and in the end by their whole
runs, of which equal ones are one segment.  So no block holds more than BLOCK_BYTES and HOT bytes, whatever the documents.  Texts equal
to one of a smaller doc_id are one factor as a whole from the start.  Joins back to the rows leave skew to adaptive execution.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetspan.llm._common import Rolling, chunks, cut, mix, packed, raw, small, suffix_array, unpacked, word_bounds, word_hashes

WINDOW = 50
GRAM = 20
BLOCK_BYTES = HOT = 1 << 20
#: Bytes of \x20 and \x09-\x0D, which part words.
IS_WORD = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])
WORDS, OTHER = Rolling(0x5851F42D4C957F2D), Rolling(0x14057B7EF767814F)


class Part:
    """Words of a batch of texts, with 64-bit hashes; begin[i]:begin[i + 1] are those of text i."""

    def __init__(self, texts: list[bytes | None]):
        buffer = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        self.starts, self.ends = word_bounds(buffer, IS_WORD)
        size = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(size + 1)))
        self.begin = np.searchsorted(self.starts, self.base)
        self.word = word_hashes(buffer, self.starts, self.ends)
        self.texts = texts

    def runs(self, size: int, rolling: Rolling) -> np.ndarray:
        """Hash of the `size` words from each word on; the last ones, for which there are too few words, are missing."""
        n = max(0, len(self.word) - size + 1)
        at = np.arange(n)
        return mix(rolling.runs(rolling.prefix(self.word), at, at + size))

    def places(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the window from each word on its anchor, the least of its hashes of `gram` words, and the first word that has it."""
        if len(self.word) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = self.runs(gram, WORDS)
        at, span, width = np.arange(len(x)), window - gram + 1, 1

        def least(step: int) -> np.ndarray:
            one, other = at[: len(at) - step], at[step:]
            return np.where(x[other] < x[one], other, one)

        while 2 * width <= span:
            at = least(width)
            width *= 2
        if span > width:
            at = least(span - width)
        return x[at].view(np.int64), at


def grams(window: int) -> list[int]:
    """Words of the stretches that anchors are taken from, the last of them whole runs."""
    gram = min(GRAM, (window + 1) // 2)
    return sorted({gram, (gram + window) // 2, window})


def _anchors(window: int):
    """doc_id, _th and the distinct anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            part = Part(raw(b, "text"))
            anchor, _ = part.places(window, grams(window)[0])
            own = [np.unique(anchor[a : max(a, e - window + 1)]) for a, e in zip(part.begin[:-1].tolist(), part.begin[1:].tolist())]
            keys = [b.column(b.schema.get_field_index(k)) for k in ("doc_id", "_th", "_sha")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(own, pa.list_(pa.int64()))], ["doc_id", "_th", "_sha", "anchors"])

    return run


def segments(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First run and number of runs of one text's segments."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(place)), bool), place[1:] != place[:-1])))
    return first, np.diff(np.append(first, len(place)))


SEGMENTS = "anchor long, doc_id long, a long, b long, pos int, words binary, h1 long, h2 long, runs int"


def _segments(window: int, gram: int, text: str, keys: tuple[str, ...]):
    """Segments of rows of `text`, those that recur in one text once, with the row's keys and 128 bits of fingerprint.

    Where a column `shared` names anchors, only theirs.  Segments of one run have no words: their fingerprint is all that is asked.
    """
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("shared")
            if i >= 0:
                b = b.filter(b.column(i).is_valid())
            for c in chunks(iter([b]), text):
                part = Part(raw(c, text))
                anchor, place = part.places(window, gram)
                one, other = WORDS.prefix(part.word), OTHER.prefix(part.word)
                buffer = b"\n".join(t or b"" for t in part.texts) + b"\n"
                rows, firsts, counts = [], [], []
                for k, (a, e) in enumerate(zip(part.begin[:-1].tolist(), part.begin[1:].tolist())):
                    first, count = segments(place[a : max(a, e - window + 1)])
                    first = first + a
                    if i >= 0:
                        take = np.isin(anchor[first], np.asarray(c.column(i)[k].values.to_numpy(), np.int64))
                        first, count = first[take], count[take]
                    end = first + count + window - 1
                    prints = np.stack([h.runs(p, first, end) for h, p in ((WORDS, one), (OTHER, other))], 1)
                    at = np.sort(np.unique(np.ascontiguousarray(prints).view("V16").ravel(), return_index=True)[1])
                    rows.append(np.full(len(at), k))
                    firsts.append(first[at])
                    counts.append(count[at])
                if not rows:
                    continue
                row, first, count = (np.concatenate(x) for x in (rows, firsts, counts))
                end = first + count + window - 1
                prints = [mix(h.runs(p, first, end) + mix(count.astype(np.uint64))).view(np.int64) for h, p in ((WORDS, one), (OTHER, other))]
                words = [None] * len(row) if gram == window else [buffer[x:y] for x, y in zip(part.starts[first].tolist(), part.ends[end - 1].tolist())]
                owner = [c.column(c.schema.get_field_index(k)).take(pa.array(row)) for k in keys]
                owner += [pa.array(np.zeros(len(row), np.int64))] * (3 - len(owner))
                pos = pa.array((first - part.begin[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), *(x.cast(pa.int64()) for x in owner), pos, pa.array(words, pa.binary()), *map(pa.array, prints), pa.array(count.astype(np.int32))], names)

    return run


class Block:
    """An indexed reference block: the words of segments, one after the other, and the suffix array over them."""

    def __init__(self, texts: list[bytes], doc: np.ndarray, window: int):
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends = word_bounds(buffer, IS_WORD)
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.begin = np.searchsorted(starts, base)
        size = np.diff(self.begin)
        self.words = word_hashes(buffer, starts, ends)
        self.prefix = WORDS.prefix(self.words)
        self.segment = np.repeat(np.arange(len(texts)), size)
        self.left = np.repeat(self.begin[1:], size) - np.arange(len(self.words))  # words up to the segment's end
        self.doc, self.window = doc[self.segment], window
        symbol = np.unique(self.words, return_inverse=True)[1]
        text = np.empty(len(symbol) + len(texts), np.int64)  # each segment ends with a symbol of its own
        place = np.arange(len(symbol)) + self.segment
        text[place] = symbol
        text[self.begin[1:] + np.arange(len(texts))] = len(symbol) + np.arange(len(texts))
        back = np.full(len(text), -1, np.int64)
        back[place] = np.arange(len(symbol))
        order = back[suffix_array(text)]
        self.order = order[order >= 0]

    def equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        return WORDS.runs(self.prefix, x, x + size) == WORDS.runs(self.prefix, y, y + size)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word: how many words from it on an earlier document has too, at most up to the segment's end, and that document.

        Only matches of `window` words or more are found, others are 0.  In suffix order the longest match of a word with earlier documents
        is with the closest suffix of such a document, above or below.
        """
        size, ref = np.zeros(len(self.words), np.int64), np.full(len(self.words), -1, np.int64)
        order = self.order[self.left[self.order] >= self.window]
        same = np.zeros(len(order), bool)  # the run is that of the suffix above
        same[1:] = self.equal(order[1:], order[:-1], np.full(max(0, len(order) - 1), self.window))
        doc, group = self.doc[order], np.cumsum(~same)
        for step in (-1, 1):
            near = np.arange(len(order)) + step
            todo = np.arange(len(order))
            while True:
                near[todo] = np.clip(near[todo], -1, len(order))
                inside = (near[todo] >= 0) & (near[todo] < len(order))
                todo = todo[inside]
                ok = group[near[todo]] == group[todo]
                near[todo[~ok]] = -1
                todo = todo[ok]
                todo = todo[doc[near[todo]] >= doc[todo]]
                if not len(todo):
                    break
                near[todo] = near[near[todo]]
            at = np.flatnonzero((near >= 0) & (near < len(order)))
            at = at[(group[near[at]] == group[at]) & (doc[near[at]] < doc[at])]
            x, y = order[at], order[near[at]]
            low, high = np.full(len(at), self.window), np.minimum(self.left[x], self.left[y])
            while (low < high).any():
                middle = (low + high + 1) // 2
                ok = self.equal(x, y, middle)
                low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
            better = low > size[x]
            size[x[better]], ref[x[better]] = low[better], self.doc[y[better]]
        return size, ref

    def parse(self) -> list[tuple[int, int, int, int]]:
        """Greedy factors (segment, first word in it, words, earlier document)."""
        size, ref = self.longest()
        found = np.flatnonzero(size)
        out, upto, segment = [], -1, -1
        for p, n, r, s in zip(found.tolist(), size[found].tolist(), ref[found].tolist(), self.segment[found].tolist()):
            if s != segment or p > upto - self.window:  # the run at p is not inside the last factor
                out.append((s, p - int(self.begin[s]), n, r))
                segment, upto = s, p + n
        return out


def _factors(window: int, most: int = BLOCK_BYTES):
    """Factors of the different segments of a partition that is sorted by anchor; a block has whole anchors."""

    def parsed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, texts, doc = t.column("anchor").to_numpy(), t.column("words").to_pylist(), t.column("ref").to_numpy()
        ends = np.cumsum([len(x) for x in texts])
        last = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))  # ends of anchors' rows
        a = 0
        while a < len(texts):
            full = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most))
            b = int(last[min(np.searchsorted(last, full + 1), len(last) - 1)])
            got = Block(texts[a:b], doc[a:b], window).parse()
            if got:
                s, p, n, r = (np.array(x, np.int64) for x in zip(*got))
                keys = [t.column(k).combine_chunks().take(pa.array(a + s)) for k in ("h1", "h2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(r)], ["h1", "h2", "pos", "size", "ref"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            anchor = t.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on in the next batch
            if whole:
                yield from parsed(t.slice(0, whole).combine_chunks())
                held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield from parsed(pa.Table.from_batches(held).combine_chunks())

    return run


def _matched(found: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """(doc_id, a, b, pos, size, ref): factors of segments, of which doc_id, a, b and pos say where they stand.

    Of equal segments those of the least document are parsed, as one, the others are one factor.
    """
    found = cut(found)
    whole = cut(found.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("end"), F.first("words").alias("words"), F.first("runs").alias("runs")))
    firsts = whole.select("h1", "h2", "runs", F.col("ref").alias("first"), "end")
    everything = F.array(F.struct(F.lit(0).alias("pos"), (F.col("runs") + window - 1).alias("size"), F.col("first").alias("ref")))
    if sizes[0] < window:
        met = cut(whole.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes")).where("n > 1").select("anchor", (F.col("bytes") > HOT).alias("hot")))
        rows = whole.join(small(met), "anchor")
        blocks = rows.where("not hot").select("anchor", "ref", "h1", "h2", "words").repartition("anchor").sortWithinPartitions("anchor", "ref", "h1", "h2")
        parsed = blocks.mapInArrow(_factors(window), "h1 long, h2 long, pos int, size int, ref long")
        if not met.where("hot").isEmpty():
            longer = rows.where("hot").select("ref", "h1", "h2", "words").mapInArrow(_segments(window, sizes[1], "words", ("ref", "h1", "h2")), SEGMENTS)
            parsed = parsed.union(_matched(longer, window, sizes[1:]).select(F.col("a").alias("h1"), F.col("b").alias("h2"), "pos", "size", "ref"))
        parsed = parsed.groupBy("h1", "h2").agg(F.collect_list(F.struct("pos", "size", "ref")).alias("own"))  # as many as a segment has runs, at most
        firsts = firsts.join(parsed, ["h1", "h2"], "left").where("first < end or own is not null")
        factor = F.when(F.col("first") < F.col("doc_id"), everything).otherwise(F.col("own"))
    else:
        firsts, factor = firsts.where("first < end"), F.when(F.col("first") < F.col("doc_id"), everything)
    each = found.drop("anchor", "words", "runs").join(firsts, ["h1", "h2"]).select("doc_id", "a", "b", "pos", F.explode(factor).alias("f"))
    return each.select("doc_id", "a", "b", (F.col("pos") + F.col("f.pos")).alias("pos"), "f.size", "f.ref")


def factors(base: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(copies, parsed): keys (doc_id, _th) of texts equal to an earlier one, and of the others their factors, as one
    sorted array of (pos, size, ref).  base: a frame with doc_id, text and _th, which is xxhash64 of the text; it
    stands in the plan just as the caller joins it again, so that its shuffle is shared."""
    keyed = base.where("doc_id is not null and text is not null").select("doc_id", "_th", F.unhex(F.sha2("text", 256)).alias("_sha"), "text")
    own = cut(keyed.mapInArrow(_anchors(window), "doc_id long, _th long, _sha binary, anchors array<long>"))
    firsts = small(cut(own.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n")))
    copies = cut(own.select("doc_id", "_th", "_sha").join(firsts, "_sha").where("_first < doc_id").select("doc_id", "_th", "_first").dropDuplicates(["doc_id", "_th"]))
    rest = own.join(small(copies.select("doc_id", "_th")), ["doc_id", "_th"], "left_anti").select("doc_id", "_th", F.explode("anchors").alias("anchor"))
    common = rest.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = cut(rest.join(common, "anchor").groupBy("doc_id", "_th").agg(F.collect_set("anchor").alias("shared")))
    sizes = grams(window)
    found = base.join(shared, ["doc_id", "_th"], "left").mapInArrow(_segments(window, sizes[0], "text", ("doc_id", "_th")), SEGMENTS)
    parsed = _matched(found, window, sizes).withColumnRenamed("a", "_th")
    return copies, parsed.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_set(F.struct("pos", "size", "ref"))).alias("_factors"))


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word spans [start, end) of runs that start at the given words, in order; spans that touch are one."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(starts) > window)))
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), (starts[last] + window).tolist()))


def _spans(batch: pa.RecordBatch, window: int) -> list[list[tuple[int, int]]]:
    """Merged spans of each row's factors; a run inside a factor is removed wherever it recurs in the text."""
    col = batch.column(batch.schema.get_field_index("_factors"))
    out: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
    some = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    if len(some):
        rows = batch.take(pa.array(some))
        part = Part(raw(rows, "text"))
        runs = part.runs(window, WORDS)
        for i, k in enumerate(some.tolist()):
            found = rows.column(rows.schema.get_field_index("_factors"))[i].values
            pos, size = (found.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2))
            a = int(part.begin[i])
            own = runs[a : max(a, int(part.begin[i + 1]) - window + 1)]
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + size - window + 1, -1)
            inside = np.cumsum(edge[:-1]) > 0
            out[k] = merged(np.flatnonzero(np.isin(own, own[inside])), window)
    return out


def _finish(window: int, rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts = raw(b, "text")
            spans = _spans(b, window)
            copy = b.column(b.schema.get_field_index("_first")).is_valid().to_pylist()
            n_words, n_removed, kept = [], [], []
            for t, s, c in zip(texts, spans, copy):
                words = (t or b"").split()
                if c and len(words) >= window:
                    s = [(0, len(words))]
                n_words.append(len(words))
                n_removed.append(sum(e - a for a, e in s))
                if rewrite:
                    kept.append(_cut(t, s) if s else t)
                else:
                    at, left = 0, []
                    for a, e in s:
                        left += words[at:a]
                        at = e
                    kept.append(hashlib.sha256(b" ".join(left + words[at:] if s else words)).hexdigest())
            if rewrite:
                i = b.schema.get_field_index("text")
                b = b.set_column(i, b.schema.field(i), pa.array(kept, pa.binary()).cast(b.column(i).type))
                yield b.append_column("_words", pa.array(n_words, pa.int64())).append_column("_removed", pa.array(n_removed, pa.int64()))
            else:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans' words and what follows each span up to the next word."""
    starts, _ = word_bounds(np.frombuffer(text, np.uint8), IS_WORD)
    out, at = [], 0
    for a, e in spans:
        out.append(text[at : starts[a]])
        at = int(starts[e]) if e < len(starts) else len(text)
    return b"".join([*out, text[at:]])


def _marked(docs: DataFrame, window: int) -> DataFrame:
    base = docs.withColumn("_th", F.xxhash64("text"))
    copies, parsed = factors(base, window)
    marks = parsed.join(copies, ["doc_id", "_th"], "full_outer").select("doc_id", "_th", "_factors", "_first")
    return base.join(marks, ["doc_id", "_th"], "left")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of anything but \\x20 and \\x09-\\x0D, unchanged.  Removed are the words of every run of `window` words
    that also starts in a document with a smaller doc_id.  Null and empty texts have no words; rows without doc_id and rows with
    equal doc_id remove nothing from each other, repeated rows give repeated rows.  Other columns are ignored; an empty table gives an empty
    one.  A text of any length is read whole by one worker.
    """
    return _marked(docs.select("doc_id", "text"), window).mapInArrow(_finish(window, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removed words cut from text and n_chars recounted; documents of which no word is left go, others stay."""
    marked = _marked(packed(docs), window)
    schema = T.StructType([*marked.schema, T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType())])
    out = marked.mapInArrow(_finish(window, True), schema).where("_removed = 0 or _removed < _words")
    return unpacked(out, docs, F.col("_removed") > 0)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
pos AS (SELECT DISTINCT doc_id, p FROM win JOIN firsts USING (s), unnest(range(i, i + 50)) AS t(p) WHERE first < doc_id),
gone AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM pos GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, string_agg(x, ' ' ORDER BY p) AS s
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS d ANTI JOIN pos USING (doc_id, p) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
