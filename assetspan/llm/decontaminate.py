"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of document rows inside one task.  Its words become symbols: words that occur in no benchmark
window become a separator, and runs of other words that are shorter than the shortest window are left out,
neither of which can lose an occurrence.  The suffix array of what remains gives the Burrows-Wheeler transform, a
wavelet matrix over it answers ranks, and all windows are searched backwards at once.  Suffix positions are sampled
at every SAMPLE-th position and at each run's start; other occurrences step back to the next sample.
Spans that touch or overlap merge.

Benchmarks reach the tasks in blocks of BLOCK_BYTES of text at most, or one item where that is longer.  A benchmark of one block is
searched in one pass without a shuffle.  Each block of a larger one has a pass of its own over the documents, of which
only hits are stored before the next block is read, so that driver and workers hold one block at a time; the hits then meet by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.llm._common import ALNUM, Rolling, chunks, cut, mix, packed, raw, suffix_array, unpacked, word_bounds, word_hashes

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20

IS_WORD = np.array([i != 32 for i in range(256)])
WORDS = Rolling(0x6A09E667F3BCC909)
words_of = re.compile(rb"[^ ]+").finditer


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin."""
    parts = [(t or b"").translate(ALNUM) for t in texts]
    buffer = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    starts, ends = word_bounds(buffer, IS_WORD)
    base = np.concatenate(([0], np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))))
    return word_hashes(buffer, starts, ends), np.searchsorted(starts, base)


class Windows:
    """The distinct windows of a block of benchmark items, in symbols from 1 on, and the items of each, in arrays."""

    def __init__(self, items: list[tuple[object, bytes | None]], size: int = WINDOW):
        words, begin = hashed_words([t for _, t in items])
        self.known = np.unique(words)
        symbol = self.symbols(words)
        count = np.diff(begin)
        each = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), each)
        first = np.repeat(begin[:-1], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        length = np.minimum(count, size)[item]
        key = mix(WORDS.runs(WORDS.prefix(words), first, first + length) + length.astype(np.uint64))
        _, at, window = np.unique(key, return_index=True, return_inverse=True)
        self.length = length[at]
        self.shortest = int(self.length.min()) if len(at) else 0
        self.matrix = np.zeros((len(at), size), np.int32)
        for k in range(size):
            on = self.length > k
            self.matrix[on, k] = symbol[first[at[on]] + k]
        names, name = np.unique(np.array(["" if i is None else str(i) for i, _ in items], dtype=object).astype(str) if items else np.zeros(0, str), return_inverse=True)
        self.names = names.tolist()
        pair = np.unique(np.stack([window, name[item]], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.item = pair[:, 1]
        self.bounds = np.searchsorted(pair[:, 0], np.arange(len(at) + 1))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for words of no window."""
        if not len(self.known):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at + 1, 0)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Names of the items of any of the windows, in order."""
        found = {int(i) for w in np.unique(windows).tolist() for i in self.item[self.bounds[w] : self.bounds[w + 1]]}
        return [self.names[i] for i in sorted(found)]


class FMIndex:
    """text: symbols; 0 is a separator that no pattern holds.  The text begins and ends with one."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        unique = text + (text == 0).sum()
        unique[text == 0] = np.arange((text == 0).sum())  # each separator its own symbol, so that suffixes differ soon
        order = suffix_array(unique)
        last = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (last >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            zeros = n - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        self.bwt = text[order - 1]
        start = np.zeros(n, bool)
        start[1:] = text[:-1] == 0
        sampled = (np.arange(n) % SAMPLE == 0) | start | (text == 0)
        self.sampled = sampled[order]
        self.position = order[self.sampled]
        self.before = np.concatenate(([0], np.cumsum(self.sampled)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the transform."""
        low, high = np.zeros_like(at), at.copy()
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pattern occurs, and where: two arrays with one entry per occurrence."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for back in range(int(length.max(initial=0))):
            on = length[which] > back
            rest = (which[~on], low[~on], high[~on])
            which, low, high = which[on], low[on], high[on]
            c = patterns[which, length[which] - 1 - back]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            live = low < high
            which, low, high = (np.concatenate((x[live], y)) for x, y in zip((which, low, high), rest))
        count = high - low
        pattern = np.repeat(which, count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        steps, todo = np.zeros(len(row), np.int64), np.arange(len(row))
        while len(todo := todo[~self.sampled[row[todo]]]):
            c = self.bwt[row[todo]]
            row[todo] = self.first[c] + self.rank(c, row[todo])
            steps[todo] += 1
        return pattern, self.position[self.before[row]] + steps


def shard_hits(words: np.ndarray, begin: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shard's hashed words: document, first word and window of each occurrence, by document."""
    none = np.zeros(0, np.int64)
    if not len(windows.matrix) or not len(words):
        return none, none, none
    found = windows.symbols(words)
    symbols = np.zeros(len(words) + len(begin) - 1, np.int64)  # one separator after each document
    symbols[np.arange(len(words)) + np.repeat(np.arange(len(begin) - 1), np.diff(begin))] = found
    flag = np.concatenate(([0], (symbols > 0).astype(np.int8), [0]))
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= windows.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none
    size = ends - starts + 1
    base = np.concatenate(([1], 1 + np.cumsum(size)))  # of each run in the reduced text; one separator after each
    text = np.zeros(int(base[-1]), np.int64)
    place = np.full(int(base[-1]), -1, np.int64)
    inside = np.arange((size - 1).sum()) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    to, at = np.repeat(base[:-1], size - 1) + inside, np.repeat(starts, size - 1) + inside
    text[to], place[to] = symbols[at], at
    which, where = FMIndex(text, len(windows.known)).search(windows.matrix, windows.length)
    where = place[where]
    first = begin[:-1] + np.arange(len(begin) - 1)
    doc = np.searchsorted(first, where, side="right") - 1
    order = np.argsort(doc, kind="stable")
    return doc[order], (where - first[doc])[order], which[order]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what follows each of them up to the next word."""
    bounds = [m.span() for m in words_of(text.translate(ALNUM))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : bounds[a][0]])
        at = bounds[b][0] if b < len(bounds) else len(text)
    return b"".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "_words long, _spans array<struct<start:int,end:int>>, _items array<string>"
_built: list[tuple[bytes, int, Windows]] = []


def _windows(items: list[tuple[object, bytes | None]], digest: bytes, size: int) -> Windows:
    """The block's windows, built once per worker for the block at hand."""
    if not _built or _built[0][:2] != (digest, size):
        _built[:] = [(digest, size, Windows(items, size))]
    return _built[0][2]


def _hits(texts: list[bytes | None], windows: Windows) -> tuple[list[int], list[list | None], list[list | None]]:
    """Number of words, merged spans and item names of each text."""
    words, begin = hashed_words(texts)
    doc, first, which = shard_hits(words, begin, windows)
    spans: list[list | None] = [None] * len(texts)
    names: list[list | None] = [None] * len(texts)
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        spans[d] = merged(list(zip(first[a:b].tolist(), (first[a:b] + windows.length[which[a:b]]).tolist())))
        names[d] = windows.items_of(which[a:b])
    return np.diff(begin).tolist(), spans, names


def _pass(items: list[tuple[object, bytes | None]], size: int, rewrite: bool = False):
    """Adds _words, _spans and _items to the rows; with rewrite the spans are cut from text."""
    digest = hashlib.sha256(repr(items).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(items, digest, size)
        for b in chunks(batches, "text", SHARD_BYTES):
            n, spans, names = _hits(raw(b, "text"), windows)
            shown = [None if s is None else [{"start": x, "end": y} for x, y in s] for s in spans]
            new = [pa.array(n, pa.int64()), pa.array(shown, _SPANS), pa.array(names, pa.list_(pa.string()))]
            out = _cut(b, spans) if rewrite else b
            yield pa.RecordBatch.from_arrays([*out.columns, *new], [*b.schema.names, "_words", "_spans", "_items"])

    return run


def _cut(batch: pa.RecordBatch, spans: list[list[tuple[int, int]] | None]) -> pa.RecordBatch:
    """The batch without the spans' words."""
    if not any(spans):
        return batch
    at = batch.schema.get_field_index("text")
    kept = [without(t, s) if s else t for t, s in zip(raw(batch, "text"), spans)]
    return batch.set_column(at, batch.schema.field(at), pa.array(kept, pa.binary()).cast(batch.column(at).type))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, bytes | None]]]:
    """The distinct items in parts of at most block_bytes of text; an item larger than that is a part of its own."""
    part: list[tuple[object, bytes | None]] = []
    size = 0
    for item, text in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        text = None if text is None else bytes(text)
        if part and size + len(text or b"") > block_bytes:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text or b"")
    yield part


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, rewrite: bool = False) -> DataFrame:
    """docs with three more columns: `_words` (count), `_spans` (merged word spans of hits, or null), `_items` (ids, or null).

    Words are maximal runs of ASCII letters and digits and non-ASCII characters, lower-cased in A-Z.  A window is
    `window` consecutive words of an item, or all words of a shorter one.  Null and empty texts have no words; an
    item without words has no window; equal items count each by its id, an item without id by the empty string.  Every row of
    docs gives one row, repeated ones too; an empty table gives an empty one, and an empty benchmark hits nothing.  docs must have
    doc_id and text, and no columns of those three names.  With rewrite the spans are cut from text.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _FOUND
    parts = blocks(benchmark, block_bytes)
    items, following = next(parts), next(parts, None)
    if following is None:
        return docs.mapInArrow(_pass(items, window, rewrite), schema)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_th"), "text")
    found, count = [], None
    while items is not None:
        hits = keyed.mapInArrow(_pass(items, window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th long, text string, {_FOUND}")
        found.append(cut(hits.where("_spans is not null").select("doc_id", "_th", "_spans", "_items")))
        items, following = following, next(parts, None)
    every = reduce(DataFrame.union, found).groupBy("doc_id", "_th").agg(F.collect_list("_spans").alias("_lists"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    every = every.select(F.col("doc_id").alias("_doc"), "_th", F.array_sort(F.flatten("_lists")).alias("_lists"), "_items")
    counted = docs.mapInArrow(_pass([], window), schema).drop("_spans", "_items").withColumn("_key", F.xxhash64("text"))
    joined = counted.join(every, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_th")), "left").drop("_doc", "_th", "_key")
    return joined.mapInArrow(_merge(rewrite), schema)


def _merge(rewrite: bool):
    """Merges the spans that several blocks found, in _lists, and with rewrite cuts them from text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            lists = b.column(b.schema.get_field_index("_lists")).to_pylist()
            spans = [None if x is None else merged([(y["start"], y["end"]) for y in x]) for x in lists]
            shown = [None if s is None else [{"start": x, "end": y} for x, y in s] for s in spans]
            out = _cut(b, spans) if rewrite else b
            names = [n for n in b.schema.names if n not in ("_lists", "_items")]
            columns = [out.column(out.schema.get_field_index(n)) for n in [*names, "_items"]]
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(shown, _SPANS), columns[-1]], [*names, "_spans", "_items"])

    return run


def report(found: DataFrame) -> DataFrame:
    """The digest columns of each row of find()."""
    items = F.coalesce("_items", F.array().cast("array<string>"))
    hit = F.aggregate(F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit words cut from text and n_chars recounted; documents of which no word is left go, others stay."""
    hit = F.aggregate(F.col("_spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = find(packed(docs), benchmark, window, block_bytes, rewrite=True).where(F.col("_spans").isNull() | (hit < F.col("_words")))
    return unpacked(out, docs, F.col("_spans").isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return report(find(docs.select("doc_id", "text"), benchmark))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
  FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
