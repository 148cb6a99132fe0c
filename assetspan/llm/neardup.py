"""MinHash near-dedup with ProbMinHash signatures, banding and exact verification.

Signatures: each distinct shingle (SHINGLE consecutive words) of a text is a Poisson process of rate 1; each arrival falls into one of
REGISTERS registers, which keeps the shingle that came first.  A shingle stops as soon as its next arrival is later than the last of all
registers' first arrivals, so that most stop after a few.  Two texts agree in a register with the probability Jaccard similarity
of their weighted shingles, which for equal weights is the Jaccard similarity of the sets, the one that is verified; weights by
counts of one text would lower it where two texts repeat different passages.  Of a register's shingle 16 bits are kept.

Candidates: BANDS bands of ROWS registers each; at a similarity of 0.8 all bands miss with probability 3e-6.  A pair that agrees in
fewer than LEAST_AGREE registers is given up, which at a similarity of 0.8 happens with probability 1e-8; so the sets of
shingles, which are far larger than signatures, are made for few texts only.
Equal texts are one node from the start, so that copies make no pairs.  Inside a band's bucket:
1. every member is compared with one hub, the member that shares most buckets with others;
2. in buckets that still hold several classes, small ones compare members of different classes, larger ones members outside the
   hub's class with HUBS more hubs;
3. members that are still outside are compared with all members of other classes, as far as the sizes of both and the shingles that
   occur in no other text allow a similarity of 0.8 at all, in blocks of bounded size.
Pairs become rows in the first two steps only, where their number grows with the bucket and not with its square; no
link between classes is given up.
Verification is exact: Jaccard similarity of the shingle sets of at least THRESHOLD.  Classes are
the connected components, found by spreading least ids with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.llm._common import ALNUM, BROADCAST_ROWS, Rolling, chunks, cut, mix, packed, raw, small, unpacked, word_bounds, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, ROWS, BANDS = 96, 4, 24
LEAST_AGREE = 53
SMALL, HUBS = 32, 4
BLOCK_OUTSIDE, BLOCK_ALL = 2048, 2048

IS_WORD = np.array([i != 32 for i in range(256)])
WORDS = Rolling(0xBB67AE8584CAA73B)


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, shingle hash and count, sorted by the first two.  Texts of fewer words have all of them as their one shingle."""
    parts = [(t or b"").translate(ALNUM) for t in texts]
    buffer = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    starts, ends = word_bounds(buffer, IS_WORD)
    base = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    begin = np.searchsorted(starts, base)
    words = word_hashes(buffer, starts, ends)
    n = np.diff(begin)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(begin[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, SHINGLE)[doc]
    hashes = mix(WORDS.runs(WORDS.prefix(words), first, first + size) + size.astype(np.uint64))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """[n, registers] shingles by ProbMinHash; texts without shingles have zeros."""
    first = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        u = mix(shingle + np.uint64(0x9E3779B97F4A7C15 * step % (1 << 64)))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        at = doc * registers + (mix(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        out[at[won]] = shingle[won]
        on = time < first.reshape(n, registers).max(1)[doc]
        doc, shingle, weight, time = doc[on], shingle[on], weight[on], time[on]
    return out.reshape(n, registers)


def packed_signature(signature: np.ndarray) -> np.ndarray:
    """[n, bands] numbers, each of ROWS registers of 16 bits."""
    return np.ascontiguousarray(signature.astype(np.uint16)).view(np.int64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many registers packed signatures agree, row by row."""
    return (x.view(np.uint16) == y.view(np.uint16)).sum(1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "md5", "th", "n", "sig"]
    for b in chunks(batches, "text"):
        doc, shingle, _ = shingles(raw(b, "text"))
        size = np.bincount(doc, minlength=b.num_rows)
        packs = packed_signature(signatures(doc, shingle, np.ones(len(doc)), b.num_rows))
        some = size > 0
        sig = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))), pa.int32()), pa.array(packs[some].ravel()))
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names[:3]), pa.array(size), sig], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        doc, shingle, _ = shingles(raw(b, "text"))
        ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b.num_rows))))
        sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shingle.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "set"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (b.column(i).flatten().to_numpy().reshape(-1, BANDS) for i in (2, 3))
        yield b.select([0, 1]).filter(pa.array(agreement(x, y) >= LEAST_AGREE))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(*(b.column(i) for i in (2, 3))):
            x, y = (z.values.to_numpy() for z in (x, y))
            o = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(o >= THRESHOLD * (len(x) + len(y) - o) - 1e-9)
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _ends(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """a, b and the columns of side (node, ...) for both of them, named with x_ and y_."""
    for end, name in (("a", "x_"), ("b", "y_")):
        pairs = pairs.join(side.select(F.col("node").alias(end), *(F.col(c).alias(name + c) for c in columns)), end)
    return pairs.select("a", "b", *(n + c for c in columns for n in ("x_", "y_")))


def sets_of(wanted: DataFrame, nodes: DataFrame, usable: DataFrame) -> DataFrame:
    """(node, set) of the nodes in wanted, from their texts."""
    keys = small(cut(wanted.join(nodes, "node").select("node", F.col("first").alias("doc_id"), "th")))
    texts = usable.join(keys, ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(_sets, "node long, set array<long>")


def linked(pairs: DataFrame, nodes: DataFrame, usable: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of texts that are similar enough."""
    fits = f"least(x_n, y_n) >= {THRESHOLD} * greatest(x_n, y_n) - 1e-9"
    alike = cut(_ends(pairs, nodes, "n", "sig").where(fits).select("a", "b", "x_sig", "y_sig").mapInArrow(_alike, "a long, b long"))
    wanted = alike.select(F.col("a").alias("node")).union(alike.select("b")).distinct()
    return _ends(alike, cut(sets_of(wanted, nodes, usable)), "set").mapInArrow(_similar, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes that have an edge."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    wrap = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda df: df
    while True:
        near = both.join(wrap(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = near.join(wrap(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(low.join(wrap(jump), "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = not new.where("label < old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one class, with their class."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return named.join(mixed, "key")


def _pairs(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
    """Distinct (a, b), a < b, of rows of x and y in one bucket for which the condition holds."""
    x, y = x.alias("x"), y.alias("y")
    return x.join(y, F.expr(f"x.key = y.key and x.node <> y.node and x.label <> y.label and ({condition})")).select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def _nodes(own: DataFrame) -> DataFrame:
    """One row per text: md5, node, first (its least doc_id), th, n, sig, copies (rows).

    A node is called by its first doc_id; where several texts have the same, by a hash of text and doc_id.
    """
    texts = cut(own.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("th").alias("th"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    shared = texts.groupBy("first").agg(F.count("*").alias("k")).where("k > 1").select("first", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return texts.withColumn("node", F.col("first"))
    return cut(texts.join(shared, "first", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("md5", "first")).otherwise(F.col("first"))))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, found): own has doc_id, md5 and th of each row with both doc_id and text; found has md5, class_id (the class's
    least doc_id) and keeper (whether the text is the class's first) of the texts that more than one row or another text share."""
    usable = docs.where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5"), F.xxhash64("text").alias("th"), "text")
    own = cut(usable.mapInArrow(_sign, "doc_id long, md5 binary, th long, n long, sig array<long>"))
    usable = usable.select("doc_id", "th", "text")
    nodes = _nodes(own)
    exploded = nodes.select("node", F.posexplode("sig").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key"))
    buckets = cut(exploded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"))
    members = cut(exploded.join(small(buckets.where("n > 2").select("key", "n")), "key"))
    members = cut(members.join(members.groupBy("node").agg(F.sum("n").alias("center")), "node"))
    hub = members.groupBy("key").agg(F.max(F.struct("center", (-F.col("node")).alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("hub"))
    first = members.join(hub, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    edges = cut(linked(first.union(buckets.where("n = 2").select("a", "b")).distinct(), nodes, usable))
    labels = components(edges)

    mixed = cut(_labelled(members, labels))
    if not mixed.isEmpty():
        few, large = mixed.where(F.col("n") <= SMALL), mixed.where(F.col("n") > SMALL)
        best = F.max(F.struct("center", "node", "label")).alias("t")
        hubs = large.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("salt")).agg(best).select("key", "t.node", "t.label")
        again = _pairs(few, few, "x.node < y.node").union(_pairs(large, hubs, "true")).distinct().join(edges, ["a", "b"], "left_anti")
        edges = cut(edges.union(linked(again, nodes, usable)))
        labels = components(edges)
        mixed = cut(_labelled(members.where(F.col("n") > SMALL), labels))
        if not mixed.isEmpty():
            inside = cut(sets_of(mixed.select("node").distinct(), nodes, usable))
            tokens = inside.select("node", F.explode("set").alias("token"))
            alone = tokens.groupBy("token").agg(F.count("*").alias("df"), F.first("node").alias("node")).where("df = 1").groupBy("node").agg(F.count("*").alias("lone"))
            size = inside.select("node", F.size("set").alias("size")).join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common"))
            opened = mixed.join(size, "node").where(f"common >= {THRESHOLD} * size - 1e-9")
            major = opened.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("m")).select("key", F.col("m.label").alias("major"))
            opened = cut(opened.join(major, "key"))
            edges = cut(edges.union(_blocks(opened, inside)))
            labels = components(edges)

    texts = nodes.select("node", "md5", "first", "copies").join(small(labels), "node", "left")
    linked_texts = cut(texts.where("label is not null or copies > 1").select("md5", "first", F.coalesce("label", "node").alias("label")))
    least = linked_texts.groupBy("label").agg(F.min(F.struct("first", "md5")).alias("least"))
    found = linked_texts.join(least, "label").select("md5", F.col("least.first").alias("class_id"), (F.col("md5") == F.col("least.md5")).alias("keeper"))
    return own.select("doc_id", "md5", "th"), cut(found)


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class).

    Two texts are linked if they are equal or if the Jaccard similarity of their sets of SHINGLE words (ASCII letters, digits and
    non-ASCII characters, A-Z lower-cased) is at least THRESHOLD; a text of fewer words has one shingle of all of them, one without words
    is linked to equal texts only.  A null text is in a class of its own; without doc_id there is no class (null).  Repeated rows
    give repeated rows; rows of one doc_id with different texts are in one class only if these are linked, though both classes may be called by
    that doc_id.  Other columns are ignored; an empty table gives an empty one.  A text of any length is read whole by one worker.
    """
    own, found = _grouped(docs)
    rows = own.select("doc_id", "md5").join(small(found.select("md5", "class_id")), "md5", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return rows.union(docs.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id")))


def _blocks(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members outside a bucket's largest class and members of other classes, one per member, class and block.

    A bucket is dealt to blocks of about BLOCK_OUTSIDE members outside by BLOCK_ALL members of all, so that a block is bounded however
    large the bucket is; the sets go along, and pairs are compared inside a block without becoming rows.
    """
    count = opened.groupBy("key").agg(F.count("*").alias("all"), F.count_if(F.col("label") != F.col("major")).alias("outside"))
    parts = count.select("key", F.ceil(F.col("outside") / BLOCK_OUTSIDE).cast("int").alias("ox"), F.ceil(F.col("all") / BLOCK_ALL).cast("int").alias("oy"))
    dealt = opened.join(sets, "node").join(parts, "key").withColumn("h", F.xxhash64("node"))
    columns = ["key", "bx", "by", "role", "node", "label", "common", "set"]
    outside = dealt.where("label <> major").select("*", F.lit("x").alias("role"), F.pmod("h", "ox").cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("oy") - 1)).alias("by"))
    every = dealt.select("*", F.lit("y").alias("role"), F.explode(F.sequence(F.lit(0), F.col("ox") - 1)).alias("bx"), F.pmod("h", "oy").cast("int").alias("by"))
    return outside.select(columns).union(every.select(columns)).groupBy("key", "bx", "by").applyInPandas(_compare, "a long, b long").distinct()


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y = (pdf[pdf["role"] == r] for r in "xy")
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    nx = x["set"].map(len).to_numpy()
    token, owner = np.concatenate(list(x["set"])), np.repeat(np.arange(len(x)), nx)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    xn, xl, xc = (x[c].to_numpy() for c in ("node", "label", "common"))
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for node, label, common, own in zip(y["node"], y["label"], y["common"], y["set"]):
        near = (xl != label) & ((1 + THRESHOLD) * np.minimum(xc, common) >= THRESHOLD * (nx + len(own)) - 1e-9)
        if near.any():
            low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
            size = high - low
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.bincount(owner[at], minlength=len(x))
            for i in np.flatnonzero(near & (shared >= THRESHOLD * (nx + len(own) - shared) - 1e-9)):
                found.setdefault((int(xn[i]), int(label)), (min(int(xn[i]), int(node)), max(int(xn[i]), int(node))))
    return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype="int64")


def survivors(docs: DataFrame) -> DataFrame:
    """docs with one text of each class, that with the least doc_id, in one row; rows without doc_id or text stay.

    Rows of one doc_id with different texts are different documents; of rows with the same doc_id and text one stays, whichever its other
    columns.  An empty table gives an empty one.
    """
    own, found = _grouped(docs.select("doc_id", "text"))
    marked = cut(own.join(small(found), "md5"))
    gone = small(marked.where("not keeper or doc_id > class_id").select("doc_id", "th").distinct())
    left = docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["th"]), "left_anti")
    if marked.where("keeper and doc_id = class_id").groupBy("doc_id", "th").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return left
    rows, usable = packed(left), F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    keyed = rows.where(usable).withColumn("_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_th"]).drop("_th")
    return unpacked(keyed.union(rows.where(~usable)), docs)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE o >= 0.8 * (x.n + y.n - o) - 1e-9
  UNION SELECT a.doc_id, b.doc_id FROM d AS a JOIN d AS b ON a.text = b.text AND a.doc_id < b.doc_id),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
"""
