"""Sharding by Karmarkar-Karp differencing, for groups that must stay whole.

A partial partition is a vector of one sum per shard.  Differencing takes the two with the largest spread, joins them oppositely
ordered (largest slot to smallest), and puts the result back, until one is left.  Groups larger than a part of 2 * shards * LARGE
of all bytes (or than a fair part of a bucket, if buckets are fewer) are differenced first, by themselves: there are at most so many.  All
others are dealt to buckets of about CHUNK groups by hash, as many as it takes.
A bucket begins with its share of the large groups' vector as a first partial partition, takes CHUNK groups at a time,
and goes on with the resulting vector, so that what one step leaves uneven the next ones make up for.  As shards are
alike before that, a vector's slots keep their numbers from step to step, and buckets need not meet again.

The law is `bytes`.  A group larger than a shard's fair share makes its shard that large; nothing can be done for an
indivisible group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetspan.llm._common import cut

SHARDS = 40
OVERHEAD = 16
CHUNK, LARGE = 2000, 2000
#: Rows of one slot-numbering bucket.
RANK_ROWS = 20_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions [n, shards]: the final sums, and for each row and slot its final slot."""
    n, k = sums.shape
    order = np.argsort(sums, axis=1, kind="stable")
    vector: list[np.ndarray | None] = list(np.take_along_axis(sums, order, 1))
    heap = [(-int(v[-1] - v[0]), i) for i, v in enumerate(vector)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vector[a] + vector[b][::-1]
        to = np.argsort(total, kind="stable")
        vector[a] = vector[b] = None
        total = total[to]
        joined.append((a, b, to))
        vector.append(total)
        heapq.heappush(heap, (-int(total[-1] - total[0]), len(vector) - 1))
    final: list[np.ndarray | None] = [None] * len(vector)
    final[-1] = np.arange(k)
    for i in range(len(joined) - 1, -1, -1):
        a, b, to = joined[i]
        up = final[n + i]
        place = np.empty(k, np.int64)
        place[to] = up
        final[a], final[b], final[n + i] = place, place[::-1], None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = final[i]
    return vector[-1], out


def deal(size: np.ndarray, start: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each group when added to the sums in start, and the sums then."""
    k, sums, out = len(start), start.astype(np.int64), np.empty(len(size), np.int64)
    for at in np.array_split(np.arange(len(size)), -(-len(size) // chunk)):  # of even length: a few groups alone can't be levelled
        part = size[at]
        vectors = np.zeros((len(part) + 1, k), np.int64)
        vectors[0], vectors[1:, -1] = sums, part
        total, slots = difference(vectors)
        name = np.empty(k, np.int64)
        name[slots[0]] = np.arange(k)  # a final slot is called what the first vector's slot in it is called
        out[at] = name[slots[1:, -1]]
        sums = total[slots[0]]
    return out, sums


def _bucket(start: list[int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["th", "n"], kind="stable")
        shard, sums = deal(pdf["size"].to_numpy(), np.array(start), CHUNK)
        return pd.DataFrame({"th": pdf["th"], "n": pdf["n"], "shard": shard, "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})

    return run


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups (th, n, size), (th, n) unique -> th, n, shard."""
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-count // CHUNK))
    part = F.col("size") * 2 * shards * min(buckets, LARGE)
    schema = "th long, n long, shard int, sums array<long>"
    large = cut(groups.where(part > total).groupBy(F.col("size") < 0).applyInPandas(_bucket([0] * shards), schema))
    sums = large.where("sums is not null").select("sums").first()  # one number per shard
    start = [x // buckets for x in sums[0]] if sums else [0] * shards
    small = groups.where(part <= total).groupBy(F.pmod(F.xxhash64("th", "n", F.lit(1)), F.lit(buckets)))
    return cut(large.union(small.applyInPandas(_bucket(start), schema)).select("th", "n", "shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of equal text form a group, which stays in one shard; null texts are a group like the empty text's, with crc32 of no bytes.
    size is the bytes of the text plus OVERHEAD; slots count from 0 without gaps in each shard; grown_shard is null under
    the law `bytes`.  Repeated rows and null doc_ids are rows like others; an empty table gives an empty one.
    """
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        )
    )
    # two 64-bit hashes of a text that agree, crc32 and length included, put different texts into one group at worst
    rows = rows.withColumn("n", F.col("text_crc32") * 4 + F.pmod("size", F.lit(4)))
    groups = rows.groupBy("th", "n").agg(F.sum("size").alias("size"))
    placed = rows.join(assign(cut(groups), shards), ["th", "n"])
    buckets = max(1, -(-rows.count() // RANK_ROWS))
    ranked = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.lit(buckets)))
    ranked = cut(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "th")) - 1))
    counts = ranked.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("shard", "bucket", "offset")
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
