"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer texts are not learned from, so that a sample is bounded in bytes too.
TEXT_BYTES = 1 << 16


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """At most `rows` labelled rows for which `allowed` holds, half of them of each label as far as there are so many, with the columns of docs.

    The choice is by a hash of doc_id, so that it is the same in every run and spread over the table.  However often a
    doc_id is repeated it gives one row, that with the least text; texts of more than text_bytes bytes are passed over.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.union(part)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    got = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes).join(F.broadcast(chosen), "doc_id")
    return got.groupBy("doc_id", "_label").agg(F.min(F.struct("text", *rest)).alias("_least")).select("doc_id", "_label", *(F.col("_least").getField(c).alias(c) for c in ["text", *rest]))
