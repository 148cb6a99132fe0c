"""Identities and fingerprints; small payloads get canonical JSON, tables an order-free digest."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assetspan.functions.scalars import canonical_url


def _json_text(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"^\{\"v\":(.*)\}$", 1)


def json_list(*columns: Column) -> Column:
    """A compact JSON list of texts and whole numbers."""
    return F.concat(F.lit("["), F.concat_ws(",", *columns), F.lit("]"))


def text_hash(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def source_id(company: Column, kind: Column, url: Column) -> Column:
    return F.concat(F.lit("source-"), text_hash(json_list(_json_text(company), _json_text(kind), _json_text(canonical_url(url)))))


def job_id(source: Column, sha: Column) -> Column:
    return F.concat(F.lit("job-"), text_hash(F.concat(source, F.lit("\n"), sha), 32))


def new_contract_id(asset: Column, source: Column, sha: Column, index: Column, salt: Column | None = None) -> Column:
    """With a salt above 0 the index becomes the text `index.salt`."""
    plain = index.cast("string")
    number = plain if salt is None else F.when(salt == 0, plain).otherwise(F.concat(F.lit('"'), plain, F.lit("."), salt.cast("string"), F.lit('"')))
    return F.concat(asset, F.lit("-r"), text_hash(json_list(_json_text(source), _json_text(sha), number), 12))


def decision_event_id(job: Column, collection: Column, index: Column) -> Column:
    return F.concat(F.lit("reading-"), text_hash(json_list(_json_text(job), _json_text(collection), index.cast("string")), 20))


def title_event_id(source: Column) -> Column:
    return F.concat(F.lit("news-"), text_hash(_json_text(source), 20))


def group_event_id(company: Column, url: Column, title: Column) -> Column:
    parts = [F.when(c.isNull(), "null").otherwise(_json_text(c)) for c in (company, url, title)]
    return F.concat(F.lit("event-"), text_hash(json_list(*parts), 20))


def content_fingerprint(raw: Column, text: Column) -> Column:
    """PDF bytes by themselves, HTML by the text a reader sees."""
    pdf = F.ltrim(F.substring(raw.cast("string"), 1, 64)).startswith("%PDF-")
    return F.when(pdf, F.sha2(raw.cast("binary"), 256)).otherwise(F.sha2(text, 256))


@F.pandas_udf(StringType())
def canonical_hash(values: pd.Series) -> pd.Series:
    """SHA-256 of key-sorted compact JSON, for small JSON payloads; null and what is no JSON give null."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else hashlib.sha256(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except ValueError:
            return None

    return values.map(one)


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) for a table of any size, whatever the order of its rows; partial sums make the shuffle small."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in sorted(df.columns)])
    low = F.pmod(row, F.lit(1 << 31))
    high = F.shiftrightunsigned(row, 31).cast("decimal(20,0)")
    return df.select(row.alias("_h"), low.alias("_l"), high.alias("_u")).agg(
        F.count("*").alias("rows"),
        F.sha2(F.concat_ws("-", F.count("*").cast("string"), F.bit_xor("_h").cast("string"), F.coalesce(F.sum("_l"), F.lit(0)).cast("string"), F.coalesce(F.sum("_u"), F.lit(0)).cast("string")), 256).alias("digest"),
    )


#: Hashes that one node of a tree joins.
FAN = 1024


def tree_digest(leaves: DataFrame) -> DataFrame:
    """One row (rows, digest) for ordered texts of any number: leaves is (n, leaf) with n counted from 0 without gaps.

    A leaf's hash is that of its text, a node's hash that of its FAN children's hashes in order, level by level until one node is left.  What meets in a
    task is FAN hashes; a level has a FANth of the rows of the one below.  No rows give the hash of an empty text.
    """
    level = leaves.select("n", F.sha2(F.coalesce("leaf", F.lit("null")), 256).alias("h"))
    rows = level.count()
    width = rows
    while True:
        children = F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda c: c["h"])
        level = level.groupBy(F.floor(F.col("n") / FAN).alias("n")).agg(F.sha2(F.array_join(children, ""), 256).alias("h"))
        width = -(-width // FAN)
        if width <= 1:
            break
    return level.agg(F.lit(rows).cast("long").alias("rows"), F.coalesce(F.first("h"), F.sha2(F.lit(""), 256)).alias("digest"))
