"""Tables that a stream carries from version to version.

A state is a folder.  A commit file per version says which folders hold its tables and which batch of which stream each one came from; it is put by
one writer only, so that a version, what it holds and the batch behind it become true together.  Tables are kept in buckets of their key, and a version
writes only the buckets that it changes.  What every version adds (outcomes, changes, holds, events) stands under the version's tag and
counts from the commit on: what a batch that failed has left behind is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetspan.sources import commits

NAME, BUCKETS = "state", 64


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _written(df: DataFrame, path: str, name: str, tag: str, key: str) -> dict[str, str]:
    """Bucket and folder of what was written."""
    folder = f"{path}/tables/{name}/{tag}"
    df.withColumn("state_bucket", bucket(key)).repartition("state_bucket").write.partitionBy("state_bucket").parquet(folder)
    found = df.sparkSession.read.schema(StructType(df.schema.fields).add("state_bucket", "integer")).parquet(folder).select("state_bucket").distinct().collect()  # BUCKETS rows at most
    return {str(r[0]): f"{tag}/state_bucket={r[0]}" for r in found}


def start(spark: SparkSession, path: str, tables: dict[str, DataFrame], key: str = "asset_id") -> int:
    """Version 1 of a state; where there is a state it is left as it is.  Gives the version that counts."""
    number, _ = commits.latest(spark, path, NAME)
    if number:
        return number
    tag = f"{1:012d}-{uuid.uuid4().hex[:8]}"
    record = {"tag": tag, "key": key, "streams": {}, "tables": {n: {"schema": df.schema.jsonValue(), "folders": _written(df, path, n, tag, key)} for n, df in tables.items()}}
    commits.put_text(spark, commits.commit_file(path, NAME, 1), json.dumps(record))
    return commits.latest(spark, path, NAME)[0]


def read(spark: SparkSession, path: str, record: dict) -> dict[str, DataFrame]:
    """The tables of a version."""
    out = {}
    for name, t in record["tables"].items():
        schema = StructType.fromJson(t["schema"])
        paths = [f"{path}/tables/{name}/{f}" for f in t["folders"].values()]
        out[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return out


def advance(spark: SparkSession, path: str, number: int, record: dict, tables: dict[str, DataFrame], keys: DataFrame, added: dict[str, DataFrame], stream: str, batch: int) -> bool:
    """Commit the version after `number`; False if another stream has committed one meanwhile.

    tables: whole tables, of which only the buckets of `keys` are written; added: rows that this version adds to its history.
    """
    key, tag = record["key"], f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
    touched = sorted(r[0] for r in keys.select(bucket(key).alias("b")).distinct().collect())  # BUCKETS rows at most
    new = {"tag": tag, "key": key, "streams": record["streams"] | {stream: batch}, "tables": {}}
    for name, df in tables.items():
        kept = {b: f for b, f in record["tables"][name]["folders"].items() if int(b) not in touched}
        written = _written(df.where(bucket(key).isin(touched)), path, name, tag, key) if touched else {}
        new["tables"][name] = {"schema": df.schema.jsonValue(), "folders": kept | written}
    for name, df in added.items():
        df.withColumn("state_bucket", bucket("job_id")).repartition("state_bucket").write.partitionBy("state_bucket").parquet(f"{path}/history/{name}/version={tag}")
    return commits.put_text(spark, commits.commit_file(path, NAME, number + 1), json.dumps(new))


def history(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Rows that versions have added under a name, with `version` and `state_bucket` to prune by; None before the first."""
    tags = [r[0] for r in spark.read.schema("tag string").json(f"{path}/{NAME}.*.json").collect()] if commits.numbers(spark, path, NAME) else []  # one per version
    fs, p = commits.file_system(spark, f"{path}/history/{name}")
    if not fs.exists(p):
        return None
    rows = spark.read.parquet(f"{path}/history/{name}").where(F.col("version").isin(tags))
    return rows.withColumn("version", F.substring("version", 1, 12).cast("long"))
