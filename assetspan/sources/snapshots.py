"""Nested fleet files, feeds, manifests, journals and content-hashed snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspan.functions.hashes import canonical_hash, table_digest
from assetspan.functions.scalars import is_iso_date
from assetspan.sources.commits import commit, commit_file, file_system, numbers, put_folder

INTERPRETATION = (
    "struct<sourceStartText:string,sourceEndText:string,placementBasis:string,awardType:string,termText:string,optionText:string,valueText:string,"
    "valueUsd:double,baseDurationDays:double,derivedUsdPerDay:double,includes:array<string>,excludes:array<string>>"
)
CONTRACT = (
    "struct<id:string,vesselId:string,startDate:string,endDate:string,dayRate:double,client:string,region:string,status:string,sourceUrl:string,sourcePublishedAt:string,"
    f"newsReviewed:boolean,inputMode:string,storedReading:variant,datePrecision:struct<start:string,end:string>,interpretation:{INTERPRETATION}>"
)
#: The numbers that must be whole and the texts that must be dates are read as they stand, so that rules can tell what they were.
FLEET = f"id string, name string, company string, generation string, status string, statusAsOf string, yearBuilt variant, contracts array<{CONTRACT}>"
EVENT = "struct<id:string,company:string,url:string,title:string,publishedAt:string,vessel:string,classification:string,newsCategory:string,reviewStatus:string,autoApplied:boolean,pendingReview:boolean,sourceId:string>"
RECORD = (
    "struct<jobId:string,sourceId:string,company:string,kind:string,url:string,title:string,publishedAt:string,documentSha256:string,status:string,outcome:string,"
    "lastReadAt:string,lastError:string,failureCount:int,nextAttemptAfter:bigint,lastSuccessAt:string,reportDate:string,selected:boolean,completedAt:string>"
)


def read_fleet(spark: SparkSession, path: str) -> DataFrame:
    """Assets, each with its contracts: a JSON array in one file, or one JSON object a line in any number of files, as export_fleet writes."""
    first = spark.read.text(path).where("trim(value) <> ''").select(F.substring(F.trim("value"), 1, 1)).first()
    return spark.read.schema(FLEET).option("multiLine", first is not None and first[0] == "[").json(path)


def import_fleet(spark: SparkSession, path: str) -> DataFrame:
    fleet = read_fleet(spark, path)
    if fleet.where("id is not null").isEmpty():
        raise ValueError(f"{path} holds no asset")
    return fleet


def _day(text: Column) -> Column:
    return F.when(is_iso_date(text), F.try_to_date(text, "yyyy-MM-dd"))


def flatten(fleet: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(assets, contracts); assets without contracts stay among the assets.

    Dates are strict; what was written stays beside them as `_text`, as does the parent that a contract names (vessel_id).  The rest of a
    contract's fields stay as they are, so that nest() gives the file back.  Columns of the asset named in `carry` stand at its contracts too: they are
    at hand here, and a join would shuffle both tables.
    """
    whole = F.schema_of_variant("yearBuilt").isin("BIGINT", "INT")
    assets = fleet.select(
        F.col("id").alias("asset_id"), "name", "company", "generation", "status", _day(F.col("statusAsOf")).alias("status_as_of"), F.col("statusAsOf").alias("status_as_of_text"),
        F.when(whole, F.try_variant_get("yearBuilt", "$", "int")).alias("year_built"), F.to_json("yearBuilt").alias("year_built_text"),
    )
    rows = fleet.select(F.col("id").alias("_asset"), *carry, F.inline("contracts"))
    contracts = rows.select(
        F.col("id").alias("contract_id"), F.col("_asset").alias("asset_id"), F.col("vesselId").alias("vessel_id"), _day(F.col("startDate")).alias("start_date"), _day(F.col("endDate")).alias("end_date"),
        F.col("startDate").alias("start_text"), F.col("endDate").alias("end_text"), F.col("dayRate").alias("day_rate"), "client", "region", "status", F.col("sourceUrl").alias("source_url"),
        F.col("sourcePublishedAt").alias("source_published_at"), F.col("newsReviewed").alias("news_reviewed"), F.col("inputMode").alias("input_mode"), F.to_json("storedReading").alias("stored_reading"),
        F.col("datePrecision").alias("date_precision"), "interpretation",
        F.col("interpretation.valueUsd").alias("value_usd"), F.col("interpretation.baseDurationDays").alias("base_days"), F.col("interpretation.awardType").alias("award_type"), *carry,
    )
    return assets, contracts


def _written(day: str, text: str, columns: list[str]) -> Column:
    """A date as it is written: the text it came from as long as that still says the same, or says no date where there is none."""
    iso = F.date_format(day, "yyyy-MM-dd")
    if text not in columns:
        return iso
    return F.when(_day(F.col(text)).eqNullSafe(F.col(day)), F.col(text)).otherwise(iso)


def nest(assets: DataFrame, contracts: DataFrame) -> DataFrame:
    """The fleet file's rows from flat tables: its field names, contracts in order of start, an empty list for assets without any.

    Columns that only flatten() gives may be missing; then the values of the others are written.
    """
    has = lambda name, kind: F.col(name) if name in contracts.columns else F.lit(None).cast(kind)
    stated = has("interpretation", INTERPRETATION)
    changes = {"valueUsd": "value_usd", "baseDurationDays": "base_days", "awardType": "award_type"}
    for field, column in changes.items():
        if column in contracts.columns:
            known = stated.isNotNull() | F.col(column).isNotNull()
            full = F.coalesce(stated, F.from_json(F.lit("{}"), INTERPRETATION))
            stated = F.when(known, full.withField(field, F.col(column)))
    row = F.struct(
        F.col("contract_id").alias("id"), (F.col("vessel_id") if "vessel_id" in contracts.columns else F.col("asset_id")).alias("vesselId"), _written("start_date", "start_text", contracts.columns).alias("startDate"),
        _written("end_date", "end_text", contracts.columns).alias("endDate"), F.col("day_rate").alias("dayRate"), "client", "region", "status", has("source_url", "string").alias("sourceUrl"),
        has("source_published_at", "string").cast("string").alias("sourcePublishedAt"), has("news_reviewed", "boolean").alias("newsReviewed"), has("input_mode", "string").alias("inputMode"),
        F.try_parse_json(has("stored_reading", "string")).alias("storedReading"), has("date_precision", "struct<start:string,end:string>").alias("datePrecision"), stated.alias("interpretation"),
    )
    order = F.struct(F.col("start_date").alias("d"), F.col("contract_id").alias("i"))
    keyed = contracts.select("asset_id", F.struct(order.alias("k"), F.to_json(row).alias("r")).alias("r"))
    rows = keyed.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.from_json(r["r"], CONTRACT)).alias("contracts"))
    year = F.try_parse_json(F.col("year_built_text") if "year_built_text" in assets.columns else F.col("year_built").cast("string"))
    written = assets.select(F.col("asset_id").alias("id"), "name", "company", "generation", "status", _written("status_as_of", "status_as_of_text", assets.columns).alias("statusAsOf"), year.alias("yearBuilt"))
    return written.join(rows.withColumnRenamed("asset_id", "id"), "id", "left").withColumn("contracts", F.coalesce("contracts", F.array().cast(f"array<{CONTRACT}>")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"generatedAt string, events array<{EVENT}>").option("multiLine", True).json(path).select(F.inline("events"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Journal records as rows; of the older version 2 only completed jobs with a full identity, as version 3 rows."""
    schema = f"schemaVersion int, documents map<string,{RECORD}>, jobs array<{RECORD}>, sources map<string,struct<url:string,title:string,publishedAt:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    now = raw.where("schemaVersion = 3").select(F.explode(F.map_values("documents")).alias("r")).select("r.*")
    old = raw.where("schemaVersion = 2").select(F.explode("jobs").alias("r"), "sources")
    source = F.try_element_at("sources", F.col("r.sourceId"))
    old = old.select("r.*", source.alias("_s")).where("status = 'completed' and sourceId is not null and company is not null and kind is not null and documentSha256 is not null")
    known = F.col("outcome").isin("applied", "no-change", "held", "excluded", "migrated", "stored-result")
    fixed = {"url": F.coalesce("_s.url", "url", F.lit("")), "title": F.coalesce("_s.title", "title"), "publishedAt": F.col("_s.publishedAt"), "outcome": F.when(known, F.col("outcome")).otherwise("migrated"), "lastReadAt": F.col("completedAt")}
    both = now.unionByName(old.withColumns(fixed).drop("_s"))
    names = {c: "".join("_" + x.lower() if x.isupper() else x for x in c) for c in both.columns}
    return both.select(*[F.col(a).alias(b) for a, b in names.items() if a != "completedAt"])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Landed files: url (the path), content_type told by the first bytes, html (null for PDF and others), content bytes."""
    head = F.ltrim(F.substring("content", 1, 64).cast("string"))
    kind = F.when(head.startswith("%PDF-"), "application/pdf").when(head.startswith("<"), "text/html")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), kind.alias("content_type"), F.when(kind == "text/html", F.col("content").cast("string")).alias("html"), "content")


def export_fleet(fleet: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON object a line, fields without a value left out; read_fleet reads it back, compressed (gzip, zstd) or not."""
    fleet.write.mode("overwrite").option("ignoreNullFields", True).json(path, compression=compression)


def publish(tables: dict[str, DataFrame], path: str) -> dict:
    """Write each table under a name with its digest, then a manifest under the next free number.

    Nothing that a reader may hold is ever overwritten: a payload that is there is kept as it is, and the manifest with the highest number
    counts, so that a reader sees the old snapshot or the new one whole.  A table is evaluated once: it is written to a folder of its own, its digest
    is taken from there, and the folder is renamed.  Of several publishers at once each gets a number and a complete snapshot.

    A table just as load_table() gave it from this folder has not changed: its payload is named again, neither written nor digested; verify() does that.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = {}
    for name, df in tables.items():
        if (known := _published(df, path)) is not None:
            manifest[name] = known
            continue
        draft = f"{path}/_draft.{name}.{uuid.uuid4().hex}"
        df.write.parquet(draft)
        rows, digest = table_digest(spark.read.parquet(draft)).first()
        file = f"{name}.{digest[:16]}"
        put_folder(spark, draft, f"{path}/{file}")
        manifest[name] = {"rows": rows, "digest": digest, "file": file}
    entries = [json.dumps({"name": n, "file": m["file"], "rows": m["rows"], "digest": m["digest"]}) for n, m in manifest.items()]
    commit(spark, path, "manifest", "\n".join(entries))
    return manifest


def _published(df: DataFrame, path: str) -> dict | None:
    """What the manifest says of df if it is a table of this folder as load_table() gave it, and its payload is still there."""
    folder, entry = vars(df).get("_published", (None, None))
    if folder != path:
        return None
    fs, p = file_system(df.sparkSession, f"{path}/{entry['file']}")
    return dict(entry) if fs.exists(p) else None


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest manifest, or that of a version; no rows where there is none."""
    schema = "name string, file string, rows long, digest string"
    found = [n for n in numbers(spark, path, "manifest") if version in (None, n)]
    return spark.read.schema(schema).json(commit_file(path, "manifest", max(found))) if found else spark.createDataFrame([], schema)


def state_fingerprint(manifest: DataFrame) -> DataFrame:
    """One row: a hash of what the manifest says, times aside."""
    entries = F.array_sort(F.collect_list(F.struct("name", "file", "rows", "digest")))
    return manifest.agg(F.to_json(entries).alias("j")).select(canonical_hash("j").alias("fingerprint"))


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the latest snapshot; handed to publish() as it is, it is carried over."""
    found = read_manifest(spark, path).where(F.col("name") == name).select("rows", "digest", "file").first()
    if found is None:
        raise ValueError(f"{path} has no table {name}")
    out = spark.read.parquet(f"{path}/{found['file']}")
    out._published = (path, found.asDict())
    return out


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(check, ok) for every table of a snapshot: its digest, computed anew, is the manifest's."""
    found = []
    for name, file, rows, digest in read_manifest(spark, path).collect():  # a few names
        now = table_digest(spark.read.parquet(f"{path}/{file}")).first()
        found.append((name, (now[0], now[1]) == (rows, digest)))
    return spark.createDataFrame(found, "check string, ok boolean")


def prune(spark: SparkSession, path: str) -> list[str]:
    """Remove payloads that the latest manifest does not name, older manifests and drafts; gives the payloads' names.  Not for while others publish."""
    last = max(numbers(spark, path, "manifest"), default=0)
    keep = {r[0] for r in read_manifest(spark, path, last).select("file").collect()} | {commit_file("", "manifest", last)[1:]}
    fs, p = file_system(spark, path)
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in keep]
    for g in gone:
        fs.delete(g, True)
    return sorted(n for g in gone if not (n := g.getName()).startswith(("manifest.", "_draft.", ".")))


def load_snapshot(spark: SparkSession, path: str, seed: dict[str, DataFrame], expect: dict[str, int]) -> dict[str, DataFrame]:
    """The published tables if manifest and payloads have all of them with the expected numbers of rows, else the seed."""
    rows = {r["name"]: r["rows"] for r in read_manifest(spark, path).collect()}
    if any(rows.get(n) != k for n, k in expect.items()):
        return seed
    found = {n: load_table(spark, path, n) for n in expect}
    return found if all(found[n].count() == k for n, k in expect.items()) else seed
