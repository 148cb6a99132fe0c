"""Integrity rules of the contract table; each violation is a row (rule, asset_id, contract_id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspan.functions.scalars import finite, nonempty, positive
from assetspan.operators.jobs import backlog_fingerprint, backlog_tree_fingerprint


def _failed(checks: list[tuple[str, Column, Column | None]]) -> Column:
    """(rule, detail) of every check that fails, or whose outcome is unknown."""
    shown = lambda d: F.lit("") if d is None else F.coalesce(d.cast("string"), F.lit("null"))
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(rule).alias("rule"), shown(detail).alias("detail"))) for rule, bad, detail in checks)))


def _found(df: DataFrame, rule: str, detail: str, asset: str | None = None, contract: str | None = None) -> DataFrame:
    ids = [(F.col(c) if c else F.lit(None)).cast("string").alias(n) for c, n in ((asset, "asset_id"), (contract, "contract_id"))]
    return df.select(F.lit(rule).alias("rule"), *ids, F.coalesce(F.col(detail).cast("string"), F.lit("null")).alias("detail"))


def integrity_violations(assets: DataFrame, contracts: DataFrame, registered: DataFrame, generations: list[str], asset_states: list[str], contract_states: list[str]) -> DataFrame:
    """assets and contracts against the registry (asset_id, name, company, generation).

    Counts per company and in total, registered identity unchanged, domains, strict dates and their order, finite numbers, rates not below 0, texts
    that are not blank, contract ids given and unique, and parents that exist and are those the contract names.  Where the tables have columns
    of what was written (status_as_of_text, vessel_id), these are checked too.  Each table is read once for all rules on single rows.
    """
    identity = ["asset_id", "name", "company", "generation"]
    side = lambda d, n: d.select(*identity).groupBy(*identity).agg(F.count("*").alias(n))
    same = reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in identity])
    both = side(assets, "is").alias("x").join(side(registered, "was").alias("y"), same, "full")
    both = both.select(*(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in identity), F.coalesce("is", F.lit(0)).alias("is"), F.coalesce("was", F.lit(0)).alias("was"))
    drift = both.where("is <> was").select("asset_id", "name", F.explode(F.array_repeat(F.lit(0), F.abs(F.col("is") - F.col("was")).cast("int"))))
    counts = both.groupBy("company").agg(F.sum("is").alias("is"), F.sum("was").alias("was"))
    total = counts.agg(F.sum("is").alias("is"), F.sum("was").alias("was")).where("is <> was")
    doubled = lambda d, key: d.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    of_asset = [
        ("generation", ~F.col("generation").isin(*generations), F.col("generation")),
        ("asset status", ~F.col("status").isin(*asset_states), F.col("status")),
        ("year built", F.col("year_built").isNull(), F.col("year_built_text") if "year_built_text" in assets.columns else None),
    ]
    if "status_as_of_text" in assets.columns:
        of_asset.append(("status date", F.col("status_as_of_text").isNotNull() & F.col("status_as_of").isNull(), F.col("status_as_of_text")))
    of_contract = [
        ("contract id", ~nonempty(F.col("contract_id")), None),
        ("contract status", ~F.col("status").isin(*contract_states), F.col("status")),
        ("dates", F.col("start_date").isNull() | F.col("end_date").isNull() | (F.col("start_date") > F.col("end_date")), None),
        ("rate", ~finite(F.col("day_rate")) | (F.col("day_rate") < 0), F.col("day_rate")),
        ("client", ~nonempty(F.col("client")), None),
        ("region", ~nonempty(F.col("region")), None),
    ]
    for c, kind in contracts.dtypes:
        if kind in ("double", "float") and c != "day_rate":
            of_contract.append(("number", F.col(c).isNotNull() & ~finite(F.col(c)), F.lit(c)))
    if "vessel_id" in contracts.columns:
        of_contract.append(("parent", ~F.col("vessel_id").eqNullSafe(F.col("asset_id")), F.col("vessel_id")))
    known = assets.select("asset_id", F.lit(True).alias("_known")).distinct()
    a = assets.select(F.col("asset_id").cast("string").alias("asset_id"), F.lit(None).cast("string").alias("contract_id"), F.inline(_failed(of_asset)))
    # What a row tells by itself is told before its parent is looked up, so that ids and faults alone are shuffled.
    told = contracts.select("asset_id", "contract_id", _failed(of_contract).alias("_faults")).join(known, "asset_id", "left")
    faults = F.concat("_faults", _failed([("parent", F.col("_known").isNull(), F.col("asset_id"))]))
    c = told.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("contract_id").cast("string").alias("contract_id"), F.inline(faults))
    found = [
        _found(total, "asset count", "is"),
        _found(counts.where("is <> was"), "company count", "company"),
        _found(drift, "registry", "name", "asset_id"),
        _found(doubled(assets, "asset_id"), "asset id", "n", "asset_id"),
        _found(doubled(contracts, "contract_id"), "contract id", "n", None, "contract_id"),
        a.select("rule", "asset_id", "contract_id", "detail"),
        c.select("rule", "asset_id", "contract_id", "detail"),
    ]
    return reduce(DataFrame.unionByName, found)


def manifest_violations(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """(check, expected, found) where the one-row manifest's counts differ from the payload's."""
    shared = [c for c in counts.columns if c in manifest.columns]
    both = manifest.select(*[F.col(c).cast("long").alias(f"m_{c}") for c in shared]).join(F.broadcast(counts.select(shared)), F.lit(True))  # one row each
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"m_{c}").alias("expected"), F.col(c).cast("long").alias("found")) for c in shared])
    return both.select(F.inline(pairs)).where(~F.col("expected").eqNullSafe(F.col("found")))


def published_violations(contracts: DataFrame, events: DataFrame) -> DataFrame:
    """A derived rate that is there must be positive; a held decision has no row."""
    derived = contracts.where(F.col("derived_usd_per_day").isNotNull() & ~positive(F.col("derived_usd_per_day"))).select(F.lit("derived rate").alias("rule"), F.col("contract_id").alias("id"))
    held = events.where((F.col("action") == "hold") & F.col("has_row")).select(F.lit("hold with row").alias("rule"), F.col("event_id").alias("id"))
    return derived.union(held)


def backlog_violations(jobs: DataFrame, schema_version: int, pending: int, kinds: list[str], companies: list[str], fingerprint: str | None = None, tree: str | None = None) -> DataFrame:
    """Of a published backlog of jobs (job_id, kind, company, url, document_sha256); with a fingerprint, or that of a hash tree, also whether it is that of
    the jobs."""
    doubled = jobs.groupBy("job_id").agg(F.count("*").alias("n")).where("n > 1")
    one = jobs.agg(F.count("*").alias("n"))
    rule = lambda d, name, c, x="job_id": d.where(c).select(F.lit(name).alias("rule"), (F.col(x) if x in d.columns else F.lit(None)).cast("string").alias("job_id"))
    found = [
        rule(one, "schema version", F.lit(schema_version != 2)),
        rule(one, "count", F.col("n") != pending),
        rule(doubled, "job id", F.lit(True)),
        rule(jobs, "no job id", ~nonempty(F.col("job_id"))),
        rule(jobs, "no url", ~nonempty(F.col("url"))),
        rule(jobs, "kind", ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))),
        rule(jobs, "company", ~F.coalesce(F.col("company").isin(*companies), F.lit(False))),
        rule(jobs, "hash", ~F.coalesce(F.col("document_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
    ]
    if fingerprint is not None:
        found.append(rule(backlog_fingerprint(jobs), "fingerprint", F.col("fingerprint") != fingerprint))
    if tree is not None:
        found.append(rule(backlog_tree_fingerprint(jobs), "fingerprint", F.col("fingerprint") != tree))
    return reduce(DataFrame.union, found)


def input_violations(inputs: DataFrame, kinds: list[str]) -> DataFrame:
    """Of reading inputs (job_id, kind, pages array of locator, text)."""
    locators = F.transform("pages", lambda p: p["locator"])
    checks = {
        "job id": ~nonempty(F.col("job_id")),
        "kind": ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)),
        "pages": F.coalesce(F.size("pages"), F.lit(0)) <= 0,
        "locators": F.size(F.array_distinct(locators)) < F.size(locators),
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return inputs.select("job_id", F.explode(failed).alias("rule"))
