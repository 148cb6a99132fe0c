"""Rate observations and the economics of a contract's value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspan.functions.scalars import derived_rate, duration_days_incl, positive, reported_rate, safe_url
from assetspan.operators.intervals import firm

#: First year shown of a class; others show all (fixed value).
START_YEARS = {"7G+": 2025}
EXTENSIONS = ("extension", "option-exercised")


def economics(value_usd: Column, base_days: Column, award_type: Column | None = None) -> Column:
    """scope, usd_per_day, value_usd, days where a positive rate can be derived, else null.  The rate is always computed anew."""
    rate = derived_rate(value_usd, base_days)
    scope = F.lit("award") if award_type is None else F.when(award_type.isin(*EXTENSIONS), "extension").otherwise("award")
    return F.when(
        positive(rate),
        F.struct(scope.alias("scope"), rate.alias("usd_per_day"), F.when(positive(value_usd), value_usd).alias("value_usd"), F.when(positive(base_days), base_days).alias("days")),
    )


def timeline_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts with their economics; no row comes from anything else."""
    award = F.col("award_type") if "award_type" in contracts.columns else None
    return contracts.withColumn("economics", economics(F.col("value_usd"), F.col("base_days"), award))


def rate_observations(assets: DataFrame, contracts: DataFrame) -> DataFrame:
    """Firm periods with a disclosed or, failing that, a derived rate."""
    rows = timeline_contracts(firm(contracts))
    disclosed = reported_rate(F.col("day_rate")) > 0
    known = rows.where(disclosed | F.col("economics").isNotNull()).select(
        "contract_id", "asset_id", "client", "start_date", "end_date",
        duration_days_incl(F.col("start_date"), F.col("end_date")).alias("days"),
        F.when(disclosed, F.col("day_rate")).otherwise(F.col("economics.usd_per_day")).alias("rate"),
        F.when(disclosed, "reported").otherwise("derived").alias("basis"),
        *[c for c in ("source_url",) if c in rows.columns],
    )
    return known.join(assets.select("asset_id", "name", "company", "generation"), "asset_id")


def in_order(observations: DataFrame) -> DataFrame:
    """Observations sorted as they are shown, by start and id; the sort is in ranges over all tasks."""
    return observations.orderBy("start_date", "contract_id")


def with_source(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """source_url: the contract's own https link, else its company's report; sources holds one row per company."""
    own = observations if "source_url" in observations.columns else observations.withColumn("source_url", F.lit(None).cast("string"))
    report = sources.groupBy("company").agg(F.min(safe_url(F.col("document_url"))).alias("_report"))
    return own.join(report, "company", "left").withColumn("source_url", F.coalesce(safe_url(F.col("source_url")), F.col("_report"))).drop("_report")


def series(observations: DataFrame, generation: str | None = None, start_years: dict[str, int] | None = None, include_derived: bool = True) -> DataFrame:
    """The observations of the display window; what it hides must not reach a fit."""
    years = START_YEARS if start_years is None else start_years
    out = observations
    for g, y in years.items():
        out = out.where((F.col("generation") != g) | (F.col("start_date") >= F.lit(dt.date(y, 1, 1))))
    if generation is not None:
        out = out.where(F.col("generation") == generation)
    return out if include_derived else out.where(F.col("basis") == "reported")


def latest_labels(observations: DataFrame, k: int = 3) -> DataFrame:
    """Per class the k assets observed last, each with its last observation; ties go to the smaller id."""
    last = observations.groupBy("generation", "asset_id").agg(F.max(F.struct("start_date", "contract_id", "rate")).alias("o"))
    # the first k of each part of a class before its ranking, so that no task gets a whole class
    salted = Window.partitionBy("generation", F.pmod(F.xxhash64("asset_id"), F.lit(64))).orderBy(F.desc("o.start_date"), "asset_id")
    rank = Window.partitionBy("generation").orderBy(F.desc("o.start_date"), "asset_id")
    few = last.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("generation", "asset_id", "o.contract_id", "o.start_date", "o.rate", "rank")


def contract_report(assets: DataFrame, contracts: DataFrame) -> DataFrame:
    """One reporting row per contract: period, rate with its basis and formula inputs, evidence texts that are not blank."""
    rows = timeline_contracts(contracts)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    month = lambda c, p: F.when(F.coalesce(has(p) == "month", F.lit(False)), F.date_format(c, "yyyy-MM")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    disclosed = reported_rate(F.col("day_rate"))
    evidence = [F.when(F.trim(has(c)) != "", has(c)) for c in ("source_start_text", "source_end_text", "placement_basis", "term_text", "option_text", "value_text")]
    return rows.join(assets.select("asset_id", "name", "company", "generation"), "asset_id").select(
        "contract_id", "asset_id", "name", "company", "generation", "client", "region", "status",
        F.concat_ws(" ~ ", month(F.col("start_date"), "start_precision"), month(F.col("end_date"), "end_precision")).alias("period"),
        F.when(disclosed > 0, disclosed).otherwise(F.col("economics.usd_per_day")).alias("rate"),
        F.when(disclosed > 0, "disclosed").when(F.col("economics").isNotNull(), "derived").otherwise("undisclosed").alias("rate_basis"),
        F.col("economics.value_usd").alias("value_usd"),
        F.col("economics.days").alias("base_days"),
        F.array_compact(F.array(*evidence)).alias("evidence"),
        F.when(has("input_mode") == "stored-result", has("reviewed_at")).alias("originally_read_at"),
    )
