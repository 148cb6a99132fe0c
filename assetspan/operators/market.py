"""Market tables: by class, by owner, extremes, axis and counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.functions.scalars import js_round, utilization_band
from assetspan.operators.intervals import dimension
from assetspan.operators.status import current_rates, effective_status, percent


def _rounded(total: str, n: str):
    return F.when(F.col(n) > 0, js_round(F.col(total) / F.col(n))).otherwise(0).cast("long")


def generation_stats(assets: DataFrame, contracts: DataFrame, as_of: dt.date, generations: list[str]) -> DataFrame:
    """generation, assets, avg_rate for every class, those without assets too."""
    dim = F.broadcast(dimension(assets.sparkSession, "generation", generations))
    counts = assets.groupBy("generation").agg(F.count("*").alias("assets"))
    rates = current_rates(assets, contracts, as_of).groupBy("generation").agg(F.sum("day_rate").alias("total"), F.count("*").alias("n"))
    joined = dim.join(counts, "generation", "left").join(rates, "generation", "left").fillna(0, ["assets", "n"])
    return joined.select("generation", F.col("assets").cast("long").alias("assets"), _rounded("total", "n").alias("avg_rate"))


def company_stats(assets: DataFrame, contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """company, assets, avg_rate (rounded), premium over the market's average in percent, utilization, band."""
    rates = current_rates(assets, contracts, as_of).groupBy("company").agg(F.sum("day_rate").alias("total"), F.count("*").alias("n"))
    market = rates.agg(F.sum("total").alias("mt"), F.sum("n").alias("mn"))  # one row
    fleet = effective_status(assets, contracts, as_of).groupBy("company").agg(F.count("*").alias("assets"), F.count_if(F.col("effective_status") == "Active").alias("active"))
    joined = fleet.join(rates, "company", "left").fillna(0, ["n"]).join(F.broadcast(market), F.lit(True))
    average = F.col("mt") / F.col("mn")
    out = joined.withColumn("avg_rate", _rounded("total", "n")).withColumn("utilization", percent(F.col("active"), F.col("assets")))
    return out.select("company", "assets", "avg_rate", F.coalesce((F.col("avg_rate") - average) / average * 100, F.lit(0.0)).alias("premium"), "utilization", utilization_band(F.col("utilization")).alias("band"))


def company_generation_pivot(assets: DataFrame, contracts: DataFrame, as_of: dt.date, generations: list[str]) -> DataFrame:
    """company, and per class {class}_count and {class}_avg_rate (0 where there is none)."""
    rates = current_rates(assets, contracts, as_of).groupBy("asset_id").agg(F.sum("day_rate").alias("total"), F.count("*").alias("n"))
    per_asset = assets.join(rates, "asset_id", "left")
    wide = per_asset.groupBy("company").pivot("generation", generations).agg(F.count(F.lit(1)).alias("count"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = [F.col("company")]
    for g in generations:
        rate = F.when(F.col(f"`{g}_n`") > 0, js_round(F.col(f"`{g}_total`") / F.col(f"`{g}_n`"))).otherwise(0).cast("long")
        out += [F.coalesce(F.col(f"`{g}_count`"), F.lit(0)).cast("long").alias(f"{g}_count"), rate.alias(f"{g}_avg_rate")]
    return wide.select(*out)


def rate_extremes(assets: DataFrame, contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """Per company the assets of highest and lowest rounded average rate above 0; ties go to the smaller id."""
    rates = current_rates(assets, contracts, as_of).groupBy("company", "asset_id", "name").agg(js_round(F.avg("day_rate")).cast("long").alias("avg")).where("avg > 0")
    top = F.min(F.struct((-F.col("avg")).alias("k"), "asset_id", "avg"))
    bottom = F.min(F.struct(F.col("avg").alias("k"), "asset_id", "avg"))
    best = rates.groupBy("company").agg(top.alias("t"), bottom.alias("b"))
    return best.select("company", F.col("t.asset_id").alias("top_asset"), F.col("t.avg").alias("top_rate"), F.col("b.asset_id").alias("bottom_asset"), F.col("b.avg").alias("bottom_rate"))


def report_range(sources: DataFrame) -> DataFrame:
    """first_report, last_report, updated_as_of from report_date."""
    return sources.agg(F.min("report_date").alias("first_report"), F.max("report_date").alias("last_report"), F.max("report_date").alias("updated_as_of"))


def snapshot_counts(assets: DataFrame, contracts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: assets, contracts, events, pending_events."""
    a, c = assets.agg(F.count("*").alias("assets")), contracts.agg(F.count("*").alias("contracts"))
    e = events.agg(F.count("*").alias("events"), F.count_if("pending_review").alias("pending_events"))
    return a.join(F.broadcast(c), F.lit(True)).join(F.broadcast(e), F.lit(True))  # one row each


def axis_domain(observations: DataFrame, band: DataFrame | None = None, from_year: int | None = None, step: int = 50_000, pad: int = 20_000) -> DataFrame:
    """One row: first_year, last_year, low, high, ticks; defaults where there is no observation."""
    low, high = F.min("rate"), F.max("rate")
    x = observations.agg(F.min(F.year("start_date")).alias("y0"), F.max(F.year("start_date")).alias("y1"), low.alias("lo"), high.alias("hi"))
    if band is not None:
        x = x.join(F.broadcast(band.agg(F.min("band_lo").alias("blo"), F.max("band_hi").alias("bhi"))), F.lit(True)).withColumns({"lo": F.least("lo", "blo"), "hi": F.greatest("hi", "bhi")})
    first = F.lit(from_year) if from_year is not None else F.coalesce("y0", F.lit(2021))
    last = F.greatest(first, F.coalesce("y1", F.lit((from_year or 2026))))
    lo = F.when(F.col("lo").isNull(), 200_000).otherwise(F.greatest(F.lit(0), F.floor((F.col("lo") - pad) / step) * step)).cast("long")
    hi = F.coalesce(F.ceil((F.col("hi") + pad) / step) * step, F.lit(550_000)).cast("long")
    ticks = F.when(F.col("lo").isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(lo, hi, F.lit(step).cast("long")))
    return x.select(first.cast("int").alias("first_year"), last.cast("int").alias("last_year"), lo.alias("low"), hi.alias("high"), ticks.alias("ticks"))


def timeline_order(assets: DataFrame, generations: list[str]) -> DataFrame:
    """assets with `rank` of their class (newest highest, unknown ones 0), highest first, then by company and id."""
    dim = F.broadcast(dimension(assets.sparkSession, "generation", generations)).select("generation", (F.col("rank") + 1).alias("rank"))
    return assets.join(dim, "generation", "left").fillna(0, ["rank"]).orderBy(F.desc("rank"), "company", "asset_id")
