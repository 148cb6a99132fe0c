"""Effective status, utilization and current rates as of a date.

assets: asset_id, name, company, generation, status, status_as_of, ...; contracts: contract_id, asset_id, start_date, end_date, status, day_rate, ...
Assets without contracts stay.  `by` is a list of asset columns; without it there is one row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspan.functions.scalars import covers, is_current_reported, js_round
from assetspan.operators.intervals import coverage_islands


def effective_status(assets: DataFrame, contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """assets with effective_status.

    Active needs a firm contract on the day, else it is Idle.  Another status is kept, unless a firm contract of the day began after
    the status was reported.
    """
    day = F.lit(as_of)
    last = contracts.where((F.col("status") == "Firm") & covers(F.col("start_date"), F.col("end_date"), day)).groupBy("asset_id").agg(F.max("start_date").alias("_last"))
    status = (
        F.when(F.col("status") == "Active", F.when(F.col("_last").isNull(), "Idle").otherwise("Active"))
        .when(F.col("status_as_of").isNull() | (day <= F.col("status_as_of")), F.col("status"))
        .when(F.col("_last") > F.col("status_as_of"), "Active")
        .otherwise(F.col("status"))
    )
    return assets.join(last, "asset_id", "left").withColumn("effective_status", status).drop("_last")


def current_rates(assets: DataFrame, contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """Disclosed rates of firm contracts on the day, with their asset's columns."""
    c = [F.col(x) for x in ("status", "start_date", "end_date", "day_rate")]
    current = contracts.where(is_current_reported(*c, F.lit(as_of))).select("contract_id", "asset_id", "day_rate")
    return current.join(assets.select("asset_id", "name", "company", "generation"), "asset_id")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, js_round(part / whole * 100)).otherwise(0).cast("long")


def fleet_kpis(assets: DataFrame, contracts: DataFrame, as_of: dt.date, by: list[str] | None = None) -> DataFrame:
    """total, active, cold, marketed, fleet_utilization, market_utilization."""
    state = F.col("effective_status")
    counts = effective_status(assets, contracts, as_of).groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(state == "Active").alias("active"), F.count_if(state == "Cold-Stacked").alias("cold")
    )
    marketed = F.col("total") - F.col("cold")
    return counts.withColumns({"marketed": marketed, "fleet_utilization": percent(F.col("active"), F.col("total")), "market_utilization": percent(F.col("active"), marketed)})


def economic_utilization(assets: DataFrame, contracts: DataFrame, as_of: dt.date, by: list[str] | None = None) -> DataFrame:
    """Firm days since the year began of assets that are not cold, over their possible days."""
    start = as_of.replace(month=1, day=1)
    elapsed = (as_of - start).days + 1
    marketed = effective_status(assets, contracts, as_of).where(F.col("effective_status") != "Cold-Stacked")
    days = coverage_islands(contracts, start, as_of).groupBy("asset_id").agg(F.sum("days").alias("days"))
    sums = marketed.join(days, "asset_id", "left").groupBy(*(by or [])).agg(F.count("*").alias("marketed"), F.coalesce(F.sum("days"), F.lit(0)).alias("contract_days"))
    possible = F.col("marketed") * elapsed
    return sums.withColumns({"possible_days": possible, "economic_utilization": percent(F.col("contract_days"), possible)})


def average_rate(assets: DataFrame, contracts: DataFrame, as_of: dt.date, by: list[str] | None = None) -> DataFrame:
    return current_rates(assets, contracts, as_of).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("day_rate").alias("avg_rate"))


def filter_company(assets: DataFrame, company: str | None) -> DataFrame:
    """The assets of one company, or all."""
    return assets if company is None else assets.where(F.col("company") == company)
