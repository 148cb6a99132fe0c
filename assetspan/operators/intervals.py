"""Unions, gaps and geometry of dated intervals; both ends of a period are inclusive."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetspan.functions.scalars import is_statistical
from assetspan.operators.jobs import numbered
from assetspan.session import cut, small


def firm(contracts: DataFrame) -> DataFrame:
    return contracts.where((F.col("status") == "Firm") & is_statistical(F.col("start_date"), F.col("end_date")))


def coverage_islands(contracts: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(asset_id, start_date, end_date, days): firm periods clipped to [start, end] and merged where they overlap or follow on the next day."""
    c = firm(contracts).select("asset_id", "start_date", "end_date")
    if start:
        c = c.where(F.col("end_date") >= F.lit(start)).withColumn("start_date", F.greatest("start_date", F.lit(start)))
    if end:
        c = c.where(F.col("start_date") <= F.lit(end)).withColumn("end_date", F.least("end_date", F.lit(end)))
    order = Window.partitionBy("asset_id").orderBy("start_date", "end_date")
    reach = F.max("end_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_date") <= F.date_add(reach, 1), 0).otherwise(1)
    island = c.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("asset_id", "_island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).drop("_island")
    return merged.withColumn("days", (F.datediff("end_date", "start_date") + 1).cast("long"))


def covered_days(assets: DataFrame, contracts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """(asset_id, days) for every asset; 0 without a firm period in the range."""
    days = coverage_islands(contracts, start, end).groupBy("asset_id").agg(F.sum("days").alias("days"))
    return assets.select("asset_id").join(days, "asset_id", "left").select("asset_id", F.coalesce("days", F.lit(0)).cast("long").alias("days"))


def idle_periods(contracts: DataFrame, start: dt.date, end: dt.date, merge: bool = False) -> DataFrame:
    """(asset_id, start_date, end_date) before the first, between consecutive, and after the last firm period.

    Periods stand in start order and each is compared with the next one only; the boundary day is the contract's own.  With `merge` periods are
    merged first, so that one inside another makes no gap.  Assets without firm periods give none.
    """
    c = coverage_islands(contracts) if merge else firm(contracts)
    key = ["start_date"] if merge else ["start_date", "contract_id"]
    order = Window.partitionBy("asset_id").orderBy(*key)
    gap = lambda a, b: F.struct(a.alias("start_date"), b.alias("end_date"))
    first, following = F.row_number().over(order) == 1, F.lead("start_date").over(order)
    rows = c.select("asset_id", "start_date", "end_date", first.alias("_first"), following.alias("_next"))
    t0, t1 = F.lit(start), F.lit(end)
    gaps = F.array_compact(
        F.array(
            F.when(F.col("_first") & (F.col("start_date") > t0), gap(t0, F.col("start_date"))),
            F.when(F.col("_next").isNotNull() & (F.col("end_date") < F.col("_next")), gap(F.col("end_date"), F.col("_next"))),
            F.when(F.col("_next").isNull() & (F.col("end_date") < t1), gap(F.col("end_date"), t1)),
        )
    )
    return rows.select("asset_id", F.inline(gaps))


def timeline_span(start: Column, end: Column, first_year: int, last_year: int) -> tuple[Column, Column]:
    """Left edge and width, in percent of the years' span, of a period clipped to it; null outside it or reversed."""
    origin, limit = dt.date(first_year, 1, 1), dt.date(last_year + 1, 1, 1)
    total = (limit - origin).days
    left = F.greatest(start, F.lit(origin))
    right = F.least(F.date_add(end, 1), F.lit(limit))
    inside = is_statistical(start, end) & (right > left)
    return F.when(inside, F.datediff(left, F.lit(origin)) / total * 100), F.when(inside, F.datediff(right, left) / total * 100)


def timeline_axis(contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per quarter mark from the year of as_of to the last year of any contract, or two years on if that is later."""
    first = as_of.replace(month=1, day=1)
    last = contracts.agg(F.greatest(F.year(F.max("end_date")), F.lit(as_of.year + 2)).alias("last_year")).withColumn("last_year", F.coalesce("last_year", F.lit(as_of.year + 2)))
    mark = F.explode(F.sequence(F.lit(first), F.make_date(F.col("last_year") + 1, F.lit(1), F.lit(1)), F.expr("interval 3 months")))
    months = (F.col("last_year") - first.year + 1) * 12
    at = (F.year("mark") - first.year) * 12 + F.month("mark") - 1
    current = F.col("mark") == F.trunc(F.lit(as_of), "quarter")
    name = F.concat(F.lit("Q"), F.quarter("mark").cast("string"))
    return last.select("last_year", mark.alias("mark")).select(
        "mark",
        (at / months * 100).alias("percent"),
        F.when((F.quarter("mark") == 1) | current, F.concat_ws(" ", F.year("mark").cast("string"), name)).otherwise(name).alias("label"),
        (F.quarter("mark") == 1).alias("is_year"),
        current.alias("is_current"),
    )


def dimension(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A small table of the values in order: name, rank."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, rank int")


#: Periods of one key that meet in one cell as they begin; keys with more are cut into slices of so many.
SLICE = 512


def overlapping_pairs(periods: DataFrame, keys: list[str], order: list[str], least: int, such: Callable[[str, str], Column] | None = None, size: int = SLICE) -> DataFrame:
    """(earlier, later), both structs of all columns, of periods of one key that share more than `least` days; each pair once.  `such` says, by the names
    of the two structs, which pairs are asked for.

    periods: keys, start_date, end_date and others, those without a key share nothing; `order` tells periods of one key and start apart, pairs that it does not tell apart are left out.
    A sweep: periods are sorted by start, and each meets those before it that are still open.  A key with more than `size` periods is cut into
    slices along the sorted starts, and a period that is still open where a later slice begins is carried into it, so that a cell holds one
    slice and what is open there, however many periods a key has and however long they are; nothing is spread over days or years.
    """
    rows = cut(periods.where("start_date <= end_date").dropna(subset=keys).select(F.struct(*keys).alias("_key"), F.struct("*").alias("p"), F.struct("start_date", *order).alias("_at")))
    large = small(cut(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > size).select("_key")))
    lone = rows.join(large, "_key", "left_anti").select("_key", "p", "_at", F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("last"))
    hot = rows.join(large, "_key", "left_semi")
    if hot.isEmpty():
        homes = lone
    else:
        placed = cut(numbered(hot, "_key", [F.col("_at")], "_place").withColumn("slice", F.floor((F.col("_place") - 1) / size)))
        begins = placed.groupBy("_key", "slice").agg(F.min("p.start_date").alias("_first")).groupBy("_key").agg(F.array_sort(F.collect_list("_first")).alias("_begins"))
        open_until = F.size(F.filter("_begins", lambda b: b <= F.col("p.end_date"))).cast("long") - 1
        homes = lone.unionByName(placed.join(begins, "_key").select("_key", "p", "_at", "slice", F.greatest("slice", open_until).alias("last")))
    carried = homes.withColumn("slice", F.explode(F.sequence("slice", "last")))
    e, l = carried.alias("e"), homes.alias("l")  # noqa: E741
    shared = F.datediff(F.least("e.p.end_date", "l.p.end_date"), F.col("l.p.start_date")) > least
    pairs = e.join(l, (F.col("e._key") == F.col("l._key")) & (F.col("e.slice") == F.col("l.slice")) & (F.col("e._at") < F.col("l._at")) & shared & (such("e.p", "l.p") if such else F.lit(True)))
    return pairs.select(F.col("e.p").alias("earlier"), F.col("l.p").alias("later"))
