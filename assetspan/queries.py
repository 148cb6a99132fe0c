"""Registered queries on the model's tables, each with the SQL another engine can check it by."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspan.operators import intervals, market, observations, status, trend
from assetspan.plans.model import AS_OF, GENERATIONS, ORACLE, YEAR_START, assets, contracts, periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: str = "", plain: bool = False):
    """Register a query under its name; sql goes on from the common table expressions of ORACLE unless plain.

    Columns named in dates are given as ISO texts, so that engines with other date types agree.
    """

    def add(f):
        def run(spark, sf):
            df = f(spark, sf)
            return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates.split()}) if dates else df

        QUERIES[f.__name__] = run
        if sql:
            text = sql if plain else f"WITH {ORACLE} {sql}"
            shown = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({text})" if dates else text
        return f

    return add


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("SELECT asset_id, company, generation, effective_status FROM statuses")
def effective_status(spark, sf):
    return status.effective_status(assets(spark, sf), periods(spark, sf), AS_OF).select("asset_id", "company", "generation", "effective_status")


_KPIS = """SELECT {by} count(*) AS total, count(*) FILTER (effective_status = 'Active') AS active, count(*) FILTER (effective_status = 'Cold-Stacked') AS cold,
 count(*) FILTER (effective_status <> 'Cold-Stacked') AS marketed,
 CAST(floor(count(*) FILTER (effective_status = 'Active') / count(*) * 100 + 0.5) AS BIGINT) AS fleet_utilization,
 CAST(floor(count(*) FILTER (effective_status = 'Active') / count(*) FILTER (effective_status <> 'Cold-Stacked') * 100 + 0.5) AS BIGINT) AS market_utilization FROM statuses"""


@query(_KPIS.format(by=""))
def fleet_kpis(spark, sf):
    return status.fleet_kpis(assets(spark, sf), periods(spark, sf), AS_OF)


@query(_KPIS.format(by="company,") + " GROUP BY company")
def fleet_kpis_by_company(spark, sf):
    return status.fleet_kpis(assets(spark, sf), periods(spark, sf), AS_OF, ["company"])


@query("""SELECT company, CAST(count(*) AS BIGINT) AS marketed, CAST(sum(days) AS BIGINT) AS contract_days, CAST(count(*) * 180 AS BIGINT) AS possible_days,
 CAST(floor(sum(days) / (count(*) * 181) * 100 + 0.5) AS BIGINT) AS economic_utilization
FROM statuses JOIN covered USING (asset_id) WHERE effective_status <> 'Cold-Stacked' GROUP BY company""".replace("180", "181"))
def economic_utilization(spark, sf):
    return status.economic_utilization(assets(spark, sf), periods(spark, sf), AS_OF, ["company"])


@query("SELECT generation, count(*) AS n, round(avg(day_rate), 4) AS avg_rate FROM rates GROUP BY generation")
def average_rate(spark, sf):
    return _r(status.average_rate(assets(spark, sf), periods(spark, sf), AS_OF, ["generation"]), "avg_rate")


@query("""SELECT g.generation, CAST(coalesce(a.n, 0) AS BIGINT) AS assets, CAST(coalesce(floor(r.avg + 0.5), 0) AS BIGINT) AS avg_rate
FROM (SELECT unnest(['6G', '7G', '7G+', '8G']) AS generation) AS g LEFT JOIN (SELECT generation, count(*) AS n FROM assets GROUP BY generation) AS a USING (generation)
LEFT JOIN (SELECT generation, avg(day_rate) AS avg FROM rates GROUP BY generation) AS r USING (generation)""")
def generation_stats(spark, sf):
    return market.generation_stats(assets(spark, sf), periods(spark, sf), AS_OF, GENERATIONS)


@query("""SELECT f.company, f.n AS assets, CAST(coalesce(floor(r.avg + 0.5), 0) AS BIGINT) AS avg_rate, round((coalesce(floor(r.avg + 0.5), 0) - m.avg) / m.avg * 100, 4) AS premium,
 f.u AS utilization, CASE WHEN f.u >= 95 THEN 'tight' WHEN f.u >= 85 THEN 'firm' WHEN f.u >= 75 THEN 'balanced' ELSE 'soft' END AS band
FROM (SELECT company, count(*) AS n, CAST(floor(count(*) FILTER (effective_status = 'Active') / count(*) * 100 + 0.5) AS BIGINT) AS u FROM statuses GROUP BY company) AS f
LEFT JOIN (SELECT company, avg(day_rate) AS avg FROM rates GROUP BY company) AS r USING (company), (SELECT avg(day_rate) AS avg FROM rates) AS m""")
def company_stats(spark, sf):
    return _r(market.company_stats(assets(spark, sf), periods(spark, sf), AS_OF), "premium")


def _pivot_sql() -> str:
    cells = ", ".join(f"count(*) FILTER (generation = '{g}') AS \"{g}_count\", CAST(coalesce(floor(sum(t) FILTER (generation = '{g}') / sum(n) FILTER (generation = '{g}') + 0.5), 0) AS BIGINT) AS \"{g}_avg_rate\"" for g in GENERATIONS)
    return f"SELECT company, {cells} FROM assets LEFT JOIN (SELECT asset_id, sum(day_rate) AS t, count(*) AS n FROM rates GROUP BY asset_id) AS r USING (asset_id) GROUP BY company"


@query(_pivot_sql())
def company_generation_pivot(spark, sf):
    return market.company_generation_pivot(assets(spark, sf), periods(spark, sf), AS_OF, GENERATIONS)


@query("""SELECT company, arg_min(asset_id, (-a, asset_id)) AS top_asset, max(a) AS top_rate, arg_min(asset_id, (a, asset_id)) AS bottom_asset, min(a) AS bottom_rate
FROM (SELECT company, asset_id, CAST(floor(avg(day_rate) + 0.5) AS BIGINT) AS a FROM rates GROUP BY company, asset_id) WHERE a > 0 GROUP BY company""")
def rate_extremes(spark, sf):
    return market.rate_extremes(assets(spark, sf), periods(spark, sf), AS_OF)


@query("SELECT asset_id, start_date, end_date, days FROM islands", dates="start_date end_date")
def coverage_islands(spark, sf):
    return intervals.coverage_islands(periods(spark, sf), YEAR_START, AS_OF)


@query("SELECT asset_id, days FROM covered")
def covered_days(spark, sf):
    return intervals.covered_days(assets(spark, sf), periods(spark, sf), YEAR_START, AS_OF)


@query("""SELECT asset_id, DATE '1995-01-01' AS start_date, start_date AS end_date FROM o WHERE k = 1 AND start_date > DATE '1995-01-01'
UNION ALL SELECT asset_id, end_date, nxt FROM o WHERE end_date < nxt
UNION ALL SELECT asset_id, end_date, DATE '2001-12-31' FROM o WHERE nxt IS NULL AND end_date < DATE '2001-12-31'""".join(
    [", o AS (SELECT asset_id, start_date, end_date, row_number() OVER w AS k, lead(start_date) OVER w AS nxt FROM firm WINDOW w AS (PARTITION BY asset_id ORDER BY start_date, contract_id)) ", ""]), dates="start_date end_date")
def idle_periods(spark, sf):
    return intervals.idle_periods(periods(spark, sf), dt.date(1995, 1, 1), dt.date(2001, 12, 31))


@query("""SELECT contract_id, round(CAST(greatest(start_date, DATE '1998-01-01') - DATE '1998-01-01' AS DOUBLE) / 1096 * 100, 4) AS left_pct,
 round(CAST(least(end_date + 1, DATE '2001-01-01') - greatest(start_date, DATE '1998-01-01') AS DOUBLE) / 1096 * 100, 4) AS width_pct
FROM contracts WHERE start_date <= end_date AND least(end_date + 1, DATE '2001-01-01') > greatest(start_date, DATE '1998-01-01')""")
def timeline_span(spark, sf):
    left, width = intervals.timeline_span(F.col("start_date"), F.col("end_date"), 1998, 2000)
    return _r(periods(spark, sf).select("contract_id", left.alias("left_pct"), width.alias("width_pct")).where("left_pct is not null"), "left_pct", "width_pct")


@query("""SELECT mark, round((12 * (year(mark) - 1999) + month(mark) - 1) / ((y - 1998) * 12) * 100, 4) AS percent,
 CASE WHEN month(mark) = 1 OR mark = DATE '1999-04-01' THEN year(mark) || ' Q' || quarter(mark) ELSE 'Q' || quarter(mark) END AS label, month(mark) = 1 AS is_year, mark = DATE '1999-04-01' AS is_current
FROM (SELECT y, CAST(unnest(range(DATE '1999-01-01', make_date(y + 1, 1, 2), INTERVAL 3 MONTH)) AS DATE) AS mark FROM (SELECT greatest(year(max(end_date)), 2001) AS y FROM contracts))""", dates="mark")
def timeline_axis(spark, sf):
    return _r(intervals.timeline_axis(periods(spark, sf), AS_OF), "percent")


@query("SELECT contract_id, asset_id, name, company, generation, client, start_date, end_date, days, rate, basis FROM observations", dates="start_date end_date")
def rate_observations(spark, sf):
    return observations.rate_observations(assets(spark, sf), contracts(spark, sf))


@query("""SELECT generation, asset_id, contract_id, start_date, rate, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY generation ORDER BY start_date DESC, asset_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_date DESC, contract_id DESC) AS k FROM observations) WHERE k = 1) WHERE rank <= 3""", dates="start_date")
def latest_labels(spark, sf):
    return observations.latest_labels(observations.rate_observations(assets(spark, sf), contracts(spark, sf)), 3)


@query("""SELECT generation, basis, count(*) AS n, round(sum(rate), 2) AS total FROM observations WHERE NOT (generation = '7G+' AND start_date < DATE '1999-01-01') AND basis = 'reported' GROUP BY generation, basis""")
def observation_window(spark, sf):
    shown = observations.series(observations.rate_observations(assets(spark, sf), contracts(spark, sf)), None, {"7G+": 1999}, False)
    return shown.groupBy("generation", "basis").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 2).alias("total"))


@query("""SELECT CAST(y0 AS INT) AS first_year, CAST(y1 AS INT) AS last_year, lo AS low, hi AS high, array_to_string(range(lo, hi + 1, 50000), ',') AS ticks FROM (
 SELECT min(year(start_date)) AS y0, max(year(start_date)) AS y1, CAST(greatest(0, floor((min(rate) - 20000) / 50000) * 50000) AS BIGINT) AS lo, CAST(ceil((max(rate) + 20000) / 50000) * 50000 AS BIGINT) AS hi FROM observations)""")
def axis_domain(spark, sf):
    return market.axis_domain(observations.rate_observations(assets(spark, sf), periods(spark, sf))).withColumn("ticks", F.array_join("ticks", ","))


@query("""SELECT c.contract_id, c.asset_id, a.name, a.company, a.generation, c.client, c.region, c.status, strftime(start_date, '%Y-%m-%d') || ' ~ ' || strftime(end_date, '%Y-%m-%d') AS period,
 CASE WHEN day_rate > 0 THEN day_rate WHEN value_usd / base_days > 0 THEN value_usd / base_days END AS rate,
 CASE WHEN day_rate > 0 THEN 'disclosed' WHEN value_usd / base_days > 0 THEN 'derived' ELSE 'undisclosed' END AS rate_basis,
 CASE WHEN value_usd / base_days > 0 THEN value_usd END AS value_usd, CASE WHEN value_usd / base_days > 0 THEN base_days END AS base_days
FROM contracts AS c JOIN assets AS a USING (asset_id)""")
def contract_report(spark, sf):
    return observations.contract_report(assets(spark, sf), contracts(spark, sf)).drop("evidence", "originally_read_at")


@query(dates="date")
def rate_trend(spark, sf):
    return _r(trend.rate_trend(observations.rate_observations(assets(spark, sf), periods(spark, sf))), "rate", "band_lo", "band_hi")
