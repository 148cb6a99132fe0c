"""The model's tables from a star schema of parts, orders and line items.

An asset is a part, a contract is a line item: asset by part key, period from ship date over as many days as the quantity, both
ends inclusive.  ORACLE holds the same rules as common table expressions, for checking with another engine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(1999, 6, 30)
YEAR_START = dt.date(1999, 1, 1)
#: Fixed values of the domain: owners, classes from newest to oldest rank, contract and asset states.
COMPANIES = ["C0", "C1", "C2", "C3"]
GENERATIONS = ["6G", "7G", "7G+", "8G"]
CONTRACT_STATES = ["Firm", "Option", "Contingent"]
ASSET_STATES = ["Active", "Idle", "Warm-Stacked", "Cold-Stacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    state = F.col("p_partkey") % 10
    return p.select(
        F.col("p_partkey").cast("string").alias("asset_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("C"), (F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 4).cast("string")).alias("company"),
        F.element_at(F.array(*map(F.lit, GENERATIONS)), (F.col("p_size") % 4 + 1).cast("int")).alias("generation"),
        F.when(state <= 6, "Active").when(state == 7, "Idle").when(state == 8, "Warm-Stacked").otherwise("Cold-Stacked").alias("status"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(dt.date(1998, 12, 31))).alias("status_as_of"),
        (F.lit(1990) + F.col("p_size") % 30).cast("int").alias("year_built"),
    )


def _rows(items: DataFrame, client, region) -> DataFrame:
    quantity, start = F.col("l_quantity").cast("int"), F.to_date("l_shipdate")
    return items.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format(start, "yyyyMMdd"), quantity.cast("string")).alias("contract_id"),
        F.col("l_partkey").cast("string").alias("asset_id"),
        start.alias("start_date"),
        F.date_add(start, quantity - 1).alias("end_date"),
        F.when(F.col("l_returnflag").isin("A", "R"), "Firm").when(F.col("l_linestatus") == "F", "Option").otherwise("Contingent").alias("status"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("day_rate"),
        F.when(F.col("l_discount") == 0, "Undisclosed").otherwise(client).alias("client"),
        region.alias("region"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice")).alias("value_usd"),
        F.when(F.col("l_discount") >= 0.03, F.col("l_quantity")).alias("base_days"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows, fixed
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _rows(joined, F.col("c_mktsegment"), F.col("n_name"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contracts for what asks neither who the client is nor where: one scan of the line items, which all have an order and a customer; those two columns
    are null unless the client is undisclosed."""
    none = F.lit(None).cast("string")
    return _rows(table(spark, sf_dir, "lineitem"), none, none)


ORACLE = """
assets AS (
  SELECT CAST(p_partkey AS VARCHAR) AS asset_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
    'C' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR) AS company,
    (['6G', '7G', '7G+', '8G'])[p_size % 4 + 1] AS generation,
    CASE WHEN p_partkey % 10 <= 6 THEN 'Active' WHEN p_partkey % 10 = 7 THEN 'Idle' WHEN p_partkey % 10 = 8 THEN 'Warm-Stacked' ELSE 'Cold-Stacked' END AS status,
    CASE WHEN p_partkey % 3 = 0 THEN DATE '1998-12-31' END AS status_as_of, CAST(1990 + p_size % 30 AS INT) AS year_built
  FROM part),
contracts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INT)) AS contract_id,
    CAST(l_partkey AS VARCHAR) AS asset_id, CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INT) - 1) AS end_date,
    CASE WHEN l_returnflag IN ('A', 'R') THEN 'Firm' WHEN l_linestatus = 'F' THEN 'Option' ELSE 'Contingent' END AS status,
    CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS day_rate,
    CASE WHEN l_discount = 0 THEN 'Undisclosed' ELSE c_mktsegment END AS client, n_name AS region,
    CASE WHEN l_discount >= 0.05 THEN l_extendedprice END AS value_usd, CASE WHEN l_discount >= 0.03 THEN l_quantity END AS base_days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
firm AS (SELECT * FROM contracts WHERE status = 'Firm' AND start_date <= end_date),
statuses AS (
  SELECT a.*, CASE WHEN a.status = 'Active' THEN CASE WHEN m.last IS NULL THEN 'Idle' ELSE 'Active' END
    WHEN a.status_as_of IS NULL OR DATE '1999-06-30' <= a.status_as_of THEN a.status
    WHEN m.last > a.status_as_of THEN 'Active' ELSE a.status END AS effective_status
  FROM assets AS a LEFT JOIN (SELECT asset_id, max(start_date) AS last FROM firm WHERE DATE '1999-06-30' BETWEEN start_date AND end_date GROUP BY asset_id) AS m USING (asset_id)),
rates AS (
  SELECT c.*, a.company, a.generation, a.name FROM contracts AS c JOIN assets AS a USING (asset_id)
  WHERE c.status = 'Firm' AND c.start_date <= c.end_date AND DATE '1999-06-30' BETWEEN c.start_date AND c.end_date AND c.day_rate > 0),
clipped AS (SELECT asset_id, greatest(start_date, DATE '1999-01-01') AS s, least(end_date, DATE '1999-06-30') AS e FROM firm WHERE end_date >= DATE '1999-01-01' AND start_date <= DATE '1999-06-30'),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM clipped),
islands AS (
  SELECT asset_id, min(s) AS start_date, max(e) AS end_date, CAST(max(e) - min(s) + 1 AS BIGINT) AS days
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY asset_id, island),
covered AS (SELECT a.asset_id, CAST(coalesce(sum(i.days), 0) AS BIGINT) AS days FROM assets AS a LEFT JOIN islands AS i USING (asset_id) GROUP BY a.asset_id),
observations AS (
  SELECT c.contract_id, c.asset_id, a.name, a.company, a.generation, c.client, c.start_date, c.end_date, CAST(c.end_date - c.start_date + 1 AS INT) AS days,
    CASE WHEN c.day_rate > 0 THEN c.day_rate ELSE c.value_usd / c.base_days END AS rate, CASE WHEN c.day_rate > 0 THEN 'reported' ELSE 'derived' END AS basis
  FROM firm AS c JOIN assets AS a USING (asset_id) WHERE c.day_rate > 0 OR c.value_usd / c.base_days > 0)
"""
