"""Scalar functions on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from assetspan.functions import hashes, scalars
from assetspan.operators import intervals


def value(spark, column, **inputs):
    df = spark.range(1)
    for name, (x, kind) in inputs.items():
        df = df.withColumn(name, F.lit(x).cast(kind))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,ok", [("2026-02-28", True), ("2026-02-30", False), ("2026-2-3", False), ("tomorrow", False), ("2026-06-30T00:00:00", False), (None, False)])
def test_strict_dates(spark, text, ok):
    assert value(spark, scalars.is_iso_date(F.col("x")), x=(text, "string")) is ok


@pytest.mark.parametrize("x,expected", [(5.0, 5.0), (0.0, 0.0), (-1.0, 0.0), (math.inf, 0.0), (math.nan, 0.0), (None, 0.0)])
def test_reported_rate(spark, x, expected):
    assert value(spark, scalars.reported_rate(F.col("x")), x=(x, "double")) == expected


@pytest.mark.parametrize("amount,days,expected", [(182.5e6, 365.0, 500000.0), (0.0, 10.0, 0.0), (-1.0, 10.0, None), (5.0, 0.0, None), (math.nan, 5.0, None), (5.0, math.inf, None), (None, 5.0, None)])
def test_derived_rate(spark, amount, days, expected):
    assert value(spark, scalars.derived_rate(F.col("a"), F.col("d")), a=(amount, "double"), d=(days, "double")) == expected


def test_durations_and_rounding(spark):
    f = lambda y, m: value(spark, scalars.duration_days(F.lit(y), F.lit(m), F.lit(0)))
    assert (f(1, 0), f(0, 6)) == (365, 182.5)
    assert [value(spark, scalars.js_round(F.lit(x))) for x in (2.5, -2.5, 0.49)] == [3, -2, 0]
    assert [value(spark, scalars.backoff_seconds(F.lit(n))) for n in (0, 1, 2, 7, 8, 100)] == [300, 300, 600, 19200, 21600, 21600]


@pytest.mark.parametrize("a,b,same", [("Client Energy Ltd", "client", True), ("Undisclosed", "name unknown", True), ("A B", "C B", False), ("", "", False), ("Ex-On x", "exon y", True)])
def test_clients(spark, a, b, same):
    keys = [set(value(spark, scalars.client_keys(F.col("x")), x=(t, "string"))) for t in (a, b)]
    assert bool(keys[0] & keys[1]) is same


def test_dates_in_text_and_urls(spark):
    v = lambda c, x: value(spark, c(F.col("x")), x=(x, "string"))
    assert v(scalars.publication_date, "March 5, 2026") == v(scalars.publication_date, "03/05/2026") == "2026-03-05"
    assert v(scalars.publication_date, "2026-03-05T10:00:00Z") == "2026-03-05T10:00:00+00:00"
    assert v(scalars.publication_date, "soon") is None
    assert str(v(scalars.prose_date, "as of  May 7, 2025 and 01/02/2024")) == "2025-05-07"
    assert v(scalars.canonical_url, "HTTPS://Ex.COM/A?b=C#d") == "https://ex.com/A?b=C"
    assert v(scalars.strip_query_param, "https://e.com/a?x=1&Refresh=2&y=3#z") == "https://e.com/a?x=1&y=3#z"
    assert v(scalars.strip_query_param, "https://e.com/a?refresh=2") == "https://e.com/a"
    assert v(scalars.clean_text, " a  b\n") == "a b" and v(scalars.clean_text, None) == ""
    assert v(scalars.slug, "Deep Ocean 7") == "deep-ocean-7"
    assert v(scalars.safe_url, "http://e.com") is None


def test_spans(spark):
    left, width = intervals.timeline_span(F.col("a"), F.col("b"), 2028, 2028)
    case = lambda a, b: (value(spark, left, a=(a, "date"), b=(b, "date")), value(spark, width, a=(a, "date"), b=(b, "date")))
    assert case("2028-02-01", "2028-02-29") == (pytest.approx(31 / 366 * 100), pytest.approx(29 / 366 * 100))
    assert case("2028-03-01", "2028-02-01") == (None, None) and case("2027-01-01", "2027-12-31") == (None, None)


def test_identities(spark):
    import hashlib

    v = value(spark, hashes.source_id(F.lit("C"), F.lit("k"), F.lit("HTTPS://E.com/x#y")))
    assert v == "source-" + hashlib.sha256(b'["C","k","https://e.com/x"]').hexdigest()
    assert value(spark, hashes.job_id(F.lit("s"), F.lit("h"))) == "job-" + hashlib.sha256(b"s\nh").hexdigest()[:32]
    assert value(spark, hashes.new_contract_id(F.lit("a"), F.lit("s"), F.lit("h"), F.lit(3), F.lit(0))) == "a-r" + hashlib.sha256(b'["s","h",3]').hexdigest()[:12]
    assert value(spark, hashes.new_contract_id(F.lit("a"), F.lit("s"), F.lit("h"), F.lit(3), F.lit(2))) == "a-r" + hashlib.sha256(b'["s","h","3.2"]').hexdigest()[:12]
    assert value(spark, hashes.canonical_hash(F.lit('{"b":1.0,"a":[2]}'))) == hashlib.sha256(b'{"a":[2],"b":1.0}').hexdigest()


def test_table_digest_ignores_order_but_not_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    digest = lambda df: hashes.table_digest(df).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("a")).repartition(3)) != digest(a.distinct())
