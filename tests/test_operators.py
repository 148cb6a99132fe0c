"""Operators on small literal tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetspan.operators import apply, decisions, documents, feed, intervals, jobs, market, observations, quality, status, trend
from assetspan.sources import snapshots

ASSET = "asset_id string, name string, company string, generation string, status string, status_as_of date, year_built int"
CONTRACT = "contract_id string, asset_id string, start_date date, end_date date, day_rate double, client string, region string, status string, value_usd double, base_days double"
D = dt.date
AS_OF = D(2026, 6, 30)


def fleet(spark):
    return spark.createDataFrame(
        [("a", "A", "X", "7G", "Active", None, 2010), ("b", "B", "X", "7G", "Cold-Stacked", D(2026, 1, 1), 2010), ("c", "C", "Y", "8G", "Warm-Stacked", None, 2020), ("d", "D", "Y", "8G", "Active", None, 2020)], ASSET
    )


def rows(spark, *items):
    full = [(f"k{i}", a, s, e, r, "Client", "Sea", st, v, n) for i, (a, s, e, r, st, v, n) in enumerate(items)]
    return spark.createDataFrame(full, CONTRACT)


def contracts(spark):
    return rows(
        spark,
        ("a", D(2026, 1, 10), D(2026, 2, 10), 100.0, "Firm", None, None), ("a", D(2026, 2, 11), D(2026, 7, 1), 300.0, "Firm", None, None), ("a", D(2026, 3, 1), D(2026, 3, 5), 0.0, "Firm", 100.0, 5.0),
        ("b", D(2026, 5, 1), D(2026, 12, 1), 500.0, "Firm", None, None), ("c", D(2026, 5, 1), D(2026, 12, 1), 900.0, "Firm", None, None), ("d", D(2026, 5, 1), D(2026, 12, 1), 900.0, "Option", None, None),
    )


def test_effective_status(spark):
    out = {r.asset_id: r.effective_status for r in status.effective_status(fleet(spark), contracts(spark), AS_OF).collect()}
    assert out == {"a": "Active", "b": "Active", "c": "Warm-Stacked", "d": "Idle"}


def test_coverage_and_utilization(spark):
    days = {r.asset_id: r.days for r in intervals.covered_days(fleet(spark), contracts(spark), D(2026, 1, 1), AS_OF).collect()}
    assert days == {"a": 172, "b": 61, "c": 61, "d": 0}
    kpi = status.fleet_kpis(fleet(spark), contracts(spark), AS_OF).first()
    assert (kpi.total, kpi.active, kpi.cold, kpi.fleet_utilization) == (4, 2, 0, 50)
    eco = status.economic_utilization(fleet(spark), contracts(spark), AS_OF).first()
    assert (eco.contract_days, eco.possible_days, eco.economic_utilization) == (294, 724, 41)


def test_idle_periods_consecutive_or_merged(spark):
    nested = rows(spark, ("a", D(2026, 1, 1), D(2026, 12, 1), 1.0, "Firm", None, None), ("a", D(2026, 2, 1), D(2026, 3, 1), 1.0, "Firm", None, None), ("a", D(2026, 4, 1), D(2026, 5, 1), 1.0, "Firm", None, None))
    gaps = lambda m: sorted((str(r.start_date), str(r.end_date)) for r in intervals.idle_periods(nested, D(2026, 1, 1), D(2026, 12, 31), m).collect())
    assert gaps(False) == [("2026-03-01", "2026-04-01"), ("2026-05-01", "2026-12-31")]
    assert gaps(True) == [("2026-12-01", "2026-12-31")]


def test_observations_prefer_disclosed(spark):
    o = {r.contract_id: (r.rate, r.basis, r.days) for r in observations.rate_observations(fleet(spark), contracts(spark)).collect()}
    assert o["k2"] == (20.0, "derived", 5) and o["k0"] == (100.0, "reported", 32) and "k5" not in o
    assert observations.series(observations.rate_observations(fleet(spark), contracts(spark)), "7G", {"7G": 2027}).count() == 0


def test_market_tables(spark):
    stats = {r.company: (r.assets, r.avg_rate, r.utilization) for r in market.company_stats(fleet(spark), contracts(spark), AS_OF).collect()}
    assert stats == {"X": (2, 400, 100), "Y": (2, 900, 0)}
    empty = market.generation_stats(fleet(spark), contracts(spark), AS_OF, ["6G", "7G"]).collect()
    assert {r.generation: (r.assets, r.avg_rate) for r in empty} == {"6G": (0, 0), "7G": (2, 400)}
    d = market.axis_domain(observations.rate_observations(fleet(spark), contracts(spark)).where("1 = 0")).first()
    assert (d.first_year, d.low, d.high, d.ticks) == (2021, 200000, 550000, [])


def series(spark, points):
    return spark.createDataFrame([("g", D(2020, 1, 1) + dt.timedelta(days=int(x)), float(y)) for x, y in points], "generation string, start_date date, rate double")


def test_trend_fits_lines_and_constants(spark):
    for f in (lambda x: 1000 + 3.5 * x, lambda x: 700.0):
        out = trend.rate_trend(series(spark, [(30 * i, f(30 * i)) for i in range(20)])).collect()
        assert len(out) == 20
        for r in out:
            x = (r.date - D(2020, 1, 1)).days
            assert abs(r.rate - f(x)) < 1e-3 and abs(r.band_hi - r.band_lo) < 2e-3


def test_trend_ignores_order_and_outliers_and_needs_enough(spark):
    rng = np.random.default_rng(1)
    points = [(10 * i, 1000 + 20 * i + rng.normal(0, 5)) for i in range(40)]
    a = {r.date: r.rate for r in trend.rate_trend(series(spark, points)).collect()}
    b = {r.date: r.rate for r in trend.rate_trend(series(spark, points[::-1]).repartition(3)).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    spoiled = lambda by: [(x, y if i != 20 else y + by) for i, (x, y) in enumerate(points)]
    c = {r.date: r.rate for r in trend.rate_trend(series(spark, spoiled(60))).collect()}
    assert max(abs(a[k] - c[k]) for k in a) < 25
    assert [r.reason for r in trend.rate_trend(series(spark, spoiled(5000))).collect()] == ["no valid trend"]
    assert trend.rate_trend(series(spark, points[:4])).first().reason and trend.rate_trend(series(spark, [(0, 1), (0, 2), (1, 3), (2, 4), (2, 5)])).first().reason


GOOD = '{"vesselId":"a","contractId":null,"action":"upsert","row":{"startDate":"2027-01-01","endDate":"2027-02-01","dayRate":5,"client":"C","region":"R","status":"Firm","interpretation":{"valueUsd":182500000,"baseDurationDays":365,"derivedUsdPerDay":1}}}'
BAD = [
    ("3", "object"), ('{"vesselId":"zz","action":"hold"}', "registered"), ('{"vesselId":"c","action":"hold"}', "registered"), ('{"vesselId":"a","action":"delete"}', "action"), ('{"vesselId":"a","contractId":"k3","action":"no-change"}', "contractId"),
    ('{"vesselId":"a","contractId":7,"action":"no-change"}', "contractId"), ('{"vesselId":"a","action":"withdraw"}', "withdraw"), ('{"vesselId":"a","action":"upsert","row":null}', "row"), (GOOD.replace("2027-01-01", "2027-02-30"), "startDate"),
    (GOOD.replace("2027-01-01", "2027-03-01"), "after"), (GOOD.replace('"dayRate":5', '"dayRate":"5"'), "dayRate"), (GOOD.replace('"dayRate":5', '"dayRate":true'), "dayRate"), (GOOD.replace('"dayRate":5', '"dayRate":-1'), "dayRate"),
    (GOOD.replace('"dayRate":5', '"dayRate":1e400'), "dayRate"), (GOOD.replace('"client":"C"', '"client":" "'), "client"), (GOOD.replace('"region":"R",', ""), "region"), (GOOD.replace('"Firm"', '"Maybe"'), "status"),
    (GOOD.replace("182500000", '"100"'), "valueUsd"), (GOOD.replace("365,", "0,"), "baseDurationDays"), (GOOD.replace('"valueUsd"', '"includes":[1],"valueUsd"'), "includes"), (GOOD.replace('"valueUsd"', '"awardType":"gift","valueUsd"'), "awardType"),
    (GOOD.replace('"valueUsd"', '"termText":4,"valueUsd"'), "termText"),
]


def validated(spark, items, job="j"):
    payload = '{"reportDate":"2026-06-30","vesselUpdates":[],"decisions":[' + ",".join(items) + "]}"
    r = spark.createDataFrame([(job, "X", payload)], "job_id string, company string, payload string")
    return decisions.validate_decisions(r, fleet(spark), contracts(spark), ["Firm", "Option", "Contingent"])


def test_each_bad_decision_is_held_alone(spark):
    out = sorted(validated(spark, [x for bad, _ in BAD for x in (bad, GOOD)]).collect(), key=lambda r: r["index"])
    for i, (_, word) in enumerate(BAD):
        assert word in (out[2 * i].hold_reason or ""), (BAD[i], out[2 * i].hold_reason)
        good = out[2 * i + 1]
        assert good.hold_reason is None and good.row.derived_usd_per_day == 500000


def test_malformed_responses_are_rejected(spark):
    texts = ["no json", "[]", '{"decisions":{}}', '{"decisions":[],"vesselUpdates":[],"x":NaN}', '{"decisions":[],"vesselUpdates":[]}']
    r = spark.createDataFrame([(str(i), "X", t) for i, t in enumerate(texts)], "job_id string, company string, payload string")
    assert [x.job_id for x in decisions.envelopes(r).where("reject_reason is null").collect()] == ["4"]


def documented(d):
    return d.withColumns({"source_id": F.lit("s"), "document_sha256": F.lit("h"), "kind": F.lit("official-news"), "url": F.lit("https://e.com"), "published_at": F.lit("2026-06-30")})


def test_apply_in_order(spark):
    withdraw = '{"vesselId":"a","contractId":"k0","action":"withdraw"}'
    replace = GOOD.replace('"contractId":null', '"contractId":"k1"')
    out = apply.apply_decisions(fleet(spark), contracts(spark), documented(validated(spark, [withdraw, withdraw, replace, GOOD, GOOD, '{"vesselId":"a","action":"hold","reasonKo":"why"}'])))
    ids = {r.contract_id: r for r in out.contracts.where("asset_id = 'a'").collect()}
    assert "k0" not in ids and ids["k1"].day_rate == 5.0 and ids["k1"].news_reviewed and len(ids) == 4
    assert sorted((r["index"], r.before is None) for r in out.changes.collect()) == [(0, False), (2, False), (3, True), (4, True)]
    assert out.holds.first().hold_reason == "why" and out.outcomes.first().outcome == "held"
    assert {r["index"]: r.review_status for r in out.events.collect()} == {0: "applied", 2: "applied", 3: "applied", 4: "applied", 5: "conflict"}
    again = apply.apply_decisions(fleet(spark), out.contracts, documented(validated(spark, [GOOD] * 4)))
    assert again.contracts.where("asset_id = 'a'").count() == 8  # the same revision once more never replaces a row


def test_documents_in_rounds_and_integrity(spark):
    first = documented(validated(spark, ['{"vesselId":"a","contractId":"k0","action":"withdraw"}'], "j1")).withColumn("round", F.lit(1))
    second = documented(validated(spark, ['{"vesselId":"a","contractId":"k0","action":"no-change"}'], "j2")).withColumn("round", F.lit(2))
    third = documented(validated(spark, [GOOD.replace('"dayRate":5', '"dayRate":7')], "j3")).withColumn("round", F.lit(3))
    broken = lambda a, c: quality.integrity_violations(a, c.where("day_rate = 7").withColumn("client", F.lit("")), a, ["7G", "8G"], ["Active", "Idle", "Warm-Stacked", "Cold-Stacked"], ["Firm", "Option"])
    after, outcomes = apply.apply_documents(fleet(spark), contracts(spark), first.unionByName(second).unionByName(third), broken)
    assert {r.job_id: r.outcome for r in outcomes.collect()} == {"j1": "applied", "j2": "held", "j3": "failed"}
    assert after.where("contract_id = 'k0' or day_rate = 7").count() == 0


def test_rounds_carry_updates_changes_holds_and_events(spark):
    update = lambda job, status, day, r, why=None: (job, "X", 0, "a", status, day, why, r)
    u = [update("j1", "Cold-Stacked", "2026-06-01", 1), update("j2", "Cold-Stacked", "2026-06-01", 2), update("j3", "Idle", "2026-06-03", 3, "status is invalid"), update("j4", "Active", "2026-06-04", 4)]
    u = spark.createDataFrame(u, "job_id string, company string, index int, asset_id string, status string, status_as_of string, hold_reason string, round int").withColumn("status_as_of", F.to_date("status_as_of"))
    item = ['{"vesselId":"a","contractId":"k0","action":"withdraw"}', GOOD, '{"vesselId":"a","action":"hold","reasonKo":"why"}']
    d = [documented(validated(spark, [x], f"j{i}")).withColumn("round", F.lit(i)) for i, x in enumerate(item, 1)]
    broken = lambda a, c: a.where("asset_id = 'a' and status = 'Active' and status_as_of = '2026-06-04'").select("asset_id", F.lit(None).alias("contract_id"))
    done = apply.apply_rounds(fleet(spark), contracts(spark), d[0].unionByName(d[1]).unionByName(d[2]), broken, u)
    assert {r.job_id: r.outcome for r in done.outcomes.collect()} == {"j1": "applied", "j2": "applied", "j3": "held", "j4": "failed"}
    a = done.assets.where("asset_id = 'a'").first()
    assert (a.status, str(a.status_as_of)) == ("Cold-Stacked", "2026-06-01")
    assert sorted((r.job_id, r.action) for r in done.changes.collect()) == [("j1", "status"), ("j1", "withdraw"), ("j2", "upsert")]
    assert sorted((r.job_id, r.hold_reason) for r in done.holds.collect()) == [("j3", "status is invalid"), ("j3", "why")]
    assert sorted((r.job_id, r.review_status) for r in done.events.collect()) == [("j1", "applied"), ("j2", "applied"), ("j3", "conflict"), ("j3", "conflict")]
    docs = spark.createDataFrame([(f"j{i}", "X", i, ["old"]) for i in range(6)], "job_id string, company string, round int, open_holds array<string>")
    held = {r.job_id: r.open_holds for r in apply.settle_holds(docs, done).collect()}
    assert sorted(held.pop("j3")) == ["status is invalid", "why"] and set(map(tuple, held.values())) == {()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clearing_holds_gathers_no_ids_of_a_company(spark):
    docs = spark.createDataFrame([("j1", "X", ["a"]), ("j2", "X", ["b"]), ("j3", "X", ["c"]), ("j4", "Y", ["d"])], "job_id string, company string, open_holds array<string>")
    outcomes = spark.createDataFrame([("j1", "applied"), ("j2", "held"), ("j4", "failed")], "job_id string, outcome string")
    cleared = apply.clear_holds(docs, outcomes)
    assert {r.job_id: r.open_holds for r in cleared.collect()} == {"j1": ["a"], "j2": ["b"], "j3": [], "j4": ["d"]}
    assert "collect_" not in plan_of(cleared) and "array_contains" not in plan_of(cleared)


def test_suspected_duplicates(spark):
    near = GOOD.replace("2027-01-01", "2026-03-01").replace('"client":"C"', '"client":"client Ltd"')
    pairs = decisions.suspected_duplicates(validated(spark, [near, GOOD]), contracts(spark)).collect()
    assert [(r["index"], r.other_contract_id) for r in pairs] == [(0, "k1")]


def test_registering_twice_changes_nothing(spark):
    cap = spark.createDataFrame([("s1", "X", "official-news", "u1", "t", "2026-01-01", "h1"), ("s1", "X", "official-news", "u1", "t", "2026-01-01", "h2"), ("s2", "X", "fleet-report", "u2", None, None, "h3")], "source_id string, company string, kind string, url string, title string, published_at string, document_sha256 string")
    empty = spark.createDataFrame([], "job_id string, source_id string, company string, kind string, url string, title string, published_at string, document_sha256 string, status string, outcome string, failure_count int, next_attempt_after long, last_success_at string")
    done = cap.where("document_sha256 = 'h3'").select("source_id", "document_sha256")
    once = jobs.register(empty, cap, done, "now")
    assert {(r.document_sha256, r.status, r.outcome) for r in once.collect()} == {("h1", "pending", None), ("h2", "pending", None), ("h3", "completed", "migrated")}
    assert jobs.register(once, cap, done, "later").drop("last_success_at").exceptAll(once.drop("last_success_at")).count() == 0
    newer = jobs.register(once, cap.limit(1).withColumn("document_sha256", F.lit("h9")).withColumn("source_id", F.lit("s1")), done, "later")
    assert {r.document_sha256 for r in newer.collect()} == {"h9", "h3"}


PAGE = "<html><head><title>T</title></head><body><nav>menu</nav><article class='news'><h1>Head</h1><p>one<b>two</b>, three</p><table><tr><td>x</td><td>y</td></tr></table>" + "<p>" + "word " * 30 + "</p><script>no</script></article><time datetime='2026-03-05'>x</time><a href='/n/1'>Next</a></body></html>"


def test_reading_pages(spark):
    pages = spark.createDataFrame([("https://e.com/a", PAGE), ("https://e.com/b", "<title>Access denied</title>" + PAGE), ("https://e.com/c", "<article>short</article>"), ("https://e.com/d", None), ("https://e.com/e", "<p>no article</p>")], "url string, html string")
    out = {r.url[-1]: r for r in documents.extract_articles(pages).collect()}
    assert out["a"].text.startswith("Head onetwo, three x y word word") and out["a"].locator == "html:article.news" and "no" not in out["a"].text.split()
    assert [out[k].reject_reason for k in "bcde"] == ["error page", "body is unexpectedly short", "document is empty", "article body is missing"]
    assert {r.url[-1]: r.published_at for r in documents.publication_metadata(pages).collect()}["a"] == "2026-03-05"
    assert documents.extract_links(pages, "/n/").select("url").distinct().first().url == "https://e.com/n/1"


def test_feed_and_triage(spark):
    cand = spark.createDataFrame([("1",), ("2",), ("2",)], "job_id string")
    given = spark.createDataFrame([("1", "odd", 0), ("1", "contract", 1), ("9", "contract", 2)], "job_id string, category string, pos int")
    assert {r.job_id: r.category for r in feed.triage_categories(cand, given, ["contract"]).collect()} == {"1": "contract", "2": "other"}
    assert feed.triage_select(cand, given).count() == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    snapshots.publish({"assets": fleet(spark), "contracts": contracts(spark)}, path)
    snapshots.publish({"assets": fleet(spark).where("asset_id <> 'd'"), "contracts": contracts(spark)}, path)
    assert all(r.ok for r in snapshots.verify(spark, path).collect())
    assert len(snapshots.prune(spark, path)) == 1 and snapshots.load_table(spark, path, "assets").count() == 3
    seed = {"assets": fleet(spark)}
    assert snapshots.load_snapshot(spark, path, seed, {"assets": 3})["assets"].count() == 3
    assert snapshots.load_snapshot(spark, path, seed, {"assets": 9}) is seed and snapshots.load_snapshot(spark, path + "x", seed, {"assets": 3}) is seed


def test_fleet_files(spark, tmp_path):
    import json

    path = str(tmp_path / "fleet.json")
    one = {"id": "a", "name": "A", "company": "X", "generation": "7G", "status": "Active", "yearBuilt": 2001, "contracts": [{"id": "k", "vesselId": "a", "startDate": "2026-01-01", "endDate": "2026-02-30", "dayRate": 5, "client": "C", "region": "R", "status": "Firm"}]}
    open(path, "w").write(json.dumps([one, one | {"id": "b", "contracts": []}]))
    assets, rows_ = snapshots.flatten(snapshots.import_fleet(spark, path))
    assert assets.count() == 2 and rows_.first().end_date is None
    assert {r.id: len(r.contracts) for r in snapshots.nest(assets, rows_).collect()} == {"a": 1, "b": 0}
    open(path, "w").write("[]")
    with pytest.raises(ValueError):
        snapshots.import_fleet(spark, path)
    journal = {"schemaVersion": 2, "jobs": [{"jobId": "j", "sourceId": "s", "company": "X", "kind": "k", "documentSha256": "h", "status": "completed", "outcome": "odd", "completedAt": "t"}, {"jobId": "i", "status": "pending"}], "sources": {"s": {"url": "u"}}}
    open(path, "w").write(json.dumps(journal))
    r = snapshots.read_documents(spark, path).collect()
    assert [(x.source_id, x.url, x.outcome, x.last_read_at) for x in r] == [("s", "u", "migrated", "t")]


def test_revisions_are_registered_once(spark, tmp_path):
    from assetspan.streaming import streams

    schema = "source_id string, document_sha256 string, captured_at string"
    src, table, cp = (str(tmp_path / x) for x in ("in", "table", "cp"))
    for part in [[("s", "h1", "1"), ("s", "h1", "1")], [("s", "h1", "1"), ("s", "h2", "3")], [("s", "h0", "2")]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        streams.revision_stream(spark.readStream.schema(schema).parquet(src), table, cp).awaitTermination()
    assert sorted(r.document_sha256 for r in spark.read.parquet(table).collect()) == ["h0", "h1", "h2"]


def plain(fleet_rows):
    """Rows of a fleet as JSON values, fields without a value left out."""
    import json

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return sorted((clean(json.loads(r)) for r in fleet_rows), key=lambda x: x["id"])


def test_fleet_files_come_back_whole(spark, tmp_path):
    import json

    reading = {"sourceStartText": "Q1", "awardType": "extension", "termText": "one year", "valueUsd": 10.5, "includes": ["mob"], "excludes": []}
    row = {"id": "k", "vesselId": "a", "startDate": "2026-01-01", "endDate": "2026-12-31", "dayRate": 5.0, "client": "C", "region": "R", "status": "Firm", "sourceUrl": "https://e.com", "sourcePublishedAt": "2026-01-02", "newsReviewed": True, "inputMode": "stored-result", "storedReading": {"a": [1, "x"]}, "datePrecision": {"start": "day", "end": "month"}, "interpretation": reading}
    ships = [
        {"id": "a", "name": "A", "company": "X", "generation": "7G", "status": "Active", "statusAsOf": "2026-02-30", "yearBuilt": 2001, "contracts": [row | {"id": "k2", "vesselId": "b", "startDate": "2027-01-01", "endDate": "soon"}, row]},
        {"id": "b", "name": "B", "company": "X", "generation": "7G", "status": "Idle", "yearBuilt": True, "contracts": []},
        {"id": "c", "name": "C", "company": "Y", "generation": "8G", "status": "Idle", "statusAsOf": "2026-01-05", "yearBuilt": "2003", "contracts": [{k: row[k] for k in ("startDate", "endDate", "dayRate", "client", "region", "status")} | {"id": "k3", "vesselId": "c"}]},
    ]
    path = tmp_path / "fleet.json"
    path.write_text(json.dumps(ships, indent=1))
    fleet_ = snapshots.read_fleet(spark, str(path))
    snapshots.export_fleet(fleet_.repartition(3), str(tmp_path / "out"))
    back = snapshots.read_fleet(spark, str(tmp_path / "out"))
    assert plain(back.toJSON().collect()) == plain(map(json.dumps, ships))
    assets, rows_ = snapshots.flatten(back)
    again = plain(snapshots.nest(assets, rows_).toJSON().collect())
    expected = plain(map(json.dumps, ships))
    expected[0]["contracts"].reverse()  # in order of start
    assert again == expected
    found = quality.integrity_violations(assets, rows_, assets, ["7G", "8G"], ["Active", "Idle"], ["Firm"])
    assert sorted((r.rule, r.asset_id) for r in found.collect()) == [("dates", "a"), ("parent", "a"), ("status date", "a"), ("year built", "b"), ("year built", "c")]


def test_non_finite_numbers_and_identity(spark):
    c = contracts(spark).withColumns({"value_usd": F.when(F.col("contract_id") == "k1", F.lit(float("nan"))), "base_days": F.lit(float("inf"))})
    a = fleet(spark)
    found = quality.integrity_violations(a, c, a.where("asset_id <> 'a'").unionByName(a.where("asset_id = 'b'")), ["7G", "8G"], ["Active", "Idle", "Warm-Stacked", "Cold-Stacked"], ["Firm", "Option", "Contingent"])
    n = {(r.rule, r.detail): r["n"] for r in found.groupBy("rule", "detail").agg(F.count("*").alias("n")).collect()}
    assert n["number", "base_days"] == c.count() and n["number", "value_usd"] == 1
    assert sum(k for (rule, _), k in n.items() if rule == "registry") == 2 and ("asset count", "4") not in n


def test_rewritten_rows_keep_what_the_decision_says_nothing_of(spark):
    c = contracts(spark).withColumns({"note": F.lit("kept"), "award_type": F.lit("amendment"), "source_start_text": F.lit("old"), "input_mode": F.lit("stored-result")})
    replace = GOOD.replace('"contractId":null', '"contractId":"k1"').replace('"valueUsd"', '"awardType":"extension","termText":"a year","valueUsd"')
    out = apply.apply_decisions(fleet(spark), c, documented(validated(spark, [replace, GOOD, '{"vesselId":"a","contractId":"k0","action":"withdraw"}'])))
    rows = {r.contract_id: r for r in out.contracts.where("asset_id = 'a'").collect()}
    k1 = rows.pop("k1")
    assert (k1.note, k1.award_type, k1.term_text, k1.source_start_text, k1.input_mode, k1.derived_usd_per_day) == ("kept", "extension", "a year", None, None, 500000.0)
    assert [r.note for i, r in rows.items() if "-r" in i] == [None]
    assert out.changes.where("contract_id = 'k1'").first().before.award_type == "amendment"


def test_a_new_row_finds_a_free_id_however_many_are_taken(spark):
    d = documented(validated(spark, [GOOD]))
    now = contracts(spark)
    for k in range(11):
        now = spark.createDataFrame(apply.apply_decisions(fleet(spark), now, d).contracts.collect(), apply.apply_decisions(fleet(spark), now, d).contracts.schema)
    ids = [r.contract_id for r in now.where("asset_id = 'a'").collect()]
    assert None not in ids and len(set(ids)) == len(ids) and sum("-r" in i for i in ids) == 11


def test_title_events_of_articles_without_decisions(spark):
    docs = spark.createDataFrame([("j1", "s1", "X", "official-news", None, "u1", "2026-01-01", None), ("j2", "s2", "X", "official-news", "T", "u2", None, "other"), ("j3", "s3", "X", "fleet-report", "R", "u3", None, None)], "job_id string, source_id string, company string, kind string, title string, url string, published_at string, news_category string")
    out = apply.title_events(docs, spark.createDataFrame([("j2",)], "job_id string")).collect()
    assert [(r.job_id, r.title, r.review_status) for r in out] == [("j1", "u1", "acknowledged")] and out[0].event_id.startswith("news-")


def test_pages_however_deep(spark):
    deep = "<div>" * 2000 + "<article class='news'><p>" + "word " * 40 + "</p></article>" + "</div>" * 2000
    chrome = "<header><article>menu text</article></header><main>" + "text " * 40 + "</main>"
    pages = spark.createDataFrame([("a", deep, None), ("b", chrome, None)], "url string, html string, kind string")
    out = {r.url: r for r in documents.extract_articles(pages).collect()}
    assert out["a"].locator == "html:article.news" and out["a"].text == ("word " * 40).strip()
    import hashlib

    assert {r.url: r.legacy_sha256 for r in documents.legacy_hash(pages).collect()}["b"] == hashlib.sha256(("text " * 40).strip().encode()).hexdigest()


def test_titles_of_error_pages():
    assert all(map(documents.is_error_title, ["Access Denied | x", "404", "404 Not found", "Error: x"[:5], "ERROR page", "Just a moment..."]))
    assert not any(map(documents.is_error_title, ["4040 ways", "Errors we made", "The page not found", ""]))


def test_links_with_the_dates_beside_them(spark):
    html = """<ul><li><time datetime="2026-03-05">x</time><a href="/news/detail?ID=7">One</a></li><li>April 2, 2026 <a href="/news/news-details/two">Two</a></li></ul>
    <table><tr><td>01/31/2026</td><td><a href="/FleetStatusReport-Jan.pdf">R</a></td></tr><tr><td>02/28/2026</td><td><a href="/FleetStatusReport-Feb.pdf">R</a></td></tr></table><p><a href="/news/detail">No id</a></p>"""
    pages = spark.createDataFrame([("https://e.com/x", html)], "url string, html string")
    assert {(r.url[13:], r.title, r.published_at) for r in documents.article_links(pages).collect()} == {("/news/detail?ID=7", "One", "2026-03-05"), ("/news/news-details/two", "Two", "2026-04-02")}
    r = documents.latest_report(pages, "FleetStatusReport.*[.]pdf").collect()
    assert [(x.url, x.published_at) for x in r] == [("https://e.com/FleetStatusReport-Feb.pdf", "2026-02-28")]


def test_publishing_overwrites_nothing_that_is_read(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshots.read_manifest(spark, path).count() == 0
    first = snapshots.publish({"assets": fleet(spark)}, path)
    held = snapshots.load_table(spark, path, "assets")
    assert snapshots.publish({"assets": fleet(spark)}, path) == first
    snapshots.publish({"assets": fleet(spark).where("asset_id = 'a'")}, path)
    assert held.count() == 4 and snapshots.load_table(spark, path, "assets").count() == 1
    (tmp_path / "snap" / "_draft.half").write_text("")  # what a publisher that died leaves
    assert snapshots.load_table(spark, path, "assets").count() == 1
    assert snapshots.prune(spark, path) == [first["assets"]["file"]]


def test_an_unchanged_table_is_carried_over(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    first = snapshots.publish({"assets": fleet(spark), "contracts": contracts(spark)}, path)
    held = snapshots.load_table(spark, path, "contracts")
    digested = []
    digest = snapshots.table_digest
    monkeypatch.setattr(snapshots, "table_digest", lambda df: digested.append(df.columns) or digest(df))
    some = fleet(spark).where("asset_id = 'a'")
    second = snapshots.publish({"assets": some, "contracts": held}, path)
    assert digested == [some.columns] and second["contracts"] == first["contracts"] and second["assets"]["rows"] == 1
    assert all(r.ok for r in snapshots.verify(spark, path).collect()) and snapshots.read_manifest(spark, path).count() == 2
    assert snapshots.prune(spark, path) == [first["assets"]["file"]] and snapshots.load_table(spark, path, "contracts").count() == held.count()
    other = str(tmp_path / "other")  # another folder has no such payload, and a changed table is another
    assert snapshots.publish({"contracts": held}, other) == {"contracts": first["contracts"]} and all(r.ok for r in snapshots.verify(spark, other).collect())
    assert snapshots.publish({"contracts": held.limit(1)}, path)["contracts"]["rows"] == 1
    snapshots.prune(spark, path)
    with pytest.raises(Exception):  # the payload is gone: no manifest names it
        snapshots.publish({"contracts": held}, path)
    assert all(r.ok for r in snapshots.verify(spark, path).collect()) and snapshots.load_table(spark, path, "contracts").count() == 1


def test_backlogs(spark):
    from assetspan.operators import jobs as j

    good = spark.createDataFrame([("j1", "k", "X", "u", "0" * 64)], "job_id string, kind string, company string, url string, document_sha256 string")
    bad = spark.createDataFrame([("", "q", None, " ", "x")], good.schema)
    mark = j.backlog_fingerprint(good).first().fingerprint
    assert quality.backlog_violations(good, 2, 1, ["k"], ["X"], mark).count() == 0
    assert sorted(r.rule for r in quality.backlog_violations(bad, 3, 0, ["k"], ["X"], mark).collect()) == sorted(["schema version", "count", "no job id", "no url", "kind", "company", "hash", "fingerprint"])


def test_numbers_within_groups_over_many_ranges(spark):
    import random

    r = random.Random(3)
    items = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, "x", "y"]), i) for i in range(500)]
    df = spark.createDataFrame(items, "g string, k string, i int")
    out = jobs.numbered(df, "g", [F.col("k"), F.col("i")], "n")
    assert out.columns == ["g", "k", "i", "n"]
    expected = {}
    for g in ("a", "b", None):
        for n, x in enumerate(sorted((x for x in items if x[0] == g), key=lambda x: (x[1] is not None, x[1] or "", x[2])), 1):
            expected[x[2]] = n
    assert {x.i: x.n for x in out.collect()} == expected
    assert jobs.numbered(df.limit(0), "g", [F.col("i")], "n").count() == 0


def brute_trend(points):
    """The fit over all observations one by one: tricube over the nearest, bisquare on residuals, in three passes; then the band."""
    x, y = (np.array(v, float) for v in zip(*sorted(points)))
    n = len(x)
    span = max(0.3, min(1.0, 4 / n))
    window, k = max(2, math.floor(span * n)), max(4, math.ceil(span * n))
    robust = np.ones(n)
    for p in range(3):
        fit = np.empty(n)
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[min(window, n) - 1]
            near = d < h if h > 0 else d == 0
            w = ((1 - (d[near] / h) ** 3) ** 3 if h > 0 else np.ones(near.sum())) * robust[near]
            z, s0 = x[near] - x[i], w.sum()
            s1, s2, t0, t1 = (w * z).sum(), (w * z * z).sum(), (w * y[near]).sum(), (w * z * y[near]).sum()
            det = s0 * s2 - s1 * s1
            fit[i] = t0 / s0 if abs(det) <= 1e-9 * max(1.0, s0 * s2) else (s2 * t0 - s1 * t1) / det
        r = y - fit
        s = np.median(np.abs(r))
        if p < 2:
            u = np.abs(r) / (6 * s)
            robust = np.where(u >= 1, 0.0, (1 - u * u) ** 2)
    out = {}
    for i in range(n):
        # observations of one day are alike to the band: their share of the edge is spread over them
        days = sorted(set(x), key=lambda v: (abs(v - x[i]), v))
        left, c, s1, s2 = k, 0.0, 0.0, 0.0
        for v in days:
            rr = r[x == v]
            share = min(1.0, max(0.0, left / len(rr)))
            c, s1, s2, left = c + share * len(rr), s1 + share * rr.sum(), s2 + share * (rr * rr).sum(), left - share * len(rr)
        out[x[i]] = (fit[i], math.sqrt(max(0.0, (s2 - s1 * s1 / c) / (c - 1))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trend_equals_a_fit_over_all_points(spark, seed):
    rng = np.random.default_rng(seed)
    days = rng.integers(0, 60 if seed == 1 else 400, 90)
    points = [(int(d), float(100 + d / 3 + rng.normal() * 8 + (60 if rng.random() < 0.05 else 0))) for d in days]
    expected = brute_trend(points)
    found = {(r.date - D(2026, 1, 1)).days: r for r in trend.rate_trend(series(spark, points)).collect()}
    first = min(found)
    assert len(found) == len(expected)
    for (day, (fit, sd)), (at, r) in zip(sorted(expected.items()), sorted(found.items())):
        assert at - first == day - min(expected)
        assert r.rate == pytest.approx(fit, rel=1e-7) and r.band_hi - r.rate == pytest.approx(sd, rel=1e-6, abs=1e-6)


def test_equal_rates_of_a_day_are_stored_once_and_count_as_often_as_they_stand(spark, monkeypatch):
    real, stored = trend.kept, []
    monkeypatch.setattr(trend, "kept", lambda d: stored.append(real(d)) or stored[-1])
    rng = np.random.default_rng(2)
    distinct = [(int(d), float(100 + d / 3 + round(rng.normal() * 8))) for d in range(0, 400, 9)]
    points = [p for i, p in enumerate(distinct) for _ in range(1 + i % 4)]
    found = sorted(((r.date - D(2026, 1, 1)).days, r) for r in trend.rate_trend(series(spark, points)).collect())
    expected = sorted(brute_trend(points).items())
    assert [s.count() for s in stored] == [len(set(points))] and len(found) == len(expected)
    for (_, (fit, sd)), (_, r) in zip(expected, found):
        assert r.n == len(points) and r.rate == pytest.approx(fit, rel=1e-7) and r.band_hi - r.rate == pytest.approx(sd, rel=1e-6, abs=1e-6)
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 5), ("a", 9.0, 3), ("b", 1.0, 2), ("b", 4.0, 2), ("b", None, 7)], "g string, v double, k long")
    assert {r.g: r["median"] for r in trend.medians(df, "g", "v", "k").collect()} == {"a": 2.0, "b": 2.5}


def test_medians_are_exact(spark):
    rng = np.random.default_rng(0)
    items = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 3, 400)] + [("c", 7.0)] * 6 + [("d", 1.0), ("d", 4.0)] + [("e", 1e9), ("e", 0.0), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(items, "g string, v double")
    found = {r.g: r["median"] for r in trend.medians(df, "g", "v").collect()}
    assert found == {g: pytest.approx(np.median([v for k, v in items if k == g]), rel=1e-12) for g in "abcde"}


def test_feeds_and_captured_files(spark, tmp_path):
    import json

    feed_file = tmp_path / "events.json"
    feed_file.write_text(json.dumps({"generatedAt": "2026-01-01T00:00:00Z", "events": [{"id": "e1", "company": "X", "url": "u", "title": "T", "publishedAt": "2026-01-01", "odd": 1}, {"id": "e2", "pendingReview": True}]}))
    assert [(r.id, r.title, r.pendingReview) for r in snapshots.read_events(spark, str(feed_file)).orderBy("id").collect()] == [("e1", "T", None), ("e2", None, True)]
    for name, data in {"a.html": b" <html><p>\xc3\xa9</p></html>", "b.pdf": b"%PDF-1.4 x", "c.bin": b"\x00\x01"}.items():
        (tmp_path / "landed").mkdir(exist_ok=True)
        (tmp_path / "landed" / name).write_bytes(data)
    found = {r.url.rpartition("/")[2]: r for r in snapshots.read_captures(spark, str(tmp_path / "landed")).collect()}
    assert [(found[k].content_type, found[k].html) for k in sorted(found)] == [("text/html", " <html><p>é</p></html>"), ("application/pdf", None), (None, None)]
    assert bytes(found["b.pdf"].content) == b"%PDF-1.4 x"


def test_responses_are_parsed_once_and_results_ask_for_what_they_need(spark):
    told = validated(spark, [GOOD, '{"vesselId":"a","contractId":"k0","action":"withdraw","row":null}', '{"vesselId":"a","contractId":"none","action":"withdraw"}', "null"])
    assert "parseJson" not in plan_of(told)
    assert [r.hold_reason for r in told.orderBy("index").collect()] == [None, None, "contractId is no contract of the asset", "decision must be an object"]
    documented = told.withColumns({"source_id": F.lit("s"), "document_sha256": F.lit("h"), "kind": F.lit("fleet-report"), "url": F.lit("u"), "published_at": F.lit("2026-01-01")})
    done = apply.apply_decisions(fleet(spark), contracts(spark), documented)
    assert [r.outcome for r in done.outcomes.collect()] == ["held"] and done.changes.count() == 2
    assert "before#" not in plan_of(done.outcomes)


def test_references_without_a_semicolon_are_text():
    body = "<p>" + "word " * 30 + "</p>"
    read = documents.read_page(f"<article><h1>R&amp;D&amp</h1>{body}<p>&lt;b&gt; &notit; &copy=1</p><p>&#39;a&#39;</p></article>", "https://x.example.com/", parts=("article", "legacy"))
    assert read["text"].startswith("R&D&amp word") and read["text"].endswith("<b> &notit; &copy=1 'a'")
    plain = f"R&D&amp {'word ' * 30}<b> &notit; &copy=1 'a'"
    assert read["legacy_sha256"] == documents.hashlib.sha256(plain.encode()).hexdigest()
