"""Streams that carry state, landed captures, commits, levels of documents, hash trees and pages in one pass."""

import datetime as dt
import hashlib
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from assetspan.functions import hashes
from assetspan.operators import apply, documents
from assetspan.sources import captures as landed
from assetspan.sources import commits
from assetspan.streaming import state, streams

UTC = dt.UTC
RULES = (["7G"], ["Active", "Idle"], ["Firm", "Option"])


def drain(stream, write, checkpoint):
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# --- landed captures


def test_captures_land_whole_or_not_at_all(spark, tmp_path):
    path, at = str(tmp_path / "landed"), dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    rows = [("https://e.com/a", "https://e.com/b", "text/html", at, b" \n<p>\xc3\xa9</p>"), ("https://e.com/n", None, None, None, None)]
    schema = "url string, final_url string, content_type string, captured_at timestamp, content binary"
    landed.land(spark.createDataFrame(rows[1:], schema), path, 1)
    landed.land(spark.createDataFrame(rows, schema).repartition(2), path, 1)  # the same batch once more
    (tmp_path / "landed" / "batch=000000000001" / "left.bodies").write_bytes(b"what a task that failed has left")
    (tmp_path / "landed" / "batch=000000000002").mkdir()  # a batch that is not done
    got = sorted(landed.read_captures(spark, path).collect(), key=lambda r: r.url)
    assert [(r.url, r.final_url, r.batch, r.html, r.reject_reason) for r in got] == [("https://e.com/a", "https://e.com/b", 1, " \n<p>é</p>", None), ("https://e.com/n", None, 1, None, "document is empty")]
    assert got[0].captured_at.timestamp() == at.timestamp() and bytes(got[0].content) == rows[0][4]
    assert landed.read_captures(spark, path, 2).count() == 0 and landed.read_captures(spark, str(tmp_path / "none")).count() == 0
    shard = next(p for p in (tmp_path / "landed" / "batch=000000000001").glob("*.bodies") if p.read_bytes().startswith(b" \n<p>"))
    shard.write_bytes(b"x" * len(rows[0][4]))
    with pytest.raises(Exception, match="damaged"):
        landed.read_captures(spark, path).collect()


def test_kinds_of_captures(spark):
    cases = {
        b"%PDF-1.7 x": ("text/html", "application/pdf", None), b" \n%PDF-1.7": (None, "application/pdf", None), b"<html>": ("application/pdf", None, "PDF response did not contain a PDF document"),
        b"<html>x": (None, "text/html", None), b"plain": ("text/HTML; charset=x", "text/html", None), b"plain.": ("text/plain", None, "document format is neither PDF nor HTML"), b"": ("text/html", None, "document is empty"), b"<p>\xe9": ("text/html", "text/html", None),
    }
    c = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "content binary, content_type string")
    got = {bytes(r.content): r for r in landed.opened(c).collect()}
    assert {k: (r.content_type, r.media, r.reject_reason) for k, r in got.items()} == cases
    assert got[b"<p>\xe9"].html == "<p>é" and got[b"plain."].html is None


def test_streams_land_and_are_read_from_an_offset(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "landed")
    schema = "url string, final_url string, content_type string, captured_at timestamp, content binary, batch long"
    landed.register(spark)
    for k in range(3):
        spark.createDataFrame([(f"u{k}{i}", None, "text/html", None, b"<p>" + bytes([65 + i]), 0) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(src)
        spark.readStream.schema(schema).parquet(src).writeStream.format(landed.FORMAT).option("path", path).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.url, r.batch) for r in landed.read_captures(spark, path).collect()} == {(f"u{k}{i}", k + 1) for k in range(3) for i in range(3)}
    seen = []
    for _ in range(2):
        drain(landed.stream_captures(spark, path, 2).select("url"), lambda df, n: seen.extend((n, r.url) for r in df.collect()), str(tmp_path / "cp2"))
    assert sorted(u for _, u in seen) == [f"u{k}{i}" for k in (1, 2) for i in range(3)]


# --- commits


def test_a_number_is_put_once_however_many_try(spark, tmp_path):
    path, won = str(tmp_path / "log"), []
    tries = [threading.Thread(target=lambda k=k: won.append((k, commits.put_text(spark, f"{path}/x.json", str(k))))) for k in range(6)]
    for t in tries:
        t.start()
    for t in tries:
        t.join()
    winner, = [k for k, ok in won if ok]
    assert (tmp_path / "log" / "x.json").read_text() == str(winner) and [p.name for p in (tmp_path / "log").iterdir()] == ["x.json"]
    assert [commits.commit(spark, path, "n", "{}") for _ in range(3)] == [1, 2, 3] and commits.latest(spark, path, "n") == (3, {}) and commits.latest(spark, path, "m") == (0, None)
    assert commits._move(spark, f"{path}/x.json", f"{path}/n.000000000001.json") is False  # the way of other stores


# --- latest revision


def test_late_revisions_emit_nothing_and_sources_expire(spark, tmp_path):
    schema, src, got = "source_id string, document_sha256 string, captured_at timestamp", str(tmp_path / "in"), []
    day = lambda n: dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(days=n)
    parts = [[("a", "h2", day(5)), ("a", "h1", day(4.5))], [("a", "h2", day(5)), ("a", "h0", day(4.9))], [("b", "x", day(60))], [("a", "h3", day(6)), ("b", "y", day(59.5))], [("a", "h4", day(60)), ("c", "z", day(60))], [("a", "h5", day(60))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        s = streams.latest_revision(spark.readStream.schema(schema).parquet(src))
        drain(s, lambda df, n, k=k: got.extend((k, r.source_id, r.document_sha256) for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(got) == [(0, "a", "h2"), (2, "b", "x"), (4, "a", "h4"), (4, "c", "z"), (5, "a", "h5")]


# --- decisions in a stream


def answer(job, items, company="X", day="2026-01-01"):
    payload = items if isinstance(items, str) else json.dumps({"reportDate": None, "vesselUpdates": [], "decisions": items})
    return (job, company, payload, f"source-{job}", hashlib.sha256(job.encode()).hexdigest(), "official-news", "https://e.com", day)


ANSWER = "job_id string, company string, payload string, source_id string, document_sha256 string, kind string, url string, published_at string"


def upsert(asset, rate, contract=None):
    row = {"startDate": "2026-01-01", "endDate": "2026-02-01", "dayRate": rate, "client": "C", "region": "R", "status": "Firm"}
    return {"vesselId": asset, "contractId": contract, "action": "upsert", "row": row, "reasonKo": "r", "quote": "q", "locator": "l"}


def test_decisions_advance_the_state_once(spark, tmp_path, monkeypatch):
    path, src, cp = (str(tmp_path / x) for x in ("state", "in", "cp"))
    a = spark.createDataFrame([("a", "A", "X", "7G", "Active", None, 2010), ("b", "B", "X", "7G", "Active", None, 2010)], "asset_id string, name string, company string, generation string, status string, status_as_of date, year_built int")
    c = spark.createDataFrame([("k0", "a", dt.date(2026, 1, 1), dt.date(2026, 2, 1), 1.0, "C", "R", "Firm", None, None)], "contract_id string, asset_id string, start_date date, end_date date, day_rate double, client string, region string, status string, value_usd double, base_days double")
    assert state.start(spark, path, {"assets": a, "contracts": c}) == 1 and state.start(spark, path, {"assets": a.limit(0)}) == 1
    run = lambda cp=cp: streams.decision_stream(spark.readStream.schema(ANSWER).parquet(src), path, cp, a, *RULES).awaitTermination()
    put = lambda *rows: spark.createDataFrame(rows, ANSWER).coalesce(1).write.mode("append").parquet(src)
    rates = lambda: sorted((r.contract_id if r.contract_id == "k0" else "new", r.asset_id, r.day_rate) for r in state.read(spark, path, commits.latest(spark, path, state.NAME)[1])["contracts"].collect())
    put(answer("j1", [upsert("a", 2, "k0")]), answer("j1", [upsert("a", 9, "k0")]), answer("j2", [upsert("a", 3, "k0")], day="2026-01-02"), answer("j3", [upsert("b", 0.5)]), answer("j4", "no JSON"))
    real, broken = commits.put_text, [True]

    def put_text(spark, path, text):
        if broken and broken.pop():
            raise RuntimeError("before the commit")
        return real(spark, path, text)

    monkeypatch.setattr(commits, "put_text", put_text)
    with pytest.raises(Exception, match="before the commit"):
        run()
    assert rates() == [("k0", "a", 1.0)] and state.history(spark, path, "outcomes").count() == 0  # what is written but not committed counts for nothing
    run()
    assert rates() == [("k0", "a", 3.0), ("new", "b", 0.5)] and commits.latest(spark, path, state.NAME)[0] == 2
    put(answer("j1", [upsert("a", 7, "k0")]), answer("j4", "no JSON"))
    run()
    assert commits.latest(spark, path, state.NAME)[0] == 2  # answered before, and failed before by the same words
    put(answer("j4", [upsert("b", 4)]))
    run()
    run(cp + "2")
    assert rates() == [("k0", "a", 3.0), ("new", "b", 0.5), ("new", "b", 4.0)] and commits.latest(spark, path, state.NAME)[0] == 3
    out = sorted((r.version, r.job_id, r.outcome) for r in state.history(spark, path, "outcomes").collect())
    assert out == [(2, "j1", "applied"), (2, "j2", "applied"), (2, "j3", "applied"), (2, "j4", "failed"), (3, "j4", "applied")]


def test_a_failed_document_goes_without_applying_the_others_twice(spark, monkeypatch):
    from assetspan.operators import decisions, quality

    real, calls, left = apply.apply_decisions, [], []
    monkeypatch.setattr(apply, "apply_decisions", lambda *of: calls.append(1) or real(*of))
    monkeypatch.setattr(apply, "freed", lambda *of: left.extend(of))
    a = spark.createDataFrame([(i, i, "X", "7G", "Active", None, 2010) for i in "ab"], "asset_id string, name string, company string, generation string, status string, status_as_of date, year_built int")
    day = dt.date(2026, 1, 1)
    c = spark.createDataFrame([(f"k{i}", i, day, day, 1.0, "C", "R", "Firm", None, None) for i in "ab"], "contract_id string, asset_id string, start_date date, end_date date, day_rate double, client string, region string, status string, value_usd double, base_days double")
    check = lambda x, y: quality.integrity_violations(x, y, a, *RULES).unionByName(y.where("day_rate = 9").select(F.lit("nine").alias("rule"), "asset_id", "contract_id", F.lit("").alias("detail")))
    told = decisions.validate_decisions(spark.createDataFrame([answer("j1", [upsert("a", 9, "ka")]), answer("j2", [upsert("b", 2, "kb")])], ANSWER), a, c, RULES[2])
    given = told.join(spark.createDataFrame([(f"j{i}", i, "s", "d", "official-news", "u", "2026-01-01") for i in (1, 2)], "job_id string, round int, source_id string, document_sha256 string, kind string, url string, published_at string"), "job_id")
    done = apply.apply_rounds(a, c, given, check)
    assert calls == [1] and not left  # one round for two documents that share no asset: one way through, and nothing copied on the way
    assert sorted((r.contract_id, r.day_rate) for r in done.contracts.collect()) == [("ka", 1.0), ("kb", 2.0)]
    assert sorted(tuple(r) for r in done.outcomes.collect()) == [("j1", "failed"), ("j2", "applied")] and [r.job_id for r in done.changes.collect()] == ["j2"] == [r.job_id for r in done.events.collect()]


def test_documents_that_cannot_mend_their_company_fail_without_a_round_of_their_own(spark, monkeypatch):
    from assetspan.operators import decisions, quality

    real, calls = apply.apply_decisions, []
    monkeypatch.setattr(apply, "apply_decisions", lambda *of: calls.append(1) or real(*of))
    a = spark.createDataFrame([(i, i, co, "7G", "Active", None, 2010) for i, co in (("a", "X"), ("b", "X"), ("c", "Y"))], "asset_id string, name string, company string, generation string, status string, status_as_of date, year_built int")
    day = dt.date(2026, 1, 1)
    c = spark.createDataFrame([(f"k{i}", i, day, day, 1.0, "C", "" if i in "ab" else "R", "Firm", None, None) for i in "abc"], "contract_id string, asset_id string, start_date date, end_date date, day_rate double, client string, region string, status string, value_usd double, base_days double")
    check = lambda x, y: quality.integrity_violations(x, y, a, *RULES)  # noqa: E731  the regions of ka and kb are blank

    def run(*docs):
        told = decisions.validate_decisions(spark.createDataFrame([answer(f"j{i}", of, co) for i, (co, of) in enumerate(docs)], ANSWER), a, c, RULES[2])
        given = told.join(spark.createDataFrame([(f"j{i}", i, "s", "d", "official-news", "u", "2026-01-01") for i in range(len(docs))], "job_id string, round int, source_id string, document_sha256 string, kind string, url string, published_at string"), "job_id")
        calls.clear()
        done = apply.apply_rounds(a, c, given, check)
        changed = sorted((r.job_id, r.after.day_rate, r.before.day_rate) for r in done.changes.collect())
        return len(calls), {r.job_id: r.outcome for r in done.outcomes.collect()}, {r.contract_id: r.day_rate for r in done.contracts.collect()}, changed

    one = lambda i, rate: upsert(i, rate, f"k{i}")
    n, out, rates, changed = run(("X", [one("a", 2)]), ("X", [one("b", 3)]), ("Y", [one("c", 4)]), ("X", [one("a", 5)]))
    assert n == 1 and out == {"j0": "failed", "j1": "failed", "j2": "applied", "j3": "failed"} and rates == {"ka": 1, "kb": 1, "kc": 4} and changed == [("j2", 4, 1)]
    n, out, rates, changed = run(("X", [one("a", 2)]), ("X", [one("a", 3), one("b", 3)]), ("X", [one("b", 4)]), ("Y", [one("c", 5)]))
    assert n == 2 and out == {"j0": "failed", "j1": "applied", "j2": "applied", "j3": "applied"}  # the second mends both, and the third finds its company whole
    assert rates == {"ka": 3, "kb": 4, "kc": 5} and changed == [("j1", 3, 1), ("j1", 3, 1), ("j2", 4, 3), ("j3", 5, 1)]


def test_levels_keep_the_order_of_documents_that_share_an_asset(spark):
    rng = random.Random(4)
    docs = {f"j{i:02}": (i % 3, [rng.choice("abcdefgh") + str(i % 3) for _ in range(rng.randrange(4))]) for i in range(40)}
    alone = {2}
    want, last = {}, {}
    for i, (job, (company, names)) in enumerate(docs.items()):
        keys = [*names, *([f"company {company}"] if company in alone else [])]
        want[job] = 1 + max((last.get(k, 0) for k in keys), default=0)
        last.update(dict.fromkeys(keys, want[job]))
    rows = [(j, str(c), i, n) for i, (j, (c, names)) in enumerate(docs.items()) for n in names or [None]]
    items = spark.createDataFrame(rows, "job_id string, company string, round int, asset_id string")
    got = {r.job_id: r.level for r in apply.levels(items, spark.createDataFrame([("2",)], "company string")).collect()}
    assert got == want and apply.levels(items.limit(0), spark.createDataFrame([], "company string")).count() == 0


# --- fleet files

def test_fleet_files_may_be_compressed_and_contracts_carry_what_their_asset_has(spark, tmp_path):
    from assetspan.sources import snapshots

    day = dt.date(2026, 1, 1)
    a = spark.createDataFrame([(i, f"name {i}", "X", "7G", "Active", None, 2010) for i in "ab"], "asset_id string, name string, company string, generation string, status string, status_as_of date, year_built int")
    c = spark.createDataFrame([("k1", "a", day, day, 1.0, "C", "R", "Firm"), ("k2", "a", day, day, 2.0, "C", "R", "Firm")], "contract_id string, asset_id string, start_date date, end_date date, day_rate double, client string, region string, status string")
    snapshots.export_fleet(snapshots.nest(a, c), str(tmp_path / "fleet"), "gzip")
    assert {p.suffix for p in (tmp_path / "fleet").glob("part-*")} == {".gz"}
    assets, found = snapshots.flatten(snapshots.import_fleet(spark, str(tmp_path / "fleet")), ("name",))
    assert sorted(tuple(r) for r in found.select("contract_id", "asset_id", "day_rate", "name").collect()) == [("k1", "a", 1.0, "name a"), ("k2", "a", 2.0, "name a")] and assets.count() == 2
    assert "name" not in snapshots.flatten(snapshots.import_fleet(spark, str(tmp_path / "fleet")))[1].columns


# --- hash trees


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9, 10, 40])
def test_hash_tree(spark, monkeypatch, n):
    monkeypatch.setattr(hashes, "FAN", 3)
    level = [hashlib.sha256(f"leaf {i}".encode()).hexdigest() for i in range(n)]
    while True:
        level = [hashlib.sha256("".join(level[k : k + 3]).encode()).hexdigest() for k in range(0, len(level), 3)]
        if len(level) <= 1:
            break
    leaves = spark.createDataFrame([(i, f"leaf {i}") for i in random.sample(range(n), n)], "n long, leaf string")
    assert tuple(hashes.tree_digest(leaves).first()) == (n, level[0] if level else hashlib.sha256(b"").hexdigest())


# --- pages


def test_pages_are_read_in_one_pass():
    page = lambda n: "<html><body><article>" + "".join(f"<p>Text {i} <a href='/news/news-details/{i}'>Title {i}</a></p>" for i in range(n)) + "January 5, 2026</article></body></html>"
    took = []
    for n in (2000, 20000):
        start = time.process_time()
        links = documents.read_page(page(n), "https://e.com/")["links"]
        took.append(time.process_time() - start)
        assert len(links) == n and links[-1]["dates_raw"] == ["January 5, 2026"] and links[7]["title"] == "Title 7"
    assert took[1] < 30 * took[0] + 1
    deep = "<li>" * 3000 + "".join(f"<a href='/{i}'>T</a> March {i % 28 + 1}, 2026</li>" for i in range(3000))
    assert len(documents.read_page(deep, "https://e.com/")["links"]) == 3000


def test_dates_beside_links():
    read = lambda h: [x["dates_raw"] for x in documents.read_page(h, "https://e.com/")["links"]]
    assert read('<li><time>3 days ago</time> <a href="/x">t</a> January 5, 2026</li>') == [["3 days ago", "January 5, 2026"]]
    assert read('<li>Report 12, 2025 <a href="/x">t</a> January\n 5, 2026</li>') == [["January 5, 2026"]]
    assert read('<li>01/02/2026</li><li><a href="/x">t</a></li><li>May 1, 2026</li>') == [[]]
    assert read('<p>May 1, 2026 <span><a href="/x">t</a></span></p>') == [[]] and read('<p>May 1, 2026 <a href="/x">t</a></p>') == [["May 1, 2026"]]
    assert read('<tr><td><time datetime="2026-01-01">x</time></td><td><a href="/x">t</a></td></tr>') == [["2026-01-01"]]
    assert read('<li><script>May 1, 2026</script><a href="/x">t</a> May <b>2</b>, 2026</li>') == [["May 2, 2026"]]


# --- periods that overlap


def test_overlapping_pairs_meet_once_however_many_a_key_has(spark):
    from assetspan.operators import intervals

    rng, first = random.Random(6), dt.date(2020, 1, 1)
    rows = []
    for i in range(160):
        start = rng.randrange(400)
        rows.append((rng.choice(["a", "b", None]) if i > 100 else "hot", i, first + dt.timedelta(start), first + dt.timedelta(start + rng.choice([0, 3, 40, 40, 900]) - (i == 7)), i % 3 == 0))
    schema = "key string, n int, start_date date, end_date date, marked boolean"
    such = lambda x, y: F.col(f"{x}.marked") | F.col(f"{y}.marked")
    shared = lambda x, y: (min(x[3], y[3]) - max(x[2], y[2])).days > 31 and x[2] <= x[3] and y[2] <= y[3]
    for ask, size in ((None, 512), (None, 7), (such, 7)):
        want = sorted(tuple(sorted((x[1], y[1]))) for k, x in enumerate(rows) for y in rows[:k] if x[0] is not None and x[0] == y[0] and shared(x, y) and (ask is None or x[4] or y[4]))
        got = intervals.overlapping_pairs(spark.createDataFrame(rows, schema), ["key"], ["n"], 31, ask, size).select("earlier.n", F.col("later.n").alias("m"), (F.col("earlier.start_date") <= F.col("later.start_date")).alias("ok")).collect()
        assert sorted(tuple(sorted((r.n, r.m))) for r in got) == want and all(r.ok for r in got) and len(want) > 50
    assert intervals.overlapping_pairs(spark.createDataFrame(rows, schema).limit(0), ["key"], ["n"], 31).count() == 0


def test_publishers_share_payloads_and_each_is_digested_once(spark, tmp_path, monkeypatch):
    from assetspan import queries_streams as q

    one = lambda kind: spark.range(4).select(F.col("id").cast("string").alias("asset_id"), F.when(F.col("id") == 0, "C3").otherwise("C0").alias("company"), F.lit(kind).alias("kind"))
    monkeypatch.setattr(q, "assets", lambda *_: one("asset"))
    monkeypatch.setattr(q, "contracts", lambda *_: one("contract"))
    digested = []
    digest = q.hashes.table_digest
    monkeypatch.setattr(q.hashes, "table_digest", lambda df: digested.append(1) or digest(df))
    rows = sorted(tuple(r) for r in q.concurrent_publishers(spark, str(tmp_path)).collect())
    assert rows == [("pruned", 1, 0, True), ("seed", 1, 0, True), ("version", 3, 4, True), ("version", 4, 4, True)]
    assert len(digested) == 3  # two tables of assets, and the contracts that both versions name
