"""Registered queries of landed captures, of streams that carry state, of concurrent publishers, of pages of every kind and of hash trees; they extend
those of assetspan.queries."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.functions import hashes
from assetspan.operators import apply, decisions, documents, feed, jobs, market, observations, quality, trend
from assetspan.plans.model import ASSET_STATES, COMPANIES, CONTRACT_STATES, GENERATIONS, assets, contracts, periods, table
from assetspan.queries import query
from assetspan.queries_documents import DECISIONS, FEED, JOURNAL, _documented, announcements, journal, responses
from assetspan.queries_records import _folder
from assetspan.session import cut, kept
from assetspan.sources import captures as landed
from assetspan.sources import commits, snapshots
from assetspan.streaming import state, streams


def _fetched(spark, sf) -> DataFrame:
    """Pages as they might be fetched: one in five is HTML, a PDF document, a page that is said to be a PDF, plain text, or empty."""
    p, k = table(spark, sf, "pages"), F.col("page_id") % 5
    content = F.when(k == 1, F.concat(F.lit("\n%PDF-1.7 "), "html")).when(k == 3, F.concat(F.lit("page "), "html")).when(k == 4, "").otherwise(F.col("html"))
    kind = F.when(k.isin(1, 2), "application/PDF").when(k == 3, "text/plain").otherwise("text/html; charset=utf-8")
    return p.select("page_id", "url", content.cast("binary").alias("content"), kind.alias("content_type"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("captured_at"))


_FETCHED = """WITH f AS (SELECT page_id, url, page_id % 5 AS k, CASE page_id % 5 WHEN 1 THEN chr(10) || '%PDF-1.7 ' || html WHEN 3 THEN 'page ' || html WHEN 4 THEN '' ELSE html END AS body FROM pages)"""


@query(_FETCHED + """ SELECT url, page_id % 2 + 1 AS batch, CAST(1700000000 + page_id AS BIGINT) AS at, CASE k WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' END AS media, CAST(strlen(body) AS BIGINT) AS bytes,
 CASE k WHEN 2 THEN 'PDF response did not contain a PDF document' WHEN 3 THEN 'document format is neither PDF nor HTML' WHEN 4 THEN 'document is empty' END AS reject_reason, CASE k WHEN 0 THEN sha256(body) END AS html_sha256 FROM f""", plain=True)
def landed_captures(spark, sf):
    """Pages landed in two batches and read with what was said of them."""
    path, f = _folder(spark), _fetched(spark, sf)
    for batch in (1, 2):
        landed.land(f.where(F.col("page_id") % 2 == batch - 1), path, batch)
    c = landed.read_captures(spark, path)
    return c.select("url", "batch", F.unix_timestamp("captured_at").alias("at"), "media", F.octet_length("content").cast("long").alias("bytes"), "reject_reason", F.sha2("html", 256).alias("html_sha256"))


@query("""SELECT page_id % 3 + 1 AS batch, count(*) AS captures, 1 AS runs FROM pages WHERE page_id % 3 > 0 GROUP BY 1""", plain=True)
def replayed_captures(spark, sf):
    """A stream that begins at the second of three batches, of which the third lands when it has stopped: each batch is read once, whole."""
    path, f = _folder(spark), _fetched(spark, sf)
    for batches in ((1, 2), (3,)):
        for batch in batches:
            landed.land(f.where(F.col("page_id") % 3 == batch - 1), path, batch)
        s = landed.stream_captures(spark, path, 2).select("url", "batch")
        write = lambda df, n: df.withColumn("run", F.lit(n)).write.mode("append").parquet(f"{path}/read")
        s.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/read").groupBy("batch").agg(F.count("*").alias("captures"), F.countDistinct("run").cast("int").alias("runs"))


@query("""WITH d AS (SELECT doc_id // 4 AS s, doc_id % 4 AS k, sha256(coalesce(text, '')) AS sha FROM documents)
SELECT 'source-' || CAST(s AS VARCHAR) AS source_id, CAST(count(*) FILTER (k IN (1, 3)) + CASE WHEN count(*) FILTER (k = 1) = 0 THEN count(*) FILTER (k = 0) ELSE 0 END AS BIGINT) AS emitted, arg_max(sha, k) FILTER (k <> 2) AS document_sha256
FROM d WHERE k <> 2 GROUP BY s""", plain=True)
def latest_revision(spark, sf):
    """Each source's second document, then its first, which comes late, then its fourth, twice: a row for every revision that was newer than all before."""
    path, k = _folder(spark), F.col("doc_id") % 4
    d = table(spark, sf, "documents").select(k.alias("k"), F.concat(F.lit("source-"), F.floor(F.col("doc_id") / 4).cast("string")).alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_sha256"))
    d = cut(d.withColumn("captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k"))))
    for n in (1, 0, 3, 3):
        d.where(F.col("k") == n).drop("k").coalesce(1).write.mode("append").parquet(f"{path}/in")
        s = streams.latest_revision(spark.readStream.schema(d.drop("k").schema).parquet(f"{path}/in"))
        write = lambda df, n: df.write.mode("append").parquet(f"{path}/out")
        s.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("source_id").agg(F.count("*").alias("emitted"), F.max_by("document_sha256", "captured_at").alias("document_sha256"))


def _streamed(spark, sf) -> str:
    """A state to which the responses have been streamed: those of assets with an even number in one batch, the others in the next, and then all again."""
    path, a = _folder(spark), assets(spark, sf)
    state.start(spark, path, {"assets": a, "contracts": contracts(spark, sf).withColumns({"source_url": F.lit(None).cast("string"), "source_published_at": F.lit(None).cast("string"), "news_reviewed": F.lit(None).cast("boolean")})})
    given = kept(_documented(responses(spark, sf)))
    for k in range(2):
        given.where(F.substring("job_id", 5, 99).cast("long") % 2 == k).write.mode("append").parquet(f"{path}/in")
        s = spark.readStream.schema(given.schema).parquet(f"{path}/in")
        streams.decision_stream(s, path, f"{path}/checkpoint", a, GENERATIONS, ASSET_STATES, CONTRACT_STATES).awaitTermination()
    s = spark.readStream.schema(given.schema).parquet(f"{path}/in")
    streams.decision_stream(s, path, f"{path}/checkpoint again", a, GENERATIONS, ASSET_STATES, CONTRACT_STATES).awaitTermination()
    return path


@query(""" SELECT contract_id, asset_id, CASE WHEN status = 'Firm' AND day_rate > 0 AND client <> 'Undisclosed' THEN 'https://reports.example.com/' END AS source_url, day_rate, status FROM contracts""")
def streamed_contracts(spark, sf):
    path = _streamed(spark, sf)
    return state.read(spark, path, commits.latest(spark, path, state.NAME)[1])["contracts"].select("contract_id", "asset_id", "source_url", "day_rate", "status")


@query(DECISIONS + """ SELECT job_id, CASE WHEN bool_or(hold_reason IS NOT NULL) THEN 'held' ELSE 'applied' END AS outcome, 2 + CAST(asset_id AS BIGINT) % 2 AS version, count(*) AS events,
 count(*) FILTER (hold_reason IS NULL AND action = 'upsert') + 1 AS changes FROM decided GROUP BY job_id, asset_id""")
def decision_stream(spark, sf):
    """What each job came to, in which version, with the events and changes that it left there."""
    path = _streamed(spark, sf)
    count = lambda name: state.history(spark, path, name).groupBy("job_id", "version").agg(F.count("*").alias(name))
    out = state.history(spark, path, "outcomes").select("job_id", "outcome", "version")
    return out.join(count("events"), ["job_id", "version"], "left").join(count("changes"), ["job_id", "version"], "left").select("job_id", "outcome", "version", "events", "changes")


@query(""" SELECT 'version' AS kind, n.n AS assets, (SELECT count(*) FROM contracts) AS contracts, true AS ok FROM (SELECT count(*) AS n FROM assets UNION ALL SELECT count(*) FROM assets WHERE company <> 'C3') AS n
 UNION ALL SELECT 'seed', (SELECT count(*) FROM assets WHERE company = 'C3'), 0, true UNION ALL SELECT 'pruned', 1, 0, true""")
def concurrent_publishers(spark, sf):
    """Two publishers at once: each gets a number and a complete version; then what load_snapshot gives if the rows are not those expected, and how many
    payloads prune() takes away."""
    path, a, c = _folder(spark), kept(assets(spark, sf)), kept(contracts(spark, sf))
    both = [{"assets": a, "contracts": c}, {"assets": a.where("company <> 'C3'"), "contracts": c}]
    threads = [threading.Thread(target=snapshots.publish, args=(t, path)) for t in both]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    versions = [{r["name"]: r for r in snapshots.read_manifest(spark, path, n).collect()} for n in commits.numbers(spark, path, "manifest")]  # two rows each
    files = {r["file"] for of in versions for r in of.values()}  # versions share payloads
    found = {file: hashes.table_digest(spark.read.parquet(f"{path}/{file}")).first() for file in files}
    told = lambda r: (r["rows"], r["digest"])
    rows = [("version", of["assets"]["rows"], of["contracts"]["rows"], all(told(found[r["file"]]) == told(r) for r in of.values())) for of in versions]
    seed = {"assets": a.where("company = 'C3'")}
    rows.append(("seed", snapshots.load_snapshot(spark, path, seed, {"assets": -1})["assets"].count(), 0, True))
    rows.append(("pruned", len(snapshots.prune(spark, path)), 0, True))
    return spark.createDataFrame(rows, "kind string, assets long, contracts long, ok boolean")


def _dated(spark, sf) -> DataFrame:
    """Pages with a date in their metadata, in each place where one may stand, after a value that is none."""
    p, k = table(spark, sf, "pages"), F.col("page_id") % 6
    day = F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0")
    said = (
        F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="2026-03-'), day, F.lit('T10:00:00Z">')))
        .when(k == 1, F.concat(F.lit('<meta name="date" content="soon"><time datetime="2026-04-'), day, F.lit('">then</time>')))
        .when(k == 2, F.concat(F.lit('<meta itemprop="datePublished" content="05/'), day, F.lit('/2026">')))
        .when(k == 3, F.concat(F.lit('<div class="x news-date"> June <b>'), F.col("page_id") % 28 + 1, F.lit("</b>, 2026</div>")))
        .when(k == 4, F.concat(F.lit('<span class="module_date-time">07/'), day, F.lit("/2026 08:30:00</span>")))
        .otherwise("")
    )
    return p.select(F.concat(F.lit("https://pages.example.com/"), F.col("page_id").cast("string")).alias("url"), F.concat(said, "html").alias("html"))


@query("""SELECT 'https://pages.example.com/' || CAST(page_id AS VARCHAR) AS url, CASE page_id % 6 WHEN 0 THEN '2026-03-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || 'T10:00:00+00:00' WHEN 5 THEN NULL
 ELSE '2026-0' || CAST(page_id % 6 + 3 AS VARCHAR) || '-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') END AS published_at FROM pages""", plain=True)
def publication_metadata(spark, sf):
    return documents.publication_metadata(_dated(spark, sf))


@query("""WITH p AS (SELECT page_id AS i, 'https://pages.example.com/' || CAST(page_id AS VARCHAR) AS page_url, CAST(1 + page_id % 28 AS VARCHAR) AS d FROM pages)
SELECT page_url, 'https://pages.example.com/news/news-details/' || CAST(i AS VARCHAR) AS url, 'One' AS title, '2026-01-' || lpad(d, 2, '0') AS published_at FROM p
UNION ALL SELECT page_url, 'https://pages.example.com/News/Detail?x=1&ID=' || CAST(i AS VARCHAR), 'Two', '2026-02-' || lpad(d, 2, '0') FROM p
UNION ALL SELECT page_url, 'https://pages.example.com/news-releases/news-release-details/' || CAST(i AS VARCHAR), 'Three', NULL FROM p""", plain=True)
def article_links(spark, sf):
    """Links to articles among others, some twice, with dates in words, in figures and in elements that hold none."""
    i, d = F.col("page_id").cast("string"), (1 + F.col("page_id") % 28).cast("string")
    parts = [
        '<ul><li><time>3 days ago</time> <a href="/news/news-details/', i, '"> One\n</a> Report 12, 2025, January ', d, ', 2026</li><li><a href="/news/news-details/', i, '">Again</a> 03/03/2026</li>',
        '<li>Report 12, 2025 <a href="/News/Detail?x=1&amp;ID=', i, '"><b>T</b>wo</a> 02/', F.lpad(d, 2, "0"), '/2026 and 02/28/2026</li><li><a href="/news/detail?ID=">None</a></li></ul>',
        '<p><a href="/news-releases/news-release-details/', i, '">Three</a></p><div>April 4, 2026</div><a href="/news/other/', i, '">Other</a>',
    ]
    html = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), "html")
    return documents.article_links(table(spark, sf, "pages").select(F.concat(F.lit("https://pages.example.com/"), i).alias("url"), html.alias("html")))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'error page' WHEN 1 THEN 'article body is missing' WHEN 2 THEN 'document is empty' WHEN 3 THEN 'body is unexpectedly short' END AS reject_reason,
 CASE page_id % 6 WHEN 4 THEN 'html:article.news' WHEN 5 THEN 'html:body' END AS locator, CASE WHEN page_id % 6 > 3 THEN repeat('word ', 30) || CAST(page_id AS VARCHAR) END AS text FROM pages""", plain=True)
def rejected_pages(spark, sf):
    """Pages for each reason to take none, an article that stands after another, and a report that has no article."""
    p, k, i = table(spark, sf, "pages"), F.col("page_id") % 6, F.col("page_id").cast("string")
    body = F.concat(F.lit("<p>" + "word " * 30), i, F.lit("</p>"))
    title = F.array(*map(F.lit, ["404 Not found", "Access Denied: why", "ERROR", "Just a moment..."]))
    html = (
        F.when(k == 0, F.concat(F.lit("<title>"), F.element_at(title, (F.floor(F.col("page_id") / 6) % 4 + 1).cast("int")), F.lit("</title>"), "html"))
        .when(k == 1, F.concat(F.lit("<title>Errors of 404</title><div>"), body, F.lit("</div>")))
        .when(k == 2, "").when(k == 3, F.concat(F.lit("<article><h1>"), body, F.lit("</h1>short</article>")))
        .when(k == 4, F.concat(F.lit("<article>other</article><article class='x news'>"), body, F.lit("<script>no</script></article>")))
        .otherwise(F.concat(F.lit("<body>"), body, F.lit("</body>")))
    )
    kind = F.when(k == 5, "fleet-report").otherwise("official-news")
    read = documents.extract_articles(p.select(i.alias("url"), html.alias("html"), kind.alias("kind")))
    return read.select(F.col("url").cast("long").alias("page_id"), "reject_reason", "locator", "text")


_LEAF = """'{"jobId":"' || job_id || '","kind":"' || kind || '","company":"' || company || '","url":"' || url || '","documentSha256":"' || document_sha256 || '"}'"""
_TREE = f"""leaves AS (SELECT row_number() OVER (ORDER BY job_id) - 1 AS n, sha256({_LEAF}) AS h FROM backlog),
 l1 AS (SELECT n // 1024 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM leaves GROUP BY n // 1024), l2 AS (SELECT n // 1024 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM l1 GROUP BY n // 1024),
 l3 AS (SELECT n // 1024 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM l2 GROUP BY n // 1024)"""
_ROOT = "CASE WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT max(h) FROM l1) WHEN (SELECT count(*) FROM l2) = 1 THEN (SELECT max(h) FROM l2) ELSE (SELECT max(h) FROM l3) END"


@query(f"WITH {JOURNAL}, backlog AS (SELECT * FROM journal WHERE status <> 'completed'), {_TREE} SELECT (SELECT count(*) FROM backlog) AS pending, {_ROOT} AS fingerprint", plain=True)
def backlog_tree(spark, sf):
    """The fingerprint of a backlog of any size."""
    return jobs.backlog_tree_fingerprint(jobs.job_backlog(journal(spark, sf)))


@query(f"""WITH {JOURNAL} SELECT rule, n FROM (SELECT 'schema version' AS rule, 1 AS n UNION ALL SELECT 'count', 1 UNION ALL SELECT 'fingerprint', 1 UNION ALL SELECT rule, count(*) FROM (
 SELECT CASE CAST(job_id AS BIGINT) % 8 WHEN 0 THEN 'job id' WHEN 1 THEN 'no url' WHEN 2 THEN 'kind' WHEN 3 THEN 'company' WHEN 4 THEN 'hash' END AS rule FROM journal WHERE status <> 'completed') WHERE rule IS NOT NULL GROUP BY rule
 UNION ALL SELECT 'no job id', count(*) FROM journal WHERE status <> 'completed' AND CAST(job_id AS BIGINT) % 8 = 5)""", plain=True)
def backlog_faults(spark, sf):
    """A backlog with every fault: a version, count and fingerprint that are not its own, ids that stand twice or are blank, and bad fields."""
    j = jobs.job_backlog(journal(spark, sf))
    k = F.col("job_id").cast("long") % 8
    bad = j.withColumns({
        "url": F.when(k == 1, " ").otherwise(F.col("url")), "kind": F.when(k == 2, "letter").otherwise(F.col("kind")), "company": F.when(k == 3, F.lit(None)).otherwise(F.col("company")),
        "document_sha256": F.when(k == 4, F.upper("document_sha256")).otherwise(F.col("document_sha256")), "_k": k,
    })
    blank = bad.where("_k = 5").withColumn("job_id", F.lit(" "))
    bad = bad.where("_k not in (0, 5)").unionByName(bad.where("_k = 0")).unionByName(bad.where("_k = 0")).unionByName(blank).drop("_k")
    found = quality.backlog_violations(bad, 3, -1, ["fleet-report", "official-news"], COMPANIES, tree="0" * 64)
    return found.where("rule <> 'job id' or trim(job_id) <> ''").groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'job id' WHEN 1 THEN 'kind' WHEN 2 THEN 'pages' WHEN 3 THEN 'locators' END AS rule FROM pages) WHERE rule IS NOT NULL GROUP BY rule""", plain=True)
def input_faults(spark, sf):
    """Reading inputs with each fault that one may have."""
    k = F.col("page_id") % 5
    page = lambda name: F.struct(F.lit(name).alias("locator"), F.lit("text").alias("text"))
    pages = F.when(k == 2, F.array().cast("array<struct<locator:string,text:string>>")).when(k == 3, F.array(page("page:1"), page("page:1"))).otherwise(F.array(page("page:1"), page("page:2")))
    given = table(spark, sf, "pages").select(F.when(k == 0, " ").otherwise(F.col("page_id").cast("string")).alias("job_id"), F.when(k == 1, "letter").otherwise("official-news").alias("kind"), pages.alias("pages"))
    return quality.input_violations(given, ["official-news"]).groupBy("rule").agg(F.count("*").alias("n"))


def _fitted(p: int, weights: str) -> str:
    """CTEs of one pass of the local regression: from all pairs of days of a group, with the days' weights and weighted rates in `weights`."""
    return f"""
 s{p} AS (SELECT q.g, q.i, sum(k * w) AS s0, sum(k * w * z) AS s1, sum(k * w * z * z) AS s2, sum(k * wy) AS t0, sum(k * wy * z) AS t1 FROM kernel AS q JOIN {weights} AS v ON v.g = q.g AND v.x = q.j GROUP BY q.g, q.i),
 f{p} AS (SELECT g, i AS x, CASE WHEN s0 > 0 THEN CASE WHEN abs(s0 * s2 - s1 * s1) <= 1e-9 * greatest(1.0, s0 * s2) THEN t0 / s0 ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END END AS fit FROM s{p}),
 r{p} AS (SELECT o.g, o.x, o.y, o.y - f.fit AS r FROM obs AS o JOIN f{p} AS f USING (g, x) WHERE f.fit IS NOT NULL),
 m{p} AS (SELECT g, median(abs(r)) AS s FROM r{p} GROUP BY g),
 b{p} AS (SELECT g, x, y, CASE WHEN s < 1e-9 THEN 1.0 WHEN abs(r) / (6 * s) >= 1 THEN 0.0 ELSE pow(1 - pow(r / (6 * s), 2), 2) END AS b FROM r{p} JOIN m{p} USING (g)),
 w{p} AS (SELECT g, x, sum(b) AS w, sum(b * y) AS wy FROM b{p} GROUP BY g, x)"""


_TREND = f""", obs AS (SELECT company AS g, start_date - DATE '1970-01-01' AS x, rate AS y FROM observations),
 sizes AS (SELECT g, count(*) AS n, greatest(0.3, least(1.0, 4.0 / count(*))) AS span FROM obs GROUP BY g HAVING count(*) >= 5 AND count(DISTINCT x) >= 4),
 day AS (SELECT g, x, count(*) AS m, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy FROM obs JOIN sizes USING (g) GROUP BY g, x),
 pair AS (SELECT a.g, a.x AS i, b.x AS j, abs(a.x - b.x) AS d, sum(b.m) OVER (PARTITION BY a.g, a.x ORDER BY abs(a.x - b.x)) AS upto, b.m FROM day AS a JOIN day AS b USING (g)),
 reach AS (SELECT p.g, i, coalesce(min(d) FILTER (upto >= greatest(2, floor(span * n))), max(d)) AS h, coalesce(min(d) FILTER (upto >= greatest(4, ceil(n * span))), max(d)) AS e, greatest(4, ceil(n * span)) AS k
  FROM pair AS p JOIN sizes USING (g) GROUP BY p.g, i, span, n),
 kernel AS (SELECT p.g, i, j, CAST(j - i AS DOUBLE) AS z, CASE WHEN h > 0 THEN pow(1 - pow(CAST(d AS DOUBLE) / h, 3), 3) ELSE 1.0 END AS k FROM pair AS p JOIN reach USING (g, i) WHERE d < h OR d = 0),
 {_fitted(1, "day")}, {_fitted(2, "w1")}, {_fitted(3, "w2")},
 rest AS (SELECT g, x, count(*) AS m, sum(r) AS r1, sum(r * r) AS r2 FROM r3 GROUP BY g, x),
 inside AS (SELECT q.g, q.i, k, e, coalesce(sum(m) FILTER (d < e), 0) AS c, coalesce(sum(r1) FILTER (d < e), 0) AS s1, coalesce(sum(r2) FILTER (d < e), 0) AS s2, sum(m) FILTER (j = q.i - e) AS ma, sum(r1) FILTER (j = q.i - e) AS a1, sum(r2) FILTER (j = q.i - e) AS a2,
  sum(m) FILTER (j = q.i + e AND e > 0) AS mb, sum(r1) FILTER (j = q.i + e AND e > 0) AS b1, sum(r2) FILTER (j = q.i + e AND e > 0) AS b2 FROM (SELECT g, i, j, d FROM pair) AS q JOIN reach USING (g, i) JOIN rest ON rest.g = q.g AND rest.x = q.j GROUP BY q.g, q.i, k, e),
 early AS (SELECT *, CASE WHEN ma > 0 THEN least(1.0, greatest(0.0, (k - c) / ma)) ELSE 0.0 END AS fa FROM inside),
 late AS (SELECT *, CASE WHEN mb > 0 THEN least(1.0, greatest(0.0, (k - c - fa * coalesce(ma, 0)) / mb)) ELSE 0.0 END AS fb FROM early),
 sums AS (SELECT g, i AS x, c + fa * coalesce(ma, 0) + fb * coalesce(mb, 0) AS c, s1 + fa * coalesce(a1, 0) + fb * coalesce(b1, 0) AS s1, s2 + fa * coalesce(a2, 0) + fb * coalesce(b2, 0) AS s2 FROM late),
 band AS (SELECT g, x, CASE WHEN c > 1 THEN sqrt(greatest(0.0, (s2 - s1 * s1 / c) / (c - 1))) ELSE 0.0 END AS sd FROM sums)"""


@query(_TREND + """ SELECT g AS company, n, round(span, 6) AS span, strftime(DATE '1970-01-01' + CAST(x AS INTEGER), '%Y-%m-%d') AS date, round(fit, 2) AS rate, round(greatest(0.0, fit - sd), 2) AS band_lo, round(fit + sd, 2) AS band_hi
FROM f3 JOIN band USING (g, x) JOIN sizes USING (g)""")
def company_trend(spark, sf):
    """Each company's trend, against a fit over all pairs of days."""
    t = trend.rate_trend(observations.rate_observations(assets(spark, sf), periods(spark, sf)), "company")
    return t.select("company", "n", F.round("span", 6).alias("span"), F.date_format("date", "yyyy-MM-dd").alias("date"), *(F.round(c, 2).alias(c) for c in ("rate", "band_lo", "band_hi")))


def _placed(df: DataFrame) -> DataFrame:
    """A sorted frame with `place`, the number of each row as it comes."""
    return jobs.numbered(df.withColumns({"_i": F.monotonically_increasing_id(), "_g": F.lit(0)}), "_g", [F.col("_i")], "place").drop("_i", "_g")


@query(f"""WITH {FEED} SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN title = 'error' THEN '1970-01-01' ELSE published_at END DESC, seq) AS INT) AS place FROM feed""", plain=True)
def events_in_order(spark, sf):
    """Where each event stands in the feed as it is sorted."""
    return _placed(feed.ordered_events(announcements(spark, sf))).select("event_id", "place")


@query(""" SELECT asset_id, CAST(row_number() OVER (ORDER BY CASE generation WHEN '6G' THEN 1 WHEN '7G' THEN 2 WHEN '7G+' THEN 3 ELSE 4 END DESC, company, asset_id) AS INT) AS place FROM assets""")
def timeline_in_order(spark, sf):
    return _placed(market.timeline_order(assets(spark, sf), GENERATIONS)).select("asset_id", "place")


def _files(df: DataFrame, text, path: str) -> None:
    """A file for each value of g, which holds the text of its group."""
    df.groupBy("g").agg(text.alias("value")).repartition("g").write.mode("append").partitionBy("g").text(path)


@query(f"""WITH {FEED} SELECT event_id, company, url, title, published_at, title = 'error' AS pending, seq % 3 = 0 AS auto FROM feed""", plain=True)
def feed_files(spark, sf):
    """Events written as feed files and read again."""
    path, e = _folder(spark), announcements(spark, sf)
    row = F.struct(F.col("event_id").alias("id"), "company", "url", "title", F.col("published_at").alias("publishedAt"), (F.col("title") == "error").alias("pendingReview"), (F.col("seq") % 3 == 0).alias("autoApplied"), F.lit(1).alias("unknown"))
    _files(e.select((F.col("seq") % 64).alias("g"), row.alias("r")), F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("generatedAt"), F.collect_list("r").alias("events"))), path)
    return snapshots.read_events(spark, path).select(F.col("id").alias("event_id"), "company", "url", "title", F.col("publishedAt").alias("published_at"), F.col("pendingReview").alias("pending"), F.col("autoApplied").alias("auto"))


@query(f"""WITH {JOURNAL}, j AS (SELECT *, CAST(job_id AS BIGINT) AS i FROM journal)
SELECT job_id, source_id, url, document_sha256, status, CASE WHEN i % 3 > 0 THEN outcome WHEN i % 2 = 0 THEN 'odd' ELSE 'migrated' END AS outcome, CASE WHEN i % 2 = 1 THEN '2024-02-01' END AS last_read_at FROM j WHERE i % 2 = 0 OR status = 'completed'""", plain=True)
def journal_files(spark, sf):
    """Records in files of the journal's form, and of the form before it, of which completed jobs are taken over."""
    path, i = _folder(spark), F.col("job_id").cast("long")
    j = journal(spark, sf).withColumn("outcome", F.when(i % 3 == 0, "odd").otherwise(F.col("outcome")))
    record = lambda *more: F.struct(F.col("job_id").alias("jobId"), F.col("source_id").alias("sourceId"), "company", "kind", "title", F.col("document_sha256").alias("documentSha256"), "status", "outcome", *more)
    now = j.where(i % 2 == 0).select((i % 64).alias("g"), F.struct("job_id", record("url")).alias("r"))
    _files(now, F.to_json(F.struct(F.lit(3).alias("schemaVersion"), F.map_from_entries(F.collect_list("r")).alias("documents"))), path)
    old = j.where(i % 2 == 1).select((i % 64).alias("g"), record(F.lit("2024-02-01").alias("completedAt")).alias("r"), F.struct("source_id", F.struct("url")).alias("s"))
    _files(old, F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.collect_list("r").alias("jobs"), F.map_from_entries(F.collect_set("s")).alias("sources"))), path)
    return snapshots.read_documents(spark, path).select("job_id", "source_id", "url", "document_sha256", "status", "outcome", "last_read_at")


@query(""" SELECT contract_id, 'note ' || contract_id AS note, CASE WHEN status = 'Firm' AND day_rate > 0 AND client <> 'Undisclosed' THEN NULL ELSE 'older' END AS input_mode,
 CASE WHEN status = 'Firm' AND day_rate > 0 AND client <> 'Undisclosed' THEN 'https://reports.example.com/' ELSE 'before' END AS source_url FROM contracts""")
def kept_columns(spark, sf):
    """Columns that a decision says nothing of stay with a row that is written again; those of its source and of its older form don't."""
    c = contracts(spark, sf).withColumns({"note": F.concat(F.lit("note "), "contract_id"), "input_mode": F.lit("older"), "source_url": F.lit("before")})
    d = decisions.validate_decisions(responses(spark, sf), assets(spark, sf), periods(spark, sf), CONTRACT_STATES)
    return apply.apply_decisions(assets(spark, sf), c, _documented(d)).contracts.select("contract_id", "note", "input_mode", "source_url")
