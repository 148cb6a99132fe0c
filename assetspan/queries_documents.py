"""Registered queries of the feed, of documents and jobs, and of decisions; they extend those of assetspan.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.functions import hashes, scalars
from assetspan.operators import apply, decisions, diff, documents, feed, jobs, market, observations, quality, status
from assetspan.plans.model import AS_OF, ASSET_STATES, COMPANIES, CONTRACT_STATES, GENERATIONS, assets, contracts, periods, table
from assetspan.queries import query
from assetspan.session import cut, kept

NOW = 1_700_000_000


#: Parts of the SQL for the pages' plain markup: the article, its references decoded, what a reader sees, and that without its heading.
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_DECODE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _shown(source: str) -> str:
    return _SPACES.format(_DECODE.format(rf"regexp_replace(regexp_replace({source}, '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"))


_BODY = _shown(f"regexp_replace({_ARTICLE}, '(?s)<h1>.*?</h1>', '', 'g')")


def announcements(spark, sf) -> DataFrame:
    """The events table as a feed."""
    e, kind, bought = table(spark, sf, "events"), F.col("event_type"), F.col("event_type") == "purchase"
    row = F.struct(F.col("value").alias("day_rate"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("client"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("company"),
        F.concat(F.lit("https://news.example.com/"), F.col("user_id").cast("string")).alias("url"), kind.alias("title"),
        F.when(kind == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("published_at"),
        F.when(kind == "view", "official-report-reading").otherwise("official-news-signal").alias("classification"), F.when(kind == "click", "contract").alias("news_category"),
        F.when(kind.isin("purchase", "signup"), F.col("user_id").cast("string")).alias("asset"), (kind == "signup").alias("reviewed"), (kind == "error").alias("pending_review"),
        F.when(bought, F.struct(F.lit("upsert").alias("action"), row.alias("row"))).alias("decision"), "user_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FEED = """feed AS (
  SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS event_id, 'C' || CAST(user_id % 4 AS VARCHAR) AS company, 'https://news.example.com/' || CAST(user_id AS VARCHAR) AS url, event_type AS title,
    CASE WHEN event_type = 'error' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS published_at, CASE WHEN event_type = 'view' THEN 'official-report-reading' ELSE 'official-news-signal' END AS classification,
    user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


@query(f"""WITH {FEED} SELECT event_id, CASE WHEN title = 'error' THEN '1970-01-01' ELSE published_at END AS published_day,
 CASE WHEN title = 'click' THEN 'contract' WHEN title = 'view' THEN 'Fleet Status' WHEN title IN ('purchase', 'signup') THEN 'contract' ELSE 'other' END AS category FROM feed""", plain=True)
def ordered_events(spark, sf):
    e = feed.ordered_events(announcements(spark, sf))
    return e.select("event_id", F.date_format("published_day", "yyyy-MM-dd").alias("published_day"), feed.news_category(e).alias("category"))


@query(f"""WITH {FEED}, u AS (SELECT *, CASE WHEN title IN ('purchase', 'signup') THEN 'undisclosed' ELSE 'unknown' END AS u FROM feed)
SELECT event_id, fact, CASE WHEN fact = 'client' AND title = 'purchase' THEN 'U' || CAST(user_id AS VARCHAR) WHEN fact = 'award_type' THEN classification
 WHEN fact = 'day_rate' AND title = 'purchase' AND value > 0 THEN CAST(value AS VARCHAR) ELSE u END AS value
FROM u, (SELECT unnest(['client', 'region', 'award_type', 'start', 'term', 'option', 'value', 'day_rate']) AS fact)""", plain=True)
def event_facts(spark, sf):
    return feed.event_facts(announcements(spark, sf))


@query(f"WITH {FEED} SELECT event_id, CASE WHEN title = 'purchase' THEN 'upsert' ELSE '' END AS notes FROM feed", plain=True)
def event_notes(spark, sf):
    return feed.event_notes(announcements(spark, sf)).select("event_id", F.array_join("notes", "|").alias("notes"))


@query(f"WITH {FEED} SELECT title, count(*) AS n, sum(CASE WHEN title = 'error' THEN 1 ELSE 0 END) AS renewed FROM feed GROUP BY title", plain=True)
def merge_events(spark, sf):
    e = announcements(spark, sf).select("event_id", "title").withColumn("state", F.lit("old"))
    merged = feed.merge_events(e, e.where("title = 'error'").withColumn("state", F.lit("new")))
    return merged.groupBy("title").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "new").alias("renewed"))


@query(f"""WITH {FEED}, c AS (SELECT event_id, company, url, title, CASE WHEN title = 'click' THEN 'contract' WHEN title = 'view' THEN 'Fleet Status' END AS own FROM feed),
keys AS (SELECT DISTINCT company, url, title FROM c WHERE title = 'purchase')
SELECT event_id, coalesce(own, CASE WHEN k.title IS NOT NULL THEN 'market' ELSE 'other' END) AS news_category FROM c LEFT JOIN keys AS k USING (company, url, title)""", plain=True)
def tag_events(spark, sf):
    e = announcements(spark, sf).select("event_id", "company", "url", "title", "classification", "news_category")
    given = e.where("title = 'purchase'").select(hashes.group_event_id(F.col("company"), F.col("url"), F.col("title")).alias("id"), F.lit("market").alias("category"))
    return feed.tag_events(e, given).select("event_id", "news_category")


def triage(spark, sf) -> DataFrame:
    e = announcements(spark, sf).where("title <> 'view'")
    return e.select(F.col("event_id").alias("job_id"), (F.col("k") % 3 == 0).alias("selected"), F.when(F.col("k") % 5 == 0, "contract").otherwise("nonsense").alias("category"), F.col("k").alias("pos"))


def journal(spark, sf) -> DataFrame:
    """The feed's events as document records."""
    e = announcements(spark, sf)
    kind = F.when(F.col("title") == "view", "fleet-report").otherwise("official-news")
    return e.select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("source-"), F.col("user_id").cast("string")).alias("source_id"), "company", kind.alias("kind"), "url", "title", "published_at", F.sha2(F.col("event_id"), 256).alias("document_sha256"),
        F.when(F.col("title") == "view", "completed").when(F.col("title") == "error", "failed").otherwise("pending").alias("status"), F.when(F.col("title") == "view", "applied").alias("outcome"),
        (F.col("user_id") % 20).cast("int").alias("failure_count"), (F.lit(NOW) + F.col("k") - 50).cast("long").alias("next_attempt_after"), F.col("published_at").alias("last_success_at"), F.lit(None).cast("string").alias("last_read_at"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("boolean").alias("selected"), F.lit(None).cast("string").alias("news_category"), F.lit(None).cast("string").alias("input_mode"),
        F.when(F.col("title") == "view", F.col("published_at")).alias("report_date"),
    )


JOURNAL = FEED + """, journal AS (
  SELECT event_id AS job_id, 'source-' || CAST(user_id AS VARCHAR) AS source_id, company, CASE WHEN title = 'view' THEN 'fleet-report' ELSE 'official-news' END AS kind, url, title, published_at, sha256(event_id) AS document_sha256,
    CASE WHEN title = 'view' THEN 'completed' WHEN title = 'error' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN title = 'view' THEN 'applied' END AS outcome, CAST(user_id % 20 AS INT) AS failure_count,
    CAST(1700000000 + k - 50 AS BIGINT) AS next_attempt_after, k FROM feed)"""


@query(f"WITH {JOURNAL} SELECT job_id, CASE WHEN k % 5 = 0 THEN 'contract' ELSE 'other' END AS category FROM journal WHERE kind = 'official-news' AND status <> 'completed'", plain=True)
def triage_categories(spark, sf):
    return feed.triage_categories(journal(spark, sf).where("kind = 'official-news'").where(jobs.is_open()), triage(spark, sf), ["contract", "market"])


@query(f"""WITH {JOURNAL} SELECT job_id, CASE WHEN title <> 'view' AND k % 3 <> 0 THEN 'completed' ELSE status END AS status, CASE WHEN title <> 'view' AND k % 3 <> 0 THEN 'excluded' ELSE outcome END AS outcome FROM journal""", plain=True)
def apply_triage(spark, sf):
    return jobs.apply_triage(journal(spark, sf), announcements(spark, sf), triage(spark, sf), "2024-02-01T00:00:00Z")[0].select("job_id", "status", "outcome")


@query(f"WITH {JOURNAL} SELECT job_id, kind, company, url, document_sha256 FROM journal WHERE status <> 'completed'", plain=True)
def job_backlog(spark, sf):
    return jobs.job_backlog(journal(spark, sf))


@query(f"WITH {JOURNAL} SELECT job_id FROM journal WHERE status <> 'completed' AND next_attempt_after <= 1700000000", plain=True)
def ready_jobs(spark, sf):
    return journal(spark, sf).where(jobs.is_ready(NOW)).select("job_id")


@query(f"WITH {JOURNAL} SELECT CASE WHEN min(next_attempt_after) > 1699999940 THEN min(next_attempt_after) ELSE 0 END AS retry_after FROM journal WHERE status <> 'completed'", plain=True)
def retry_after(spark, sf):
    return jobs.retry_after(journal(spark, sf), NOW - 60)


@query(f"""WITH {JOURNAL} SELECT job_id, CASE title WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'failed' ELSE status END AS status, CAST(failure_count + CASE WHEN title = 'purchase' THEN 1 ELSE 0 END AS INT) AS failure_count,
 CAST(CASE title WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1700000000 + least(21600, 300 * (1 << least(failure_count, 16))) WHEN 'click' THEN 1700003600 ELSE next_attempt_after END AS BIGINT) AS next_attempt_after FROM journal""", plain=True)
def settle(spark, sf):
    j = journal(spark, sf)
    kind = F.when(F.col("title") == "signup", "completed").when(F.col("title") == "purchase", "failed").when(F.col("title") == "click", "usage-limited")
    results = j.select("job_id", kind.alias("result"), F.lit("applied").alias("outcome"), F.lit("timeout").alias("error"), F.lit(None).cast("long").alias("retry_at")).where("result is not null")
    return jobs.settle(j, results, NOW, "2024-02-01T00:00:00Z").select("job_id", "status", "failure_count", "next_attempt_after")


@query(f"""WITH {JOURNAL} SELECT job_id, CAST(row_number() OVER (PARTITION BY company ORDER BY CASE WHEN kind = 'fleet-report' THEN 0 ELSE 1 END, published_at, url, job_id) AS INT) AS round FROM journal""", plain=True)
def reading_order(spark, sf):
    return jobs.reading_order(journal(spark, sf)).select("job_id", "round")


@query(f"""WITH {JOURNAL} SELECT source_id, published_at AS last_success_at, document_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, job_id DESC) AS r FROM journal) WHERE r = 1""", plain=True)
def previous_sources(spark, sf):
    return jobs.previous_sources(journal(spark, sf)).select("source_id", "last_success_at", "document_sha256")


@query(f"""WITH {JOURNAL} SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, url, job_id) AS r FROM (SELECT * FROM journal WHERE title = 'view')) WHERE r <= 20""", plain=True)
def limit_per_company(spark, sf):
    items = journal(spark, sf).where("title = 'view'").withColumn("url", F.struct("url", "job_id"))
    return jobs.limit_per_company(items, 20).select("job_id")


@query(f"""WITH {JOURNAL} SELECT company, max(url) FILTER (published_at = m) AS url, max(m) AS published_at FROM (SELECT *, max(published_at) OVER (PARTITION BY company) AS m FROM journal) GROUP BY company""", plain=True)
def newest_document(spark, sf):
    return jobs.newest_document(journal(spark, sf))


@query(f"""WITH {JOURNAL}, r AS (SELECT company, source_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, CAST(job_id AS BIGINT) DESC) AS rn FROM journal WHERE kind = 'fleet-report') WHERE rn = 1)
SELECT r.company, m.d AS report_date, 'reading-pending' AS health, 'pending' AS reading_status FROM r JOIN (SELECT source_id, max(published_at) AS d FROM journal WHERE kind = 'fleet-report' GROUP BY source_id) AS m USING (source_id)""", plain=True)
def source_health(spark, sf):
    """Reports just captured, of which none has been read in that revision."""
    j = journal(spark, sf)
    newest = j.where("kind = 'fleet-report'").groupBy("company").agg(F.max(F.struct("published_at", F.col("job_id").cast("long").alias("j"), "source_id", "document_sha256")).alias("c"))
    reports = newest.select("company", "c.source_id", "c.document_sha256", F.lit(None).cast("string").alias("error"))
    none = j.where("1 = 0").select("company", "kind", F.lit("").alias("phase"), F.lit("").alias("error"))
    health = jobs.source_health(j.select("company").distinct(), reports, j, none, j.where("1 = 0").select("company", "report_date"))
    return health.select("company", "report_date", "health", "reading_status")


def captures(spark, sf) -> DataFrame:
    """The documents table as captures: four texts in a row are revisions of one source."""
    d = table(spark, sf, "documents")
    source = F.concat(F.lit("source-"), F.floor(F.col("doc_id") / 4).cast("string"))
    return d.select(
        source.alias("source_id"), F.lit("C0").alias("company"), F.lit("official-news").alias("kind"), F.concat(F.lit("https://docs.example.com/"), source).alias("url"), "lang", F.col("lang").alias("title"), F.lit("2024-01-01").alias("published_at"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_sha256"),
    )


CAPTURES = "captures AS (SELECT 'source-' || CAST(doc_id // 4 AS VARCHAR) AS source_id, lang, sha256(coalesce(text, '')) AS document_sha256 FROM documents)"


@query(f"""WITH {CAPTURES}, k AS (SELECT source_id, document_sha256, max(CAST(lang = 'en' AS INT)) AS known FROM captures GROUP BY source_id, document_sha256),
s AS (SELECT source_id, max(known) AS old, max(1 - known) AS fresh FROM k GROUP BY source_id)
SELECT 'job-' || sha256(source_id || chr(10) || document_sha256)[1:32] AS job_id, source_id, document_sha256, 'pending' AS status FROM k JOIN s USING (source_id) WHERE known = 0 OR fresh = 0""", plain=True)
def register(spark, sf):
    """First all English captures, then all captures: sources with a new revision lose their open older ones."""
    c = captures(spark, sf)
    empty = c.where("1 = 0").select(
        F.lit("").alias("job_id"), "source_id", "company", "kind", "url", "title", "published_at", "document_sha256", F.lit("").alias("status"), F.lit(None).cast("string").alias("outcome"), F.lit(0).alias("failure_count"),
        F.lit(0).cast("long").alias("next_attempt_after"), F.lit("").alias("last_success_at"),
    )
    none = c.where("1 = 0").select("source_id", "document_sha256")
    first = jobs.register(empty, c.where("lang = 'en'").drop("lang"), none, "2024-01-01")
    return jobs.register(first, c.drop("lang"), none, "2024-01-02").select("job_id", "source_id", "document_sha256", "status")


@query("""SELECT page_id, 'source-' || sha256('["C' || CAST(page_id % 4 AS VARCHAR) || '","official-news","' || regexp_replace(url, '#.*$', '') || '"]') AS source_id, regexp_replace(url, '#.*$', '') AS canonical, CASE WHEN url LIKE 'https://%' THEN url END AS safe,
 sha256(coalesce(html, '')) AS sha FROM pages""", plain=True)
def document_identities(spark, sf):
    p = table(spark, sf, "pages")
    company, url = F.concat(F.lit("C"), (F.col("page_id") % 4).cast("string")), F.col("url")
    return p.select("page_id", hashes.source_id(company, F.lit("official-news"), url).alias("source_id"), scalars.canonical_url(url).alias("canonical"), scalars.safe_url(url).alias("safe"), hashes.text_hash(F.coalesce("html", F.lit(""))).alias("sha"))


@query("""SELECT page_id, url LIKE 'https://%' AND regexp_matches(url, '^https://[^/]+/en/') AS official FROM pages""", plain=True)
def official_source(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.lit("C0").alias("company"))
    rules = p.select("company", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.lit("^/en/").alias("path_pattern")).distinct()
    return documents.official_source(p, rules).select("page_id", "official")


@query(f"""SELECT url, CASE WHEN coalesce(html, '') <> '' AND length({_BODY}) >= 100 THEN 'html:article' END AS locator, CASE WHEN coalesce(html, '') <> '' AND length({_BODY}) >= 100 THEN {_shown(_ARTICLE)} END AS text,
 CASE WHEN coalesce(html, '') = '' THEN 'document is empty' WHEN length({_BODY}) < 100 THEN 'body is unexpectedly short' END AS reject_reason FROM pages""", plain=True)
def extract_articles(spark, sf):
    return documents.extract_articles(table(spark, sf, "pages"))


_HREF = _DECODE.format("regexp_extract(a, '<a href=.([^>]*).>', 1)")


@query(f"""WITH l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a href="[^"]*">.*?</a>')) AS a FROM pages)
SELECT DISTINCT url AS page_url, {_HREF} AS href, {_shown("a")} AS title, regexp_extract(url, '^https?://[^/]+') || {_HREF} AS url, CAST(NULL AS VARCHAR) AS published_at FROM l""", plain=True)
def extract_links(spark, sf):
    return documents.extract_links(table(spark, sf, "pages"))


_APART = _SPACES.format(_DECODE.format(f"regexp_replace({_ARTICLE}, '<[^>]*>', ' ', 'g')"))


@query(f"SELECT url, CASE WHEN coalesce(html, '') <> '' THEN sha256({_APART}) END AS legacy_sha256 FROM pages", plain=True)
def legacy_hash(spark, sf):
    return documents.legacy_hash(table(spark, sf, "pages"))


@query(f"""WITH p AS (SELECT page_id, {_shown(_ARTICLE)} AS text FROM pages WHERE coalesce(html, '') <> '' AND length({_BODY}) >= 100)
SELECT 'source-' || sha256('["C0","official-news","https://pages.example.com/' || CAST(page_id AS VARCHAR) || '"]') AS source_id, sha256(CASE WHEN page_id % 4 = 0 THEN text || '!' ELSE text END) AS document_sha256, page_id % 4 <> 2 AS changed FROM p""", plain=True)
def capture_revisions(spark, sf):
    """Articles of all pages against a first state in which only those of even number were known; every fourth has changed since."""
    pages = table(spark, sf, "pages").withColumn("url", F.concat(F.lit("https://pages.example.com/"), F.col("page_id").cast("string")))
    read = cut(documents.extract_articles(pages))
    number = F.regexp_extract("url", "[0-9]+$", 0).cast("long")
    c = read.select(number.alias("page_id"), F.lit("C0").alias("company"), F.lit("official-news").alias("kind"), "url", "text", "reject_reason")
    none = c.where("1 = 0").select(F.lit("").alias("source_id"), F.lit("").alias("document_sha256"), F.lit("").alias("last_success_at"))
    first = documents.capture_revisions(c.where("page_id % 2 = 0"), none)[0].select("source_id", "document_sha256", F.lit("2024").alias("last_success_at"))
    now = c.withColumn("text", F.when(F.col("page_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return documents.capture_revisions(now, first)[0].select("source_id", "document_sha256", "changed")


@query("""SELECT l_orderkey AS page, string_agg(line_text, '|' ORDER BY l_linenumber, line_text) AS lines, bool_or(ok) AS reliable FROM (
 SELECT l_orderkey, l_linenumber, string_agg(l_returnflag || CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey, l_returnflag || CAST(l_partkey AS VARCHAR)) AS line_text, bool_or(l_quantity * 2 >= 60) AS ok FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey""", plain=True)
def assemble_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.concat("l_returnflag", F.col("l_partkey").cast("string"))
    words = li.select(F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("word"), text.alias("text"), (F.col("l_quantity") * 2).cast("int").alias("conf"))
    return jobs.assemble_lines(words).select("page", F.array_join("lines", "|").alias("lines"), "reliable")


def responses(spark, sf) -> DataFrame:
    """One response per asset: its firm contracts written anew (a rate of 0 as text, an undisclosed client blank), options withdrawn without an id,
    the others left as they are."""
    c = contracts(spark, sf)
    # Contracts meet by asset as they are, and are put into words there.
    given = ["contract_id", "asset_id", "start_date", "end_date", "status", "day_rate", "client", "region", "value_usd", "base_days"]
    lists = c.select("asset_id", F.struct(*given).alias("x")).groupBy("asset_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def item(x):
        firm = x["status"] == "Firm"
        interpretation = F.struct(x["value_usd"].alias("valueUsd"), x["base_days"].alias("baseDurationDays"))
        rate = F.when(x["day_rate"] > 0, F.to_json(F.struct(x["day_rate"].alias("v")))).otherwise('{"v":"0"}')
        row = F.concat(
            F.lit('{"startDate":"'), F.date_format(x["start_date"], "yyyy-MM-dd"), F.lit('","endDate":"'), F.date_format(x["end_date"], "yyyy-MM-dd"), F.lit('","dayRate":'), F.regexp_extract(rate, r'^\{"v":(.*)\}$', 1),
            F.lit(',"client":"'), F.when(x["client"] == "Undisclosed", "").otherwise(x["client"]), F.lit('","region":"'), x["region"], F.lit('","status":"Firm","interpretation":'), F.to_json(interpretation), F.lit("}"),
        )
        action = F.when(firm, "upsert").when(x["status"] == "Option", "withdraw").otherwise("no-change")
        named = F.when(x["status"] == "Option", "null").otherwise(F.concat(F.lit('"'), x["contract_id"], F.lit('"')))
        return F.concat(F.lit('{"vesselId":"'), x["asset_id"], F.lit('","contractId":'), named, F.lit(',"action":"'), action, F.lit('","row":'), F.when(firm, row).otherwise("null"), F.lit("}"))

    payload = F.concat(F.lit('{"reportDate":"1999-06-30","vesselUpdates":[{"vesselId":"'), F.col("asset_id"), F.lit('","status":"'), F.col("status"), F.lit('","statusAsOf":"1999-06-30"}],"decisions":['), F.array_join(F.transform("xs", item), ","), F.lit("]}"))
    return assets(spark, sf).join(lists, "asset_id").select(F.concat(F.lit("job-"), F.col("asset_id")).alias("job_id"), "company", payload.alias("payload"))


DECISIONS = """, decided AS (
  SELECT 'job-' || asset_id AS job_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY contract_id) - 1 AS INT) AS index, c.*,
    CASE WHEN status = 'Firm' THEN 'upsert' WHEN status = 'Option' THEN 'withdraw' ELSE 'no-change' END AS action,
    CASE WHEN status = 'Option' THEN 'withdraw requires contractId' WHEN status = 'Firm' AND day_rate = 0 THEN 'row.dayRate must be a number of at least 0' WHEN status = 'Firm' AND client = 'Undisclosed' THEN 'row.client is blank' END AS hold_reason FROM contracts AS c)"""


@query(DECISIONS + " SELECT job_id, index, action, hold_reason, CASE WHEN hold_reason IS NULL AND action = 'upsert' THEN value_usd / base_days END AS derived FROM decided")
def validate_decisions(spark, sf):
    d = decisions.validate_decisions(responses(spark, sf), assets(spark, sf), periods(spark, sf), CONTRACT_STATES)
    return d.select("job_id", "index", "action", "hold_reason", F.col("row.derived_usd_per_day").alias("derived"))


@query("SELECT 'job-' || asset_id AS job_id, asset_id, status, '1999-06-30' AS status_as_of, CAST(NULL AS VARCHAR) AS hold_reason FROM assets WHERE asset_id IN (SELECT asset_id FROM contracts)")
def validate_updates(spark, sf):
    u = decisions.validate_updates(responses(spark, sf), assets(spark, sf), ASSET_STATES)
    return u.select("job_id", "asset_id", "status", F.date_format("status_as_of", "yyyy-MM-dd").alias("status_as_of"), "hold_reason")


@query(DECISIONS + """, ok AS (SELECT * FROM decided WHERE hold_reason IS NULL),
rest AS (SELECT asset_id, contract_id, start_date, end_date, client, CAST(NULL AS INT) AS index FROM decided WHERE NOT (hold_reason IS NULL AND action = 'upsert') UNION ALL SELECT asset_id, contract_id, start_date, end_date, client, index FROM ok WHERE action = 'upsert')
SELECT DISTINCT a.job_id, a.index, b.contract_id AS other_contract_id FROM ok AS a JOIN rest AS b ON a.asset_id = b.asset_id AND a.client = b.client AND (b.index IS NULL OR b.index > a.index)
 AND least(a.end_date, b.end_date) - greatest(a.start_date, b.start_date) > 31 WHERE a.action = 'upsert'""")
def suspected_duplicates(spark, sf):
    c = contracts(spark, sf)
    d = decisions.validate_decisions(responses(spark, sf), assets(spark, sf), periods(spark, sf), CONTRACT_STATES)
    return decisions.suspected_duplicates(d, c).select("job_id", "index", "other_contract_id")


def _documented(d: DataFrame) -> DataFrame:
    return d.withColumns({"source_id": F.concat(F.lit("source-"), F.col("job_id")), "document_sha256": F.sha2("job_id", 256), "kind": F.lit("fleet-report"), "url": F.lit("https://reports.example.com/"), "published_at": F.lit("1999-06-30")})


@query(""" SELECT contract_id, asset_id, CASE WHEN status = 'Firm' AND day_rate > 0 AND client <> 'Undisclosed' THEN 'https://reports.example.com/' END AS source_url, day_rate, status FROM contracts""")
def apply_decisions(spark, sf):
    c = contracts(spark, sf)
    d = decisions.validate_decisions(responses(spark, sf), assets(spark, sf), periods(spark, sf), CONTRACT_STATES)
    done = apply.apply_decisions(assets(spark, sf), c.withColumn("source_url", F.lit(None).cast("string")), _documented(d))
    return done.contracts.select("contract_id", "asset_id", "source_url", "day_rate", "status")


@query(DECISIONS + " SELECT job_id, CASE WHEN bool_or(hold_reason IS NOT NULL) THEN 'held' WHEN bool_or(action = 'upsert') THEN 'applied' ELSE 'no-change' END AS outcome FROM decided GROUP BY job_id")
def decision_outcomes(spark, sf):
    c = periods(spark, sf)
    d = decisions.validate_decisions(responses(spark, sf), assets(spark, sf), c, CONTRACT_STATES)
    return apply.apply_decisions(assets(spark, sf), c, _documented(d)).outcomes


def _rounds(spark, sf):
    """(documents, result) of three documents per company in reading order, with the updates and decisions of a third of its assets each.  The registry has
    another name for one company, whose documents fail for that."""
    a, c = assets(spark, sf), kept(contracts(spark, sf))
    third = F.pmod(F.col("asset_id").cast("long"), F.lit(3))
    job = F.concat(F.lit("job-"), "company", F.lit("-"), third.cast("string")).alias("job_id")
    found = a.join(c.select("asset_id").distinct(), "asset_id", "left_semi").select(job, "company", third.alias("k")).distinct()
    listed = found.withColumns({"kind": F.when(F.col("k") == 0, "official-news").otherwise("fleet-report"), "published_at": F.lit("1999-06-30"), "url": F.lit("https://reports.example.com/"), "input_mode": F.lit(None).cast("string"), "open_holds": F.array(F.lit("old"))})
    docs = cut(jobs.reading_order(listed))
    r = kept(responses(spark, sf))
    ids = docs.select("job_id", "round")
    # A document's items are counted on from asset to asset.
    own = lambda d: d.withColumns({"asset_id": F.coalesce("asset_id", F.substring("job_id", 5, 99)), "index": F.substring("job_id", 5, 99).cast("long") * 100000 + F.col("index")}).withColumn("job_id", job).join(F.broadcast(ids), "job_id")
    d = kept(_documented(own(decisions.validate_decisions(r, a, periods(spark, sf), CONTRACT_STATES))))
    u = kept(own(decisions.validate_updates(r, a, ASSET_STATES)))
    registered = a.withColumn("company", F.when(F.col("company") == "C3", "C9").otherwise(F.col("company")))
    broken = lambda x, y: quality.integrity_violations(x, y, registered, GENERATIONS, ASSET_STATES, CONTRACT_STATES)
    done = apply.apply_rounds(a, c.withColumn("source_url", F.lit(None).cast("string")), d, broken, u)
    return docs, done


@query(""" SELECT a.asset_id, a.status, CASE WHEN n.n > 0 AND company <> 'C3' THEN '1999-06-30' ELSE strftime(status_as_of, '%Y-%m-%d') END AS status_as_of, CASE WHEN company = 'C3' THEN 0 ELSE coalesce(n.w, 0) END AS written
 FROM assets AS a LEFT JOIN (SELECT asset_id, count(*) AS n, count(*) FILTER (status = 'Firm' AND day_rate > 0 AND client <> 'Undisclosed') AS w FROM contracts GROUP BY asset_id) AS n USING (asset_id)""")
def apply_rounds(spark, sf):
    done = _rounds(spark, sf)[1]
    written = done.contracts.where("source_url is not null").groupBy("asset_id").agg(F.count("*").alias("written"))
    return done.assets.join(written, "asset_id", "left").select("asset_id", "status", F.date_format("status_as_of", "yyyy-MM-dd").alias("status_as_of"), F.coalesce("written", F.lit(0).cast("long")).alias("written"))


@query(DECISIONS + """, per AS (SELECT 'job-' || company || '-' || CAST(CAST(asset_id AS BIGINT) % 3 AS VARCHAR) AS job_id, company, CAST(asset_id AS BIGINT) % 3 AS k, count(DISTINCT asset_id) AS a, count(*) AS n, count(*) FILTER (hold_reason IS NOT NULL) AS h,
 count(*) FILTER (hold_reason IS NULL AND d.action = 'upsert') AS w FROM decided AS d JOIN (SELECT asset_id, company FROM assets) AS o USING (asset_id) GROUP BY 1, 2, 3)
SELECT job_id, CASE WHEN company = 'C3' THEN 'failed' WHEN h > 0 THEN 'held' ELSE 'applied' END AS outcome, CASE WHEN company = 'C3' THEN 0 ELSE a + w END AS changes, CASE WHEN company = 'C3' THEN 0 ELSE n END AS events,
 CASE WHEN company = 'C3' THEN 1 WHEN k = max(k) FILTER (k = 0) OVER (PARTITION BY company) THEN h WHEN max(k) FILTER (k = 0) OVER (PARTITION BY company) IS NULL AND k = max(k) OVER (PARTITION BY company) THEN h ELSE 0 END AS open_holds FROM per""")
def document_outcomes(spark, sf):
    docs, done = _rounds(spark, sf)
    count = lambda d, name: d.groupBy("job_id").agg(F.count("*").alias(name))
    held = apply.settle_holds(docs, done).select("job_id", F.size("open_holds").cast("long").alias("open_holds"))
    out = done.outcomes.join(count(done.changes, "changes"), "job_id", "left").join(count(done.events, "events"), "job_id", "left").join(held, "job_id")
    return out.select("job_id", "outcome", F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), F.coalesce("events", F.lit(0).cast("long")).alias("events"), "open_holds")


@query(""" SELECT 'generation' AS rule, count(*) AS n FROM assets WHERE generation = '8G' UNION ALL SELECT 'contract status', count(*) FROM contracts WHERE status = 'Contingent'
 UNION ALL SELECT 'registry', 2 * count(*) FROM assets WHERE company = 'C3' UNION ALL SELECT 'company count', 2""")
def integrity_violations(spark, sf):
    """Against a registry in which one company has another name, and domains that lack a class and a contract state."""
    a = assets(spark, sf)
    registered = a.withColumn("company", F.when(F.col("company") == "C3", "C9").otherwise(F.col("company")))
    return quality.integrity_violations(a, contracts(spark, sf), registered, GENERATIONS[:3], ASSET_STATES, CONTRACT_STATES[:2]).groupBy("rule").agg(F.count("*").alias("n"))


@query(""" SELECT s.company, count(*) FILTER (s.status <> s.effective_status) AS status_changes, max(k.a) AS contracts_added, max(k.r) AS contracts_removed, max(k.c) AS contracts_changed FROM statuses AS s JOIN (
 SELECT company, count(*) FILTER (c.status = 'Contingent') AS a, count(*) FILTER (c.status = 'Option') AS r, count(*) FILTER (c.status = 'Firm' AND day_rate = 0) AS c FROM contracts AS c JOIN assets USING (asset_id) GROUP BY company) AS k USING (company) GROUP BY s.company""")
def semantic_diff(spark, sf):
    """From a state without contingent contracts to one without options, with effective statuses and undisclosed firm rates marked."""
    a, c = assets(spark, sf), contracts(spark, sf)
    after_a = status.effective_status(a, c, AS_OF).withColumn("status", F.col("effective_status"))
    after_c = c.where("status <> 'Option'").withColumn("client", F.when((F.col("status") == "Firm") & (F.col("day_rate") == 0), "marked").otherwise(F.col("client")))
    return diff.semantic_diff(a, c.where("status <> 'Contingent'"), after_a, after_c, COMPANIES)


@query(""" SELECT contract_id, CASE WHEN status = 'Contingent' THEN 'added' WHEN status = 'Option' THEN 'removed' ELSE 'changed' END AS change FROM contracts WHERE status <> 'Firm' OR day_rate = 0""")
def contract_changes(spark, sf):
    c = contracts(spark, sf)
    after = c.where("status <> 'Option'").withColumn("client", F.when((F.col("status") == "Firm") & (F.col("day_rate") == 0), "marked").otherwise(F.col("client")))
    return diff.contract_changes(c.where("status <> 'Contingent'"), after).select("contract_id", "change")


@query(""" SELECT (SELECT count(*) FROM assets) AS assets, (SELECT count(*) FROM contracts) AS contracts, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_type = 'error') AS pending_events""")
def snapshot_counts(spark, sf):
    return market.snapshot_counts(assets(spark, sf), periods(spark, sf), announcements(spark, sf))


@query(""" SELECT strftime(min(start_date), '%Y-%m-%d') AS first_report, strftime(max(start_date), '%Y-%m-%d') AS last_report FROM contracts""")
def report_range(spark, sf):
    r = market.report_range(periods(spark, sf).withColumn("report_date", F.date_format("start_date", "yyyy-MM-dd")))
    return r.select("first_report", "last_report")


@query(""" SELECT o.contract_id, s.url AS source_url FROM observations AS o LEFT JOIN (SELECT 'C' || CAST(page_id % 4 AS VARCHAR) AS company, min(url) FILTER (url LIKE 'https://%') AS url FROM pages GROUP BY 1) AS s USING (company)""")
def with_source(spark, sf):
    sources = table(spark, sf, "pages").select(F.concat(F.lit("C"), (F.col("page_id") % 4).cast("string")).alias("company"), F.col("url").alias("document_url"))
    return observations.with_source(observations.rate_observations(assets(spark, sf), periods(spark, sf)), sources).select("contract_id", "source_url")


@query(""" SELECT asset_id, CAST(CASE generation WHEN '6G' THEN 1 WHEN '7G' THEN 2 WHEN '7G+' THEN 3 ELSE 4 END AS INT) AS rank FROM assets""")
def timeline_order(spark, sf):
    return market.timeline_order(assets(spark, sf), GENERATIONS).select("asset_id", "rank")


@query()
def contract_digest(spark, sf):
    """The order-free digest under which a snapshot of contracts is published."""
    return hashes.table_digest(contracts(spark, sf))


@query(f"WITH {JOURNAL} SELECT source_id, document_sha256 FROM journal WHERE (kind = 'fleet-report' AND k < 50) OR (kind = 'official-news' AND (k >= 90 OR user_id < 10))".replace("status, CASE WHEN title = 'view' THEN 'applied' END AS outcome", "status, user_id, CASE WHEN title = 'view' THEN 'applied' END AS outcome"), plain=True)
def handled(spark, sf):
    """Captures that an older pipeline knew: reports by hash, news by URL or text hash."""
    e, j = announcements(spark, sf).select(F.col("event_id").alias("job_id"), "k", "user_id"), journal(spark, sf)
    c = j.join(e, "job_id").withColumns({"raw_sha256": F.lit(None).cast("string"), "final_url": F.lit(None).cast("string"), "legacy_sha256": F.when(F.col("k") >= 90, F.col("document_sha256"))})
    known = c.where("kind = 'fleet-report' and k < 50").select("company", F.col("document_sha256").alias("sha256"))
    urls = c.where("user_id < 10").select("url").distinct()
    hashes_ = c.where("k >= 90").select(F.col("legacy_sha256").alias("sha256"))
    return jobs.handled(c, known, urls, hashes_).select("source_id", "document_sha256")


@query(f"""WITH {JOURNAL}, n AS (SELECT DISTINCT source_id, sha256(source_id) AS sha FROM journal WHERE status <> 'completed')
SELECT job_id, status FROM journal WHERE status = 'completed' UNION ALL SELECT 'job-' || sha256(source_id || chr(10) || sha)[1:32], 'pending' FROM n""", plain=True)
def requeue_changed(spark, sf):
    """Every source's document has changed when it is looked at again."""
    j = journal(spark, sf)
    return jobs.requeue_changed(j, j.select("source_id", F.sha2("source_id", 256).alias("document_sha256")).distinct()).select("job_id", "status")


@query(f"""WITH {JOURNAL} SELECT job_id, status FROM journal UNION ALL SELECT DISTINCT 'job-' || sha256(source_id || chr(10) || document_sha256)[1:32], 'pending' FROM journal WHERE status = 'failed'""", plain=True)
def enqueue_stored(spark, sf):
    j = journal(spark, sf)
    reviews = j.where("status = 'failed'").select("source_id", "company", "kind", "url", "document_sha256")
    return jobs.enqueue_stored(j, reviews).select("job_id", "status")


@query(f"""WITH {JOURNAL} SELECT source_id, min(CASE WHEN kind = 'fleet-report' THEN 0 ELSE 1 END) AS priority FROM journal GROUP BY source_id""", plain=True)
def dedupe_sources(spark, sf):
    """Reports before news, one candidate per source."""
    j = journal(spark, sf).select("source_id", "company", "kind", "url", "document_sha256")
    feeds = jobs.candidate_union(j.where("kind = 'fleet-report'"), j.where("kind = 'official-news'"))
    return jobs.dedupe_sources(feeds).select("source_id", "priority")


@query(f"""WITH {JOURNAL} SELECT rule, n FROM (SELECT 'company' AS rule, count(*) FILTER (company = 'C3') AS n FROM journal WHERE status <> 'completed' UNION ALL SELECT 'count', 1) WHERE n > 0""", plain=True)
def backlog_violations(spark, sf):
    """Of a backlog published with a wrong count, by a list of companies that lacks one."""
    b = jobs.job_backlog(journal(spark, sf))
    return quality.backlog_violations(b, 2, -1, ["fleet-report", "official-news"], COMPANIES[:3]).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS job_id, rule FROM (
 SELECT doc_id, 'pages' AS rule FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT doc_id, 'locators' FROM documents WHERE len(string_split(text, chr(10))) > len(list_distinct(string_split(text, chr(10)))) AND coalesce(text, '') <> '')""", plain=True)
def input_violations(spark, sf):
    """Documents as reading inputs: a page per line, found by its text."""
    pages = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("locator"), x.alias("text")))
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.lit("official-news").alias("kind"), F.when(F.col("text") != "", pages).alias("pages"))
    return quality.input_violations(d, ["official-news"])


@query(""" SELECT strftime(date_trunc('quarter', start_date), '%Y-%m-%d') AS quarter, company, count(*) AS contracts, CAST(sum(end_date - start_date + 1) AS BIGINT) AS days FROM contracts JOIN assets USING (asset_id) GROUP BY 1, 2""")
def contracts_by_quarter(spark, sf):
    c = periods(spark, sf).join(assets(spark, sf).select("asset_id", "company"), "asset_id")
    quarter = F.date_format(scalars.quarter_start(F.col("start_date")), "yyyy-MM-dd").alias("quarter")
    return c.groupBy(quarter, "company").agg(F.count("*").alias("contracts"), F.sum(scalars.duration_days_incl(F.col("start_date"), F.col("end_date"))).alias("days"))


@query(""" SELECT count(*) AS total, count(*) FILTER (effective_status = 'Active') AS active FROM statuses WHERE company = 'C1'""")
def one_company(spark, sf):
    return status.fleet_kpis(status.filter_company(assets(spark, sf), "C1"), periods(spark, sf), AS_OF).select("total", "active")
