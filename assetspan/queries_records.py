"""Registered queries of scalar functions, identities, faults of every kind, fleet files, snapshots and streams; they extend those of assetspan.queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspan.functions import hashes, scalars
from assetspan.operators import apply, decisions, documents, feed, jobs, observations, quality
from assetspan.plans.model import ASSET_STATES, CONTRACT_STATES, GENERATIONS, assets, contracts, periods, table
from assetspan.queries import query
from assetspan.queries_documents import DECISIONS, FEED, JOURNAL, announcements, journal
from assetspan.session import cut, kept
from assetspan.sources import snapshots
from assetspan.streaming import streams


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


#: Characters that Unicode counts as white space, for an engine whose \s knows ASCII only.
_BLANKS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'))) AS clean, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-')) AS slug,
 nullif(trim(lang), '') AS lang, CASE WHEN trim(coalesce(text, '')) <> '' THEN length(text) END AS told FROM documents""", plain=True)
def text_forms(spark, sf):
    text = F.coalesce("text", F.lit(""))
    lang, told = scalars.optional_texts(lang=F.col("lang"), told=F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(scalars.clean_text(F.col("text"))).alias("clean"), F.md5(scalars.slug(text)).alias("slug"), lang, F.char_length(told).cast("long").alias("told"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS k, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS iso FROM orders)
SELECT o_orderkey, CASE WHEN k <= 4 THEN iso WHEN k = 5 THEN iso || 'T10:20:30+00:00' END AS published, CASE WHEN k IN (1, 2, 4) OR (k = 3 AND iso LIKE '%-05-%') THEN iso END AS told FROM d""", plain=True)
def written_dates(spark, sf):
    """Order dates in four spellings, as instants, as words and as days that don't exist."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 8
    spelt = [F.date_format(day, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy")]
    raw = F.when(k == 0, spelt[0]).when(k == 1, F.concat(spelt[1], F.lit(" 10:20:30"))).when(k == 2, spelt[2]).when(k == 3, spelt[3]).when(k == 4, spelt[4])
    raw = raw.when(k == 5, F.concat(spelt[0], F.lit("T10:20:30Z"))).when(k == 6, "soon").otherwise("1999-02-30")
    told = scalars.prose_date(F.concat(F.lit("Filed on "), raw, F.lit(", at noon")))
    return table(spark, sf, "orders").select("o_orderkey", scalars.publication_date(raw).alias("published"), F.date_format(told, "yyyy-MM-dd").alias("told"))


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '?a=1&b=2#x' WHEN 1 THEN '' ELSE '?refreshed=1' END AS stripped FROM pages""", plain=True)
def stripped_urls(spark, sf):
    query_, k = F.lit("?a=1&Refresh=x&b=2#x"), F.col("page_id") % 3
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(k == 0, query_).when(k == 1, "?refresh=7").otherwise("?refreshed=1&refresh"))
    return table(spark, sf, "pages").select("page_id", scalars.strip_query_param(url).alias("stripped"))


@query("""SELECT DISTINCT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE CAST(l_linenumber AS VARCHAR) || '.0' END AS shown,
 round(l_linenumber * 365 + CAST(l_linenumber AS DOUBLE) * (365.0 / 12) + l_linenumber, 6) AS days FROM lineitem""", plain=True)
def number_forms(spark, sf):
    n = F.col("l_linenumber")
    x = F.when(n % 4 == 0, F.lit(float("nan"))).when(n % 4 == 1, F.lit(float("inf"))).when(n % 4 == 2, F.lit(float("-inf"))).otherwise(n.cast("double"))
    li = table(spark, sf, "lineitem").select("l_orderkey", n, scalars.json_number(x).alias("shown"), F.round(scalars.duration_days(n, n, n), 6).alias("days"))
    return li.distinct()


@query("""SELECT contract_id, asset_id || '-r' || sha256('["' || contract_id || '","sha",7]')[1:12] AS new_id, asset_id || '-r' || sha256('["' || contract_id || '","sha","7.2"]')[1:12] AS salted,
 'reading-' || sha256('["' || asset_id || '","decisions",7]')[1:20] AS event, 'news-' || sha256('"' || contract_id || '"')[1:20] AS title, 'event-' || sha256('["' || client || '",null,"' || region || '"]')[1:20] AS grouped FROM contracts""")
def contract_identities(spark, sf):
    c, sha, n = F.col("contract_id"), F.lit("sha"), F.lit(7)
    return contracts(spark, sf).select(
        c, hashes.new_contract_id(F.col("asset_id"), c, sha, n).alias("new_id"), hashes.new_contract_id(F.col("asset_id"), c, sha, n, F.lit(2)).alias("salted"), hashes.decision_event_id(F.col("asset_id"), F.lit("decisions"), n).alias("event"),
        hashes.title_event_id(c).alias("title"), hashes.group_event_id(F.col("client"), F.lit(None).cast("string"), F.col("region")).alias("grouped"),
    )


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN sha256('{"a":' || CAST(event_id AS VARCHAR) || ',"b":["' || event_type || '",null]}') WHEN 1 THEN sha256('[' || CAST(user_id AS VARCHAR) || ']') END AS digest FROM events""", plain=True)
def payload_hashes(spark, sf):
    """Hashes of JSON texts whose keys stand in another order and with spaces, of lists, and of what is no JSON."""
    k = F.col("event_id") % 3
    whole = F.concat(F.lit('{"b" : ["'), "event_type", F.lit('", null], "a": '), F.col("event_id").cast("string"), F.lit("}"))
    payload = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("[ "), F.col("user_id").cast("string"), F.lit("]"))).otherwise("{")
    return table(spark, sf, "events").select("event_id", hashes.canonical_hash(payload).alias("digest"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN sha256('%PDF-1.4 ' || html) ELSE sha256('text of ' || url) END AS fingerprint FROM pages""", plain=True)
def content_fingerprints(spark, sf):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("%PDF-1.4 "), "html")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", hashes.content_fingerprint(raw, F.concat(F.lit("text of "), "url")).alias("fingerprint"))


GOOD_ROW = '"startDate":"2027-01-01","endDate":"2027-02-01","dayRate":5,"client":"C","region":"R","status":"Firm"'
GOOD_READING = '"valueUsd":100,"baseDurationDays":10'


def _item(vessel: str = '"@"', contract: str = "null", action: str = '"upsert"', row: str | None = None, reading: str = GOOD_READING, **changed: str) -> str:
    body = GOOD_ROW if row is None else row
    for name, value in changed.items():
        body = ",".join(f'"{name}":{value}' if part.startswith(f'"{name}"') else part for part in body.split(","))
    inner = row if row is not None and not row.startswith('"') else f'{{{body},"interpretation":{{{reading}}}}}'
    return f'{{"vesselId":{vessel},"contractId":{contract},"action":{action},"row":{inner}}}'


#: Items of each kind, @ for the asset's id, and the reason why each is held.
BAD_ITEMS = [
    ("3", "decision must be an object"), ('["x"]', "decision must be an object"), (_item(vessel='"none"'), "asset is not registered for this company"), (_item(vessel="7"), "asset is not registered for this company"),
    (_item(action='"delete"'), "action is invalid"), (_item(action="null"), "action is invalid"), (_item(contract='"unknown"'), "contractId is no contract of the asset"), (_item(contract="7", action='"no-change"'), "contractId is no contract of the asset"),
    (_item(action='"withdraw"'), "withdraw requires contractId"), (_item(row="null"), "upsert requires a row"), (_item(row="[]"), "upsert requires a row"), (_item(startDate='"2027-02-30"'), "row.startDate is no real date"),
    (_item(startDate="20270101"), "row.startDate is no real date"), (_item(endDate='"2027-2-1"'), "row.endDate is no real date"), (_item(startDate='"2027-03-01"'), "row.startDate is after row.endDate"),
    (_item(dayRate='"5"'), "row.dayRate must be a number of at least 0"), (_item(dayRate="true"), "row.dayRate must be a number of at least 0"), (_item(dayRate="-1"), "row.dayRate must be a number of at least 0"),
    (_item(dayRate="1e400"), "row.dayRate must be a number of at least 0"), (_item(client='" "'), "row.client is blank"), (_item(region="null"), "row.region is blank"), (_item(status='"Maybe"'), "row.status is invalid"),
    (_item(reading='"termText":4'), "interpretation.termText must be text"), (_item(reading='"awardType":"gift"'), "interpretation.awardType is invalid"), (_item(reading='"valueUsd":"100"'), "interpretation.valueUsd must be a number of at least 0"),
    (_item(reading='"baseDurationDays":0'), "interpretation.baseDurationDays must be a number above 0"), (_item(reading='"includes":[1]'), "interpretation.includes must be a list of text"), (_item(reading='"excludes":"x"'), "interpretation.excludes must be a list of text"),
    (_item(row=GOOD_ROW).replace(f'{{{GOOD_READING}}}', "[]"), "interpretation must be an object"), (_item(), None), (_item(reading='"valueUsd":null,"includes":[]'), None), (_item(action='"hold"', row="null"), None),
]


def _case(of: str, values: list[str | None]) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def _pick(k: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


@query(f" SELECT asset_id, CAST(k AS INT) AS k, {_case('k', [r for _, r in BAD_ITEMS])} AS hold_reason FROM assets, (SELECT unnest(range({len(BAD_ITEMS)})) AS k)")
def held_decisions(spark, sf):
    """For every asset one response with an item of each kind."""
    items = F.replace(F.lit(",".join(i for i, _ in BAD_ITEMS)), F.lit("@"), F.col("asset_id"))
    a = assets(spark, sf)
    r = a.select(F.col("asset_id").alias("job_id"), "company", F.concat(F.lit('{"vesselUpdates":[],"decisions":['), items, F.lit("]}")).alias("payload"))
    d = decisions.validate_decisions(r, a, periods(spark, sf), CONTRACT_STATES)
    return d.select(F.col("job_id").alias("asset_id"), F.col("index").cast("int").alias("k"), "hold_reason")


BAD_UPDATES = [
    ("3", "update must be an object"), ('{"vesselId":"none","status":"Idle","statusAsOf":"1999-06-30"}', "asset is not registered for this company"), ('{"vesselId":"@","status":"Sold","statusAsOf":"1999-06-30"}', "status is invalid"),
    ('{"vesselId":"@","status":true,"statusAsOf":"1999-06-30"}', "status is invalid"), ('{"vesselId":"@","status":"Idle","statusAsOf":"1999-06-31"}', "statusAsOf must be a real date"), ('{"vesselId":"@","status":"Idle"}', "statusAsOf must be a real date"),
    ('{"vesselId":"@","status":"Idle","statusAsOf":"1999-06-30"}', None),
]


@query(f" SELECT asset_id, CAST(k AS INT) AS k, {_case('k', [r for _, r in BAD_UPDATES])} AS hold_reason FROM assets, (SELECT unnest(range({len(BAD_UPDATES)})) AS k)")
def held_updates(spark, sf):
    items = F.replace(F.lit(",".join(i for i, _ in BAD_UPDATES)), F.lit("@"), F.col("asset_id"))
    a = assets(spark, sf)
    r = a.select(F.col("asset_id").alias("job_id"), "company", F.concat(F.lit('{"decisions":[],"vesselUpdates":['), items, F.lit("]}")).alias("payload"))
    return decisions.validate_updates(r, a, ASSET_STATES).select(F.col("job_id").alias("asset_id"), F.col("index").cast("int").alias("k"), "hold_reason")


@query(f" SELECT job_id, reject_reason, report_date, hold_reason FROM (SELECT asset_id AS job_id, CAST(asset_id AS BIGINT) % 6 AS k FROM assets), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS j, "
       "unnest(['response is not JSON', 'response must be an object', 'decisions and vesselUpdates must be arrays', NULL, NULL, NULL]) AS reject_reason, unnest([NULL, NULL, NULL, '1999-06-30', NULL, NULL]) AS report_date, "
       "unnest([NULL, NULL, NULL, NULL, 'reportDate is no real date', NULL]) AS hold_reason) WHERE j = k")
def response_envelopes(spark, sf):
    lists = '"decisions":[],"vesselUpdates":[]'
    texts = ['{"decisions":[],"vesselUpdates":[],"x":NaN}', "[]", '{"decisions":{},"vesselUpdates":[]}', f'{{"reportDate":"1999-06-30",{lists}}}', f'{{"reportDate":"1999-06-31",{lists}}}', f'{{"reportDate":null,{lists}}}']
    r = assets(spark, sf).select(F.col("asset_id").alias("job_id"), "company", _pick(F.col("asset_id").cast("long") % 6, texts).alias("payload"))
    e = decisions.envelopes(r).select("job_id", "reject_reason")
    return e.join(decisions.report_dates(r).withColumn("report_date", F.date_format("report_date", "yyyy-MM-dd")), "job_id", "left").select("job_id", "reject_reason", "report_date", "hold_reason")


def _turns(spark, sf) -> DataFrame:
    """Decisions of one document per asset: contingent contracts are proposed anew without an id, options withdrawn, firm ones held."""
    c = periods(spark, sf)
    lists = c.select("asset_id", F.struct("contract_id", "asset_id", "start_date", "end_date", "status").alias("x")).groupBy("asset_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def item(x):
        body = F.concat(F.lit('{"startDate":"'), F.date_format(x["start_date"], "yyyy-MM-dd"), F.lit('","endDate":"'), F.date_format(x["end_date"], "yyyy-MM-dd"), F.lit('","dayRate":1,"client":"New","region":"R","status":"Firm"}'))
        new = x["status"] == "Contingent"
        named = F.when(new, "null").otherwise(F.concat(F.lit('"'), x["contract_id"], F.lit('"')))
        action = F.when(new, "upsert").when(x["status"] == "Option", "withdraw").otherwise("hold")
        return F.concat(F.lit('{"vesselId":"'), x["asset_id"], F.lit('","reasonKo":"why","contractId":'), named, F.lit(',"action":"'), action, F.lit('","row":'), F.when(new, body).otherwise("null"), F.lit("}"))

    payload = F.concat(F.lit('{"vesselUpdates":[],"decisions":['), F.array_join(F.transform("xs", item), ","), F.lit("]}"))
    r = assets(spark, sf).join(lists, "asset_id").select(F.concat(F.lit("job-"), "asset_id").alias("job_id"), "company", payload.alias("payload"))
    d = decisions.validate_decisions(r, assets(spark, sf), c, CONTRACT_STATES)
    return d.withColumns({"source_id": F.concat(F.lit("source-"), "job_id"), "document_sha256": F.sha2("job_id", 256), "kind": F.lit("official-news"), "url": F.lit("https://news.example.com/"), "published_at": F.lit("1999-06-30")})


_NEW_ID = """asset_id || '-r' || sha256('["source-' || job_id || '","' || sha256(job_id) || '",' || CAST(index AS VARCHAR) || ']')[1:12]"""


@query(DECISIONS + f""" SELECT CASE WHEN status = 'Contingent' AND side = 1 THEN {_NEW_ID} ELSE contract_id END AS contract_id, asset_id, CASE WHEN side = 1 THEN 'New' ELSE client END AS client, CASE WHEN side = 1 THEN true END AS news_reviewed,
 CASE WHEN side = 0 THEN status ELSE 'Firm' END AS status FROM decided, (SELECT unnest([0, 1]) AS side) WHERE status <> 'Option' AND (side = 0 OR status = 'Contingent')""")
def new_contracts(spark, sf):
    c = contracts(spark, sf)
    return apply.apply_decisions(assets(spark, sf), c, _turns(spark, sf)).contracts.select("contract_id", "asset_id", "client", "news_reviewed", "status")


@query(DECISIONS + f""" SELECT job_id, index, CASE status WHEN 'Contingent' THEN {_NEW_ID} ELSE contract_id END AS contract_id, CASE status WHEN 'Contingent' THEN 'applied' WHEN 'Option' THEN 'applied' ELSE 'conflict' END AS review_status,
 'reading-' || sha256('["' || job_id || '","decisions",' || CAST(index AS VARCHAR) || ']')[1:20] AS event_id, CASE WHEN status = 'Firm' THEN 'why' END AS held, CASE WHEN status = 'Option' THEN client END AS was FROM decided""")
def decision_records(spark, sf):
    """Events, holds and changes of the same documents."""
    done = apply.apply_decisions(assets(spark, sf), contracts(spark, sf), _turns(spark, sf), store=kept)
    changes = done.changes.select("job_id", "index", F.col("contract_id").alias("_c"), F.col("before.client").alias("was"))
    holds = done.holds.select("job_id", "index", F.col("contract_id").alias("_h"), F.col("hold_reason").alias("held"))
    e = done.events.select("job_id", "index", "review_status", "event_id").join(changes, ["job_id", "index"], "left").join(holds, ["job_id", "index"], "left")
    return e.select("job_id", F.col("index").cast("int").alias("index"), F.coalesce("_c", "_h").alias("contract_id"), "review_status", "event_id", "held", "was")


@query(f"WITH {JOURNAL} SELECT 'news-' || sha256('\"' || source_id || '\"')[1:20] AS event_id, job_id, title, 'acknowledged' AS review_status FROM journal WHERE kind = 'official-news' AND title <> 'click'", plain=True)
def title_events(spark, sf):
    """Articles of which only clicks led to an event of their own."""
    j = journal(spark, sf)
    return apply.title_events(j, j.where("title = 'click'")).select("event_id", "job_id", "title", "review_status")


@query(f"WITH {JOURNAL} SELECT job_id, title FROM journal WHERE kind = 'official-news' AND k % 3 = 0", plain=True)
def triage_select(spark, sf):
    chosen = announcements(spark, sf).where("k % 3 = 0").select(F.col("event_id").alias("job_id"))
    return feed.triage_select(journal(spark, sf).where("kind = 'official-news'"), chosen.union(chosen)).select("job_id", "title")


def _with_holds(j: DataFrame) -> DataFrame:
    return j.withColumn("open_holds", F.when(F.col("title") == "error", F.array(F.concat(F.lit("late "), "url"), F.lit("odd"))).otherwise(F.array().cast("array<string>")))


@query(f"WITH {JOURNAL} SELECT job_id, unnest(['late ' || url, 'odd']) AS hold FROM journal WHERE title = 'error' AND company = 'C1' AND job_id <> '7'", plain=True)
def company_holds(spark, sf):
    return jobs.company_holds(_with_holds(journal(spark, sf)), "7", "C1")


@query(f"""WITH {JOURNAL} SELECT job_id, CASE WHEN title = 'error' AND (company NOT IN (SELECT company FROM journal WHERE title = 'signup' AND company <> 'C2')) THEN 2 ELSE 0 END AS holds FROM journal""", plain=True)
def cleared_holds(spark, sf):
    """Signups were read, with success but for one company."""
    j = _with_holds(journal(spark, sf))
    outcomes = j.where("title = 'signup'").select("job_id", F.when(F.col("company") == "C2", "failed").otherwise("applied").alias("outcome"))
    return apply.clear_holds(j, outcomes).select("job_id", F.size("open_holds").alias("holds"))


@query(f"""WITH {FEED} SELECT CASE WHEN title = 'purchase' THEN 'derived rate' ELSE 'hold with row' END AS rule, event_id AS id FROM feed WHERE (title = 'purchase' AND k % 2 = 0) OR (title = 'error' AND k % 2 = 1)""", plain=True)
def published_violations(spark, sf):
    e = announcements(spark, sf)
    rates = e.where("title = 'purchase'").select(F.col("event_id").alias("contract_id"), F.when(F.col("k") % 2 == 0, F.lit(0.0)).otherwise(F.lit(2.5)).alias("derived_usd_per_day"))
    held = e.select("event_id", F.when(F.col("title") == "error", "hold").otherwise("upsert").alias("action"), (F.col("k") % 2 == 1).alias("has_row"))
    return quality.published_violations(rates, held)


@query(" SELECT 'contracts' AS check, count(*) + 1 AS expected, count(*) AS found FROM contracts")
def manifest_violations(spark, sf):
    """A manifest that counts one contract too many."""
    n = F.count("*")
    counts = assets(spark, sf).agg(n.alias("assets")).join(contracts(spark, sf).agg(n.alias("contracts")), F.lit(True))  # one row each
    return quality.manifest_violations(counts.withColumn("contracts", F.col("contracts") + 1), counts)


@query(f"""WITH {FEED} SELECT event_id, CASE k % 3 WHEN 0 THEN 'new ' || event_id WHEN 1 THEN 'old ' || event_id END AS interpretation FROM feed""", plain=True)
def event_interpretation(spark, sf):
    """The row's interpretation, else that of older facts."""
    k, text = F.col("k") % 3, lambda w: F.concat(F.lit(w), "event_id")
    decision = F.struct(F.struct(F.when(k == 0, text("new ")).alias("interpretation")).alias("row"), F.struct(F.when(k <= 1, text("old ")).alias("interpretation")).alias("facts"))
    e = announcements(spark, sf).select("event_id", "k").withColumn("decision", decision)
    return e.select("event_id", feed.event_interpretation(e).alias("interpretation"))


_KEY = "CAST(split_part(contract_id, '-', 1) AS BIGINT)"


@query(f""", a AS (SELECT CAST(asset_id AS BIGINT) % 7 AS k FROM assets), c AS (SELECT {_KEY} % 13 AS k, {_KEY} % 26 AS j FROM contracts)
SELECT rule, n FROM (
 SELECT 'generation' AS rule, count(*) AS n FROM a WHERE k = 1 UNION ALL SELECT 'asset status', count(*) FROM a WHERE k = 2 UNION ALL SELECT 'year built', count(*) FROM a WHERE k = 3 UNION ALL SELECT 'status date', count(*) FROM a WHERE k = 4
 UNION ALL SELECT 'contract id', count(*) FILTER (k = 0) + (count(*) FILTER (k = 0) > 1)::INT + count(*) FILTER (k = 11) FROM c
 UNION ALL SELECT 'contract status', count(*) FROM c WHERE k = 1 UNION ALL SELECT 'dates', count(*) FROM c WHERE k IN (2, 3) UNION ALL SELECT 'rate', count(*) FROM c WHERE k IN (4, 5) UNION ALL SELECT 'client', count(*) FROM c WHERE k = 6
 UNION ALL SELECT 'region', count(*) FROM c WHERE k = 7 UNION ALL SELECT 'number', count(*) FROM c WHERE k = 8 UNION ALL SELECT 'parent', count(*) FILTER (k = 9) + 2 * count(*) FILTER (k = 10) FROM c
 UNION ALL SELECT 'asset count', 1 UNION ALL SELECT 'registry', count(*) FROM assets WHERE asset_id = '1' UNION ALL SELECT 'company count', 1) WHERE n > 0""")
def fault_counts(spark, sf):
    """Tables with a fault of every kind: assets by their number, contracts by their order's; the registry has one asset twice, and one class of contracts is given twice."""
    n, order = F.col("asset_id").cast("long") % 7, F.split("contract_id", "-")[0].cast("long") % 13
    a = assets(spark, sf).withColumns({"generation": F.when(n == 1, "9G").otherwise(F.col("generation")), "status": F.when(n == 2, "Sold").otherwise(F.col("status")), "year_built": F.when(n != 3, F.col("year_built"))})
    a = a.withColumns({"status_as_of_text": F.when(n == 4, "1999-02-30").otherwise(F.date_format("status_as_of", "yyyy-MM-dd")), "status_as_of": F.when(n != 4, F.col("status_as_of"))})
    c = contracts(spark, sf).withColumn("k", order)
    k = F.col("k")
    c = c.withColumns(
        {
            "vessel_id": F.when(k.isin(9, 10), "none").otherwise(F.col("asset_id")), "status": F.when(k == 1, "Maybe").otherwise(F.col("status")), "start_date": F.when(k != 2, F.col("start_date")),
            "end_date": F.when(k == 3, F.date_sub("start_date", 1)).otherwise(F.col("end_date")), "day_rate": F.when(k == 4, F.lit(float("nan"))).when(k == 5, F.lit(-1.0)).otherwise(F.col("day_rate")),
            "client": F.when(k == 6, " ").otherwise(F.col("client")), "region": F.when(k != 7, F.col("region")), "value_usd": F.when(k == 8, F.lit(float("inf"))).otherwise(F.col("value_usd")),
            "asset_id": F.when(k == 10, "gone").otherwise(F.col("asset_id")), "contract_id": F.when(k == 0, "").otherwise(F.col("contract_id")),
        }
    )
    c = c.withColumn("_twice", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 11, 2).otherwise(1))))
    registered = assets(spark, sf).withColumn("generation", F.when(n == 1, "9G").otherwise(F.col("generation")))
    registered = registered.unionByName(registered.where("asset_id = '1'"))
    found = quality.integrity_violations(a, c.drop("k", "_twice"), registered, GENERATIONS, ASSET_STATES, CONTRACT_STATES)
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(""" SELECT contract_id, asset_id, start_date, end_date, day_rate, client, region, status, value_usd, base_days, a.name FROM contracts JOIN assets AS a USING (asset_id, status) UNION ALL
 SELECT contract_id, asset_id, start_date, end_date, day_rate, client, region, c.status, value_usd, base_days, a.name FROM contracts AS c JOIN assets AS a USING (asset_id) WHERE c.status <> a.status""", dates="start_date end_date")
def fleet_files(spark, sf):
    """The model's tables nested, written as a fleet file, read again and flattened."""
    path = _folder(spark)
    snapshots.export_fleet(snapshots.nest(assets(spark, sf), contracts(spark, sf)), path, "gzip")
    rows = snapshots.flatten(snapshots.import_fleet(spark, path), ("name",))[1]
    return rows.select("contract_id", "asset_id", "start_date", "end_date", "day_rate", "client", "region", "status", "value_usd", "base_days", "name")


@query(""" SELECT 'assets' AS "check", true AS ok, count(*) AS rows FROM assets UNION ALL SELECT 'contracts', true, count(*) FROM contracts""")
def published_snapshot(spark, sf):
    """Published, published again with other assets and the contracts of the first snapshot, pruned, verified, and loaded against a seed that must not be
    taken."""
    path, a = _folder(spark), assets(spark, sf)
    snapshots.publish({"assets": a.where("company <> 'C3'"), "contracts": contracts(spark, sf)}, path)
    manifest = snapshots.publish({"assets": a, "contracts": snapshots.load_table(spark, path, "contracts")}, path)
    snapshots.prune(spark, path)
    loaded = snapshots.load_snapshot(spark, path, {}, {n: m["rows"] for n, m in manifest.items()})
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("check"), "rows") for n, df in loaded.items()]
    return snapshots.verify(spark, path).join(counts[0].union(counts[1]), "check")


@query()
def snapshot_fingerprint(spark, sf):
    """The state's fingerprint, from the manifest of a published snapshot."""
    path = _folder(spark)
    snapshots.publish({"assets": assets(spark, sf), "contracts": contracts(spark, sf)}, path)
    return snapshots.state_fingerprint(snapshots.read_manifest(spark, path))


def _captured(spark, sf) -> DataFrame:
    """The documents' file as a stream of captures, four revisions to a source."""
    d = table(spark, sf, "documents")
    s = spark.readStream.schema(d.schema).parquet(f"{sf}/documents.parquet*")
    source = F.concat(F.lit("source-"), F.floor(F.col("doc_id") / 4).cast("string"))
    return s.select(source.alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_sha256"), F.col("doc_id").cast("string").alias("captured_at"))


_SOURCES = "WITH s AS (SELECT 'source-' || CAST(doc_id // 4 AS VARCHAR) AS source_id, sha256(coalesce(text, '')) AS document_sha256, CAST(doc_id AS VARCHAR) AS captured_at FROM documents)"


@query(_SOURCES + " SELECT DISTINCT source_id, document_sha256, 'pending' AS status FROM s", plain=True)
def revision_stream(spark, sf):
    """Streamed twice into one table, which takes each revision once."""
    path = _folder(spark)
    for k in range(2):
        streams.revision_stream(_captured(spark, sf), f"{path}/table", f"{path}/checkpoint{k}").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("source_id", "document_sha256", "status")


@query(" SELECT generation, contract_id, CAST(row_number() OVER (PARTITION BY generation ORDER BY start_date, contract_id) AS INT) AS place FROM observations")
def observation_order(spark, sf):
    """Each observation's place among those of its class, in the order in which they are shown."""
    o = observations.in_order(observations.rate_observations(assets(spark, sf), periods(spark, sf)))
    return jobs.numbered(o, "generation", [F.col("start_date"), F.col("contract_id")], "place").select("generation", "contract_id", "place")


_STATES = ["degraded-preserved", "reading-pending", "reading-failed", "held", "healthy", "degraded-preserved"]


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS company, {_case('s_suppkey % 6', _STATES)} AS health, CASE s_suppkey % 6 WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' WHEN 4 THEN 'completed' WHEN 5 THEN 'completed' ELSE 'pending' END AS reading_status,
 CASE WHEN s_suppkey % 4 = 0 THEN 'degraded-preserved' ELSE 'healthy' END AS news_monitor, CASE WHEN s_suppkey % 6 IN (0, 1) THEN 'before' ELSE 'read' END AS report_date, CASE s_suppkey % 6 WHEN 5 THEN 'broken' WHEN 0 THEN 'lost' END AS error FROM supplier""", plain=True)
def source_states(spark, sf):
    """Suppliers as companies, in each state that a report source can be in."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("company"), (F.col("s_suppkey") % 6).alias("k"), (F.col("s_suppkey") % 4).alias("j"))
    k, source = F.col("k"), F.concat(F.lit("source-"), "company")
    reports = s.where("k <> 0").select("company", source.alias("source_id"), F.lit("sha").alias("document_sha256"), F.when(k == 5, "broken").alias("error"))
    status = F.when(k == 2, "failed").otherwise("completed")
    docs = s.where("k >= 2").select(hashes.job_id(source, F.lit("sha")).alias("job_id"), source.alias("source_id"), F.lit("fleet-report").alias("kind"), status.alias("status"), F.when(k == 3, "held").otherwise("applied").alias("outcome"), F.lit("read").alias("report_date"))
    lost = s.where("k = 0").select("company", F.lit("fleet-report").alias("kind"), F.lit("fetch").alias("phase"), F.lit("lost").alias("error"))
    errors = lost.union(s.where("j = 0").select("company", F.lit("official-news"), F.lit("discovery"), F.lit("no list")))
    return jobs.source_health(s.select("company"), reports, docs, errors, s.select("company", F.lit("before").alias("report_date")))


@query(f"""WITH {JOURNAL} SELECT 'some ready' AS "case", 0 AS retry_after UNION ALL SELECT 'all wait', min(next_attempt_after) FROM journal WHERE status <> 'completed' UNION ALL SELECT 'usage', 1700009999 UNION ALL SELECT 'none open', 0""", plain=True)
def retry_cases(spark, sf):
    """When to go on: with some jobs ready, with all waiting, while usage is limited, and with nothing to do."""
    j = journal(spark, sf)
    last = 1_700_000_000
    cases = [("some ready", jobs.retry_after(j, last)), ("all wait", jobs.retry_after(j, last - 1000)), ("usage", jobs.retry_after(j, last, last + 9999)), ("none open", jobs.retry_after(j.where("status = 'completed'"), last))]
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("case"), "retry_after") for name, df in cases])


@query("""SELECT page_id, page_id % 8 IN (0, 5) AS official FROM pages""", plain=True)
def official_places(spark, sf):
    """Pages at places of their company, and at places that look like it: other schemes, hosts, ports, users, paths and owners."""
    k, n = F.col("page_id") % 8, F.col("page_id").cast("string")
    heads = ["https://news.example.com/en/", "http://news.example.com/en/", "https://news.example.com.evil.org/en/", "https://news.example.com:8443/en/", "https://user@news.example.com/en/", "https://NEWS.example.com:443/en/", "https://news.example.com/de/", "https://other.example.com/en/"]
    p = table(spark, sf, "pages").select("page_id", F.lit("C0").alias("company"), F.concat(_pick(k, heads), n).alias("url"))
    rules = spark.createDataFrame([("C0", "news.example.com", "^/en/"), ("C1", "other.example.com", None)], "company string, host string, path_pattern string")
    return documents.official_source(p, rules).select("page_id", "official")
