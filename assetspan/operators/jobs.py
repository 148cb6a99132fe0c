"""Documents, their revisions and the backlog of jobs.

documents: job_id, source_id, company, kind, url, title, published_at, document_sha256, status (pending, failed, completed), outcome,
failure_count, next_attempt_after (epoch seconds), last_success_at, last_read_at, last_error, selected, report_date.
captures: source_id, company, kind, url, title, published_at, document_sha256, raw_sha256, legacy_sha256, final_url.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetspan.functions.hashes import canonical_hash, job_id, tree_digest
from assetspan.functions.scalars import backoff_seconds
from assetspan.session import cut

USAGE_WAIT = 3600


def is_open() -> Column:
    return F.col("status") != "completed"


def is_ready(now: int) -> Column:
    """Open, and the wait is over."""
    return is_open() & (F.coalesce("next_attempt_after", F.lit(0)) <= now)


def handled(captures: DataFrame, report_hashes: DataFrame, article_urls: DataFrame, article_hashes: DataFrame) -> DataFrame:
    """Captures that an older pipeline dealt with: reports by (company, either hash), news by either URL or the older text hash."""
    report, news = captures.where("kind = 'fleet-report'"), captures.where("kind = 'official-news'")
    by_hash = report.select("*", F.explode(F.array_compact(F.array("document_sha256", "raw_sha256"))).alias("_k")).join(report_hashes.select("company", F.col("sha256").alias("_k")).distinct(), ["company", "_k"], "left_semi")
    by_url = news.select("*", F.explode(F.array_compact(F.array("url", "final_url"))).alias("_k")).join(article_urls.select(F.col("url").alias("_k")).distinct(), "_k", "left_semi")
    by_text = news.withColumn("_k", F.col("legacy_sha256")).join(article_hashes.select(F.col("sha256").alias("_k")).distinct(), "_k", "left_semi")
    return reduce(DataFrame.unionByName, [by_hash, by_url, by_text]).drop("_k").dropDuplicates(["source_id", "document_sha256"])


def latest_captures(captures: DataFrame) -> DataFrame:
    """One capture per (source_id, document_sha256), the least of equal ones."""
    rest = [c for c in captures.columns if c not in ("source_id", "document_sha256")]
    return captures.groupBy("source_id", "document_sha256").agg(F.min(F.struct(*rest)).alias("c")).select("source_id", "document_sha256", "c.*")


def register(documents: DataFrame, captures: DataFrame, handled_before: DataFrame, now: str) -> DataFrame:
    """documents after the captures: known revisions are touched, news that was excluded stays out, first sightings of handled sources
    are completed as migrated, all else is pending and takes the place of older open revisions of its source."""
    c = latest_captures(captures).withColumn("job_id", job_id(F.col("source_id"), F.col("document_sha256")))
    sources = documents.groupBy("source_id").agg(F.bool_or(F.coalesce(F.col("outcome") == "excluded", F.lit(False))).alias("excluded"))
    fresh = c.join(documents.select("job_id"), "job_id", "left_anti").join(sources, "source_id", "left")
    fresh = fresh.where(~((F.col("kind") == "official-news") & F.coalesce("excluded", F.lit(False))))
    done = handled_before.select("source_id", "document_sha256", F.lit(True).alias("_done")).distinct()
    fresh = fresh.join(done, ["source_id", "document_sha256"], "left").withColumn("_migrated", F.col("excluded").isNull() & F.coalesce("_done", F.lit(False)))
    new = fresh.select(
        "job_id", "source_id", "company", "kind", "url", "title", "published_at", "document_sha256",
        F.when(F.col("_migrated"), "completed").otherwise("pending").alias("status"), F.when(F.col("_migrated"), "migrated").alias("outcome"),
        F.lit(0).alias("failure_count"), F.lit(0).cast("long").alias("next_attempt_after"), F.lit(now).alias("last_success_at"),
    )
    seen = c.select("job_id", F.col("title").alias("_title"), F.col("published_at").alias("_published"), F.lit(True).alias("_seen"))
    kept = documents.join(seen, "job_id", "left")
    kept = kept.withColumns(
        {
            "title": F.coalesce("title", "_title"),
            "published_at": F.coalesce("published_at", "_published"),
            "last_success_at": F.when(F.col("_seen"), F.lit(now)).otherwise(F.col("last_success_at")),
        }
    ).drop("_title", "_published", "_seen")
    replaced = kept.where(is_open()).join(new.select("source_id").distinct(), "source_id", "left_semi").select("job_id")
    return kept.join(replaced, "job_id", "left_anti").unionByName(new, allowMissingColumns=True)


def previous_sources(documents: DataFrame) -> DataFrame:
    """Per source the facts of its last success."""
    order = F.struct(F.coalesce("last_success_at", F.lit("")), F.coalesce("last_read_at", F.lit("")), "job_id")
    best = documents.groupBy("source_id").agg(F.max_by(F.struct("last_success_at", "document_sha256", "title", "published_at"), order).alias("f"))
    return best.select("source_id", "f.*")


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... within each group in the given order, however large a group is.

    Rows are sorted into ranges over all tasks and numbered inside each range; counts per range, a row for each group and range, give
    what to add.  The order must be total, or equal rows are numbered in any order.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = cut(df.withColumns(keys).repartitionByRange(group, *keys).withColumn("_slice", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_group"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*keys))
    ranked = ranged.withColumn("_in", inside).join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of")))
    return ranked.withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).select(*df.columns, name)


def reading_order(documents: DataFrame) -> DataFrame:
    """documents with `round`: reports first, then articles, stored results last, by date and URL, counted within each company."""
    rank = F.when(F.col("input_mode") == "stored-result", 2).when(F.col("kind") == "fleet-report", 0).otherwise(1)
    return numbered(documents, "company", [rank, F.col("published_at"), F.col("url"), F.col("job_id")], "round")


def settle(documents: DataFrame, results: DataFrame, now: int, now_iso: str) -> DataFrame:
    """documents after results (job_id, result: completed, failed or usage-limited, outcome, error, retry_at)."""
    d = documents.join(results.select("job_id", F.col("result").alias("_r"), F.col("outcome").alias("_o"), F.col("error").alias("_e"), F.col("retry_at").alias("_t")), "job_id", "left")
    done, failed, limited = (F.coalesce(F.col("_r") == x, F.lit(False)) for x in ("completed", "failed", "usage-limited"))
    failures = F.coalesce("failure_count", F.lit(0)) + F.when(failed, 1).otherwise(0)
    wait = F.when(done, 0).when(failed, now + backoff_seconds(failures)).when(limited, F.greatest(F.coalesce("_t", F.lit(now + USAGE_WAIT)), F.lit(now))).otherwise(F.col("next_attempt_after"))
    return d.withColumns(
        {
            "status": F.when(done, "completed").when(failed, "failed").otherwise(F.col("status")),
            "outcome": F.when(done, F.col("_o")).otherwise(F.col("outcome")),
            "last_read_at": F.when(done, F.lit(now_iso)).otherwise(F.col("last_read_at")),
            "last_error": F.when(done, F.lit(None)).when(failed | limited, F.col("_e")).otherwise(F.col("last_error")),
            "failure_count": failures,
            "next_attempt_after": wait.cast("long"),
        }
    ).drop("_r", "_o", "_e", "_t")


def job_backlog(documents: DataFrame) -> DataFrame:
    """Open jobs; the published fingerprint of a small backlog is backlog_fingerprint()."""
    return documents.where(is_open()).select("job_id", "kind", "company", "url", "document_sha256")


def backlog_fingerprint(backlog: DataFrame) -> DataFrame:
    """One row (pending, fingerprint) of a backlog small enough to be one JSON text."""
    jobs = F.array_sort(F.collect_list(F.struct(F.col("job_id").alias("jobId"), "kind", "company", "url", F.col("document_sha256").alias("documentSha256"))))
    return backlog.agg(F.count("*").alias("pending"), F.to_json(jobs).alias("j")).select("pending", canonical_hash("j").alias("fingerprint"))


def backlog_tree_fingerprint(backlog: DataFrame) -> DataFrame:
    """One row (pending, fingerprint) of a backlog of any size, by a hash tree over its jobs in order of their ids."""
    job = F.to_json(F.struct(F.col("job_id").alias("jobId"), "kind", "company", "url", F.col("document_sha256").alias("documentSha256")))
    leaves = numbered(backlog.select(F.lit(0).alias("g"), F.col("job_id").alias("k"), job.alias("leaf")), "g", [F.col("k"), F.col("leaf")], "n")
    return tree_digest(leaves.select((F.col("n") - 1).cast("long").alias("n"), "leaf")).select(F.col("rows").alias("pending"), F.col("digest").alias("fingerprint"))


def retry_after(documents: DataFrame, now: int, usage_until: int = 0) -> DataFrame:
    """One row: the end of a usage wait, else the first end of a wait if all open jobs wait, else 0."""
    wait = F.coalesce("next_attempt_after", F.lit(0))
    x = documents.where(is_open()).agg(F.bool_and(wait > now).alias("all"), F.min(wait).alias("first"))
    return x.select((F.lit(usage_until) if usage_until else F.when(F.coalesce("all", F.lit(False)), F.col("first")).otherwise(0)).cast("long").alias("retry_after"))


def limit_per_company(items: DataFrame, n: int = 20) -> DataFrame:
    """The n newest items of each company's listing."""
    rank = F.row_number().over(Window.partitionBy("company").orderBy(F.desc_nulls_last("published_at"), "url"))
    return items.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def newest_document(links: DataFrame) -> DataFrame:
    """Per company the link of the latest date; undated ones come last."""
    order = F.struct(F.coalesce("published_at", F.lit("")), "url")
    return links.groupBy("company").agg(F.max_by("url", order).alias("url"), F.max("published_at").alias("published_at"))


def dedupe_sources(captures: DataFrame, priority: str = "priority") -> DataFrame:
    """The first capture of each source by priority."""
    rest = [c for c in captures.columns if c not in ("source_id", priority)]
    return captures.groupBy("source_id").agg(F.min(F.struct(priority, *rest)).alias("c")).select("source_id", "c.*")


def candidate_union(*feeds: DataFrame) -> DataFrame:
    """Feeds of candidates one under the other, with `priority` as their order."""
    ranked = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def enqueue_stored(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """documents with a pending job for each stored review (source_id, company, kind, url, document_sha256) that has none."""
    r = reviews.withColumn("job_id", job_id(F.col("source_id"), F.col("document_sha256"))).dropDuplicates(["job_id"])
    new = r.join(documents.select("job_id"), "job_id", "left_anti").withColumns({"status": F.lit("pending"), "input_mode": F.lit("stored-result"), "failure_count": F.lit(0), "next_attempt_after": F.lit(0).cast("long")})
    return documents.unionByName(new, allowMissingColumns=True)


def requeue_changed(documents: DataFrame, recheck: DataFrame) -> DataFrame:
    """Open jobs whose source now has another hash (source_id, document_sha256) are replaced by one for that."""
    r = recheck.select("source_id", F.col("document_sha256").alias("_now")).dropDuplicates(["source_id"])
    moved = documents.where(is_open()).join(r, "source_id").where(~F.col("document_sha256").eqNullSafe(F.col("_now")))
    new = moved.withColumn("document_sha256", F.col("_now")).withColumn("job_id", job_id(F.col("source_id"), F.col("_now"))).withColumns({"status": F.lit("pending"), "failure_count": F.lit(0).cast(documents.schema["failure_count"].dataType), "next_attempt_after": F.lit(0).cast("long")})
    fresh = new.select(documents.columns).dropDuplicates(["job_id"]).join(documents.select("job_id"), "job_id", "left_anti")
    return documents.join(moved.select("job_id"), "job_id", "left_anti").unionByName(fresh)


def company_holds(documents: DataFrame, job: str, company: str) -> DataFrame:
    """Open holds of the company from documents other than the job's."""
    return documents.where((F.col("company") == company) & (F.col("job_id") != job)).select("job_id", F.explode("open_holds").alias("hold"))


def apply_triage(documents: DataFrame, events: DataFrame, verdicts: DataFrame, now_iso: str, default: str = "other") -> tuple[DataFrame, DataFrame]:
    """(documents, events) after verdicts (job_id, selected, category): what was not selected is completed as excluded, and listed by its title
    unless the feed has its (url, company)."""
    from assetspan.functions.hashes import title_event_id
    from assetspan.operators.feed import merge_events

    v = verdicts.select("job_id", F.col("selected").alias("_s"), F.col("category").alias("_c")).dropDuplicates(["job_id"])
    d = documents.join(v, "job_id", "left")
    out = F.coalesce(~F.col("_s"), F.lit(False))
    d = d.withColumns(
        {
            "status": F.when(out, "completed").otherwise(F.col("status")),
            "outcome": F.when(out, "excluded").otherwise(F.col("outcome")),
            "last_read_at": F.when(out, F.lit(now_iso)).otherwise(F.col("last_read_at")),
            "selected": F.coalesce("_s", "selected"),
            "news_category": F.coalesce("_c", "news_category"),
        }
    )
    titles = d.where(out).join(events.select("url", "company").distinct(), ["url", "company"], "left_anti").select(
        title_event_id(F.col("source_id")).alias("event_id"), "company", F.coalesce("title", "url").alias("title"), "url", "published_at", F.lit("official-news-signal").alias("classification"),
        F.lit("acknowledged").alias("review_status"), F.lit(False).alias("pending_review"), F.coalesce("news_category", F.lit(default)).alias("news_category"),
    )
    return d.drop("_s", "_c"), merge_events(events, titles.dropDuplicates(["event_id"]))


def source_health(companies: DataFrame, reports: DataFrame, documents: DataFrame, errors: DataFrame, prior: DataFrame) -> DataFrame:
    """Per company: report_date, health, reading_status, error.

    companies: company; reports: the newest report capture of each (company, source_id, document_sha256, error); errors: company, kind, phase, error; prior:
    company, report_date as last published.
    """
    r = reports.withColumn("job_id", job_id(F.col("source_id"), F.col("document_sha256"))).withColumnRenamed("error", "_re").withColumn("_got", F.lit(True))
    d = documents.where("kind = 'fleet-report'")
    dates = d.groupBy("source_id").agg(F.max("report_date").alias("_confirmed"))
    e = errors.where("kind = 'fleet-report'").groupBy("company").agg(F.min("error").alias("_ee"))
    news = errors.where("kind = 'official-news' and phase = 'discovery'").select("company").distinct().withColumn("_news", F.lit(True))
    x = companies.join(r.select("company", "source_id", "job_id", "_re", "_got"), "company", "left").join(d.select("job_id", "status", "outcome"), "job_id", "left").join(dates, "source_id", "left")
    x = x.join(e, "company", "left").join(news, "company", "left").join(prior.select("company", F.col("report_date").alias("_prior")), "company", "left")
    health = (
        F.when(F.col("_got").isNull() | F.col("_re").isNotNull(), "degraded-preserved")
        .when(F.col("status").isNull() | (F.col("status") == "pending"), "reading-pending")
        .when(F.col("status") == "failed", "reading-failed")
        .when(F.col("outcome") == "held", "held")
        .otherwise("healthy")
    )
    return x.select(
        "company", F.coalesce("_confirmed", "_prior").alias("report_date"), health.alias("health"), F.coalesce("status", F.lit("pending")).alias("reading_status"),
        F.when(F.col("_news"), "degraded-preserved").otherwise("healthy").alias("news_monitor"), F.coalesce("_re", "_ee").alias("error"),
    )


def assemble_lines(words: DataFrame, least_confidence: int = 60) -> DataFrame:
    """Recognised words (page, block, par, line, word, text, conf) -> (page, lines, reliable): lines of all words, in order.

    A page is reliable if at least one word with a letter reaches the confidence.
    """
    w = words.where(F.trim("text") != "")
    ok = w.groupBy("page").agg(F.bool_or((F.coalesce(F.col("conf"), F.lit(-1)) >= least_confidence) & F.col("text").rlike(r"\p{L}")).alias("reliable"))
    lines = w.groupBy("page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("line_text"))
    pages = lines.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "line_text"))), lambda x: x["line_text"]).alias("lines"))
    return pages.join(ok, "page")
