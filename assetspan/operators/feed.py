"""The disclosure feed: order, categories, facts, notes and merging.

events: event_id, company, url, title, published_at (text), classification, news_category, asset, review_status, pending_review, reviewed,
decision (struct of action, contract_id, row, reason, quote, locator, hold_reason; row a struct of period, rate, client,
region, interpretation), facts (struct of the older shape).  Columns that a feed lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspan.functions.hashes import group_event_id
from assetspan.functions.scalars import is_iso_date, nonempty, positive, reported_rate
from assetspan.operators.observations import economics

REPORT, CONTRACT, OTHER = "Fleet Status", "contract", "other"


def _path(events: DataFrame, path: str, kind: str = "string") -> Column:
    """A nested field where the feed has it, else null."""
    from pyspark.sql.types import StructType

    at = events.schema
    for part in path.split("."):
        if not isinstance(at, StructType) or part not in at.fieldNames():
            return F.lit(None).cast(kind)
        at = at[part].dataType
    return F.col(path)


def publication_day(published_at: Column) -> Column:
    """The day of a publication date; the epoch where there is no valid one."""
    day = F.substring(published_at, 1, 10)
    return F.when(is_iso_date(day), F.try_to_date(day, "yyyy-MM-dd")).otherwise(F.date_from_unix_date(F.lit(0)))


def ordered_events(events: DataFrame) -> DataFrame:
    """Newest first; `seq` is the order they came in and decides ties."""
    return events.withColumn("published_day", publication_day(F.col("published_at"))).orderBy(F.desc("published_day"), "seq")


def has_details(events: DataFrame) -> Column:
    reviewed = F.coalesce(_path(events, "reviewed", "boolean"), F.lit(False)) | _path(events, "decision.action").isNotNull()
    return reviewed & nonempty(_path(events, "asset"))


def news_category(events: DataFrame) -> Column:
    """The given tag, else by kind of event."""
    return F.coalesce(
        F.when(nonempty(_path(events, "news_category")), _path(events, "news_category")),
        F.when(_path(events, "classification") == "official-report-reading", REPORT),
        F.when(has_details(events), CONTRACT),
        F.lit(OTHER),
    )


def event_interpretation(events: DataFrame) -> Column:
    """What the decision's row says, else what the older facts say."""
    new, old = _path(events, "decision.row.interpretation", "string"), _path(events, "decision.facts.interpretation", "string")
    return F.coalesce(new, old)


def event_facts(events: DataFrame) -> DataFrame:
    """(event_id, fact, value): seven facts per event, the decision's row before the older facts; codes, not display texts.

    A fact that nothing tells is `undisclosed` where the event was read or reviewed, else `unknown`.
    """
    p = lambda path, kind="string": _path(events, path, kind)
    i, o, f = "decision.row.interpretation.", "decision.facts.interpretation.", "facts."
    text = lambda name: F.coalesce(p(i + name), p(o + name))
    some = lambda *cs: F.coalesce(*[F.when(nonempty(c.cast("string")), c.cast("string")) for c in cs])
    unknown = F.when(p("decision.action").isNotNull() | F.coalesce(p("reviewed", "boolean"), F.lit(False)), "undisclosed").otherwise("unknown")
    row_rate = reported_rate(p("decision.row.day_rate", "double"))
    old_rate = F.when((p(f + "day_rate_disclosure") == "reported") & positive(p(f + "day_rate_usd", "double")), p(f + "day_rate_usd", "double"))
    term = some(text("term_text"), p(f + "term_text"), F.concat(p(f + "award_term_years"), F.lit("y")), F.concat_ws("–", some(p(f + "expected_start")), some(p(f + "expected_end"))))
    facts = {
        "client": some(p("decision.row.client"), p("decision.facts.client"), p(f + "counterparty")),
        "region": some(p("decision.row.region"), p("decision.facts.region"), p(f + "location")),
        "award_type": some(text("award_type"), p(f + "award_type"), p("classification")),
        "start": some(text("source_start_text"), p(f + "expected_start")),
        "term": term,
        "option": some(text("option_text"), p(f + "option_text"), F.concat(p(f + "option_term_years"), F.lit("y"))),
        "value": some(text("value_text"), F.coalesce(p(i + "value_usd", "double"), p(o + "value_usd", "double")), p(f + "value_text"), p(f + "announced_value_usd")),
        "day_rate": some(F.when(row_rate > 0, row_rate), old_rate),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("fact"), F.coalesce(v, unknown).alias("value")) for k, v in facts.items()])
    return events.select("event_id", F.inline(pairs))


def event_notes(events: DataFrame) -> DataFrame:
    """(event_id, notes, quotes): texts that are not blank; a quote is followed by where it stands."""
    p = lambda path, kind="string": _path(events, path, kind)
    i = "decision.row.interpretation."
    derived = economics(p(i + "value_usd", "double"), p(i + "base_duration_days", "double"), p(i + "award_type"))["usd_per_day"]
    notes = [p("decision.action"), F.coalesce(p("decision.reason"), p("reason")), p("decision.hold_reason"), F.when(p("decision.row.start_date").isNotNull(), F.concat_ws(" – ", p("decision.row.start_date"), p("decision.row.end_date"))), derived.cast("string")]
    quote = F.when(nonempty(p("decision.quote")), F.concat_ws(" · ", p("decision.quote"), F.when(nonempty(p("decision.locator")), p("decision.locator"))))
    return events.select("event_id", F.array_compact(F.array(*[F.when(nonempty(n), n) for n in notes])).alias("notes"), F.array_compact(F.array(quote)).alias("quotes"))


def merge_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events of new replace those of their id; the rest stays."""
    return old.join(new.select("event_id").distinct(), "event_id", "left_anti").unionByName(new, allowMissingColumns=True)


def triage_select(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates whose job_id was selected, each once."""
    return candidates.join(selected.select("job_id").distinct(), "job_id", "left_semi").dropDuplicates(["job_id"])


def triage_categories(candidates: DataFrame, given: DataFrame, allowed: list[str], default: str = OTHER) -> DataFrame:
    """(job_id, category): the first valid category given for each candidate, else the default.  given: job_id, category, pos."""
    first = given.where(F.col("category").isin(*allowed)).groupBy("job_id").agg(F.min_by("category", "pos").alias("category"))
    return candidates.select("job_id").distinct().join(first, "job_id", "left").fillna(default, ["category"])


def tag_events(events: DataFrame, categories: DataFrame, default: str = OTHER) -> DataFrame:
    """Untagged events get the category given for their (company, url, title), reports their own.  categories: id, category."""
    own = F.coalesce(F.col("news_category"), F.when(F.col("classification") == "official-report-reading", REPORT))
    key = group_event_id(F.col("company"), F.col("url"), F.col("title"))
    given = categories.groupBy(F.col("id").alias("_key")).agg(F.min("category").alias("_given"))
    return events.withColumn("_key", key).join(given, "_key", "left").withColumn("news_category", F.coalesce(own, F.col("_given"), F.lit(default))).drop("_key", "_given")
