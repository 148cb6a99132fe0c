"""Dates, rates, texts and URLs as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
BACKOFF_FIRST, BACKOFF_MOST = 300, 21_600
#: What a client's name says where the client is not told, in any letter case.
UNDISCLOSED = ["undisclosed", "not disclosed", "unnamed", "unknown"]


def is_iso_date(text: Column) -> Column:
    """A strict calendar date YYYY-MM-DD; false for null."""
    return F.coalesce(text.rlike(DAY_PATTERN) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_statistical(start: Column, end: Column) -> Column:
    """Both dates are there and in order."""
    return F.coalesce(start <= end, F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def positive(x: Column) -> Column:
    return finite(x) & F.coalesce(x > 0, F.lit(False))


def nonempty(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def reported_rate(day_rate: Column) -> Column:
    """The disclosed rate; 0 means undisclosed."""
    return F.when(positive(day_rate), day_rate).otherwise(0.0)


def covers(start: Column, end: Column, as_of: Column) -> Column:
    """Both ends of a period count."""
    return is_statistical(start, end) & F.coalesce(as_of.between(start, end), F.lit(False))


def is_current_reported(status: Column, start: Column, end: Column, day_rate: Column, as_of: Column) -> Column:
    return F.coalesce(status == "Firm", F.lit(False)) & covers(start, end, as_of) & positive(day_rate)


def duration_days_incl(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def duration_days(years: Column, months: Column, days: Column) -> Column:
    """A year has 365 days, a month 365/12."""
    return years * 365 + months * (365 / 12) + days


def derived_rate(value_usd: Column, base_days: Column) -> Column:
    """Value per day of the base term, null where either can't be used."""
    usable = finite(value_usd) & (value_usd >= 0) & positive(base_days)
    return F.when(usable, value_usd / base_days)


def js_round(x: Column) -> Column:
    """Half up, as in floor(x + 0.5)."""
    return F.floor(x + 0.5)


def quarter_start(day: Column) -> Column:
    return F.date_trunc("quarter", day).cast("date")


def backoff_seconds(failures: Column) -> Column:
    exponent = F.greatest(F.lit(0), F.least(failures - 1, F.lit(16))).cast("int")
    return F.least(F.lit(BACKOFF_MOST), F.lit(BACKOFF_FIRST) * F.call_function("shiftleft", F.lit(1), exponent))


def clean_text(text: Column) -> Column:
    """White space, Unicode's too, collapsed and trimmed; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def publication_date(text: Column) -> Column:
    """ISO date or instant kept, four other formats made ISO dates, else null."""
    t = clean_text(text)
    iso = F.when(is_iso_date(t), t)
    instant = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})?$") & t.try_cast("timestamp").isNotNull(), F.regexp_replace(t, "Z$", "+00:00"))
    other = [F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM-dd") for f in ("MM/dd/yyyy HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy")]
    return F.coalesce(iso, instant, *other)


def prose_date(text: Column) -> Column:
    """The first `Month d, yyyy` or mm/dd/yyyy in a text."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    named = F.regexp_extract(text, rf"\b((?:{months})\s+\d{{1,2}},\s+\d{{4}})\b", 1)
    slashed = F.regexp_extract(text, r"\b(\d{2}/\d{2}/\d{4})\b", 1)
    return F.coalesce(F.to_date(F.try_to_timestamp(F.regexp_replace(named, r"\s+", " "), F.lit("MMMM d, yyyy"))), F.to_date(F.try_to_timestamp(slashed, F.lit("MM/dd/yyyy"))))


def safe_url(url: Column) -> Column:
    """An https URL, else null."""
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", url)


def canonical_url(url: Column) -> Column:
    """Without fragment, scheme and host in lower case."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(plain, F.length(head) + 1))


def strip_query_param(url: Column, name: str = "refresh") -> Column:
    """The URL without one query parameter, whatever its case."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & (F.lower(F.split(p, "=")[0]) != name)), "&")
    base, tail = F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), tail)


def client_keys(client: Column) -> Column:
    """Two clients are the same if they share a key: their first word, or that both are undisclosed."""
    text = F.trim(F.coalesce(client, F.lit("")))
    word = F.regexp_replace(F.lower(F.element_at(F.split(text, r"\s+"), 1)), "[^a-z0-9]", "")
    return F.array_compact(F.array(F.when(word != "", F.concat(F.lit("w:"), word)), F.when(text.rlike("(?i)" + "|".join(UNDISCLOSED)), F.lit("undisclosed"))))


def optional_texts(**columns: Column) -> list[Column]:
    """Each text as it is where it is not blank, else null."""
    return [F.when(nonempty(c), c).alias(name) for name, c in columns.items()]


def json_number(x: Column) -> Column:
    """A double as text that is safe in JSON; what is not finite becomes a word."""
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(x.cast("string"))


def utilization_band(percent: Column) -> Column:
    return F.when(percent >= 95, "tight").when(percent >= 85, "firm").when(percent >= 75, "balanced").otherwise("soft")
