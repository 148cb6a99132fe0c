"""Validation of untrusted decisions: one bad item is held with a reason, never its document.

responses: job_id, company, payload (JSON text {reportDate, vesselUpdates: [...], decisions: [...]}).  The payload is read as VARIANT, so that true,
"100", NaN and a missing value stay different things.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspan.functions.scalars import client_keys, derived_rate, finite, is_iso_date, nonempty
from assetspan.operators.intervals import overlapping_pairs
from assetspan.session import cut, kept, small

#: Fixed values of the response format.
ACTIONS = ["upsert", "withdraw", "no-change", "hold"]
AWARD_TYPES = ["signed-contract", "letter-of-award", "binding-letter-of-award", "option-exercised", "extension", "amendment", "other", "unknown"]
TEXTS = ["sourceStartText", "sourceEndText", "placementBasis", "termText", "optionText", "valueText"]
LEAST_OVERLAP = 31


def _type(item: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def _text(item: Column, path: str) -> Column:
    """The value where it is a JSON string, else null."""
    return F.when(_type(item, path) == "STRING", F.try_variant_get(item, path, "string"))


#: Fields that the checks read, by what their value may be.
PLACES = {"": ["vesselId", "contractId", "action", "reasonKo", "quote", "locator"], "row.": ["startDate", "endDate", "client", "region", "status"], "row.interpretation.": [*TEXTS, "awardType"]}
NUMBERS = ["row.dayRate", "row.interpretation.valueUsd", "row.interpretation.baseDurationDays"]
LISTS = ["row.interpretation.includes", "row.interpretation.excludes"]
#: Fields of each object, without the names before them.
WITHIN = {p: [f.removeprefix(p) for f in [*(p + f for f in PLACES[p]), *NUMBERS, *LISTS] if f.rpartition(".")[0] == p.rstrip(".")] for p in PLACES}
UPDATE = ["vesselId", "status", "statusAsOf"]


def _shape(names: list[str]) -> str:
    """The type of an object of which these fields are read; what is no object is null in it."""
    return f"struct<{','.join(f'{n}:variant' for n in names)}>"


def _name(path: str) -> str:
    return path.replace(".", "__")


def _fields(items: DataFrame) -> DataFrame:
    """items with every field that is read as plain columns, each object looked into once: <field>__kind and its text, number or list, and whether the
    item, its row and the row's interpretation are objects."""
    texts = [p + f for p, fields in PLACES.items() for f in fields]
    rest = [c for c in items.columns if c != "item"]
    leaves = lambda p, of: [F.col(f"{of}.{f}").alias(_name(p + f)) for f in WITHIN[p]]
    outer = items.select(*rest, F.col("item").isNotNull().alias("item__object"), *leaves("", "item"), F.try_variant_get("item.row", "$", _shape([*WITHIN["row."], "interpretation"])).alias("_row"))
    found = [c for c in outer.columns if c != "_row"]
    inner = outer.select(*found, F.col("_row").isNotNull().alias("row__object"), *leaves("row.", "_row"), (F.col("_row.interpretation").isNull() | F.is_variant_null("_row.interpretation")).alias("row__interpretation__absent"),
                         F.try_variant_get("_row.interpretation", "$", _shape(WITHIN["row.interpretation."])).alias("_read"))
    flat = inner.select(*[c for c in inner.columns if c != "_read"], F.col("_read").isNotNull().alias("row__interpretation__object"), *leaves("row.interpretation.", "_read"))
    kinds = [F.schema_of_variant(_name(f)).alias(_name(f) + "__kind") for f in [*texts, *NUMBERS, *LISTS]]
    values = [F.try_variant_get(_name(f), "$", k).alias(_name(f)) for fs, k in ((texts, "string"), (NUMBERS, "double"), (LISTS, "array<string>")) for f in fs]
    return flat.select(*rest, "item__object", "row__object", "row__interpretation__object", "row__interpretation__absent", *kinds, *values)


def _kind(field: str) -> Column:
    return F.col(_name(field) + "__kind")


def _absent(field: str) -> Column:
    return F.coalesce(_kind(field) == "VOID", F.lit(True))


def _given(field: str) -> Column:
    """The text where the field is a JSON string, else null."""
    return F.when(_kind(field) == "STRING", F.col(_name(field)))


def _number(field: str) -> Column:
    """The value where the field is a finite JSON number, else null."""
    kind, x = _kind(field), F.col(_name(field))
    return F.when((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & finite(x), x)


def _texts_only(field: str) -> Column:
    """A list in which every element is a string."""
    return F.coalesce(_kind(field).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))


def _is_object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def _list(name: str) -> Column:
    """A list of the response, whatever its elements are; null where the field is none."""
    return F.try_variant_get("v", f"$.{name}", "array<struct<vesselId:variant>>")


def envelopes(responses: DataFrame) -> DataFrame:
    """responses with `v` and, where the whole response must be rejected, reject_reason."""
    parsed = responses.select("*", F.explode(F.array(F.try_parse_json("payload"))).alias("v"))  # parsed once, however often v is asked
    lists = _list("decisions").isNotNull() & _list("vesselUpdates").isNotNull()
    reason = F.when(F.col("v").isNull(), "response is not JSON").when(lists, F.lit(None).cast("string")).when(~_is_object(F.schema_of_variant("v")), "response must be an object").otherwise("decisions and vesselUpdates must be arrays")
    return parsed.withColumn("reject_reason", reason)


def report_dates(responses: DataFrame) -> DataFrame:
    """(job_id, report_date, hold_reason): a report date that is given but no real date is held."""
    e = envelopes(responses).where("reject_reason is null")
    day = _text(F.col("v"), "$.reportDate")
    ok = is_iso_date(day)
    return e.select("job_id", F.when(ok, F.try_to_date(day, "yyyy-MM-dd")).alias("report_date"), F.when(~ok & F.coalesce(_type(F.col("v"), "$.reportDate") != "VOID", F.lit(False)), "reportDate is no real date").alias("hold_reason"))


def _items(responses: DataFrame, name: str, shape: str) -> DataFrame:
    e = envelopes(responses).where("reject_reason is null")
    return e.select("job_id", "company", F.posexplode(F.try_variant_get("v", f"$.{name}", f"array<{shape}>")).alias("index", "item"))


def _interpretation_reason() -> Column:
    p = "row.interpretation"
    amount, days = (p + ".valueUsd", p + ".baseDurationDays")
    reason = F.when(F.col(_name(p) + "__absent"), F.lit(None).cast("string")).when(~F.col(_name(p) + "__object"), "interpretation must be an object")
    for t in TEXTS:
        reason = reason.when(~_absent(f"{p}.{t}") & _given(f"{p}.{t}").isNull(), f"interpretation.{t} must be text")
    reason = reason.when(~_absent(p + ".awardType") & ~F.coalesce(_given(p + ".awardType").isin(*AWARD_TYPES), F.lit(False)), "interpretation.awardType is invalid")
    reason = reason.when(~_absent(amount) & ~F.coalesce(_number(amount) >= 0, F.lit(False)), "interpretation.valueUsd must be a number of at least 0")
    reason = reason.when(~_absent(days) & ~F.coalesce(_number(days) > 0, F.lit(False)), "interpretation.baseDurationDays must be a number above 0")
    for t in LISTS:
        reason = reason.when(~_absent(t) & ~_texts_only(t), f"{t.removeprefix('row.')} must be a list of text")
    return reason


def _row_reason(contract_states: list[str]) -> Column:
    start, end = _given("row.startDate"), _given("row.endDate")
    reason = (
        F.when(~F.col("row__object"), "upsert requires a row")
        .when(~is_iso_date(start), "row.startDate is no real date")
        .when(~is_iso_date(end), "row.endDate is no real date")
        .when(start > end, "row.startDate is after row.endDate")
        .when(~F.coalesce(_number("row.dayRate") >= 0, F.lit(False)), "row.dayRate must be a number of at least 0")
        .when(~nonempty(_given("row.client")), "row.client is blank")
        .when(~nonempty(_given("row.region")), "row.region is blank")
        .when(~F.coalesce(_given("row.status").isin(*contract_states), F.lit(False)), "row.status is invalid")
    )
    return reason.otherwise(_interpretation_reason())


def _snake(name: str) -> str:
    return "".join("_" + x.lower() if x.isupper() else x for x in name)


def validate_decisions(responses: DataFrame, assets: DataFrame, contracts: DataFrame, contract_states: list[str]) -> DataFrame:
    """(job_id, company, index, asset_id, contract_id, action, row struct, reason, quote, locator, hold_reason); valid ones have no hold_reason.

    Checks in this order: an object, an asset of the company, a known action, a contract of that asset, an id to withdraw, a valid row to upsert.
    The derived rate of a row is computed here, whatever the response says.  A row has all that the interpretation says.
    """
    d = _fields(_items(responses, "decisions", _shape([*WITHIN[""], "row"])))
    p = "row.interpretation."
    value, days = _number(p + "valueUsd"), _number(p + "baseDurationDays")
    day = lambda f: F.try_to_date(_given(f), "yyyy-MM-dd")
    row = F.struct(
        day("row.startDate").alias("start_date"), day("row.endDate").alias("end_date"), _number("row.dayRate").alias("day_rate"), _given("row.client").alias("client"), _given("row.region").alias("region"),
        _given("row.status").alias("status"), value.alias("value_usd"), days.alias("base_days"), derived_rate(value, days).alias("derived_usd_per_day"), _given(p + "awardType").alias("award_type"),
        *(_given(p + t).alias(_snake(t)) for t in TEXTS), *(F.when(_texts_only(t), F.col(_name(t))).alias(t.rpartition(".")[2]) for t in LISTS),
    )
    texts = [F.when(nonempty(_given(k)), _given(k)).alias(n) for k, n in (("reasonKo", "reason"), ("quote", "quote"), ("locator", "locator"))]
    own = d.withColumn("_upsert", F.coalesce(_given("action") == "upsert", F.lit(False))).withColumn("_why", F.when(F.col("_upsert"), _row_reason(contract_states)))
    # All that the response itself tells; what the tables tell is looked up for ids alone, and only ids that they lack come back to the rows.
    read = kept(own.select("job_id", "company", "index", _given("vesselId").alias("asset_id"), _given("contractId").alias("contract_id"), (~_absent("contractId")).alias("_named"), _given("action").alias("action"), "item__object", "_why",
                           F.when(F.col("_upsert") & F.col("_why").isNull(), row).alias("row"), *texts))
    strange = lacking(read.select("company", "asset_id").distinct(), assets)
    unknown = lacking(read.where("_named").select("asset_id", "contract_id"), contracts)
    d = read.join(strange.withColumn("_strange", F.lit(True)), ["company", "asset_id"], "left").join(unknown.withColumn("_unknown", F.lit(True)), ["asset_id", "contract_id"], "left")
    reason = (
        F.when(~F.col("item__object"), "decision must be an object")
        .when(F.col("company").isNull() | F.col("asset_id").isNull() | F.col("_strange"), "asset is not registered for this company")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action is invalid")
        .when(F.col("_named") & (F.col("contract_id").isNull() | F.col("_unknown")), "contractId is no contract of the asset")
        .when((F.col("action") == "withdraw") & ~F.col("_named"), "withdraw requires contractId")
        .when(F.col("action") == "upsert", F.col("_why"))
    )
    d = d.withColumn("hold_reason", reason)
    return d.select("job_id", "company", "index", "asset_id", "contract_id", "action", F.when(F.col("hold_reason").isNull(), F.col("row")).alias("row"), "reason", "quote", "locator", "hold_reason")


def lacking(named: DataFrame, table: DataFrame) -> DataFrame:
    """What of the pairs named the table has not; pairs with a null are left out.  Equal pairs are made one after the look-up: where there are many of
    them the caller does so before."""
    pairs = named.dropna()
    return small(cut(pairs.join(table.select(pairs.columns), pairs.columns, "left_anti").distinct()))


def validate_updates(responses: DataFrame, assets: DataFrame, asset_states: list[str]) -> DataFrame:
    """(job_id, company, index, asset_id, status, status_as_of, hold_reason) of the responses' asset updates."""
    i = _items(responses, "vesselUpdates", _shape(UPDATE))
    found = i.select("job_id", "company", "index", F.col("item").isNotNull().alias("item__object"), *(F.col(f"item.{f}").alias(f) for f in UPDATE))
    texts = found.select("job_id", "company", "index", "item__object", *(F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(f, "$", "string")).alias(n) for f, n in zip(UPDATE, ("asset_id", "status", "_day"))))
    d = texts.join(assets.select("asset_id", F.col("company").alias("_owner")).dropDuplicates(["asset_id"]), "asset_id", "left")
    day = F.col("_day")
    reason = (
        F.when(~F.col("item__object"), "update must be an object")
        .when(~F.coalesce(F.col("_owner") == F.col("company"), F.lit(False)), "asset is not registered for this company")
        .when(~F.coalesce(F.col("status").isin(*asset_states), F.lit(False)), "status is invalid")
        .when(~is_iso_date(day), "statusAsOf must be a real date")
    )
    return d.select("job_id", "company", "index", "asset_id", "status", F.try_to_date(day, "yyyy-MM-dd").alias("status_as_of"), reason.alias("hold_reason"))


def suspected_duplicates(decisions: DataFrame, contracts: DataFrame, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """(job_id, asset_id, index, start_date, other_index, other_contract_id, other_start_date): written rows that overlap another
    period of the same asset and client by more than least_overlap days.

    The others are the asset's contracts that the job neither withdraws nor replaces, and rows written later in the same job.
    """
    valid = decisions.where("hold_reason is null")
    written = valid.where("action = 'upsert'").select("job_id", "asset_id", "index", "contract_id", "row.start_date", "row.end_date", "row.client").withColumn("key", F.explode(client_keys(F.col("client"))))
    touched = valid.where("action in ('upsert', 'withdraw') and contract_id is not null").select("job_id", "contract_id").distinct()
    jobs = written.select("job_id", "asset_id").distinct()
    rows = contracts.join(jobs, "asset_id").join(touched, ["job_id", "contract_id"], "left_anti").select("job_id", "asset_id", F.lit(None).cast("int").alias("index"), "contract_id", "start_date", "end_date", "client")
    other = rows.withColumn("key", F.explode(client_keys(F.col("client")))).unionByName(written).withColumn("order", F.coalesce("index", F.lit(-1)))
    one_written = lambda x, y: F.col(f"{x}.index").isNotNull() | F.col(f"{y}.index").isNotNull()
    found = overlapping_pairs(other, ["job_id", "asset_id", "key"], ["order"], least_overlap, one_written)
    written_first = F.col("earlier.index").isNotNull() & (F.col("later.index").isNull() | (F.col("earlier.index") < F.col("later.index")))
    a, b = (F.when(written_first, F.col(x)).otherwise(F.col(y)) for x, y in (("earlier", "later"), ("later", "earlier")))
    pairs = found.select(a.alias("a"), b.alias("b"))
    out = pairs.select("a.job_id", "a.asset_id", "a.index", "a.start_date", F.col("b.index").alias("other_index"), F.col("b.contract_id").alias("other_contract_id"), F.col("b.start_date").alias("other_start_date"))
    return out.distinct()  # two clients may share two keys
