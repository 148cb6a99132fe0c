"""Filter interaction audit: what each filter takes in every order of the filters, alone and after others.

Every document gets a mask, one bit for each filter that it fails; documents are counted per part and mask, which leaves
at most two to the number of filters cells a part.  A recursive CTE then enumerates the orders: it extends each prefix
by every letter that it has not used, joins the part's cells, carries the applied bits along, and each level of the
recursion emits the figures of the step that it added.  The steps of a whole order are the prefixes of it.

All work is done by SQL functions.  Equal texts are told by their SHA-256, and a document's first twin is found by the
least doc_id per text and a join on text and doc_id, so that a text with very many copies is in no one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspan.llm._common import cut

#: Rows that a recursion may make.  It is lifted for the orders, which have 326 prefixes a part with five filters, however many parts there are.
LIMIT = "spark.sql.cteRecursionRowLimit"

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text, which is not null, fails A to D."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", F.lit(""))) > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, filters=text_filters, copies: str | None = "E") -> DataFrame:
    """One row per row of docs: doc_id, part and mask; the filters' bits in the order of their names.

    filters gives, for a text column, the condition of failing each filter.  `copies` names one more, which a document
    fails whose text an earlier doc_id has.  A null text is an empty one, a null lang the part ''.  Rows that share a
    doc_id and a text are alike: all or none of them are copies; a row without doc_id is no copy and has none.
    """
    text = F.coalesce("text", F.lit(""))
    failing = filters(F.col("text"))
    bits = {name: 1 << i for i, name in enumerate(sorted([*failing, *([copies] if copies else [])]))}
    given = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    mask = reduce(lambda a, b: a + b, (F.when(c, bits[name]).otherwise(0) for name, c in failing.items()), F.lit(0))
    rows = given.select("doc_id", "part", mask.alias("mask"), F.sha2("text", 256).alias("digest"))
    if not copies:
        return rows.drop("digest")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("earliest", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("earliest").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copied, bits[copies]).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per part and mask: all documents, those labelled good and those labelled toxic.

    A document counts as good if any of its labels has quality 1, as toxic if any has toxic 1; one without labels is neither.
    """
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return masked.join(judged, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


#: {letters} is a list of ('letter', bit) rows, {cells} the view of the cells of a part as one array.
ORDERS = """
WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
prefixes(part, filter_order, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT p.part, concat(p.filter_order, l.letter), p.applied | l.bit, p.step + 1,
    aggregate(c.cells, 0L, (s, x) -> s + if(x.mask & (p.applied | l.bit) = 0, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + if(x.mask & p.applied = 0 AND x.mask & l.bit != 0, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + if(x.mask & p.applied != 0 AND x.mask & l.bit != 0, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + if(x.mask = l.bit, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + if(x.mask & p.applied = 0 AND x.mask & l.bit != 0, x.good, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + if(x.mask & p.applied = 0 AND x.mask & l.bit != 0, x.toxic, 0L))
  FROM prefixes p JOIN letters l ON p.applied & l.bit = 0 JOIN {cells} c ON c.part = p.part
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM prefixes WHERE step > 0
"""


def steps(counted: DataFrame, letters: str) -> DataFrame:
    """One row per part, prefix of an order and step: the last letter's figures after those before it."""
    spark = counted.sparkSession
    packed = cut(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    rows = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(sorted(letters)))
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "-1")
    try:
        return cut(spark.sql(ORDERS.format(letters=rows, cells="{cells}"), cells=packed))
    finally:
        spark.conf.set(LIMIT, before)


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, copies: str | None = "E") -> DataFrame:
    """One row per part, order of all filters and step, zeros included.

    kept and removed: documents after and at the step; redundant: those that fail its filter and had gone before;
    unique_fails: those that fail its filter only; good_lost and toxic_lost: the removed ones so labelled; shapley: what
    its filter removes, over all orders.  An empty table gives an empty one; other columns are ignored.
    """
    letters = "".join(sorted([*filters(F.lit("")), *([copies] if copies else [])]))
    emitted = steps(cells(masks(docs, filters, copies), labels), letters)
    emitted = emitted.withColumn("letter", F.substring("filter_order", -1, 1))
    whole = emitted.where(F.col("step") == len(letters)).select("part", F.col("filter_order").alias("whole"))
    places = F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    of_order = whole.select("part", "whole", places).withColumn("filter_order", F.col("whole").substr(F.lit(1), F.col("step")))
    out = of_order.join(emitted, ["part", "step", "filter_order"]).drop("filter_order").withColumnRenamed("whole", "filter_order")
    shapley = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "letter"]).select("part", "filter_order", F.col("step").cast("int"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), judged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT d.part, coalesce(j.good, 0) AS good, coalesce(j.toxic, 0) AS toxic,
    MAP {'A': len(words) < 200,
         'B': 100 * len(list_distinct(words)) < 50 * len(words),
         'C': 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text),
         'D': regexp_matches(d.text, '[#$%&*|]'),
         'E': coalesce(f.least < d.doc_id, false)} AS fails
  FROM d JOIN firsts f ON f.text = d.text LEFT JOIN judged j ON j.doc_id = d.doc_id
), tally AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails
), orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(filter_order, letter)
), places AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, string_split(substr(filter_order, 1, step - 1), '') AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), judged_steps AS (
  SELECT part, filter_order, step, letter, n, good, toxic,
    fails[letter] AS this, len(list_filter(earlier, lambda x: x <> '' AND fails[x])) > 0 AS before,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: x <> letter AND fails[x])) > 0 AS other
  FROM places, tally
), figures AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT this AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN this AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN this AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN this AND NOT other THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN this AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN this AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged_steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM figures
"""
