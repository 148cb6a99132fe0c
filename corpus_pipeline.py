"""The corpus pipeline: five operators of assetspan.llm in a row, each on all that the one before it kept.

Every stage takes an empty table and gives an empty one, reads texts of any length whole, and keeps columns whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assetspan.llm import bpe, decontaminate, langid, neardup, substring
from assetspan.llm._common import cut, table
from assetspan.llm.queries import VOCABULARY
from assetspan.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the network is trained on the documents as they come.

    Null and empty texts and those without a letter go.  Repeated rows are judged alike; of languages that tie the first by name counts.
    """
    ship(spark)
    return langid.accepted(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least doc_id.

    Of repeated rows one stays, of texts that share the least doc_id that with the least hash.  Rows without doc_id or text stay.
    """
    ship(spark)
    return neardup.survivors(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go.

    Null and empty texts stay as they are, rows without doc_id and rows that share one take nothing from each other.
    """
    ship(spark)
    return substring.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark items; documents of which nothing is left go.

    Null and empty texts, and all texts where the benchmark is empty, stay as they are; repeated rows are cut alike.
    """
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with digests of ids and of what they decode to; null and empty texts have no ids, repeated rows give repeated rows."""
    ship(spark)
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written to the checkpoint folder before the next one begins."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else cut(docs), sf_dir)
    return docs
