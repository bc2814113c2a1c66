"""A corpus through five stages: language, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads back as
the next one's docs. All but the last keep the columns of documents. Every row goes through every stage.

In all stages: a null text is an empty one; rows that repeat are judged alike, each by itself; columns besides doc_id, text
and lang are carried along, whatever their names; an empty table gives an empty one. A row with a null doc_id is nobody's
copy and removes nothing of another's: its language or benchmark passages may remove it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparklog.llm import decontaminate, language, neardup, pack, substring
from sparklog.llm.common import drop_written, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt from the corpus; those without letters, null and empty texts among them, or of
    doubtful language go. Where no row has a lang, all with a letter stay."""
    return language.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more; that with the smallest
    doc_id stays, with all its rows."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller doc_id has; a text of which
    nothing is left stays as an empty one."""
    return substring.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: none that has 13 consecutive words of an item, however long the document is, and
    none of whose words items of fewer than 13 words cover a twentieth or more."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, related documents one after the other."""
    return pack.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language models, sketches' bands and tokenizers aren't SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is removed when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return docs
