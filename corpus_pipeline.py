"""Corpus preparation: the stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, line_dedup, packing, quality, simhash
from strandline.llm.queries import WORD_VOCABULARY, table
from strandline.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents whose best language is less likely than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the isolation forests."""
    forests = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs.select(*COLUMNS), forests).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    model = langid.fit(docs, F.lit(True))
    found = langid.identified(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that later documents repeat; n_chars follows the text."""
    found = line_dedup.deduplicated(docs.select(*COLUMNS), line_dedup.build(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents that share 0.8 of their five-word shingles; null doc_ids stay."""
    gone = simhash.similar_documents(docs, words=5, similarity=0.8).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their places in sequences of 4096 tokens."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("best_fit_packing", sequence_packing),
]

#: The stages learn models, so SQL can't express them; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a stored table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
