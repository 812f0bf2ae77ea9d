"""A training corpus from raw documents, in stages that each use one operator of ``veristry.llm``.

A stage gets what the one before it kept and returns the columns of documents;
the last returns sampled encodings and what they decode to.  Nothing is dropped but what a stage's
operator rejects: documents without a language, all but the first of a group
of near copies, repeated passages (and documents that consist of them), and
contaminated documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristry.llm import decontamination, language_id, ngram_join, segmentation, substring_dedup
from veristry.llm.shared import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null, empty and letterless texts; fills in a missing lang.

    Rows are judged one by one, so repeated rows stay or go together.
    """
    out = language_id.identify(docs, language_id.train(docs)).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of linked documents.

    Documents without words are linked with nothing and stay; so does a
    document with a null doc_id, which can't be told apart from others.  Rows
    that repeat the smallest doc_id are the same document and stay together.
    """
    found = ngram_join.jaccard_components(docs)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller doc_id has; a document of nothing else goes.

    A document of which nothing is removed keeps its text as it is, null or
    empty ones too; another's kept words are joined by one space.
    """
    out = substring_dedup.remove_repeated_windows(docs).where("n_removed = 0 OR n_removed < n_words")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items contaminate; a null or empty text isn't contaminated."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_contamination(docs, items).where("NOT contaminated").select(docs.columns)


def encodings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled encodings of each document, and the texts that they decode to.

    A null text gives one row without ids, an empty one its only encoding.
    """
    return segmentation.encode(docs, segmentation.load(segmentation.model_path()), decoded=True)


STAGES = [("language_id", language), ("ngram_join", near_copies), ("substring_dedup", passages), ("decontamination", benchmarks), ("sentencepiece", encodings)]

#: The first and the last stage have no SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
