"""Problem 10: missing and wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.language import find_sentences, fit_found, label_code, segments_of
from assayflow.plans.common import Registry, table
from assayflow.workspace import materialise

registry = Registry()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = materialise(find_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), "sentences")
    return segments_of(found, "doc_id", fit_found(found))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, confidence, n_chars, share) for each language with a whole sentence in a document."""
    return segments(spark, sf_dir).where("lang is not null").groupBy("doc_id", "lang").agg(F.max("confidence").alias("confidence"), F.sum("n_chars").alias("n_chars"))


@registry.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", label_code(F.col("lang")).alias("label")).distinct()
    held = languages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))  # at most one entry for each model
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | (F.element_at("langs", 1) != F.col("label"))
    return held.join(docs, "doc_id").where(wrong).select("doc_id", F.explode("langs").alias("lang")).distinct()


@registry.query("p10_segments")
def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@registry.query("p10_documents")
def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's main language, null without prose, with a confidence and what its label is worth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), label_code(F.col("lang")).alias("code"))
    main = languages(spark, sf_dir).groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct("n_chars", "lang")).alias("m"), F.count("*").alias("n_languages"))
    state = F.when(F.col("m").isNull(), "no prose").when(F.col("code").isNull(), "missing").when(F.col("code") != F.col("m.lang"), "wrong").when(F.col("n_languages") > 1, "mixed").otherwise("right")
    return docs.join(main, "doc_id", "left").select("doc_id", "label", F.col("m.lang").alias("lang"), F.round("m.confidence", 6).alias("confidence"), F.coalesce("n_languages", F.lit(0)).alias("n_languages"), state.alias("state"))
