"""Problem 8: token ids of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.tokens import encode_corpus
from assayflow.plans.common import Registry, table

registry = Registry()


@registry.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.query("p8_by_source")
def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents, documents without tokens, tokens."""
    docs = table(spark, sf_dir, "documents")
    n = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "source").join(n, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("n") == 0, 1)).alias("n_empty"), F.sum("n").alias("n_tokens"))
