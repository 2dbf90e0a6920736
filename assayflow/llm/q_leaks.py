"""Problem 9: evaluation items that leaked into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.leaks import leaked_items
from assayflow.plans.common import Registry, table

registry = Registry()


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


@registry.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id")


@registry.query("p9_by_suite")
def p9_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By suite and source: leaked items, documents with leaks, mean share of an item's words."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "eval_items").select("item_id", "suite")
    full = leaks(spark, sf_dir).join(docs, "doc_id").join(items, "item_id")
    return full.groupBy("suite", "source").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.col("n_words") / F.col("n_item_words")), 6).alias("mean_share"))
