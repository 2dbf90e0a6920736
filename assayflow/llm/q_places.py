"""Problem 3: places as typed, mapped to the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.reference import map_to_reference
from assayflow.plans.common import Registry, table
from assayflow.text import is_placeholder

registry = Registry()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_acc, geo_loc_name, name) of the isolates with a filled geo_loc_name; name is null where no entry is meant."""
    rows = table(spark, sf_dir, "isolates").select("target_acc", "geo_loc_name").where(~is_placeholder(F.col("geo_loc_name")) & F.col("target_acc").isNotNull()).distinct()
    named = map_to_reference(rows, "geo_loc_name", table(spark, sf_dir, "insdc_geo_loc_name_vocabulary"), "name")
    return rows.join(named, "geo_loc_name", "left")


@registry.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.coalesce(F.col("name") == F.col("geo_loc_name"), F.lit(False))  # a text that is an entry stands for it
    return places(spark, sf_dir).where(~exact).select("target_acc", F.coalesce("name", F.lit("unmatched")).alias("name")).distinct()


@registry.query("p3_unmatched")
def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand for no entry, with their isolates."""
    return places(spark, sf_dir).where("name is null").groupBy("geo_loc_name").agg(F.countDistinct("target_acc").alias("n_isolates"))
