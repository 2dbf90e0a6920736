"""Problem 5: dates and times as typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators.timestamps import known_zones, normalise_timestamps
from assayflow.plans.common import Registry, table

registry = Registry()


def normalised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of isolates and ast with its date text in the one form, null where it can't be read."""
    sites = table(spark, sf_dir, "submitting_sites").dropDuplicates(["site"])
    one = lambda t, key, text: table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), F.col(key).alias("record_key"), F.col(text).alias("date_text"), "site")
    rows = one("isolates", "target_acc", "collection_date").unionByName(one("ast", "id", "testing_date"))
    zoned = rows.join(sites.select("site", "time_zone", "date_order"), "site", "left")
    return normalise_timestamps(zoned, "date_text", "time_zone", "date_order", zones=known_zones(sites, "time_zone"))


@registry.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalised_dates(spark, sf_dir).where("normalised is not null and record_key is not null")
    return found.select("source_table", "record_key", "normalised").distinct()


@registry.query("p5_unread")
def p5_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled date texts that name no date, with their shape (digits 9, letters A) and number of rows."""
    shape = F.regexp_replace(F.regexp_replace(F.col("date_text"), r"\p{N}", "9"), r"\p{L}+", "A")
    left = normalised_dates(spark, sf_dir).where(F.col("normalised").isNull() & (F.trim("date_text") != ""))
    return left.groupBy("source_table", shape.alias("shape")).agg(F.count("*").alias("n_rows"), F.countDistinct("date_text").alias("n_texts"))
