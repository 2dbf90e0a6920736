"""Features from long tables of elements: families, classes, support, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gene_family(symbol: Column) -> Column:
    """Family of an allele symbol; null for point mutations (symbols with an underscore). A beta-lactamase loses its variant (a number and
    what follows it); any other symbol first loses its allele number, and what is left then loses the letter after a final Roman numeral."""
    variant = F.regexp_replace(symbol, "-[0-9]+[A-Za-z]*$", "")
    lactamase = variant.rlike("^bla[A-Za-z]+(-[A-Za-z]+)?$")
    unnumbered = F.regexp_replace(symbol, "([^0-9])[0-9]+$", "$1")
    return F.when(symbol.contains("_"), None).when(lactamase, variant).otherwise(F.regexp_replace(unnumbered, "(-[IVX]+)[a-z]$", "$1"))


def first_calls(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def hierarchy(df: DataFrame, record: str, symbol: str, classes: str) -> DataFrame:
    """(record, feature): alleles, families as family:x, and each class of a list joined by slashes as class:x, once each."""
    allele = df.select(record, F.col(symbol).alias("feature"))
    family = df.select(record, F.concat(F.lit("family:"), gene_family(F.col(symbol))).alias("feature"))
    split = df.select(record, F.explode(F.split(classes, "/")).alias("c")).where("trim(c) <> ''").select(record, F.concat(F.lit("class:"), F.trim("c")).alias("feature"))
    return allele.unionByName(family).unionByName(split).where(F.col(record).isNotNull() & F.col("feature").isNotNull()).distinct()


def supported(df: DataFrame, record: str, feature: str, least: int = 5) -> DataFrame:
    """(feature, n_records) of features that enough different records have."""
    return df.select(record, feature).distinct().groupBy(feature).agg(F.count("*").alias("n_records")).where(F.col("n_records") >= least)


def feature_sets(df: DataFrame, record: str, feature: str) -> DataFrame:
    """(record, features): sorted, for design matrices; a record's features are few."""
    return df.groupBy(record).agg(F.array_sort(F.collect_set(feature)).alias("features"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, vector): the mean by position. Positions are aggregated as rows, so no group is gathered; vectors with a null are left out."""
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("at", "x"))
    per = rows.groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: F.round(s.x, 6)).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
