"""Consolidating pairwise matches into groups: alternate large-star and small-star rewrites of the edge table.

Every rewrite is an aggregate (combined before the shuffle) and a join that adaptive execution may split where one
record holds a large part of all edges. Each round is written to the shared folder; no identifier reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.workspace import discard, materialise


def _large_star(e: DataFrame) -> DataFrame:
    """Edges (u > v): each neighbour larger than u is tied to the least of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges (u > v): u and its smaller neighbours are tied to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): every identifier of a pair, with the least identifier it is linked to, directly or indirectly.

    Pairs may repeat, run in either direction and hold an identifier twice (which makes it known, and links nothing).
    A pair with a null end is no pair. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pairs.sparkSession
    p = pairs.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where("x is not null and y is not null")
    p, origin = materialise(p.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "pairs")
    edges, path, mark = p.where("u <> v"), None, None
    while True:
        edges, new = materialise(_small_star(_large_star(edges)), "stars")
        discard(spark, path)
        path, before, mark = new, mark, _mark(edges)
        if mark[0] == 0 or mark == before:
            break
    alone = p.where("u = v").select("u").join(edges.select("u"), "u", "left_anti")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).unionByName(alone.select(F.col("u").alias("id"), F.col("u").alias("component"))).distinct()
