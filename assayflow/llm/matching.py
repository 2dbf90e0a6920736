"""Matching entities across sources without keys: loopy belief propagation over candidate pairs.

Each candidate pair is a binary variable with log odds from its fields. One factor for each row of either side allows at most
one partner, and one for each group of rows (that share an unseen entity) says that they have the same entity of the other side. Messages are
exchanged through aggregates and joins until they no longer change; the beliefs are marginal match probabilities.

The joins are of tables of like size on one key, so they are asked to merge: broadcasting small ones in every round would
only fill the driver.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.workspace import discard, materialise

BOUND = 30.0  # of log odds, so that exp() stays finite
DAMP_AFTER = 20  # rounds


def bounded(c: Column) -> Column:
    return F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c))


def others(pairs: DataFrame, key: str, weight: Column) -> DataFrame:
    """pairs with __rest: the sum of the weights of the other pairs of the same key, never below zero."""
    w = pairs.withColumn("__w", weight)
    total = w.groupBy(key).agg(F.sum("__w").alias("__sum"))
    return w.join(total.hint("merge"), key).withColumn("__rest", F.greatest(F.lit(0.0), F.col("__sum") - F.col("__w"))).drop("__sum", "__w")


def group_messages(pairs: DataFrame, belief: Column, most: float) -> DataFrame:
    """pairs with g: what the other rows of the row's group say for the pair's entity, against all other entities and none.

    A row counts once for an entity, by its best pair, and none of its pairs has a part in its own messages: a row alone in its group gets
    none. Weights are relative to the group's heaviest entity, so that large groups meet no bound. The pairs of a group meet in one task,
    where windows take the sums (and spill); a group is a record, of tens of rows.
    """
    of_row, of_entity, of_group, of_part = (Window.partitionBy(*k) for k in (["grp", "a"], ["grp", "z"], ["grp"], ["grp", "a", "z"]))
    weight = lambda c: F.exp(c - F.col("__top"))
    v = pairs.repartition("grp").withColumn("__v", F.log1p(F.exp(bounded(belief))))
    v = v.withColumns({"__v": F.max("__v").over(of_part), "__n": F.count("*").over(of_part)})
    v = v.withColumns({"__all": F.sum(F.col("__v") / F.col("__n")).over(of_entity), "__m": F.count("*").over(of_entity), "__alone": F.count("*").over(of_row) == F.count("*").over(of_group)})
    v = v.withColumns({"__top": F.max("__all").over(of_group), "__rest": F.greatest(F.lit(0.0), F.col("__all") - F.col("__v"))})
    # weight of all entities for a row: of those its own pairs name without its own part, of the others in full
    v = v.withColumns({
        "__full": F.sum(weight(F.col("__all")) / F.col("__m")).over(of_group),
        "__own": F.sum(weight(F.col("__all")) / F.col("__n")).over(of_row),
        "__less": F.sum(weight(F.col("__rest")) / F.col("__n")).over(of_row),
    })
    against = F.greatest(F.lit(0.0), F.col("__full") - F.col("__own")) + F.greatest(F.lit(0.0), F.col("__less") - weight(F.col("__rest"))) + weight(F.lit(0.0))
    message = F.col("__rest") - F.col("__top") - F.log(F.greatest(F.lit(1e-300), against))
    message = F.when(F.col("__alone"), 0.0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), message)))
    return v.withColumn("g", message).drop("__v", "__n", "__all", "__m", "__alone", "__top", "__rest", "__full", "__own", "__less")


def contested_groups(p: DataFrame) -> DataFrame:
    """(grp) of the groups in which a row of either side has several candidates, or whose pairs name several entities. A row b that
    two groups claim contests both, so no message leaves the other groups."""
    rivals = lambda k: p.groupBy(k).agg(F.count("*").alias("__n")).where("__n > 1").select(k)
    several = p.groupBy("grp").agg(F.min("z").alias("__lo"), F.max("z").alias("__hi")).where("__lo <> __hi").select("grp")
    return p.join(rivals("a").hint("merge"), "a", "left_semi").select("grp").unionByName(p.join(rivals("b").hint("merge"), "b", "left_semi").select("grp")).unionByName(several).distinct()


def propagate(candidates: DataFrame, damping: float = 0.1, tolerance: float = 0.05, most_rounds: int = 200, group_most: float = 8.0) -> DataFrame:
    """(a, b, probability) of candidates(a, b, grp, z, s): rows a and b with log odds s; grp is the group of a, z the entity of b.

    Each pair comes once; a null grp is a group of the row alone. Groups without rivals have their messages after one round; the others go on
    until no message changes by more than the tolerance. Messages that swing are damped more after every DAMP_AFTER rounds; should any still
    move after most_rounds, a warning tells how many pairs. An empty table gives an empty one. Ties (equal rows) share the probability.
    """
    spark = candidates.sparkSession
    zero = F.lit(0.0)
    pairs, ppath = materialise(candidates.select("a", "b", F.coalesce("grp", F.concat(F.lit("row "), F.col("a"))).alias("grp"), "z", F.col("s").cast("double").alias("s")), "pairs")
    contested, cpath = materialise(contested_groups(pairs), "contested")
    calm = group_messages(pairs.join(contested.hint("merge"), "grp", "left_anti").withColumn("g", zero), F.col("s"), group_most).withColumns({"x": zero, "y": zero})
    p, path = materialise(pairs.join(contested.hint("merge"), "grp", "left_semi").withColumns({"g": zero, "x": zero, "y": zero}), "pairs")
    moved: float | None = None
    for number in range(most_rounds):
        if number and number % DAMP_AFTER == 0:
            damping = (1 + damping) / 2
        n = group_messages(p.withColumn("g0", F.col("g")), F.col("s") + F.col("y"), group_most)
        n = n.withColumn("g", F.col("g0") * damping + F.col("g") * (1 - damping)).drop("g0")
        n = others(n, "a", F.exp(bounded(F.col("s") + F.col("g") + F.col("y")))).withColumn("x1", F.col("x") * damping - F.log1p("__rest") * (1 - damping)).drop("__rest")
        n = others(n, "b", F.exp(bounded(F.col("s") + F.col("g") + F.col("x1")))).withColumn("y1", F.col("y") * damping - F.log1p("__rest") * (1 - damping)).drop("__rest")
        n, new = materialise(n.withColumn("move", F.greatest(F.abs(F.col("x1") - F.col("x")), F.abs(F.col("y1") - F.col("y")))).select("a", "b", "grp", "z", "s", "g", F.col("x1").alias("x"), F.col("y1").alias("y"), "move"), "pairs")
        moved = n.agg(F.max("move")).first()[0]
        discard(spark, path)
        p, path = n.drop("move"), new
        if moved is None or moved < tolerance:
            break
        if number == most_rounds - 1:
            warnings.warn(f"messages of {n.where(F.col('move') >= tolerance).count()} pairs still move after {most_rounds} rounds", stacklevel=2)
    both = p.unionByName(calm.select(*p.columns))
    out, _ = materialise(both.select("a", "b", (1 / (1 + F.exp(-bounded(F.col("s") + F.col("g") + F.col("x") + F.col("y"))))).alias("probability")), "beliefs")
    discard(spark, path, ppath, cpath)
    return out


def one_to_one(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of at least the given probability that are the best of both their rows; equal ones go by the names of the rows."""
    s = scored.where(F.col("probability") >= least)
    best_b = s.groupBy("a").agg(F.max_by("b", F.struct("probability", "b")).alias("b"))
    best_a = s.groupBy("b").agg(F.max_by("a", F.struct("probability", "a")).alias("a"))
    return s.join(best_b.join(best_a.hint("merge"), ["a", "b"]).hint("merge"), ["a", "b"])
