"""Group bootstrap: whole groups are drawn with replacement, from sums made once for each group.

Draws are counter-based hashes, so they don't depend on partitions and SQL can repeat them; intervals are statistically, not bit by
bit, those of another random generator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPREAD = 128  # tasks over which draws are dealt: few rows before their groups are drawn, so the planner would take one


def hash_number(*parts: Column, modulo: Column | int | None = None) -> Column:
    """The first 32 bits of SHA-256 of the parts, joined by colons, as a whole number."""
    n = F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")
    return n if modulo is None else n % (F.lit(modulo) if isinstance(modulo, int) else modulo)


def group_bootstrap(df: DataFrame, keys: Sequence[str], group: str, numerators: dict[str, Column], denominators: dict[str, Column], draws: int = 2000, seed: int = 20260815) -> DataFrame:
    """(keys, statistic, estimate, lo, hi, n_groups): ratios of sums with percentile intervals (2.5 and 97.5 %).

    Each statistic is sum(numerator) / sum(denominator) over the drawn groups; draws without a denominator are left out, and the
    interval is null where they are more than half. Work is draws x groups, whatever the number of rows.
    """
    names = list(numerators)
    sums = df.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(*[F.sum(numerators[s].cast("double")).alias(f"x{i}") for i, s in enumerate(names)], *[F.sum(denominators[s].cast("double")).alias(f"d{i}") for i, s in enumerate(names)])
    w = Window.partitionBy(*keys)
    sums = sums.withColumns({"j": F.row_number().over(w.orderBy(group)) - 1, "G": F.count("*").over(w)})
    cols = [f"{p}{i}" for i in range(len(names)) for p in ("x", "d")]
    sizes = sums.groupBy(*keys).agg(F.max("G").alias("G"), *[F.sum(c).alias(f"t_{c}") for c in cols])
    slots = sizes.select(*keys, "G", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).repartition(SPREAD, *keys, "draw").select(*keys, "G", "draw", F.explode(F.sequence(F.lit(0), (F.col("G") - 1).cast("int"))).alias("slot"))
    picks = slots.withColumn("j", hash_number(F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"), modulo=F.col("G")).cast("int"))
    picks = picks.groupBy(*keys, "draw", "j").agg(F.count("*").alias("m"))
    # the number of picks is unknown to the planner, which would broadcast them
    drawn = picks.join(sums.hint("merge"), [*keys, "j"]).groupBy(*keys, "draw").agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in cols])
    stats = drawn.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.try_divide(f"x{i}", f"d{i}").alias("v")) for i, s in enumerate(names)])))
    ends = stats.groupBy(*keys, "statistic").agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), F.count("v").alias("n"))
    whole = sizes.select(*keys, "G", F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.try_divide(f"t_x{i}", f"t_d{i}").alias("estimate")) for i, s in enumerate(names)])))
    enough = F.col("n") >= draws / 2
    return whole.join(ends, [*keys, "statistic"], "left").select(*keys, "statistic", F.round("estimate", 6).alias("estimate"), F.when(enough, F.round("lo", 6)).alias("lo"), F.when(enough, F.round("hi", 6)).alias("hi"), F.col("G").alias("n_groups"))


def paired_differences(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str], group: str, measure: str, draws: int = 2000, seed: int = 20260815) -> DataFrame:
    """Bootstrap of the mean of a's measure less b's, over rows that both tables hold; group and keys are a's."""
    both = a.join(b.select(*on, F.col(measure).cast("double").alias("__b")), list(on))
    d = F.col(measure).cast("double") - F.col("__b")
    return group_bootstrap(both, keys, group, {"difference": d}, {"difference": F.when(d.isNotNull(), 1)}, draws, seed)


def leave_source_out(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str], source: str, measure: str, least: float = 0.1) -> DataFrame:
    """(keys, source, share, difference): the paired difference without each source that holds at least the given share of the rows."""
    both = a.join(b.select(*on, F.col(measure).cast("double").alias("__b")), list(on)).withColumn("__d", F.col(measure).cast("double") - F.col("__b"))
    g = both.groupBy(*keys, source).agg(F.sum("__d").alias("s"), F.count("__d").alias("n"))
    t = g.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    j = g.join(t, list(keys)).where(F.col(source).isNotNull()).withColumn("share", F.col("n") / F.col("tn")).where(F.col("share") >= least)
    return j.select(*keys, source, F.round("share", 6).alias("share"), F.round(F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")), 6).alias("difference"))


def leave_source_out_intervals(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str], source: str, group: str, measure: str, least: float = 0.1, draws: int = 2000, seed: int = 20260815) -> DataFrame:
    """(keys, left_out, statistic, estimate, lo, hi, n_groups): paired_differences without each source that holds at least the given share of the
    rows of its key, so of 1 / least sources at most."""
    both = a.join(b.select(*on, F.col(measure).cast("double").alias("__b")), list(on)).withColumn("__d", F.col(measure).cast("double") - F.col("__b"))
    n = both.groupBy(*keys, source).agg(F.count("__d").alias("n"))
    major = n.join(n.groupBy(*keys).agg(F.sum("n").alias("tn")), list(keys)).where(F.col(source).isNotNull() & (F.col("n") >= least * F.col("tn"))).select(*keys, F.col(source).alias("left_out"))
    rest = both.join(major, list(keys)).where(~F.col(source).eqNullSafe(F.col("left_out")))
    return group_bootstrap(rest, [*keys, "left_out"], group, {"difference": F.col("__d")}, {"difference": F.when(F.col("__d").isNotNull(), 1)}, draws, seed)
