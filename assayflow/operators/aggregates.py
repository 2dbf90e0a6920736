"""Aggregates over censored measurements and their predictions. Everything is combined before the shuffle; nothing gathers a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.functions.interval import INF, interval_error, rounded_half_up

RANGES = 64  # of scores of one key that are cumulated apart


def intersect_intervals(df: DataFrame, keys: Sequence[str], sign: str, value: str, unit: str, row: str, record: str | None = None) -> DataFrame:
    """One row for each key: the intersection of its measurements.

    outcome: single, interval_intersection, repeat_unit_conflict, discordant_repeat_measurements or repeat_not_representable; sign and
    value of the intersection where it is one-sided or a point; n_rows; carrier, the least row. An exclusive end beats an inclusive one at
    the same value. Rows without a comparator or a positive value must be routed away before; ids are listed where record is given.
    """
    s, v = F.col(sign), F.col(value)
    lower = F.max(F.when(s.isin("=", ">=", ">"), F.struct(v.alias("v"), (s == ">").alias("open"))))
    upper = F.min(F.when(s.isin("=", "<=", "<"), F.struct(v.alias("v"), (s != "<").alias("closed"))))
    extra = [F.array_join(F.array_sort(F.collect_set(record)), ";").alias("reconciled_from")] if record else []
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(unit).alias("u1"), F.max(unit).alias("u2"), lower.alias("lo"), upper.alias("hi"), F.min(row).alias("carrier"), F.min_by(sign, row).alias("s0"), F.min_by(value, row).alias("v0"), *extra)
    lo, hi, lo_open, hi_open = F.col("lo.v"), F.col("hi.v"), F.col("lo.open"), ~F.col("hi.closed")
    empty = (lo > hi) | ((lo == hi) & (lo_open | hi_open))
    both = lo.isNotNull() & hi.isNotNull()
    outcome = F.when(F.col("n_rows") == 1, "single").when(F.col("u1") != F.col("u2"), "repeat_unit_conflict").when(both & empty, "discordant_repeat_measurements").when(both & (lo != hi), "repeat_not_representable").otherwise("interval_intersection")
    ok = F.col("outcome").isin("single", "interval_intersection")
    out_sign = F.when(F.col("outcome") == "single", F.col("s0")).when(both, "=").when(lo.isNotNull(), F.when(lo_open, ">").otherwise(">=")).otherwise(F.when(hi_open, "<").otherwise("<="))
    out_value = F.when(F.col("outcome") == "single", F.col("v0")).otherwise(F.coalesce(lo, hi))
    return g.withColumn("outcome", outcome).select(*keys, "outcome", F.when(ok, out_sign).alias("sign"), F.when(ok, out_value).alias("value"), "n_rows", "carrier", *(["reconciled_from"] if record else []))


def score(df: DataFrame, predicted: str, lo: str, hi: str) -> DataFrame:
    """df with p (prediction rounded half up), error, agrees (within one dilution), exact, over and under (by two and more)."""
    p, a, b = rounded_half_up(F.col(predicted)), F.col(lo), F.col(hi)
    error = interval_error(p, a, b)
    return df.withColumns({"p": p, "error": error, "agrees": error <= 1, "is_exact": (a == b), "over": (p - b) >= 2, "under": (a - p) >= 2})


def agreement_measures() -> list[Column]:
    """Aggregates of a scored table."""
    n = lambda c: F.count_if(c)
    exact = F.col("is_exact")
    r = lambda c, name: F.round(c, 6).alias(name)
    return [
        F.count("*").alias("n"), n(exact).alias("n_exact"), n(~exact).alias("n_censored"), r(F.avg(F.col("agrees").cast("double")), "agreement"),
        r(F.avg(F.when(exact, F.col("agrees").cast("double"))), "agreement_exact"), r(F.avg(F.when(exact, (F.col("error") == 0).cast("double"))), "exact_match"),
        r(F.avg(F.col("over").cast("double")), "over_call"), r(F.avg(F.col("under").cast("double")), "under_call"), r(F.avg(F.when(exact, F.col("p") - F.col("lo"))), "bias"),
    ]


def best_constant(df: DataFrame, topics: Sequence[str], fold: str, lo: str, hi: str) -> DataFrame:
    """(topics, fold, constant): the dilution that agrees best with all other folds; ties by exact agreement, then the lower one.

    Intervals are first counted, and the counts of the other folds are the totals less the fold's own, so rows are read once.
    """
    cells = df.groupBy(*topics, fold, lo, hi).agg(F.count("*").alias("n"))
    span = cells.groupBy(*topics).agg(F.min(F.when(F.col(lo) != -INF, F.col(lo))).alias("a1"), F.min(F.when(F.col(hi) != INF, F.col(hi))).alias("a2"), F.max(F.when(F.col(lo) != -INF, F.col(lo))).alias("b1"), F.max(F.when(F.col(hi) != INF, F.col(hi))).alias("b2"))
    span = span.select(*topics, F.explode(F.sequence((F.floor(F.least("a1", "a2")) - 1).cast("int"), (F.floor(F.greatest("b1", "b2")) + 1).cast("int"))).alias("c"))
    hits = cells.join(span, list(topics)).withColumn("ok", interval_error(F.col("c").cast("double"), F.col(lo), F.col(hi)) <= 1).withColumn("ex", F.col(lo) == F.col(hi))
    per = hits.groupBy(*topics, "c", fold).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("ex"), F.col("n")).otherwise(0)).alias("ne"), F.sum(F.when(F.col("ok") & F.col("ex"), F.col("n")).otherwise(0)).alias("ke"))
    total = per.groupBy(*topics, "c").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "k", "ne", "ke")])
    rest = per.join(total, [*topics, "c"]).select(*topics, fold, "c", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n", "k", "ne", "ke")]).where("n > 0")
    rank = F.struct(F.round(F.col("k") / F.col("n"), 9).alias("ea"), F.coalesce(F.round(F.try_divide("ke", "ne"), 9), F.lit(-1.0)).alias("ee"), (-F.col("c")).alias("c"))
    return rest.groupBy(*topics, fold).agg(F.max(rank).alias("r")).select(*topics, fold, (-F.col("r.c")).alias("constant"))


def confusion(df: DataFrame, keys: Sequence[str], truth: str, score_: str, threshold: Column) -> DataFrame:
    """Counts and ratios of a binary decision score >= threshold; a ratio without a denominator is null."""
    y, hit = F.col(truth) == 1, F.col(score_) >= threshold
    g = df.groupBy(*keys).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"), F.round(F.avg(F.pow(F.col(score_) - F.col(truth), 2)), 6).alias("brier"))
    d = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns({"sensitivity": d(tp, tp + fn), "specificity": d(tn, tn + fp), "ppv": d(tp, tp + fp), "npv": d(tn, tn + fn), "balanced_accuracy": F.round((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, 6), "mcc": d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def score_curve(df: DataFrame, keys: Sequence[str], truth: str, score_: str) -> DataFrame:
    """(keys, score, pos, neg, pos_ge, neg_ge, P, N): of each different score the cases at it and from it upwards. One row for each
    score. Scores are cut into ranges at their percentiles, cumulated within a range, and the sums of the higher ranges are added, so
    no task orders all scores of a key. Rows with a null score are left out."""
    g = df.where(F.col(score_).isNotNull()).groupBy(*keys, F.col(score_).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    # ranges by the scores themselves, whose number is bounded by RANGES for each key
    cuts = g.groupBy(*keys).agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], F.lit(1000)).alias("__cuts"))
    g = g.join(cuts, list(keys)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("score")))).drop("__cuts")
    sums = g.groupBy(*keys, "__range").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    all_, higher = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("__range"))
    over = sums.select(*keys, "__range", (F.sum("__p").over(higher) - F.col("__p")).alias("__p"), (F.sum("__n").over(higher) - F.col("__n")).alias("__n"), F.sum("__p").over(all_).alias("P"), F.sum("__n").over(all_).alias("N"))
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc("score"))
    return g.join(over, [*keys, "__range"]).select(*keys, "score", "pos", "neg", (F.sum("pos").over(down) + F.col("__p")).alias("pos_ge"), (F.sum("neg").over(down) + F.col("__n")).alias("neg_ge"), "P", "N")


def ranking_quality(df: DataFrame, keys: Sequence[str], truth: str, score_: str) -> DataFrame:
    """(keys, auroc, average_precision): ties of scores share their rank; null where a class is missing."""
    c = score_curve(df, keys, truth, score_)
    area = F.sum(F.col("pos") * (F.col("N") - F.col("neg_ge") + F.col("neg") / 2))
    ap = F.sum(F.col("pos") * F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge")))
    return c.groupBy(*keys).agg(F.round(F.try_divide(area, F.max(F.col("P") * F.col("N"))), 6).alias("auroc"), F.round(F.try_divide(ap, F.max("P")), 6).alias("average_precision"))


def choose_threshold(df: DataFrame, keys: Sequence[str], truth: str, score_: str, least: float = 0.9) -> DataFrame:
    """(keys, threshold, sensitivity, specificity, feasible) among 0, 1 and all scores: the most specific one of at least the given
    sensitivity (then the most sensitive, then the greatest); if there is none the most sensitive (then specific, then greatest)."""
    c = score_curve(df, keys, truth, score_)
    ends = c.groupBy(*keys).agg(F.max("P").alias("P"), F.max("N").alias("N"), F.count_if(F.col("score") >= 1).alias("__one"), F.max(F.when(F.col("score") >= 1, F.col("pos_ge"))).alias("p1"), F.max(F.when(F.col("score") >= 1, F.col("neg_ge"))).alias("n1"))
    bounds = ends.select(*keys, F.inline(F.array(F.struct(F.lit(0.0).alias("score"), F.col("P").alias("pos_ge"), F.col("N").alias("neg_ge")), F.struct(F.lit(1.0).alias("score"), F.coalesce("p1", F.lit(0)).alias("pos_ge"), F.coalesce("n1", F.lit(0)).alias("neg_ge")))), "P", "N")
    t = c.select(*keys, F.col("score").cast("double").alias("score"), "pos_ge", "neg_ge", "P", "N").unionByName(bounds.select(*keys, "score", "pos_ge", "neg_ge", "P", "N")).where("P > 0 and N > 0")
    sens, spec = F.round(F.col("pos_ge") / F.col("P"), 9), F.round(1 - F.col("neg_ge") / F.col("N"), 9)
    t = t.withColumns({"sens": sens, "spec": spec})
    ok = F.max(F.when(F.col("sens") >= least, F.struct("spec", "sens", "score")))
    fallback = F.max(F.struct("sens", "spec", "score"))
    g = t.groupBy(*keys).agg(ok.alias("a"), fallback.alias("b"))
    pick = lambda f: F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}"))
    return g.select(*keys, pick("score").alias("threshold"), F.round(pick("sens"), 6).alias("sensitivity"), F.round(pick("spec"), 6).alias("specificity"), F.col("a").isNotNull().alias("feasible"))


def leave_fold_out_mean(df: DataFrame, topics: Sequence[str], fold: str, y: str) -> DataFrame:
    """(topics, fold, score): the mean of y over the other folds."""
    g = df.groupBy(*topics, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    total = g.groupBy(*topics).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return g.join(total, list(topics)).select(*topics, fold, F.round(F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")), 6).alias("score"))


def intraclass(df: DataFrame, keys: Sequence[str], group: str, x: str) -> DataFrame:
    """One-way analysis of variance by key: icc, size-weighted group size, design effect, proportion and half width of its interval."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys, group).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("v"))
    t = g.groupBy(*keys).agg(F.count("*").cast("double").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("sx"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sxx"))
    ssb = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("N")
    msb, msw = F.try_divide(ssb, F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("N") - F.col("k"))
    m0 = F.try_divide(F.col("N") - F.col("n2") / F.col("N"), F.col("k") - 1)
    t = t.withColumns({"icc": F.greatest(F.lit(0.0), F.try_divide(msb - msw, msb + (m0 - 1) * msw)), "mean_size": F.col("n2") / F.col("N"), "p": F.col("sx") / F.col("N")})
    deff = 1 + (F.col("mean_size") - 1) * F.col("icc")
    return t.select(*keys, F.round("icc", 6).alias("icc"), F.round("mean_size", 6).alias("group_size"), F.round(deff, 6).alias("design_effect"), F.round("p", 6).alias("proportion"), F.round(1.96 * F.sqrt(F.greatest(F.lit(0.0), F.col("p") * (1 - F.col("p"))) * deff / F.col("N")), 6).alias("half_width"))


def concentration_of_groups(df: DataFrame, keys: Sequence[str], group: str, record: str) -> DataFrame:
    """By key: coverage (records with a group), groups, largest share, inverse Simpson, groups that cover half of the records, singletons."""
    per = df.select(*keys, group, record).distinct()
    sizes = per.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"))
    # groups of one size are taken together, so the cumulative sum runs over sizes, not over groups
    bands = sizes.groupBy(*keys, "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(F.col("n") * F.col("k")).over(w.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.withColumns({"before": before, "all": F.sum(F.col("n") * F.col("k")).over(w)})
    need = F.greatest(F.lit(0), F.least(F.col("k"), F.ceil((F.col("all") / 2 - F.col("before")) / F.col("n"))))
    g = bands.groupBy(*keys).agg(F.sum("k").alias("n_groups"), F.max("all").alias("n_grouped"), F.max("n").alias("largest"), F.sum(F.col("n") * F.col("n") * F.col("k")).alias("n2"), F.sum(need).alias("groups_for_half"), F.sum(F.when(F.col("n") == 1, F.col("k")).otherwise(0)).alias("n_singletons"))
    n = per.groupBy(*keys).agg(F.countDistinct(record).alias("n_records"))
    return n.join(g, list(keys), "left").select(*keys, "n_records", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce("n_grouped", F.lit(0)) / F.col("n_records"), 6).alias("coverage"), F.round(F.col("largest") / F.col("n_grouped"), 6).alias("largest_share"), F.round(F.col("n_grouped") * F.col("n_grouped") / F.col("n2"), 6).alias("inverse_simpson"), "groups_for_half", "n_singletons")


def field_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n_present, n_missing): of all columns in one pass; blanks are missing."""
    present = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    counts = df.agg(F.count("*").alias("__n"), *[present(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("n_present"), (F.col("__n") - F.col(f"c{i}")).alias("n_missing")) for i, c in enumerate(columns)])))
