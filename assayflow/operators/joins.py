"""Joins with checks and reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.operators.contracts import duplicate_keys, refuse

SMALL = 8 << 20  # bytes of a side that may be broadcast
FANS = 64  # tasks that pairs of many rows are spread over; their tables are small, and would be coalesced into few


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if the optimizer proves it small; otherwise the join is left to the planner."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], compare: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Left join to a table with unique keys (refused otherwise): its other columns, matched (boolean) and conflict, the first column
    of compare that both sides fill with different texts. Columns of compare keep the left value where it is filled.
    Rows with a null key match nothing; left rows are neither lost nor multiplied."""
    keys = list(on)
    if check:
        refuse(duplicate_keys(right.dropna(subset=keys), keys), "keys of the lookup table are not unique")
    r = right.dropna(subset=keys).select(*keys, *[F.col(c).alias(f"__r_{c}") for c in right.columns if c not in keys], F.lit(True).alias("__hit"))
    j = left.join(r, keys, "left")
    same = lambda c: F.lower(F.trim(F.col(c).cast("string"))) == F.lower(F.trim(F.col(f"__r_{c}").cast("string")))
    conflict = F.coalesce(*[F.when(~same(c), F.lit(c)) for c in compare], F.lit(None).cast("string"))
    taken = [F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in compare else F.col(c) for c in left.columns]
    new = [F.col(f"__r_{c}").alias(c) for c in right.columns if c not in left.columns]
    return j.select(*taken, *new, F.coalesce("__hit", F.lit(False)).alias("matched"), conflict.alias("conflict"))


def side_by_side(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with side: both, left_only, right_only; columns other than the keys are a_* and b_*."""
    x = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in on], F.lit(1).alias("__a"))
    y = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on], F.lit(1).alias("__b"))
    side = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), "both").when(F.col("__a").isNotNull(), "left_only").otherwise("right_only")
    return x.join(y, list(on), "full_outer").withColumn("side", side).drop("__a", "__b")


def rule_match(rows: DataFrame, row_id: str, rules: DataFrame, rule_id: str, base: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """(row_id, outcome, rule): the rule that holds for a row. Rules match on base columns and, where their optional ones are not null, on
    these. Outcomes: matched; ambiguous_rules (rule: their ids, joined); missing_constraint (rule: the columns that the row lacks, joined); no_matching_rule; no_rule (no
    rule of the base at all). The rule table is small; where that can't be proven the join shuffles on the base columns."""
    r = rules.select(F.col(rule_id).alias("__rule"), *base, *[F.col(c).alias(f"__r_{c}") for c in optional])
    j = rows.select(row_id, *base, *optional).join(small_side(r), list(base), "left")
    fits, lacks = F.lit(True), []
    for c in optional:
        fits = fits & (F.col(f"__r_{c}").isNull() | F.coalesce(F.col(f"__r_{c}") == F.col(c), F.lit(False)))
        lacks.append(F.when(F.col(f"__r_{c}").isNotNull() & F.col(c).isNull(), F.lit(c)))
    j = j.withColumn("__fits", F.col("__rule").isNotNull() & fits).withColumn("__lacks", F.array_compact(F.array(*lacks)) if lacks else F.array().cast("array<string>"))
    g = j.groupBy(row_id).agg(F.count("__rule").alias("n"), F.array_sort(F.collect_set(F.when(F.col("__fits"), F.col("__rule")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__lacks")))).alias("lacks"))
    outcome = F.when(F.size("hits") == 1, "matched").when(F.size("hits") > 1, "ambiguous_rules").when(F.col("n") == 0, "no_rule").when(F.size("lacks") > 0, "missing_constraint").otherwise("no_matching_rule")
    named = F.when(F.size("hits") > 0, F.array_join("hits", ";")).when(F.col("n") > 0, F.nullif(F.array_join("lacks", ";"), F.lit("")))
    return g.select(row_id, outcome.alias("outcome"), named.alias("rule"))


def reconcile(a: DataFrame, a_id: str, b: DataFrame, b_id: str, on: Sequence[str]) -> DataFrame:
    """(a_id, outcome, n_matches, partner): rows of b with the same normalised texts in all columns of on: unique_match (with the
    partner), ambiguous_match or no_match. Null and blank texts match blank ones, except in the first column, the key."""
    norm = lambda c: F.coalesce(F.lower(F.regexp_replace(F.trim(F.col(c).cast("string")), r"\s+", " ")), F.lit(""))
    x = a.select(F.col(a_id).alias("__a"), *[norm(c).alias(f"__k{i}") for i, c in enumerate(on)])
    y = b.select(F.col(b_id).alias("__b"), *[norm(c).alias(f"__k{i}") for i, c in enumerate(on)]).where("__k0 <> ''")
    keys = [f"__k{i}" for i in range(len(on))]
    y = y.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__b").alias("p"))
    n = F.coalesce("n", F.lit(0))
    return x.join(y, keys, "left").select(F.col("__a").alias(a_id), F.when(n == 1, "unique_match").when(n > 1, "ambiguous_match").otherwise("no_match").alias("outcome"), n.alias("n_matches"), F.when(n == 1, F.col("p")).alias("partner"))


def identifier_overlap(a: DataFrame, a_id: str, b: DataFrame, b_id: str, identifiers: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(identifier_type, identifier, a_ids, b_ids): identifiers of any type that both tables hold, with the rows that hold them, sorted and joined."""
    def long(df: DataFrame, key: str, side: int, name: str) -> DataFrame:
        ids = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), cols[side].alias("v")) for t, cols in identifiers.items()]))
        rows = df.select(F.col(key).alias("k"), ids.alias("i")).where("i.v is not null and trim(i.v) <> ''")
        return rows.groupBy(F.col("i.t").alias("identifier_type"), F.col("i.v").alias("identifier")).agg(F.array_join(F.array_sort(F.collect_set("k")), ";").alias(name))
    return long(a, a_id, 0, "a_ids").join(long(b, b_id, 1, "b_ids"), ["identifier_type", "identifier"])


def whole_profiles(profiles: DataFrame, key: str, profile: str) -> DataFrame:
    """(k, p) of the profiles (arrays of one length) without a null place."""
    return profiles.where(F.col(profile).isNotNull() & ~F.exists(profile, lambda x: x.isNull())).select(F.col(key).alias("k"), F.col(profile).alias("p"))


def holes_of(profiles: DataFrame, *also: str) -> DataFrame:
    """(hole, v, p, also): each profile p with one place left out, once for each place, and the value v of that place. Whole profiles only."""
    holes = profiles.select("p", *also, F.posexplode("p").alias("at", "v"))
    return holes.select(F.struct("at", F.transform("p", lambda x, i: F.when(i != F.col("at"), x)).alias("rest")).alias("hole"), "v", "p", *also)


def one_apart(profiles: DataFrame, key: str, profile: str) -> DataFrame:
    """(a, b), a < b: profiles (arrays of one length) that differ in exactly one place, a row for each pair of rows; profiles with a null
    place are in no pair. Different profiles meet by an equi-join on each with one place left out; two profiles that differ in one place have one
    such form in common, so no pair comes twice. Then each pair of profiles meets its keys, so rows that share a profile cost nothing but
    their own pairs, which are not sorted or sent again."""
    whole = whole_profiles(profiles, key, profile)
    holes = holes_of(whole.select("p").distinct())
    left, right = holes.select("hole", F.col("p").alias("pa"), F.col("v").alias("va")), holes.select("hole", F.col("p").alias("pb"), F.col("v").alias("vb"))
    near = left.hint("merge").join(right, "hole").where("va < vb").select("pa", "pb")
    of = lambda k, p: whole.select(F.col("k").alias(k), F.col("p").alias(p))
    half = near.hint("merge").join(of("ka", "pa"), "pa").select("ka", "pb")
    pairs = half.repartition(FANS, "pb").hint("merge").join(of("kb", "pb").repartition(FANS, "pb"), "pb").where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def links_one_apart(profiles: DataFrame, key: str, profile: str) -> DataFrame:
    """(a, b): a few links that join the same keys to groups as the pairs of one_apart, at most one for each row and each place of a different
    profile. Profiles that are alike but for one place are all pairs of one another, and so are their keys, directly or through the other
    profile: each is tied to the least key there. A profile that no other is next to ties nothing, though several keys may have it."""
    whole = whole_profiles(profiles, key, profile)
    holes = holes_of(whole.groupBy("p").agg(F.min("k").alias("first")), "first")
    met = holes.groupBy("hole").agg(F.min("first").alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("hole", "a")
    tied = holes.hint("merge").join(met, "hole").select("a", F.col("first").alias("b"), "p")
    own = tied.groupBy("p").agg(F.min("b").alias("a")).hint("merge").join(whole, "p").select("a", F.col("k").alias("b"))
    return tied.select("a", "b").unionByName(own).where("a <> b").distinct()


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key in a total order; limited in each task before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def nearest_with(pairs: DataFrame, query: str, relative: str, similarity: Column, tie: Column, facts: DataFrame, fact_id: str, topics: Sequence[str], apart: str, k: int = 200) -> DataFrame:
    """(query, topics, relative, similarity): for each query and topic the most similar relative, among the query's k most similar ones, that
    has a fact on the topic and lies in another fold (apart). Ties go to the greater tie, then to the smaller relative."""
    p = pairs.where(F.col(query) != F.col(relative)).select(F.col(query).alias("q"), F.col(relative).alias("r"), similarity.alias("sim"), tie.alias("tie"))
    p = top_k(p, ["q"], [F.desc("sim"), F.desc("tie"), F.asc("r")], k)
    own = facts.select(F.col(fact_id).alias("q"), *topics, F.col(apart).alias("__qa")).distinct()
    theirs = facts.select(F.col(fact_id).alias("r"), *topics, F.col(apart).alias("__ra")).distinct()
    hits = p.join(own, "q").join(theirs, ["r", *topics]).where("__qa <> __ra")
    best = top_k(hits, ["q", *topics], [F.desc("sim"), F.desc("tie"), F.asc("r")], 1)
    return best.select(F.col("q").alias(query), *topics, F.col("r").alias(relative), F.col("sim").alias("similarity"))
