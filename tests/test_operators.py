import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.operators import aggregates as agg
from assayflow.operators import contracts, folds, graph, joins, models, resample, routing
from assayflow.operators.features import hierarchy, mean_vectors


def test_routing_is_a_partition(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    reasons = {"no_a": F.col("a").isNull(), "no_b": F.col("b").isNull()}
    ok, bad = routing.routed(df, routing.first_match(reasons))
    assert ok.count() == 1 and {r.reason for r in bad.collect()} == {"no_a", "no_b"}
    assert [r.r for r in df.select(routing.all_matches(reasons).alias("r")).collect()] == ["no_b", None, "no_a;no_b"]


def test_contracts(spark):
    df = spark.createDataFrame([("a", "x", "dev"), ("a", "y", "ext"), ("b", "x", "dev"), (None, "z", None)], "k string, v string, s string")
    assert {r.k for r in contracts.duplicate_keys(df, ["k"]).collect()} == {"a", None}
    assert [r.k for r in contracts.dependency_violations(df, "k", "v").collect()] == ["a"]
    assert [r.k for r in contracts.crossing_groups(df, "k", "s").collect()] == ["a"]
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["q"])
    with pytest.raises(contracts.ContractError):
        contracts.refuse(contracts.duplicate_keys(df, ["k"]), "twice")
    report = {r.rule: r.n_rows for r in contracts.validation_report(df, {"no_k": ("failure", F.col("k").isNull()), "none": ("warning", F.col("v") == "q")}).collect()}
    assert report == {"no_k": 1, "none": 0}


def test_lookup_join(spark):
    left = spark.createDataFrame([("a", "1"), ("b", None), (None, "3"), ("c", "4")], "k string, v string")
    right = spark.createDataFrame([("a", "2", "p"), ("b", "5", "q"), (None, "9", "r")], "k string, v string, w string")
    got = {r.k: (r.v, r.w, r.matched, r.conflict) for r in joins.lookup_join(left, right, ["k"], ["v"]).collect()}
    assert got == {"a": ("1", "p", True, "v"), "b": ("5", "q", True, None), None: ("3", None, False, None), "c": ("4", None, False, None)}
    with pytest.raises(contracts.ContractError):
        joins.lookup_join(left, right.union(right), ["k"])


def test_rule_match(spark):
    rows = spark.createDataFrame([(1, "x", "m"), (2, "x", None), (3, "y", "m"), (4, "z", "m"), (5, "x", "q")], "id int, d string, m string")
    rules = spark.createDataFrame([("r1", "x", "m"), ("r2", "z", None), ("r3", "z", "m")], "rule_id string, d string, m string")
    got = {r.id: (r.outcome, r.rule) for r in joins.rule_match(rows, "id", rules, "rule_id", ["d"], ["m"]).collect()}
    assert got == {1: ("matched", "r1"), 2: ("missing_constraint", "m"), 3: ("no_rule", None), 4: ("ambiguous_rules", "r2;r3"), 5: ("no_matching_rule", None)}


def test_one_apart_against_all_pairs(spark):
    r = random.Random(5)
    ps = [(i, [r.randrange(3) for _ in range(4)]) for i in range(60)] + [(99, [None, 1, 1, 1])]
    got = {(x.a, x.b) for x in joins.one_apart(spark.createDataFrame(ps, "k int, p array<int>"), "k", "p").collect()}
    assert got == {(a, b) for a, p in ps for b, q in ps if a < b and None not in p + q and sum(x != y for x, y in zip(p, q, strict=True)) == 1}


def test_one_apart_does_not_shuffle_its_pairs(spark):
    """Rows that share a profile: each pair of rows once, repeated rows too, and no exchange or sort above the join that makes the pairs."""
    ps = [(i, [str(i % 2), "x|y", "z"]) for i in range(6)] + [(0, ["0", "x|y", "z"]), (50, ["9", "x", "y|z"])]
    df = joins.one_apart(spark.createDataFrame(ps, "k int, p array<string>"), "k", "p")
    assert sorted((x.a, x.b) for x in df.collect()) == sorted((a, b) for a, p in ps for b, q in ps if a < b and sum(x != y for x, y in zip(p, q, strict=True)) == 1)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_links_make_the_groups_of_all_pairs(spark):
    """Sparse links against all pairs: alone with a twin, keys with two profiles, null places; and no more links than rows and places."""
    r = random.Random(11)
    for kinds in (2, 4, 9):
        ps = [(r.randrange(70), [r.randrange(kinds) for _ in range(3)]) for _ in range(60)] + [(99, [None, 1, 1]), (101, [50, 51, 52]), (102, [50, 51, 52]), (5, [50, 51, 52])]
        df = spark.createDataFrame(ps, "k int, p array<int>")
        links = [(x.a, x.b) for x in joins.links_one_apart(df, "k", "p").collect()]
        group = lambda edges: {k: v.root for k, v in ((x.id, x) for x in graph.linked_groups(spark.createDataFrame(edges, "a int, b int"), "a", "b", df, "k").collect())}  # noqa: E731, B023
        assert group(links) == group([(x.a, x.b) for x in joins.one_apart(df, "k", "p").collect()])
        assert len(links) <= 4 * len(ps)


@pytest.mark.parametrize(("rows", "want"), [
    ([("=", 2.0, "u")], ("single", "=", 2.0)), ([("<=", 2.0, "u"), ("<", 2.0, "u")], ("interval_intersection", "<", 2.0)), ([(">", 2.0, "u"), (">=", 2.0, "u")], ("interval_intersection", ">", 2.0)),
    ([(">=", 2.0, "u"), ("<=", 2.0, "u")], ("interval_intersection", "=", 2.0)), ([(">", 2.0, "u"), ("<=", 2.0, "u")], ("discordant_repeat_measurements", None, None)), ([(">", 2.0, "u"), ("<=", 4.0, "u")], ("repeat_not_representable", None, None)),
    ([("=", 2.0, "u"), ("=", 2.0, "w")], ("repeat_unit_conflict", None, None)), ([("=", 2.0, "u"), ("=", 4.0, "u")], ("discordant_repeat_measurements", None, None)),
])
def test_interval_intersection_in_any_order(spark, rows, want):
    for k in range(2):
        d = spark.createDataFrame([("g", s, v, u, i) for i, (s, v, u) in enumerate(rows[::-1] if k else rows)], "g string, s string, v double, u string, r int")
        r = agg.intersect_intervals(d, ["g"], "s", "v", "u", "r").first()
        assert (r.outcome, r.sign, r.value) == want


def test_ranking_against_pairs(spark):
    r = random.Random(3)
    rows = [("m", r.randrange(2), r.choice([0.1, 0.2, 0.5, 0.9, 1.0])) for _ in range(60)]
    q = agg.ranking_quality(spark.createDataFrame(rows, "k string, y int, s double"), ["k"], "y", "s").first()
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    assert abs(q.auroc - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-6


def components(pairs, extra=()):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    for x in extra:
        find(x)
    return {x: find(x) for x in parent}


def test_linked_groups(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(40)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    df = spark.createDataFrame([*pairs, (None, "n01"), ("n02", None)], "a string, b string")
    got = graph.linked_groups(df, "a", "b", spark.createDataFrame([("zz",), (None,)], "id string"))
    assert {x.id: x.root for x in got.collect()} == components(pairs, ["zz"])
    labels = graph.dense_labels(got, "root", "g-%03d").select("root", "label").distinct().collect()
    assert [x.label for x in sorted(labels, key=lambda x: x.root)] == [f"g-{i + 1:03}" for i in range(len(labels))]


def test_capped_merge():
    lineage = {"a": "L1", "b": "L2", "c": "L3", "d": "L1"}
    seeds = {"a": "a", "d": "a", "b": "b", "c": "c"}
    root, removed, ledger = graph.capped_merge([("a", "b", 0.9), ("b", "c", 0.8), ("a", "d", 0.99)], lineage, seeds, most=3, stop_share=1.0)
    assert root["a"] == root["b"] == root["d"] == "a" and removed == {"c"} and [x[2] for x in ledger] == ["within_lineage", "merged", "removed c"]
    with pytest.raises(ValueError, match="cross"):
        graph.capped_merge([("a", "b", 0.9)], lineage, seeds, most=3)


def test_folds_keep_units(spark):
    rows = [(f"u{i % 13}", f"s{i % 3}") for i in range(130)] + [(None, "s0")]
    got = {r.u: r.fold for r in folds.assign_folds(spark.createDataFrame(rows, "u string, s string"), "u", "s", 4).collect()}
    assert len(got) == 13 and set(got.values()) == {0, 1, 2, 3}
    assert folds.assign_folds(spark.createDataFrame([], "u string, s string"), "u", "s").count() == 0


def test_bootstrap(spark):
    r = random.Random(2)
    rows = [("k", f"g{i % 20}", r.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, g string, x double")
    got = resample.group_bootstrap(df, ["k"], "g", {"mean": F.col("x")}, {"mean": F.lit(1)}, draws=100).first()
    assert got.lo < got.estimate < got.hi and got.n_groups == 20
    again = resample.group_bootstrap(df.repartition(7), ["k"], "g", {"mean": F.col("x")}, {"mean": F.lit(1)}, draws=100).first()
    assert got == again


def test_gradient_and_fit():
    r = np.random.default_rng(0)
    x = (r.random((300, 3)) < 0.4) * 1.0
    y = np.clip(np.ceil(-3 + 3 * x[:, 0] + 2 * x[:, 1] + r.normal(0, 0.7, 300)), -2, 4)
    lo, hi = np.where(y <= -2, -np.inf, y), np.where(y >= 4, np.inf, y)
    t = np.array([0.3, 0.2, 0.5, -0.4, 0.1])
    _, g = models.objective(t, x, lo, hi, 0.5)
    num = [(models.objective(t + e, x, lo, hi, 0.5)[0] - models.objective(t - e, x, lo, hi, 0.5)[0]) / 2e-5 for e in np.eye(5) * 1e-5]
    assert np.allclose(g, num, rtol=1e-4)
    fit = models.fit_ridge(x, lo, hi, 0.01)
    assert abs(fit[2] - 3) < 0.4 and abs(fit[3] - 2) < 0.4
    for m in (fit, models.fit_boosted(x, lo, hi, trees=150, depth=2)):
        p = np.floor(models.predict(m, x) + 0.5)
        assert np.mean(np.maximum(np.maximum(p - hi, lo - p), 0) <= 1) > 0.85
    a, b = models.principal_components(x, x[:5], 2)
    assert a.shape == (300, 2) and np.allclose(a[:5], b)


def test_ridge_ends_at_its_minimum(monkeypatch):
    """Features that sum to one and a small penalty: the gradient vanishes after few evaluations, from a start of another penalty too."""
    r = np.random.default_rng(1)
    group, site = r.integers(0, 40, 800), r.integers(0, 6, 800)
    y = np.round(r.normal(group % 5, 1.0) + site % 2)
    lo, hi = np.where(y < 0, -np.inf, y), np.where(y > 4, np.inf, y)
    x = models.Indicators(np.tile(np.arange(800), 2), np.concatenate([group, 40 + site]), (800, 46))
    calls = []
    monkeypatch.setattr(models, "interval_probability", lambda a, b, f=models.interval_probability: calls.append(1) or f(a, b))
    theta = None
    for penalty in (100.0, 0.1, 0.001):
        theta = models.fit_ridge(x, lo, hi, penalty, start=theta)
        value, grad = models.objective(theta, x, lo, hi, penalty)
        assert np.abs(grad).max() < 1e-2
    assert models.objective(models.fit_ridge(x, lo, hi, 0.001), x, lo, hi, 0.001)[0] == pytest.approx(value, abs=1e-4)
    assert len(calls) < 80


def test_nested_predictions(spark):
    r = random.Random(0)
    rows = []
    for i in range(120):
        f = ["a"] if r.random() < 0.5 else []
        d = float((3 if f else 0) + r.choice([0, 0, 1]))
        rows.append(("t", f"r{i}", f"g{i % 24}", i % 24 % 3, d, d, f))
    df = spark.createDataFrame(rows, "t string, r string, g string, fold int, lo double, hi double, f array<string>")
    p = models.nested_predictions(df, "t", "r", "g", "fold", "lo", "hi", "f", "ridge", (10.0, 0.1)).join(df.select("r", "lo"), "r").toPandas()
    assert len(p) == 120 and (p.predicted - p.lo).abs().mean() < 0.8


def test_features(spark):
    d = spark.createDataFrame([("r", "blaTEM-1", "A/B"), ("r", "gyrA_S83L", None), (None, "x1", "C")], "r string, s string, c string")
    assert {x.feature for x in hierarchy(d, "r", "s", "c").collect()} == {"blaTEM-1", "gyrA_S83L", "family:blaTEM", "class:A", "class:B"}
    v = mean_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, None)], "k int, v array<double>"), ["k"], "v").collect()
    assert [(r.k, r.vector) for r in v] == [(1, [2.0, 3.0])]


def test_score_curve_in_ranges(spark):
    """Cumulated over ranges and offsets as over one sorted list, with ties, nulls and a key of few scores."""
    r = random.Random(5)
    rows = [("a", r.randrange(2), round(r.random(), 3)) for _ in range(4000)] + [("b", 1, 0.5), ("b", 0, 0.5), ("c", 1, 0.25), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    got = {(x.k, x.score): (x.pos, x.neg, x.pos_ge, x.neg_ge, x.P, x.N) for x in agg.score_curve(df, ["k"], "y", "s").collect()}
    want = {}
    for k, s in {(k, s) for k, _, s in rows if s is not None}:
        mine = [(y, t) for q, y, t in rows if q == k and t is not None]
        n = lambda y, keep: sum(v == y and keep(t) for v, t in mine)  # noqa: B023, E731
        want[k, s] = (n(1, lambda t: t == s), n(0, lambda t: t == s), n(1, lambda t: t >= s), n(0, lambda t: t >= s), n(1, lambda t: True), n(0, lambda t: True))  # noqa: B023
    assert got == want
    assert agg.score_curve(df.limit(0), ["k"], "y", "s").count() == 0


def test_values_of_violations_are_exact(spark):
    rows = [("k", f"v{i}") for i in range(1000)] + [("one", "x"), ("one", "x"), (None, "x"), ("two", None)]
    got = contracts.dependency_violations(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert [tuple(r) for r in got] == [("k", 1000)]


def test_places_in_order(spark):
    rows = [(f"k{i % 700:04d}",) for i in range(2000)] + [(None,)]
    got = graph.ranked(spark.createDataFrame(rows, "k string").repartition(7), "k").collect()
    assert {r.k: (r["rank"], r["of"]) for r in got} == {f"k{i:04d}": (i, 700) for i in range(700)}
    assert graph.ranked(spark.createDataFrame([], "k string"), "k").count() == 0
