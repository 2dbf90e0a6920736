import pytest

from assayflow.llm.matching import group_messages, one_to_one, propagate

SCHEMA = "a string, b string, grp string, z string, s double"


def test_rivals_share_and_groups_decide(spark):
    rows = [
        ("a1", "b1", "g1", "z1", 4.0), ("a2", "b1", "g2", "z1", 1.0),  # two rows want b1
        ("a3", "b3", "g3", "z3", 1.0), ("a3", "b4", "g3", "z4", 1.0), ("a4", "b5", "g3", "z3", 5.0),  # the group's other row names z3
        ("a6", "b6", None, "z6", -5.0), ("a7", "b7", None, "z7", 2.0),
    ]
    got = {(x.a, x.b): x.probability for x in propagate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a1", "b1"] > 0.9 and got["a2", "b1"] < 0.1
    assert got["a3", "b3"] > 0.9 and got["a3", "b4"] < 0.1 and got["a4", "b5"] > 0.95
    assert got["a6", "b6"] < 0.05 and got["a7", "b7"] == pytest.approx(1 / (1 + 2.718281828**-2), abs=0.01)
    pairs = {(x.a, x.b) for x in one_to_one(propagate(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert pairs == {("a1", "b1"), ("a3", "b3"), ("a4", "b5"), ("a7", "b7")}


def test_equal_rivals_and_no_rows(spark):
    rows = [("a1", "b1", None, "z", 3.0), ("a2", "b1", None, "z", 3.0)]
    got = [x.probability for x in propagate(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got[0] == pytest.approx(got[1], abs=0.01)
    assert propagate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_marginals_of_a_small_problem(spark):
    """On a tree of factors belief propagation is exact: compare with all assignments."""
    import itertools
    import math

    rows = [("a1", "b1", None, "z1", 1.0), ("a1", "b2", None, "z2", 0.5), ("a2", "b2", None, "z2", 1.5), ("a3", "b3", None, "z3", -0.5)]
    total, on = 0.0, [0.0] * len(rows)
    for pick in itertools.product((0, 1), repeat=len(rows)):
        chosen = [r for r, k in zip(rows, pick, strict=True) if k]
        if len({r[0] for r in chosen}) == len(chosen) == len({r[1] for r in chosen}):
            w = math.exp(sum(r[4] for r in chosen))
            total += w
            on = [o + w * k for o, k in zip(on, pick, strict=True)]
    got = {(x.a, x.b): x.probability for x in propagate(spark.createDataFrame(rows, SCHEMA), damping=0.0, tolerance=1e-6, group_most=0.0).collect()}
    assert all(abs(got[r[0], r[1]] - o / total) < 0.01 for r, o in zip(rows, on, strict=True))


def said_by_group(rows, most=8.0):
    """Messages by the definition: for each row and entity the sums over the other rows, each by its best pair."""
    import math

    parts = {}
    for a, _, grp, z, s in rows:
        parts.setdefault(grp, {}).setdefault(a, {})[z] = max(s, parts.get(grp, {}).get(a, {}).get(z, -99.0))
    out = {}
    for a, b, grp, z, _ in rows:
        if len(parts[grp]) == 1:
            out[a, b] = 0.0
            continue
        others = [p for k, p in parts[grp].items() if k != a]
        total = {e: sum(math.log1p(math.exp(p[e])) for p in others if e in p) for e in {e for p in parts[grp].values() for e in p}}
        against = math.log(1 + sum(math.exp(t) for e, t in total.items() if e != z))
        out[a, b] = max(-most, min(most, total[z] - against))
    return out


def test_messages_of_groups_leave_the_own_row_out(spark):
    from pyspark.sql import functions as F

    rows = [
        ("a1", "b1", "g1", "z1", 3.0), ("a2", "b2", "g1", "z1", 3.0),  # the right sample has one candidate for each row
        *[(a, f"{a}c{i}", "g1", "z2", 2.0) for a in ("a1", "a2") for i in range(5)],  # another one has five tests of the drug
        ("a3", "b3", "g2", "z1", 4.0), ("a3", "b4", "g2", "z1", 4.0), ("a3", "b5", "g2", "z2", 1.0),  # alone: nobody speaks
        *[(f"r{i}", f"{z}{i}", "g3", z, s) for i in range(12) for z, s in (("z3", 12.0), ("z4", 11.0))],  # large sums
    ]
    want = said_by_group(rows)
    got = {(x.a, x.b): x.g for x in group_messages(spark.createDataFrame(rows, SCHEMA), F.col("s"), 8.0).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    p = {(x.a, x.b): x.probability for x in propagate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert p["a1", "b1"] > 0.5 and p["a2", "b2"] > 0.5
    assert all(p["a1", f"a1c{i}"] < 0.1 for i in range(5))


def test_marginals_with_groups_of_several_candidates(spark):
    """One round from rest: the belief of a pair is its odds and message against those of its row's other pairs."""
    import math

    rows = [("a1", "b1", "g", "z1", 1.0), ("a1", "b2", "g", "z1", 0.5), ("a1", "b3", "g", "z2", 0.0), ("a2", "b4", "g", "z1", 0.5), ("a2", "b5", "g", "z2", -0.5), ("a3", "b6", None, "z1", 1.0), ("a3", "b7", None, "z1", 0.0), ("a3", "b8", None, "z2", 0.5)]
    g = said_by_group([(a, b, grp or a, z, s) for a, b, grp, z, s in rows])
    odds = {(a, b): math.exp(s + g[a, b]) for a, b, _, _, s in rows}
    got = {(x.a, x.b): x.probability for x in propagate(spark.createDataFrame(rows, SCHEMA), damping=0.0, tolerance=1e-9).collect()}
    for a, b, *_ in rows:
        assert got[a, b] == pytest.approx(odds[a, b] / (1 + sum(o for (x, _), o in odds.items() if x == a)), abs=1e-4)
