import pytest
from pyspark.sql import functions as F

from assayflow.operators import rule_tables, typing_results
from assayflow.operators.contracts import ContractError
from assayflow.operators.measurement import concordance, decimal_equal, measurement_type, only_measurement, record_id, same_when_present


def test_measurement_types(spark):
    rows = [("2", None), (" ", "15"), ("2", "15"), ("x", "15"), ("<NA>", None), ("x", "y"), (None, None)]
    d = spark.createDataFrame(rows, "m string, z string")
    got = [tuple(r.t) for r in d.select(measurement_type(F.col("m"), F.col("z")).alias("t")).collect()]
    assert got == [("MIC", 2.0, "mg/L", "2"), ("ZONE", 15.0, "mm", "15"), (None, 2.0, None, "2"), ("ZONE", 15.0, "mm", "x"), (None, None, None, None), (None, None, None, "x"), (None, None, None, None)]
    got = [tuple(r.t) for r in d.select(only_measurement(F.col("m"), F.col("z")).alias("t")).collect()]
    assert got[:4] == [("MIC", "2", "mg/L"), ("ZONE", "15", "mm"), (None, None, None), (None, None, None)]


def test_ids_and_agreement(spark):
    d = spark.createDataFrame([("id1", "s", " S ", "1.0", "1"), (" ", None, None, "x", "x"), (None, "r", "S", "2", "2.10")], "id string, a string, b string, c string, d string")
    ids = [tuple(r.r) for r in d.select(record_id(d, "id", ["a", "b"]).alias("r")).collect()]
    assert ids[0] == ("id1", "native") and ids[1][1] == "digest" and ids[1][0].startswith("sha256-") and ids[1][0] != ids[2][0]
    assert [r.x for r in d.select(concordance(F.col("a"), F.lit("S")).alias("x")).collect()] == ["CONCORDANT", "NOT_REPORTED", "DISCORDANT"]
    assert [r.x for r in d.select(decimal_equal(F.col("c"), F.col("d")).alias("x")).collect()] == [True, False, False]
    assert [r.x for r in d.select(same_when_present(F.col("b"), F.col("a")).alias("x")).collect()] == ["true", "not_asserted", "false"]


def test_sequence_types_and_profiles(spark):
    d = spark.createDataFrame([(" 007 ", "perfect"), ("0", "OKAY"), ("12", "novel"), ("x", "OKAY"), (None, "OKAY"), ("131", "Okay ")], "st string, status string")
    assert [r.x for r in d.select(typing_results.sequence_type_lineage(F.col("st"), F.col("status")).alias("x")).collect()] == ["ST7", None, None, None, None, "ST131"]
    p = spark.createDataFrame([("s", "fumC(11);adk(10) ; gyrB"), ("s", ""), (None, "adk(1);fumC(2);gyrB(3)")], "scheme string, a string").withColumn("p", typing_results.allele_profile(F.col("a")))
    assert [[tuple(x) for x in r.p] for r in p.collect()] == [[("adk", "10"), ("fumC", "11"), ("gyrB", "")], [], [("adk", "1"), ("fumC", "2"), ("gyrB", "3")]]
    assert typing_results.other_scheme(p, "scheme", "p", "s", ["gyrB", "adk", "fumC"]).count() == 2
    m = spark.createDataFrame([("EXACTX",), (" partial_contig_endX",), ("PARTIALX",), (None,)], "m string")
    assert [r.x for r in m.select(typing_results.complete(F.col("m")).alias("x")).collect()] == [True, True, False, False]


def test_lineage_groups_against_all_pairs(spark):
    import random

    r = random.Random(4)
    profile = {k: [str(r.randrange(3)) for _ in range(4)] for k in range(1, 40)}
    rows = [(i, k, profile[k], k % 3 != 0 and r.random() < 0.6) for i in range(160) for k in [r.randrange(1, 40)]]
    df = spark.createDataFrame([(i, f"ST{k}", p, d) for i, k, p, d in rows] + [(999, None, ["1"] * 4, True)], "i int, st string, p array<string>, d boolean")
    got = {x.i: (x.lineage_group, x.basis) for x in typing_results.lineage_groups(df, "i", "st", "p", F.col("d")).collect()}
    weight = {k: sum(d for _, q, _, d in rows if q == k) for k in {q for _, q, _, _ in rows}}
    core = [k for k, w in weight.items() if w]
    near = lambda a, b: sum(x != y for x, y in zip(profile[a], profile[b], strict=True)) == 1
    group = {}
    for k in core:
        seen, todo = {k}, [k]
        while todo:
            a = todo.pop()
            todo += [b for b in core if b not in seen and near(a, b)]
            seen |= {b for b in core if near(a, b)}
        group[k] = min(seen, key=lambda q: (-weight[q], q))
    want = {}
    for i, k, _, _ in rows:
        met = {group[b] for b in core if near(k, b)}
        want[i] = (f"SLV:ST{group[k]}", "within") if k in group else (f"SLV:ST{met.pop()}", "neighbour_of_one") if len(met) == 1 else (f"SLV:ST{k}", "outside")
    assert got == want and {b for _, b in want.values()} == {"within", "neighbour_of_one", "outside"}
    with pytest.raises(ContractError):
        typing_results.lineage_groups(df.unionByName(spark.createDataFrame([(1000, f"ST{rows[0][1]}", ["9"] * 4, True)], df.schema)), "i", "st", "p", F.col("d"))


def test_calls_overlaps_and_carriers(spark):
    rows = [("a", "g1", "AMR", "EXACT", "s", 1), ("a", " g1", "AMR", "ALLELE", "s", 2), ("a", "g2", "STRESS", "EXACT", "s", 3), ("b", "g1", "AMR", "PARTIAL", "s", 4), ("b", "g1", "AMR", "BLASTX", "t", 5), ("c", "g9", None, None, None, 6)]
    calls = typing_results.element_calls(spark.createDataFrame(rows, "r string, g string, k string, m string, s string, n int"), "r", "g", "k", "m", [F.asc("n")])
    assert {x.n: x.outcome for x in calls.collect()} == {1: "call", 2: "duplicate_call", 3: "excluded_type", 4: "excluded_method", 5: "call", 6: "excluded_type"}
    report = {x.measure: x.n for x in typing_results.element_summary(calls, "r", "g", "s").collect()}
    assert report == {"records": 3, "records_without_call": 1, "calls": 2, "elements": 1, "subtype:s": 1, "subtype:t": 1, "duplicate_call": 1, "excluded_type": 2, "excluded_method": 1}
    hits = spark.createDataFrame([("x", 99.5, 90.0), ("x", 99.0, 95.0), ("y", 91.0, 80.0), ("z", 89.0, 99.0)], "q string, i double, c double")
    best = typing_results.best_overlap(hits, "q", "i", "c")
    assert {x.q: x.overlap for x in best.collect()} == {"x": "near_identical", "y": "close", "z": "not_found"}
    uses = spark.createDataFrame([("x", "g"), ("x", "g"), ("y", "h"), ("w", "h")], "s string, gene string")
    got = {(x.scope, x.gene, x.overlap): x.n for x in typing_results.overlap_summary(uses, "s", "gene", best, top=1).collect()}
    assert got == {("sequences", None, "near_identical"): 1, ("sequences", None, "close"): 1, ("sequences", None, "not_found"): 1, ("uses", None, "near_identical"): 2, ("uses", None, "close"): 1, ("uses", None, "not_found"): 1, ("gene", "g", "near_identical"): 2}
    f = spark.createDataFrame([("a", "t"), ("a", "t"), (None, "t"), ("b", "u")], "r string, f string")
    train, test = typing_results.carriers(spark.createDataFrame([("a",), ("b",), (None,)], "r string"), "r", f, "f", "t")
    assert [x.r for x in test.collect()] == ["a"] and {x.r for x in train.collect()} == {"b", None}
    with pytest.raises(ContractError):
        typing_results.carriers(train, "r", f, "f", "t")


def test_detection(spark):
    inf = float("inf")
    rows = [("m", 1.4, 2.0, inf), ("m", 1.6, 2.0, inf), ("m", 0.0, 0.0, 0.0), ("q", 3.0, 0.0, 0.0)]
    got = {x.k: (x.n, x.n_right_censored, x.detected_share, x.agreement) for x in typing_results.detection(spark.createDataFrame(rows, "k string, p double, lo double, hi double"), ["k"], "p", "lo", "hi").collect()}
    assert got == {"m": (3, 2, 0.5, 1.0), "q": (1, 0, None, 0.0)}


def test_tables_that_steer(spark):
    rules = spark.createDataFrame([("r1", "a", "MIC", "1", "2", "AB"), ("r1 ", "b", "zone", "9", "9", "cd"), ("", "", "x", "1e", None, None)], "id string, d string, t string, lo string, hi string, h string")
    got = {(x.rule_id, x.violation) for x in rule_tables.rule_violations(rules, "id", ["d"], "t", "lo", "hi", "h", "ab").collect()}
    assert got == {("r1", "duplicate_id"), ("r1 ", "other_artifact"), ("", "missing_id"), ("", "missing_d"), ("", "unknown_type"), ("", "bad_threshold"), ("", "other_artifact")}
    assert [tuple(x) for x in rule_tables.rule_violations(rules.limit(0), "id", ["d"], "t", "lo", "hi").collect()] == [(None, "no_rules")]
    assert [x.c for x in rules.select(rule_tables.constraints(rules, ["d", "h"]).alias("c")).collect()] == [{"d": "a", "h": "AB"}, {"d": "b", "h": "cd"}, {}]
    rule_tables.require_order({"near": 99.9, "duplicate": 99.99}, ["near", "duplicate"], 0, 100)
    for plan in ({"near": 99.99, "duplicate": 99.9}, {"near": 99.9}, {"near": True, "duplicate": 99}, {"near": 99, "duplicate": 101}):
        with pytest.raises(ContractError):
            rule_tables.require_order(plan, ["near", "duplicate"], 0, 100)
    d = spark.createDataFrame([("k", "S"), ("k", "R"), ("j", "S"), ("i", None)], "g string, v string")
    assert {(x.value, x.issue) for x in rule_tables.set_differences(d, "v", ["S", "I"], "categories").collect()} == {("R", "unexpected"), ("I", "absent")}
    assert {x.g: x.missing for x in rule_tables.lacks_values(d, ["g"], "v", ["S", "R"]).collect()} == {"j": "R", "i": "R;S"}
    got = {x.g: (x.field, x.stored, x.derived) for x in rule_tables.rederived(d.where("v is null or v = 'R'"), "g", {"v": F.when(F.col("g") == "k", "R").otherwise("S")}).collect()}
    assert got == {"i": ("v", None, "S")}
