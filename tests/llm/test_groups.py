import random
from collections import Counter

from pyspark.sql import functions as F

from assayflow.llm.components import connected_components
from assayflow.llm.consensus import closest_to_consensus, consensus, profile_of
from assayflow.llm.overlap import cross_split_matches, winnow
from assayflow.llm.splits import deal, related_units, spanning_forest


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_noise(spark):
    r = random.Random(7)
    pairs = [(f"c{i:04}", f"c{i + 1:04}") for i in range(200)] + [("hub", f"h{i}") for i in range(100)] + [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(60)] + [("self", "self")]
    r.shuffle(pairs)
    rows = [(a, b, "x") for a, b in pairs] + [(b, a, "y") for a, b in pairs[:50]] + [(None, "n1", "z"), ("n2", None, "z")]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(rows, "a string, b string, component string"), "a", "b").collect()}
    assert got == roots(pairs)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "a string, b string")
    assert connected_components(df, "a", "b").count() == 0
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_spanning_forest(spark):
    r = random.Random(2)
    links = [(f"n{r.randrange(50):02}", f"n{r.randrange(50):02}", r.randrange(5)) for _ in range(90)]
    nodes, forest = spanning_forest(spark.createDataFrame([*links, (None, "n01", 1)], "a string, b string, w int"), "a", "b", "w")
    true = roots([(a, b) for a, b, _ in links if a != b])
    got = {x.node: x.root for x in nodes.collect()}
    assert got.keys() == true.keys()
    assert Counter(frozenset(k for k in got if got[k] == v) for v in set(got.values())) == Counter(frozenset(k for k in true if true[k] == v) for v in set(true.values()))
    edges = forest.collect()
    assert len(edges) == len(got) - len(set(got.values()))
    best, weight = {}, 0  # Kruskal's forest has the same weight
    for a, b, w in links:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(w, best.get(k, w))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, b), w in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            weight += w
    assert sum(e.weight for e in edges) == weight


def test_units_and_nulls(spark):
    rows = [("i1", "g1", None), ("i2", "g1", "d1"), ("i3", None, "d1"), ("i4", None, None), (None, "g1", None), ("i5", "g9", None), ("i1", "g1", None)]
    units, _ = related_units(spark.createDataFrame(rows, "i string, g string, d string"), "i", {"L": F.col("g"), "D": F.col("d")})
    assert {x.i: x.unit for x in units.collect()} == {"i1": "i1", "i2": "i1", "i3": "i1", "i4": "i4", "i5": "i5"}
    none, forest = related_units(spark.createDataFrame([], "i string, g string, d string"), "i", {"L": F.col("g")})
    assert none.count() == 0 and forest.count() == 0


def test_deal_meets_the_proportions_of_each_band(spark):
    rows = [(f"u{i:04}", 1 if i < 700 else 5) for i in range(1000)]
    got = deal(spark.createDataFrame(rows, "u string, n long"), "u", "n", (("train", 0.8), ("validation", 0.1), ("test", 0.1))).collect()
    for n, of in ((1, 700), (5, 300)):
        c = Counter(x.split for x in got if x.n == n)
        assert all(abs(c[s] - p * of) <= 1 for s, p in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert deal(spark.createDataFrame([], "u string, n long"), "u", "n", (("train", 1.0),)).count() == 0


def test_lone_large_units_go_to_all_splits(spark):
    """Bands of one unit: the offset is carried over, so the records keep their proportions to within the largest unit."""
    sizes = [900, 430, 300, 140, 130, 70, 40, 36, 20, 17, 9, 8, 5, *[1] * 700]
    rows = [(f"u{i:04}", n, "old") for i, n in enumerate(sizes)] + [(None, 3, "old"), ("u0003", 140, "old")]
    got = deal(spark.createDataFrame(rows, "u string, n long, split string"), "u", "n", (("train", 0.8), ("validation", 0.1), ("test", 0.1))).collect()
    assert len(got) == len(rows) and len({x.split for x in got if x.u == "u0003"}) == 1
    held = {s: sum(n for _, n, split in {tuple(x) for x in got} if split == s) for s in ("train", "validation", "test")}
    assert all(abs(held[s] - p * sum(held.values())) <= 40 for s, p in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert {x.split for x in got if x.n >= 36} == {"train", "validation", "test"}


def test_forest_outlasts_the_job(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "r string, g string")
    _, forest = related_units(df, "r", {"g": F.col("g")}, keep=f"{tmp_path}/forest")
    assert spark.read.parquet(f"{tmp_path}/forest").count() == forest.count() == 2


def test_winnowing_finds_every_common_run():
    r = random.Random(3)
    for _ in range(50):
        run = "".join(r.choice("abcd") for _ in range(32))
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(60))) + run + "".join(r.choice("abcd") for _ in range(r.randrange(60))) for _ in range(2))
        assert {h for _, h in winnow(a, 16, 17)} & {h for _, h in winnow(b, 16, 17)}
    assert winnow("", 4, 3) == [] and len(winnow("ab", 4, 3)) == 1


def test_pairs_against_brute_force(spark):
    """Prefixes by rarity lose no pair: all pairs of texts are compared by the definition. Phrases that all texts hold are among them."""
    from assayflow.llm.overlap import aligned

    r = random.Random(12)
    phrase = "the strain was read twice and differed by one dilution from the earlier value. "
    body = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    bases = [body(240) for _ in range(6)]
    texts = []
    for i in range(48):
        t = bases[i % 6]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "x", body(30)]) + t[at + 1 :]
        texts.append((f"t{i}", "ab"[i % 2 if i % 7 else 0], t[: r.choice([240, 200, 90])] + (phrase if i % 5 else "")))
    texts += [("p", "a", phrase), ("q", "b", phrase), ("x", "a", "x" * 9000), ("y", "b", "x" * 9000 + "y"), ("z", "b", "short")]
    want = {}
    for ia, sa, a in texts:
        for ib, sb, b in texts:
            if sa == "a" and sb == "b":
                ha, hb = {h for _, h in winnow(a, 16, 17)}, {h for _, h in winnow(b, 16, 17)}
                n = len(ha & hb)
                m = aligned(a, b, 16, 17)
                if n and (n >= 0.8 * len(ha) or n >= 0.8 * len(hb)) and max(m / len(a), m / len(b)) >= 0.8:
                    want[ia, ib] = m
    df = spark.createDataFrame(texts, "text_id string, side string, text string")
    got = {(x.id_a, x.id_b): x.common for x in cross_split_matches(df).collect()}
    assert got == want and len(want) > 20 and ("p", "q") in want and ("x", "y") in want
    # an equi-join of the texts, or of their digests, gives other rows
    assert set(want) != {(a[0], b[0]) for a in texts for b in texts if a[1] == "a" and b[1] == "b" and a[2] == b[2]}


def test_shared_identities_need_the_fingerprints(spark, tmp_path):
    """Isolates that share one of three identities: their record texts differ, so joining equal texts gives nothing."""
    from assayflow.llm.q_groups import identity_texts, p6_documents, p6_found, p6_report

    rows = [("d1", "Development ", "D-01", "c1", "aa" * 32, "n"), ("d2", "development", "D2", "c2", "bb" * 32, "n"), ("d3", "development", None, "unknown", None, "n"), ("e1", "external", "d 1", "c9", "cc" * 32, None), ("e2", "EXTERNAL", "D7", "C-02", "dd" * 32, "m"), ("e3", "external", "D8", "c10", ("BB" * 32), "m"), ("e4", "external", "D11", "c11", "ee" * 32, "m"), ("e5", None, "D1", "c1", None, "m"), ("d1", "external", "D-01", None, None, "n")]
    spark.createDataFrame(rows, "isolate_id string, evaluation_split string, deduplication_group string, genomic_cluster string, genome_sha256 string, surveillance_network string").write.parquet(f"{tmp_path}/isolate_metadata.parquet")
    found = {(x.isolate_a, x.isolate_b) for x in p6_found(spark, str(tmp_path)).collect()}
    assert found == {("d1", "e1"), ("d2", "e2"), ("d2", "e3")}
    texts = identity_texts(spark, str(tmp_path))
    sides = [{x.text for x in texts.where(F.col("side") == s).collect()} for s in ("development", "external")]
    assert not sides[0] & sides[1]
    report = {(x.evaluation_split, x.surveillance_network): (x.n_isolates, x.n_overlapping) for x in p6_report(spark, str(tmp_path)).collect()}
    assert report == {("development", "n"): (2, 2), ("external", None): (1, 1), ("external", "m"): (3, 2), ("external", "n"): (1, 1)}
    text = "The reader of plate 17 wrote down two values for the same well and kept them both until the run of May was repeated. "
    docs = [(1, text, "s", "d2"), (2, text, "s", "d2"), (3, text.replace("May", "June"), "q", "e2"), (4, "other words " * 20, "q", "e2"), (5, None, "q", "e2"), (6, text, "s", None), (7, text, "s", "d1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, isolate_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.class_id, x.evaluation_split, x.n_links) for x in p6_documents(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "development", 1), 2: (1, "development", 1), 3: (3, "external", 1)}


def test_cross_split_matches(spark):
    base = "the strain was read twice and differed by one dilution from the earlier value in every well of the plate"
    other = "unrelated words fill this text up to a similar length so that nothing of it is shared with any base at all"
    texts = [("t1", "a", base), ("t2", "b", base.replace("twice", "again")), ("t3", "b", other), ("t4", "a", None), ("t5", "b", ""), ("t6", "b", base)]
    got = {(x.id_a, x.id_b): x.coverage_a for x in cross_split_matches(spark.createDataFrame(texts, "text_id string, side string, text string"), k=8, w=9).collect()}
    assert got.keys() == {("t1", "t2"), ("t1", "t6")} and got["t1", "t6"] == 1.0 and 0.8 < got["t1", "t2"] < 1
    assert cross_split_matches(spark.createDataFrame([], "text_id string, side string, text string")).count() == 0


def test_consensus_votes_by_tier():
    profile, _ = profile_of([("0.25", {"2020": 1}), ("0.52", {"2019": 9}), ("0.5", {"2019": 3})])
    assert consensus(profile) == "0.25"
    profile, _ = profile_of([("1025", {"t": 2}), ("1035", {"t": 1}), ("1125", {"t": 1})])
    assert consensus(profile) == "1025"


def test_closest_value(spark):
    rows = [("g", "16", "2020|2", 1), ("g", "32", "2019|3", 5), ("g", "64", "2020|1", 5), ("one", "7", "1", 1), (None, "1", "1", 1), ("null", None, "1", 1), ("tie", "12", "5", 1), ("tie", "13", "5", 1), ("tie", "13", "4", 9)]
    got = {x.g: x.v for x in closest_to_consensus(spark.createDataFrame(rows, "g string, v string, t string, n long"), "g", "v", "t", "n").collect()}
    assert got == {"g": "16", "one": "7", "tie": "13"}


def test_large_group_goes_in_blocks(spark):
    rows = [("g", f"{i:05}", "1", 1) for i in range(600)] + [("g", "00421", "2", 1)]
    got = closest_to_consensus(spark.createDataFrame(rows, "g string, v string, t string, n long"), "g", "v", "t", "n").collect()
    assert [(x.g, x.v) for x in got] == [("g", "00421")]


def record_rows(spark, path, rows):
    columns = "source_ast_record_id string, source_record_checksum string, measurement_sign string, ast_value double, source_dataset string, source_release string, raw_antibiotic string, ast_platform string"
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/normalized_ast.parquet")


def test_alignment_decides_where_no_release_goes_before(spark, tmp_path):
    """Columns outvote the most frequent value: picking that one instead of aligning gives other rows."""
    from assayflow.llm.q_records import p2_consensus, p2_found

    names = ["ceftriaxone 30", "ceftriaxon 30", "ceftriaxone", "ceftriaxone 3", "cro", "cro"]
    rows = [("r1", None, "=", float(2**i), "legacy mirror", f"20{i}", n, None) for i, n in enumerate(names)]
    rows += [("r2", None, "<=", 2.0, "legacy mirror", "201", "gentamicin", "Osmora"), ("r2", None, "<", float("inf"), "x", "209", "gentamicin", "n/a"), ("r3", None, None, None, "x", "1", None, None), ("r2", None, None, 4e18, "x", "300", None, "")]
    record_rows(spark, tmp_path, rows)
    got = {(x.record_id, x.field): x.value for x in p2_consensus(spark, str(tmp_path)).collect()}
    most_frequent = max(sorted(set(names)), key=names.count)
    assert got == {("r1", "raw_antibiotic"): "ceftriaxone"} and most_frequent == "cro"
    best = {x.record_id: (x.measurement_sign, x.value_nano) for x in p2_found(spark, str(tmp_path)).collect()}
    assert best == {"r1": ("=", 32 * 10**9), "r2": ("<", 1 << 62)}


def test_streamed_alignment_is_that_of_a_list(spark):
    """Groups of 600 values pass a task one by one, and end as if they had been a list."""
    r = random.Random(2)
    rows = [(f"g{k}", "".join(r.choice("0123456789") for _ in range(r.randrange(2, 6))), r.choice("abc"), r.randrange(1, 4)) for k in range(2) for _ in range(700)]
    rows += [("g0", v, t, n) for _, v, t, n in rows[:20]]
    votes = {}
    for g, v, t, n in rows:
        d = votes.setdefault(g, {}).setdefault(v, {})
        d[t] = d.get(t, 0) + n
    got = {x.g: x.v for x in closest_to_consensus(spark.createDataFrame(rows, "g string, v string, t string, n long"), "g", "v", "t", "n").collect()}
    for g, vs in votes.items():
        agreed = consensus(profile_of(list(vs.items()))[0])
        assert got[g] == min(vs, key=lambda v: (edits(v, agreed), [(-ord(t), -n) for t, n in sorted(vs[v].items(), reverse=True)], v))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
