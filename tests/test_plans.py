import hashlib
from itertools import combinations

import numpy as np
import pytest

from assayflow.operators import models
from assayflow.plans import measures, tables


def test_profiles_of_all_parts(spark, tmp_path):
    """Neighbours and groups of parts with any key, against all pairs."""
    parts = [(k, k % 50) for k in [*range(1, 40), *range(580, 640), *range(973, 1000), 20_000, 5_000_000_000]]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k, _ in parts[::3] for _ in range(k % 5)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    ps = {k: [s % 3, k % 4, *[k // n % 3 for n in (4, 12, 36, 108, 324)]] for k, s in parts}
    want = {(a, b) for a, b in combinations(sorted(ps), 2) if sum(x != y for x, y in zip(ps[a], ps[b], strict=True)) == 1}
    assert {(x.a, x.b) for x in tables.profiles_one_apart(spark, str(tmp_path)).collect()} == want
    assert any(b > 600 for _, b in want)
    name = {x.k: x.group_name for x in tables.groups_of_profiles(spark, str(tmp_path)).collect()}
    assert set(name) == set(ps) and all(name[a] == name[b] for a, b in want)


def test_ridge_of_every_drug_and_penalty(spark, monkeypatch):
    """Drugs of any name get results, and a penalty of the grid's ends is chosen where it is best."""
    rng = np.random.default_rng(3)
    rows = []
    for drug in ("colistin", "ciprofloxacin"):
        for i in range(240):
            y = float(rng.integers(-6, 7)) if drug == "colistin" else 10.0 * (i % 3)
            rows.append((f"{drug}{i}", drug, i % 4, f"l{i % 24}", f"s{i % 3}", "n", y, y))
    df = spark.createDataFrame(rows, "id string, drug string, fold int, lineage string, source string, network string, lo double, hi double")
    monkeypatch.setattr(measures, "references", lambda spark, sf_dir: df)
    got = measures.nested_ridge(spark, "").collect()
    assert {(x.drug, x.fold, x.n) for x in got} == {(d, f, 60) for d in ("colistin", "ciprofloxacin") for f in range(4)}
    assert any(x.choice not in (100.0, 10.0, 1.0) for x in got)


def test_weights_are_repeated_rows():
    rng = np.random.default_rng(5)
    x, lo, w = (rng.random((30, 4)) < 0.5).astype(float), rng.integers(-3, 4, 30).astype(float), rng.integers(1, 6, 30)
    hi = np.where(rng.random(30) < 0.2, np.inf, lo)
    many = [np.repeat(v, w, axis=0) for v in (x, lo, hi)]
    places = models.Indicators(*np.nonzero(x), x.shape)
    assert models.fit_ridge(places, lo, hi, 1.0, weight=w.astype(float)) == pytest.approx(models.fit_ridge(*many, 1.0), abs=1e-3)
    assert models.predict(models.fit_boosted(x, lo, hi, 20, weight=w.astype(float)), x) == pytest.approx(models.predict(models.fit_boosted(*many, 20), x), abs=1e-6)
    keep = lo > 0
    assert np.allclose(places[keep] @ np.arange(4.0), x[keep] @ np.arange(4.0)) and np.allclose(places[keep].T @ lo[keep], x[keep].T @ lo[keep])


def test_bootstrap_queries_take_2000_draws(spark, monkeypatch):
    """Both queries against the draws made here, one by one."""
    rng = np.random.default_rng(7)
    rows = [(m, f"t{i}", "d", f"l{i % 9}", "s", float(p), 0.0, 0.0) for i in range(60) for m, p in ((1, rng.integers(0, 4)), (2, rng.integers(0, 4)))]
    df = spark.createDataFrame(rows, "model int, id string, drug string, lineage string, source string, predicted double, lo double, hi double")
    monkeypatch.setattr(measures, "predictions", lambda spark, sf_dir: df)
    hit = {(m, i): int(p <= 1) for m, i, _, _, _, p, _, _ in rows}
    of = [[f"t{i}" for i in range(60) if i % 9 == g] for g in range(9)]
    picks = [[int(hashlib.sha256(f"20260815:{d}:{k}".encode()).hexdigest()[:8], 16) % 9 for k in range(9)] for d in range(2000)]
    for got, value in ((measures.bootstrap_agreement(spark, ""), lambda t: hit[1, t]), (measures.paired_difference(spark, ""), lambda t: hit[1, t] - hit[2, t])):
        means = [np.mean([value(t) for g in pick for t in of[g]]) for pick in picks]
        row = got.where("statistic in ('agreement', 'difference')").first()
        assert [row.lo, row.hi] == pytest.approx(list(np.quantile(means, [0.025, 0.975])), abs=2e-6)
        assert [row.lo, row.hi] != pytest.approx(list(np.quantile(means[:200], [0.025, 0.975])), abs=2e-6)


def test_both_models_on_either_side(spark, monkeypatch):
    rows = [(1, "a", 0.0), (1, "b", 0.0), (1, "b2", 0.0), (2, "b", 0.0), (2, "b2", 1.0), (2, "c", 0.0), (2, "d", 0.0), (2, "e", 0.0)]
    df = spark.createDataFrame(rows, "model int, id string, predicted double")
    monkeypatch.setattr(measures, "predictions", lambda spark, sf_dir: df)
    assert {tuple(r) for r in measures.models_side_by_side(spark, "").collect()} == {("both", 2), ("left_only", 1), ("right_only", 3)}


def test_requests_in_batches(spark, tmp_path):
    """Batches and digests of digests against a list, for fewer requests than batches, none, and repeats."""
    for n in (0, 1, 5, 16, 2503):
        names = [f"S{i:06d}" for i in range(n)]
        spark.createDataFrame([(x,) for x in [*names, *names[:3], None]], "biosample_accession string").write.parquet(f"{tmp_path}/{n}/sequence_requests.parquet")
        want, at = {}, 0
        for b in range(16):
            size = n // 16 + (b < n % 16)
            mine = list(enumerate(names))[at : at + size]
            at += size
            blocks = {}
            for k, x in mine:
                blocks.setdefault(k // tables.BLOCK, []).append(x)
            if mine:
                want[b + 1] = (size, hashlib.sha256("\n".join(hashlib.sha256("\n".join(v).encode()).hexdigest() for _, v in sorted(blocks.items())).encode()).hexdigest())
        assert {r.batch: (r.n, r.digest) for r in tables.request_batches(spark, f"{tmp_path}/{n}").collect()} == want


def test_routing_with_null_and_placeholder_ids(spark, tmp_path):
    columns = ["scientific_name", "mic_secondary", "disk_diffusion_secondary", "raw_ast_value", "measurement_sign", "antibiotic", "isolate_id", "biosample_accession", "source_ast_record_id", "source_dataset"]
    row = lambda rid: ("Escherichia coli", None, None, "2", "=", "x", "i", "b", rid, "d")
    ids = [None] * 40 + ["unknown"] * 30 + ["r1", "r2", "r2", "r3"]
    df = spark.createDataFrame([row(r) for r in ids], ", ".join(f"{c} string" for c in columns)).selectExpr("*", "1 as source_row_number")
    df.write.parquet(f"{tmp_path}/normalized_ast.parquet")
    assert {r.reason: r.n_rows for r in tables.structural_routing(spark, str(tmp_path)).collect()} == {"included": 42, "duplicate_record_id": 32}
