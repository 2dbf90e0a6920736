import datetime as dt
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.functions import interval as iv
from assayflow.functions.calendar import date_text, days_from_civil, instant_text
from assayflow.functions.normal import interval_log_likelihood, interval_probability
from assayflow.operators.features import gene_family
from assayflow.operators.sequences import base_counts, locus, reverse_complement
from assayflow.operators.timestamps import normalise_timestamps
from assayflow.text import alias_coalesce, canonical_headers, clean, is_placeholder, label_key

INF = float("inf")


@pytest.mark.parametrize(("sign", "value", "want"), [("=", 4.0, (2, 2)), ("<=", 4.0, (-INF, 2)), ("<", 4.0, (-INF, 1)), (">=", 0.25, (-2, INF)), (">", 8.0, (4, INF)), ("=", 3.0, None), ("?", 4.0, None), (None, 4.0, None), ("=", None, None), ("=", 0.06, (-4, -4))])
def test_dilution_bounds(spark, sign, value, want):
    r = spark.createDataFrame([(sign, value)], "s string, v double").select(iv.dilution_bounds(F.col("s"), iv.dilution(F.col("v"))).alias("b")).first().b
    assert (None if r is None else (r.lo, r.hi)) == want


@pytest.mark.parametrize(("p", "lo", "hi", "want"), [(2.0, 2.0, 2.0, 0), (4.0, 2.0, 2.0, 2), (0.0, 2.0, INF, 2), (9.0, 2.0, INF, 0), (3.0, -INF, 1.0, 2)])
def test_interval_error(spark, p, lo, hi, want):
    assert spark.createDataFrame([(p, lo, hi)], "p double, lo double, hi double").select(iv.interval_error(F.col("p"), F.col("lo"), F.col("hi")).alias("e")).first().e == want


@pytest.mark.parametrize(("kind", "sign", "v", "want"), [("MIC", "=", 1.0, "S"), ("MIC", "<=", 1.0, "S"), ("MIC", "<=", 2.0, None), ("MIC", "=", 2.0, "I"), ("MIC", ">", 4.0, "R"), ("MIC", ">=", 4.0, None), ("MIC", "<", 1.0, "S"), ("ZONE", "=", 0.5, "R"), ("ZONE", "=", 1.0, "I"), ("ZONE", "=", 4.0, "S"), ("ZONE", ">=", 4.0, "S"), ("ZONE", "<", 1.0, "R"), ("ZONE", "<=", 1.0, None), ("MIC", "x", 1.0, None)])
def test_classify(spark, kind, sign, v, want):
    d = spark.createDataFrame([(kind, sign, v)], "k string, s string, v double")
    assert d.select(iv.classify(F.col("k"), iv.concentration(F.col("s"), F.col("v")), F.lit(1.0), F.lit(4.0)).alias("c")).first().c == want


def test_parse_measurement(spark):
    texts = ["<=0.5", "> 8", "4", "=2", "0,5", "", None, "<", "1/2"]
    got = [r.m and (r.m.sign, r.m.value) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iv.parse_measurement(F.col("t")).alias("m")).collect()]
    assert got == [("<=", 0.5), (">", 8.0), ("=", 4.0), ("=", 2.0), None, None, None, None, None]


def test_calendar_against_python(spark):
    days = [dt.date(1900, 3, 1), dt.date(1970, 1, 1), dt.date(2000, 2, 29), dt.date(2024, 12, 31), dt.date(1969, 12, 31)]
    d = spark.createDataFrame([(x.year, x.month, x.day) for x in days], "y int, m int, d int").select(days_from_civil(F.col("y"), F.col("m"), F.col("d")).alias("n"))
    assert [r.n for r in d.collect()] == [(x - dt.date(1970, 1, 1)).days for x in days]
    assert [r.t for r in d.select(date_text(F.col("n")).alias("t")).collect()] == [x.isoformat() for x in days]
    s = spark.createDataFrame([(0,), (-1,), (1700000000,)], "s long").select(instant_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in s] == ["1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "2023-11-14T22:13:20Z"]


CASES = [
    ("2014-09-22", "2014-09-22"), (" 2018 ", "2018"), ("2018-11", "2018-11"), ("08/2012", "2012-08"), ("Dec 2022", "2022-12"), ("22 août 2018", "2018-08-22"),
    ("25 de octubre de 2011", "2011-10-25"), ("18. Dezember 2012", "2012-12-18"), ("14MAR2018", "2018-03-14"), ("Jul. 13, 2018", "2018-07-13"), ("42387", "2016-01-18"),
    ("03/04/2016", "2016-03-04"), ("03/04/16", "2016-03-04"), ("13/04/2016", None), ("2016-02-30", None), ("2016/2018", None), ("before 2020", None), ("2021-06-1x", None), ("0000-00-00", None),
    ("", None), (None, None), ("n/a", None), ("2024-03-10T02:30:00", "2024-03-10T07:30:00Z"), ("2024-11-03 01:30:00", "2024-11-03T05:30:00Z"), ("2024-07-01T12:00:00+05:30", "2024-07-01T06:30:00Z"),
    ("2024-07-01 12:00", "2024-07-01T16:00:00Z"), ("Jul 17, 2019 12:39 AM", "2019-07-17T04:39:00Z"), ("20190603T200328Z", "2019-06-03T20:03:28Z"), ("1703574029", "2023-12-26T07:00:29Z"),
    ("1660240628914", "2022-08-11T17:57:08Z"), ("1517942974991833", "2018-02-06T18:49:34Z"), ("41298.50", "2013-01-24T17:00:00Z"), ("2013-01-09 21:35:06 CET", "2013-01-09T20:35:06Z"), ("2017-10-21T20:17:04.025253147+02:00", "2017-10-21T18:17:04Z"),
    ("2020-01-01T25:00:00Z", None), ("x" * 5000, None),
]


def test_timestamps(spark):
    rows = [(i, t, "America/New_York", "mdy", "spare") for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, t string, z string, o string, normalised string")
    got = {r.id: r.normalised for r in normalise_timestamps(df, "t", "z", "o").collect()}
    assert {CASES[i][0]: got[i] for i in got} == dict(CASES)


def test_timestamps_without_site(spark):
    df = spark.createDataFrame([(t, None, None) for t in ("2014-09-22", "03/04/2016", "2020-01-01 10:00", "2020-01-01T10:00:00Z", "41298.50")], "t string, z string, o string")
    assert [r.normalised for r in normalise_timestamps(df, "t", "z", "o").collect()] == ["2014-09-22", None, None, "2020-01-01T10:00:00Z", None]
    assert normalise_timestamps(df.limit(0), "t", "z", "o").count() == 0
    clash = df.selectExpr("t", "t as __ts", "z as __ts_zone", "o as __ts_parts", "o as `a b`")
    got = normalise_timestamps(clash, "__ts", "__ts_zone", "__ts_parts")
    assert got.columns == ["t", "__ts", "__ts_zone", "__ts_parts", "a b", "normalised"] and got.where("normalised is not null").count() == 2


def test_wall_times_against_zoneinfo(spark):
    zones = ["Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "America/Los_Angeles"]
    rows = []
    for z in zones:
        for h in range(0, 24 * 420, 7):
            w = dt.datetime(2019, 1, 1) + dt.timedelta(hours=h, minutes=h % 60)
            u = w.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0).astimezone(dt.UTC)
            rows.append((w.strftime("%Y-%m-%d %H:%M:%S"), z, u.strftime("%Y-%m-%dT%H:%M:%SZ")))
    df = spark.createDataFrame(rows, "t string, z string, want string")
    assert normalise_timestamps(df, "t", "z").where("normalised is null or normalised <> want").count() == 0


def test_any_year_and_unknown_zones(spark):
    """Years before and after the exploded ones against the tz database, and more unknown zone names than it has zones."""
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Africa/Casablanca"]
    walls = [dt.datetime(y, m, 15, 2, 30) for y in (2, 1750, 1799, 1850, 1899, 1950, 2099, 2100, 2128, 2129, 2200, 2304, 2400, 9998) for m in (1, 3, 6, 10)]
    utc = lambda w, z: w - w.replace(tzinfo=zoneinfo.ZoneInfo(z)).utcoffset()
    text = lambda w, sep, end: f"{w.year:04d}-{w.month:02d}-{w.day:02d}{sep}{w.hour:02d}:{w.minute:02d}:{w.second:02d}{end}"
    rows = [(text(w, " ", ""), z, text(utc(w, z), "T", "Z")) for w in walls for z in zones] + [("2020-01-01 10:00", f"Nowhere/{i:05d}", None) for i in range(1500)]
    got = normalise_timestamps(spark.createDataFrame(rows, "t string, z string, want string"), "t", "z")
    assert got.where("not (normalised <=> want)").count() == 0


def test_text(spark):
    labels = ["ST1", "st 1", "ST-001", "St_01 ", "ST10", "n/a", "", None, "-", "0"]
    assert [r.k for r in spark.createDataFrame([(x,) for x in labels], "x string").select(label_key(F.col("x")).alias("k")).collect()] == ["st1", "st1", "st1", "st1", "st10", None, None, None, None, "0"]
    d = spark.createDataFrame([(" a ",), ("NaN",), (None,), ("Not Collected",)], "x string")
    assert [r.c for r in d.select(clean(F.col("x")).alias("c")).collect()] == ["a", None, None, "Not Collected"]
    assert [r.p for r in d.select(is_placeholder(F.col("x")).alias("p")).collect()] == [False, True, True, True]
    with pytest.raises(ValueError, match="duplicate"):
        canonical_headers(spark.createDataFrame([(1, 2)], ["A b", "a_B"]))
    v, clash = alias_coalesce(spark.createDataFrame([("x", "X "), (None, "y"), ("x", "z"), (" ", None)], "a string, b string"), ["a", "b", "c"])
    got = spark.createDataFrame([("x", "X "), (None, "y"), ("x", "z"), (" ", None)], "a string, b string").select(v.alias("v"), clash.alias("c")).collect()
    assert [tuple(r) for r in got] == [("x", False), ("y", False), ("x", True), (None, False)]


def test_gene_family(spark):
    want = {"blaCTX-M-15": "blaCTX-M", "blaTEM-1B": "blaTEM", "gyrA_S83L": None, "qnrB4": "qnrB", "aac(3)-IVa": "aac(3)-IV", "sul1": "sul", None: None}
    want |= {"aac(6')-Ib7": "aac(6')-I", "aac(3)-IId": "aac(3)-II", "ant(2'')-Ia": "ant(2'')-I", "tet(A)": "tet(A)", "armA": "armA", "rmtB1": "rmtB", "blaEC": "blaEC", "blaCTX-M": "blaCTX-M", "dfr-12": "dfr-", "7": "7", "": ""}
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", gene_family(F.col("s")).alias("f")).collect()
    assert {r.s: r.f for r in rows} == want


def test_sequences(spark):
    d = spark.createDataFrame([("ACGTN", 1, 3, "-", 95.0, 0.95), ("ACGTN", 2, 3, "+", 70.0, 0.95), ("ACGTN", 2, 3, "+", 90.0, 1.0)], "s string, a int, b int, strand string, i double, c double")
    x = locus(F.col("s"), F.col("a"), F.col("b"), F.col("strand"), F.length("s"), F.col("i"), F.col("c"), flank=1)
    assert [tuple(r.x) for r in d.select(x.alias("x")).collect()] == [("truncated", "ACGT"), ("below_threshold", None), ("found", "ACGT")]
    r = d.select(reverse_complement(F.col("s")).alias("r"), base_counts(F.col("s")).alias("c")).first()
    assert r.r == "NACGT" and tuple(r.c) == (5, 2, 1, True)


def test_normal(spark):
    assert np.isclose(interval_probability(np.array([-1.0]), np.array([1.0]))[0], 0.6826894921370859)
    assert interval_probability(np.array([40.0]), np.array([41.0]))[0] == 1e-300
    d = spark.createDataFrame([(0.0, 1.0, 0.0, 0.0), (0.0, None, 0.0, 0.0)], "m double, s double, lo double, hi double")
    got = [r.x for r in d.select(interval_log_likelihood("m", "s", "lo", "hi").alias("x")).collect()]
    assert np.isclose(got[0], np.log(0.3413447460685429)) and got[1] is None
