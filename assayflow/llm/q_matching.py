"""Problem 7: antibiogram rows and the tests they report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.matching import one_to_one, propagate
from assayflow.llm.reference import Tree, fold, map_to_reference
from assayflow.operators.timestamps import known_zones, normalise_timestamps
from assayflow.plans.common import Registry, table
from assayflow.text import is_placeholder
from assayflow.workspace import discard, materialise

registry = Registry()
# Three-letter codes of antibiotics, synonyms of methods, units in mg/L.
CODES = {
    "amk": "amikacin", "amp": "ampicillin", "ctx": "cefotaxime", "cro": "ceftriaxone", "cip": "ciprofloxacin", "cst": "colistin", "etp": "ertapenem",
    "fos": "fosfomycin", "gen": "gentamicin", "lvx": "levofloxacin", "mem": "meropenem", "nit": "nitrofurantoin", "tzp": "piperacillin-tazobactam",
    "tet": "tetracycline", "tob": "tobramycin", "sxt": "trimethoprim-sulfamethoxazole",
}
METHODS = {"bmd": "broth microdilution", "agar dil.": "agar dilution", "agar dil": "agar dilution", "gradient test": "gradient strip", "etest": "gradient strip"}
SIGNS = {"=": "=", "==": "=", "<": "<", "<=": "<=", "≤": "<=", ">": ">", ">=": ">=", "≥": ">="}
# Log odds of agreement and disagreement of each field; a missing value on either side says nothing.
PRIOR = -8.0
WEIGHTS = {"number": 9.0, "tail": 6.5, "near": 4.0, "other": -4.0, "date": 6.0, "day": 1.5, "no_date": -5.0, "method": (1.0, -4.0), "platform": (1.3, -3.0), "value": 2.3, "step": -1.5, "no_value": -4.0, "sign": (0.6, -1.5), "sir": (0.6, -1.0)}
BEYOND = 8.0  # entities this far (log odds) below a group's best are given up before the messages


def read_drug(tree: Tree, text: str) -> tuple[int, int, str] | None:
    key = fold(text)
    for part in (key, key.rpartition(" ")[0], key.rpartition(" ")[2]):
        if part in tree.exact:
            return 0, 0, tree.exact[part][0]
        if part in CODES:
            return 0, 0, CODES[part]
    found = tree.within(key, 3)
    if found and (len(found) == 1 or found[0][0] < found[1][0]):
        return 1, *found[0]
    return None


def lookup(c: Column, values: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), c)


def filled(c: str) -> Column:
    return F.when(~is_placeholder(F.col(c)), F.lower(F.trim(c)))


def bin_of(v: Column) -> Column:
    return F.when(v > 0, F.round(F.log2(v)).cast("int"))


def submitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(rows, table that they read): antibiogram rows in comparable form; the accession is the one of the submitted record."""
    raw = table(spark, sf_dir, "ncbi_biosample_antibiograms").where("antibiogram_row_id is not null").dropDuplicates(["antibiogram_row_id"])
    raw = normalise_timestamps(raw.select("antibiogram_row_id", "biosample_accession", "antibiotic_raw", "resistance_phenotype_raw", "measurement_sign_raw", "measurement_raw", "measurement_unit_raw", "laboratory_typing_method_raw", "laboratory_typing_platform_raw", "ast_testing_date_raw", "biosample_record_xml_sha256"), "ast_testing_date_raw", into="on")
    tests = table(spark, sf_dir, "ast").select(F.lower(F.trim("antibiotic")).alias("drug")).where("drug is not null").distinct()
    drugs = map_to_reference(raw, "antibiotic_raw", tests, "drug", "drug", read_drug)
    text = F.lower(F.regexp_replace(F.translate("measurement_raw", ",", "."), r"[\s ]+", ""))
    number = F.regexp_extract(text, r"(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    unit = F.coalesce(F.nullif(F.regexp_extract(text, "([munµμ]g/m?l)$", 1), F.lit("")), F.lower("measurement_unit_raw"))
    value = F.when(unit.rlike("^[uµμ]g/l$"), number / 1000).otherwise(number)
    sign = lookup(F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, "^([<>=≤≥]+)", 1), F.lit("")), F.regexp_replace("measurement_sign_raw", r"\s+", "")), F.lit("")), SIGNS)
    acc = F.upper(F.regexp_replace("biosample_accession", r"[\s ]+", ""))
    acc = F.when(~is_placeholder(F.col("biosample_accession")), F.regexp_replace(F.regexp_replace(acc, r"^BIOSAMPLE:", ""), r"\.\d+$", ""))
    digits = F.regexp_extract(acc, r"(\d+(?:X\d+)?)$", 1)
    rows, path = materialise(raw.join(drugs, "antibiotic_raw", "left").select(
        F.col("antibiogram_row_id").alias("a"), F.col("biosample_record_xml_sha256").alias("grp"), "drug", value.alias("v"), sign.alias("sign"), F.substring(filled("resistance_phenotype_raw"), 1, 1).alias("sir"),
        lookup(filled("laboratory_typing_method_raw"), METHODS).alias("method"), filled("laboratory_typing_platform_raw").alias("platform"), F.to_date("on").alias("day"), F.when(digits != "", digits).alias("own"),
    ), "rows")
    # a record has one accession, and mostly one date: rows that lack them take the record's
    record = rows.where("grp is not null").groupBy("grp").agg(F.max(F.struct(F.length("own").alias("n"), "own"))["own"].alias("number"), F.min("day").alias("d1"), F.max("day").alias("d2"))
    return rows.join(record.hint("merge"), "grp", "left").withColumn("number", F.coalesce("number", "own")).withColumn("day", F.coalesce("day", F.when(F.col("d1") == F.col("d2"), F.col("d1")))).drop("own", "d1", "d2"), path


def tested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(rows, table that they read): rows of ast in comparable form, with the local date at their site; the sample's accession is that of its isolate."""
    sites = table(spark, sf_dir, "submitting_sites").dropDuplicates(["site"])
    raw = table(spark, sf_dir, "ast").where("id is not null").dropDuplicates(["id"]).select("id", "isolate", "biosample", "antibiotic", "resistance_phenotype", "mic_mg_l", "measurement_sign", "laboratory_typing_method", "laboratory_typing_platform", "testing_date", "site")
    raw = normalise_timestamps(raw.join(sites.select("site", "time_zone", "date_order"), "site", "left"), "testing_date", "time_zone", "date_order", "on", known_zones(sites, "time_zone"))
    instant = F.try_to_timestamp("on")
    wall = F.date_from_unix_date(F.floor(F.unix_seconds(F.when(F.col("time_zone").isNotNull(), F.from_utc_timestamp(instant, F.col("time_zone"))).otherwise(instant)) / 86400).cast("int"))
    day = F.when(F.length("on") == 10, F.to_date(F.when(F.length("on") == 10, F.col("on")))).when(F.length("on") > 10, wall)
    rows, path = materialise(raw.select(
        F.col("id").alias("b"), F.coalesce("isolate", "biosample", "id").alias("z"), F.lower(F.trim("antibiotic")).alias("drug"), F.col("mic_mg_l").try_cast("double").alias("v"), lookup(F.regexp_replace("measurement_sign", r"\s+", ""), SIGNS).alias("sign"), F.substring(filled("resistance_phenotype"), 1, 1).alias("sir"),
        lookup(filled("laboratory_typing_method"), METHODS).alias("method"), filled("laboratory_typing_platform").alias("platform"), day.alias("day"), F.regexp_extract("biosample", r"(\d+)(?:\.\d+)?$", 1).alias("own"),
    ), "rows")
    sample = rows.where("own <> ''").groupBy("z").agg(F.min("own").alias("number"))
    return rows.drop("own").join(sample.hint("merge"), "z", "left"), path


def agree(c: str) -> Column:
    yes, no = WEIGHTS[c]
    return F.when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), 0.0).when(F.col(f"a_{c}") == F.col(f"b_{c}"), yes).otherwise(no)


def log_odds() -> Column:
    w = WEIGHTS
    an, bn = F.col("a_number"), F.col("b_number")
    near = (F.length(an) == F.length(bn)) & ((F.levenshtein(an, bn) <= 1) | (F.array_join(F.array_sort(F.split(an, "")), "") == F.array_join(F.array_sort(F.split(bn, "")), "")) & (F.levenshtein(an, bn) <= 2))
    number = F.when(an.isNull() | bn.isNull(), 0.0).when(an == bn, w["number"]).when((F.length(an) < 9) & bn.endswith(an), w["tail"]).when(near | ((F.abs(F.length(an) - F.length(bn)) == 1) & (F.levenshtein(an, bn) == 1)), w["near"]).otherwise(w["other"])
    gap = F.abs(F.datediff("a_day", "b_day"))
    date = F.when(gap.isNull(), 0.0).when(gap == 0, w["date"]).when(gap == 1, w["day"]).otherwise(w["no_date"])
    step = F.abs(F.log2("a_v") - F.log2("b_v"))
    value = F.when(step.isNull(), 0.0).when(step < 0.2, w["value"]).when(step < 1.2, w["step"]).otherwise(w["no_value"])
    return reduce(lambda x, y: x + y, [agree("method"), agree("platform"), agree("sign"), agree("sir")], number + date + value + F.lit(PRIOR))


def key(*parts: Column) -> Column:
    """The parts as one text; null where one is null."""
    return F.when(reduce(lambda x, y: x & y, [p.isNotNull() for p in parts]), F.concat_ws("|", *[p.cast("string") for p in parts]))


def first_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): pairs of the same drug that share the end of a number and a day or a value; or a day, a value and a method."""
    day, step = F.col("day"), bin_of(F.col("v"))
    end = F.when(F.regexp_like("number", F.lit(r"\d{5}$")), F.substring("number", -5, 5))
    keys = F.explode(F.array_compact(F.array(key(end, F.lit("d"), day), key(end, F.lit("v"), step), key(F.lit("p"), day, step, F.col("method")))))
    return a.where("drug is not null").select("a", "drug", keys.alias("k")).join(b.select("b", "drug", keys.alias("k")), ["drug", "k"]).select("a", "b").distinct()


def pairs_within(a: DataFrame, b: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): pairs of the same drug in the given groups and entities (grp, z) that share a day, a value give or take a step, or, for rows that lack one of these, a method."""
    day, step, method = F.col("day"), bin_of(F.col("v")), F.col("method")
    bare = day.isNull() | step.isNull()
    ka = a.where("drug is not null").join(groups.hint("merge"), "grp").select("a", "z", "drug", F.explode(F.array_compact(F.array(key(F.lit("d"), day), *[key(F.lit("v"), step + k) for k in (-1, 0, 1)], F.when(bare, key(F.lit("m"), method))))).alias("k"))
    kb = b.select("b", "z", "drug", F.explode(F.array_compact(F.array(key(F.lit("d"), day), key(F.lit("v"), step), key(F.lit("m"), method)))).alias("k"))
    return ka.join(kb, ["z", "drug", "k"]).select("a", "b").distinct()


def scored(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, grp, z, s)."""
    side = lambda d, s, keep: d.select(*keep, *[F.col(c).alias(f"{s}_{c}") for c in ("number", "v", "sign", "sir", "method", "platform", "day")])
    return pairs.join(side(a, "a", ["a", "grp"]).hint("merge"), "a").join(side(b, "b", ["b", "z"]).hint("merge"), "b").select("a", "b", "grp", "z", log_odds().alias("s"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, probability) of all candidate pairs after belief propagation."""
    a, apath = materialise((read := submitted(spark, sf_dir))[0], "submitted")
    discard(spark, read[1])
    b, bpath = materialise((read := tested(spark, sf_dir))[0], "tested")
    discard(spark, read[1])
    first, fpath = materialise(scored(first_pairs(a, b), a, b).where("s > -9"), "candidates")
    # of a record only samples whose pairs together come near the best of its samples stay; there, weaker pairs join in
    best = first.groupBy("grp", "z", "a").agg(F.max("s").alias("s")).groupBy("grp", "z").agg(F.sum(F.log1p(F.exp("s"))).alias("v"))
    top = best.where("grp is not null").groupBy("grp").agg(F.max("v").alias("top"))
    kept, kpath = materialise(best.join(top.hint("merge"), "grp").where(F.col("v") >= F.col("top") - BEYOND).select("grp", "z"), "kept")
    near = first.join(kept.hint("merge"), ["grp", "z"], "left_semi").select("a", "b")
    pairs = near.unionByName(pairs_within(a, b, kept)).distinct()
    out = propagate(scored(pairs, a, b).unionByName(first.where("grp is null")).where("s > -9"))
    discard(spark, apath, bpath, fpath, kpath)
    return out


@registry.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_to_one(matches(spark, sf_dir)).select(F.col("a").alias("antibiogram_row_id"), F.col("b").alias("id"))


@registry.query("p7_confidence")
def p7_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair that is at all likely, with its marginal probability."""
    return matches(spark, sf_dir).where("probability >= 0.001").select(F.col("a").alias("antibiogram_row_id"), F.col("b").alias("id"), F.round("probability", 6).alias("confidence"))
