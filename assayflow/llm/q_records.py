"""Problem 2: one record for each test sent more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.components import connected_components
from assayflow.llm.consensus import closest_to_consensus
from assayflow.plans.common import Registry, table
from assayflow.text import PLACEHOLDERS, is_placeholder
from assayflow.workspace import materialise

registry = Registry()
# Sources in the order of trust within a release.
TRUST = {"ncbi pathogen detection ast": "3", "biosample antibiogram": "2", "legacy mirror": "1"}
SIGNS = {"=": "=", "==": "=", "<": "<", "<=": "<=", "=<": "<=", "≤": "<=", ">": ">", ">=": ">=", "=>": ">=", "≥": ">="}


BARE = tuple({p.replace(" ", "") for p in PLACEHOLDERS})


def _reports(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of normalized_ast as (also, rid, chk, tier, sign, nano); a mere projection, so every use reads the table again."""
    bare = lambda c: F.translate(F.lower(c), " \t\r\n\u00a0", "")
    rid = bare("source_ast_record_id")
    rid = F.when(rid.startswith("ncbi-ast"), F.ltrim(F.substring(rid, 9, 1 << 20), F.lit("-:_"))).otherwise(rid)
    chk = bare("source_record_checksum")
    sign = F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), bare("measurement_sign"))
    usable = (F.col("ast_value") > 0) & (F.col("ast_value") < float("inf")) & ~F.isnan("ast_value")
    nano = F.when(usable, F.least(F.round(F.col("ast_value") * 1e9), F.lit(float(1 << 62))).cast("long"))  # greater ones don't fit and become 2^62
    trust = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.lower(F.trim("source_dataset"))), F.lit("0"))
    tier = F.concat_ws("|", F.coalesce(F.trim("source_release"), F.lit("")), trust)
    rows = table(spark, sf_dir, "normalized_ast").select(*[F.col(c) for c in also], F.when(~rid.isin(*BARE), rid).alias("rid"), F.when(~chk.isin(*BARE) & (F.ltrim(chk, F.lit("0")) != ""), chk).alias("chk"), tier.alias("tier"), sign.alias("sign"), nano.alias("nano"))
    return rows.where("rid is not null or chk is not null")


def tests(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(test, tier, sign, nano, also): the rows with the test they belong to. Ids that share a checksum, directly or through others, are
    one test. Only checksums of several ids, or of rows without an id, are followed further: each other id is its own test.
    """
    rows = _reports(spark, sf_dir, also)
    by_sum = rows.where("chk is not null").groupBy("chk").agg(F.min("rid").alias("first"), F.max("rid").alias("last"), F.max(F.col("rid").isNull()).alias("nameless"))
    by_sum, _ = materialise(by_sum.where("nameless or first <> last"), "checksums")
    ties = rows.where("rid is not null and chk is not null").select("rid", "chk").join(by_sum.where("first <> last").select("chk", "first"), "chk").where("rid <> first").select("rid", "first").distinct()
    of = connected_components(ties, "rid", "first")
    named = rows.where("rid is not null").select(F.col("rid").alias("key"), "tier", "sign", "nano", *also)
    nameless = rows.where("rid is null").join(by_sum.where("nameless").select("chk", "first"), "chk").select(F.coalesce("first", F.concat(F.lit("checksum "), "chk")).alias("key"), "tier", "sign", "nano", *also)
    return named.unionByName(nameless).join(of.withColumnRenamed("id", "key"), "key", "left").select(F.coalesce("component", "key").alias("test"), "tier", "sign", "nano", *also)


_blank = ", ".join(f"'{p}'" for p in PLACEHOLDERS)


@registry.query("p2_found", f"""
with recursive t as (
  select case when lower(trim(source_ast_record_id)) not in ({_blank}) then regexp_replace(regexp_replace(lower(source_ast_record_id), '\\s+', '', 'g'), '^ncbi-ast[-:_]?', '') end rid,
    case when lower(trim(source_record_checksum)) not in ({_blank}) and not regexp_matches(source_record_checksum, '^ *0+ *$') then lower(trim(source_record_checksum)) end chk,
    trim(source_release) || '|' || case lower(trim(source_dataset)) when 'ncbi pathogen detection ast' then '3' when 'biosample antibiogram' then '2' when 'legacy mirror' then '1' else '0' end tier,
    case regexp_replace(measurement_sign, '\\s+', '', 'g') when '=' then '=' when '==' then '=' when '<' then '<' when '<=' then '<=' when '≤' then '<=' when '>' then '>' when '>=' then '>=' when '≥' then '>=' end sign,
    case when ast_value > 0 and not isnan(ast_value) and ast_value < 'infinity'::double then least(round(ast_value * 1e9), 4611686018427387904.0)::bigint end nano
  from normalized_ast),
edge as (select distinct x.rid a, y.rid b from t x join t y on x.chk = y.chk where x.rid is not null and y.rid is not null),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a where e.a <> e.b),
root as (select a rid, min(b) root from (select * from reach union all select rid, rid from t where rid is not null) group by a),
by_sum as (select chk, min(root) root from t join root using (rid) where chk is not null group by chk),
member as (select t.*, coalesce(root.root, by_sum.root, 'checksum ' || t.chk) test from t left join root on t.rid = root.rid left join by_sum on t.rid is null and t.chk = by_sum.chk where t.rid is not null or t.chk is not null),
signs as (select test, sign, row_number() over (partition by test order by tier desc, k desc, sign) r from (select test, sign, tier, count(*) k from member where sign is not null group by 1, 2, 3)),
vals as (select test, nano, row_number() over (partition by test order by tier desc, k desc, nano::varchar) r from (select test, nano, tier, count(*) k from member where nano is not null group by 1, 2, 3)),
n as (select test from member group by 1 having count(*) > 1)
select n.test record_id, coalesce(s.sign, '') measurement_sign, coalesce(v.nano, -1) value_nano
from n left join signs s on s.test = n.test and s.r = 1 left join vals v on v.test = n.test and v.r = 1""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of several rows with the best sign and value. A test without any id goes by its checksum.

    Where all usable signs (values) of a test agree there is nothing to align; the others go through the consensus.
    """
    rows, _ = materialise(tests(spark, sf_dir), "tests")
    all_of = rows.groupBy("test").agg(F.count("*").alias("n"), F.min("sign").alias("s1"), F.max("sign").alias("s2"), F.min("nano").alias("v1"), F.max("nano").alias("v2")).where("n > 1")
    all_of, _ = materialise(all_of, "agreed")
    disputed = all_of.where("s1 <> s2 or v1 <> v2").select("test", (F.col("s1") != F.col("s2")).alias("s"), (F.col("v1") != F.col("v2")).alias("v"))
    reports = F.array(F.struct(F.when(F.col("s"), F.col("sign")).alias("v"), F.lit("s").alias("of")), F.struct(F.when(F.col("v"), F.col("nano").cast("string")).alias("v"), F.lit("v").alias("of")))
    votes = rows.join(disputed, "test").select("test", "tier", F.explode(reports).alias("r")).where("r.v is not null").select(F.concat("r.of", "test").alias("g"), "r.v", "tier", F.lit(1).alias("n"))
    chosen = closest_to_consensus(votes, "g", "v", "tier", "n")
    pick = chosen.groupBy(F.substring("g", 2, 1 << 30).alias("test")).agg(F.max(F.when(F.col("g").startswith("s"), F.col("v"))).alias("s"), F.max(F.when(F.col("g").startswith("v"), F.col("v"))).alias("v"))
    return all_of.join(pick, "test", "left").select(F.col("test").alias("record_id"), F.coalesce("s", "s1", F.lit("")).alias("measurement_sign"), F.coalesce(F.col("v").try_cast("long"), "v1", F.lit(-1)).alias("value_nano"))


@registry.query("p2_consensus")
def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, value, n_values): fields for which no release goes before another, of the tests that report several values; all rows
    vote, and the alignment decides."""
    fields = ("raw_antibiotic", "ast_platform")
    rows = tests(spark, sf_dir, fields)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("r")
    votes = rows.select("test", each).select("test", "r.field", "r.v").where(~is_placeholder(F.col("v")))
    votes, _ = materialise(votes.groupBy("test", "field", "v").agg(F.count("*").alias("n")), "reported")
    several = votes.groupBy("test", "field").agg(F.count("*").alias("n_values")).where("n_values > 1")
    named = votes.join(several, ["test", "field"]).select(F.concat_ws("|", "field", "test").alias("g"), "v", F.lit("").alias("t"), "n")
    chosen = closest_to_consensus(named, "g", "v", "t", "n")
    split = chosen.select(F.expr("substring(g, instr(g, '|') + 1)").alias("test"), F.substring_index("g", "|", 1).alias("field"), F.col("v").alias("value"))
    return split.join(several, ["test", "field"]).select(F.col("test").alias("record_id"), "field", "value", "n_values")


@registry.query("p2_disputes")
def p2_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By latest release: tests of several rows, and those whose usable signs or values differ."""
    all_of = tests(spark, sf_dir).groupBy("test").agg(F.count("*").alias("n"), F.max("tier").alias("tier"), F.min("sign").alias("s1"), F.max("sign").alias("s2"), F.min("nano").alias("v1"), F.max("nano").alias("v2")).where("n > 1")
    return all_of.groupBy(F.substring_index("tier", "|", 1).alias("source_release")).agg(F.count("*").alias("n_tests"), F.count(F.when(F.col("s1") != F.col("s2"), 1)).alias("n_sign_disputes"), F.count(F.when(F.col("v1") != F.col("v2"), 1)).alias("n_value_disputes"))
