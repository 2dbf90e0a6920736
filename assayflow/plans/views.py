"""Views that the queries share, in Spark and in SQL: measurements with their isolate's groups, and predictions made from hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions.interval import comparator, dilution, dilution_bounds
from assayflow.operators.resample import hash_number
from assayflow.plans.common import sql_hash, sql_label, table
from assayflow.text import label_key

META_SQL = f"""meta as (select isolate_id, max({sql_label('lineage_group')}) lineage, max({sql_label('genomic_cluster')}) cluster,
  max(case when regexp_replace(lower(evaluation_split), '\\s+', '', 'g') in ('development', 'external') then regexp_replace(lower(evaluation_split), '\\s+', '', 'g') end) split,
  max(surveillance_network) network from isolate_metadata where isolate_id is not null group by 1)"""
MEAS_SQL = f"""{META_SQL},
test as (select distinct id, isolate isolate_id, lower(trim(antibiotic)) drug, trim(measurement_sign) sign, try_cast(mic_mg_l as double) val, site source from ast where id is not null),
meas as (select t.*, coalesce(m.lineage, t.isolate_id) lineage, m.cluster, m.split, coalesce(m.network, 'none') network, {sql_hash("'7:' || coalesce(m.lineage, t.isolate_id)")} % 5 fold from test t left join meta m using (isolate_id)),
bound as (select *, case when abs(log2(val) - round(log2(val))) <= 0.1 then round(log2(val)) end d from meas where val > 0 and sign in ('=', '<', '<=', '>', '>=')),
ref as (select *, case when sign in ('=', '>=') then d when sign = '>' then d + 1 else '-infinity'::double end lo, case when sign in ('=', '<=') then d when sign = '<' then d - 1 else 'infinity'::double end hi from bound where d is not null)"""
PRED_SQL = f"""{MEAS_SQL},
pred as (select *, 1 model, d + ({sql_hash("'m1:' || id")} % 7 - 3) * 0.6 predicted from ref union all select *, 2 model, d + ({sql_hash("'m2:' || id")} % 5 - 2) * 0.7 predicted from ref),
scored as (select *, floor(predicted + 0.5) p, greatest(floor(predicted + 0.5) - hi, lo - floor(predicted + 0.5), 0) error, lo = hi is_exact from pred)"""
MEASURES_SQL = """count(*) n, count(*) filter (is_exact) n_exact, count(*) filter (not is_exact) n_censored, round(avg((error <= 1)::int), 6) agreement,
  round(avg(case when is_exact then (error <= 1)::int end), 6) agreement_exact, round(avg(case when is_exact then (error = 0)::int end), 6) exact_match,
  round(avg((p - hi >= 2)::int), 6) over_call, round(avg((lo - p >= 2)::int), 6) under_call, round(avg(case when is_exact then p - lo end), 6) bias"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each isolate: keys of its groups, its split and network."""
    split = F.lower(F.regexp_replace("evaluation_split", r"\s+", ""))
    rows = table(spark, sf_dir, "isolate_metadata").where("isolate_id is not null")
    return rows.groupBy("isolate_id").agg(F.max(label_key(F.col("lineage_group"))).alias("lineage"), F.max(label_key(F.col("genomic_cluster"))).alias("cluster"), F.max(F.when(split.isin("development", "external"), split)).alias("split"), F.max("surveillance_network").alias("network"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = table(spark, sf_dir, "ast").where("id is not null").select("id", F.col("isolate").alias("isolate_id"), F.lower(F.trim("antibiotic")).alias("drug"), F.trim("measurement_sign").alias("sign"), F.col("mic_mg_l").try_cast("double").alias("val"), F.col("site").alias("source")).distinct()
    j = test.join(metadata(spark, sf_dir), "isolate_id", "left").withColumns({"lineage": F.coalesce("lineage", "isolate_id"), "network": F.coalesce("network", F.lit("none"))})
    return j.withColumn("fold", hash_number(F.lit("7"), F.col("lineage"), modulo=5))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements on the dilution scale with their bounds; values off the scale and rows without a comparator are left out."""
    m = measurements(spark, sf_dir).withColumn("sign", comparator(F.col("sign"))).withColumn("d", dilution(F.col("val")))
    m = m.withColumn("b", dilution_bounds(F.col("sign"), F.col("d"))).where("b is not null")
    return m.withColumns({"lo": F.col("b.lo"), "hi": F.col("b.hi")}).drop("b")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions, made from hashes of the tests' ids."""
    r = references(spark, sf_dir)
    one = r.withColumns({"model": F.lit(1), "predicted": F.col("d") + (hash_number(F.lit("m1"), F.col("id"), modulo=7) - 3) * 0.6})
    two = r.withColumns({"model": F.lit(2), "predicted": F.col("d") + (hash_number(F.lit("m2"), F.col("id"), modulo=5) - 2) * 0.7})
    return one.unionByName(two)
