"""Queries on measurements and predictions: bounds, agreement, constants, confusion, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions.interval import INF, classify, concentration, interval_error, reference_class
from assayflow.operators.aggregates import agreement_measures, best_constant, choose_threshold, concentration_of_groups, confusion, intersect_intervals, intraclass, leave_fold_out_mean, ranking_quality, score
from assayflow.operators.joins import nearest_with, rule_match, side_by_side
from assayflow.operators.models import nested_predictions
from assayflow.operators.resample import group_bootstrap, leave_source_out, leave_source_out_intervals, paired_differences
from assayflow.plans.common import Registry, sql_hash, table
from assayflow.plans.views import MEAS_SQL, MEASURES_SQL, PRED_SQL, measurements, predictions, references

registry = Registry()
finite = lambda c: F.when(F.abs(F.col(c)) != INF, F.col(c)).alias(c)
DRAWS = 2000  # the operators' default


@registry.query("interval_bounds", f"with {MEAS_SQL} select id, sign, val, d::int d, case when lo > '-infinity'::double then lo end lo, case when hi < 'infinity'::double then hi end hi, case when lo = '-infinity'::double then 'left_censored' when hi = 'infinity'::double then 'right_censored' else 'exact' end class from ref")
def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).select("id", "sign", "val", "d", finite("lo"), finite("hi"), reference_class(F.col("lo"), F.col("hi")).alias("class"))


CONST_SQL = f"""{MEAS_SQL},
span as (select drug, unnest(range(floor(least(min(lo) filter (lo > '-infinity'::double), min(hi) filter (hi < 'infinity'::double)))::bigint - 1, floor(greatest(max(lo) filter (lo > '-infinity'::double), max(hi) filter (hi < 'infinity'::double)))::bigint + 2)) c from ref group by drug),
folds as (select distinct drug, fold from ref),
tried as (select f.drug, f.fold, s.c, round(avg((greatest(s.c - r.hi, r.lo - s.c, 0) <= 1)::int), 9) ea, coalesce(round(avg(case when r.lo = r.hi then (greatest(s.c - r.hi, r.lo - s.c, 0) <= 1)::int end), 9), -1) ee from folds f join span s using (drug) join ref r on r.drug = f.drug and r.fold <> f.fold group by 1, 2, 3),
const as (select drug, fold, c constant from (select *, row_number() over (partition by drug, fold order by ea desc, ee desc, c) k from tried) where k = 1)"""


@registry.query("constant_by_fold", f"with {CONST_SQL} select drug, fold, constant from const")
def constant_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_constant(references(spark, sf_dir), ["drug"], "fold", "lo", "hi")


@registry.query("baseline_agreement", f"with {CONST_SQL}, scored as (select r.*, constant p, greatest(constant - hi, lo - constant, 0) error, lo = hi is_exact from ref r join const using (drug, fold)) select drug, {MEASURES_SQL} from scored group by drug")
def baseline_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by drug of the constant that agrees best with the other folds: the flagship."""
    r = references(spark, sf_dir)
    j = r.join(best_constant(r, ["drug"], "fold", "lo", "hi"), ["drug", "fold"]).withColumn("predicted", F.col("constant").cast("double"))
    return score(j, "predicted", "lo", "hi").groupBy("drug").agg(*agreement_measures())


@registry.query("agreement_by_model", f"with {PRED_SQL} select model, drug, {MEASURES_SQL} from scored group by model, drug")
def agreement_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(predictions(spark, sf_dir), "predicted", "lo", "hi").groupBy("model", "drug").agg(*agreement_measures())


@registry.query("agreement_by_class", f"with {PRED_SQL}, s as (select *, case when lo = '-infinity'::double then 'left_censored' when hi = 'infinity'::double then 'right_censored' else 'exact' end class, case when lineage = 'st1' then 'dominant' else 'other' end stratum from scored) select model, class, stratum, {MEASURES_SQL} from s group by grouping sets ((model, class), (model, stratum), (model))")
def agreement_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By reference class, by lineage stratum and in all, in one pass."""
    s = score(predictions(spark, sf_dir), "predicted", "lo", "hi").withColumns({"class": reference_class(F.col("lo"), F.col("hi")), "stratum": F.when(F.col("lineage") == "st1", "dominant").otherwise("other")})
    return s.groupingSets([["model", "class"], ["model", "stratum"], ["model"]], "model", "class", "stratum").agg(*agreement_measures())


@registry.query("interval_log_likelihood")
def log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayflow.functions.normal import interval_log_likelihood as ll

    p = predictions(spark, sf_dir).withColumn("ll", ll(F.col("predicted"), F.lit(1.0), F.col("lo"), F.col("hi")))
    return p.groupBy("model", "drug").agg(F.round(F.avg("ll"), 6).alias("mean_log_likelihood"))


REPEATS_SQL = """clean as (select isolate_id, lower(trim(antibiotic)) drug, case trim(measurement_sign) when '==' then '=' else trim(measurement_sign) end sign, ast_value val, ast_unit unit, source_row_number r, source_ast_record_id rec from normalized_ast
  where isolate_id is not null and antibiotic is not null and trim(measurement_sign) in ('=', '==', '<', '<=', '>', '>=') and ast_value > 0 and not isnan(ast_value)),
g as (select isolate_id, drug, count(*) n_rows, min(unit) u1, max(unit) u2, min(r) carrier, arg_min(sign, (r, rec, sign, val)) s0, arg_min(val, (r, rec, sign, val)) v0,
  max(case when sign in ('=', '>=', '>') then val end) lo, min(case when sign in ('=', '<=', '<') then val end) hi,
  from clean group by 1, 2),
e as (select g.*, coalesce((select bool_or(c.sign = '>') from clean c where c.isolate_id = g.isolate_id and c.drug = g.drug and c.val = g.lo and c.sign in ('=', '>=', '>')), false) lo_open,
  coalesce((select bool_or(c.sign = '<') from clean c where c.isolate_id = g.isolate_id and c.drug = g.drug and c.val = g.hi and c.sign in ('=', '<=', '<')), false) hi_open from g),
o as (select *, case when n_rows = 1 then 'single' when u1 <> u2 then 'repeat_unit_conflict' when lo is not null and hi is not null and (lo > hi or (lo = hi and (lo_open or hi_open))) then 'discordant_repeat_measurements' when lo is not null and hi is not null and lo <> hi then 'repeat_not_representable' else 'interval_intersection' end outcome from e)"""


@registry.query("repeat_measurements", f"with {REPEATS_SQL} select isolate_id, drug, outcome, case outcome when 'single' then s0 when 'interval_intersection' then case when lo is not null and hi is not null then '=' when lo is not null then case when lo_open then '>' else '>=' end else case when hi_open then '<' else '<=' end end end sign, case outcome when 'single' then v0 when 'interval_intersection' then coalesce(lo, hi) end val, n_rows, carrier from o")
def repeat_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intersection of each isolate's measurements of a drug, with what came of it."""
    sign = F.trim("measurement_sign")
    sign = F.when(sign == "==", "=").otherwise(sign)
    rows = table(spark, sf_dir, "normalized_ast").select("isolate_id", F.lower(F.trim("antibiotic")).alias("drug"), sign.alias("sign"), F.col("ast_value").alias("val"), "ast_unit", "source_row_number", F.col("source_ast_record_id").alias("rec"))
    rows = rows.where(F.col("isolate_id").isNotNull() & F.col("drug").isNotNull() & F.col("sign").isin("=", "<", "<=", ">", ">=") & (F.col("val") > 0) & ~F.isnan("val")).withColumn("row", F.struct("source_row_number", "rec", "sign", "val"))
    return intersect_intervals(rows, ["isolate_id", "drug"], "sign", "val", "ast_unit", "row").select("isolate_id", "drug", "outcome", "sign", F.col("value").alias("val"), "n_rows", F.col("carrier.source_row_number").alias("carrier"))


RULES = [("r1", "ciprofloxacin", 0.25, 0.5, None), ("r2", "gentamicin", 2.0, 2.0, None), ("r3", "ceftriaxone", 1.0, 2.0, "broth microdilution"), ("r4", "ceftriaxone", 1.0, 2.0, "agar dilution"), ("r5", "meropenem", 2.0, 8.0, None), ("r6", "meropenem", 2.0, 8.0, "gradient strip")]
RULES_SQL = "rules as (select * from (values " + ", ".join(f"('{i}', '{d}', {lo}, {hi}, {'null' if m is None else repr(m)})" for i, d, lo, hi, m in RULES) + ") t(rule_id, drug, low, high, method))"
RULED_SQL = f"""{RULES_SQL},
t as (select distinct id, lower(trim(antibiotic)) drug, case when hash_blank then null else laboratory_typing_method end method, trim(measurement_sign) sign, try_cast(mic_mg_l as double) val from (select *, {sql_hash("'x:' || id")} % 9 = 0 hash_blank from ast where id is not null)),
j as (select t.id, r.rule_id, r.rule_id is not null and (r.method is null or (t.method is not null and r.method = t.method)) fits, r.method is not null and t.method is null lacks from t left join rules r using (drug)),
m as (select id, count(rule_id) n, count(*) filter (fits) k, bool_or(lacks) lacks, string_agg(case when fits then rule_id end, ';' order by rule_id) hits from j group by id)"""


def ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from assayflow.operators.resample import hash_number

    rules = spark.createDataFrame(RULES, "rule_id string, drug string, low double, high double, method string")
    rows = table(spark, sf_dir, "ast").where("id is not null").select("id", F.lower(F.trim("antibiotic")).alias("drug"), F.when(hash_number(F.lit("x"), F.col("id"), modulo=9) != 0, F.col("laboratory_typing_method")).alias("method"), F.trim("measurement_sign").alias("sign"), F.col("mic_mg_l").try_cast("double").alias("val")).distinct()
    return rows, rules


@registry.query("rule_outcomes", f"with {RULED_SQL} select id, case when k = 1 then 'matched' when k > 1 then 'ambiguous_rules' when n = 0 then 'no_rule' when lacks then 'missing_constraint' else 'no_matching_rule' end outcome, case when k > 0 then hits when n > 0 and lacks then 'method' end rule from m")
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with optional constraints, matched to tests whose method is missing for every ninth."""
    rows, rules = ruled(spark, sf_dir)
    return rule_match(rows, "id", rules, "rule_id", ["drug"], ["method"])


@registry.query("region_of_interval", f"with {RULED_SQL}, c as (select t.id, case when sign in ('=', '>=', '>') then val end lo, sign in ('=', '>=') lo_inc, case when sign in ('=', '<=', '<') then val end hi, r.low, r.high, m.hits from m join t using (id) join rules r on r.rule_id = m.hits where m.k = 1 and sign in ('=', '<', '<=', '>', '>=') and val > 0) select id, hits as rule, case when hi <= low then 'S' when lo > high or (lo = high and not lo_inc) then 'R' when (lo > low or (lo = low and not lo_inc)) and hi <= high then 'I' end category from c")
def region_of_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one region between the thresholds of the matched rule that holds a whole censored measurement, null where it crosses one."""
    rows, rules = ruled(spark, sf_dir)
    m = rule_match(rows, "id", rules, "rule_id", ["drug"], ["method"]).where("outcome = 'matched'")
    j = m.join(rows, "id").join(rules.select(F.col("rule_id").alias("rule"), "low", "high"), "rule").withColumn("i", concentration(F.col("sign"), F.col("val"))).where("i is not null")
    return j.select("id", "rule", classify(F.lit("MIC"), F.col("i"), F.col("low"), F.col("high")).alias("category"))


TRUTH_SQL = f"{PRED_SQL}, binary_ as (select model, drug, lineage, fold, split, id, case when lo >= 1 then 1 else 0 end y, round(1 / (1 + exp(-predicted)), 6) s from pred)"


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("model", "drug", "lineage", "fold", "split", "id", F.when(F.col("lo") >= 1, 1).otherwise(0).alias("y"), F.round(1 / (1 + F.exp(-F.col("predicted"))), 6).alias("s"))


@registry.query("confusion_by_model", f"with {TRUTH_SQL}, c as (select model, count(*) filter (y = 1 and s >= 0.5)::double tp, count(*) filter (y = 0 and s >= 0.5)::double fp, count(*) filter (y = 1 and s < 0.5)::double fn, count(*) filter (y = 0 and s < 0.5)::double tn, round(avg((s - y) ** 2), 6) brier from binary_ group by model) select model, tp::bigint tp, fp::bigint fp, fn::bigint fn, tn::bigint tn, brier, round(tp / (tp + fn), 6) sensitivity, round(tn / (tn + fp), 6) specificity, round(tp / (tp + fp), 6) ppv, round(tn / (tn + fn), 6) npv, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) mcc from c")
def confusion_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(binary(spark, sf_dir), ["model"], "y", "s", F.lit(0.5))


CURVE_SQL = "curve as (select model, s, sum(y) pos, count(*) - sum(y) neg from binary_ group by 1, 2), cum as (select *, sum(pos) over d pos_ge, sum(neg) over d neg_ge, sum(pos) over w p_all, sum(neg) over w n_all from curve window w as (partition by model), d as (partition by model order by s desc))"


@registry.query("ranking_quality", f"with {TRUTH_SQL}, {CURVE_SQL} select model, round(sum(pos * (n_all - neg_ge + neg / 2)) / max(p_all * n_all), 6) auroc, round(sum(pos * pos_ge / (pos_ge + neg_ge)) / max(p_all), 6) average_precision from cum group by model")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking_quality(binary(spark, sf_dir), ["model"], "y", "s")


@registry.query("chosen_threshold", f"with {TRUTH_SQL}, {CURVE_SQL}, t as (select model, s::double score, pos_ge, neg_ge, p_all, n_all from cum union all select distinct model, 0.0, p_all, n_all, p_all, n_all from cum union all select distinct model, 1.0, coalesce(max(case when s >= 1 then pos_ge end) over (partition by model), 0), coalesce(max(case when s >= 1 then neg_ge end) over (partition by model), 0), p_all, n_all from cum), q as (select model, score, round(pos_ge / p_all, 9) sens, round(1 - neg_ge / n_all, 9) spec from t), k as (select *, row_number() over (partition by model order by (sens >= 0.9) desc, case when sens >= 0.9 then spec else sens end desc, case when sens >= 0.9 then sens else spec end desc, score desc) r from q) select model, score threshold, round(sens, 6) sensitivity, round(spec, 6) specificity, sens >= 0.9 feasible from k where r = 1")
def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_threshold(binary(spark, sf_dir), ["model"], "y", "s", 0.9)


@registry.query("leave_fold_out_prevalence", f"with {TRUTH_SQL}, g as (select drug, fold, sum(y)::double s, count(*) n from binary_ where model = 1 group by 1, 2) select a.drug, a.fold, round((sum(b.s) - a.s) / (sum(b.n) - a.n), 6) score from g a join g b using (drug) group by a.drug, a.fold, a.s, a.n")
def leave_fold_out_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leave_fold_out_mean(binary(spark, sf_dir).where("model = 1"), ["drug"], "fold", "y")


BOOT_SQL = """sums as (select *, row_number() over (partition by {k} order by lineage) - 1 j, count(*) over (partition by {k}) g from (select {k}, lineage, {sums} from {src} where lineage is not null group by {k}, lineage)),
slots as (select {k}, g, draw, unnest(range(g)) slot from (select distinct {k}, g, unnest(range({draws})) draw from sums)),
picks as (select {k}, draw, ('0x' || substr(sha256('20260815:' || draw || ':' || slot), 1, 8))::ubigint::bigint % g j from slots)"""


@registry.query("bootstrap_agreement", f"with {PRED_SQL}, one as (select * from scored where model = 1), {BOOT_SQL.format(k='drug', src='one', draws=DRAWS, sums='sum((error <= 1)::int)::double x0, count(*)::double d0, sum(case when is_exact then (error <= 1)::int end)::double x1, sum(case when is_exact then 1 end)::double d1')}, drawn as (select drug, draw, sum(x0) / nullif(sum(d0), 0) a, sum(x1) / nullif(sum(d1), 0) b from picks join sums using (drug, j) group by 1, 2), long as (select drug, draw, 'agreement' statistic, a v from drawn union all select drug, draw, 'agreement_exact', b from drawn), whole as (select drug, max(g) n_groups, sum(x0) / sum(d0) a, sum(x1) / nullif(sum(d1), 0) b from sums group by drug) select l.drug, statistic, round(max(case statistic when 'agreement' then w.a else w.b end), 6) estimate, case when count(v) >= {DRAWS / 2} then round(quantile_cont(v, 0.025), 6) end lo, case when count(v) >= {DRAWS / 2} then round(quantile_cont(v, 0.975), 6) end hi, max(n_groups) n_groups from long l join whole w using (drug) group by 1, 2")
def bootstrap_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(predictions(spark, sf_dir).where("model = 1"), "predicted", "lo", "hi")
    agrees, exact = F.col("agrees").cast("int"), F.col("is_exact")
    return group_bootstrap(s, ["drug"], "lineage", {"agreement": agrees, "agreement_exact": F.when(exact, agrees)}, {"agreement": F.lit(1), "agreement_exact": F.when(exact, 1)})


PAIR_SQL = f"{PRED_SQL}, both_ as (select a.id, a.drug, a.lineage, a.source, (a.error <= 1)::int - (b.error <= 1)::int d from scored a join scored b using (id) where a.model = 1 and b.model = 2)"


@registry.query("paired_difference", f"with {PAIR_SQL}, {BOOT_SQL.format(k='drug', src='both_', draws=DRAWS, sums='sum(d)::double x0, count(d)::double d0')}, drawn as (select drug, draw, sum(x0) / nullif(sum(d0), 0) v from picks join sums using (drug, j) group by 1, 2), whole as (select drug, max(g) n_groups, sum(x0) / sum(d0) e from sums group by drug) select drug, 'difference' statistic, round(max(e), 6) estimate, round(quantile_cont(v, 0.025), 6) lo, round(quantile_cont(v, 0.975), 6) hi, max(n_groups) n_groups from drawn join whole using (drug) group by drug")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(predictions(spark, sf_dir), "predicted", "lo", "hi").withColumn("hit", F.col("agrees").cast("int")).select("id", "drug", "lineage", "source", "model", "hit")
    return paired_differences(s.where("model = 1"), s.where("model = 2"), ["id"], ["drug"], "lineage", "hit")


@registry.query("leave_source_out", f"with {PAIR_SQL}, g as (select drug, source, sum(d) s, count(*) n from both_ group by 1, 2), t as (select drug, sum(s) ts, sum(n) tn from g group by 1) select drug, source, round(n / tn, 6) share, round((ts - s) / (tn - n), 6) difference from g join t using (drug) where source is not null and n / tn >= 0.10")
def without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(predictions(spark, sf_dir), "predicted", "lo", "hi").withColumn("hit", F.col("agrees").cast("int")).select("id", "drug", "source", "model", "hit")
    return leave_source_out(s.where("model = 1"), s.where("model = 2"), ["id"], ["drug"], "source", "hit", 0.10)


LEFT_SQL = f"{PAIR_SQL}, n as (select drug, source, count(*) n from both_ group by 1, 2), major as (select n.drug, n.source left_out from n join (select drug, sum(n) tn from n group by 1) t using (drug) where n.source is not null and n.n >= 0.1 * tn), rest as (select b.drug, m.left_out, b.lineage, b.d from both_ b join major m on m.drug = b.drug and b.source is distinct from m.left_out)"


@registry.query("leave_source_out_intervals", f"with {LEFT_SQL}, {BOOT_SQL.format(k='drug, left_out', src='rest', draws=DRAWS, sums='sum(d)::double x0, count(d)::double d0')}, drawn as (select drug, left_out, draw, sum(x0) / nullif(sum(d0), 0) v from picks join sums using (drug, left_out, j) group by 1, 2, 3), whole as (select drug, left_out, max(g) n_groups, sum(x0) / sum(d0) e from sums group by 1, 2) select drug, left_out, 'difference' statistic, round(max(e), 6) estimate, round(quantile_cont(v, 0.025), 6) lo, round(quantile_cont(v, 0.975), 6) hi, max(n_groups) n_groups from drawn join whole using (drug, left_out) group by 1, 2")
def without_source_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(predictions(spark, sf_dir), "predicted", "lo", "hi").withColumn("hit", F.col("agrees").cast("int")).select("id", "drug", "lineage", "source", "model", "hit")
    return leave_source_out_intervals(s.where("model = 1"), s.where("model = 2"), ["id"], ["drug"], "source", "lineage", "hit")


@registry.query("intraclass_correlation", f"with {PRED_SQL}, x as (select drug, lineage, (error <= 1)::int::double x from scored where model = 1), g as (select drug, lineage, count(*)::double n, avg(x) m, var_pop(x) v from x group by 1, 2), t as (select drug, count(*)::double k, sum(n) nn, sum(n * n) n2, sum(n * v) ssw, sum(n * m) sx, sum(n * m * m) sxx from g group by drug), u as (select *, (sxx - sx * sx / nn) / nullif(k - 1, 0) msb, ssw / nullif(nn - k, 0) msw, (nn - n2 / nn) / nullif(k - 1, 0) m0, n2 / nn ms, sx / nn p from t), v as (select *, greatest(0, (msb - msw) / (msb + (m0 - 1) * msw)) icc from u) select drug, round(icc, 6) icc, round(ms, 6) group_size, round(1 + (ms - 1) * icc, 6) design_effect, round(p, 6) proportion, round(1.96 * sqrt(greatest(0, p * (1 - p)) * (1 + (ms - 1) * icc) / nn), 6) half_width from v")
def intraclass_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(predictions(spark, sf_dir).where("model = 1"), "predicted", "lo", "hi").withColumn("hit", F.col("agrees").cast("double"))
    return intraclass(s, ["drug"], "lineage", "hit")


@registry.query("group_concentration", f"with {MEAS_SQL}, per as (select distinct network, cluster, isolate_id from meas), s as (select network, cluster, count(*) n from per where cluster is not null group by 1, 2), c as (select *, sum(n) over (partition by network order by n desc, cluster rows between unbounded preceding and current row) cum, sum(n) over (partition by network) nn from s), g as (select network, count(*) n_groups, max(nn) nn, max(n) mx, sum(n * n) n2, count(*) filter (2 * (cum - n) < nn) groups_for_half, count(*) filter (n = 1) n_singletons from c group by 1), r as (select network, count(distinct isolate_id) n_records from per group by 1) select network, n_records, coalesce(n_groups, 0) n_groups, round(coalesce(nn, 0) / n_records, 6) coverage, round(mx / nn, 6) largest_share, round(nn * nn / n2, 6) inverse_simpson, groups_for_half::bigint groups_for_half, n_singletons from r left join g using (network)")
def group_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentration_of_groups(measurements(spark, sf_dir), ["network"], "cluster", "isolate_id").withColumn("n_singletons", F.col("n_singletons").cast("long"))


@registry.query("censoring_profile", f"with {MEAS_SQL} select drug, coalesce(split, 'none') split, count(*) n, case when split = 'external' then null else count(*) filter (lo <> hi) end n_censored, case when split = 'external' then 'sealed' else round(avg((lo <> hi)::int), 4)::decimal(10, 4)::varchar end fraction from ref group by drug, split")
def censoring_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and share of censored measurements; of external rows only their number leaves the query."""
    open_ = F.col("split").isNull() | (F.col("split") != "external")
    g = references(spark, sf_dir).groupBy("drug", "split").agg(F.count("*").alias("n"), F.count_if(F.col("lo") != F.col("hi")).alias("k"))
    return g.select("drug", F.coalesce("split", F.lit("none")).alias("split"), "n", F.when(open_, F.col("k")).alias("n_censored"), F.when(open_, F.round(F.col("k") / F.col("n"), 4).cast("decimal(10,4)").cast("string")).otherwise("sealed").alias("fraction"))


@registry.query("models_side_by_side", f"with {PRED_SQL}, a as (select id, predicted from pred where model = 1), b as (select id, predicted from pred where model = 2) select case when a.id is not null and b.id is not null then 'both' when a.id is not null then 'left_only' else 'right_only' end side, count(*) n from a full join b using (id) group by 1")
def models_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return side_by_side(p.where("model = 1").select("id", "predicted"), p.where("model = 2").select("id", "predicted"), ["id"]).groupBy("side").agg(F.count("*").alias("n"))


NEAR_SQL = f"""{MEAS_SQL},
side as (select regexp_replace(regexp_replace(lower(development_sequence_id), '\\s+', '', 'g'), '^.*::', '') a, regexp_replace(regexp_replace(lower(external_sequence_id), '\\s+', '', 'g'), '^.*::', '') b, ani_percent ani, least(aligned_fraction_development, aligned_fraction_external) af from collision_pairs),
p0 as (select a q, b r, ani sim, af tie from side union all select b, a, ani, af from side),
p1 as (select *, row_number() over (partition by q order by sim desc, tie desc, r) k from p0 where q is not null and r is not null and q <> r),
fact as (select distinct lower(isolate_id) q, drug, fold from ref),
hit as (select p.q, f.drug, p.r, p.sim, row_number() over (partition by p.q, f.drug order by p.sim desc, p.tie desc, p.r) k from p1 p join fact f on f.q = p.q join fact h on h.q = p.r and h.drug = f.drug where p.k <= 200 and f.fold <> h.fold)"""


@registry.query("nearest_relative", f"with {NEAR_SQL} select q isolate_id, drug, r relative, sim similarity from hit where k = 1")
def nearest_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each isolate and drug the most similar relative of another fold that was tested for the drug."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), "^.*::", "")
    p = table(spark, sf_dir, "collision_pairs").select(bare("development_sequence_id").alias("a"), bare("external_sequence_id").alias("b"), F.col("ani_percent").alias("ani"), F.least("aligned_fraction_development", "aligned_fraction_external").alias("af"))
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "ani", "af")).where("a is not null and b is not null").withColumnsRenamed({"a": "isolate_id", "b": "relative"})
    facts = references(spark, sf_dir).select(F.lower("isolate_id").alias("fact_id"), "drug", "fold")
    return nearest_with(both, "isolate_id", "relative", F.col("ani"), F.col("af"), facts, "fact_id", ["drug"], "fold")


@registry.query("nested_ridge")
def nested_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of every drug from features of the test, penalty chosen on inner folds, and their agreement."""
    r = references(spark, sf_dir)
    feats = F.array(F.concat(F.lit("source:"), F.coalesce("source", F.lit("none"))), F.concat(F.lit("network:"), F.col("network")), F.concat(F.lit("lineage:"), "lineage"))
    p = nested_predictions(r.withColumn("features", feats), "drug", "id", "lineage", "fold", "lo", "hi", "features", "ridge")
    s = score(p.join(r.select("id", "lo", "hi"), "id"), "predicted", "lo", "hi")
    return s.groupBy("drug", "fold").agg(F.count("*").alias("n"), F.round(F.avg(F.col("agrees").cast("double")), 6).alias("agreement"), F.max("choice").alias("choice"))
