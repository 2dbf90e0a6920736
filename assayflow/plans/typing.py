"""Queries on measurement typing, typing results and the checks of steering tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators import rule_tables, typing_results
from assayflow.operators.measurement import concordance, measurement_type, only_measurement, record_id, same_when_present
from assayflow.plans.common import Registry, table
from assayflow.plans.views import PRED_SQL, predictions

registry = Registry()
_clean = lambda c: f"case when lower(trim({c})) not in ('', 'nan', 'none', 'null', '<na>') then trim({c}) end"
BOTH_SQL = "raws as (select *, case when ast_unit = 'mg/L' or source_row_number % 11 = 0 then raw_ast_value end mic, case when ast_unit <> 'mg/L' or source_row_number % 7 = 0 then raw_ast_value end zone from normalized_ast)"


def both_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalized_ast with a raw column for each type of measurement, some rows with both and some with none."""
    k = F.col("source_row_number")
    mic = F.when((F.col("ast_unit") == "mg/L") | (k % 11 == 0), F.col("raw_ast_value"))
    zone = F.when((F.col("ast_unit") != "mg/L") | (k % 7 == 0), F.col("raw_ast_value"))
    return table(spark, sf_dir, "normalized_ast").withColumns({"mic": mic, "zone": zone})


@registry.query("measurement_types", f"with {BOTH_SQL}, n as (select try_cast({_clean('mic')} as double) m, try_cast({_clean('zone')} as double) z, mic, zone from raws) select case when m is not null and z is null then 'MIC' when z is not null and m is null then 'ZONE' end as type, case when m is not null and z is null then 'mg/L' when z is not null and m is null then 'mm' end unit, case when nullif(trim(mic), '') is not null and nullif(trim(zone), '') is null then 'MIC' when nullif(trim(zone), '') is not null and nullif(trim(mic), '') is null then 'ZONE' end filled, count(*) n, count(coalesce(m, z)) n_values from n group by all")
def measurement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by type, by numbers and by filled texts."""
    d = both_columns(spark, sf_dir).select(measurement_type(F.col("mic"), F.col("zone")).alias("t"), only_measurement(F.col("mic"), F.col("zone")).alias("o"))
    return d.groupBy("t.type", "t.unit", F.col("o.type").alias("filled")).agg(F.count("*").alias("n"), F.count("t.value").alias("n_values"))


@registry.query("record_ids", f"with i as (select {_clean('source_ast_record_id')} own, sha256('[[\"antibiotic\",' || coalesce('\"' || antibiotic || '\"', 'null') || '],[\"isolate_id\",' || coalesce('\"' || isolate_id || '\"', 'null') || '],[\"raw_ast_value\",' || coalesce('\"' || raw_ast_value || '\"', 'null') || ']]') h from normalized_ast) select coalesce(own, 'sha256-' || h) id, case when own is not null then 'native' else 'digest' end origin, count(*) n from i group by 1, 2")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "normalized_ast")
    return n.select(record_id(n, "source_ast_record_id", ["isolate_id", "antibiotic", "raw_ast_value"]).alias("r")).groupBy("r.id", "r.origin").agg(F.count("*").alias("n"))


@registry.query("category_concordance", f"with c as (select raw_submitted_ast_category s, submitted_ast_category i, raw_measurement_sign p, measurement_sign q from normalized_ast) select case when {_clean('s')} is null then 'NOT_REPORTED' when coalesce(upper({_clean('s')}) = i, false) then 'CONCORDANT' else 'DISCORDANT' end concordance, case when {_clean('p')} is null then 'not_asserted' when lower(regexp_replace(trim(p), '\\s+', ' ', 'g')) = coalesce(lower(regexp_replace(trim(q), '\\s+', ' ', 'g')), '') then 'true' else 'false' end same_sign, count(*) n from c group by all")
def category_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted categories against the normalised ones, and raw signs against the stored ones."""
    c = F.col
    d = table(spark, sf_dir, "normalized_ast").select(concordance(c("raw_submitted_ast_category"), c("submitted_ast_category")).alias("concordance"), same_when_present(c("raw_measurement_sign"), c("measurement_sign")).alias("same_sign"))
    return d.groupBy("concordance", "same_sign").agg(F.count("*").alias("n"))


@registry.query("category_support", "with g as (select lower(trim(antibiotic)) drug, site, max((submitted_ast_category = 'S')::int) s, max((submitted_ast_category = 'R')::int) r from (select n.antibiotic, n.submitted_ast_category, n.source_release site from normalized_ast n) where antibiotic is not null group by 1, 2) select drug, site as release, concat_ws(';', case when coalesce(r, 0) = 0 then 'R' end, case when coalesce(s, 0) = 0 then 'S' end) missing from g where coalesce(r, 0) = 0 or coalesce(s, 0) = 0")
def category_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs and releases that lack susceptible or resistant rows."""
    n = table(spark, sf_dir, "normalized_ast").where("antibiotic is not null").select(F.lower(F.trim("antibiotic")).alias("drug"), F.col("source_release").alias("release"), "submitted_ast_category")
    return rule_tables.lacks_values(n, ["drug", "release"], "submitted_ast_category", ["S", "R"])


@registry.query("rederived_signs", f"with d as (select source_row_number k, measurement_sign stored, case trim(raw_measurement_sign) when '==' then '=' else trim(raw_measurement_sign) end derived from normalized_ast) select 'measurement_sign' field, stored, derived, count(*) n from d where stored is distinct from derived group by all")
def rederived_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored signs that don't follow from the raw ones."""
    raw = F.trim("raw_measurement_sign")
    d = rule_tables.rederived(table(spark, sf_dir, "normalized_ast"), "source_row_number", {"measurement_sign": F.when(raw == "==", "=").otherwise(raw)})
    return d.groupBy("field", "stored", "derived").agg(F.count("*").alias("n"))


BAD_RULES = [("r1", "a", "MIC", "0.25", "0.5"), ("r1", "b", "mic ", "1", "1"), ("r2", "c", "ZONE", "15", "20"), ("r3", "d", "ZONE", "20", "15"), ("r4", None, "MIC", "2", "1"), (None, "e", "disk", "x", None), ("r5", " ", "MIC", "1", "2")]
BAD_RULES_SQL = "rules as (select * from (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in BAD_RULES) + ") t(rule_id, drug, kind, low, high))"


@registry.query("rule_table_violations", f"with {BAD_RULES_SQL}, t as (select *, upper(trim(kind)) k, try_cast(trim(low) as decimal(38, 12)) lo, try_cast(trim(high) as decimal(38, 12)) hi from rules) select distinct rule_id, violation from (select rule_id, unnest([case when {_clean('rule_id')} is null then 'missing_id' end, case when {_clean('drug')} is null then 'missing_drug' end, case when coalesce(k, '') not in ('MIC', 'ZONE') then 'unknown_type' end, case when lo is null or hi is null then 'bad_threshold' end, case when (k = 'MIC' and hi < lo) or (k = 'ZONE' and lo < hi) then 'crossed_thresholds' end]) violation from t union all select trim(rule_id), 'duplicate_id' from rules where {_clean('rule_id')} is not null group by 1 having count(*) > 1) where violation is not null")
def rule_table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules with every fault."""
    rules = spark.createDataFrame(BAD_RULES, "rule_id string, drug string, kind string, low string, high string")
    return rule_tables.rule_violations(rules, "rule_id", ["drug"], "kind", "low", "high")


METHODS = ["EXACTX", "ALLELEP", "PARTIALX", "blastx", "INTERNAL_STOP", "PARTIAL_CONTIG_ENDX"]
CALLS_SQL = f"""hit as (select l_suppkey record, 'g' || (p_partkey % 40) symbol, case when p_size % 4 = 0 then 'STRESS' else 'AMR' end kind, {METHODS!r}[p_partkey % 6 + 1] as method, p_type subtype, l_orderkey, l_linenumber, l_partkey from lineitem join part on l_partkey = p_partkey),
why as (select *, case when kind <> 'AMR' then 'excluded_type' when not regexp_matches(upper(method), '^(EXACT|ALLELE|BLAST|POINT|HMM|PARTIAL_CONTIG_END)') then 'excluded_method' end w from hit),
calls as (select *, coalesce(w, case when row_number() over (partition by record, symbol, w is null order by l_orderkey, l_linenumber, l_partkey, kind, method, subtype) = 1 then 'call' else 'duplicate_call' end) outcome from why)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == k)
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (k % 6 + 1).cast("int"))
    hits = j.select(F.col("l_suppkey").alias("record"), F.concat(F.lit("g"), (k % 40).cast("string")).alias("symbol"), F.when(F.col("p_size") % 4 == 0, "STRESS").otherwise("AMR").alias("kind"), method.alias("method"), F.col("p_type").alias("subtype"), "l_orderkey", "l_linenumber", "l_partkey")
    return typing_results.element_calls(hits, "record", "symbol", "kind", "method", [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "kind", "method", "subtype")])


@registry.query("element_report", f"with {CALLS_SQL}, per as (select record, max((outcome = 'call')::int) has from calls group by 1) select 'records' measure, count(*) n from per union all select 'records_without_call', count(*) filter (has = 0) from per union all select 'calls', count(*) filter (outcome = 'call') from calls union all select 'elements', count(distinct symbol) from calls where outcome = 'call' union all select 'subtype:' || trim(subtype), count(*) from calls where outcome = 'call' group by 1 union all select outcome, count(*) from calls where outcome <> 'call' group by 1")
def element_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typing_results.element_summary(calls(spark, sf_dir), "record", "symbol", "subtype")


@registry.query("typed_lineages", "with t as (select ' 00' || (p_size % 6) st, ['perfect', 'OKAY ', 'NOVEL'][p_partkey % 3 + 1] status from part) select case when trim(st)::int > 0 and upper(trim(status)) in ('PERFECT', 'OKAY') then 'ST' || trim(st)::int end lineage, count(*) n from t group by 1")
def typed_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("perfect"), F.lit("OKAY "), F.lit("NOVEL")), (F.col("p_partkey") % 3 + 1).cast("int"))
    st = F.concat(F.lit(" 00"), (F.col("p_size") % 6).cast("string"))
    return table(spark, sf_dir, "part").groupBy(typing_results.sequence_type_lineage(st, status).alias("lineage")).agg(F.count("*").alias("n"))


ST_SQL = "st as (select p_partkey record, p_partkey % 97 + 1 k, p_size % 5 = 0 and (p_partkey % 97 + 1) % 4 <> 0 d from part), one as (select k, [k % 3, (k // 3) % 3, (k // 9) % 3, (k // 27) % 3] p, count(*) filter (d) w from st group by 1), near as (select a.k a, b.k b from one a join one b on a.k <> b.k and (a.p[1] <> b.p[1])::int + (a.p[2] <> b.p[2])::int + (a.p[3] <> b.p[3])::int + (a.p[4] <> b.p[4])::int = 1)"


@registry.query("lineage_groups", f"with recursive {ST_SQL}, edge as (select n.a, n.b from near n join one x on x.k = n.a and x.w > 0 join one y on y.k = n.b and y.w > 0), reach as (select k a, k b from one where w > 0 union select r.a, e.b from reach r join edge e on r.b = e.a), grp as (select r.a k, arg_min(o.k, (-o.w, o.k)) name from reach r join one o on o.k = r.b group by 1), got as (select n.a k, min(g.name) lo, max(g.name) hi from near n join grp g on g.k = n.b group by 1) select s.record, 'SLV:ST' || coalesce(g.name, case when o.lo = o.hi then o.lo end, s.k) lineage_group, case when g.name is not null then 'within' when o.lo = o.hi then 'neighbour_of_one' else 'outside' end basis from st s left join grp g using (k) left join got o using (k)")
def groups_of_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence types in groups of single-locus variants, those of rows that don't define groups by their neighbours."""
    k = F.col("p_partkey") % 97 + 1
    digits = F.array(*[(F.floor(k / n) % 3).cast("string") for n in (1, 3, 9, 27)])
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), F.concat(F.lit("ST"), k.cast("string")).alias("st"), digits.alias("p"), ((F.col("p_size") % 5 == 0) & (k % 4 != 0)).alias("d"))
    return typing_results.lineage_groups(d, "record", "st", "p", F.col("d"))


OVER_SQL = "hits as (select p_partkey seq, 85.0 + p_size % 16 ident, 75.0 + p_partkey % 26 cov from part where p_partkey % 3 <> 0), best as (select seq, case when ident >= 99 and cov >= 95 then 'near_identical' when ident >= 90 and cov >= 80 then 'close' else 'not_found' end c from hits), uses as (select l_partkey seq, p_brand gene from lineitem join part on l_partkey = p_partkey), j as (select uses.*, coalesce(c, 'not_found') overlap from uses left join best using (seq)), common as (select gene from j group by 1 order by count(*) desc, gene limit 15)"


@registry.query("overlap_report", f"with {OVER_SQL} select 'sequences' as scope, null gene, overlap, count(distinct seq) n from j group by overlap union all select 'uses', null, overlap, count(*) from j group by overlap union all select 'gene', gene, overlap, count(*) from j where gene in (select gene from common) group by gene, overlap")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the sequences in use are to a reference: different ones, uses, and the fifteen genes of most uses."""
    part = table(spark, sf_dir, "part")
    hits = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("q"), (85.0 + F.col("p_size") % 16).alias("ident"), (75.0 + F.col("p_partkey") % 26).alias("cov"))
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seq")).join(part.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("gene")), "seq")
    return typing_results.overlap_summary(uses, "seq", "gene", typing_results.best_overlap(hits, "q", "ident", "cov"))


@registry.query("carriers_apart", "with c as (select p_partkey k from part where p_brand = (select min(p_brand) from part)) select case when c.k is null then 'train' else 'test' end side, count(*) n from lineitem left join c on c.k = l_partkey group by 1")
def carriers_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the records with one feature, and all others."""
    features = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("feature"))
    target = features.agg(F.min("feature")).first()[0]
    train, test = typing_results.carriers(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record")), "record", features, "feature", target)
    n = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n").where("n > 0")
    return n(train, "train").unionByName(n(test, "test"))


@registry.query("detection_by_model", f"with {PRED_SQL} select model, drug, count(*) n, count(*) filter (hi = 'infinity'::double) n_right_censored, round(avg(case when hi = 'infinity'::double then (p > 1)::int end), 6) detected_share, round(avg((error <= 1)::int), 6) agreement from scored group by model, drug")
def detection_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typing_results.detection(predictions(spark, sf_dir), ["model", "drug"], "predicted", "lo", "hi")
