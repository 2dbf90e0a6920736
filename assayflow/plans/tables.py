"""Queries on the tables themselves: scans, routing, joins with checks, contracts, groups, features, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.operators.aggregates import field_coverage
from assayflow.operators.contracts import crossing_groups, dependency_violations, duplicate_keys, shared_values, validation_report
from assayflow.operators.features import cosine, feature_sets, first_calls, hierarchy, mean_vectors, supported
from assayflow.operators.folds import assign_folds
from assayflow.operators.graph import dense_labels, leakage_units, linked_groups, profile_groups, ranked, star_links
from assayflow.operators.joins import identifier_overlap, links_one_apart, lookup_join, one_apart, reconcile, top_k
from assayflow.operators.routing import all_matches, first_match
from assayflow.operators.sequences import base_counts, content_addressed, reverse_complement, windows
from assayflow.plans.common import Registry, sql_hash, sql_label, table
from assayflow.plans.views import META_SQL, metadata
from assayflow.text import clean, is_placeholder, label_key, normalised

registry = Registry()
SIGNS = ("=", "<", "<=", ">", ">=")
BLOCK = 1000  # consecutive requests under one digest


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each isolate: of repeated rows the latest, then the least text of the row."""
    i = table(spark, sf_dir, "isolates").where("target_acc is not null")
    return first_calls(i, ["target_acc"], [F.desc("target_creation_date"), F.asc_nulls_last("biosample_acc"), F.asc_nulls_last("geo_loc_name"), F.asc_nulls_last("collection_date"), F.asc_nulls_last("bioproject_acc"), F.asc_nulls_last("host"), F.asc_nulls_last("site")])


ISOLATES_SQL = "iso as (select * from (select *, row_number() over (partition by target_acc order by target_creation_date desc, biosample_acc nulls last, geo_loc_name nulls last, collection_date nulls last, bioproject_acc nulls last, host nulls last, site nulls last) k from isolates where target_acc is not null) where k = 1)"


@registry.query("species_drug_scan", "select distinct i.target_acc, i.biosample_acc, i.bioproject_acc from isolates i where i.target_acc in (select isolate from ast where lower(trim(scientific_name)) = 'escherichia coli' and lower(trim(antibiotic)) in ('ciprofloxacin', 'gentamicin', 'ceftriaxone'))")
def species_drug_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolates with a test of a species and of some drugs: filters reach the scan, the tests only reduce."""
    a = table(spark, sf_dir, "ast").where((F.lower(F.trim("scientific_name")) == "escherichia coli") & F.lower(F.trim("antibiotic")).isin("ciprofloxacin", "gentamicin", "ceftriaxone"))
    return table(spark, sf_dir, "isolates").join(a.select(F.col("isolate").alias("target_acc")), "target_acc", "left_semi").select("target_acc", "biosample_acc", "bioproject_acc").distinct()


@registry.query("enrichment_matches", f"with {ISOLATES_SQL}, t as (select distinct isolate_id target_acc from isolate_metadata where isolate_id is not null) select t.target_acc, iso.host, count(iso.target_acc) over (partition by t.target_acc) n_matches, '[\"' || coalesce(iso.bioproject_acc, '') || '\"]' projects from t left join iso using (target_acc)")
def enrichment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested isolates with what the current table knows of them and how often it does."""
    t = table(spark, sf_dir, "isolate_metadata").select(F.col("isolate_id").alias("target_acc")).where("target_acc is not null").distinct()
    j = t.join(isolates(spark, sf_dir).withColumn("hit", F.lit(1)), "target_acc", "left")
    return j.select("target_acc", "host", F.count("hit").over(Window.partitionBy("target_acc")).alias("n_matches"), F.to_json(F.array(F.coalesce("bioproject_acc", F.lit("")))).alias("projects"))


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "normalized_ast")
    # the keys of several rows are counted before the wide rows move; rows without a key get keys of their own, which match nothing
    twice = n.where("source_ast_record_id is not null").groupBy(F.col("source_ast_record_id").alias("key")).agg(F.count("*").alias("times")).where("times > 1").select("key", F.lit(True).alias("dup"))
    key = F.coalesce("source_ast_record_id", F.concat(F.lit("\0"), F.xxhash64("source_row_number", "isolate_id", "raw_ast_value").cast("string")))
    sign = F.trim("measurement_sign")
    sign = F.when(sign == "==", "=").otherwise(sign)
    number = F.col("raw_ast_value").try_cast("double")
    filled = lambda c: clean(F.col(c)).isNotNull()
    reasons = {
        "not_escherichia_coli": ~F.coalesce(F.lower("scientific_name").rlike(r"^escherichia coli(\s|$)"), F.lit(False)),
        "secondary_measurement": filled("mic_secondary") | filled("disk_diffusion_secondary"),
        "nonnumeric_measurement": filled("raw_ast_value") & number.isNull(),
        "missing_measurement": ~filled("raw_ast_value") | F.col("raw_ast_value").isNull(),
        "nonpositive_or_nonfinite": ~F.coalesce((number > 0) & (number < float("inf")) & ~F.isnan(number), F.lit(False)),
        "missing_sign": clean(sign).isNull(),
        "invalid_sign": ~sign.isin(*SIGNS),
        "missing_antibiotic": clean(F.col("antibiotic")).isNull(),
        "missing_isolate": clean(F.col("isolate_id")).isNull(),
        "missing_biosample": clean(F.col("biosample_accession")).isNull(),
        "duplicate_record_id": F.coalesce("dup", F.lit(False)),
    }
    return n.withColumn("key", key).join(twice, "key", "left").withColumn("reason", first_match(reasons))


_b = lambda c: f"({c} is null or lower(trim({c})) in ('', 'nan', 'none', 'null', '<na>'))"
STRUCT_SQL = f"""x as (select *, case when trim(measurement_sign) = '==' then '=' else trim(measurement_sign) end s, try_cast(raw_ast_value as double) num, count(*) over (partition by source_ast_record_id) > 1 dup from normalized_ast),
routed as (select *, case when not coalesce(regexp_matches(lower(scientific_name), '^escherichia coli(\\s|$)'), false) then 'not_escherichia_coli'
  when not {_b('mic_secondary')} or not {_b('disk_diffusion_secondary')} then 'secondary_measurement' when not {_b('raw_ast_value')} and num is null then 'nonnumeric_measurement' when {_b('raw_ast_value')} then 'missing_measurement'
  when not coalesce(num > 0 and num < 'infinity'::double and not isnan(num), false) then 'nonpositive_or_nonfinite' when {_b('s')} then 'missing_sign' when s not in ('=', '<', '<=', '>', '>=') then 'invalid_sign'
  when {_b('antibiotic')} then 'missing_antibiotic' when {_b('isolate_id')} then 'missing_isolate' when {_b('biosample_accession')} then 'missing_biosample' when dup and source_ast_record_id is not null then 'duplicate_record_id' end reason from x)"""


@registry.query("structural_routing", f"with {STRUCT_SQL} select coalesce(reason, 'included') reason, source_dataset, count(*) n_rows from routed group by 1, 2")
def structural_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of normalized_ast in exactly one bin: the first reason that holds, or included."""
    return structural(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("included")).alias("reason"), "source_dataset").agg(F.count("*").alias("n_rows"))


@registry.query("missing_fields", f"""with r as (select nullif(concat_ws(';', case when {_b('ast_method')} then 'ast_method' end, case when {_b('ast_platform')} then 'ast_platform' end, case when {_b('ast_vendor')} then 'ast_vendor' end, case when {_b('disk_content')} and ast_measurement_type = 'ZONE' then 'disk_content' end, case when not regexp_matches(coalesce(ast_testing_date, ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T|$)') then 'ast_testing_date' end), '') reasons from normalized_ast) select reason, count(*) n_rows from (select unnest(string_split(reasons, ';')) reason from r where reasons is not null) group by 1""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of a row at once, counted."""
    from assayflow.operators.routing import reason_histogram

    blank = lambda c: clean(F.col(c)).isNull()
    n = table(spark, sf_dir, "normalized_ast")
    reasons = {c: blank(c) for c in ("ast_method", "ast_platform", "ast_vendor")} | {"disk_content": blank("disk_content") & (F.col("ast_measurement_type") == "ZONE"), "ast_testing_date": ~F.coalesce("ast_testing_date", F.lit("")).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T|$)")}
    return reason_histogram(n.select(all_matches(reasons).alias("reasons")), "reasons")


@registry.query("record_digests", "select source_row_number, sha256('[[\"antibiotic\",' || coalesce('\"' || antibiotic || '\"', 'null') || '],[\"isolate_id\",' || coalesce('\"' || isolate_id || '\"', 'null') || '],[\"raw_ast_value\",' || coalesce('\"' || raw_ast_value || '\"', 'null') || ']]') digest from normalized_ast")
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayflow.sources.sinks import row_digest

    n = table(spark, sf_dir, "normalized_ast")
    return n.select("source_row_number", row_digest(n, ["isolate_id", "antibiotic", "raw_ast_value"]).alias("digest"))


@registry.query("country_from_place", "select i.target_acc, case when trim(coalesce(country, '')) <> '' then country else v.name end country, case when trim(coalesce(country, '')) <> '' then 'explicit' when v.name is not null then 'place_prefix' else 'absent' end country_source from (select distinct target_acc, country, geo_loc_name from isolates) i left join (select distinct name from insdc_geo_loc_name_vocabulary) v on v.name = trim(split_part(i.geo_loc_name, ':', 1))")
def country_from_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "isolates").select("target_acc", "country", "geo_loc_name").distinct()
    v = table(spark, sf_dir, "insdc_geo_loc_name_vocabulary").select("name").distinct()
    j = i.withColumn("name", F.regexp_replace(F.substring_index("geo_loc_name", ":", 1), r"^[\s\u00a0]+|[\s\u00a0]+$", "")).join(v.withColumn("known", F.lit(True)), "name", "left")
    explicit = F.trim(F.coalesce("country", F.lit(""))) != ""
    return j.select("target_acc", F.when(explicit, F.col("country")).when(F.col("known"), F.col("name")).alias("country"), F.when(explicit, "explicit").when(F.col("known"), "place_prefix").otherwise("absent").alias("country_source"))


@registry.query("lookup_with_conflicts", f"with {ISOLATES_SQL}, l as (select isolate_id, biosample_accession biosample, specimen_source source from isolate_metadata union all select isolate_id, biosample_accession, null from sequence_requests) select (iso.target_acc is not null) matched, case when lower(trim(l.biosample)) <> lower(trim(iso.biosample_acc)) then 'biosample' when lower(trim(l.source)) <> lower(trim(iso.isolation_source)) then 'source' end conflict, count(*) n_rows from l left join iso on iso.target_acc = l.isolate_id group by 1, 2")
def lookup_with_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What metadata and sequence requests say of their isolates, against the isolates: unmatched rows and values that contradict each other."""
    i = isolates(spark, sf_dir).select(F.col("target_acc").alias("isolate_id"), F.col("biosample_acc").alias("biosample"), F.col("isolation_source").alias("source"), "epi_type")
    says = lambda t, source: table(spark, sf_dir, t).select("isolate_id", F.col("biosample_accession").alias("biosample"), source.alias("source"))
    rows = says("isolate_metadata", F.col("specimen_source")).unionByName(says("sequence_requests", F.lit(None).cast("string")))
    return lookup_join(rows, i, ["isolate_id"], ["biosample", "source"]).groupBy("matched", "conflict").agg(F.count("*").alias("n_rows"))


_n = lambda c: f"coalesce(lower(regexp_replace(trim({c}), '\\s+', ' ', 'g')), '')"


# Fixed pairs: the columns of an antibiogram row and those of ast that must say the same, the key first.
SAME_FIELDS = {"biosample_accession": "biosample", "antibiotic_raw": "antibiotic", "measurement_sign_raw": "measurement_sign", "measurement_raw": "mic_mg_l", "resistance_phenotype_raw": "resistance_phenotype", "laboratory_typing_method_raw": "laboratory_typing_method"}
_keys = [f"k{i}" for i in range(len(SAME_FIELDS))]
SAME_SQL = f"a as (select distinct antibiogram_row_id, {', '.join(f'{_n(c)} k{i}' for i, c in enumerate(SAME_FIELDS))} from ncbi_biosample_antibiograms), b as (select distinct id, {', '.join(f'{_n(c)} k{i}' for i, c in enumerate(SAME_FIELDS.values()))} from ast)"


def same_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    norm = lambda d, key, names: d.select(key, *[F.coalesce(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit("")).alias(n) for c, n in names]).distinct()
    names = list(SAME_FIELDS.values())
    return norm(table(spark, sf_dir, "ncbi_biosample_antibiograms"), "antibiogram_row_id", SAME_FIELDS.items()), norm(table(spark, sf_dir, "ast"), "id", zip(names, names, strict=True))


@registry.query("exact_reconciliation", f"with {SAME_SQL}, g as (select {', '.join(_keys)}, count(*) n, min(id) p from b where k0 <> '' group by all) select antibiogram_row_id, case when n = 1 then 'unique_match' when n > 1 then 'ambiguous_match' else 'no_match' end outcome, coalesce(n, 0) n_matches, case when n = 1 then p end partner from a left join g using ({', '.join(_keys)})")
def exact_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antibiogram rows whose six fields equal those of tests of the same sample."""
    a, b = same_fields(spark, sf_dir)
    return reconcile(a, "antibiogram_row_id", b, "id", list(SAME_FIELDS.values()))


@registry.query("reconciliation_histogram", f"with {SAME_SQL}, g as (select {', '.join(_keys)}, count(*) n from a where k0 <> '' group by all), r as (select coalesce(n, 0) n_matches from b left join g using ({', '.join(_keys)})) select n_matches, count(*) n_tests from r group by 1")
def reconciliation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way round: tests by the number of antibiogram rows that match them."""
    a, b = same_fields(spark, sf_dir)
    return reconcile(b, "id", a, "antibiogram_row_id", list(SAME_FIELDS.values())).groupBy("n_matches").agg(F.count("*").alias("n_tests"))


@registry.query("identifier_overlap", "with a as (select distinct isolate_id k, unnest([{'t': 'biosample', 'v': biosample_accession}, {'t': 'assembly', 'v': assembly_accession}, {'t': 'isolate', 'v': isolate_id}, {'t': 'source', 'v': genome_source_accession}]) i from isolate_metadata), b as (select distinct sequence_id k, unnest([{'t': 'biosample', 'v': biosample_accession}, {'t': 'assembly', 'v': sequence_accession}, {'t': 'isolate', 'v': isolate_id}, {'t': 'source', 'v': sequence_accession}]) i from sequence_requests), x as (select i.t t, i.v v, string_agg(distinct k, ';' order by k) ids from a where i.v is not null and trim(i.v) <> '' group by 1, 2), y as (select i.t t, i.v v, string_agg(distinct k, ';' order by k) ids from b where i.v is not null and trim(i.v) <> '' group by 1, 2) select x.t identifier_type, x.v identifier, x.ids a_ids, y.ids b_ids from x join y using (t, v)")
def identifiers_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return identifier_overlap(table(spark, sf_dir, "isolate_metadata"), "isolate_id", table(spark, sf_dir, "sequence_requests"), "sequence_id", {"biosample": (c("biosample_accession"), c("biosample_accession")), "assembly": (c("assembly_accession"), c("sequence_accession")), "isolate": (c("isolate_id"), c("isolate_id")), "source": (c("genome_source_accession"), c("sequence_accession"))})


PROFILE_SQL = "prof as (select p_partkey k, [p_size % 3, p_partkey % 4, (p_partkey // 4) % 3, (p_partkey // 12) % 3, (p_partkey // 36) % 3, (p_partkey // 108) % 3, (p_partkey // 324) % 3] p from part)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = lambda n: F.floor(k / n)
    return table(spark, sf_dir, "part").select(k.alias("k"), F.array(*[x.cast("long") for x in (F.col("p_size") % 3, k % 4, d(4) % 3, d(12) % 3, d(36) % 3, d(108) % 3, d(324) % 3)]).alias("p"))


@registry.query("profiles_one_apart", f"with {PROFILE_SQL} " + 'select a.k a, b.k b from prof a join prof b on a.k < b.k where ' + ' + '.join(f'(a.p[{i}] <> b.p[{i}])::int' for i in range(1, 8)) + ' = 1')
def profiles_one_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of seven places that differ in one: an equi-join on profiles with a place left out, over all parts. The digits repeat every 972
    parts, so pairs grow with the square of the parts; the SQL compares all of them."""
    return one_apart(profiles(spark, sf_dir), "k", "p")


@registry.query("profile_groups")
def groups_of_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir)
    weight = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("w"))
    return profile_groups(p.join(weight, "k", "left").na.fill({"w": 0}), "k", links_one_apart(p, "k", "p"), "w")


PAIRS_SQL = """pr as (select case when lower(trim(development_sequence_id)) not in ('', 'na') then regexp_replace(lower(development_sequence_id), '\\s+', '', 'g') end a, case when lower(trim(external_sequence_id)) not in ('', 'na') then regexp_replace(lower(external_sequence_id), '\\s+', '', 'g') end b, ani_percent ani, least(aligned_fraction_development, aligned_fraction_external) af from collision_pairs),
near as (select a, b, case when ani >= 99.99 and af >= 0.95 then 'duplicate' else 'near_neighbor' end class from pr where a is not null and b is not null and a <> b and ani between 99.9 and 100 and af between 0.9 and 1)"""


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.when(~is_placeholder(F.col(c)), F.lower(F.regexp_replace(c, r"\s+", "")))
    p = table(spark, sf_dir, "collision_pairs").select(key("development_sequence_id").alias("a"), key("external_sequence_id").alias("b"), F.col("ani_percent").alias("ani"), F.least("aligned_fraction_development", "aligned_fraction_external").alias("af"))
    return p.where("a <> b and ani between 99.9 and 100 and af between 0.9 and 1").select("a", "b", F.when((F.col("ani") >= 99.99) & (F.col("af") >= 0.95), "duplicate").otherwise("near_neighbor").alias("class"))


@registry.query("pair_classes", f"with {PAIRS_SQL} select class, count(*) n_pairs, count(distinct a) n_left from near group by 1")
def pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n_pairs"), F.countDistinct("a").alias("n_left"))


@registry.query("similarity_clusters", f"with recursive {PAIRS_SQL}, e as (select a, b from near union select b, a from near), r as (select a, a b from e union select r.a, e.b from r join e on r.b = e.a), root as (select a id, min(b) root from r group by 1), s as (select root, count(*) size, dense_rank() over (order by root) k from root group by 1) select id, 'cluster-' || lpad(k::varchar, 6, '0') label, size from root join s using (root)")
def similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over pairs above the thresholds, numbered by their least member."""
    g = linked_groups(near_pairs(spark, sf_dir), "a", "b")
    return dense_labels(g, "root", "cluster-%06d").select("id", "label", "size")


@registry.query("partner_counts", f"with {PAIRS_SQL}, p as (select distinct a, b, class from near union select distinct b, a, class from near) select a id, count(distinct case when class = 'duplicate' then b end) n_duplicate_partners, count(distinct case when class = 'near_neighbor' then b end) n_near_partners from p group by 1")
def partner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = near_pairs(spark, sf_dir)
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "class")).distinct()
    return both.groupBy(F.col("a").alias("id")).pivot("class", ["duplicate", "near_neighbor"]).agg(F.count("b")).select("id", F.coalesce("duplicate", F.lit(0)).alias("n_duplicate_partners"), F.coalesce("near_neighbor", F.lit(0)).alias("n_near_partners"))


UNITS_SQL = f"""{META_SQL}, mem as (select distinct isolate_id i, unnest(['L:' || {sql_label('lineage_group')}, 'D:' || {sql_label('deduplication_group')}]) g from isolate_metadata where isolate_id is not null),
tie as (select distinct x.g a, y.g b from mem x join mem y using (i) where x.g is not null and y.g is not null), r as (select g a, g b from mem where g is not null union select r.a, t.b from r join tie t on r.b = t.a), root as (select a g, min(b) root from r group by 1),
u0 as (select distinct m.i, root from mem m join root using (g)), nm as (select root, min(i) unit from u0 group by 1), unit as (select i.isolate_id, coalesce(nm.unit, i.isolate_id) unit from (select distinct isolate_id from meta) i left join u0 on u0.i = i.isolate_id left join nm using (root))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "isolate_metadata")
    links = star_links(m, "isolate_id", {"L": label_key(F.col("lineage_group")), "D": label_key(F.col("deduplication_group"))})
    return linked_groups(links, "a", "b", m, "isolate_id").select(F.col("id").alias("isolate_id"), F.col("root").alias("unit"), "size")


@registry.query("leakage_units", f"with recursive {UNITS_SQL}, sized as (select isolate_id, unit, count(*) over (partition by unit) size, dense_rank() over (order by unit) k from unit) select isolate_id, unit, 'cv-group-' || lpad(k::varchar, 6, '0') as label, size from sized")
def units_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units over lineages and, guarded against chaining, deduplication groups, numbered by their least isolate."""
    m = table(spark, sf_dir, "isolate_metadata")
    u = leakage_units(m, "isolate_id", {"L": label_key(F.col("lineage_group"))}, {"D": label_key(F.col("deduplication_group"))}, 5)
    return dense_labels(u, "unit", "cv-group-%06d").select("isolate_id", "unit", "label", "size")


@registry.query("balanced_folds")
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units dealt to five folds that balance the networks; the number of isolates of each fold and network."""
    u = units(spark, sf_dir).join(metadata(spark, sf_dir).select("isolate_id", "network"), "isolate_id", "left")
    return u.join(assign_folds(u, "unit", "network"), "unit").groupBy("fold", "network").agg(F.count("*").alias("n_isolates"), F.countDistinct("unit").alias("n_units"))


@registry.query("field_coverage", "select field, n_present, (select count(*) from isolates) - n_present n_missing from (unpivot (select " + ", ".join(f"count(*) filter (trim({c}) <> '') {c}" for c in ("collection_date", "geo_loc_name", "country", "host", "site", "epi_type", "isolation_source")) + " from isolates) on columns(*) into name field value n_present)")
def coverage_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_coverage(table(spark, sf_dir, "isolates"), ["collection_date", "geo_loc_name", "country", "host", "site", "epi_type", "isolation_source"])


_s = "regexp_replace(lower(evaluation_split), '\\s+', '', 'g')"


@registry.query("contract_report", f"with m as (select *, {_s} s, {sql_label('lineage_group')} l, {sql_label('genomic_cluster')} c from isolate_metadata) select rule, severity, n_rows from (select 'missing_isolate' rule, 'failure' severity, count(*) filter (isolate_id is null) n_rows from m union all select 'bad_sha256', 'failure', count(*) filter (not regexp_matches(coalesce(genome_sha256, ''), '^[0-9a-fA-F]{{64}}$')) from m union all select 'unknown_split', 'failure', count(*) filter (s is null or s not in ('development', 'external')) from m union all select 'missing_site', 'warning', count(*) filter (site is null) from m) union all select 'duplicate_isolate', 'failure', count(*) from (select isolate_id from m group by 1 having count(*) > 1 or isolate_id is null) union all select 'isolate_of_two_lineages', 'failure', count(*) from (select isolate_id from m where l is not null group by 1 having count(distinct l) > 1) union all select 'biosample_of_two_isolates', 'failure', count(*) from (select biosample_accession from m where isolate_id is not null and biosample_accession is not null group by 1 having count(distinct isolate_id) > 1) union all select 'network_in_both_splits', 'warning', count(*) from (select surveillance_network from m where s in ('development', 'external') and surveillance_network is not null group by 1 having count(distinct s) > 1) union all select 'cluster_crosses_splits', 'failure', count(*) from (select c from m where s in ('development', 'external') and c is not null group by 1 having count(distinct s) > 1) union all select 'site_in_both_splits', 'warning', count(*) from (select site from m where s in ('development', 'external') and site is not null group by 1 having count(distinct s) > 1)")
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules counted in one pass; keys, dependencies and crossing groups as violations."""
    m = table(spark, sf_dir, "isolate_metadata").withColumns({"s": F.lower(F.regexp_replace("evaluation_split", r"\s+", "")), "l": label_key(F.col("lineage_group")), "c": label_key(F.col("genomic_cluster"))})
    known = m.withColumn("s", F.when(F.col("s").isin("development", "external"), F.col("s")))
    rules = {"missing_isolate": ("failure", F.col("isolate_id").isNull()), "bad_sha256": ("failure", ~F.coalesce("genome_sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$")), "unknown_split": ("failure", F.col("s").isNull() | ~F.col("s").isin("development", "external")), "missing_site": ("warning", F.col("site").isNull())}
    count = lambda d, rule, severity: d.agg(F.count("*").alias("n_rows")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n_rows")
    return (
        validation_report(m, rules)
        .unionByName(count(duplicate_keys(m, ["isolate_id"]), "duplicate_isolate", "failure"))
        .unionByName(count(dependency_violations(m, "isolate_id", "l"), "isolate_of_two_lineages", "failure"))
        .unionByName(count(dependency_violations(m, "biosample_accession", "isolate_id"), "biosample_of_two_isolates", "failure"))
        .unionByName(count(shared_values(known, "surveillance_network", "s"), "network_in_both_splits", "warning"))
        .unionByName(count(crossing_groups(known, "c", "s"), "cluster_crosses_splits", "failure"))
        .unionByName(count(shared_values(known, "site", "s"), "site_in_both_splits", "warning"))
    )


ELEMENT_SQL = "el as (select distinct l_suppkey record, case p_partkey % 5 when 0 then 'blaCTX-M-' || (p_partkey % 30) when 1 then 'qnrB' || (p_partkey % 9) when 2 then case p_partkey % 2 when 0 then 'aac(3)-IVa' else 'aac(6'')-Ib' || (p_partkey % 7) end when 3 then 'gyrA_S83L' else 'tet' || (p_partkey % 4) end symbol, upper(split_part(p_type, ' ', 1)) || '/' || p_brand classes from lineitem join part on l_partkey = p_partkey)"
FAMILY_SQL = "case when symbol like '%\\_%' escape '\\' then null when regexp_matches(symbol, '^bla[A-Za-z]+(-[A-Za-z]+)?(-[0-9]+[A-Za-z]*)?$') then regexp_replace(symbol, '-[0-9]+[A-Za-z]*$', '') else regexp_replace(regexp_replace(symbol, '([^0-9])[0-9]+$', '\\1'), '(-[IVX]+)[a-z]$', '\\1') end"
HIER_SQL = f"{ELEMENT_SQL}, hier as (select record, symbol feature from el union select record, 'family:' || {FAMILY_SQL} from el union select record, 'class:' || trim(c) from (select record, unnest(string_split(classes, '/')) c from el))"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    j = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("record")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == k)
    m = lambda n: (k % n).cast("string")
    symbol = F.when(k % 5 == 0, F.concat(F.lit("blaCTX-M-"), m(30))).when(k % 5 == 1, F.concat(F.lit("qnrB"), m(9))).when((k % 5 == 2) & (k % 2 == 0), "aac(3)-IVa").when(k % 5 == 2, F.concat(F.lit("aac(6')-Ib"), m(7))).when(k % 5 == 3, "gyrA_S83L").otherwise(F.concat(F.lit("tet"), m(4)))
    return j.select("record", symbol.alias("symbol"), F.concat(F.upper(F.substring_index("p_type", " ", 1)), F.lit("/"), "p_brand").alias("classes")).distinct()


@registry.query("feature_hierarchy", f"with {HIER_SQL} select record, feature from hier where feature is not null")
def feature_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(elements(spark, sf_dir), "record", "symbol", "classes")


@registry.query("supported_features", f"with {HIER_SQL} select feature, count(distinct record) n_records from hier where feature is not null group by 1 having count(distinct record) >= 5")
def supported_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supported(hierarchy(elements(spark, sf_dir), "record", "symbol", "classes"), "record", "feature")


@registry.query("feature_sets", f"with {ELEMENT_SQL} select record, list_sort(list(distinct symbol)) features from el group by 1")
def sets_of_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_sets(elements(spark, sf_dir), "record", "symbol")


@registry.query("occurrence_numbers", f"with {ELEMENT_SQL} select record, classes, symbol || '#' || row_number() over (partition by record, symbol order by classes) name from el")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("record", "symbol").orderBy("classes"))
    return elements(spark, sf_dir).select("record", "classes", F.concat_ws("#", "symbol", n.cast("string")).alias("name"))


@registry.query("mean_vectors", "select label, list(x order by pos) vector from (select label, pos, round(avg(x), 6) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) pos from embeddings) group by 1, 2) group by 1")
def vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")


@registry.query("similarity_to_mean", "with m as (select label, list(x order by pos) v from (select label, pos, round(avg(x), 6) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) pos from embeddings) group by 1, 2) group by 1) select vec_id, round(list_cosine_similarity(embedding::double[], v), 5) similarity from embeddings join m using (label)")
def similarity_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.join(mean_vectors(e, ["label"], "embedding"), "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("vector")), 5).alias("similarity"))


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the documents that are FASTA."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("^>[0-9]+\n[ACGT\n]+"))
    r = d.select("doc_id", F.posexplode(F.split(F.substring("text", 2, 1 << 30), "\n>")).alias("i", "r"))
    return r.select("doc_id", "i", F.substring_index("r", "\n", 1).alias("name"), F.upper(F.regexp_replace(F.expr("substring(r, length(substring_index(r, '\n', 1)) + 1)"), r"\s+", "")).alias("sequence"))


FASTA_SQL = "fa as (select doc_id, generate_subscripts(p, 1) - 1 i, unnest(p) r from (select doc_id, string_split(substr(text, 2), chr(10) || '>') p from documents where regexp_matches(text, '^>[0-9]+\\n[ACGT\\n]+'))), fasta as (select doc_id, i, string_split(r, chr(10))[1] as name, upper(regexp_replace(substr(r, length(string_split(r, chr(10))[1]) + 1), '\\s+', '', 'g')) as seq from fa)"


@registry.query("sequence_counts", f"with {FASTA_SQL} select doc_id, i, name, length(seq) n_bases, length(seq) - length(translate(seq, 'GC', '')) gc, length(translate(seq, 'ACGT', '')) ambiguous from fasta")
def sequence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta(spark, sf_dir).withColumn("c", base_counts(F.col("sequence"))).select("doc_id", "i", "name", F.col("c.length").alias("n_bases"), "c.gc", "c.ambiguous")


@registry.query("sequence_windows", f"with {FASTA_SQL}, w as (select doc_id, i, seq, unnest(range(length(seq) // 100 + case when length(seq) % 100 >= 50 then 1 else 0 end)) k from fasta) select doc_id, i, k * 100 start, substr(seq, k * 100 + 1, 100) win, reverse(translate(substr(seq, k * 100 + 1, 100), 'ACGT', 'TGCA')) reverse_complement from w")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(fasta(spark, sf_dir).withColumn("key", F.struct("doc_id", "i")), "key", "sequence", 100, 50)
    return w.select("key.doc_id", "key.i", "start", F.col("window").alias("win"), reverse_complement(F.col("window")).alias("reverse_complement"))


@registry.query("sequence_copies", f"with {FASTA_SQL} select sha256(seq) sha256, count(*) n_uses from fasta group by 1")
def sequence_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique, uses = content_addressed(fasta(spark, sf_dir), "sequence")
    return uses.join(unique.select("sha256"), "sha256").groupBy("sha256").agg(F.count("*").alias("n_uses"))


@registry.query("wide_to_long", "select id, field, value from (unpivot (select distinct id, antibiotic, mic_mg_l, measurement_sign, testing_standard from ast where id is not null) on antibiotic, mic_mg_l, measurement_sign, testing_standard into name field value value) where trim(value) <> ''")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["antibiotic", "mic_mg_l", "measurement_sign", "testing_standard"]
    a = table(spark, sf_dir, "ast").where("id is not null").select("id", *cols).distinct()
    return a.unpivot("id", cols, "field", "value").where("trim(value) <> ''")


@registry.query("change_classes", f"with {ISOLATES_SQL}, m as (select isolate_id, max(specimen_source) s from isolate_metadata where isolate_id is not null group by 1) select case when trim(coalesce(i.isolation_source, '')) = '' and trim(coalesce(m.s, '')) = '' then 'both_missing' when trim(coalesce(i.isolation_source, '')) = '' then 'source_added' when trim(coalesce(m.s, '')) = '' then 'source_missing' when lower(trim(i.isolation_source)) = lower(trim(m.s)) then 'same' else 'changed' end class, count(*) n from iso i join m on m.isolate_id = i.target_acc group by 1")
def change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "isolate_metadata").where("isolate_id is not null").groupBy(F.col("isolate_id").alias("target_acc")).agg(F.max("specimen_source").alias("s"))
    gone = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    old, new = F.col("isolation_source"), F.col("s")
    kind = F.when(gone(old) & gone(new), "both_missing").when(gone(old), "source_added").when(gone(new), "source_missing").when(F.lower(F.trim(old)) == F.lower(F.trim(new)), "same").otherwise("changed")
    return isolates(spark, sf_dir).join(m, "target_acc").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@registry.query("tables_apart", "select 'only_metadata' side, count(*) n from (select isolate_id from isolate_metadata except select target_acc from isolates) union all select 'only_isolates', count(*) from (select target_acc from isolates except select isolate_id from isolate_metadata) union all select 'both', count(*) from (select target_acc from isolates intersect select isolate_id from isolate_metadata)")
def tables_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "isolate_metadata").select(F.col("isolate_id").alias("k"))
    b = table(spark, sf_dir, "isolates").select(F.col("target_acc").alias("k"))
    n = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.subtract(b), "only_metadata").unionByName(n(b.subtract(a), "only_isolates")).unionByName(n(a.intersect(b), "both"))


@registry.query("request_batches", f"with b as (select b, ntile(16) over (order by b) batch, (row_number() over (order by b) - 1) // {BLOCK} block from (select distinct biosample_accession b from sequence_requests where biosample_accession is not null)), d as (select batch, block, count(*) n, sha256(string_agg(b, chr(10) order by b)) h from b group by 1, 2) select batch, sum(n)::bigint n, sha256(string_agg(h, chr(10) order by block)) digest from d group by 1")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen batches of requests in order; a batch's digest is that of the digests of its blocks of consecutive requests, so no list is
    gathered whole."""
    b = table(spark, sf_dir, "sequence_requests").select(F.col("biosample_accession").alias("b")).where("b is not null").distinct()
    b = ranked(b, "b")
    k, n = F.col("rank"), F.col("of")
    least, more = F.floor(n / 16), n % 16  # the first n % 16 batches hold one more
    batch = F.when(k < more * (least + 1), F.floor(k / (least + 1))).otherwise(more + F.floor((k - more * (least + 1)) / F.greatest(least, F.lit(1))))
    d = b.groupBy((batch + 1).cast("int").alias("batch"), F.floor(k / BLOCK).alias("block")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("b")), "\n"), 256).alias("h"))
    digests = F.array_sort(F.collect_list(F.struct("block", "h")))
    return d.groupBy("batch").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(digests, lambda x: x.h), "\n"), 256).alias("digest"))


@registry.query("largest_by_network", f"with {META_SQL}, g as (select coalesce(network, 'none') network, lineage, count(*) n from meta where lineage is not null group by 1, 2) select network, lineage, n from (select *, row_number() over (partition by network order by n desc, lineage) k from g) where k <= 3")
def largest_by_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = metadata(spark, sf_dir).where("lineage is not null").groupBy(F.coalesce("network", F.lit("none")).alias("network"), "lineage").agg(F.count("*").alias("n"))
    return top_k(g, ["network"], [F.desc("n"), F.asc("lineage")], 3)


@registry.query("union_by_name", "select source, count(*) n, count(accession) n_accession, count(species_result) n_species from (select 'metadata' source, biosample_accession accession, species_result from isolate_metadata union all select 'isolates', biosample_acc, null from isolates) group by 1")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "isolate_metadata").select(F.lit("metadata").alias("source"), F.col("biosample_accession").alias("accession"), "species_result")
    b = table(spark, sf_dir, "isolates").select(F.lit("isolates").alias("source"), F.col("biosample_acc").alias("accession"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("accession").alias("n_accession"), F.count("species_result").alias("n_species"))


@registry.query("normalised_categories", "select case lower(regexp_replace(trim(resistance_phenotype_raw), '\\s+', ' ', 'g')) when 'susceptible' then 'S' when 's' then 'S' when 'intermediate' then 'I' when 'i' then 'I' when 'resistant' then 'R' when 'r' then 'R' else upper(trim(resistance_phenotype_raw)) end category, count(*) n from ncbi_biosample_antibiograms group by 1")
def normalised_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"susceptible": "S", "s": "S", "intermediate": "I", "i": "I", "resistant": "R", "r": "R", "nonsusceptible": "NS", "non-susceptible": "NS", "ns": "NS", "sdd": "SDD", "susceptible-dose dependent": "SDD"}
    c = F.col("resistance_phenotype_raw")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), normalised(c))
    return table(spark, sf_dir, "ncbi_biosample_antibiograms").groupBy(F.coalesce(known, F.upper(F.trim(c))).alias("category")).agg(F.count("*").alias("n"))


@registry.query("hash_ordered_groups", f"with {META_SQL}, g as (select lineage, count(*) n from meta where lineage is not null group by 1) select lineage, n, {sql_hash("'20260815:' || lineage")} tie from g order by n desc, tie limit 10")
def hash_ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the largest lineages, equals in the order of a seeded hash."""
    from assayflow.operators.resample import hash_number

    g = metadata(spark, sf_dir).where("lineage is not null").groupBy("lineage").agg(F.count("*").alias("n")).withColumn("tie", hash_number(F.lit("20260815"), F.col("lineage")))
    return g.orderBy(F.desc("n"), "tie").limit(10)
