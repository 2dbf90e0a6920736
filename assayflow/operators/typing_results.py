"""Results of typing tools: sequence types, allele profiles, lineage groups, element calls, overlaps with a reference, carriers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.operators.contracts import ContractError, dependency_violations, refuse
from assayflow.operators.graph import profile_groups
from assayflow.operators.joins import one_apart

# Statuses of a sequence type that name a lineage, beginnings of the methods of a complete element, limits of identity and
# coverage (per cent) of the classes of overlap.
LINEAGE_STATUSES = ("PERFECT", "OKAY")
COMPLETE_METHODS = ("EXACT", "ALLELE", "BLAST", "POINT", "HMM", "PARTIAL_CONTIG_END")
OVERLAPS = (("near_identical", 99.0, 95.0), ("close", 90.0, 80.0))


def sequence_type_lineage(st: Column, status: Column) -> Column:
    """ST and the number, without leading zeros, of a positive whole sequence type with a status that names one; otherwise null."""
    digits = F.trim(st)
    number = F.when(digits.rlike("^[0-9]+$"), F.ltrim(digits, F.lit("0")))
    return F.when((number != "") & F.upper(F.trim(status)).isin(*LINEAGE_STATUSES), F.concat(F.lit("ST"), number))


def allele_profile(alleles: Column) -> Column:
    """Array of (locus, allele), sorted, of a text such as adk(10);fumC(11)."""
    parts = F.filter(F.split(alleles, ";"), lambda x: F.trim(x) != "")
    return F.array_sort(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "(", 1)).alias("locus"), F.when(x.contains("("), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^(]*\(", ""), r"\)+\s*$", ""))).otherwise("").alias("allele"))))


def other_scheme(df: DataFrame, scheme: str, profile: str, expected: str, loci: Sequence[str]) -> DataFrame:
    """Rows typed with another scheme or other loci than expected; refuse them with contracts.refuse."""
    own = F.array_sort(F.transform(F.col(profile), lambda p: p.locus))
    return df.where(~(F.col(scheme).eqNullSafe(F.lit(expected)) & own.eqNullSafe(F.array(*[F.lit(x) for x in sorted(loci)]))))


def complete(method: Column) -> Column:
    """Whether a method of detection found an element whole."""
    return F.coalesce(F.upper(F.trim(method)).rlike("^(" + "|".join(COMPLETE_METHODS) + ")"), F.lit(False))


def element_calls(df: DataFrame, record: str, symbol: str, kind: str, method: str, order: Sequence[Column], wanted: str = "AMR") -> DataFrame:
    """Rows with a column outcome: 'call' for the first complete element of the wanted kind of each (record, symbol) in the given order,
    otherwise why not: excluded_type, excluded_method or duplicate_call."""
    why = F.when(~F.trim(kind).eqNullSafe(F.lit(wanted)), "excluded_type").when(~complete(F.col(method)), "excluded_method")
    rows = df.withColumn("__why", why).withColumn("__symbol", F.trim(symbol))
    first = F.row_number().over(Window.partitionBy(record, "__symbol", F.col("__why").isNull()).orderBy(*order))
    return rows.withColumn("outcome", F.coalesce("__why", F.when(first == 1, "call").otherwise("duplicate_call"))).drop("__why", "__symbol")


def element_summary(df: DataFrame, record: str, symbol: str, subtype: str) -> DataFrame:
    """(measure, n) of element_calls: records, records without a call, calls, different elements, calls by subtype, rows by other outcomes."""
    call = F.col("outcome") == "call"
    per = df.groupBy(record).agg(F.max(call.cast("int")).alias("has"))
    n = lambda d, name, c: d.agg(c.alias("n")).select(F.lit(name).alias("measure"), "n")
    return (
        n(per, "records", F.count("*")).unionByName(n(per, "records_without_call", F.count_if(F.col("has") == 0)))
        .unionByName(n(df, "calls", F.count_if(call))).unionByName(n(df.where(call), "elements", F.countDistinct(F.trim(symbol))))
        .unionByName(df.where(call).groupBy(F.concat(F.lit("subtype:"), F.coalesce(F.trim(subtype), F.lit(""))).alias("measure")).agg(F.count("*").alias("n")))
        .unionByName(df.where(~call).groupBy(F.col("outcome").alias("measure")).agg(F.count("*").alias("n")))
    )


def overlap_class(identity: Column, coverage: Column) -> Column:
    """near_identical, close or not_found, by the per cent of identity and of coverage."""
    made = F
    for name, least_identity, least_coverage in OVERLAPS:
        made = made.when((identity >= least_identity) & (coverage >= least_coverage), name)
    return made.otherwise("not_found")


def best_overlap(hits: DataFrame, query: str, identity: str, coverage: str) -> DataFrame:
    """(query, overlap): the best class of each query's hits."""
    rank = F.when(F.col("c") == "near_identical", 0).when(F.col("c") == "close", 1).otherwise(2)
    g = hits.select(query, overlap_class(F.col(identity), F.col(coverage)).alias("c")).groupBy(query).agg(F.min(F.struct(rank.alias("r"), "c")).alias("b"))
    return g.select(query, F.col("b.c").alias("overlap"))


def overlap_summary(uses: DataFrame, sequence: str, gene: str, best: DataFrame, top: int = 15) -> DataFrame:
    """(scope, gene, overlap, n) of uses of sequences: different sequences by class, uses by class, and uses by class of the genes of most uses
    (the lesser of equals; a top-k report)."""
    j = uses.join(best.withColumnRenamed(best.columns[0], sequence), sequence, "left").withColumn("overlap", F.coalesce("overlap", F.lit("not_found")))
    none = F.lit(None).cast("string")
    unique = j.groupBy("overlap").agg(F.countDistinct(sequence).alias("n")).select(F.lit("sequences").alias("scope"), none.alias("gene"), "overlap", "n")
    rows = j.groupBy("overlap").agg(F.count("*").alias("n")).select(F.lit("uses").alias("scope"), none.alias("gene"), "overlap", "n")
    common = j.groupBy(gene).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.asc(gene)).limit(top).select(gene)
    genes = j.join(F.broadcast(common), gene).groupBy(gene, "overlap").agg(F.count("*").alias("n")).select(F.lit("gene").alias("scope"), F.col(gene).alias("gene"), "overlap", "n")
    return unique.unionByName(rows).unionByName(genes)


def carriers(rows: DataFrame, record: str, features: DataFrame, feature: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows of records without the target feature, and of its carriers; a target that nobody carries is refused."""
    have = features.where(F.col(feature) == target).select(record).distinct()
    test = rows.join(have, record, "left_semi")
    if not test.limit(1).count():
        raise ContractError(f"no carriers of {target}")
    return rows.join(have, record, "left_anti"), test


def lineage_groups(df: DataFrame, record: str, lineage: str, profile: str, defining: Column) -> DataFrame:
    """(record, lineage_group, basis) of the rows with a lineage (ST and a number) and a profile (an array of alleles of the same loci).

    Lineages of defining rows are linked where their profiles differ at one locus; a group is named by its lineage of most defining rows,
    of equals by the least number. Other lineages join the only group that they have a neighbour in, and otherwise stand alone. A lineage
    with two profiles is refused.
    """
    typed = df.where(F.col(lineage).isNotNull()).select(record, lineage, F.transform(profile, lambda x: x.cast("string")).alias("p"), F.coalesce(defining, F.lit(False)).alias("d"))
    refuse(dependency_violations(typed.withColumn("t", F.concat_ws("|", "p")), lineage, "t"), "lineages with several profiles")
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    one = typed.groupBy(lineage).agg(F.min("p").alias("p"), F.count_if("d").alias("w")).withColumn("k", number(F.col(lineage)))
    links = one_apart(one, "k", "p")
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = one.where("w > 0")
    of = lambda s: core.select(F.col("k").alias(s))
    inner = near.join(of("a"), "a", "left_semi").join(of("b"), "b", "left_semi").where("a < b")
    groups = profile_groups(core, "k", inner, "w").select("k", "group_name")
    reached = near.join(groups.select(F.col("k").alias("b"), "group_name"), "b").groupBy(F.col("a").alias("k")).agg(F.min("group_name").alias("lo"), F.max("group_name").alias("hi")).where("lo = hi").select("k", F.col("lo").alias("only"))
    named = one.join(groups, "k", "left").join(reached, "k", "left")
    basis = F.when(F.col("group_name").isNotNull(), "within").when(F.col("only").isNotNull(), "neighbour_of_one").otherwise("outside")
    named = named.select(lineage, F.concat(F.lit("SLV:ST"), F.coalesce("group_name", "only", "k").cast("string")).alias("lineage_group"), basis.alias("basis"))
    return typed.select(record, lineage).join(named, lineage).select(record, "lineage_group", "basis")


def detection(scored: DataFrame, keys: Sequence[str], predicted: str, lo: str, hi: str, above: float = 1.0) -> DataFrame:
    """(keys, n, n_right_censored, detected_share, agreement): how many of the right-censored measurements were predicted above a dilution, and
    the share of all predictions within one dilution; the share is null where no measurement is right-censored."""
    p = F.floor(F.col(predicted) + 0.5)
    open_ = F.col(hi) == float("inf")
    error = F.greatest(p - F.col(hi), F.col(lo) - p, F.lit(0.0))
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(open_).alias("n_right_censored"), F.round(F.avg(F.when(open_, (p > above).cast("int"))), 6).alias("detected_share"), F.round(F.avg((error <= 1).cast("int")), 6).alias("agreement"))
