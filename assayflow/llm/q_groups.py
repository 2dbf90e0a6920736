"""Problems 1, 4 and 6: related isolates, components of matches, isolates across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.llm.components import connected_components
from assayflow.llm.overlap import cross_split_matches
from assayflow.llm.splits import deal, related_units
from assayflow.plans.common import Registry, table
from assayflow.text import PLACEHOLDERS, is_placeholder, label_key
from assayflow.workspace import materialise

registry = Registry()
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def split_key() -> F.Column:
    s = F.lower(F.regexp_replace("evaluation_split", r"\s+", ""))
    return F.when(s.isin("development", "external"), s)


def isolate_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((isolate_id, unit, sides), forest); sides: development and external, as far as the isolate's rows name them."""
    meta = table(spark, sf_dir, "isolate_metadata")
    units, forest = related_units(meta, "isolate_id", {"L": label_key(F.col("lineage_group")), "D": label_key(F.col("deduplication_group"))})
    sides = meta.where("isolate_id is not null").groupBy("isolate_id").agg(F.array_sort(F.collect_set(split_key())).alias("sides"))
    return units.join(sides, "isolate_id"), forest


_blank = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
_key = lambda c: f"case when lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) not in ({_blank}) then regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') end"
_meta = f"meta as (select isolate_id, {_key('lineage_group')} lg, {_key('deduplication_group')} dg, {_key('genomic_cluster')} cg, lower(trim(genome_sha256)) gs, regexp_replace(lower(evaluation_split), '\\s+', '', 'g') side from isolate_metadata where isolate_id is not null)"
# Labels spread, a round at a time, over the groups of the members: the least isolate of a unit reaches all of it.
_unit_sql = f"""
with recursive {_meta},
member as (select distinct isolate_id, 'L:' || lg g from meta where lg is not null union select distinct isolate_id, 'D:' || dg from meta where dg is not null),
tie as (select distinct x.g a, y.g b from member x join member y using (isolate_id)),
reach as (select g a, g b from member union select r.a, t.b from reach r join tie t on r.b = t.a),
root as (select a g, min(b) root from reach group by a),
of as (select distinct m.isolate_id, r.root from member m join root r using (g)),
named as (select root, min(isolate_id) unit_id from of group by root),
unit as (select distinct i.isolate_id, coalesce(n.unit_id, i.isolate_id) unit_id from (select distinct isolate_id from meta) i left join of using (isolate_id) left join named n using (root))
"""


@registry.query("p1_found", _unit_sql + """
select distinct isolate_id, unit_id from unit where unit_id in (
  select unit_id from unit join meta using (isolate_id) where side in ('development', 'external') group by unit_id having count(distinct side) = 2)""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = isolate_units(spark, sf_dir)
    rows, _ = materialise(rows, "units")
    divided = rows.select("unit", F.explode("sides").alias("side")).groupBy("unit").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b")
    return rows.join(divided, "unit", "left_semi").select("isolate_id", F.col("unit").alias("unit_id"))


@registry.query("p1_splits")
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every isolate: whole units, dealt by size band in the proportions of SPLITS."""
    rows, _ = isolate_units(spark, sf_dir)
    rows, _ = materialise(rows, "units")
    sizes = rows.groupBy("unit").agg(F.count("*").alias("unit_size"))
    dealt = deal(sizes, "unit", "unit_size", SPLITS)
    return rows.join(dealt, "unit").select("isolate_id", F.col("unit").alias("unit_id"), "unit_size", "split")


@registry.query("p1_shares")
def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By new split: units, isolates, their share and the proportion that was asked for."""
    s = p1_splits(spark, sf_dir).groupBy("split").agg(F.countDistinct("unit_id").alias("n_units"), F.count("*").alias("n_isolates"))
    total = F.sum("n_isolates").over(Window.partitionBy(F.lit(1)))  # one row for each split
    asked = F.coalesce(*[F.when(F.col("split") == name, F.lit(part)) for name, part in SPLITS])
    return s.select("split", "n_units", "n_isolates", F.round(F.col("n_isolates") / total, 6).alias("share"), asked.alias("asked"))


@registry.query("p1_forest")
def p1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persisted spanning forest: the links that hold the units together."""
    _, forest = isolate_units(spark, sf_dir)
    return forest.select(F.col("a").alias("group_key"), F.col("b").alias("record_key"), F.col("weight").alias("group_size"))


def match_key(c: str) -> F.Column:
    """A sequence id without case and blanks; null where the end is not filled."""
    return F.when(~is_placeholder(F.col(c)), F.lower(F.regexp_replace(c, r"[\s ]+", "")))


_seq_key = lambda c: f"case when lower(trim({c})) not in ({_blank}) then regexp_replace(lower({c}), '\\s+', '', 'g') end"


@registry.query("p4_found", f"""
with recursive pair as (select * from (select {_seq_key('development_sequence_id')} a, {_seq_key('external_sequence_id')} b from collision_pairs) where a is not null and b is not null),
named as (select regexp_replace(lower(sequence_id), '\\s+', '', 'g') k, min(sequence_id) s from sequence_requests group by 1),
edge as (select distinct coalesce(x.s, a) a, coalesce(y.s, b) b from pair left join named x on x.k = a left join named y on y.k = b),
both_ways as (select a, b from edge union select b, a from edge),
reach as (select a, a b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select a sequence_id, min(b) component_id from reach group by a""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "collision_pairs").select(match_key("development_sequence_id").alias("a"), match_key("external_sequence_id").alias("b")).where("a is not null and b is not null").distinct()
    named = table(spark, sf_dir, "sequence_requests").where("sequence_id is not null").groupBy(F.lower(F.regexp_replace("sequence_id", r"[\s ]+", "")).alias("k")).agg(F.min("sequence_id").alias("s"))
    to = lambda k: named.select(F.col("k").alias(k), F.col("s").alias(f"{k}s"))
    spelled = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("as", "a").alias("a"), F.coalesce("bs", "b").alias("b"))
    return connected_components(spelled, "a", "b").select(F.col("id").alias("sequence_id"), F.col("component").alias("component_id"))


def identity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(isolate_id, side, surveillance_network, keys, text_id, text): each isolate's record as a text of its identities, a letter for the kind and
    the 64 digits of the hash of its label each. Labels that differ in one digit share no run; records with one identity in common share a
    passage of 65 characters, wherever it stands."""
    kinds = {"L": label_key(F.col("deduplication_group")), "K": label_key(F.col("genomic_cluster")), "G": F.when(~is_placeholder(F.col("genome_sha256")), F.lower(F.trim("genome_sha256")))}
    keys = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(k), F.sha2(F.concat_ws(":", F.lit(k), c), 256))) for k, c in kinds.items()]))
    rows = table(spark, sf_dir, "isolate_metadata").select("isolate_id", split_key().alias("side"), "surveillance_network", keys.alias("keys")).where("isolate_id is not null and side is not null")
    text = F.array_join("keys", "")
    rows, _ = materialise(rows.where(F.size("keys") > 0).withColumns({"text": text, "text_id": F.sha2(text, 256)}).distinct(), "identities")
    return rows


def shared_identities(rows: DataFrame) -> DataFrame:
    """(id_a, id_b, n_shared, coverage): texts of development (a) and of external isolates (b) that share a passage of a whole identity. Whether the
    passage is one is checked on the identities themselves."""
    texts = rows.select("text_id", F.when(F.col("side") == "development", "a").otherwise("b").alias("side"), "text").distinct()
    # one identity in three is less than a third of the fingerprints at worst: any shared one is followed
    met = cross_split_matches(texts, k=16, w=17, least=0.0, share=None).where("common >= 65")
    of = lambda s, name: rows.select(F.col("text_id").alias(f"id_{s}"), F.col("keys").alias(name)).distinct()
    both = met.join(of("a", "ka"), "id_a").join(of("b", "kb"), "id_b").withColumn("n_shared", F.size(F.array_intersect("ka", "kb")))
    return both.where("n_shared > 0").select("id_a", "id_b", "n_shared", F.greatest("coverage_a", "coverage_b").alias("coverage"))


@registry.query("p6_found", f"""
with {_meta},
k as (select distinct isolate_id, side, 'D' || dg k from meta where dg is not null union select distinct isolate_id, side, 'C' || cg from meta where cg is not null union select distinct isolate_id, side, 'G' || gs from meta where gs is not null and gs not in ({_blank}))
select distinct least(x.isolate_id, y.isolate_id) isolate_a, greatest(x.isolate_id, y.isolate_id) isolate_b
from k x join k y using (k) where x.side = 'development' and y.side = 'external' and x.isolate_id <> y.isolate_id""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity_texts(spark, sf_dir)
    same = shared_identities(rows)
    of = lambda side, s: rows.where(F.col("side") == side).select(F.col("text_id").alias(f"id_{s}"), F.col("isolate_id").alias(s)).distinct()
    pairs = same.join(of("development", "a"), "id_a").join(of("external", "b"), "id_b").where("a <> b")
    return pairs.select(F.least("a", "b").alias("isolate_a"), F.greatest("a", "b").alias("isolate_b")).distinct()


@registry.query("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split and network: isolates, isolates that share an identity with the other split, and the mean coverage of their identity texts."""
    rows = identity_texts(spark, sf_dir)
    same, _ = materialise(shared_identities(rows), "shared")
    best = same.select(F.col("id_a").alias("text_id"), F.lit("development").alias("side"), "coverage").unionByName(same.select(F.col("id_b").alias("text_id"), F.lit("external").alias("side"), "coverage"))
    best = best.groupBy("text_id", "side").agg(F.max("coverage").alias("coverage"))
    per = rows.join(best, ["text_id", "side"], "left").groupBy("side", "surveillance_network", "isolate_id").agg(F.max(F.coalesce("coverage", F.lit(0.0))).alias("coverage"))
    return per.groupBy(F.col("side").alias("evaluation_split"), "surveillance_network").agg(F.count("*").alias("n_isolates"), F.count(F.when(F.col("coverage") > 0, 1)).alias("n_overlapping"), F.round(F.avg("coverage"), 6).alias("coverage"))


def documents_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, side, text_id, text) of the documents of isolates of one split; a document's text is its class."""
    meta = table(spark, sf_dir, "isolate_metadata").select("isolate_id", split_key().alias("side")).where("isolate_id is not null and side is not null")
    one = meta.groupBy("isolate_id").agg(F.min("side").alias("side"), F.max("side").alias("other")).where("side = other").select("isolate_id", "side")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "isolate_id", "text").where("text is not null and trim(text) <> '' and doc_id is not null")
    return docs.join(one, "isolate_id").select("doc_id", "source", F.when(F.col("side") == "development", "a").otherwise("b").alias("side"), F.sha2("text", 256).alias("text_id"), "text").distinct()


@registry.query("p6_documents")
def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document of an isolate of either split whose text is, exactly or nearly, in the other split: its class (the least document
    of the same text and split), the number of the other split's texts that it meets, and its greatest coverage by one of them."""
    docs, _ = materialise(documents_of_splits(spark, sf_dir), "documents")
    met, _ = materialise(cross_split_matches(docs.select("text_id", "side", "text").distinct()), "met")
    links = met.select(F.col("id_a").alias("text_id"), F.lit("a").alias("side"), F.col("coverage_a").alias("coverage")).unionByName(met.select(F.col("id_b").alias("text_id"), F.lit("b").alias("side"), F.col("coverage_b").alias("coverage")))
    links = links.groupBy("text_id", "side").agg(F.count("*").alias("n_links"), F.round(F.max("coverage"), 6).alias("coverage"))
    classes = docs.groupBy("text_id", "side").agg(F.min("doc_id").alias("class_id"))
    split = F.when(F.col("side") == "a", "development").otherwise("external")
    return docs.join(links, ["text_id", "side"]).join(classes, ["text_id", "side"]).select("doc_id", "class_id", split.alias("evaluation_split"), "source", "n_links", "coverage").distinct()


@registry.query("p6_by_source")
def p6_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split and source: documents that are in the other split too, and their mean coverage."""
    return p6_documents(spark, sf_dir).groupBy("evaluation_split", "source").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("class_id").alias("n_texts"), F.round(F.avg("coverage"), 6).alias("coverage"))
