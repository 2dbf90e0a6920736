"""FASTA and GFF3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators.sequences import base_counts


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, description, sequence, counts): one row for each record; text before the first '>' is refused as a record without a name."""
    raw = spark.read.text(path, lineSep=">").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("v")).where("trim(v) <> ''")
    head = F.substring_index("v", "\n", 1)
    seq = F.upper(F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s+", ""))
    rows = raw.select("file", F.substring_index(F.trim(head), " ", 1).alias("name"), F.trim(F.expr("substring(trim(substring_index(v, '\n', 1)), length(substring_index(trim(substring_index(v, '\n', 1)), ' ', 1)) + 1)")).alias("description"), seq.alias("sequence"))
    return rows.withColumn("counts", base_counts(F.col("sequence")))


def fasta_lines(df: DataFrame, name: str, sequence: str, width: int = 80) -> DataFrame:
    """(value): records as text, wrapped; write with df.write.text."""
    wrapped = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 features with their attributes as a map; comments and the FASTA part are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("p", F.split("value", "\t")).where("size(p) = 9")
    at = lambda i: F.get("p", F.lit(i))
    pairs = F.filter(F.split(at(8), ";"), lambda x: x.contains("="))
    attributes = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.url_decode(F.substring_index(x, "=", -1)).alias("v"))))
    return lines.select(at(0).alias("contig"), at(1).alias("source"), at(2).alias("type"), at(3).try_cast("int").alias("start"), at(4).try_cast("int").alias("end"), at(6).alias("strand"), attributes.alias("attributes"))


def panel_genes(gff: DataFrame, genes: list[str]) -> DataFrame:
    """One row for each gene of a panel; a gene without a feature, or with several, is refused by its count."""
    wanted = gff.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    rows = gff.where(F.col("type") == "gene").select(F.coalesce(F.try_element_at("attributes", F.lit("gene")), F.try_element_at("attributes", F.lit("Name"))).alias("gene"), "contig", "start", "end", "strand")
    return F.broadcast(wanted).join(rows, "gene", "left").groupBy("gene").agg(F.count("contig").alias("n_features"), F.min(F.when(F.col("contig").isNotNull(), F.struct("contig", "start", "end", "strand"))).alias("locus"))
