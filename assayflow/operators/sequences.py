"""Nucleotide sequences: complements, windows, loci with thresholds, content-addressed copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"))


def base_counts(seq: Column) -> Column:
    """struct(length, gc, ambiguous, valid): valid is whether all characters are IUPAC codes."""
    n = lambda chars: F.length(seq) - F.length(F.translate(seq, chars, ""))
    return F.struct(F.length(seq).alias("length"), n("GCgc").alias("gc"), (F.length(seq) - n("ACGTacgt")).alias("ambiguous"), seq.rlike("^[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*$").alias("valid"))


def windows(df: DataFrame, key: str, seq: str, size: int, least: int) -> DataFrame:
    """(key, start, window): windows side by side; a last one of under least bases is dropped."""
    count = F.floor(F.length(seq) / size) + F.when(F.length(seq) % size >= least, 1).otherwise(0)
    starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int")))
    return df.select(key, F.col(seq).alias("__s"), F.explode(starts).alias("i")).select(key, (F.col("i") * size).alias("start"), F.expr(f"substring(__s, i * {size} + 1, {size})").alias("window"))


def locus(seq: Column, start: Column, end: Column, strand: Column, contig_length: Column, identity: Column, coverage: Column, flank: int = 0, least_identity: float = 80.0, least_coverage: float = 0.9) -> Column:
    """struct(status, sequence) of a hit (1-based, inclusive): extended by flank within its contig, turned on the minus strand.
    status: found, truncated (the extension meets an end of the contig) or below_threshold."""
    lo, hi = F.greatest(F.lit(1), F.least(start, end) - flank), F.least(contig_length, F.greatest(start, end) + flank)
    part = F.substring(seq, lo, hi - lo + 1)
    cut = (F.least(start, end) - flank < 1) | (F.greatest(start, end) + flank > contig_length)
    good = (identity >= least_identity) & (coverage >= least_coverage)
    status = F.when(~F.coalesce(good, F.lit(False)), "below_threshold").when(cut, "truncated").otherwise("found")
    return F.struct(status.alias("status"), F.when(good, F.when(strand == "-", reverse_complement(part)).otherwise(part)).alias("sequence"))


def content_addressed(df: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(unique (sha256, sequence), df with sha256 instead of the sequence)."""
    d = df.withColumn("sha256", F.sha2(F.upper(seq), 256))
    return d.where(F.col(seq).isNotNull()).groupBy("sha256").agg(F.min(F.upper(seq)).alias("sequence")), d.drop(seq)
