"""Sinks: never overwrite, write whole or not at all, and say what was written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators.contracts import ContractError


def distinct_paths(inputs: list[str], outputs: list[str]) -> None:
    """Refuse outputs that are inputs, lie in one, or are named twice."""
    norm = lambda p: p.rstrip("/")
    outs = [norm(p) for p in outputs]
    for o in outs:
        if outs.count(o) > 1 or any(o == norm(i) or o.startswith(norm(i) + "/") for i in inputs):
            raise ContractError(f"{o} is an input or named twice")


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write to a path that must not exist; the committer makes all files visible at once."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_routed(df: DataFrame, reason: str, included: str, excluded: str) -> None:
    """Rows without a reason to one place, the others to another."""
    distinct_paths([], [included, excluded])
    write_new(df.where(F.col(reason).isNull()).drop(reason), included)
    write_new(df.where(F.col(reason).isNotNull()), excluded)


def pair_lines(df: DataFrame, a: str, b: str, numbers: list[str]) -> DataFrame:
    """Pairs as text columns with six decimals, ordered by (a, b) over ranges."""
    return df.select(a, b, *[F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in numbers]).orderBy(a, b)


def content_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files of a path; markers and checksums of the file system are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(~name.startswith("_") & ~name.startswith(".")).select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_issues(lines: DataFrame, line: str, actual: DataFrame) -> DataFrame:
    """(path, issue) of checksum lines 'sha256  path' against files (name, sha256): bad_line, unsafe_path, duplicate_path, missing_file, changed_file; files no line names: unlisted_file."""
    p = lines.select(F.regexp_extract(line, r"^([0-9a-f]{64})  (.+)$", 1).alias("h"), F.regexp_extract(line, r"^([0-9a-f]{64})  (.+)$", 2).alias("path"), F.col(line).alias("raw")).where("trim(raw) <> ''")
    n = p.groupBy("path").agg(F.count("*").alias("n"))
    j = p.join(n, "path").join(actual.select(F.col("name").alias("path"), F.col("sha256").alias("found")), "path", "left")
    issue = F.when(F.col("h") == "", "bad_line").when(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "unsafe_path").when(F.col("n") > 1, "duplicate_path").when(F.col("found").isNull(), "missing_file").when(F.col("found") != F.col("h"), "changed_file")
    listed = j.select(F.when(F.col("h") == "", F.col("raw")).otherwise(F.col("path")).alias("path"), issue.alias("issue")).where("issue is not null").distinct()
    extra = actual.select(F.col("name").alias("path")).join(p.select("path"), "path", "left_anti").select("path", F.lit("unlisted_file").alias("issue"))
    return listed.unionByName(extra)


def row_digest(df: DataFrame, columns: list[str]) -> F.Column:
    """SHA-256 of a row's columns as JSON of sorted [name, value] pairs; nulls are kept."""
    return F.sha2(F.to_json(F.array(*[F.array(F.lit(c), F.col(c).cast("string")) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame) -> dict[str, int | str]:
    """Rows and an order-free digest of a table, in one pass."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    n, s, x = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return {"rows": n, "digest": hashlib.sha256(f"{n}:{s}:{x}".encode()).hexdigest()}


def lock(manifest: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_lock(manifest: Mapping[str, object], expected: str) -> None:
    if lock(manifest) != expected:
        raise ContractError("the locked artifact has changed")
