"""Delimited text tables: every column a string, headers checked, never inferred."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayflow.operators.contracts import ContractError, require_columns
from assayflow.text import canonical_headers


def header_of(spark: SparkSession, path: str, sep: str | None = None) -> tuple[list[str], str]:
    """(columns, delimiter) of the first line; the delimiter is sniffed among comma and tab unless given."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ContractError(f"{path} is empty")
    line = first[0][0].lstrip("﻿")
    sep = sep or ("\t" if line.count("\t") >= line.count(",") and "\t" in line else ",")
    names = next(csv.reader([line], delimiter=sep))
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ContractError(f"duplicate headers in {path}: {', '.join(twice)}")
    return names, sep


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (), sep: str | None = None, canonical: bool = False) -> DataFrame:
    """A delimited file with a header; blank cells are null, a byte order mark is dropped, quoted cells may hold line breaks."""
    names, sep = header_of(spark, path, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"', quote='"', mode="FAILFAST")
    df = canonical_headers(df) if canonical else df
    return require_columns(df, required, path)


def counted(df: DataFrame, columns: Sequence[str]) -> int:
    """Rows of a table that has the columns."""
    return require_columns(df, columns).count()


def key_value_report(df: DataFrame, key: str, value: str, by: Sequence[str]) -> DataFrame:
    """(by, values map<string,double>) of a report with a key and a value in each line; thousands separators are dropped, texts that are no number are left out."""
    number = F.regexp_replace(value, ",", "").try_cast("double")
    rows = df.select(*by, F.col(key).alias("k"), number.alias("v")).where("k is not null and v is not null")
    rows = rows.groupBy(*by, "k").agg(F.max("v").alias("v"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("values"))


def sealed(df: DataFrame, split: str, held_out: str, open_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(development rows in full, held-out rows with the open columns only): the scan of the latter never reads the others."""
    return df.where(F.col(split) != held_out), df.where(F.col(split) == held_out).select(*open_columns)
