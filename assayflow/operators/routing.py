"""Reason-coded routing: every row lands in exactly one of included and excluded, with its reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(reasons: Mapping[str, Column]) -> Column:
    """The first code whose condition holds (null conditions don't), in order; null where none does."""
    return F.coalesce(*[F.when(c, F.lit(code)) for code, c in reasons.items()], F.lit(None).cast("string"))


def all_matches(reasons: Mapping[str, Column], sep: str = ";") -> Column:
    """All codes whose condition holds, in order and joined; null where none does."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in reasons.items()]))
    return F.when(F.size(hits) > 0, F.array_join(hits, sep))


def routed(df: DataFrame, reason: Column, into: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(included, excluded): rows without and with a reason; together they are the input."""
    marked = df.withColumn(into, reason)
    return marked.where(F.col(into).isNull()).drop(into), marked.where(F.col(into).isNotNull())


def reason_histogram(df: DataFrame, reasons: str, sep: str = ";") -> DataFrame:
    """(reason, n_rows) of a column of joined codes."""
    return df.where(F.col(reasons).isNotNull()).select(F.explode(F.split(reasons, sep)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))
