"""Fail-closed checks. Each gives its violations as rows, so that a caller may count, keep or refuse them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what is required of it."""


def require_columns(df: DataFrame, columns: Iterable[str], label: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{label} lacks the columns {', '.join(missing)}")
    return df


def refuse_columns(df: DataFrame, owned: Iterable[str], label: str = "stage") -> DataFrame:
    """A stage may not overwrite columns that another one owns."""
    taken = [c for c in owned if c in df.columns]
    if taken:
        raise ContractError(f"{label} would overwrite {', '.join(taken)}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows) of keys that occur more than once or hold a null."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | blank)


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """(determinant, n_values) where a value of the determinant goes with several of the dependent; nulls of either say nothing.
    Least and greatest are compared first, so values are counted of the violating keys only."""
    rows = df.where(F.col(determinant).isNotNull() & F.col(dependent).isNotNull()).select(determinant, dependent)
    bad = rows.groupBy(determinant).agg(F.min(dependent).alias("__lo"), F.max(dependent).alias("__hi")).where("__lo <> __hi").select(determinant)
    return rows.join(bad, determinant).groupBy(determinant).agg(F.countDistinct(dependent).alias("n_values"))


def crossing(df: DataFrame, key: str, value: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo <> __hi").select(key)


def crossing_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows lie in several splits."""
    return crossing(df, group, split)


def shared_values(df: DataFrame, value: str, split: str) -> DataFrame:
    """Values (sites, projects, networks) that occur in several splits."""
    return crossing(df, value, split)


def validation_report(df: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(rule, severity, n_rows) of row rules {name: (severity, condition of a violation)}, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, (_, c) in rules.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(f"`{name}`").alias("n_rows")) for name, (severity, _) in rules.items()])
    return counts.select(F.inline(rows))


def refuse(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raise if there is any violation, with the first few."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ContractError(f"{message}: {[tuple(r) for r in rows]}")
