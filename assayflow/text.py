"""Column builders for dirty text: blanks, placeholders, canonical labels, aliases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for "no value".
BLANK_TOKENS = ("", "nan", "none", "null")
BLANK_TOKENS_WITH_NA = (*BLANK_TOKENS, "<na>")
PLACEHOLDERS = (
    "", "-", "--", "?", ".", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "<na>", "missing", "unknown", "not assigned",
    "not applicable", "not available", "not provided", "not collected", "not known", "not recorded", "unspecified", "pending",
    "tbd", "see notes", "singleton", "restricted access",
)


def spaced(c: Column) -> Column:
    """Trimmed, every run of blanks (no-break ones too) one space; null stays null."""
    return F.trim(F.regexp_replace(c, r"[\s ​﻿]+", " "))


def is_placeholder(c: Column, tokens: Iterable[str] = PLACEHOLDERS) -> Column:
    """True for null and for texts that stand for no value, case and blanks aside."""
    return c.isNull() | F.lower(spaced(c)).isin(list(tokens))


def clean(c: Column, tokens: Iterable[str] = BLANK_TOKENS_WITH_NA) -> Column:
    """Trimmed text, or null where it is blank."""
    return F.when(~F.lower(F.trim(c)).isin(list(tokens)), F.trim(c))


def normalised(c: Column) -> Column:
    """Trimmed, lower case, runs of white space one space."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def label_key(c: Column) -> Column:
    """A label without case, blanks, separators and leading zeros of its numbers; null where it names nothing."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    key = F.regexp_replace(bare, r"(?<!\p{N})0+(?=\p{N})", "")
    return F.when(~is_placeholder(c) & (key != ""), key)


def header_name(name: str) -> str:
    """A column header in lower case, with runs of other characters than letters and digits as one underscore."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def canonical_headers(df: DataFrame) -> DataFrame:
    """df with header_name() headers; two headers that become one are refused."""
    names = [header_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"duplicate headers: {', '.join(twice)}")
    return df.toDF(*names)


def alias_coalesce(df: DataFrame, aliases: Iterable[str], tokens: Iterable[str] = BLANK_TOKENS_WITH_NA) -> tuple[Column, Column]:
    """(first non-blank value of the aliases that df has, whether two of them differ beyond case and blanks)."""
    have = [clean(F.col(f"`{a}`").cast("string"), tokens) for a in aliases if a in df.columns]
    if not have:
        return F.lit(None).cast("string"), F.lit(False)
    distinct = F.array_distinct(F.filter(F.array(*[normalised(c) for c in have]), lambda x: x.isNotNull()))
    return F.coalesce(*have), F.size(distinct) > 1


def computed_once(c: Column) -> Column:
    """A long computed column that filters are not pushed through: below, they would compute it a second time, and all that it is made of
    as often as it is used. The number of the task, never negative, keeps the optimizer from it."""
    return F.when(F.spark_partition_id() >= 0, c)


def joined_values(c: Column, sep: str = ";") -> Column:
    """Aggregate: distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)
