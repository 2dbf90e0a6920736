"""Folds that keep units whole and balance what they hold."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_UNITS = 1_000_000


def unit_totals(df: DataFrame, unit: str, stratum: str) -> DataFrame:
    """(unit, stratum, n): what each unit holds."""
    return df.where(F.col(unit).isNotNull()).groupBy(unit, F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"))


def tie_order(seed: int, unit: str) -> str:
    return hashlib.sha256(f"{seed}:{unit}".encode()).hexdigest()


def balance(vectors: dict[str, np.ndarray], folds: int, seed: int) -> dict[str, int]:
    """Greedy assignment: units by size (then hash); the first open the folds, each other goes where the squared relative distance of
    all folds from their targets stays least, then to the least loaded, then to the first."""
    if not vectors:
        return {}
    names = sorted(vectors, key=lambda u: (-vectors[u][-1], tie_order(seed, u)))
    total = np.sum([vectors[u] for u in names], axis=0)
    target = total / folds
    scale = np.maximum(target, 1)
    held = np.zeros((folds, len(total)))
    out = {}
    for k, u in enumerate(names):
        if k < folds:
            f = k
        else:
            now = (((held - target) / scale) ** 2).sum(axis=1)
            then = (((held + vectors[u] - target) / scale) ** 2).sum(axis=1)
            cost = np.round(now.sum() - now + then, 12)
            f = min(range(folds), key=lambda i: (cost[i], held[i, -1], i))
        held[f] += vectors[u]
        out[u] = f
    return out


def assign_folds(df: DataFrame, unit: str, stratum: str, folds: int = 5, seed: int = 20260815) -> DataFrame:
    """(unit, fold). The choice is sequential, so it is made on the driver from one vector for each unit; their number is
    checked. Rows never reach the driver."""
    totals = unit_totals(df, unit, stratum)
    n = totals.select(unit).distinct().count()
    if n > MOST_UNITS:
        raise ValueError(f"{n} units are too many for a sequential assignment")
    rows = totals.collect()
    strata = sorted({r["stratum"] for r in rows})
    place = {s: i for i, s in enumerate(strata)}
    vectors: dict[str, np.ndarray] = {}
    for r in rows:
        v = vectors.setdefault(r[unit], np.zeros(len(strata) + 1))
        v[place[r["stratum"]]] += r["n"]
        v[-1] += r["n"]
    kind = df.schema[unit].dataType.simpleString()
    return df.sparkSession.createDataFrame(sorted(balance(vectors, folds, seed).items()), f"{unit} {kind}, fold int")


def inner_folds(spark: SparkSession, sizes: dict[str, int], folds: int = 4, seed: int = 20260815) -> dict[str, int]:
    """The largest group first, each to the least loaded fold."""
    load = [0] * folds
    out = {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], tie_order(seed, g))):
        f = load.index(min(load))
        out[g] = f
        load[f] += sizes[g]
    return out
