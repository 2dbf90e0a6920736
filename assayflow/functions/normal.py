"""The normal distribution, which Spark SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FLOOR = 1e-300
_erfc = np.vectorize(math.erfc, otypes=[float])


def tail(x: np.ndarray) -> np.ndarray:
    """1 - Phi(x), exact far into the tail."""
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def interval_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Phi(b) - Phi(a), taken in the tail where both lie, floored."""
    flip = a > 0
    lo, hi = np.where(flip, -b, a), np.where(flip, -a, b)
    return np.maximum(tail(-hi) - tail(-lo), FLOOR)


@F.pandas_udf(DoubleType())
def interval_log_likelihood(mu: pd.Series, sd: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """log P(lo - 1 < X <= hi) of a normal X; null where an argument is."""
    ok = mu.notna() & sd.notna() & lo.notna() & hi.notna() & (sd > 0)
    out = pd.Series(np.nan, index=mu.index)
    m, s, a, b = (x[ok].to_numpy(float) for x in (mu, sd, lo, hi))
    out[ok] = np.log(interval_probability((a - 1 - m) / s, (b - m) / s))
    return out.where(ok, None)
