"""Two interval algebras for censored measurements: concentrations with open and closed ends, and whole dilutions.

They differ on purpose: '<' y is everything below y as a concentration, and at most one dilution below y as a dilution.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
SNAP = 0.1
COMPARATORS = ("=", "<", "<=", ">", ">=")


def parse_measurement(text: Column) -> Column:
    """struct(sign, value) of texts such as '<=0.5' (no sign means '='); null where the text is anything else."""
    pattern = r"^\s*(<=|>=|<|>|=)?\s*([0-9]+(?:\.[0-9]+)?)\s*$"
    sign, number = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), F.struct(F.when(sign == "", "=").otherwise(sign).alias("sign"), number.try_cast("double").alias("value")))


def comparator(sign: Column) -> Column:
    """The sign in its one form; '==' is '='. Null where it is none."""
    s = F.trim(sign)
    s = F.when(s == "==", "=").otherwise(s)
    return F.when(s.isin(*COMPARATORS), s)


def dilution(value: Column) -> Column:
    """Whole log2 dilution of a value within SNAP of one, else null."""
    x = F.when(value > 0, F.log2(value))
    return F.when(F.abs(x - F.round(x)) <= SNAP, F.round(x).cast("int"))


def dilution_bounds(sign: Column, d: Column) -> Column:
    """struct(lo, hi) of a dilution with a comparator, both inclusive, infinite where open."""
    d = d.cast("double")
    lo = F.when(sign.isin("=", ">="), d).when(sign == ">", d + 1).when(sign.isin("<", "<="), F.lit(-INF))
    hi = F.when(sign.isin("=", "<="), d).when(sign == "<", d - 1).when(sign.isin(">", ">="), F.lit(INF))
    return F.when(d.isNotNull() & sign.isin(*COMPARATORS), F.struct(lo.alias("lo"), hi.alias("hi")))


def rounded_half_up(p: Column) -> Column:
    return F.floor(p + 0.5)


def interval_error(p: Column, lo: Column, hi: Column) -> Column:
    """Dilutions by which a prediction misses the interval."""
    return F.greatest(p - hi, lo - p, F.lit(0.0))


def reference_class(lo: Column, hi: Column) -> Column:
    return F.when(lo == -INF, "left_censored").when(hi == INF, "right_censored").otherwise("exact")


def boundary(lo: Column, hi: Column) -> Column:
    """The finite end of an interval, the upper one if both are; used as the prediction a relative gives."""
    return F.when(lo == -INF, hi).otherwise(lo)


def concentration(sign: Column, value: Column) -> Column:
    """struct(lo, lo_inc, hi, hi_inc) with null ends where open."""
    none = F.lit(None).cast("double")
    lo = F.when(sign.isin("=", ">=", ">"), value).otherwise(none)
    hi = F.when(sign.isin("=", "<=", "<"), value).otherwise(none)
    return F.when(sign.isin(*COMPARATORS) & (value > 0), F.struct(lo.alias("lo"), sign.isin("=", ">=").alias("lo_inc"), hi.alias("hi"), sign.isin("=", "<=").alias("hi_inc")))


def is_subset(inner: Column, outer: Column) -> Column:
    """Whether an interval lies in another: each bounded side of outer bounds inner, and an equal end is not closed inside and open outside."""
    low = outer.lo.isNull() | F.coalesce((inner.lo > outer.lo) | ((inner.lo == outer.lo) & (outer.lo_inc | ~inner.lo_inc)), F.lit(False))
    high = outer.hi.isNull() | F.coalesce((inner.hi < outer.hi) | ((inner.hi == outer.hi) & (outer.hi_inc | ~inner.hi_inc)), F.lit(False))
    return low & high


def region(lo: Column | None, lo_inc: bool, hi: Column | None, hi_inc: bool) -> Column:
    none = F.lit(None).cast("double")
    return F.struct((none if lo is None else lo).alias("lo"), F.lit(lo_inc).alias("lo_inc"), (none if hi is None else hi).alias("hi"), F.lit(hi_inc).alias("hi_inc"))


def classify(kind: Column, interval: Column, low: Column, high: Column) -> Column:
    """The one of three regions that holds the whole interval, null where it crosses an end. Concentrations (MIC) fall from S to R,
    zone diameters (ZONE) rise; low and high are the lower and the upper threshold."""
    mic = F.when(is_subset(interval, region(None, False, low, True)), "S").when(is_subset(interval, region(high, False, None, False)), "R").when(is_subset(interval, region(low, False, high, True)), "I")
    zone = F.when(is_subset(interval, region(None, False, low, False)), "R").when(is_subset(interval, region(high, True, None, False)), "S").when(is_subset(interval, region(low, True, high, False)), "I")
    return F.when(kind == "MIC", mic).when(kind == "ZONE", zone)
