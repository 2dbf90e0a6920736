"""Integer calendar arithmetic that never raises, whatever the session's time zone or ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: int) -> Column:
    """Floor division of integers."""
    return F.floor(a.cast("long") / F.lit(b)).cast("long")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = idiv(yy, 400)
    yoe = yy - era * 400
    doy = idiv(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1
    doe = yoe * 365 + idiv(yoe, 4) - idiv(yoe, 100) + doy
    return era * 146097 + doe - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def is_date(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m)), F.lit(False))


def instant_text(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of seconds since 1970."""
    days = idiv(seconds, 86400)
    rest = seconds - days * 86400
    return F.concat(date_text(days), F.lit("T"), F.lpad((idiv(rest, 3600)).cast("string"), 2, "0"), F.lit(":"), F.lpad((idiv(rest, 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((rest % 60).cast("string"), 2, "0"), F.lit("Z"))


def date_text(days: Column) -> Column:
    """YYYY-MM-DD of days since 1970."""
    return F.date_from_unix_date(days.cast("int")).cast("string")
