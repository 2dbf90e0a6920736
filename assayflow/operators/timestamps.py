"""Dates and times as typed, in many formats and zones, in one unambiguous form.

Local times meet their zone's offset intervals in an as-of join: the zones' intervals of constant offset are exploded by
local year, and a row joins those of its (zone, year). Two intervals that hold the local time mean that it occurs twice,
none that a change of clocks skipped it, one gives the offset.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions.calendar import date_text, days_from_civil, idiv, instant_text, is_date
from assayflow.text import computed_once, spaced

# Month names in English, German, French, Spanish, Portuguese, Italian and Dutch, accents removed.
MONTHS = {
    1: "jan january januar janner janvier janv enero ene janeiro gennaio gen januari",
    2: "feb february februar fevrier fevr fev febrero fevereiro febbraio februari",
    3: "mar march marz maerz mrz mars marzo marco maart mrt",
    4: "apr april avril avr abril abr aprile",
    5: "may mai mayo maio maggio mag mei",
    6: "jun june juni juin junio junho giugno giu",
    7: "jul july juli juillet juil julio julho luglio lug",
    8: "aug august aout agosto ago augustus",
    9: "sep sept september septembre septiembre setembro set settembre",
    10: "oct october oktober okt octobre octubre outubro out ottobre ott",
    11: "nov november novembre noviembre novembro",
    12: "dec december dezember dez decembre diciembre dic dezembro dicembre",
}
# Minutes east of UTC of zone abbreviations that name one offset.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "cet": 60, "west": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "aest": 600, "acdt": 630, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
EXCEL_EPOCH = -25569  # 1899-12-30 in days since 1970
SERIAL_DAYS = (10000, 80000)


FIRST, LAST = 1800, 2128  # years that are exploded: no zone of the tz database changes before, and 2101 to 2128 hold every kind of year
FOREVER = 1 << 60


@functools.cache
def _intervals(zone: str, first: int, last: int) -> tuple[tuple[int, int, int], ...]:
    """(local start, local end, offset), seconds: the zone's intervals of constant offset; the first has no start."""
    tz = zoneinfo.ZoneInfo(zone)
    off = lambda s: int(dt.datetime.fromtimestamp(s, tz).utcoffset().total_seconds())
    begin, end, step = int(dt.datetime(first, 1, 1, tzinfo=dt.UTC).timestamp()), int(dt.datetime(last, 12, 31, tzinfo=dt.UTC).timestamp()), 7 * 86400
    rows, start, now = [], -FOREVER, off(begin)
    for t in range(begin, end, step):
        if off(t + step) != now:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == now else (lo, mid)
            rows.append((start + now, hi + now, now))
            start, now = hi, off(hi)
    rows.append((start + now, end + step + now, now))
    return tuple(rows)


def zone_intervals(zones: list[str], first: int = FIRST, last: int = LAST) -> list[tuple[str, int, int, int]]:
    """(zone, local start, local end, offset), seconds: the intervals of constant offset. Unknown zones give none."""
    known = zoneinfo.available_timezones()
    return [(z, *row) for z in zones if z in known for row in _intervals(z, first, last)]


def interval_table(spark: SparkSession, zones: list[str], first: int = FIRST, last: int = LAST) -> DataFrame:
    """zone, local year and the intervals that reach into that year or end in the one before, ordered."""
    exploded: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    year = lambda s: (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)).year if s > -FOREVER / 2 else first
    for zone, a, b, o in zone_intervals(zones, first, last):
        for y in range(max(first, year(a)), min(last, year(b)) + 1):
            exploded.setdefault((zone, y), []).append((a, b, o))
    rows = [(z, y, v) for (z, y), v in sorted(exploded.items())]
    return spark.createDataFrame(rows, "__zone string, __year int, __spans array<struct<a:long,b:long,o:int>>")


def known_zones(df: DataFrame, zone: str) -> list[str]:
    """The zones of a column that the tz database knows; no more than it holds, whatever else the column holds."""
    known = sorted(zoneinfo.available_timezones())
    return sorted(r[0] for r in df.select(F.col(f"`{zone}`").alias("z")).where(F.col("z").isin(known)).distinct().collect())


def new_year(y: Column) -> Column:
    """Days from 1970 to 1 January of a year."""
    return F.unix_date(F.make_date(y, F.lit(1), F.lit(1)))


def like_year(y: Column) -> Column:
    """The year of the table whose clocks change on the same days: before the first, none do; after the last, the zone's rule for good
    depends on the weekday of 1 January and on the leap day only."""
    kinds = {}
    for k in range(LAST - 27, LAST + 1):
        kinds[(dt.date(k, 1, 1) - dt.date(1970, 1, 1)).days % 7 * 2 + (k % 4 == 0)] = k
    leap = F.dayofyear(F.make_date(y, F.lit(12), F.lit(31))) - 365
    kind = F.pmod(new_year(y), F.lit(7)) * 2 + leap
    later = F.try_element_at(F.create_map(*[F.lit(v) for kv in sorted(kinds.items()) for v in kv]), kind.cast("int"))
    return F.when(y > LAST, later).otherwise(F.greatest(y, F.lit(FIRST)))


def _plain(text: Column) -> Column:
    """Lower case, single blanks, no accents."""
    return F.lower(F.translate(spaced(text), "ÀÁÂÃÄàáâãäÉÈÊëéèêÛÜÙûüùÔÖÓôöóÇç", "AAAAAaaaaaEEEeeeeUUUuuuOOOoooCc"))


CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([ap])\.?m\.?)?(?: ?(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]{2,5}))?"
YMD, DMY, NAME, GAP, BEFORE = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})", r"([a-z]{3,10})\.?", r"[ -]?", r"(?:t| |, )"
# Shapes of plain date texts, the first that fits counts: a text becomes its kind, year, month, day, hour, minute, second, half of the day and
# zone. Kinds: y, ym, ymd; local with a wall time; dmy and mixed, the same two in the order of the site; day, serial and the counts of seconds.
SHAPES = [
    (YMD, "ymd|$1|$2|$3"),
    (YMD + BEFORE + CLOCK, "local|$1|$2|$3|$4|$5|$6|$7|$8"),
    (DMY, "dmy|$3|$1|$2"),
    (DMY + BEFORE + CLOCK, "mixed|$3|$1|$2|$4|$5|$6|$7|$8"),
    (r"(\d{4})-(\d{2})", "ym|$1|$2"),
    (r"(\d{1,2})[/.-](\d{4})", "ym|$2|$1"),
    (r"((?:19|20)\d{2})", "y|$1"),
    (r"((?:19|20)\d{2})(\d{2})(\d{2})", "ymd|$1|$2|$3"),
    (r"(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(?:(\d{2})(?:[.,]\d+)?)?(z|[+-]\d{2}:?\d{2})?", "local|$1|$2|$3|$4|$5|$6||$7"),
    (r"(\d{1,2})\.?" + GAP + "(?:de )?" + NAME + GAP + r"(?:de )?,? ?(\d{4})(?:(?: |, |t)" + CLOCK + ")?", "named|$3|$2|$1|$4|$5|$6|$7|$8"),
    (NAME + GAP + r"(\d{1,2})(?:st|nd|rd|th)?,? ?(\d{4})(?:(?: |, |t)" + CLOCK + ")?", "named|$3|$1|$2|$4|$5|$6|$7|$8"),
    (r"(\d{4})[ -]" + NAME + r"[ -](\d{1,2})", "named|$1|$2|$3"),
    (NAME + r"[ -]?(?:de )?(\d{4})", "ym|$2|$1"),
    (r"\d{5}", "day"),
    (r"\d{5}\.\d+", "serial"),
    (r"\d{9,10}(?:\.\d+)?", "seconds"),
    *[(rf"\d{{{n - 1},{n}}}", f"parts|{n - 10}") for n in (13, 16, 19)],
]


def _shape(t: Column) -> Column:
    """Array of the parts of a plain date text, the kind first; null if it has no shape of a date."""
    whole = [(f"^{pattern}$", form) for pattern, form in SHAPES]
    made = reduce(lambda made, s: made.when(t.rlike(s[0]), F.regexp_replace(t, s[0], s[1])), whole[1:], F.when(t.rlike(whole[0][0]), F.regexp_replace(t, *whole[0])))
    return F.split(made, r"\|")


def _parse(parts: Column, t: Column, order: Column) -> Column:
    """Struct of the values of the parts. kind: y, ym, ymd, local (wall time), day, serial, instant (seconds)."""
    text = lambda k: F.get(parts, F.lit(k))
    number = lambda k: text(k).try_cast("int")
    shape = text(0)
    needs = shape.isin("dmy", "mixed")
    swapped = needs & (order != "mdy")
    year = F.when(needs & (number(1) < 100), 2000 + number(1)).otherwise(number(1))
    month_of = F.create_map(*[F.lit(x) for k, names in MONTHS.items() for n in names.split() for x in (n, k)])
    month = F.when(swapped, number(3)).when(text(2).rlike("^[a-z]"), F.try_element_at(month_of, text(2))).otherwise(number(2))
    day = F.when(swapped, number(2)).otherwise(number(3))
    known = ~needs | order.isin("mdy", "dmy")
    half, filled = text(7), lambda k: F.nullif(text(k), F.lit(""))
    hour = F.when(F.coalesce(half, F.lit("")) == "", number(4)).when(number(4).between(1, 12), number(4) % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    clock = filled(4).isNotNull()
    kind = F.when(shape.isin("local", "mixed", "named"), F.when(clock, "local").otherwise("ymd")).when(shape == "dmy", "ymd").when(shape.isin("seconds", "parts"), "instant").otherwise(shape)
    whole, real = t.try_cast("long"), t.try_cast("double")
    at = (
        F.when(shape == "day", F.when(whole.between(*SERIAL_DAYS), whole + EXCEL_EPOCH))
        .when(shape == "serial", F.when(real.between(*SERIAL_DAYS), F.floor((real + EXCEL_EPOCH) * 86400 + F.lit(1e-3))))
        .when(shape == "seconds", F.floor(real))
        .when(shape == "parts", F.coalesce(*[F.when(number(1) == n, idiv_exact(whole, 10**n)) for n in (3, 6, 9)]))
    )
    one = F.lit(1)
    return F.struct(
        kind.alias("kind"), F.when(known, year).alias("y"), F.when(shape == "y", one).otherwise(month).alias("m"), F.when(shape.isin("y", "ym"), one).otherwise(day).alias("d"),
        F.coalesce(hour, F.lit(0)).alias("h"), F.coalesce(number(5), F.lit(0)).alias("mi"), F.coalesce(number(6), F.lit(0)).alias("s"), filled(8).alias("zone"), needs.alias("needs"), at.cast("long").alias("at"),
    )


def idiv_exact(a: Column, b: int) -> Column:
    """Whole quotient of non-negative longs, without a detour over doubles."""
    return (a - a % F.lit(b).cast("long")).cast("decimal(20,0)") / F.lit(b).cast("decimal(20,0)")


def normalise_timestamps(df: DataFrame, text: str, zone: str | None = None, order: str | None = None, into: str = "normalised", zones: list[str] | None = None) -> DataFrame:
    """df with a column of the one form of its date texts.

    text, zone and order name columns: the text as typed, the IANA zone of times without one, and 'dmy' or 'mdy'.
    YYYY, YYYY-MM or YYYY-MM-DD come out as written; a time comes out as YYYY-MM-DDTHH:MM:SSZ in UTC, fractions dropped.
    A wall time that occurs twice is the earlier instant; a skipped one takes the offset in force before the change.
    Null: null, blank, placeholder and unreadable texts, impossible dates, spans, and texts that need a zone or an order
    where it is null or unknown. Years are 0001 to 9999. Rows, their other columns and repeats stay; a column named as the result is replaced.
    zones: the zones that may occur; by default the known ones of the zone column (the tz database bounds their number).
    """
    spark = df.sparkSession
    own = "__ts"
    while any(c.lower().startswith(own) for c in df.columns):
        own = "_" + own
    plain, shape, ts, zone_, year, like, spans_, secs_, at_, offset_, instant_ = (f"{own}_{k}" for k in ("plain", "shape", "parts", "zone", "year", "like", "spans", "secs", "at", "offset", "instant"))
    if zones is None:
        zones = [] if zone is None else known_zones(df, zone)
    null = F.lit(None).cast("string")
    # what is used more than once is a column of its own, so that the plan holds each expression once
    p = df.withColumn(plain, _plain(F.col(f"`{text}`"))).withColumn(shape, computed_once(_shape(F.col(plain))))
    p = p.withColumn(ts, computed_once(F.when(F.col(shape).isNotNull(), _parse(F.col(shape), F.col(plain), F.lower(F.trim(F.col(f"`{order}`"))) if order else null))))
    x = lambda k: F.col(f"{ts}.{k}")
    kind = x("kind")
    dated = kind.isin("y", "ym", "ymd", "local") & is_date(x("y"), x("m"), x("d"))
    timed = x("h").between(0, 23) & x("mi").between(0, 59) & x("s").between(0, 59)
    secs = F.when(dated & (kind == "local") & timed, days_from_civil(x("y"), x("m"), x("d")) * 86400 + x("h") * 3600 + x("mi") * 60 + x("s")).when(kind == "serial", x("at"))
    abbreviations = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    digits = F.regexp_replace(x("zone"), "[^0-9]", "")
    minutes = F.when(x("zone").rlike(r"^[+-]"), (digits.substr(1, 2).try_cast("int") * 60 + F.coalesce(digits.substr(3, 2).try_cast("int"), F.lit(0))) * F.when(x("zone").startswith("-"), -1).otherwise(1)).otherwise(F.try_element_at(abbreviations, x("zone")))
    minutes = F.when(minutes.between(-18 * 60, 18 * 60), minutes)
    local = x("zone").isNull()
    p = p.withColumn(secs_, computed_once(secs))
    p = p.withColumn(year, F.when(local & F.col(secs_).isNotNull(), F.year(F.date_from_unix_date(idiv(F.col(secs_), 86400).cast("int")))))
    # the optimizer follows join keys down to the scan, writing out all that they are made of; a generator is where it stops
    keys = F.struct((F.col(f"`{zone}`") if zone else null).alias(zone_), like_year(F.col(year)).alias(like))
    p = p.select("*", F.inline(F.array(keys)))
    table = interval_table(spark, zones).toDF(zone_, like, spans_)  # at most the tz database: some 600 zones of 329 years
    p = p.join(F.broadcast(table) if len(zones) <= 100 else table, [zone_, like], "left")
    L, spans = F.col(secs_), F.col(spans_)
    p = p.withColumn(at_, F.when(F.col(year) > LAST, L + (new_year(F.col(like)) - new_year(F.col(year))).cast("long") * 86400).otherwise(L))  # the same moment of the like year
    at = F.col(at_)
    holding = F.filter(spans, lambda v: (v.a <= at) & (at < v.b))
    before = F.filter(spans, lambda v: v.b <= at)
    offset = F.when(F.size(holding) > 0, F.array_max(F.transform(holding, lambda v: v.o))).otherwise(F.try_element_at(F.transform(before, lambda v: v.o), F.lit(-1)))
    p = p.withColumn(offset_, F.when(local & L.isNotNull(), offset))
    p = p.withColumn(instant_, F.when(kind == "instant", x("at")).when(local, L - F.col(offset_)).otherwise(L - minutes * 60))
    instant = F.col(instant_)
    y4 = F.lpad(x("y").cast("string"), 4, "0")
    m2, d2 = F.lpad(x("m").cast("string"), 2, "0"), F.lpad(x("d").cast("string"), 2, "0")
    value = (
        F.when(dated & (kind == "y"), y4)
        .when(dated & (kind == "ym"), F.concat(y4, F.lit("-"), m2))
        .when(dated & (kind == "ymd"), F.concat(y4, F.lit("-"), m2, F.lit("-"), d2))
        .when(kind == "day", date_text(x("at")))
        .when(kind.isin("instant", "serial", "local"), instant_text(instant))
    )
    if order:
        value = F.when(~(x("needs") & F.col(f"`{order}`").isNull()), value)
    return p.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != into.lower()], computed_once(value).alias(into))
