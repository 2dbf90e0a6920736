"""What a row measures: type and unit of a measurement, record ids, agreement of texts, of categories and of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.sources.sinks import row_digest
from assayflow.text import clean, normalised

# Units of the two types of measurement.
UNITS = {"MIC": "mg/L", "ZONE": "mm"}


def measurement_type(mic: Column, zone: Column) -> Column:
    """Struct (type, value, unit, raw) of a row with a column for each type: MIC or ZONE where exactly one of the texts is a number, null
    where none or both are. value is the MIC where it is a number, otherwise the zone; raw is the text of the MIC where it is filled."""
    m, z = clean(mic).try_cast("double"), clean(zone).try_cast("double")
    kind = F.when(m.isNotNull() & z.isNull(), "MIC").when(z.isNotNull() & m.isNull(), "ZONE")
    unit = F.when(kind == "MIC", UNITS["MIC"]).when(kind == "ZONE", UNITS["ZONE"])
    return F.struct(kind.alias("type"), F.coalesce(m, z).alias("value"), unit.alias("unit"), F.coalesce(clean(mic), clean(zone)).alias("raw"))


def only_measurement(mic: Column, zone: Column) -> Column:
    """Struct (type, raw, unit) by filled texts, numbers or not: null throughout where both or none are filled."""
    m, z = F.nullif(F.trim(mic), F.lit("")), F.nullif(F.trim(zone), F.lit(""))
    kind = F.when(m.isNotNull() & z.isNull(), "MIC").when(z.isNotNull() & m.isNull(), "ZONE")
    return F.struct(kind.alias("type"), F.when(kind.isNotNull(), F.coalesce(m, z)).alias("raw"), F.when(kind == "MIC", UNITS["MIC"]).when(kind == "ZONE", UNITS["ZONE"]).alias("unit"))


def record_id(df: DataFrame, native: str, columns: list[str], prefix: str = "sha256-") -> Column:
    """Struct (id, origin): the native id where it is filled, otherwise the prefix and the digest of the row's columns."""
    own = clean(F.col(native))
    return F.struct(F.coalesce(own, F.concat(F.lit(prefix), row_digest(df, columns))).alias("id"), F.when(own.isNotNull(), "native").otherwise("digest").alias("origin"))


def concordance(submitted: Column, interpreted: Column) -> Column:
    """NOT_REPORTED where no category was submitted, otherwise whether it is the interpreted one, case and blanks aside."""
    return F.when(clean(submitted).isNull(), "NOT_REPORTED").when(F.upper(clean(submitted)).eqNullSafe(interpreted), "CONCORDANT").otherwise("DISCORDANT")


def decimal_equal(a: Column, b: Column) -> Column:
    """Whether two texts are the same decimal number; false where one is none."""
    n = lambda c: F.trim(c).try_cast("decimal(38,18)")
    return F.coalesce(n(a) == n(b), F.lit(False))


def same_when_present(parent: Column, source: Column) -> Column:
    """'not_asserted' where the parent says nothing, otherwise 'true' or 'false': the same text, case and blanks aside."""
    return F.when(clean(parent).isNull(), "not_asserted").when(normalised(parent) == F.coalesce(normalised(source), F.lit("")), "true").otherwise("false")
