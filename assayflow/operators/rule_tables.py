"""Checks of tables that steer a job: rules, plans, configurations. Each gives its violations as rows or refuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.operators.contracts import ContractError
from assayflow.text import clean


def rule_violations(rules: DataFrame, rule_id: str, required: Sequence[str], kind: str, low: str, high: str, digest: str | None = None, expected: str | None = None) -> DataFrame:
    """(rule_id, violation) of a table of rules with two thresholds, each violation once.

    missing_id, duplicate_id, missing_<column>, unknown_type (neither MIC nor ZONE), bad_threshold (no number), crossed_thresholds (a MIC's
    low above its high, a zone's below) and other_artifact (the row's digest is not the expected one). An empty table gives 'no_rules'.
    """
    number = lambda c: F.trim(F.col(c).cast("string")).try_cast("decimal(38,12)")
    blank = lambda c: clean(F.col(c).cast("string")).isNull()
    t = F.upper(F.trim(F.col(kind)))
    lo, hi = number(low), number(high)
    tests = {"missing_id": blank(rule_id), **{f"missing_{c}": blank(c) for c in required}, "unknown_type": ~F.coalesce(t.isin("MIC", "ZONE"), F.lit(False)), "bad_threshold": lo.isNull() | hi.isNull(), "crossed_thresholds": ((t == "MIC") & (hi < lo)) | ((t == "ZONE") & (lo < hi))}
    if digest is not None:
        tests["other_artifact"] = ~F.lower(F.trim(F.col(digest))).eqNullSafe(F.lit(expected))
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests.items()]))
    rows = rules.select(F.col(rule_id).cast("string").alias("rule_id"), F.explode(found).alias("violation"))
    twice = rules.where(~blank(rule_id)).groupBy(F.trim(F.col(rule_id).cast("string")).alias("rule_id")).agg(F.count("*").alias("n")).where("n > 1").select("rule_id", F.lit("duplicate_id").alias("violation"))
    none = rules.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("rule_id"), F.lit("no_rules").alias("violation"))
    return rows.unionByName(twice).unionByName(none).distinct()


def constraints(rules: DataFrame, optional: Sequence[str]) -> Column:
    """Map of a rule's optional constraints, blank ones left out."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), clean(F.col(c).cast("string")).alias("value")) for c in optional]), lambda x: x.value.isNotNull())
    return F.map_from_entries(pairs)


def require_order(plan: Mapping[str, float], order: Sequence[str], least: float, most: float) -> None:
    """Refuse thresholds that are missing, no numbers, outside [least, most], or not in ascending order."""
    values = []
    for name in order:
        value = plan.get(name)
        if isinstance(value, bool) or not isinstance(value, int | float) or not least <= value <= most:
            raise ContractError(f"{name} must be a number from {least} to {most}, not {value!r}")
        values.append(value)
    if values != sorted(values):
        raise ContractError(f"{' <= '.join(order)} does not hold: {values}")


def set_differences(df: DataFrame, column: str, wanted: Sequence[str], label: str) -> DataFrame:
    """(label, value, issue): values of a column that a configuration lacks ('unexpected'), and its own that the column lacks ('absent')."""
    have = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    want = df.sparkSession.createDataFrame([(v,) for v in sorted(set(wanted))], "value string")
    extra = have.join(F.broadcast(want), "value", "left_anti").withColumn("issue", F.lit("unexpected"))
    gone = want.join(have, "value", "left_anti").withColumn("issue", F.lit("absent"))
    return extra.unionByName(gone).select(F.lit(label).alias("label"), "value", "issue")


def lacks_values(df: DataFrame, keys: Sequence[str], column: str, wanted: Sequence[str]) -> DataFrame:
    """(keys, missing): groups whose values don't hold all the wanted ones, with those that are missing, sorted and joined."""
    has = [F.max((F.col(column) == v).cast("int")).alias(f"h{i}") for i, v in enumerate(wanted)]
    g = df.groupBy(*keys).agg(*has)
    gone = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"h{i}"), F.lit(0)) == 0, F.lit(v)) for i, v in sorted(enumerate(wanted), key=lambda x: x[1])]))
    return g.withColumn("missing", F.array_join(gone, ";")).where("missing <> ''").select(*keys, "missing")


def rederived(df: DataFrame, key: str, recomputed: Mapping[str, Column]) -> DataFrame:
    """(key, field, stored, derived): fields whose stored value is not what its expression gives; null equals null only."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stored"), c.cast("string").alias("derived")) for f, c in recomputed.items()])
    return df.select(key, F.explode(fields).alias("r")).select(key, "r.field", "r.stored", "r.derived").where(~F.col("stored").eqNullSafe(F.col("derived")))
