"""All queries of the core."""

from __future__ import annotations

from assayflow.plans import measures, tables, timestamps, typing

REGISTRIES = [measures.registry, tables.registry, timestamps.registry, typing.registry]


def queries() -> dict:
    return {k: f for r in REGISTRIES for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in REGISTRIES for k, s in r.sql.items()}
