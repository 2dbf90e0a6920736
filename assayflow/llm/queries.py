"""All queries of the subpackage."""

from __future__ import annotations

import importlib

MODULES = ["q_groups", "q_records", "q_places", "q_matching", "q_tokens", "q_leaks", "q_language"]
REGISTRIES = [importlib.import_module(f"assayflow.llm.{m}").registry for m in MODULES]


def queries() -> dict:
    return {k: f for r in REGISTRIES for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in REGISTRIES for k, s in r.sql.items()}
