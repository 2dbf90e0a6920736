"""Tables and registration shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayflow.workspace import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with their oracle SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} exists")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_label(c: str) -> str:
    """SQL for text.label_key, for labels of ASCII letters and digits."""
    from assayflow.text import PLACEHOLDERS

    blank = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    return f"case when lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) not in ({blank}) then regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') end"


def sql_hash(text: str) -> str:
    """SQL for resample.hash_number of one text."""
    return f"('0x' || substr(sha256({text}), 1, 8))::ubigint::bigint"
