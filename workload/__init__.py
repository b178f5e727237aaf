"""Registered queries over the star-schema tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    """A query and the equivalent SQL on the same tables (None for a rows-only check)."""

    run: Query
    sql: str | None = None


_SCHEMAS: dict[str, StructType] = {}


def table_reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Tables of a data folder by name. A table's schema is inferred once, as a catalog would."""

    def read(name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        return spark.read.schema(_SCHEMAS[path]).parquet(path)

    return read


def all_cases() -> dict[str, Case]:
    from workload import families, files, lists, preparation, reports

    cases: dict[str, Case] = {}
    for module in (lists, reports, families, preparation, files):
        cases.update(module.CASES)
    return cases
