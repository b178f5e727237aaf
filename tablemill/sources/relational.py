"""Read-only access to a remote relational database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError
from tablemill.plans.sql import clean_sql, ensure_read_only


def jdbc_options(
    url: str,
    table_or_query: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Reader options. A query must pass the read-only check.

    With a partition column, its bounds and a number of partitions the rows are read by
    that many parallel range queries; rows outside the bounds are still read.
    """
    text = table_or_query.strip()
    if not url.startswith("jdbc:") or not text:
        raise SpecError("A JDBC URL and a table or query are needed.")
    options = {"url": url, "fetchsize": "10000", **(properties or {})}
    if " " in text or "\n" in text:
        text = clean_sql(text)
        ensure_read_only(text)
        text = f"({text}) q"
    options["dbtable"] = text
    split = (partition_column, bounds, partitions)
    if any(split):
        if not all(split):
            raise SpecError("A parallel read needs a partition column, its bounds and a number of partitions.")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, **options) -> DataFrame:
    """Remote table or query as a frame; filters, columns and limits are pushed down by Spark."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table_or_query, **options)).load()
