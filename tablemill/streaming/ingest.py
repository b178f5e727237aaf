"""Incremental pick-up of files that arrive in a landing folder."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tablemill.errors import SpecError
from tablemill.functions.months import label_of_previous
from tablemill.plans.scope import column
from tablemill.sources.delimited import file_label, scan, scan_groups, union_by_name
from tablemill.sources.files import as_files

FORMATS = ("csv", "parquet")
#: Partition column of the datasets that ingest_by_name writes: the batch a row came with.
BATCH = "ingest_batch"
_FILE = "path string, modificationTime timestamp, length long, content binary"


def expand_path(template: str, as_of: dt.date, profile: str = "") -> str:
    """Fill ``{DATE}`` (ddmmyyyy), ``{MONTH}`` (month before, MON_YYYY) and ``{PROFILE}``."""
    values = {"DATE": f"{as_of:%d%m%Y}", "MONTH": label_of_previous(as_of), "PROFILE": profile}

    def fill(match: re.Match[str]) -> str:
        if match[1] not in values:
            raise SpecError(f"Unknown token {match[0]}; use {{DATE}}, {{MONTH}} or {{PROFILE}}.")
        return values[match[1]]

    return re.sub(r"\{([^{}]*)\}", fill, template)


def landing_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    file_format: str = "csv",
    pattern: str | None = None,
    files_per_batch: int | None = None,
    filename: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Files below a folder as a stream; each file is seen once per checkpoint.

    ``multi_line`` keeps quoted line breaks inside their record; turn it off to split large
    CSV files that have none. A CSV header must name the columns of ``schema`` in their order;
    ``ingest_by_name`` takes any order.
    """
    if file_format not in FORMATS:
        raise SpecError(f"Landing files are {' or '.join(FORMATS)}; got {file_format!r}.")
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if file_format == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
        # Spark matches CSV columns by position: a header in another order is refused.
        reader = reader.option("enforceSchema", False)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.format(file_format).load(folder)
    return df.select("*", file_label().alias("filename")) if filename else df


def ingest(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    compression: str = "zstd",
    partition_by: tuple[str, ...] = (),
    **options,
) -> StreamingQuery:
    """Append all files not yet converted to a Parquet dataset, then stop.

    The checkpoint records the files taken and the sink's log records the files written,
    so a run that fails half-way is completed, not repeated, by the next one.
    """
    rows = landing_stream(spark, folder, schema, **options)
    if transform is not None:
        rows = transform(rows)
    writer = rows.writeStream.format("parquet").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return query


def ingest_by_name(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    schema: StructType | str,
    pattern: str | None = None,
    files_per_batch: int | None = None,
    compression: str = "zstd",
) -> StreamingQuery:
    """Append all CSV files not yet converted, their columns matched by header name, then stop.

    Columns of ``schema`` that a file lacks are null, its other columns are left out. Only
    the paths of new files come to the driver. Each batch is one partition of the dataset
    (``ingest_batch``) and replaces that partition if it is run again, so a run that fails
    half-way is completed by the next one without repeating rows.
    """
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        paths = [re.sub("^file:/+", "/", r["path"]) for r in batch.select("path").distinct().toLocalIterator()]
        groups = scan_groups(session, as_files(sorted(paths))) if paths else []
        if not groups:
            return
        rows = union_by_name([scan(session, group, filename=False, schema=kinds) for group in groups])
        known = {name.lower() for name in rows.columns}
        cells = [(column(f.name) if f.name.lower() in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds]
        writer = rows.select(*cells, F.lit(number).alias(BATCH)).write.mode("overwrite").partitionBy(BATCH)
        writer.option("partitionOverwriteMode", "dynamic").option("compression", compression).parquet(target)

    query = (
        reader.load(folder).select("path").writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
