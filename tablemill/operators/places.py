"""Where rows are stored: addresses that stay the same however a plan is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType


def _stored_fields(df: DataFrame) -> str:
    """What a frame's source can tell about where its rows are stored, as a type; empty for other frames.

    That is known of the scan of files and what filters and projects it, not of joins or groups.
    """
    if "_metadata" in {c.lower() for c in df.columns}:
        return ""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    told = [hidden.apply(i) for i in range(hidden.size())]
    told = [a.dataType().simpleString(10_000) for a in told if a.name() == "_metadata"]
    return told[0] if len(told) == 1 else ""


def with_address(df: DataFrame, file: str, row: str) -> DataFrame | None:
    """The frame with a number for each row's file and its place in that file.

    Only rows of Parquet files have such an address, also behind filters and projections. It
    is part of the scan, so filters are pushed down as before. None for all other frames.
    """
    if "row_index" not in _stored_fields(df):
        return None
    return df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def reading_order(df: DataFrame) -> list[Column]:
    """Columns that order rows as they are read, by file name and by place in the file.

    Exact for Parquet rows. Rows of other files are numbered task by task within their file and
    block, which holds as long as they weren't shuffled before; all other rows have the order of
    their partitions.
    """
    told = _stored_fields(df)
    if "row_index" in told:
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    blocks = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if "file_block_start" in told else []
    return [*blocks, F.monotonically_increasing_id()]


def _hashable(kind) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    kind = getattr(kind, "elementType", kind)
    return _hashable(kind) if isinstance(kind, StructType) else not isinstance(kind, (MapType, VariantType))


def content_order(df: DataFrame, names: list[str]) -> list[Column]:
    """Two hashes over columns: rows in which they agree are equal for all that these columns show."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    usable = [F.col(f"`{n.replace('`', '``')}`") for n in names if _hashable(kinds[n]) and df.columns.count(n) == 1]
    return [F.xxhash64(*usable), F.hash(*usable)] if usable else [F.lit(0).cast("long"), F.lit(0)]
