"""Parquet file sets and conversion to Parquet."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs, parquet
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablemill.errors import SpecError
from tablemill.functions.inference import wider
from tablemill.operators.shadows import with_shadows
from tablemill.plans.scope import column
from tablemill.sources.delimited import infer_schema, scan, scan_groups, union_by_name
from tablemill.sources.files import InputFile, as_files, clean_path, file_system, literal_path
from tablemill.sources.heads import open_binary, path_frame, record_batch

# Parquet codecs offered, and those of them that Spark ships without.
CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4", "brotli")
MISSING_CODECS = ("brotli",)
DEFAULT_CODEC = "zstd"
SOURCE_COLUMN = "source_file"
# Below the output: the names of the sources that are in it, written when they are. Readers pass over it.
FINISHED = "_finished"
# The ending dropped from a source name: the last one, and a .gz after it.
SOURCE_ENDING = r"(\.[^./]*)?(\.[gG][zZ])?$"


def read_parquet_set(spark: SparkSession, source: str | list[str] | list[InputFile]) -> DataFrame:
    """Union of Parquet files by column name.

    Files whose types clash are read in groups of equal schema and widened: whole numbers
    to bigint, numbers to double, anything else to text.
    """
    files = as_files(source)
    try:
        return spark.read.option("mergeSchema", True).parquet(*[f.literal for f in files])
    except (PySparkException, Py4JJavaError) as exc:
        if "CANNOT_MERGE" not in str(exc):
            raise
    groups: dict[str, list[str]] = defaultdict(list)
    for row in footers(spark, files).orderBy("path").toLocalIterator():
        groups[row["schema"]].append(literal_path(row["path"]))
    frames = [spark.read.parquet(*members) for members in groups.values()]
    wide: dict[str, DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            wide[f.name] = wider(wide.get(f.name, f.dataType), f.dataType)
    return union_by_name([
        df.select([column(f.name).cast(wide[f.name]).alias(f.name) for f in df.schema.fields]) for df in frames
    ])


def footers(spark: SparkSession, files: list[InputFile]) -> DataFrame:
    """Schema text of every file, read from its footer inside a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with open_binary(path) as stream:
                    found.append((path, parquet.read_schema(stream).remove_metadata().to_string()))
            yield record_batch({"path": pa.string(), "schema": pa.string()}, found)

    return path_frame(spark, files).mapInArrow(read, "path string, schema string")


@dataclass(frozen=True)
class Converted:
    """Outcome of a conversion."""

    output_path: str
    total_files: int
    skipped_files: int
    rows: int


def check_codec(name: str) -> str:
    codec = (name or "").strip().lower()
    if codec not in CODECS:
        raise SpecError(f"Unknown compression {name!r}; use one of {', '.join(CODECS)}.")
    if codec in MISSING_CODECS:
        raise SpecError(f"Spark ships without the {codec} codec; use zstd, gzip, snappy, lz4 or uncompressed.")
    return codec


def target_name(relative: str) -> str:
    """Name of a converted source: its relative path with the CSV ending replaced."""
    return re.sub(SOURCE_ENDING, "", relative) + ".parquet"


def csv_to_parquet(
    spark: SparkSession,
    source: str | list[str],
    output: str,
    compression: str = DEFAULT_CODEC,
    typed: bool = False,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    shadows: Iterable[str] | None = None,
) -> Converted:
    """Convert CSV files to Parquet in one job over all files.

    The output is a dataset partitioned by ``source_file``, the relative path of each
    source with a ``.parquet`` ending, so folders are kept and readers can prune by
    source. Sources that a run has finished are skipped, as are files without rows. What a
    run left that died before is replaced, as it is not recorded as finished.
    A single file with an output path that ends in ``.parquet`` becomes that dataset.
    ``transform`` is applied before the write, for the monthly cleaning. ``shadows`` names text
    columns whose parsed dates or numbers are stored beside them, for filters to be pruned by.
    """
    codec = check_codec(compression)
    files = as_files(source)
    output = clean_path(output).rstrip("/")
    single = len(files) == 1 and output.lower().endswith(".parquet")
    if output.lower().endswith(".parquet") and not single:
        output = output.rpartition("/")[0]
    done = finished_sources(output)
    if single and system_kind(f"{output}/_SUCCESS") == fs.FileType.File:
        done = {target_name(files[0].relative)}
    waiting = [f for f in files if (not single or not done) and target_name(f.relative) not in done]
    groups = scan_groups(spark, waiting) if waiting else []
    read = {path for group in groups for path in group.paths}
    skipped = len(files) - len(read)
    if not groups:
        return Converted(output, len(files), skipped, 0)
    schema = infer_schema(spark, groups) if typed else None
    rows = union_by_name([scan(spark, group, schema=schema) for group in groups])
    if transform is not None:
        rows = transform(rows)
    if shadows is not None:
        rows = with_shadows(rows, shadows)
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if single:
        if system_kind(output) == fs.FileType.File:
            raise SpecError(f"{output!r} is a file; name a folder that ends in .parquet.")
        rows.write.mode("overwrite").option("compression", codec).parquet(output)
    else:
        labelled = rows.withColumn(SOURCE_COLUMN, _source_label(waiting, "filename")).drop("filename")
        replaced = labelled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replaced.option("compression", codec).partitionBy(SOURCE_COLUMN).parquet(output)
    record_finished(output, [target_name(f.relative) for f in waiting if f.path in read])
    return Converted(output, len(files), skipped, seen.get["rows"])


def _source_label(files: list[InputFile], path_column: str) -> Column:
    """Target name of a row's file: its path below the input root it was listed under."""
    roots = sorted({f.path[: len(f.path) - len(f.relative)] for f in files}, key=len, reverse=True)
    path = F.col(path_column)
    below = F.coalesce(*[
        F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))) for root in roots
    ])
    return F.concat(F.regexp_replace(below, SOURCE_ENDING, ""), F.lit(".parquet"))


def system_kind(path: str) -> fs.FileType:
    system, inner, _ = file_system(path)
    return system.get_file_info(inner).type


def record_finished(output: str, names: list[str]) -> None:
    """Record sources as finished, in one file per run, after their rows are committed."""
    system, inner, _ = file_system(output)
    system.create_dir(f"{inner}/{FINISHED}")
    with system.open_output_stream(f"{inner}/{FINISHED}/{uuid.uuid4().hex}") as sink:
        sink.write("".join(f"{name}\n" for name in names).encode())


def finished_sources(output: str) -> set[str]:
    """Sources that earlier runs have recorded below ``output``."""
    system, inner, _ = file_system(output)
    if system.get_file_info(f"{inner}/{FINISHED}").type != fs.FileType.Directory:
        return set()
    found: set[str] = set()
    for record in system.get_file_info(fs.FileSelector(f"{inner}/{FINISHED}")):
        with system.open_input_stream(record.path) as stream:
            found.update(stream.read().decode().splitlines())
    return found
