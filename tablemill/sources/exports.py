"""Writing results: CSV and one-time samples."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import SpecError

# Sample size and the words that mark a representative table.
SAMPLE_ROWS = 1000
MASTER_WORD = "MASTER"
PREFERRED_REGION = "DVVNL"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; null and empty text are both written as nothing."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result export: every cell quoted, quotes doubled, null as an empty cell."""
    text = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    (
        text.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def representative(names: Sequence[str], preferred: str = PREFERRED_REGION) -> str:
    """The object to sample: a master of the preferred region, any master, or the first."""
    given = [n.strip() for n in names if n and n.strip()]
    if not given:
        raise SpecError("There is no table to sample.")
    masters = sorted(n for n in given if MASTER_WORD in n.upper())
    regional = [n for n in masters if preferred.upper() in n.upper()]
    return (regional or masters or given)[0]


def first_table(spark: SparkSession) -> str:
    """The first base table by name, or the first view when there is no table."""
    listed = spark.catalog.listTables()
    if not listed:
        raise SpecError("There is no table to sample.")
    return min(listed, key=lambda t: (t.tableType in ("VIEW", "TEMPORARY"), t.name)).name


def slug(text: str) -> str:
    """A file-name-safe form of a label."""
    return re.sub(r"[^\w-]", "_", text.strip()).strip("_") or "default"


def sample_once(df: DataFrame, path: str, source: str = "", rows: int = SAMPLE_ROWS) -> bool:
    """Write up to ``rows`` rows and a metadata record; an existing sample is left alone.

    Returns whether a sample was written.
    """
    from tablemill.sources.files import is_folder

    folder = path.rstrip("/")
    if is_folder(folder):
        return False
    sample = df.limit(rows)
    sample.write.mode("ignore").option("header", True).option("escape", '"').csv(f"{folder}/rows")
    saved = df.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True)
    meta = {
        "created_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(),
        "source_table": source,
        "row_limit": rows,
        "rows_saved": saved.csv(f"{folder}/rows").count(),
    }
    record = df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string")
    record.coalesce(1).write.mode("ignore").text(f"{folder}/meta")
    return True
