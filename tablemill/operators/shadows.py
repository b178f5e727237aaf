"""Typed shadows of text columns: what a filter would parse row by row, stored once beside the text.

A table whose dates and numbers are kept as text can't be pruned by them: a filter has to parse
every row. A shadow is an ordinary column with the parsed value, so a filter on the text can
read the shadow instead, which the Parquet scan compares with its statistics. The text stays
what is shown; shadows are not among a table's columns for a specification.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField

from tablemill.errors import SpecError
from tablemill.functions.casts import to_date, to_double
from tablemill.operators.filters import DATE_NAME
from tablemill.plans.scope import DAY, NUMBER, SHADOW, column


def with_shadows(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The frame with a shadow for each named text column, or for all whose name is date-like.

    Columns with a date-like name get the parsed day, all others the parsed number; text that
    is none has a null shadow. The column's metadata says what it is a shadow of, which is kept
    in Parquet files and tables.
    """
    known = {f.name.lower(): f for f in df.schema.fields}
    own = {str(f.metadata[SHADOW]).lower() for f in df.schema.fields if SHADOW in f.metadata}
    if names is None:
        wanted = [f for f in df.schema.fields if isinstance(f.dataType, StringType) and DATE_NAME.search(f.name)]
    else:
        wanted = [_text_column(name, known) for name in names]
    added = []
    for field in wanted:
        if field.name.lower() not in own:
            kind = DAY if DATE_NAME.search(field.name) else NUMBER
            value = to_date(column(field.name)) if kind == DAY else to_double(column(field.name), field.dataType)
            name = f"{field.name}__{kind}"
            while name.lower() in known:
                name += "_"
            added.append(value.alias(name, metadata={SHADOW: field.name, "kind": kind}))
    return df.select("*", *added)


def _text_column(name: str, known: dict[str, StructField]) -> StructField:
    field = known.get(name.lower())
    if field is None or not isinstance(field.dataType, StringType):
        raise SpecError(f"A shadow needs a text column; {name!r} is none.")
    return field
