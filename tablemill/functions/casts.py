"""Tolerant casts: a value that does not fit becomes null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

# Java number syntax that is not a plain decimal: a trailing type letter, as in "12d".
JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"

# Date layouts accepted in text besides ISO dates (with or without a time), each
# with the shape of the text it is tried on.
DATE_LAYOUTS = (
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{4,}-\d{4}$", "d-MMMM-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)
_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}.*)?$"


def to_double(col: Column, dtype: DataType) -> Column:
    """TRY_CAST to double. Text is trimmed; blank or non-numeric text gives null."""
    if isinstance(dtype, (NumericType, BooleanType)):
        return col.cast("double")
    text = col if isinstance(dtype, StringType) else col.cast("string")
    return F.when(~text.rlike(JAVA_SUFFIX), text.try_cast("double"))


def to_text(col: Column, dtype: DataType | None = None) -> Column:
    return col if isinstance(dtype, StringType) else col.cast("string")


def to_date(col: Column) -> Column:
    """Parse text as a date in any accepted layout; null if none fits.

    Each layout is tried only on text of its shape: a parser that is run on text of another
    layout fails with an exception per row.
    """
    text = F.trim(col.cast("string"))
    parsed = F.when(text.rlike(_ISO_DATE), text.try_cast("date"))
    for shape, layout in DATE_LAYOUTS:
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)).cast("date"))
    return parsed


def shown(col: Column) -> Column:
    """Text for display, with null spelled out."""
    return F.coalesce(col.cast("string"), F.lit("(null)"))


def as_number(value: object) -> float | None:
    """The numeric reading of a specification value, or None if it has none."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str):
        try:
            return float(value)
        except ValueError:
            return None
    return None
