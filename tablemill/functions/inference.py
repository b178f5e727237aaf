"""Column types from text values, and common types of differing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegralType, LongType, NumericType, NullType, StringType

from tablemill.plans.scope import column

# Kinds of text, each with a bit and the shape of its values.
INTEGER, NUMBER, BOOLEAN, DATE, MOMENT, TEXT = 1, 2, 4, 8, 16, 32
SHAPES = (
    (INTEGER, r"^[+-]?\d{1,18}$"),
    (NUMBER, r"(?i)^[+-]?(\d{1,18}\.\d*|\d*\.\d+|\d{1,18})(e[+-]?\d+)?$"),
    (BOOLEAN, r"(?i)^(true|false)$"),
    (DATE, r"^\d{4}-\d{2}-\d{2}$"),
    (MOMENT, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"),
)
# The type for a set of kinds found in one column; any other set is text.
TYPES = {
    INTEGER: "bigint",
    NUMBER: "double",
    INTEGER | NUMBER: "double",
    BOOLEAN: "boolean",
    DATE: "date",
    MOMENT: "timestamp_ntz",
    DATE | MOMENT: "timestamp_ntz",
}


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each text column to the narrowest type that all its values fit.

    One aggregation collects the kinds of value in every column as bits. Whole numbers that
    do not fit a bigint keep all their digits as text.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not names:
        return df
    found = df.agg(*[F.bit_or(_kind(column(n))).alias(f"k{i}") for i, n in enumerate(names)]).first()
    types = {n: TYPES[found[i]] for i, n in enumerate(names) if found[i] in TYPES}
    return df.select([
        F.trim(column(n)).try_cast(types[n]).alias(n) if n in types else column(n) for n in df.columns
    ])


def _kind(col: Column) -> Column:
    text = F.trim(col)
    kind = F.when(col.isNull(), F.lit(None))
    for bit, shape in SHAPES:
        fits = text.rlike(shape)
        if bit in (DATE, MOMENT):
            fits = fits & text.try_cast(TYPES[bit]).isNotNull()
        kind = kind.when(fits, F.lit(bit))
    return kind.otherwise(F.lit(TEXT))


def wider(a: DataType, b: DataType) -> DataType:
    """The type both columns fit: bigint, double or, failing those, text."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return LongType()
    return DoubleType() if isinstance(a, NumericType) and isinstance(b, NumericType) else StringType()
