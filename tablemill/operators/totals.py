"""Grand-total row of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField

from tablemill.operators.paging import ordering
from tablemill.plans.scope import column

# Text of the total row and the column that carries it when present.
TOTAL_LABEL = "GRAND TOTAL"
TOTAL_COLUMN = "DISCOM"


def with_grand_total(
    df: DataFrame, label_column: str = TOTAL_COLUMN, order_by: Sequence[str] = (), keep_order: bool = True
) -> DataFrame:
    """Append one row that sums every numeric column of the shown rows.

    The label goes into ``label_column`` or else the first column, unless that column is
    numeric and is summed itself. Any other column shows its value if all rows agree on
    it, and otherwise a blank (null where the type has no blank). An empty frame, or one
    without numeric columns, comes back unchanged. The total row sorts last, the others by
    ``order_by`` or else, with ``keep_order``, as they came; without either nothing is sorted.
    A row number behind the keys lets rows with equal keys be spread over many ranges.
    """
    fields = df.schema.fields
    if not any(isinstance(f.dataType, NumericType) for f in fields):
        return df
    label = next((i for i, f in enumerate(fields) if f.name.upper() == label_column.upper()), 0)
    names = [f"__c{i}" for i in range(len(fields))]
    keys = [names[[f.name for f in fields].index(k)] for k in order_by]
    rows = df.toDF(*names)
    if not isinstance(fields[label].dataType, (NumericType, StringType)):
        rows = rows.withColumn(names[label], column(names[label]).cast("string"))
    cells = [_total_cell(name, f, i == label).alias(name) for i, (name, f) in enumerate(zip(names, fields))]
    total = rows.agg(F.count(F.lit(1)).alias("__rows"), *cells).filter("__rows > 0").drop("__rows")
    place = F.monotonically_increasing_id()
    stacked = rows.withColumns({"__total": F.lit(0), "__row": place}).union(total.withColumns({"__total": F.lit(1), "__row": place}))
    if keys or keep_order:
        stacked = stacked.orderBy("__total", *[ordering(column(k), "ASC") for k in keys], "__row")
    return stacked.drop("__total", "__row").toDF(*[f.name for f in fields])


def _total_cell(name: str, field: StructField, is_label: bool) -> Column:
    col = column(name)
    if isinstance(field.dataType, NumericType):
        return F.sum(col)
    if is_label:
        return F.first(F.lit(TOTAL_LABEL))
    if isinstance(field.dataType, StringType):
        filled = F.when(col != "", col)
        return F.when(F.min(filled) == F.max(filled), F.min(filled)).otherwise(F.lit(""))
    return F.when(F.min(col) == F.max(col), F.min(col))
