"""Computed columns: aggregates, CASE and COALESCE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from tablemill.errors import SpecError
from tablemill.functions.casts import to_double, to_text
from tablemill.operators.filters import compile_filter
from tablemill.plans.scope import Scope
from tablemill.plans.spec import CaseColumn, FunctionColumn

_AGGREGATE = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


def aggregate(func: str, col: Column, dtype: DataType) -> Column:
    """SUM, AVG, MIN, MAX or COUNT. SUM and AVG read text as numbers."""
    if func in ("SUM", "AVG") and isinstance(dtype, StringType):
        col = to_double(col, dtype)
    return _AGGREGATE[func](col)


def aggregate_of(func: str, column_text: str, scope: Scope) -> Column:
    """An aggregate of a referenced column, or COUNT over all rows for ``*``."""
    if column_text.strip() == "*":
        if func != "COUNT":
            raise SpecError(f"{func} needs a column; only COUNT takes '*'.")
        return F.count(F.lit(1))
    ref = scope.resolve(column_text)
    if func == "COUNT_DISTINCT":
        return F.count_distinct(ref.expr)
    return aggregate(func, ref.expr, ref.dtype)


def coalesce_of(spec: FunctionColumn, scope: Scope) -> Column:
    first = scope.resolve(spec.column)
    if not spec.second_column:
        return first.expr
    second = scope.resolve(spec.second_column)
    if first.dtype != second.dtype and StringType() in (first.dtype, second.dtype):
        return F.coalesce(to_text(first.expr, first.dtype), to_text(second.expr, second.dtype))
    return F.coalesce(first.expr, second.expr)


def case_of(spec: CaseColumn, scope: Scope) -> Column | None:
    """A CASE column, aggregated if asked; None when no branch names a column."""
    branches = [b for b in spec.branches if b.column.strip()]
    if not branches:
        return None
    conditions = [compile_filter(b, scope) for b in branches]
    results = [_result(b.then_type, b.then_value, scope) for b in branches]
    results.append(_result(spec.else_type, spec.else_value, scope))
    if spec.aggregate_func:
        results = [(to_double(col, dtype), dtype) for col, dtype in results]
    elif any(isinstance(dtype, StringType) for _, dtype in results):
        results = [(to_text(col, dtype), dtype) for col, dtype in results]
    values = [col for col, _ in results]
    chain = F.when(conditions[0], values[0])
    for test, value in zip(conditions[1:], values[1:-1]):
        chain = chain.when(test, value)
    chain = chain.otherwise(values[-1])
    return _AGGREGATE[spec.aggregate_func](chain) if spec.aggregate_func else chain


def _result(kind: str, value: object, scope: Scope) -> tuple[Column, DataType]:
    if kind == "column":
        ref = scope.resolve(str(value))
        return ref.expr, ref.dtype
    return F.lit(None if value is None else str(value)), StringType()
