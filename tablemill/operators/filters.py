"""Filter conditions to boolean columns.

Wherever the column already has the right type, the condition compares the bare column
with a literal of that type, so it reaches the Parquet scan as a pushed filter. Only text
columns that are compared as numbers or dates go through a tolerant cast.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
import re
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FractionalType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tablemill.errors import SpecError
from tablemill.functions.casts import as_number, to_date, to_double, to_text
from tablemill.plans.scope import Scope
from tablemill.plans.spec import COMPARISONS, EQUALITY, LISTS, NULL_TESTS, PATTERNS, RANGES, TEXT_TESTS
from tablemill.plans.spec import Branch, Filter

# Fixed value: a column whose name holds one of these words is filtered as a date.
DATE_NAME = re.compile(r"DATE|TIME|TIMESTAMP", re.IGNORECASE)

_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}
_TIMESTAMPS = (TimestampType, TimestampNTZType)


def column_family(dtype: DataType, name: str = "") -> str:
    """One of text, number, date, boolean, other; the column name may force ``date``."""
    if DATE_NAME.search(name) or isinstance(dtype, (DateType, *_TIMESTAMPS)):
        return "date"
    if isinstance(dtype, StringType):
        return "text"
    if isinstance(dtype, NumericType):
        return "number"
    return "boolean" if isinstance(dtype, BooleanType) else "other"


def operators_for(dtype: DataType, name: str = "") -> tuple[str, ...]:
    """Operators offered for a column of this type and name."""
    common = EQUALITY + NULL_TESTS
    family = column_family(dtype, name)
    if family == "text":
        return common + TEXT_TESTS + PATTERNS + LISTS
    if family == "boolean":
        return common + LISTS
    return common + COMPARISONS + RANGES + LISTS


def check_operator(flt: Filter, dtype: DataType, name: str) -> None:
    """Refuse an operator outside the column's family list."""
    allowed = operators_for(dtype, name)
    if flt.operator not in allowed:
        raise SpecError(f"{flt.operator} is not offered for column {name!r}; use one of {', '.join(allowed)}.")


def compile_filters(filters: tuple[Filter, ...], scope: Scope) -> Column | None:
    """All conditions joined by AND; None when there are none."""
    conditions = [compile_filter(f, scope) for f in filters]
    return reduce(operator.and_, conditions) if conditions else None


def compile_filter(flt: Filter | Branch, scope: Scope) -> Column:
    ref = scope.resolve(flt.column)
    return condition(ref.expr, ref.dtype, ref.name, flt.operator, flt.value, ref.day, ref.number)


def condition(
    col: Column, dtype: DataType, name: str, op: str, value: Any, day: Column | None = None, number: Column | None = None
) -> Column:
    """A single condition on a column of known type and name.

    ``day`` and ``number`` are columns with the parsed values of a text column, where those are
    stored; comparisons that would parse the text use them, and the scan can be pruned by them.
    """
    if op in NULL_TESTS:
        return col.isNull() if op == "IS NULL" else col.isNotNull()
    if op in TEXT_TESTS:
        return _text_test(to_text(col, dtype), op, str(value))
    if DATE_NAME.search(name):
        return _date_condition(col, dtype, op, value) if day is None else _date_condition(day, DateType(), op, value)
    if op in LISTS:
        found = col.isin([typed_literal(v, dtype, name) for v in list_values(op, value)])
        return found if op == "IN" else ~found
    if op in RANGES:
        bounds = range_values(value)
        parsed = number is not None and all(as_number(b) is not None for b in bounds)
        inside = _between(number, DoubleType(), name, *bounds) if parsed else _between(col, dtype, name, *bounds)
        return inside if op == "BETWEEN" else ~inside
    if op in PATTERNS:
        matched = _like(to_text(col, dtype), "" if value is None else str(value))
        return matched if op == "LIKE" else ~matched
    if op in COMPARISONS and as_number(value) is not None:
        return _compare_number(col, dtype, name, op, value) if number is None else _compare_number(number, DoubleType(), name, op, value)
    return _COMPARE[op](col, typed_literal(value, dtype, name))


def list_values(op: str, value: Any) -> list[Any]:
    """Items of a list value: a sequence, or text separated by commas; blanks are dropped."""
    if isinstance(value, str):
        items: list[Any] = [part.strip() for part in value.split(",")]
    elif isinstance(value, (list, tuple, set, frozenset)):
        items = list(value)
    else:
        items = [value]
    items = [item for item in items if item is not None and item != ""]
    if not items:
        raise SpecError(f"{op} needs at least one value.")
    return items


def range_values(value: Any) -> tuple[Any, Any]:
    """The two bounds of a range: a pair, or text with one comma."""
    bounds = [part.strip() for part in value.split(",")] if isinstance(value, str) else value
    if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
        raise SpecError("BETWEEN needs two values, as a pair or separated by one comma.")
    if isinstance(value, str) and not all(bounds):
        raise SpecError("BETWEEN needs two values, as a pair or separated by one comma.")
    return bounds[0], bounds[1]


def typed_literal(value: Any, dtype: DataType, name: str) -> Column:
    """A literal of the column's own type, so that ANSI comparison never casts the column."""
    if value is None:
        return F.lit(None).cast(dtype)
    try:
        return _literal(value, dtype)
    except (ValueError, InvalidOperation, TypeError) as exc:
        raise SpecError(f"Value {value!r} does not fit column {name!r} of type {dtype.simpleString()}.") from exc


def _literal(value: Any, dtype: DataType) -> Column:
    if isinstance(dtype, StringType):
        return F.lit(value.isoformat() if isinstance(value, (dt.date, dt.time)) else str(value))
    if isinstance(dtype, DecimalType):
        return F.lit(Decimal(str(value).strip()))
    if isinstance(dtype, IntegralType):
        number = Decimal(str(int(value)) if isinstance(value, bool) else str(value).strip())
        if not number.is_finite() or number != number.to_integral_value():
            return F.lit(float(number))
        return F.lit(int(number)) if abs(number) < 2**63 else F.lit(number)
    if isinstance(dtype, FractionalType):
        return F.lit(float(value))
    if isinstance(dtype, BooleanType):
        return F.lit(_as_bool(value))
    if isinstance(dtype, DateType):
        return F.lit(value.date() if isinstance(value, dt.datetime) else _as_date(value))
    if isinstance(dtype, _TIMESTAMPS):
        moment = value if isinstance(value, dt.date) else dt.datetime.fromisoformat(str(value).strip())
        return F.lit(moment.isoformat(sep=" ") if isinstance(moment, dt.datetime) else moment.isoformat()).cast(dtype)
    raise ValueError(dtype.simpleString())


def _as_bool(value: Any) -> bool:
    word = str(value).strip().lower()
    if word in ("true", "t", "1", "yes", "y"):
        return True
    if word in ("false", "f", "0", "no", "n"):
        return False
    raise ValueError(value)


def _as_date(value: Any) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value).strip())


def date_value(value: Any) -> dt.date:
    """A date written as ``YYYY-MM-DD`` (or a date object); anything else is refused."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value).strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            pass
    raise SpecError(f"Date filters take YYYY-MM-DD values; got {value!r}.")


def _text_test(text: Column, op: str, value: str) -> Column:
    if op == "STARTS WITH":
        return text.startswith(value)
    if op == "ENDS WITH":
        return text.endswith(value)
    return text.contains(value) if op == "CONTAINS" else ~text.contains(value)


def _like(text: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash in the pattern is an ordinary character."""
    unused = next(c for c in "\\!^~|#\x01\x02" if c not in pattern) if pattern else "\\"
    return F.like(text, F.lit(pattern), F.lit(unused))


def _compare_number(col: Column, dtype: DataType, name: str, op: str, value: Any) -> Column:
    compare = _COMPARE[op]
    number = as_number(value)
    if isinstance(dtype, IntegralType) and math.isfinite(number):
        exact = Decimal(str(value).strip()) if not isinstance(value, str) or "_" not in value else Decimal(number)
        bound = math.floor(exact) if op in (">", "<=") else math.ceil(exact)
        return compare(col, F.lit(bound) if abs(bound) < 2**63 else F.lit(number))
    if isinstance(dtype, DecimalType) and math.isfinite(number):
        return compare(col, F.lit(Decimal(str(value).strip())))
    if isinstance(dtype, FractionalType) and not isinstance(dtype, DecimalType):
        return compare(col, F.lit(number))
    if isinstance(dtype, (NumericType, StringType, BooleanType)):
        return compare(to_double(col, dtype), F.lit(number))
    raise SpecError(f"Column {name!r} of type {dtype.simpleString()} cannot be compared with the number {value!r}.")


def _between(col: Column, dtype: DataType, name: str, low: Any, high: Any) -> Column:
    if as_number(low) is not None and as_number(high) is not None:
        return _compare_number(col, dtype, name, ">=", low) & _compare_number(col, dtype, name, "<=", high)
    return (col >= typed_literal(low, dtype, name)) & (col <= typed_literal(high, dtype, name))


def _date_condition(col: Column, dtype: DataType, op: str, value: Any) -> Column:
    if op in LISTS:
        days = [date_value(v) for v in list_values(op, value)]
        found = reduce(operator.or_, [_on_day(col, dtype, "=", day) for day in days])
        return found if op == "IN" else ~found
    if op in RANGES:
        low, high = (date_value(v) for v in range_values(value))
        inside = _on_day(col, dtype, ">=", low) & _on_day(col, dtype, "<=", high)
        return inside if op == "BETWEEN" else ~inside
    if op in PATTERNS:
        day = date_value(value)
        matched = (col if isinstance(dtype, DateType) else _as_day(col, dtype)).cast("string") == day.isoformat()
        return matched if op == "LIKE" else ~matched
    return _on_day(col, dtype, op, date_value(value))


def _as_day(col: Column, dtype: DataType) -> Column:
    return col.cast("date") if isinstance(dtype, (DateType, *_TIMESTAMPS)) else to_date(col)


def _on_day(col: Column, dtype: DataType, op: str, day: dt.date) -> Column:
    """Compare a column's calendar day. Timestamps use half-open bounds on the bare column."""
    if not isinstance(dtype, _TIMESTAMPS):
        return _COMPARE[op](_as_day(col, dtype), F.lit(day))
    start = F.lit(day.isoformat()).cast(dtype)
    end = F.lit((day + dt.timedelta(days=1)).isoformat()).cast(dtype)
    if op == ">=":
        return col >= start
    if op == ">":
        return col >= end
    if op == "<":
        return col < start
    if op == "<=":
        return col < end
    same = (col >= start) & (col < end)
    return same if op == "=" else ~same
