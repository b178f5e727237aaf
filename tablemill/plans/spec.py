"""Declarative query specifications.

A specification is plain data: it can be written in Python or read from JSON with
``QuerySpec.from_dict``. It carries no engine state; ``tablemill.plans.compile`` turns it
into a lazy DataFrame.
"""

from __future__ import annotations

import itertools
import re
import types
import typing
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

from tablemill.errors import SpecError

# Operator, function and join names accepted in a specification.
NULL_TESTS = ("IS NULL", "IS NOT NULL")
EQUALITY = ("=", "!=")
COMPARISONS = (">", "<", ">=", "<=")
PATTERNS = ("LIKE", "NOT LIKE")
LISTS = ("IN", "NOT IN")
RANGES = ("BETWEEN", "NOT BETWEEN")
TEXT_TESTS = ("CONTAINS", "NOT CONTAINS", "STARTS WITH", "ENDS WITH")
FILTER_OPERATORS = EQUALITY + COMPARISONS + PATTERNS + LISTS + NULL_TESTS + RANGES + TEXT_TESTS
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
FUNCTIONS = AGGREGATES + ("COUNT_DISTINCT", "COALESCE")
JOIN_TYPES = ("INNER", "LEFT", "RIGHT")
DEFAULT_LIMIT = 1000
MAX_LIMIT = 50_000
NAME_RULE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise SpecError(f"Unknown {what} {value!r}; use one of {', '.join(allowed)}.")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None

    def __post_init__(self) -> None:
        _one_of(self.operator, FILTER_OPERATORS, "filter operator")


@dataclass(frozen=True)
class Sort:
    column: str
    direction: str = "ASC"

    def __post_init__(self) -> None:
        _one_of(self.direction, ("ASC", "DESC"), "sort direction")


@dataclass(frozen=True)
class Branch:
    """One WHEN … THEN … arm of a CASE column."""

    column: str
    operator: str
    value: Any = ""
    then_value: Any = ""
    then_type: str = "literal"

    def __post_init__(self) -> None:
        _one_of(self.operator, FILTER_OPERATORS, "filter operator")
        _one_of(self.then_type, ("literal", "column"), "THEN type")


@dataclass(frozen=True)
class CaseColumn:
    alias: str
    branches: tuple[Branch, ...] = ()
    else_value: Any = ""
    else_type: str = "literal"
    aggregate_func: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.else_type, ("literal", "column"), "ELSE type")
        if self.aggregate_func is not None:
            _one_of(self.aggregate_func, AGGREGATES, "aggregate")


@dataclass(frozen=True)
class FunctionColumn:
    func: str
    column: str
    alias: str
    second_column: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.func, FUNCTIONS, "function")


@dataclass(frozen=True)
class Aggregate:
    column: str
    func: str
    alias: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.func, AGGREGATES, "aggregate")


@dataclass(frozen=True)
class JoinKey:
    left_column: str
    right_column: str

    def __post_init__(self) -> None:
        if not (self.left_column.strip() and self.right_column.strip()):
            raise SpecError("A join condition needs a column on both sides.")


@dataclass(frozen=True)
class Join:
    table: str
    conditions: tuple[JoinKey, ...]
    join_type: str = "INNER"
    alias: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.join_type, JOIN_TYPES, "join type")
        if not self.table.strip():
            raise SpecError("A join needs a table.")
        if not self.conditions:
            raise SpecError(f"The join to {self.table!r} needs at least one pair of columns.")
        alias = (self.alias or "").strip()
        if alias and not NAME_RULE.fullmatch(alias):
            raise SpecError(f"Join alias {alias!r} must be a letter or underscore, then letters, digits, underscores.")
        object.__setattr__(self, "alias", alias or None)

    @property
    def reference(self) -> str:
        return self.alias or self.table.strip()


@dataclass(frozen=True)
class Pivot:
    """A report: one aggregate of ``values`` by row fields, spread over column fields."""

    values: str
    func: str
    rows: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _one_of(self.func, AGGREGATES, "report aggregate")
        if not self.values.strip():
            raise SpecError("A report needs a value field.")
        object.__setattr__(self, "rows", tuple(f.strip() for f in self.rows if f.strip()))
        object.__setattr__(self, "columns", tuple(f.strip() for f in self.columns if f.strip()))


@dataclass(frozen=True)
class QuerySpec:
    table: str = ""
    select: tuple[str, ...] = ("*",)
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    joins: tuple[Join, ...] = ()
    limit_rows: int = DEFAULT_LIMIT
    offset: int = 0
    mode: str = "LIST"
    pivot: Pivot | None = None
    add_grand_total: bool = False
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    case_expressions: tuple[CaseColumn, ...] = ()
    function_columns: tuple[FunctionColumn, ...] = ()
    execution_mode: str = "builder"
    sql: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.mode, ("LIST", "REPORT"), "mode")
        _one_of(self.execution_mode, ("builder", "sql"), "execution mode")
        if not 0 <= self.limit_rows <= MAX_LIMIT:
            raise SpecError(f"limit_rows must lie between 0 (unlimited) and {MAX_LIMIT}.")
        if self.offset < 0:
            raise SpecError("offset cannot be negative.")
        if self.execution_mode == "sql":
            if not (self.sql or "").strip():
                raise SpecError("SQL mode needs SQL text.")
            return
        if not self.table.strip():
            raise SpecError("A query needs a table.")
        if self.mode == "REPORT" and self.pivot is None:
            raise SpecError("Report mode needs a pivot definition.")
        references = [self.table.strip(), *(j.reference for j in self.joins)]
        repeated = {r for r in references if references.count(r) > 1}
        if repeated:
            raise SpecError(f"Each joined table needs its own name; repeated: {', '.join(sorted(repeated))}.")

    @property
    def selects_all(self) -> bool:
        return not self.select or tuple(self.select) == ("*",)

    def with_(self, **changes: Any) -> QuerySpec:
        return replace(self, **changes)

    @classmethod
    def from_dict(cls, payload: Mapping[str, Any]) -> QuerySpec:
        """Build a specification from nested dicts and lists, as decoded from JSON.

        An ``engine`` entry is accepted and has no effect: everything runs on Spark.
        """
        return decode(cls, {name: value for name, value in payload.items() if name != "engine"})


def suggest_alias(table: str, taken: Iterable[str]) -> str:
    """A free join alias for a table: its last name part, numbered from 2 if it is taken."""
    base = re.sub(r"[^A-Za-z0-9_]", "_", table.strip().rpartition(".")[2])
    if base and not NAME_RULE.fullmatch(base):
        base = f"j_{base}"
    base = base or "join_ref"
    used = set(taken)
    names = itertools.chain([base], (f"{base}_{n}" for n in itertools.count(2)))
    return next(name for name in names if name not in used)


def decode(kind: type, payload: Mapping[str, Any]) -> Any:
    """A dataclass from a mapping with its field names; unknown names are refused."""
    hints = typing.get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    unknown = set(payload) - known
    if unknown:
        raise SpecError(f"Unknown field(s) for {kind.__name__}: {', '.join(sorted(unknown))}.")
    try:
        return kind(**{name: _decode_value(hints[name], value) for name, value in payload.items()})
    except TypeError as exc:
        raise SpecError(f"{kind.__name__}: {exc}") from exc


def _decode_value(hint: Any, value: Any) -> Any:
    if typing.get_origin(hint) is types.UnionType:
        hint = next(a for a in typing.get_args(hint) if a is not type(None))
    if typing.get_origin(hint) is tuple and value is not None:
        return tuple(_decode_value(typing.get_args(hint)[0], v) for v in value)
    if is_dataclass(hint) and isinstance(value, Mapping):
        return decode(hint, value)
    return value
