"""Name resolution: every column of the base table and its joins under one unique name."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from tablemill.errors import SpecError
from tablemill.operators.places import with_address

# Metadata of a column that holds the parsed values of a text column: which one, and the kind of values.
SHADOW, DAY, NUMBER, TEXT = "shadow_of", "day", "number", "text"

Tables = SparkSession | Mapping[str, DataFrame] | Callable[[str], DataFrame]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(quoted(name))


def lookup_table(tables: Tables, name: str) -> DataFrame:
    """A table by name from a session catalog, a mapping or a function."""
    if isinstance(tables, SparkSession):
        return tables.table(".".join(quoted(part) for part in name.split(".")))
    if isinstance(tables, Mapping):
        if name not in tables:
            raise SpecError(f"Unknown table {name!r}; known: {', '.join(sorted(tables))}.")
        return tables[name]
    return tables(name)


@dataclass(frozen=True)
class Ref:
    """A resolved column: its table reference, own name, type and expression, and parsed values stored beside it."""

    reference: str
    name: str
    dtype: DataType
    expr: Column
    day: Column | None = None
    number: Column | None = None

    @property
    def qualified(self) -> str:
        return f"{self.reference}.{self.name}"


class Scope:
    """Tables visible to a query, in join order.

    Columns carry the physical name ``reference.column`` while a query is assembled. That
    keeps repeated tables and equal column names apart without plan aliases, and a rename
    costs nothing at run time: Catalyst still prunes and pushes through it.
    """

    def __init__(self, base: str) -> None:
        self.base = base
        self._columns: dict[str, dict[str, tuple[str, DataType]]] = {}
        self._addresses: dict[str, tuple[str, str]] = {}
        self._shadows: dict[str, dict[str, dict[str, str]]] = {}

    @property
    def references(self) -> list[str]:
        return list(self._columns)

    def admit(self, reference: str, df: DataFrame, addressed: bool = False) -> DataFrame:
        """Register a table and return it with its columns qualified.

        ``addressed`` adds where each row is stored, where the table can tell; see ``addresses``.
        """
        known: dict[str, tuple[str, DataType]] = {}
        shadows = self._shadows.setdefault(reference, {})
        texts = {f.name.lower() for f in df.schema.fields if isinstance(f.dataType, StringType)}
        others = {f.name.lower() for f in df.schema.fields} - texts
        for field in df.schema.fields:
            source = str(field.metadata.get(SHADOW, "")).lower()
            if source in (others if field.metadata.get("kind") == TEXT else texts):
                shadows.setdefault(source, {})[str(field.metadata.get("kind"))] = field.name
                continue
            if field.name.lower() in known:
                raise SpecError(f"Table {reference!r} has the column {field.name!r} more than once.")
            known[field.name.lower()] = (field.name, field.dataType)
        self._columns[reference] = known
        names = [f"{reference}.{f.name}" for f in df.schema.fields]
        placed = with_address(df, "__file", "__row") if addressed else None
        if placed is None:
            return df.toDF(*names)
        self._addresses[reference] = (f"__file.{reference}", f"__row.{reference}")
        return placed.toDF(*names, *self._addresses[reference])

    @property
    def addresses(self) -> list[str]:
        """Columns that tell where the rows of the tables are stored, for those that can."""
        return [name for pair in self._addresses.values() for name in pair]

    @property
    def all_addressed(self) -> bool:
        return self._addresses.keys() == self._columns.keys()

    def columns_of(self, reference: str) -> list[Ref]:
        return [self._ref(reference, name, dtype) for name, dtype in self._columns[reference].values()]

    def all_columns(self) -> list[Ref]:
        return [ref for reference in self._columns for ref in self.columns_of(reference)]

    def resolve(self, text: str, default: str | None = None) -> Ref:
        """Find a column. The longest table reference that prefixes the text wins."""
        wanted = text.strip()
        prefixes = [r for r in self._columns if wanted.startswith(r + ".")]
        if prefixes:
            reference = max(prefixes, key=len)
            name = wanted[len(reference) + 1:]
        elif "." in wanted:
            reference, _, name = wanted.rpartition(".")
        else:
            reference, name = default or self.base, wanted
        reference, name = reference.strip(), name.strip()
        if not reference or not name:
            raise SpecError(f"Invalid column reference {text!r}.")
        if reference not in self._columns:
            raise SpecError(f"Unknown table reference {reference!r} in column {text!r}.")
        found = self._columns[reference].get(name.lower())
        if found is None:
            options = ", ".join(actual for actual, _ in self._columns[reference].values())
            raise SpecError(f"Table {reference!r} has no column {name!r}. Available: {options}.")
        return self._ref(reference, *found)

    def _ref(self, reference: str, name: str, dtype: DataType) -> Ref:
        own = self._shadows[reference].get(name.lower(), {})
        parsed = {kind: column(f"{reference}.{own[kind]}") for kind in (DAY, NUMBER) if kind in own}
        return Ref(reference, name, dtype, column(f"{reference}.{name}"), **parsed)
