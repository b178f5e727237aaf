"""Specification to lazy DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.operators.expressions import aggregate_of, case_of, coalesce_of
from tablemill.operators.filters import check_operator, compile_filters
from tablemill.operators.joins import equi_join
from tablemill.operators.paging import Key, KeyIndex, key_index, page_of
from tablemill.operators.places import content_order
from tablemill.plans.scope import Ref, Scope, Tables, column, lookup_table
from tablemill.plans.spec import QuerySpec


@dataclass
class Source:
    """The filtered join a query reads, with the names visible in it."""

    scope: Scope
    frame: DataFrame


def open_source(spec: QuerySpec, tables: Tables, addressed: bool = False) -> Source:
    """FROM and WHERE: join the tables in order and apply all filters.

    With ``addressed``, rows carry where those of the tables are stored.
    """
    base = spec.table.strip()
    scope = Scope(base)
    table = lookup_table(tables, base)
    frame = scope.admit(base, table, addressed)
    sources = [table]
    parts = {base: frame}
    for join in spec.joins:
        earlier = set(scope.references)
        table = lookup_table(tables, join.table.strip())
        joined = parts[join.reference] = scope.admit(join.reference, table, addressed)
        pairs, owners = [], set()
        for keys in join.conditions:
            left = scope.resolve(keys.left_column)
            right = scope.resolve(keys.right_column, default=join.reference)
            if left.reference not in earlier:
                raise SpecError(f"The left side of join {join.reference!r} must be the base table or an earlier join.")
            if right.reference != join.reference:
                raise SpecError(f"The right side of join {join.reference!r} must be a column of that table.")
            pairs.append((left.qualified, right.qualified))
            owners.add(left.reference)
        how = join.join_type.lower()
        # Keys that all come from one table can be read from it instead of the joins so far.
        key_source = parts[owners.pop()] if how == "left" and len(owners) == 1 else None
        frame = equi_join(frame, joined, pairs, how, [table] if how == "left" else sources, key_source)
        sources.append(table)
    condition = compile_filters(spec.filters, scope)
    return Source(scope, frame if condition is None else frame.filter(condition))


@dataclass
class Shape:
    """A list query before ordering: where its rows come from, its outputs and sort keys."""

    frame: DataFrame
    outputs: list[tuple[Column, str]]
    sorts: list[tuple[Column, str]]
    addresses: list[str] = field(default_factory=list)
    all_addressed: bool = False
    apart: Column | None = None

    def finish(self, frame: DataFrame) -> DataFrame:
        """Project the outputs under their public names; equal names are allowed."""
        return frame.select([col for col, _ in self.outputs]).toDF(*[name for _, name in self.outputs])

    def keyed(self) -> tuple[DataFrame, list[Key]]:
        """The outputs with the sort keys, and behind those what tells rows with equal keys apart.

        That is where the rows of the tables are stored; for groups and for tables that can't
        tell, it is what the row shows.
        """
        rows = self.frame.select(
            *[col.alias(f"__out_{i}") for i, (col, _) in enumerate(self.outputs)],
            *[key.alias(f"__sort_{i}") for i, (key, _) in enumerate(self.sorts)],
            *[column(name).alias(f"__tie_{i}") for i, name in enumerate(self.addresses)],
            *([] if self.apart is None else [self.apart.alias("__apart")]),
        )
        named = [(f"__sort_{i}", direction) for i, (_, direction) in enumerate(self.sorts)]
        named += [(f"__tie_{i}", "ASC") for i in range(len(self.addresses))]
        if not self.all_addressed:
            shown = content_order(rows, [c for c in rows.columns if c.startswith(("__out", "__sort"))])
            rows = rows.select("*", *[col.alias(f"__shown_{i}") for i, col in enumerate(shown)])
            named += [(f"__shown_{i}", "ASC") for i in range(len(shown))]
        return rows, [Key(name, direction, rows.schema[name].dataType) for name, direction in named]

    def unkeyed(self, rows: DataFrame) -> DataFrame:
        return rows.select([column(f"__out_{i}") for i in range(len(self.outputs))]).toDF(*[name for _, name in self.outputs])


def shape(spec: QuerySpec, source: Source, apart: Ref | None = None) -> Shape:
    """Projection and grouping of a list query. Rows that differ in ``apart`` are never grouped together."""
    scope, frame = source.scope, source.frame
    joined = bool(spec.joins)
    selected = [] if spec.selects_all else [scope.resolve(text) for text in spec.select]
    cases = [(case_of(c, scope), c.alias, bool(c.aggregate_func)) for c in spec.case_expressions if c.alias.strip()]
    computed = [case for case in cases if case[0] is not None]
    for f in spec.function_columns:
        if f.column.strip() and f.alias.strip():
            col = coalesce_of(f, scope) if f.func == "COALESCE" else aggregate_of(f.func, f.column, scope)
            computed.append((col, f.alias, f.func != "COALESCE"))
    for a in spec.aggregates:
        computed.append((aggregate_of(a.func, a.column, scope), a.alias or f"{a.func}({a.column})", True))

    if spec.group_by or any(grouped for _, _, grouped in computed):
        named = {ref.qualified for ref in selected}
        keys = [ref for ref in map(scope.resolve, spec.group_by) if ref.qualified not in named] + selected
        return _grouped(spec, scope, frame, keys, computed, joined, apart)

    if spec.selects_all:
        outputs = [(ref.expr, ref.name) for ref in scope.all_columns()]
    else:
        outputs = [(ref.expr, _public(ref, joined)) for ref in selected]
    aliases = {alias: col for col, alias, _ in computed}
    outputs += [(col, alias) for col, alias, _ in computed]
    sorts = []
    for s in spec.sort:
        ref = _find(scope, s.column, aliases)
        sorts.append((aliases[s.column.strip()] if ref is None else ref.expr, s.direction))
    return Shape(frame, outputs, sorts, scope.addresses, scope.all_addressed, None if apart is None else apart.expr)


def _grouped(
    spec: QuerySpec,
    scope: Scope,
    frame: DataFrame,
    keys: list[Ref],
    computed: list[tuple[Column, str, bool]],
    joined: bool,
    apart: Ref | None = None,
) -> Shape:
    """Group by the key columns and by computed columns that are not aggregates."""
    groups = [ref.expr.alias(f"__key_{i}") for i, ref in enumerate(keys)]
    groups += [] if apart is None else [apart.expr.alias("__key_apart")]
    groups += [col.alias(f"__computed_{i}") for i, (col, _, agg) in enumerate(computed) if not agg]
    totals = [col.alias(f"__computed_{i}") for i, (col, _, agg) in enumerate(computed) if agg]
    if not totals:
        frame = frame.select(groups).distinct()
    else:
        frame = frame.groupBy(*groups).agg(*totals) if groups else frame.agg(*totals)
    key_columns = {ref.qualified: column(f"__key_{i}") for i, ref in enumerate(keys)}
    aliases = {alias: column(f"__computed_{i}") for i, (_, alias, _) in enumerate(computed)}
    outputs = [(key_columns[ref.qualified], _public(ref, joined)) for ref in keys]
    outputs += [(column(f"__computed_{i}"), alias) for i, (_, alias, _) in enumerate(computed)]
    sorts = []
    for s in spec.sort:
        ref = _find(scope, s.column, aliases)
        found = key_columns.get(ref.qualified) if ref is not None else None
        found = aliases.get(s.column.strip()) if found is None else found
        if found is None:
            raise SpecError(f"Sort column {s.column!r} is neither grouped nor computed.")
        sorts.append((found, s.direction))
    return Shape(frame, outputs, sorts, apart=None if apart is None else column("__key_apart"))


def _public(ref: Ref, joined: bool) -> str:
    return ref.qualified if joined else ref.name


def _find(scope: Scope, text: str, aliases: dict[str, Column]) -> Ref | None:
    """The table column a sort names, or None when it can only be an output alias."""
    try:
        return scope.resolve(text)
    except SpecError:
        if text.strip() in aliases:
            return None
        raise


def build_list(spec: QuerySpec, tables: Tables, index: KeyIndex | None = None) -> DataFrame:
    """A list query. ``index`` is one of its first sort key (see ``page_index``), for pages behind an offset."""
    if not (spec.sort or spec.offset):
        shaped = shape(spec, open_source(spec, tables))
        rows = shaped.finish(shaped.frame)
        return rows.limit(spec.limit_rows) if spec.limit_rows else rows
    shaped = shape(spec, open_source(spec, tables, addressed=True))
    rows, keys = shaped.keyed()
    return shaped.unkeyed(page_of(rows, keys, spec.limit_rows, spec.offset, index))


def page_index(spec: QuerySpec, tables: Tables, path: str | None = None) -> KeyIndex:
    """The histogram of a list query's first sort key, to be used for any of its pages; kept at ``path`` if given."""
    rows, keys = shape(spec, open_source(spec, tables, addressed=True)).keyed()
    index = key_index(rows.select([k.col for k in keys]), keys[0], keys)
    if path:
        index.save(rows.sparkSession, keys[0], path)
    return index


def build(spec: QuerySpec, tables: Tables, checked: bool = False) -> DataFrame:
    """Run any specification: a list query, a report or SQL text.

    ``checked`` refuses filters whose operator is not offered for their column's type, as a
    form for queries would; by itself a query may compare text as numbers.
    """
    if checked and spec.execution_mode != "sql":
        check_operators(spec, tables)
    if spec.execution_mode == "sql":
        from tablemill.plans.sql import run_sql

        from tablemill.operators.totals import with_grand_total

        session = tables if isinstance(tables, SparkSession) else SparkSession.active()
        result = run_sql(session, spec.sql or "")
        if spec.mode == "REPORT" and spec.add_grand_total:
            return with_grand_total(result, keep_order=states_order(spec.sql or ""))
        return result
    if spec.mode == "REPORT":
        from tablemill.operators.reports import report

        return report(spec, tables)
    return build_list(spec, tables)


def states_order(text: str) -> bool:
    """Whether SQL text may state an order. One in a subquery or a literal only costs a needless sort."""
    return bool(re.search(r"\b(ORDER|SORT)\s+BY\b", text, re.IGNORECASE))


def check_operators(spec: QuerySpec, tables: Tables) -> None:
    """Refuse filters whose operator is not offered for the column's type."""
    scope = open_source(spec.with_(filters=()), tables).scope
    for flt in spec.filters:
        ref = scope.resolve(flt.column)
        check_operator(flt, ref.dtype, ref.name)


def count_rows(spec: QuerySpec, tables: Tables) -> DataFrame:
    """One row, ``total``: rows of the filtered join before grouping and limits."""
    return open_source(spec, tables).frame.agg(F.count(F.lit(1)).alias("total"))


def may_group(spec: QuerySpec) -> bool:
    computed = any(f.func != "COALESCE" for f in spec.function_columns) or any(c.aggregate_func for c in spec.case_expressions)
    return bool(spec.group_by or spec.aggregates or computed)


@dataclass
class Page:
    """One page of a result with its size information. The rows are planned when they are asked for."""

    plan_rows: Callable[[], DataFrame]
    counts: DataFrame

    @cached_property
    def rows(self) -> DataFrame:
        return self.plan_rows()

    def info(self) -> dict[str, int | bool]:
        return self.counts.first().asDict()


def page_sizes(totals: DataFrame, spec: QuerySpec) -> DataFrame:
    """Adds ``page_rows`` and ``truncated`` (the page is full) to totals of ungrouped rows."""
    left = F.greatest(F.col("total") - spec.offset, F.lit(0).cast("long"))
    sized = totals.withColumn("page_rows", F.least(left, F.lit(spec.limit_rows).cast("long")) if spec.limit_rows else left)
    return sized.withColumn("truncated", _full(spec))


def _full(spec: QuerySpec) -> Column:
    return F.col("page_rows") == spec.limit_rows if spec.limit_rows else F.lit(False)


def fetch_page(spec: QuerySpec, tables: Tables, index: KeyIndex | None = None) -> Page:
    """The page plus ``total``, ``page_rows`` and ``truncated`` (the page is full).

    Without grouping the size of the page follows from the total, and the data are counted once.
    """
    counts = count_rows(spec, tables)
    if not may_group(spec):
        return Page(lambda: build_list(spec, tables, index), page_sizes(counts, spec))
    rows = build_list(spec, tables, index)
    shown = rows.agg(F.count(F.lit(1)).alias("page_rows")).select(F.lit(0).cast("long").alias("total"), "page_rows")
    counts = counts.select("total", F.lit(0).cast("long").alias("page_rows")).union(shown)
    counts = counts.agg(F.max("total").alias("total"), F.max("page_rows").alias("page_rows"))
    return Page(lambda: rows, counts.withColumn("truncated", _full(spec)))
