"""Families of equal tables, one per month and region, queried as one."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.operators.distincts import count_summary, distinct_summary, unite_distinct
from tablemill.operators.paging import ordering, sort_rows
from tablemill.operators.places import content_order
from tablemill.operators.reports import lay_out, long_report
from tablemill.operators.totals import with_grand_total
from tablemill.plans.compile import Page, Source, build, build_list, count_rows, fetch_page, may_group, open_source, page_sizes, shape, states_order
from tablemill.plans.scope import Tables, column, lookup_table
from tablemill.plans.spec import NAME_RULE, QuerySpec, decode
from tablemill.plans.sql import clean_sql

# Region codes, table naming and placeholders of a family.
REGION_CODES = ("DVVNL", "PVVNL", "PUVNL", "MVVNL", "KESCO")
TABLE_STEM = "CM_master_data_"
TABLE_PLACEHOLDER = "{{MASTER_TABLE}}"
REGION_PLACEHOLDER = "{{DISCOM}}"
# String literals and comments of SQL text.
NOT_CODE = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/""", re.DOTALL)
# Other names under which a JSON payload may carry the fields.
FIELD_ALIASES = {"month_tag": "month", "discoms": "regions", "base_discom": "base_region"}


@dataclass(frozen=True)
class Family:
    """Which member tables a query runs over.

    With ``enabled`` off, or a single region, only the base region's table is read.
    """

    month: str
    regions: tuple[str, ...] = ()
    base_region: str = ""
    enabled: bool = True
    schema_name: str | None = None
    allowed: tuple[str, ...] = REGION_CODES

    def __post_init__(self) -> None:
        month = self.month.strip().lower()
        if not re.fullmatch(r"[a-z]{3}_\d{4}", month):
            raise SpecError(f"A family month is written like mar_2026; got {self.month!r}.")
        known = {code.upper(): code for code in self.allowed}
        regions = tuple(dict.fromkeys(_region(r, known) for r in self.regions))
        base = _region(self.base_region, known) if self.base_region.strip() else ""
        regions = regions or ((base,) if base else ())
        if not regions:
            raise SpecError("A family needs at least one region.")
        if self.schema_name and not NAME_RULE.fullmatch(self.schema_name):
            raise SpecError(f"Invalid schema name {self.schema_name!r}.")
        object.__setattr__(self, "month", month)
        object.__setattr__(self, "regions", regions)
        object.__setattr__(self, "base_region", base if base in regions else regions[0])

    @classmethod
    def from_dict(cls, payload: Mapping[str, object]) -> Family:
        return decode(cls, {FIELD_ALIASES.get(name, name): value for name, value in payload.items()})

    @property
    def members(self) -> tuple[str, ...]:
        """Regions actually read."""
        return self.regions if self.enabled and len(self.regions) > 1 else (self.base_region,)

    def table(self, region: str) -> str:
        name = f"{TABLE_STEM}{self.month}_{region}"
        return f"{self.schema_name}.{name}" if self.schema_name else name

    def is_member(self, name: str) -> bool:
        """True for the placeholder and for any month's and region's table name."""
        return name == TABLE_PLACEHOLDER or bool(self._pattern().fullmatch(name.strip()))

    def _pattern(self) -> re.Pattern[str]:
        regions = "|".join(re.escape(code) for code in self.allowed)
        schema = rf"(?:[`\"]?{re.escape(self.schema_name)}[`\"]?\s*\.\s*)?" if self.schema_name else ""
        return re.compile(rf"{schema}[`\"]?\b{TABLE_STEM}[A-Z]{{3}}_\d{{4}}_(?:{regions})\b[`\"]?", re.IGNORECASE)

    def in_text(self, text: str, region: str) -> str:
        """SQL text with placeholders and member table names set to one region.

        Placeholders are replaced wherever they stand. Names of member tables are only replaced
        where they name a table: string literals and comments stay as they are.
        """
        name, pieces, at = self._pattern(), [], 0
        for quoted_text in NOT_CODE.finditer(text):
            pieces += [name.sub(lambda _: self.table(region), text[at : quoted_text.start()]), quoted_text[0]]
            at = quoted_text.end()
        text = "".join(pieces) + name.sub(lambda _: self.table(region), text[at:])
        return text.replace(TABLE_PLACEHOLDER, self.table(region)).replace(REGION_PLACEHOLDER, region)

    def tables_for(self, region: str, tables: Tables):
        """A table lookup in which every member name means this region's table."""

        def find(name: str) -> DataFrame:
            return lookup_table(tables, self.table(region) if self.is_member(name) else name)

        return find


def _region(code: str, known: dict[str, str]) -> str:
    found = known.get(code.strip().upper())
    if found is None:
        raise SpecError(f"Unknown region {code!r}; use one of {', '.join(known.values())}.")
    return found


@dataclass(frozen=True)
class FamilyDataset:
    """Table lookup over one dataset with the rows of all members, labelled by region (and month).

    Stored with ``partitionBy``, a member's rows are its own partition, and so are those of any
    choice of members.
    """

    df: DataFrame
    family: Family
    region_column: str
    month_column: str | None = None

    def __call__(self, name: str) -> DataFrame:
        for region in self.family.allowed:
            if name.lower() == self.family.table(region).lower():
                return self.rows(F.col(self.region_column) == region)
        raise SpecError(f"{name!r} is not a member table.")

    def rows(self, wanted: Column) -> DataFrame:
        rows = self.df.filter(wanted)
        return rows.filter(F.col(self.month_column) == self.family.month) if self.month_column else rows

    def members(self) -> DataFrame:
        """The rows of all members that are read, in one scan."""
        return self.rows(F.col(self.region_column).isin(*self.family.members))


def family_of_partitions(df: DataFrame, family: Family, region_column: str, month_column: str | None = None) -> FamilyDataset:
    return FamilyDataset(df, family, region_column, month_column)


def _together(spec: QuerySpec, family: Family, tables: Tables) -> Source | None:
    """The source of all members at once, if they are one dataset and joins can't mix them up.

    A join that keeps unmatched rows of the joined table would do so once for each member.
    """
    if not isinstance(tables, FamilyDataset) or len(family.members) < 2 or not family.is_member(spec.table):
        return None
    if any(family.is_member(j.table) or j.join_type == "RIGHT" for j in spec.joins):
        return None
    own = FamilyDataset(tables.df, family, tables.region_column, tables.month_column)
    return open_source(spec, lambda name: own.members() if family.is_member(name) else tables(name), addressed=bool(spec.sort))


def _keyless(spec: QuerySpec) -> bool:
    """Whether an aggregate stands alone, which gives a row even for a member without rows."""
    return spec.selects_all and not spec.group_by and may_group(spec)


def union_family(spec: QuerySpec, family: Family, tables: Tables) -> DataFrame:
    """The same query over every member, combined by UNION ALL.

    A limit holds per member, after that member's own sort. Without a limit the sort
    holds for the union. Reports aggregate per member and are laid out together; where
    members fill the same cell, the later region's value is shown.
    """
    if spec.execution_mode == "sql":
        return _sql_union(spec, family, tables)
    branches = [family.tables_for(region, tables) for region in family.members]
    if len(branches) == 1:
        return build(spec, branches[0])
    if spec.mode != "REPORT" and not spec.offset and not _keyless(spec) and (spec.sort or not spec.limit_rows):
        source = _together(spec, family, tables)
        if source is not None:
            return _one_scan(spec, source, tables.region_column)
    if spec.mode == "REPORT":
        parts = [
            long_report(spec, find).withColumn("__branch", F.lit(i)) for i, find in enumerate(branches)
        ]
        return lay_out(_stack(parts), spec)
    if spec.limit_rows or spec.offset:
        return _stack([build_list(spec, find) for find in branches])
    shapes = [shape(spec, open_source(spec, find)) for find in branches]
    if not spec.sort:
        return _stack([s.finish(s.frame) for s in shapes])
    keyed = [
        s.frame.select(
            *[col.alias(f"__out_{i}") for i, (col, _) in enumerate(s.outputs)],
            *[key.alias(f"__sort_{i}") for i, (key, _) in enumerate(s.sorts)],
        )
        for s in shapes
    ]
    order = [ordering(column(f"__sort_{i}"), s.direction) for i, s in enumerate(spec.sort)]
    names = [name for _, name in shapes[0].outputs]
    rows = _stack(keyed)
    return sort_rows(rows, order, content_order(rows, rows.columns)).select([f"__out_{i}" for i in range(len(names))]).toDF(*names)


def _one_scan(spec: QuerySpec, source: Source, region_column: str) -> DataFrame:
    """All members from rows labelled by region: groups and limits hold per region.

    Each task keeps the first rows of every region before anything is shuffled.
    """
    shaped = shape(spec, source, apart=source.scope.resolve(region_column, default=spec.table.strip()))
    if not spec.sort:
        return shaped.finish(shaped.frame)
    rows, keys = shaped.keyed()
    order = [k.ordered for k in keys]
    if not spec.limit_rows:
        return shaped.unkeyed(rows.orderBy(*order))
    place = F.row_number().over(Window.partitionBy("__apart").orderBy(*order))
    return shaped.unkeyed(rows.withColumn("__place", place).filter(F.col("__place") <= spec.limit_rows))


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def union_family_sql(
    spark: SparkSession,
    text: str,
    family: Family,
    limit_rows: int = 0,
    order_by: Sequence[Column | str] = (),
) -> DataFrame:
    """SQL text run once per member. ``limit_rows`` holds per member, ``order_by`` for the union."""
    body = clean_sql(text)
    parts = [spark.sql(family.in_text(body, region)) for region in family.members]
    if limit_rows:
        parts = [part.orderBy(*order_by).limit(limit_rows) if order_by else part.limit(limit_rows) for part in parts]
        return _stack(parts)
    stacked = _stack(parts)
    keys = [F.col(key) if isinstance(key, str) else key for key in order_by]
    return sort_rows(stacked, keys, content_order(stacked, stacked.columns)) if keys else stacked


def _sql_union(spec: QuerySpec, family: Family, tables: Tables) -> DataFrame:
    """SQL text of a specification over all members, with its limit, sort and grand total."""
    session = tables if isinstance(tables, SparkSession) else SparkSession.active()
    order = [ordering(column(s.column.strip()), s.direction) for s in spec.sort]
    rows = union_family_sql(session, spec.sql or "", family, spec.limit_rows, order)
    if spec.mode == "REPORT" and spec.add_grand_total:
        return with_grand_total(rows, keep_order=bool(order) or states_order(spec.sql or ""))
    return rows


def family_total(spec: QuerySpec, family: Family, tables: Tables) -> DataFrame:
    """One row, ``total``: matching rows of all members, each counted on its own or all in one scan."""
    source = _together(spec, family, tables)
    if source is not None:
        return source.frame.agg(F.count(F.lit(1)).alias("total"))
    parts = [count_rows(spec, family.tables_for(region, tables)) for region in family.members]
    return _stack(parts).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def family_distinct(spec: QuerySpec, family: Family, tables: Tables) -> DataFrame:
    """Distinct counts over all members as one set, by the selected columns.

    ``union_family`` counts each member's values on its own, and those counts don't add up. The
    specification has a single computed column, a COUNT_DISTINCT, and no sort or limit.
    """
    counted = [f for f in spec.function_columns if f.func == "COUNT_DISTINCT"]
    others = spec.group_by or spec.aggregates or spec.case_expressions or spec.sort or spec.limit_rows or spec.offset
    if spec.mode == "REPORT" or spec.execution_mode == "sql" or others or len(counted) != 1 or len(spec.function_columns) != 1:
        raise SpecError("A distinct count over a family takes selected columns and one COUNT_DISTINCT.")
    selected = [] if spec.selects_all else list(spec.select)
    keys = [f"__key_{i}" for i in range(len(selected))]

    def summary(source: Source) -> DataFrame:
        named = [source.scope.resolve(text).expr.alias(key) for text, key in zip(selected, keys)]
        return distinct_summary(source.frame.select(*named, source.scope.resolve(counted[0].column).expr.alias("__counted")), keys, "__counted")

    source = _together(spec, family, tables)
    if source is not None:
        sets, scope = summary(source), source.scope
    else:
        sources = [open_source(spec, family.tables_for(region, tables)) for region in family.members]
        sets, scope = unite_distinct([summary(s) for s in sources], keys), sources[0].scope
    refs = [scope.resolve(text) for text in selected]
    names = [ref.qualified if spec.joins else ref.name for ref in refs]
    return count_summary(sets, keys, "__n").toDF(*names, counted[0].alias)


def family_page(spec: QuerySpec, family: Family, tables: Tables) -> Page:
    """The union's rows with the summed ``total`` and ``page_rows``, and ``truncated`` if a member's page is full.

    For reports and SQL text the total is the number of rows shown, and nothing is cut off
    but by a limit.
    """
    if spec.mode == "REPORT" or spec.execution_mode == "sql":
        rows, shown = union_family(spec, family, tables), F.count(F.lit(1))
        return Page(lambda: rows, rows.agg(shown.alias("total"), shown.alias("page_rows"), F.lit(False).alias("truncated")))
    source = None if may_group(spec) else _together(spec, family, tables)
    if source is not None:
        region = source.scope.resolve(tables.region_column, default=spec.table.strip()).expr
        parts = page_sizes(source.frame.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("total")), spec)
    else:
        parts = _stack([fetch_page(spec, family.tables_for(region, tables)).counts for region in family.members])
    counts = parts.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("page_rows"), F.lit(0)).alias("page_rows"),
        F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"),
    )
    return Page(lambda: union_family(spec, family, tables), counts)
