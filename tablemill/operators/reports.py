"""Reports: one aggregate grouped by row fields and spread over column fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.functions.casts import shown
from tablemill.operators.expressions import aggregate
from tablemill.operators.paging import ordering
from tablemill.operators.totals import with_grand_total
from tablemill.plans.compile import open_source
from tablemill.plans.scope import Tables, column
from tablemill.plans.spec import Pivot, QuerySpec
from tablemill.session import materialize

MAX_HEADINGS_SETTING = "spark.sql.pivotMaxValues"


def report(spec: QuerySpec, tables: Tables) -> DataFrame:
    """The finished report, with its grand total if the specification asks for one."""
    return lay_out(long_report(spec, tables), spec)


def row_names(pivot: Pivot) -> list[str]:
    return [f"__row_{i}" for i in range(len(pivot.rows))]


def column_names(pivot: Pivot) -> list[str]:
    return [f"__column_{i}" for i in range(len(pivot.columns))]


def long_report(spec: QuerySpec, tables: Tables) -> DataFrame:
    """The aggregate in long form: one row per row key and column key.

    This is the whole report before any value becomes a heading, so it is also the form
    to use when there are more headings than a table can have columns.
    """
    pivot = _pivot(spec)
    source = open_source(spec, tables)
    value = source.scope.resolve(pivot.values)
    keys = [
        source.scope.resolve(text).expr.alias(name)
        for text, name in zip(pivot.rows + pivot.columns, row_names(pivot) + column_names(pivot))
    ]
    total = aggregate(pivot.func, value.expr, value.dtype).alias("__value")
    return source.frame.groupBy(*keys).agg(total) if keys else source.frame.agg(total)


def lay_out(long: DataFrame, spec: QuerySpec) -> DataFrame:
    """Long form to report. With several values for a cell the highest ``__branch`` wins."""
    pivot = _pivot(spec)
    if not pivot.columns:
        keys = row_names(pivot)
        labels = [*pivot.rows, f"{pivot.func}({pivot.values.strip()})"]
        wide = long.select(*keys, "__value")
    else:
        wide, labels = _spread(long, pivot)
    if spec.add_grand_total:
        total = with_grand_total(wide.toDF(*_unique(labels)), order_by=_unique(labels)[: len(pivot.rows)])
        return total.toDF(*labels)
    if pivot.rows:
        wide = wide.orderBy(*[ordering(column(k), "ASC") for k in row_names(pivot)])
    return wide.toDF(*labels)


def _pivot(spec: QuerySpec) -> Pivot:
    if spec.mode != "REPORT" or spec.pivot is None:
        raise SpecError("A report needs REPORT mode and a pivot definition.")
    return spec.pivot


def _unique(labels: list[str]) -> list[str]:
    """Labels made distinct by position; a report may show the same text twice."""
    return [label if label not in labels[:i] else f"{label} #{i}" for i, label in enumerate(labels)]


def _heading(pivot: Pivot) -> Column:
    names = column_names(pivot)
    if len(names) == 1:
        return shown(column(names[0]))
    parts = [F.concat(F.lit(f"{field}="), shown(column(n))) for field, n in zip(pivot.columns, names)]
    return F.concat_ws(" | ", *parts)


def _spread(long: DataFrame, pivot: Pivot) -> tuple[DataFrame, list[str]]:
    """Turn headings into columns, in the order they first appear in key-sorted rows.

    The long form is written once: the headings and the pivot both read that small table,
    so the source data is scanned a single time.
    """
    rows, keys = row_names(pivot), column_names(pivot)
    long = materialize(long.withColumn("__heading", _heading(pivot)), "report")
    headings = _heading_order(long, rows + keys, keys)
    if not headings:
        empty = long.select(*rows, "__value").limit(0)
        return empty, [*pivot.rows, f"{pivot.func}({pivot.values.strip()})"]
    pick = F.max_by("__value", "__branch") if "__branch" in long.columns else F.first("__value")
    wide = long.groupBy(*rows).pivot("__heading", headings).agg(pick)
    return wide.toDF(*rows, *[f"__cell_{i}" for i in range(len(headings))]), [*pivot.rows, *headings]


def _heading_order(long: DataFrame, sort_keys: list[str], heading_keys: list[str]) -> list[str]:
    most = int(long.sparkSession.conf.get(MAX_HEADINGS_SETTING, "10000"))
    place = F.struct(*[c for k in sort_keys for c in (column(k).isNull(), column(k))])
    source = F.struct(*[column(k) for k in heading_keys])
    seen = long.groupBy("__heading").agg(
        F.min(place).alias("__place"), F.min(source).alias("__low"), F.max(source).alias("__high")
    ).withColumn("__clash", ~F.col("__low").eqNullSafe(F.col("__high")))
    found = seen.orderBy("__place").select("__heading", "__clash").limit(most + 1).collect()
    if len(found) > most:
        raise SpecError(
            f"The column fields have more than {most} distinct headings ({MAX_HEADINGS_SETTING}); "
            "use long_report() or fewer column fields."
        )
    clash = [row["__heading"] for row in found if row["__clash"]]
    if clash:
        raise SpecError(f"Different values share the heading(s) {', '.join(map(repr, clash))}.")
    return [row["__heading"] for row in found]
