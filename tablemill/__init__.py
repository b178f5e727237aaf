"""Declarative table queries and data preparation on Spark DataFrames."""

from tablemill.errors import SpecError
from tablemill.plans.compile import Page, build, count_rows, fetch_page
from tablemill.plans.spec import (
    Aggregate,
    Branch,
    CaseColumn,
    Filter,
    FunctionColumn,
    Join,
    JoinKey,
    Pivot,
    QuerySpec,
    Sort,
)
from tablemill.plans.sql import run_sql

__all__ = [
    "Aggregate",
    "Branch",
    "CaseColumn",
    "Filter",
    "FunctionColumn",
    "Join",
    "JoinKey",
    "Page",
    "Pivot",
    "QuerySpec",
    "Sort",
    "SpecError",
    "build",
    "count_rows",
    "fetch_page",
    "run_sql",
]
