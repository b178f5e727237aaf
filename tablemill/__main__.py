"""Command line: run a query or a data preparation job on the current Spark session.

    spark-submit --py-files tablemill.zip -m tablemill convert --input 'in/**/*.csv' --output out
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError
from tablemill.operators.families import Family, union_family
from tablemill.operators.lookups import enrich_monthly
from tablemill.plans.compile import build
from tablemill.plans.spec import QuerySpec
from tablemill.sources.catalog import create_object, read_source
from tablemill.sources.delimited import read_csv_set
from tablemill.sources.exports import export_csv
from tablemill.sources.folders import merge_folder
from tablemill.sources.parquet import CODECS, DEFAULT_CODEC, csv_to_parquet


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tablemill", description=__doc__.splitlines()[0])
    jobs = top.add_subparsers(dest="job", required=True)

    convert = jobs.add_parser("convert", help="CSV files to Parquet")
    convert.add_argument("--input", required=True)
    convert.add_argument("--output", required=True)
    convert.add_argument("--compression", choices=CODECS, default=DEFAULT_CODEC)
    convert.add_argument("--typed", action="store_true", help="infer column types instead of keeping text")
    convert.add_argument("--shadows", help="text columns whose parsed dates or numbers are stored too, separated by commas")
    convert.add_argument("--hierarchy", help="office lookup; with --supply, the rows get the monthly cleaning")
    convert.add_argument("--supply", help="supply-type lookup")
    convert.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today(), help="day behind the month of the rows")

    create = jobs.add_parser("create", help="table or view from files")
    create.add_argument("--input", required=True)
    create.add_argument("--object-name", required=True)
    create.add_argument("--object-type", choices=("TABLE", "VIEW"), default="TABLE")
    create.add_argument("--replace", action="store_true")
    create.add_argument("--month-label")
    create.add_argument("--sheet", help="sheet of a workbook")
    create.add_argument("--no-header", action="store_true")
    create.add_argument("--names", help="new column names, separated by commas")

    merge = jobs.add_parser("merge", help="all files of a folder into one CSV data set")
    merge.add_argument("--input", required=True)
    merge.add_argument("--output", required=True)
    merge.add_argument("--no-subfolders", action="store_true")

    query = jobs.add_parser("query", help="a JSON query specification over catalog tables, exported as CSV")
    query.add_argument("--spec", required=True, help="JSON text: the specification, with an optional 'family' part")
    query.add_argument("--output", required=True)
    return top


def read_lookup(spark: SparkSession, source: str) -> DataFrame:
    """A lookup with its keys as they are written."""
    return read_source(spark, source) if source.lower().endswith((".parquet", ".xlsx")) else read_csv_set(spark, source, filename=False)


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.job == "convert":
        transform = None
        if args.hierarchy or args.supply:
            if not (args.hierarchy and args.supply):
                raise SpecError("The monthly cleaning needs both --hierarchy and --supply.")
            hierarchy, supply = read_lookup(spark, args.hierarchy), read_lookup(spark, args.supply)
            transform = lambda rows: enrich_monthly(rows, hierarchy, supply, args.as_of)
        shadows = args.shadows.split(",") if args.shadows else None
        done = csv_to_parquet(spark, args.input, args.output, args.compression, args.typed, transform, shadows)
        return f"{done.rows} rows from {done.total_files - done.skipped_files} file(s) to {done.output_path}; skipped {done.skipped_files}."
    if args.job == "create":
        names = [n.strip() for n in args.names.split(",")] if args.names else None
        rows = read_source(spark, args.input, not args.no_header, args.sheet, names)
        made = create_object(spark, args.object_name, rows, args.object_type, args.replace, args.month_label)
        return f"Created {made.kind} {made.name}."
    if args.job == "merge":
        return json.dumps(merge_folder(spark, args.input, args.output, not args.no_subfolders))
    payload = json.loads(args.spec)
    family = payload.pop("family", None)
    spec = QuerySpec.from_dict(payload)
    rows = union_family(spec, Family.from_dict(family), spark) if family else build(spec, spark)
    export_csv(rows, args.output)
    return f"Exported {args.output}."


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(SparkSession.builder.getOrCreate(), args))
    except SpecError as exc:
        print(exc, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
