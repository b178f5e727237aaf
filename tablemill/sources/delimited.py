"""CSV and TSV scans."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType, StructField, StructType

from tablemill.errors import SpecError
from tablemill.functions.casts import JAVA_SUFFIX
from tablemill.functions.inference import wider
from tablemill.plans.scope import column, quoted
from tablemill.sources.files import InputFile, as_files, literal_path
from tablemill.sources.heads import DETECT, candidates, heads, record_widths, unique_headers, wide_records
from tablemill.sources.records import range_states, read_records

# What happens to cells beyond the header: an error, or columns of their own.
REFUSE, KEEP = "refuse", "keep"
# Texts that count as missing in uploaded sheets.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession,
    source: str | list[str],
    header: bool = True,
    sep: str = DETECT,
    schema: StructType | None = None,
    infer: bool = True,
    sampling: float | None = None,
    wide: str = REFUSE,
    split: int | None = None,
) -> DataFrame:
    """Scan delimited files as one table. Types are inferred unless a schema is given.

    Inference reads the data once more; pass ``schema`` for large inputs, or ``sampling``
    to infer from a share of the rows. Gzipped files are read by their suffix.
    """
    infer = infer and schema is None
    return read_csv_set(spark, source, header, sep, filename=False, infer=infer, schema=schema, sampling=sampling, wide=wide, split=split)


def read_tsv(spark: SparkSession, source: str | list[str], header: bool = True, **options) -> DataFrame:
    return read_csv(spark, source, header=header, sep="\t", **options)


def read_csv_set(
    spark: SparkSession,
    source: str | list[str] | list[InputFile],
    header: bool = True,
    sep: str = DETECT,
    filename: bool = True,
    infer: bool = False,
    schema: StructType | None = None,
    sampling: float | None = None,
    wide: str = REFUSE,
    split: int | None = None,
) -> DataFrame:
    """Union of delimited files by column name; columns a file lacks are null.

    All columns are text unless ``infer`` or ``schema`` says otherwise, so ``DV_111368`` and
    ``123`` can share a column. ``filename`` adds the path of each row's file. Files with
    equal headers share one scan. ``wide`` says what becomes of cells beyond the header.
    Files with quoted line breaks of more than ``split`` bytes, the session's size of file splits
    unless given, are read by ranges of that size.
    """
    files = as_files(source)
    groups = scan_groups(spark, files, header, sep, wide, split)
    if not groups:
        raise SpecError("The input files hold no rows and no headers.")
    if infer:
        schema = infer_schema(spark, groups, header, sampling)
    return union_by_name([scan(spark, group, header, filename, schema) for group in groups])


def read_csv_lenient(
    spark: SparkSession, source: str | list[str], filename: bool = True, sep: str = DETECT
) -> DataFrame:
    """Text scan of files whose delimiters may differ and whose bytes may not all decode.

    With ``COMMA_FIRST`` commas are kept unless a line has more cells than the header.
    Undecodable bytes become replacement characters.
    """
    return read_csv_set(spark, source, sep=sep, filename=filename)


def union_by_name(parts: Iterable[DataFrame]) -> DataFrame:
    """Union as a balanced tree, so that its depth grows with the logarithm of the parts."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = (parts[i : i + 2] for i in range(0, len(parts), 2))
        parts = [reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pair) for pair in pairs]
    return parts[0]


def blank_missing(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Null for every text cell that spells a missing value, in all or the named columns."""
    chosen = set(df.columns if names is None else names)
    return df.select([
        F.when(~column(f.name).isin(*MISSING_WORDS), column(f.name)).alias(f.name)
        if f.name in chosen and isinstance(f.dataType, StringType)
        else column(f.name)
        for f in df.schema.fields
    ])


def with_headers(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename all columns by position."""
    names = [n.strip() for n in names if n.strip()]
    if len(names) != len(df.columns):
        raise SpecError(f"{len(names)} header names were given for {len(df.columns)} columns.")
    return df.toDF(*names)


@dataclass
class ScanGroup:
    """Files that one scan can read: same header, delimiter and record reader.

    ``states`` tells how the byte ranges of files begin that are read by ranges.
    """

    names: tuple[str, ...]
    sep: str
    multi_line: bool
    paths: list[str]
    states: DataFrame | None = None


@dataclass
class _Layout:
    """How the whole of one file looks: its header and widest record by delimiter."""

    mark: str
    headers: dict[str, tuple[str, ...]]
    widest: dict[str, int]
    multi_line: bool
    states: DataFrame | None = None

    def fits(self, mark: str) -> bool:
        return self.widest[mark] <= len(self.headers[mark])

    def settle(self) -> bool:
        """Whether no record has more cells than the header, by another delimiter if need be.

        A header that a delimiter leaves in one piece only counts if all of them do.
        """
        if not self.fits(self.mark):
            whole = max(map(len, self.headers.values())) == 1
            others = [m for m, cells in self.headers.items() if self.fits(m) and (whole or len(cells) > 1)]
            self.mark = max(others, key=lambda m: len(self.headers[m]), default=self.mark)
        return self.fits(self.mark)


def scan_groups(
    spark: SparkSession, files: list[InputFile], header: bool = True, sep: str = DETECT, wide: str = REFUSE, split: int | None = None
) -> list[ScanGroup]:
    """Group files by how they have to be read. Files without any record are left out.

    Delimiters are judged by all records of a file. Where records have more cells than the
    header by any delimiter, ``REFUSE`` names the files and counts those records, and
    ``KEEP`` gives the cells columns of their own, called ``Column_i``.
    """
    if wide not in (REFUSE, KEEP):
        raise SpecError(f"Wide records are handled by {REFUSE!r} or {KEEP!r}; got {wide!r}.")
    layouts = _layouts(spark, files, sep, split or split_bytes(spark))
    unfit = {path: layout for path, layout in layouts.items() if not layout.settle()}
    if unfit and wide == REFUSE:
        found = wide_records(spark, [(p, x.mark, len(x.headers[x.mark])) for p, x in unfit.items()])
        listed = ", ".join(f"{r['path']} ({r['n']})" for r in found.orderBy("path").limit(20).collect())
        raise SpecError(f"Records with more cells than their header in {len(unfit)} files: {listed}")
    members: dict[object, list[str]] = {}
    widths: dict[object, int] = {}
    for f in files:
        if f.path in layouts:
            layout = layouts[f.path]
            key = layout.headers[layout.mark], layout.mark, layout.multi_line, layout.states is not None
            members.setdefault(key, []).append(f.path)
            widths[key] = max(widths.get(key, 0), layout.widest[layout.mark])
    groups = []
    for key, paths in members.items():
        cells, mark, multi, _ = key
        cells = (*cells, *[""] * (widths[key] - len(cells)))
        names = tuple(unique_headers(cells) if header else (f"column{i}" for i in range(len(cells))))
        groups.append(ScanGroup(names, mark, multi, paths, layouts[paths[0]].states))
    return groups


def _layouts(spark: SparkSession, files: list[InputFile], sep: str, size: int) -> dict[str, _Layout]:
    """The layout of every file with a record: heads from its first bytes, widths from one pass over all lines.

    A line with an odd number of quotes may be part of a record with a quoted line break.
    Files with such lines are measured by records: large ones by byte ranges, small and gzipped
    ones whole. All others stay splittable by lines.
    """
    shared: dict[tuple[str, ...], tuple[str, ...]] = {}
    found: dict[str, _Layout] = {}
    for row in heads(spark, files, sep).toLocalIterator():
        cells = tuple(row["cells"])
        layout = found.setdefault(row["path"], _Layout("", {}, {}, True))
        layout.headers[row["mark"]] = shared.setdefault(cells, cells)
        layout.mark = row["mark"] if row["chosen"] else layout.mark
    if not found:
        return found
    marks = candidates(sep)
    listed = [f for f in files if f.path in found]
    for row in _line_widths(spark, listed, marks).filter(~F.col("odd")).toLocalIterator():
        if row["path"] in found:
            found[row["path"]].multi_line = False
            found[row["path"]].widest = {m: row[f"w{i}"] for i, m in enumerate(marks)}
    whole = [f for f in listed if found[f.path].multi_line]
    large = [f for f in whole if f.size > size and not f.name.lower().endswith(".gz")]
    if large:
        states = range_states(spark, large, marks, size)
        lone = set()
        for row in states.groupBy("path", "mark").agg(F.max("widest").alias("widest"), F.max("lone").alias("lone")).toLocalIterator():
            found[row["path"]].widest[row["mark"]] = row["widest"]
            found[row["path"]].states = states
            if row["lone"]:  # records may end in carriage returns
                lone.add(row["path"])
        for path in lone:
            found[path].states = None
        whole = [f for f in whole if found[f.path].states is None]
    if whole:
        for row in record_widths(spark, whole, marks).toLocalIterator():
            found[row["path"]].widest = dict(zip(marks, row["widest"]))
    return found


def split_bytes(spark: SparkSession) -> int:
    """The session's size of file splits."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def _line_widths(spark: SparkSession, files: list[InputFile], marks: tuple[str, ...]) -> DataFrame:
    """path, odd (a line has an odd number of quotes), and the most cells of a line for each delimiter."""
    lines = spark.read.text([literal_path(f.path) for f in files]).select(file_label().alias("path"), "value")
    odd = F.max(_occurrences(F.col("value"), '"') % 2 == 1).alias("odd")
    return lines.groupBy("path").agg(odd, *[F.max(_cells(m)).alias(f"w{i}") for i, m in enumerate(marks)])


def _occurrences(text: Column, mark: str) -> Column:
    """In bytes, so that undecodable text does not hide a mark."""
    lost = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))
    return (lost / len(mark.encode())).cast("int")


def _cells(mark: str) -> Column:
    """Cells of a line; marks inside of a quoted cell do not count."""
    value = F.col("value")
    quoted = rf'(^|{re.escape(mark)})"[^"]*+(?:""[^"]*+)*+"'
    bare = F.when(value.contains('"'), F.regexp_replace(value, quoted, "$1")).otherwise(value)
    return _occurrences(bare, mark) + 1


def file_label() -> Column:
    """The path of the file a row came from, as listed: decoded, without the local scheme."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def scan(
    spark: SparkSession, group: ScanGroup, header: bool = True, filename: bool = True, schema: StructType | None = None
) -> DataFrame:
    """Read one group of files, as text unless ``schema`` types a column."""
    names = group.names
    wanted = {f.name.lower(): f for f in schema.fields} if schema is not None else {}
    fields = [StructField(n, wanted[n.lower()].dataType if n.lower() in wanted else StringType()) for n in names]
    if group.states is not None:
        kinds = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
        records = read_records(group.states, group.paths, group.sep, header)
        cells = records.select(F.from_csv("record", kinds, _options(group, False)).alias("cells"), F.col("path").alias("__path"))
        rows = cells.select("cells.*", "__path")
        return rows.withColumnRenamed("__path", "filename") if filename else rows.drop("__path")
    df = _reader(spark, group, header).schema(StructType(fields)).csv([literal_path(path) for path in group.paths])
    return df.select("*", file_label().alias("filename")) if filename else df


def _options(group: ScanGroup, header: bool) -> dict[str, str]:
    return {
        "header": str(header).lower(),
        "sep": group.sep,
        "quote": '"',
        "escape": '"',
        "multiLine": str(group.multi_line).lower(),
        "enforceSchema": "true",
        "maxCharsPerColumn": "-1",
        "maxColumns": str(max(20480, len(group.names))),
        "mode": "PERMISSIVE",
    }


def _reader(spark: SparkSession, group: ScanGroup, header: bool) -> DataFrameReader:
    return spark.read.options(**_options(group, header))


def _inferred(spark: SparkSession, reader: DataFrameReader, group: ScanGroup, header: bool) -> StructType:
    """Spark's own inference over the files of a group, or over their records."""
    if group.states is None:
        return reader.csv([literal_path(path) for path in group.paths]).schema
    records = read_records(group.states, group.paths, group.sep, header).select("record")
    texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader.option("header", False)._jreader.csv(texts), spark).schema


def infer_schema(
    spark: SparkSession, groups: list[ScanGroup], header: bool = True, sampling: float | None = None
) -> StructType:
    """Types of all columns over all groups, by Spark's CSV inference.

    Whole numbers are bigint. Types of one column that differ between groups are widened.
    Inference also takes codes such as ``12D`` for numbers in Java's notation, so columns it
    calls double are looked over once more and stay text if they hold such codes.
    """
    types: dict[str, StructField] = {}
    for group in groups:
        reader = _reader(spark, group, header).option("inferSchema", True)
        if sampling:
            reader = reader.option("samplingRatio", sampling)
        found = _inferred(spark, reader, group, header).fields
        kinds = [LongType() if isinstance(f.dataType, IntegralType) else f.dataType for f in found]
        kinds += [StringType()] * (len(group.names) - len(kinds))
        doubles = [n for n, kind in zip(group.names, kinds) if isinstance(kind, DoubleType)]
        codes = _java_notation(scan(spark, group, header, filename=False), doubles) if doubles else set()
        for name, kind in zip(group.names, kinds):
            kind = StringType() if name in codes else kind
            known = types.setdefault(name.lower(), StructField(name, kind))
            types[name.lower()] = StructField(known.name, wider(known.dataType, kind))
    return StructType(list(types.values()))


def _java_notation(rows: DataFrame, names: list[str]) -> set[str]:
    """Columns with a number that ends in a type letter.

    All columns are tested together first, since hardly any data has such values.
    """
    together = F.concat_ws("\n", *[column(n) for n in names])
    if not rows.agg(F.max(together.rlike(rf"(?m){JAVA_SUFFIX}")).alias("hit")).first()["hit"]:
        return set()
    hits = rows.agg(*[F.max(column(n).rlike(JAVA_SUFFIX)) for n in names]).first()
    return {name for name, hit in zip(names, hits) if hit}
