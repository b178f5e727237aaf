import gzip
import io
import zipfile

import pytest

from tablemill import SpecError
from tablemill.functions.inference import infer_types
from tablemill.sources.containers import read_xlsx, read_zip
from tablemill.sources.delimited import blank_missing, read_csv, read_csv_lenient, read_csv_set, read_tsv, with_headers
from tablemill.sources.files import clean_path, list_files, resolve_inputs
from tablemill.sources.folders import conflicting_columns, detect_columns, merge_folder, merge_frame
from tablemill.sources.heads import COMMA_FIRST, sniff, unique_headers
from tablemill.sources.parquet import check_codec, csv_to_parquet, finished_sources, read_parquet_set, target_name


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = text if isinstance(text, bytes) else text.encode()
    path.write_bytes(gzip.compress(data) if path.name.endswith(".gz") else data)
    return str(path)


def names(files):
    return [f.relative for f in files]


# Paths -------------------------------------------------------------------------------

def test_resolving_files_folders_and_patterns(tmp_path):
    root = tmp_path / "in put"
    put(root / "a.csv", "x\n1\n")
    put(root / "sub" / "b.csv", "x\n2\n")
    put(root / "sub" / "c.gz", "x\n3\n")
    assert names(resolve_inputs(f' "{root}/a.csv" ')) == ["a.csv"]
    assert names(resolve_inputs(str(root))) == ["sub/c.gz"]
    assert names(resolve_inputs(f"{root}/*.csv")) == ["a.csv"]
    assert names(resolve_inputs(f"{root}/**/*.csv")) == ["a.csv", "sub/b.csv"]
    assert names(resolve_inputs(f"{root}/*.gz")) == ["sub/c.gz"]
    assert names(resolve_inputs(f"{root}/sub/c.csv.gz")) == ["c.gz"]
    assert names(resolve_inputs(f"{root}/a.csv.gz")) == ["a.csv"]
    assert names(resolve_inputs(f"{root}/*.csv.gz")) == ["sub/c.gz"]
    assert names(resolve_inputs(f"file://{root}/a.csv")) == ["a.csv"]
    for missing in (f"{root}/*.tsv", f"{root}/none.csv", ""):
        with pytest.raises(SpecError):
            resolve_inputs(missing)
    assert clean_path("\u00a0'C:\\data\\x.csv' ") == "C:/data/x.csv"


def test_unreadable_parquet_is_left_out(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, name string").coalesce(1).write.parquet(str(tmp_path / "north"))
    put(tmp_path / "tmp_1.parquet", b"x" * 40)
    put(tmp_path / "short.parquet", b"tiny")
    files = resolve_inputs(str(tmp_path))
    assert len(files) == 1 and files[0].relative.startswith("north/part-")
    assert read_parquet_set(spark, str(tmp_path)).collect() == [(1, "a")]
    assert len(list_files(f"{tmp_path}/*.parquet")) == 2


# CSV ---------------------------------------------------------------------------------

def test_types_are_inferred(spark, tmp_path):
    put(tmp_path / "t.csv", "id,name,amount,ok,day,mix\n1,Alice,1.5,true,2024-01-02,123\n2,,2,false,2024-01-03,DV_111368\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "amount": "double", "ok": "boolean", "day": "date", "mix": "string"}
    assert df.filter("name is null").count() == 1
    put(tmp_path / "codes.csv", "code,big,e,void\n1D,12345678901234567890,1e3,\n2F,7,Inf,\n")
    codes = read_csv(spark, str(tmp_path / "codes.csv"))
    assert dict(codes.dtypes) == {"code": "string", "big": "decimal(20,0)", "e": "double", "void": "string"}
    assert sorted(r["code"] for r in codes.collect()) == ["1D", "2F"]
    put(tmp_path / "two" / "a.csv", "k,v\n1,1\n")
    put(tmp_path / "two" / "b.csv", "v,k\n1.5,x\n")
    both = read_csv(spark, str(tmp_path / "two"))
    assert dict(both.dtypes) == {"k": "string", "v": "double"}
    assert sorted(both.select("k", "v").collect()) == [("1", 1.0), ("x", 1.5)]
    assert dict(read_csv(spark, str(tmp_path / "t.csv"), sampling=1.0).dtypes)["amount"] == "double"
    assert dict(read_csv(spark, str(tmp_path / "t.csv"), infer=False).dtypes)["id"] == "string"


def test_no_header_and_tsv(spark, tmp_path):
    put(tmp_path / "t.tsv", "1\tx\n2\ty\n")
    df = read_tsv(spark, str(tmp_path / "t.tsv"), header=False)
    assert df.columns == ["column0", "column1"] and sorted(df.collect()) == [(1, "x"), (2, "y")]
    assert with_headers(df, ["a", " b "]).columns == ["a", "b"]
    with pytest.raises(SpecError):
        with_headers(df, ["a"])


def test_files_with_other_headers_are_united_by_name(spark, tmp_path, rows):
    put(tmp_path / "1.csv", "A,B\n1,2\n")
    put(tmp_path / "2.csv", "B,C\n3,4\n")
    put(tmp_path / "3.csv", "c,a\n5,6\n")
    put(tmp_path / "4.csv", "")
    df = read_csv_set(spark, f"{tmp_path}/*.csv")
    assert df.columns == ["A", "B", "filename", "C"]
    assert rows(df.select("A", "B", "C", "filename")) == [
        ("1", "2", None, f"{tmp_path}/1.csv"), ("6", None, "5", f"{tmp_path}/3.csv"), (None, "3", "4", f"{tmp_path}/2.csv")]


def test_awkward_paths_and_bom(spark, tmp_path):
    path = put(tmp_path / "a b+c%20é.csv", "\ufeffid,v\n1,x\n")
    assert read_csv_set(spark, path).collect() == [("1", "x", path)]
    odd = put(tmp_path / "odd" / "b[1]{x}*?.csv", "id,v\n2,y\n")
    assert read_csv_set(spark, odd).collect() == [("2", "y", odd)]
    assert read_csv_set(spark, str(tmp_path / "odd")).collect() == [("2", "y", odd)]


def test_gzip_by_either_ending(spark, tmp_path, rows):
    put(tmp_path / "a.csv.gz", "id,name\n1,Alice\n")
    put(tmp_path / "b.gz", "id,name\n2,Bob\n")
    assert rows(read_csv_set(spark, f"{tmp_path}/*.gz", filename=False)) == [("1", "Alice"), ("2", "Bob")]


def test_quoted_line_breaks_in_small_and_large_files(spark, tmp_path):
    body = "id,note\n" + "".join(f'{i},"line {i}\nwith ""quotes"", commas"\n' for i in range(500))
    put(tmp_path / "breaks.csv", body)
    put(tmp_path / "plain.csv", "id,note\n" + "".join(f"{i},x\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv_set(spark, f"{tmp_path}/*.csv")
        assert df.filter("filename like '%breaks.csv'").count() == 500
        plain = df.filter("filename like '%plain.csv'")
        assert plain.count() == 5000
        assert read_csv_set(spark, str(tmp_path / "plain.csv")).rdd.getNumPartitions() > 1
        assert df.filter("id = 7 and note like 'line 7%'").first()["note"] == 'line 7\nwith "quotes", commas'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_delimiters_are_detected_per_file(spark, tmp_path, rows):
    put(tmp_path / "a.csv", 'id;name\n1;"x;,y"\n')
    put(tmp_path / "b.csv", "id|name\n2|z\n")
    put(tmp_path / "c.csv", b"id,name\n3,\xff\n")
    assert rows(read_csv_lenient(spark, f"{tmp_path}/*.csv", filename=False)) == [("1", "x;,y"), ("2", "z"), ("3", "\ufffd")]
    # Commas are kept unless some line has too many of them.
    lenient = read_csv_lenient(spark, f"{tmp_path}/*.csv", filename=False, sep=COMMA_FIRST)
    assert lenient.columns == ["id", "name", "id|name"] and lenient.count() == 3
    assert sniff("a\nb\n") == "," and sniff("a,b;c\n1,2;3\n") == "," and sniff("a;b;c\n1,5;2;3\n") == ";"
    assert sniff("", ",") == ","


def test_missing_words(spark, rows):
    df = spark.createDataFrame([("NA", "n/a", 1), ("N", "null", 2)], "a string, b string, c int")
    assert rows(blank_missing(df)) == [("N", None, 2), (None, None, 1)]
    assert rows(blank_missing(df, ["b"])) == [("N", None, 2), ("NA", None, 1)]


def test_headers_are_made_unique():
    assert unique_headers(["A", "A", ""]) == ["A", "A_2", "Column_3"]
    assert unique_headers([" a ", "A", "a_2", None, "a"]) == ["a", "A_2", "a_2_2", "Column_4", "a_3"]


# Parquet -----------------------------------------------------------------------------

def test_conversion_keeps_folders_and_skips_what_is_done(spark, tmp_path, rows):
    source, target = tmp_path / "in", str(tmp_path / "out")
    put(source / "north" / "a.csv.gz", "KNO,VALUE\n123,1\nDV_111368,2\n")
    put(source / "b.csv", "KNO,EXTRA\n5,x\n")
    put(source / "empty.csv", "")
    first = csv_to_parquet(spark, f"{source}/**/*.*", target)
    assert (first.total_files, first.skipped_files, first.rows) == (3, 1, 3)
    assert finished_sources(target) == {"north/a.parquet", "b.parquet"}
    # A run that died in its commit leaves a part of its rows, and no record.
    put(tmp_path / "out" / "source_file=c.parquet" / "part-0.snappy.parquet", "")
    put(source / "c.csv", "KNO\n6\n")
    second = csv_to_parquet(spark, f"{source}/**/*.*", target)
    assert (second.total_files, second.skipped_files, second.rows) == (4, 3, 1)
    df = spark.read.option("mergeSchema", True).parquet(target)
    assert rows(df.select("KNO", "VALUE", "EXTRA", "source_file")) == [
        ("123", "1", None, "north/a.parquet"), ("5", None, "x", "b.parquet"), ("6", None, None, "c.parquet"), ("DV_111368", "2", None, "north/a.parquet")]


def test_single_file_conversion(spark, tmp_path):
    source = put(tmp_path / "t.csv", "id,v\n1,x\n")
    out = str(tmp_path / "made" / "t.parquet")
    assert csv_to_parquet(spark, source, out, "snappy", typed=True, transform=lambda df: df.drop("filename")).rows == 1
    assert spark.read.parquet(out).collect() == [(1, "x")]
    assert csv_to_parquet(spark, source, out).skipped_files == 1


@pytest.mark.parametrize("codec", ["uncompressed", "snappy", "gzip", "zstd", "lz4"])
def test_codecs(spark, tmp_path, codec):
    source = put(tmp_path / "t.csv", "id\n1\n")
    assert csv_to_parquet(spark, source, str(tmp_path / "out"), codec.upper()).rows == 1


def test_codec_names():
    assert [target_name(n) for n in ("a.csv", "x/b.csv.gz", "c.gz", "d.2024.csv")] == ["a.parquet", "x/b.parquet", "c.parquet", "d.2024.parquet"]
    for bad in ("brotli", "rar", ""):
        with pytest.raises(SpecError):
            check_codec(bad)


def test_parquet_types_are_widened(spark, tmp_path, rows):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "1"))
    spark.createDataFrame([(2**40, 1.5)], "a long, b double").write.parquet(str(tmp_path / "2"))
    spark.createDataFrame([("x", True)], "c string, b boolean").write.parquet(str(tmp_path / "3"))
    df = read_parquet_set(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    assert rows(df.select("a", "c")) == [(1, None), (2**40, None), (None, "x")]


# Archives and workbooks --------------------------------------------------------------

def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="Data" sheetId="1" r:id="a"/><sheet name="More" sheetId="2" r:id="b"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>day</t></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format(
            '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
            '<row r="2"><c r="A2"><v>1.0</v></c><c r="B2" t="inlineStr"><is><t>Alice</t></is></c><c r="C2" s="1"><v>45579</v></c></row>'
            '<row r="4"><c r="A4"><v>2.5</v></c><c r="C4" t="e"><v>#N/A</v></c></row>'))
        book.writestr("xl/worksheets/sheet2.xml", SHEET.format('<row><c t="str"><v>flag</v></c></row><row><c t="b"><v>1</v></c></row>'))
    return out.getvalue()


def test_workbooks(spark, tmp_path, rows):
    path = put(tmp_path / "book.xlsx", workbook())
    every = read_xlsx(spark, path, all_sheets=True)
    assert every.columns == ["SOURCE_FILE", "SOURCE_SHEET", "id", "name", "day", "flag"]
    assert rows(every) == [
        ("book.xlsx", "Data", "1", "Alice", "2024-10-14 00:00:00", None), ("book.xlsx", "Data", "2.5", None, None, None),
        ("book.xlsx", "Data", None, None, None, None), ("book.xlsx", "More", None, None, None, "True")]
    typed = read_xlsx(spark, path)
    assert dict(typed.dtypes) == {"id": "double", "name": "string", "day": "timestamp_ntz"}
    assert read_xlsx(spark, path, sheet="More").collect() == [(True,)]
    with pytest.raises(SpecError):
        read_xlsx(spark, path, sheet="None")


def test_archives_and_nested_members(spark, tmp_path, rows):
    inner = zipped(deep_dot_csv="id,v\n3,c\n")
    put(tmp_path / "box.zip", zipped(a_dot_csv="id,v\n1,a\n", x__b_dot_csv_dot_gz=gzip.compress(b"id,w\n2,b\n"), in_dot_zip=inner,
                                     readme_dot_txt="skip", empty_dot_csv=""))
    df = read_zip(spark, str(tmp_path / "box.zip"))
    assert rows(df.select("SOURCE_FILE", "id", "v", "w")) == [
        ("box.zip::a.csv", "1", "a", None), ("box.zip::in.zip::deep.csv", "3", "c", None), ("box.zip::x/b.csv.gz::b.csv", "2", None, "b")]


def test_folder_merge(spark, tmp_path, rows):
    root = tmp_path / "in"
    put(root / "1.csv", "A,A,\n1,2,3\n")
    put(root / "2" / "two.csv.gz", "B,A\nNA,5\n")
    put(root / "3.zip", zipped(m_dot_csv="C\n7\n"))
    put(root / "4.xlsx", workbook())
    put(root / "notes.txt", "skip")
    put(root / "5.csv", "A\n")
    merged = merge_frame(spark, str(root))
    assert (merged.total_files, merged.merged_items) == (5, 6)
    assert merged.rows.columns == ["SOURCE_FILE", "SOURCE_SHEET", "A", "A_2", "Column_3", "B", "C", "id", "name", "day", "flag"]
    seen = rows(merged.rows.select("SOURCE_FILE", "SOURCE_SHEET", "A", "B", "C").filter("SOURCE_SHEET = 'Sheet1'"))
    assert seen == [("1.csv", "Sheet1", "1", None, None), ("3.zip::m.csv", "Sheet1", None, None, "7"), ("two.csv.gz::two.csv", "Sheet1", "5", None, None)]
    out = str(tmp_path / "out")
    stats = merge_folder(spark, str(root), out)
    assert (stats["total_rows"], stats["total_columns"], stats["merged_items"]) == (7, 11, 6)
    assert read_csv_set(spark, f"{out}/*.csv", filename=False).count() == 7
    flat = merge_frame(spark, str(root), recursive=False)
    assert flat.total_files == 4
    for bad in (str(tmp_path / "none"), str(tmp_path / "out")):
        with pytest.raises(SpecError):
            merge_frame(spark, bad) if bad.endswith("none") else merge_frame(spark, str(put(tmp_path / "void" / "a.txt", "x"))[:-6])


def test_legacy_workbooks_are_refused(spark, tmp_path):
    put(tmp_path / "old" / "a.xls", b"x")
    with pytest.raises(Exception, match="legacy workbooks"):
        merge_frame(spark, str(tmp_path / "old"))


def test_detected_columns(spark, tmp_path):
    put(tmp_path / "a.csv", "id,name\n" + ",\n" + "".join(f"{i},n{i}\n" for i in range(200)))
    put(tmp_path / "b.csv", "id\n7\n")
    found = detect_columns(spark, f"{tmp_path}/*.csv")
    assert {(r["source_file"], r["name"]): r["sample_values"] for r in found.collect()} == {
        ("a.csv", "id"): ["0", "1", "2", "3", "4"], ("a.csv", "name"): ["n0", "n1", "n2", "n3", "n4"], ("b.csv", "id"): ["7"]}
    assert conflicting_columns(found).collect() == [("id", 2)]


def test_text_columns_get_the_type_all_values_fit(spark):
    df = spark.createDataFrame([
        ("1", " 2 ", "1", "true", "2024-01-01", "2024-01-01", "2024-13-01", None, "12345678901234567890"),
        ("-3", "2.5", "x", "FALSE", "2024-01-02", "2024-01-01 10:00", "2024-01-01", None, "1"),
    ], "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    typed = infer_types(df)
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string", "boolean", "date", "timestamp_ntz", "string", "string", "string"]
    assert sorted(r["b"] for r in typed.collect()) == [2.0, 2.5]
