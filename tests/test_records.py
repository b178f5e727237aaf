"""Large files with quoted line breaks, read by byte ranges, against the plain reader and csv module."""

import csv
import io
import random
from pathlib import Path

import pytest

from tablemill.sources.delimited import KEEP, read_csv, read_csv_set, scan_groups
from tablemill.sources.files import as_files
from tablemill.sources.records import cells_of, range_states

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    spark.conf.set(SPLIT, "2048")
    yield
    spark.conf.unset(SPLIT)


def awkward(draw, rows, width=3):
    """Records with quotes, delimiters and line breaks in cells, some of them much longer than a split."""
    pieces = ["a", "b ", '"', ",", ";", "\n", "\r\n", "é", "", "\n\n", '""', "x" * 50]
    out = io.StringIO(newline="")
    write = csv.writer(out, lineterminator="\n")
    write.writerow(["id", *(f"c{k}" for k in range(1, width))])
    table = []
    for k in range(rows):
        cells = ["".join(draw.choices(pieces, k=draw.randint(0, 400 if k % 97 == 5 else 8))) for _ in range(width - 1)]
        table.append([str(k), *cells])
        write.writerow(table[-1])
    return out.getvalue(), table


@pytest.mark.parametrize("seed", range(3))
def test_ranges_give_every_record_once(spark, tmp_path, small_splits, seed):
    text, table = awkward(random.Random(seed), 400)
    path = tmp_path / "big.csv"
    path.write_text(("﻿" if seed else "") + text, newline="")
    groups = scan_groups(spark, as_files(str(path)))
    assert len(groups) == 1 and groups[0].states is not None and groups[0].names == ("id", "c1", "c2")
    df = read_csv(spark, str(path), infer=False)
    assert df.rdd.getNumPartitions() > 5
    got = {r["id"]: (r["c1"] or "", r["c2"] or "") for r in df.collect()}
    assert len(got) == df.count() == len(table) and got == {i: (a, b) for i, a, b in table}


def test_same_rows_types_and_names_as_the_whole_file_reader(spark, tmp_path, rows):
    path = tmp_path / "in" / "typed.csv"
    path.parent.mkdir()
    body = "".join(f'{k},{k / 4},2024-01-{k % 28 + 1:02d},"note {k}\nof ""{k}"", it",{"" if k % 5 else chr(34) * 2}\n' for k in range(900))
    path.write_text("id,amount,day,note,blank\n" + body)
    whole = read_csv_set(spark, str(path), infer=True)
    expected = (whole.dtypes, rows(whole))
    spark.conf.set(SPLIT, "3000")
    try:
        split = read_csv_set(spark, str(path), infer=True)
        assert split.rdd.getNumPartitions() > 5 and (split.dtypes, rows(split)) == expected
        assert "MapInArrow" in split._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(SPLIT)


def test_wide_records_other_delimiters_and_stray_quotes(spark, tmp_path, small_splits):
    (tmp_path / "wide.csv").write_text("a;b\n" + "".join(f'{k};"x\n{k}";{"more" if k == 333 else ""}\n' if k == 333 else f'{k};"x\n{k}"\n' for k in range(500)))
    kept = read_csv_set(spark, str(tmp_path / "wide.csv"), filename=False, wide=KEEP)
    assert kept.columns == ["a", "b", "Column_3"] and kept.where("Column_3 = 'more'").count() == 1 and kept.count() == 500
    # Quotes within a cell, here inches, are no beginning of a quoted one.
    (tmp_path / "inch.csv").write_text("a,b\n" + "".join(f'{k},5" pipe\n' for k in range(400)) + 'q,"two\nlines"\n')
    inch = read_csv_set(spark, str(tmp_path / "inch.csv"), filename=False)
    assert inch.count() == 401 and inch.where("b = '5\" pipe'").count() == 400 and inch.where("b = 'two\nlines'").count() == 1


def test_carriage_returns_alone_fall_back_to_the_whole_file(spark, tmp_path, small_splits):
    (tmp_path / "mac.csv").write_bytes(b"a,b\r" + b"".join(b'%d,"x\ry"\r' % k for k in range(600)))
    groups = scan_groups(spark, as_files(str(tmp_path / "mac.csv")))
    assert [g.states for g in groups] == [None]


def test_cells_of_a_line():
    comma, wide = cells_of(","), cells_of("||")
    for line, inside, want in [
        (b'a,"b,c",d\n', False, (False, 2)), (b'a,"b,c\n', False, (True, 1)), (b'x,y",z\n', True, (False, 1)), (b'x""y,\n', True, (True, 0)),
        (b'"a""",b\n', False, (False, 1)), (b'"a""\n', False, (True, 0)), (b'5" x,"\n', False, (True, 1)), (b'"a"b"c,d\n', False, (False, 1)), (b"\n", True, (True, 0)),
    ]:
        assert comma.follow(line, inside) == want
    assert wide.follow(b'a|b||"c||\n', False) == (True, 1)


def test_states_of_a_file_without_line_breaks(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b," + "x" * 5000)
    states = range_states(spark, as_files(str(tmp_path / "one.csv")), (",",), 1000).orderBy("start").collect()
    assert len(states) == 6 and not any(s["inside"] for s in states) and {s["widest"] for s in states} == {3}


def test_texts_are_not_written_by_one_task(spark, tmp_path, monkeypatch):
    from workload import files

    monkeypatch.setattr(files, "FILE_BYTES", 1 << 20, raising=False)
    texts = [(k, f'"{k}"\n' + "word, " * 10_000 + "end", "en", None) for k in range(80)] + [(None, None, None, "s")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    place = files.scratch_path
    monkeypatch.setattr(files, "scratch_path", lambda *a: written.append(place(*a)) or written[-1])
    got = files.csv_split_records(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["chars"]) for r in got if r["doc_id"] is not None) == [(k, len(t)) for k, t, _, _ in texts[:-1]]
    sizes = [p.stat().st_size for p in Path(written[0]).glob("*.csv")]
    assert len(got) == 81 and len(sizes) > 3 and max(sizes) < 2 << 20
