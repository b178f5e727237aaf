import json

from tablemill.__main__ import main


def test_jobs(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name\n1,Alice\n2,Bob\n")
    source = str(tmp_path / "in" / "a.csv")
    assert main(["convert", "--input", source, "--output", str(tmp_path / "a.parquet"), "--typed"]) == 0
    assert spark.read.parquet(str(tmp_path / "a.parquet")).schema["id"].dataType.simpleString() == "bigint"
    assert main(["create", "--input", source, "--object-name", "cli_people", "--object-type", "VIEW", "--replace"]) == 0
    spec = {"table": "cli_people", "select": ["name"], "filters": [{"column": "id", "operator": ">", "value": "1"}]}
    assert main(["query", "--spec", json.dumps(spec), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.text(str(tmp_path / "out")).collect() == [('"name"',), ('"Bob"',)]
    assert main(["merge", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "merged")]) == 0
    assert '"total_rows": 2' in capsys.readouterr().out
    assert main(["query", "--spec", json.dumps({"table": "cli_people", "select": ["nope"]}), "--output", str(tmp_path / "x")]) == 1
    assert "no column 'nope'" in capsys.readouterr().err
    family = {"table": "{{MASTER_TABLE}}", "select": ["id"], "family": {"month": "jan_2026", "regions": ["PVVNL", "KESCO"]}}
    for region, rows in (("PVVNL", [(1,)]), ("KESCO", [(2,)])):
        spark.createDataFrame(rows, "id int").createOrReplaceTempView(f"CM_master_data_jan_2026_{region}")
    assert main(["query", "--spec", json.dumps(family), "--output", str(tmp_path / "family")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "family")).count() == 2
