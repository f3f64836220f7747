import json

from cantera import cli
from cantera.plans import garden
from cantera.sources import sinks


def run(capsys, *args):
    code = cli.main(list(args))
    got = capsys.readouterr()
    return code, got.out, got.err


def test_commands(spark, tmp_path, capsys):
    file = tmp_path / "g.bc3"
    file.write_bytes(garden.TEXT.encode("cp1252"))
    name = str(file)
    assert run(capsys, "validate", name)[:2] == (0, "2 families, 0 errors, 0 warnings\n")
    assert "combinations: 6" in run(capsys, "inspect", name, "GPA200")[1]
    item = json.loads(run(capsys, "resolve", name, "GPA100", "-s", "1,2")[1])
    assert item["code"] == "GPA100ab" and item["error"] is None and list(item)[:3] == ["code", "family", "unit"]
    code, out, err = run(capsys, "generate", name, "--chapter", "G#", "--include-invalid", "--limit", "5")
    lines = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [x["code"] for x in lines] == ["GPA100aa", "GPA100ab", "GPA100ba", "GPA100bb", "GPA200aa"] and "5 items written" in err
    out_file = tmp_path / "out.json"
    assert run(capsys, "generate", name, "--family", "GPA200$", "--format", "json", "--out", str(out_file), "--no-decomposition")[0] == 0
    assert [x["code"] for x in json.loads(out_file.read_text(encoding="utf-8"))] == ["GPA200ba", "GPA200bb", "GPA200ca", "GPA200cb"]
    assert run(capsys, "generate", name, "--range", "X..Y")[0] == 1
    assert run(capsys, "resolve", str(tmp_path / "none"), "X")[0] == 1


def test_validate_reports_faults(spark, tmp_path, capsys):
    file = tmp_path / "bad.bc3"
    file.write_text("~C|F$|u|x|\n~P|F$|1+1\n%A(2)=1|\n~P|G$|2+2\n|\n", encoding="utf-8")
    code, out, _ = run(capsys, "validate", str(file))
    assert code == 1 and "F$ line 2: " in out and "warning: G$ line 1: ignored stray expression '2+2'" in out and "2 families, 1 errors, 1 warnings" in out


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "x"), ("B", "y")], "chapter_name string, text string")
    sinks.write_chapters(df, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"chapter_name=A", "chapter_name=B"}
    sinks.write_documents(df, str(tmp_path / "d"), prefix="B", key="chapter_name")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    sinks.write_json_lines(df.selectExpr("text as value"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    sinks.write_duplicate_reports(df, df, df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "either")).count() == 2
