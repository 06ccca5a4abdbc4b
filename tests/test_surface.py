"""SQL functions, the command line and versions."""

import io
import json
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.functions import sql
from sparkloom.operators import analysis
from sparkloom.plans import queries
from sparkloom.sources.lines import read_text


def texts(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT tokenize('I can''t, Ann.', 'en') AS a, detokenize('I can n''t , Ann .', 'en') AS b, strip_diacritics('Éñ') AS c, tokenize(CAST(NULL AS STRING), 'en') AS d").first()
    assert tuple(row) == ("I can n't , Ann .", "I can't, Ann.", "en", None)
    rows = spark.sql("SELECT t.* FROM VALUES ('Pay $5.', 'en') AS v(x, g), LATERAL tokenize_table(x, g) AS t ORDER BY tok_no").collect()
    assert [(r.start, r.end, r.type, r.surf) for r in rows] == [(0, 3, "WORD-B", "Pay"), (4, 5, "PUNCT", "$"), (5, 6, "NUMBER", "5"), (6, 7, "PUNCT-E", ".")]


def test_older_rules(spark):
    df = spark.createDataFrame([("::token Nr. ::lc deu",), ("::token T-bar ::sem thing",), ("::abbrev x",)], "line string")
    assert [r[0] for r in df.select(sql.current_rule(F.col("line"))).collect()] == ["::abbrev Nr. ::lcode deu", "::lexical T-bar ::sem-class thing", "::abbrev x"]


def test_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("A1 She isn't in.\nA2\nA3 co-op \"x\"\n", encoding="utf-8")
    run = lambda *a: cli.main([*a], spark)
    run("tokenize", "-i", f"{tmp_path}/in.txt", "-o", f"{tmp_path}/tok", "--lc", "eng", "-f", "-a", f"{tmp_path}/ann")
    assert texts(spark, tmp_path / "tok") == ["A1 She is n't in .", "", "A3 co @-@ op \"@ x @\""]
    assert [json.loads(x)["ID"] for x in texts(spark, tmp_path / "ann")] == ["A1", "2", "A3"]
    run("tokenize", "-i", f"{tmp_path}/in.txt", "-o", f"{tmp_path}/tok2", "--simple", "-a", f"{tmp_path}/ann2", "--annotation-format", "double-colon")
    assert texts(spark, tmp_path / "tok2")[2] == "A3 co - op \" x \""
    assert texts(spark, tmp_path / "ann2")[0] == "::line 1 ::s A1 She isn't in."
    run("detokenize", "-i", f"{tmp_path}/tok", "-o", f"{tmp_path}/back", "--lc", "eng", "-f")
    assert texts(spark, tmp_path / "back") == ["A1 She isn't in.", "", "A3 co-op \"x\""]
    with pytest.raises(SystemExit):
        run("stem")


def test_command_line_streams(spark, tmp_path, capsys, monkeypatch):
    """STDIN and STDOUT, counts and annotation on STDERR, invalid bytes dropped."""
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO("She isn't in.\n\nwell-k".encode() + b"\xff" + "nown &nbsp;x\n".encode())}))
    cli.main(["tokenize", "--lc", "eng", "-v", "-c"], spark)
    shown = capsys.readouterr()
    assert shown.out.split("\n") == ["She is n't in .", "", "well @-@ known x", ""]
    assert "3 lines, 9 tokens, 1 lines normalized" in shown.err and [json.loads(x)["ID"] for x in shown.err.split("\n") if x.startswith("{")] == ["1", "2", "3"]


def test_lines_of_splits(spark, tmp_path):
    """Line numbers follow the file, wherever its splits fall."""
    for name in "ab":
        (tmp_path / f"{name}.txt").write_bytes(b"\n".join([f"{name} line {i}".encode() + b"\xfe" * (i % 7 == 0) for i in range(1, 3001)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = read_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r.path for r in rows}) == 2 and len(rows) == 6000
    assert all(r.text == f"{r.path[-5]} line {r.line_no}" for r in rows)


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    assert spark.read.parquet(analysis.snapshot(df, str(tmp_path), "1.0")).count() == 1
    with pytest.raises(Exception, match="already exists"):
        analysis.snapshot(df, str(tmp_path), "1.0")


def test_entry_leaves_out_what_cannot_be_imported(monkeypatch):
    import __spark_entry__ as entry

    whole = set(entry.queries())
    assert set(queries.QUERIES) <= whole
    if entry._llm is None:
        return
    monkeypatch.setitem(sys.modules, "sparkloom.llm.op4_compression", None)
    with pytest.warns(UserWarning, match="op4"):
        assert set(entry.queries()) == whole - {"op4_compression_bands"}
    with pytest.warns(UserWarning, match="op4"):
        assert "token_type_counts" in entry.oracle_sql()
