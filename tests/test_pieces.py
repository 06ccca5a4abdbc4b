"""Normalization, sources, sinks, analytics and streams on small rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sparkloom.functions import normalize
from sparkloom.operators import analysis
from sparkloom.operators.cascade import tokenized
from sparkloom.sources import lines, sinks
from sparkloom.streaming import tokens as streams


def applied(spark, f, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_normalization(spark):
    cases = [("a&nbsp;b&#160;c&#XA0;d", "a b c d"), ("5 µm․", "5 μm."), ("Ã±andÂº", "ñandº"), ("Âº", "Âº"), ("\x93x\x94", "“x”"), ("a፡b", "a b"), ("a፡፡b", "a፡፡b"), ("a­b﻿\x01", "ab"), ("x y", "x y"), ("می‌خواهم", "می‌خواهم"), ("a‌ b", "a b"), ("‍a", "a"), ("a️b ☀️", "ab ☀️"), ("", ""), (None, None)]
    assert applied(spark, normalize.normalized, [a for a, _ in cases]) == [b for _, b in cases]
    assert applied(spark, normalize.even_lower, ["İX", "ab"]) == ["ix", "ab"]


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo \xff\n\nfour\n")
    got = [(r.line_no, r.text) for r in lines.read_text(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(1, "one"), (2, "two "), (3, ""), (4, "four")]
    assert applied(spark, lines.line_id, ["S1 a b ", "S1", "S1 ", ""]) == ["S1", None, None, None]
    assert applied(spark, lines.sentence, ["S1  a b ", "S1 x"]) == ["a b", "x"]


def test_annotations(spark, tmp_path):
    df = tokenized(spark.createDataFrame([("L1", 'Dr. Lee isn\'t "in".', "en")], "id string, text string, lang string"))
    js = df.select("id", sinks.annotation(F.col("id"), F.col("snt"), F.col("tokens")).alias("j"), sinks.double_colon(F.col("id"), F.col("snt"), F.col("tokens")).alias("d"))
    row = js.withColumn("again", sinks.annotation_to_double_colon(F.col("j"))).first()
    assert row.d == row.again and row.d.startswith("::line L1 ::s Dr. Lee") and row.d.split("\n")[1].split(" ::")[1:] == ["type ABBREV", "sem-class pre-name-title", "surf Dr."]
    made = json.loads(row.j)
    assert made["ID"] == "L1" and made["chart"][1] == {"span": "4-7", "type": "WORD-B", "surf": "Lee"}
    blocks = sinks.blocks(spark.createDataFrame([(1, i, t) for i, t in enumerate(["::line a", "x", "::line b", "y", "z"])], "f int, line_no int, text string"), "f")
    assert [r.block for r in blocks.orderBy("line_no").collect()] == [1, 1, 2, 2, 2]
    sinks.write_tokens(df, str(tmp_path / "out"), "id")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Dr. Lee is n't \"@ in @\" ."]


def test_analytics(spark):
    words = spark.createDataFrame([(1, i, s, "WORD-B") for i, s in enumerate(["deMo", "MacArthur", "a1", "b-c", "x", "7", "!", "deMo"])], "line int, tok_no int, surf string, type string")
    names = lambda df: sorted(r.surf for r in df.collect())
    assert names(analysis.case_anomaly(words)) == ["deMo", "deMo"]
    assert names(analysis.number_anomaly(words)) == ["a1"]
    assert names(analysis.punct_anomaly(words)) == ["b-c"]
    near = analysis.neighbours(words, "line")
    assert [(r.near, r.number) for r in analysis.around_numbers(near, "after").collect()] == [("!", "d")]
    ranked = analysis.ranked(spark.createDataFrame([("s", i) for i in range(15)], "surf string, at int"), "at").first()
    assert (ranked.n, ranked.locations, ranked.more) == (15, list(range(10)), True)
    assert analysis.top(analysis.frequency(words), 1).first().surf == "deMo"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "She can't, can she?", "en"), (2, "Vamos al mar.", "es"), (3, "plain words", None)]
    batch = spark.createDataFrame(rows, "id int, text string, lang string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = streams.token_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("token_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("token_stream").collect()), key=str) == sorted(map(tuple, streams.token_stream(batch).collect()), key=str)


def test_windows_leave_late_rows_out(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for n, minutes in enumerate(([0, 5, 70], [600], [3, 601])):
        spark.createDataFrame([(t + dt.timedelta(minutes=m), "k") for m in minutes], "ts timestamp, key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.windowed_counts(spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "in")), "ts", "key", "1 hour", late="1 hour")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (t, 2) in got and (t + dt.timedelta(hours=1), 1) in got
    sessions = streams.session_counts(spark.createDataFrame([(t, "a"), (t + dt.timedelta(minutes=10), "a"), (t + dt.timedelta(minutes=50), "a")], "ts timestamp, key string"), "ts", "key")
    assert sorted(r.n for r in sessions.collect()) == [1, 2]


def test_boost_chains(spark):
    """Tokens and texts of different styles come out the same."""
    from sparkloom.operators import analysis

    cases = [
        ("a", "wow ! ! ! well @-@ known @\" hi \"@ @...", 'wow !!! well - known " hi " ...'), ("a", "didn 't ca n't wo n't cannot", "did n't can n't will n't can not"),
        ("a", "don 't didn ’t we ' ll", "do n't did n’t we 'll"), ("a", "father @-@ in @-@ law l 'eau", "father - in - law l' eau"),
        ("b", "well @-@ known , yes .", "well-known, yes."), ("b", "a ( b ) costs $ 5 or 5 % now", "a (b) costs $5 or 5% now"), ("b", "he 's here ; do n't can not go", "he's here; don't cannot go"), ("b", "x\u0092y&#160;z", "x’y z"),
    ]
    df = spark.createDataFrame([(i, k, x) for i, (k, x, _) in enumerate(cases)], "i int, k string, x string")
    got = {r.i: (r.a if r.k == "a" else r.b) for r in df.select("i", "k", analysis.boosted(F.col("x")).alias("a"), analysis.boosted_text(F.col("x")).alias("b")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_block_context(spark):
    import difflib

    from sparkloom.operators import analysis

    left = {"a": list("pqrstuvwxyz"), "b": ["same"], "c": ["only", "old"]}
    right = {"a": list("pqrstXvwxyz"), "b": ["same"], "d": ["only new"]}
    frame = lambda d: spark.createDataFrame([(k, i, x) for k, v in d.items() for i, x in enumerate(v)], "block string, line_no int, text string")
    got = {r.block: r["diff"] for r in analysis.block_context(frame(left), frame(right)).collect()}
    assert got == {k: "\n".join(list(difflib.unified_diff(left.get(k, []), right.get(k, []), n=3, lineterm=""))[2:]) for k in "acd"}
    assert got["a"].count("\n") == 8


def test_merged_rules_in_order(spark):
    from sparkloom.operators import analysis

    cols = "kind string, head string, target string, sem_class string, tag string"
    a = spark.createDataFrame([("lexical", "b", "", "x", ""), ("abbrev", "Z.", "", None, "t"), ("abbrev", "A.", "", "m", "")], cols)
    b = spark.createDataFrame([("lexical", "a", "", "x", ""), ("misspelling", "teh", "the", None, None), ("abbrev", "A.", "", None, "")], cols)
    merged = analysis.merge_rules(a, b)
    assert [r.head for r in analysis.in_rule_order(merged).collect()] == ["Z.", "A.", "teh", "a", "b"]
    assert [r.value for r in analysis.rule_text(merged).collect()] == ["::abbrev Z. ::tag t", "::abbrev A. ::sem-class m", "::misspelling teh ::target the", "# ::lexical a ::sem-class x", "::lexical b ::sem-class x"]


def test_reverse_index_and_versions(spark, tmp_path):
    from sparkloom.operators import analysis
    from sparkloom.sources import rule_files

    index = {r.target: r.heads for r in rule_files.reverse_index(rule_files.rule_table(spark, "eng")).collect()}
    assert "can't" in index["can n't"] and "cant" in index["can n't"]
    df = spark.range(2)
    for _ in range(11):
        analysis.update_snapshot(df, f"{tmp_path}/kept")
    assert analysis.versions(spark, f"{tmp_path}/kept") == [str(i) for i in range(1, 12)]
