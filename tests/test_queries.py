import collections
import json
import pathlib
import re

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from sparkloom.functions.normalize import normalized
from sparkloom.operators import analysis
from sparkloom.operators.cascade import LANGUAGES, tokenizer
from sparkloom.operators.detok import detokenizer
from sparkloom.plans import queries
from sparkloom.rules import HERE
from sparkloom.sources import lines as line_source

SF = "/root/testdata/sf0.001"
#: Queries whose result over the small tables may be empty.
MAY_BE_EMPTY: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    answer = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((plain(tuple(row[names.index(c)] for c in columns)) for row in answer.fetchall()), key=repr)
    assert got == want
    assert got or name in MAY_BE_EMPTY


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def made(spark):
    """(doc_id, line_no, lang, normalized text, tokens) of each line, by the tokenizer alone."""
    out = []
    for r in queries._cascade_input(spark, SF).withColumn("snt", F.coalesce(normalized(F.col("text")), F.lit(""))).collect():
        out.append((r.doc_id, r.line_no, LANGUAGES.get(r.lang, r.lang), r.snt, list(tokenizer(LANGUAGES.get(r.lang, r.lang), HERE, False)._line(r.snt))))
    return out


def test_tokens_match_whole_walks(spark, made):
    """Texts, types and annotations against the full cascade over each line, without cache, cuts or batches."""
    assert rows(queries.tokenize_full(spark, SF)) == sorted(((i, n, " ".join(t.surf for t in ts)) for i, n, _, _, ts in made), key=repr)
    back = {v: k for k, v in LANGUAGES.items()}
    types = collections.Counter((back[lang], t.type, t.sem_class) for *_, lang, _, ts in made for t in ts)
    assert {(r.lang, r.type, r.sem_class): r.n for r in queries.token_chart_types(spark, SF).collect()} == types
    want = {}
    for i, n, _, snt, ts in made:
        chart = [{"span": f"{t.start}-{t.end}", "type": t.type} | ({"sem-class": t.sem_class} if t.sem_class else {}) | {"surf": t.surf} for t in ts]
        want[i, n] = {"ID": str(i), "snt": snt, "chart": chart}
    assert {(r.doc_id, r.line_no): json.loads(r.json) for r in queries.annotation_json(spark, SF).collect()} == want
    text = lambda a: "\n".join([f"::line {a['ID']} ::s {a['snt']}", *(" ".join(f"::{k} {v}" for k, v in t.items()) for t in a["chart"])])
    assert {(r.doc_id, r.line_no): r.text for r in queries.annotation_double_colon(spark, SF).collect()} == {k: text(a) for k, a in want.items()}


def test_pages_match_whole_walks(spark):
    found = collections.Counter()
    walk = tokenizer("eng", HERE, False)
    for r in line_source.split_lines(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.col("html").alias("text")), "page_id").select("page_id", normalized(F.col("text")).alias("snt")).collect():
        found.update((r.page_id, t.type) for t in walk._line(r.snt))
    assert {(r.page_id, r.type): r.n for r in queries.tokenize_pages(spark, SF).collect()} == found


def test_detokenized_lines(spark, made):
    same = 0
    got = {(r.doc_id, r.line_no): (r.detokenized, r.same) for r in queries.detokenize_roundtrip(spark, SF).collect()}
    for i, n, lang, snt, ts in made:
        text = detokenizer(lang, HERE).string(" ".join(t.surf for t in ts))
        assert got.pop((i, n)) == (text, text == re.sub(r"[ \t\r\n\f\v]+", " ", snt).strip(" "))
        same += text == " ".join(snt.split())
    assert not got and same > 0.6 * len(made)


def test_rewrites_match_python(spark):
    lines = queries.every_line(spark, SF).collect()

    def unmarked(x):
        for pattern, by in ((r" @([-–—:/_]+)@ ", r"\1"), (r" @([-–—:/_]+)@(?= |$)", r"\1"), (r"((?<=^)|(?<= ))([-–—:/_]+)@ ", r"\2")):
            x = re.sub(pattern, by, x)
        return x

    assert rows(queries.detok_markup(spark, SF)) == sorted(((r.doc_id, r.line_no, unmarked(r.text)) for r in lines), key=repr)

    def boosted(x, chain):
        x = f" {x.strip(' ')} "
        for pattern, by in chain:
            x = regex.sub(pattern, by.replace("$", "\\"), x)
        return x.strip(" ")

    assert rows(queries.boost_rewrites(spark, SF)) == sorted(((r.doc_id, r.line_no, boosted(r.text, analysis.BOOST_TOKENS), boosted(r.text, analysis.BOOST_TEXT)) for r in lines), key=repr)


def test_each_query_is_checked():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"tokenize_full", "token_chart_types", "tokenize_pages", "annotation_json", "annotation_double_colon", "detokenize_roundtrip", "detok_markup", "boost_rewrites"}


def test_pushdown(spark):
    """Scans read the columns that a query needs, and no query over lines shuffles text."""
    plan = queries.token_type_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(read.split(",")) == {"lang:string", "text:string"}
    plan = queries.extract_emails(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rules_are_broadcast(spark):
    """A table of rules made in the driver is broadcast, so that n-grams aren't shuffled; one that is too large isn't."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(queries.rule_join_longest_match(spark, SF))
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found
    assert not analysis._small(spark.createDataFrame([(i,) for i in range(20)], "i int"), most=19)
