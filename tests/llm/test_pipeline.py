import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkloom.llm import op7_language
from tests.llm.test_op3 import brute as near_groups
from tests.llm.test_op6 import brute as leaks
from tests.llm.test_op9 import expected as encoded

SF = "/root/testdata/sf0.001"


def brute(spark):
    """The pipeline in plain Python; only the language decisions are the operator's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in op7_language.accepted(docs, docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in known)
    count = collections.Counter(x for _, t in rows for x in t.split("\n") if x.strip())
    seen, kept = set(), []
    for i, t in rows:
        out, lost, some = [], False, False
        for x in t.split("\n"):
            if x.strip() and count[x] > cp.LINE_COPIES and x in seen:
                lost = True
                continue
            seen.add(x)
            out.append(x)
            some = some or bool(x.strip())
        if some or not lost:
            kept.append((i, "\n".join(out)))
    gone = {g[k] for g in near_groups([t for _, t in kept]) for k in range(1, len(g))}
    kept = [r for n, r in enumerate(kept) if n not in gone]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return {i: encoded(t)[0] for i, t in kept if not leaks(t, items)}


def test_rows_match_brute_force(spark):
    got = {r.doc_id: r.ids for r in cp.run(spark, SF).collect()}
    assert len(got) > 50
    assert got == brute(spark)


def test_columns_and_odd_rows(spark):
    text = "The and that this for with on are as by the thatness. " * 3
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, None, None), (None, text, "en", "s", 5, "y"), (None, text, "en", "s", 5, "y"), (3, text + "more", "en", "s", 5, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    docs = docs.withColumns({c: F.lit("mine") for c in ("_h", "lines", "removed", "language", "cosine", "margin", "root", "chunk", "part")})
    for data in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, data, SF)
            assert out.columns == docs.columns
            assert all(r.lines == r.language == r._h == "mine" for r in out.collect())


@pytest.mark.parametrize("size", [5, 300])
def test_one_of_near_copies_stays_whatever_their_number(spark, size):
    """Copies edited at different lines, among documents that share a line of boilerplate only."""
    r = random.Random(size)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    passage = lambda: [r.choices(words, k=20) for _ in range(10)]
    first, rows = passage(), []
    for _ in range(size):
        copy = [list(x) for x in first]
        for _ in range(3):
            copy[r.randrange(10)][r.randrange(20)] = "".join(r.choices("klmnopqrst", k=6))
        rows.append("\n".join(" ".join(x) for x in copy))
    own = ["\n".join(" ".join(x) for x in passage()) for _ in range(8)]
    rows += [f"{x}\nthe same line below every text" for x in own]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    left = {x.doc_id: x.text for x in cp.near(spark, cp.lines(spark, docs, SF), SF).collect()}
    copies = [i for i in left if i < size]
    assert len(copies) == 1 and left[copies[0]] == rows[copies[0]]
    assert [left[size + i].startswith(x) for i, x in enumerate(own)] == [True] * 8
    assert sum("below every text" in t for t in left.values()) == 1
