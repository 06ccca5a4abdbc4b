import random

import numpy as np
import pytest

from sparkloom.llm import op1_suffixes as op

ROWS = "doc_id bigint, text string, words int, bytes string"


def brute(rows, window=op.WINDOW):
    """Passages by counting all windows as tuples of words."""
    docs = []
    for i, t in rows:
        t = t or ""
        places, at, data = [], 0, t.encode()
        for w in data.split(b" " if False else None):
            at = data.index(w, at)
            places.append((at, at + len(w), w))
            at += len(w)
        docs.append((i, places))
    count = {}
    for _, p in docs:
        for k in range(len(p) - window + 1):
            key = tuple(x[2] for x in p[k : k + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for i, p in docs:
        covered = [k for k in range(len(p) - window + 1) if count[tuple(x[2] for x in p[k : k + window])] > 1]
        spans = []
        for k in covered:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + window
            else:
                spans.append([k, k + window])
        out += [(i, a, b - a, p[a][0], p[b - 1][1] - p[a][0]) for a, b in spans]
    return sorted(out, key=str)


def got(df, **more):
    return sorted((tuple(r) for r in op.passages(df, **more).collect()), key=str)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert len(want) > 20
    assert got(docs) == want


@pytest.mark.parametrize(("window", "head"), [(3, 1), (5, 5), (8, 20)])
def test_small_windows(spark, window, head):
    r = random.Random(window)
    rows = [(i % 7 or None, " ".join(r.choice("abcdé") for _ in range(r.randint(0, 30))), 1, "x") for i in range(40)]
    rows += [(1, None, 1, "x"), (2, "", 1, "x"), (3, "  \n\t ", 1, "x"), (4, "\n a  b\tc a b c a b c", 1, "x"), (4, "\n a  b\tc a b c a b c", 1, "x"), (5, "z " * 3000, 1, "x")]
    docs = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(docs, window=window, head=head) == brute([r[:2] for r in rows], window)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], ROWS)) == []


def test_equal_digits_of_different_windows_do_not_meet():
    keys = np.array([5, 5, 7, 7, 9, 9], np.uint64)
    extra = np.array([(1, False), (2, False), (3, False), (3, False), (4, True), (5, False)], op._EXTRA)
    assert op._met_pairs(keys, extra).tolist() == [False, False, True, True, True, False]


def test_a_very_long_text(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, "other " + " ".join(words[140_000:140_060]))]
    got = {tuple(r)[:3] for r in op.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {x for x in got if x[0] == 2} == {(2, 1, 60)}
    # the words come again after 100,003 of them
    assert {x for x in got if x[0] == 1} == {(1, 0, 49_997), (1, 100_003, 49_997)}
