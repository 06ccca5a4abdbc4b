import numpy as np
import pytest

from sparkloom.llm import op10_lines as op

ROWS = "doc_id bigint, text string, lines string, _h string, extra int"


def brute(rows, most=op.MAX_COPIES):
    """Texts without repeated lines, lines and removed ones, of (doc_id, text); equal rows are one document for the rule."""
    count, first = {}, {}
    order = {r: k for k, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, 0)))}
    for r in rows:
        for i, line in enumerate((r[1] or "").split("\n")):
            if line.strip(" \t\r\f\v"):
                count[line] = count.get(line, 0) + 1
                first[line] = min(first.get(line, (10**9, 0)), (order[r], i))
    out = []
    for r in rows:
        kept, lines, removed = [], 0, 0
        for i, line in enumerate((r[1] or "").split("\n")):
            real = bool(line.strip(" \t\r\f\v"))
            lines += real
            if real and count[line] > most and first[line] != (order[r], i):
                removed += 1
            else:
                kept.append(line)
        out.append((r[0], "\n".join(kept), lines, removed))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 2, 5])
def test_table_matches_brute_force(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in op.dedup(docs, most).select("doc_id", "text", "lines", "removed").collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], most)
    assert most > 1 or sum(r[3] for r in got) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a\nb\na\n \nb"), (5, "b\nc"), (5, "b\nc"), (6, "é\na"), (7, "c\n" * 40_000), (None, "é\nlast")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], ROWS).repartition(3)
    out = op.dedup(docs)
    assert out.columns == ["doc_id", "text", "_h", "extra", "lines", "removed"]
    assert sorted((tuple(r) for r in out.select("doc_id", "text", "lines", "removed").collect()), key=str) == brute(rows)
    assert op.dedup(docs.limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        index = op.PerfectHash(keys)
        assert sorted(index(keys).tolist()) == list(range(len(keys))) and index.size == len(keys)
