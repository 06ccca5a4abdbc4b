import itertools
import random

import numpy as np
import pytest

from sparkloom.llm import op9_sentencepiece as op

ROWS = "doc_id bigint, text string, ids string, exact int"
TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a\n", "a\nb c \n d", "é ½ x 漢字 🙂", "the the the", "x" * 300, "a▁b", "\ttab\r\nend", "word " * 50]


def expected(text):
    ids = op.model(op.MODEL).encode(text or "")
    return ids, op.model(op.MODEL).decode(ids) == (text or "")


@pytest.mark.parametrize(("giant", "cut"), [(1 << 16, 1 << 14), (4, 7), (0, 64)])
def test_ids_are_the_librarys(spark, giant, cut):
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(TEXTS + ["the the the"])] + [(12, "the the the", "y", 2)]
    got = op.encode(spark.createDataFrame(rows, ROWS).repartition(2), giant=giant, cut=cut).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] is None, r[0] or 0, expected(r[1])) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.ids, r.exact)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for giant in (1 << 16, 3000):
        got = op.encode(docs, giant=giant, cut=900).collect()
        assert len(got) == len(text)
        for r in got:
            assert r.ids == expected(text[r.doc_id])[0] and r.exact
            assert op.decode(r.ids) == text[r.doc_id]


def scanned(text, cut):
    """Ids by the scan alone, and the chunks with their states."""
    data = b" " + text.encode()
    chunks = [op.Chunk(data[low:high], low, a, b) for a, b, low, high in op.cut_points(data, cut)]
    found = op.boundary_states([c.transfer() for c in chunks])
    return [i for c, (s, e) in zip(chunks, found) for i in c.backtrace(s, e)], chunks, found


def test_scan_gives_the_librarys_ids_wherever_the_cuts_fall():
    r = random.Random(9)
    letters = "etaoinshrdlu éüñ漢字ß  .,'\n0123"
    texts = [t for t in TEXTS if t and "▁" not in t] + ["漢字" * 40, "internationalization" * 5, "私は日本語を話します。" * 5, "abab" * 30]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 120))) for _ in range(100)]
    for text in texts:
        for cut in (3, 5, 16):
            assert scanned(text, cut)[0] == expected(text)[0], (text, cut)


def test_matrices_decide():
    """Cuts within units have several states on either side, and only the scan tells which of them are right."""
    text = "internationalization" * 20
    ids, chunks, found = scanned(text, 37)
    assert ids == expected(text)[0] and sum(len(c.into) > 1 for c in chunks) > 5
    assert any(s for s, _ in found)
    made = [c.transfer() for c in chunks]
    assert any((~np.isfinite(m)).any() for m in made)
    # without what lies before and after a chunk, its states are open
    alone = [int(np.isfinite(m).any(1).sum()) for m in made]
    assert max(alone) > 1


def test_scan_finds_the_best_way():
    """Against all ways through random matrices of changing sizes."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = [1, *rng.integers(1, 5, 5), 1]
        made = [np.where(rng.random((x, y)) < 0.3, -np.inf, -rng.integers(1, 50, (x, y)).astype(float)) for x, y in itertools.pairwise(sizes)]
        total = lambda way: sum(m[a, b] for m, a, b in zip(made, way, way[1:]))
        best = max(map(total, itertools.product(*(range(n) for n in sizes))))
        if np.isfinite(best):
            states = op.boundary_states(made)
            assert all(x[1] == y[0] for x, y in itertools.pairwise(states))
            assert sum(m[s] for m, s in zip(made, states)) == best


def test_long_units_are_cut(spark):
    """A text over the default limit, without any space, is spread over chunks."""
    rows = [(1, "漢字かな交じり文" * 4000, "x", 1), (2, "x1" * 50_000, "x", 1), (2, "x1" * 50_000, "x", 1)]
    got = op.encode(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((r.doc_id, r.ids, r.exact) for r in got) == sorted((i, *expected(t)) for i, t, *_ in rows)
    assert all(len(op.cut_points(t.encode(), op.CUT_BYTES)) > 4 for _, t, *_ in rows)


def test_units_encoded_together_are_the_units():
    """Units of many in one text, line feeds among them, first and last, and none at all."""
    units = [b"\n", b" ", b"   ", b" the", b"the", "  é½漢🙂".encode(), b"\t\r", " ▁x".encode(), b"\x00", b"a" * 300] * 9
    for given in (units, units[1:], units[:1], units[3:] + units[:1], []):
        data = np.frombuffer(b"".join(given) + b"\n", np.uint8)
        lengths = np.array([len(u) for u in given], np.int64)
        ids, size = op._encode_spans(data, np.cumsum(lengths) - lengths, np.cumsum(lengths), op.MODEL)
        want = op._encode_units(given, op.MODEL)
        assert size.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_empty_table(spark):
    assert op.encode(spark.createDataFrame([], ROWS)).count() == 0
