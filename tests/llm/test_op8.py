import math

import numpy as np
import pytest

from sparkloom.llm import op8_range_coder as op
from sparkloom.llm import op9_sentencepiece as pieces

ROWS = "doc_id bigint, text string, block string, n int"


@pytest.mark.parametrize("seed", range(6))
def test_blocks_come_back(seed):
    rng = np.random.default_rng(seed)
    v = [2, 300, 100_000][seed % 3]
    made = [rng.integers(0, v, n) for n in (1, 63, 64, 65, 700, 0)] + [np.zeros(900, np.int64), np.tile(rng.integers(0, v, 7), 80), np.minimum(rng.zipf(1.3, 500), v) - 1]
    for ids, payload in zip(made, op.encode_blocks(made, v)):
        assert (op.decode_block(payload, len(ids), v) == ids).all()


def brute(ids, v):
    """Start and width of each id, by counting again for each."""
    out = []
    for t, x in enumerate(ids):
        low, high, left = x, x + 1, op.TOTAL - v
        for k in (2, 1, 0):
            after = [ids[s] for s in range(k, t) if list(ids[s - k : s]) == list(ids[t - k : t])] if t >= k else []
            if after:
                w = left * len(after) // (len(after) + op.ESCAPE[k] * len(set(after)))
                low += w * sum(y < x for y in after) // len(after)
                high += w * sum(y <= x for y in after) // len(after)
                left -= w
        out.append((low + left * x // v, high + left * (x + 1) // v - low - left * x // v))
    return out


def exact(parts):
    """The payload by one number of any length, without carries or words."""
    low, span, words = 0, (1 << 64) - 1, 2
    for start, size in parts:
        part = span >> op.TOTAL_BITS
        low, span = low + part * start, part * size
        while span < 1 << 32:
            low, span, words = low << 32, span << 32, words + 1
    return low.to_bytes(4 * words, "big")


@pytest.mark.parametrize("v", [40, 70_000])
def test_intervals_match_brute_force(v):
    rng = np.random.default_rng(v)
    made = [np.minimum(rng.zipf(1.4, 400), v) - 1, rng.integers(0, v, 90), np.zeros(300, np.int64), np.tile(rng.integers(0, v, 5), 60)]
    for ids in made:
        both = np.stack([ids, ids[::-1]])
        low, width = op.intervals(both, v)
        for k in range(2):
            assert list(zip(low[k].tolist(), width[k].tolist())) == brute(both[k].tolist(), v)


@pytest.mark.parametrize("seed", range(3))
def test_members_before_in_both(seed):
    """Groups of any size around whole steps, and of very different sizes together."""
    rng = np.random.default_rng(seed)
    sizes = rng.permutation([1, 2, 63, 64, 65, 127, 128, 129, 320, 321, 1100, 4097])
    made = [rng.permutation(n) for n in sizes] if seed else [np.arange(n)[::-1] if n % 2 else np.arange(n) for n in sizes]
    want = [int((x[:i] < x[i]).sum()) for x in made for i in range(len(x))]
    assert op._both_before(np.concatenate(made), sizes).tolist() == want


def test_large_contexts_match_brute_force():
    """Contexts that more than 64, and more than 128, ids follow, in all orders."""
    rng = np.random.default_rng(5)
    a = np.stack([np.zeros(700, np.int64), rng.integers(0, 2, 700), rng.integers(0, 40, 700)])
    a[0, 2::3], a[2, ::2] = rng.integers(0, 600, 233), 7
    low, width = op.intervals(a, 600)
    for k in range(3):
        assert list(zip(low[k].tolist(), width[k].tolist())) == brute(a[k].tolist(), 600)


def test_payload_is_the_exact_number():
    for seed in range(4):
        ids = np.minimum(np.random.default_rng(seed).zipf(1.5, 300), 500) - 1
        parts = brute(ids.tolist(), 500)
        payload = op.encode_blocks([ids], 500)[0]
        assert payload == exact(parts)
        assert len(payload) * 8 < sum(math.log2(op.TOTAL / size) for _, size in parts) * 1.01 + 64


def test_beats_general_compression(spark):
    """Under 8.2 bits an id, where zlib takes more than 9."""
    import zlib

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    ids = np.concatenate([pieces.model(pieces.MODEL).encode(t) for t in texts])[: 8192 * 20]
    cut = [ids[a : a + 8192] for a in range(0, len(ids), 8192)]
    size = sum(map(len, op.encode_blocks(cut, 32000)))
    packed = sum(len(zlib.compress(x.astype("<u2").tobytes(), 9)) for x in cut)
    assert size * 8 < 8.2 * len(ids) < packed * 8


def test_repetition_is_cheap():
    ids = np.tile(np.arange(50) * 600, 40)
    assert len(op.encode_blocks([ids], 32000)[0]) < len(ids) * 2 / 8


def joined(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r.block, r.place)):
        if r.continued:
            out[-1][1].extend(r.ids)
        else:
            out.append((r.doc_id, list(r.ids)))
    return out


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(30)
    coded = op.blocks(docs, size=1000)
    got = joined(op.decoded(coded).collect())
    want = [(r.doc_id, pieces.model(pieces.MODEL).encode(r.text)) for r in docs.collect()]
    assert sorted(got) == sorted(want)
    n, size = coded.selectExpr("sum(n)", "sum(length(payload))").first()
    assert size < 1.5 * n  # under 12 bits an id in blocks of 1,000


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "the word", "x", 1), (None, "the word", "x", 1), (3, "again and again " * 700, "x", 1), (4, "", "x", 1)]
    docs = spark.createDataFrame(rows, ROWS).coalesce(1)
    for size in (8192, 100, 7):
        got = joined(op.decoded(op.blocks(docs, size=size)).collect())
        want = [(r[0], pieces.model(pieces.MODEL).encode(r[1] or "")) for r in rows]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert op.blocks(docs.limit(0)).count() == 0
    only = joined(op.decoded(op.blocks(docs.limit(2))).collect())
    assert sorted(only) == [(1, []), (2, [])]


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "the word and that", "x", 1)], ROWS)
    with pytest.raises(Exception, match="damaged"):
        op.decoded(op.blocks(docs).withColumn("checksum", F.col("checksum") + 1)).collect()
