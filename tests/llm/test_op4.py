import random

import zstandard

from sparkloom.llm import op4_compression as op

ROWS = "doc_id bigint, text string, ratio string, verdict int"


def brute(text):
    data = (text or "").encode()
    size = lambda b: len(zstandard.ZstdCompressor(level=op.LEVEL).compress(b))

    def outside(b):
        band = [x for x in op.BANDS if x[0] <= len(b)]
        r = size(b) / max(len(b), 1)
        return 0 if not band else -1 if r < band[-1][1] else 1 if r > band[-1][2] else 0

    chunks = [data[i : i + op.CHUNK_BYTES] for i in range(0, len(data), op.CHUNK_BYTES)]
    verdict = outside(data) if data else 0
    for x in (-1, 1):
        if not verdict and sum(len(c) for c in chunks if outside(c) == x) > op.CHUNK_SHARE * len(data):
            verdict = x
    name = {0: "keep", -1: "repetitive", 1: "incompressible"}[verdict]
    return (size(data) / len(data) if data else None, len(chunks), sum(outside(c) == -1 for c in chunks), sum(outside(c) == 1 for c in chunks), name)


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in op.judged(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.ratio, g.chunks, g.repetitive_chunks, g.dense_chunks, g.verdict) == brute(r.text)
    assert {r.verdict for r in got.values()} >= {"keep"}


def test_odd_rows(spark):
    r = random.Random(2)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9000))
    plain = " ".join("".join(r.choice(["the", "an", "ing", "er", "re", "on"]) for _ in range(r.randint(1, 4))) for _ in range(30000))
    texts = ["", None, "a", "again " * 3000, noise, plain, plain + "x" * 300_000, "é" * 200, plain]
    docs = spark.createDataFrame([(None if i == 2 else i, t, "old", 1) for i, t in enumerate(texts)], ROWS)
    got = op.judged(docs).collect()
    assert sorted(map(str, ((x.ratio, x.chunks, x.repetitive_chunks, x.dense_chunks, x.verdict) for x in got))) == sorted(map(str, map(brute, texts)))
    verdict = {x.doc_id: x.verdict for x in got}
    assert (verdict[3], verdict[4], verdict[5], verdict[6], verdict[0], verdict[1]) == ("repetitive", "incompressible", "keep", "repetitive", "keep", "keep")
    assert op.judged(docs.limit(0)).count() == 0
