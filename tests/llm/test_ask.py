import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import ask
from sparkloom.llm.components import components


def test_chunks_depend_on_texts_alone():
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.integers(0, 60, 500)] + ["y" * 400] * 3 + [None, "", "z"]
    ends = set()
    for step in (1, 7, 100, 1000):
        batches = [pa.record_batch({"text": pa.array(texts[i : i + step], pa.string())}) for i in range(0, len(texts), step)]
        made = [sum(b.num_rows for b in held) for held in ask.chunks(batches, 200)]
        assert sum(made) == len(texts)
        ends.add(tuple(made))
    assert len(ends) == 1


@pytest.mark.parametrize("bits", [24, 40, 64])
def test_keys_come_back(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64))
        assert (ask.decode(ask.encode(keys)) == keys).all()
    for n in (0, 1, 7, 8, 9):
        flags = rng.random(n) < 0.5
        assert (ask.unpack(ask.pack(flags), np.dtype(bool)) == flags).all()


def test_steady(spark, tmp_path):
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert ask.steady(plain) is plain
    assert ask.steady(plain.repartition(3)) is not plain
    made = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert ask.steady(made).inputFiles()


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
