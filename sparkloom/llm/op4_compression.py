"""Quality rules from compression bands.

The ratio of a text is its zstandard-compressed size over its size in bytes. Both
the whole document and its fixed chunks of ``CHUNK_BYTES`` are held against a band
that depends on the length: a ratio under it says repetitive, one over it
incompressible. A short text compresses worse, frame and all, so each power of
two of the length has its own limits (``BANDS``); texts under ``LEAST_BYTES`` say
nothing and pass. A chunk is judged by the limits of its own length; a document
goes if its whole ratio is outside, or if more than ``CHUNK_SHARE`` of its chunks'
bytes are.

Defined results: a null or empty text has ratio null, no chunks, and passes. Chunks
end between bytes, maybe within a character. Repeated rows get equal results.
Other columns pass through; columns named as results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common

LEVEL = 3
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.5
LEAST_BYTES = 128
#: Least length in bytes, least ratio, greatest ratio.
BANDS = [(128, 0.40, 1.00), (256, 0.32, 0.90), (512, 0.28, 0.82), (1024, 0.25, 0.76), (2048, 0.22, 0.72), (4096, 0.20, 0.70), (8192, 0.18, 0.68), (16384, 0.16, 0.66), (65536, 0.15, 0.65)]
RESULTS = "ratio double, chunks int, repetitive_chunks int, dense_chunks int, verdict string"
_FROM = np.array([b[0] for b in BANDS])
_LOW = np.array([b[1] for b in BANDS])
_HIGH = np.array([b[2] for b in BANDS])


def verdicts(sizes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """-1 for a repetitive text, 1 for an incompressible one, 0 for others."""
    band = np.searchsorted(_FROM, sizes, "right") - 1
    ratio = packed / np.maximum(sizes, 1)
    known = band >= 0
    band = np.maximum(band, 0)
    return np.where(known & (ratio < _LOW[band]), -1, np.where(known & (ratio > _HIGH[band]), 1, 0))


def _judge(column: pa.Array):
    data, offsets = common.flat(column)
    view = memoryview(data)
    n = len(column)
    starts, ends = offsets[:-1], offsets[1:] - 1
    sizes = ends - starts
    pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
    whole = np.array([len(pack(view[a:b])) if b > a else 0 for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    # a document of one chunk is that chunk
    count = -(-sizes // CHUNK_BYTES)
    doc = np.repeat(np.arange(n), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    a = starts[doc] + number * CHUNK_BYTES
    length = np.minimum(a + CHUNK_BYTES, ends[doc]) - a
    packed = np.where(count[doc] == 1, whole[doc], 0)
    for i in np.flatnonzero(count[doc] > 1).tolist():
        packed[i] = len(pack(view[a[i] : a[i] + length[i]]))
    chunk = verdicts(length, packed)
    low, high = (np.bincount(doc, weights=np.where(chunk == x, length, 0), minlength=n) for x in (-1, 1))
    total = verdicts(sizes, whole)
    limit = CHUNK_SHARE * sizes
    name = np.full(n, "keep", object)
    name[high > limit] = "incompressible"
    name[low > limit] = "repetitive"
    name[total == 1] = "incompressible"
    name[total == -1] = "repetitive"
    counted = [np.bincount(doc[chunk == x], minlength=n) for x in (-1, 1)]
    return np.where(sizes > 0, whole / np.maximum(sizes, 1), np.nan), count, *counted, name


def judged(docs: DataFrame) -> DataFrame:
    """docs with ratio, chunks, chunks outside their bands, and a verdict: keep, repetitive or incompressible."""
    docs = docs.drop("ratio", "chunks", "repetitive_chunks", "dense_chunks", "verdict")
    schema = common.extended(docs, RESULTS)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                ratio, count, low, high, verdict = _judge(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ratio, from_pandas=True), pa.array(count, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(verdict, pa.string())],
                    names,
                )

    return docs.mapInArrow(common.tidied(run), schema)


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass."""
    return judged(docs).where("verdict = 'keep'")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
