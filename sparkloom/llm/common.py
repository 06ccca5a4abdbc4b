"""Shared pieces of the training-data operators.

Text reaches Python as Arrow batches and is handled as one flat byte array a
slice, so that the cost of Python is paid a slice and not a word. A slice holds
about ``SLICE_BYTES`` of text (one longer document makes a longer slice), which
bounds memory whatever the length of the documents.

Nulls: a null text counts as an empty one everywhere in this subpackage.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = ~SPACE

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93


def tidy() -> None:
    """Gives freed memory of this worker back: it lives on between tasks, next to others."""
    _pow.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not that C library


def tidied(run):
    """run, a function of record batches, with tidy() at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Arrow batches are kept at 8 MB in sessions that leave their size at the default, for the sake of long documents."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def unused(name: str, df: DataFrame) -> str:
    """The name, with so many underscores behind that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Folders written within scratch blocks, the innermost last.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Folders of the shared folder that are taken within the block are deleted at its end; what is read later is stored as kept."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _scratch.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def folder(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new folder of the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch and not kept:
        _scratch[-1].append(path)
    return path


def stored(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends there."""
    spark = df.sparkSession
    path = folder(spark, name, kept)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """Columns doc_id, text and _h, a hash of the text.

    (doc_id, _h) names a document: rows that repeat both are one document, rows
    that share only doc_id (null, say) are different ones."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """The batch in consecutive slices of about ``most`` bytes of the text column."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text with a space after it, and the n + 1 offsets of the texts."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    joined = pc.binary_join_element_wise(texts, "", " ")
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    n = len(joined)
    wide = pa.types.is_large_string(joined.type)
    offsets = np.frombuffer(joined.buffers()[1], np.int64 if wide else np.int32)[joined.offset : joined.offset + n + 1].astype(np.int64)
    data = joined.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses, modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES * 5 // 4)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        have = _pow[base] = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of the kind; the last byte must be of another."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever the span lies."""
    up, down = powers(_P, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def owners(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each span, and for each text the number of its first span (n + 1 of them)."""
    first = np.searchsorted(starts, offsets, "left")
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def window_hash(items: np.ndarray, k: int, base: int = _Q) -> np.ndarray:
    """Hashes of all windows of k consecutive items."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(items))
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def words(texts: pa.Array, kind: np.ndarray = WORDY, lower: bool = True):
    """Hash, text and the texts' first words of all words of a slice."""
    data, offsets = flat(texts, lower)
    starts, ends = spans(data, kind)
    doc, first = owners(starts, offsets)
    return span_hash(data, starts, ends), doc, first


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the lengths of the lists."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def blobs(values: np.ndarray, bucket: np.ndarray, buckets: int):
    """Rows of values (a 2-D or structured array) as one binary a bucket: (bucket, bytes)."""
    order = np.argsort(bucket, kind="stable")
    values, cuts = values[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, values[cuts[b] : cuts[b + 1]].tobytes()) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def unblob(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """The rows of all binaries of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).copy()


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of df and further fields, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
