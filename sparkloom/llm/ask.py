"""Asking about 64-bit keys, in proportion to the input and without joining text.

A chunk (about ``CHUNK_BYTES`` of consecutive text of one scan partition) sends
each of its distinct keys once, sorted, as differences in byte planes, to the
buckets of the key range. A bucket sees the keys of all chunks together and
answers each chunk with one small value a key, in the order of the keys. The
answers are written to the shared folder by scan partition; a second scan of the
same documents makes the same chunks and reads its own answers from there. What
is shuffled is so a few bytes a key, and the text itself never moves.

The second scan must meet the rows of the first in the same partitions:
``steady`` therefore writes out any input that isn't a plain file scan.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

CHUNK_BYTES = 4 << 20
#: Text whose keys one bucket gets, so that a bucket's memory doesn't grow with the table.
BUCKET_BYTES = 32 << 20
REQUEST = "bucket int, part int, chunk int, n int, keys binary, extra binary"
REPLY = "part int, chunk int, bucket int, reply binary"
_PLAIN = ("Project", "Filter", "Relation", "LogicalRelation", "LogicalQueryStage", "+-", ":-")


def steady(docs: DataFrame) -> DataFrame:
    """docs if they are a plain scan of files, else docs written and read again."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # splits of files follow the number of cores, which a lost executor changes between two scans
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    plan = docs._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    plain = all(line.lstrip(" :+-").split(" ")[0].split("[")[0] in _PLAIN for line in plan)
    return docs if plain and docs.inputFiles() else common.stored(docs, "steady")


def encode(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences; the first byte is the number of planes."""
    if not len(sorted_keys):
        return b"\0"
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def decode(data: bytes) -> np.ndarray:
    planes = data[0]
    if not planes:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :planes] = raw.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def chunks(batches, most: int = CHUNK_BYTES):
    """Lists of consecutive slices, each list about ``most`` bytes of text.

    Where a list ends depends on the texts alone, not on how the rows come in batches."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(total, total[at] + most - size, "right")) - 1
            if end <= at:
                if held:
                    yield held
                    held, size = [], 0
                    continue
                end = at + 1  # one text that is longer
            held += common.slices(batch.slice(at, end - at))
            size += int(total[end] - total[at])
            at = end
    if held:
        yield held


def buckets(spark: SparkSession, volume: int) -> int:
    """Buckets for the keys of so many bytes of text."""
    return max(common.shuffles(spark), volume // BUCKET_BYTES)


def width(bits: int, buckets: int) -> int:
    return -(-(1 << bits) // buckets)


def request_rows(part: int, number: int, found: np.ndarray, extra: np.ndarray | None, buckets: int, bits: int = 64):
    """The rows of a chunk's request; chunks of a partition are told apart, and kept in order, by their numbers."""
    step = width(bits, buckets)
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(found, edges), [len(found)]))
    used = np.flatnonzero(np.diff(cuts))
    rows = [(cuts[b], cuts[b + 1]) for b in used]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array([part] * len(used), pa.int32()),
            pa.array([number] * len(used), pa.int32()),
            pa.array([b - a for a, b in rows], pa.int32()),
            pa.array([encode(found[a:b]) for a, b in rows], pa.binary()),
            pa.array([None if extra is None else extra[a:b].tobytes() for a, b in rows], pa.binary()),
        ],
        ["bucket", "part", "chunk", "n", "keys", "extra"],
    )


def requests(docs: DataFrame, keys, buckets: int, bits: int = 64) -> DataFrame:
    """keys(part, number of the chunk's first row, slices) gives sorted distinct keys under 2**bits and None or an array of as many rows of extra values."""

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for held in chunks(batches):
            yield from request_rows(part, row, *keys(part, row, held), buckets, bits)
            row += sum(x.num_rows for x in held)

    return docs.mapInArrow(common.tidied(run), REQUEST)


def answered(asked: DataFrame, answer, extra: np.dtype | None = None) -> DataFrame:
    """answer(keys, their extra values) for all keys of a bucket, chunk after chunk: an array with a value for each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("chunk", "ascending")])
        keys = np.concatenate([decode(x) for x in table.column("keys").to_pylist()])
        more = common.unblob(table.column("extra"), extra) if extra is not None else None
        reply = answer(keys, more)
        cuts = np.concatenate(([0], np.cumsum(table.column("n").to_numpy(), dtype=np.int64)))
        del keys, more
        common.tidy()
        return pa.table(
            {
                "part": table.column("part"),
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "reply": pa.array([pack(reply[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, REPLY)


def pack(values: np.ndarray) -> bytes:
    if values.dtype == bool:
        return np.packbits(values).tobytes() + bytes([len(values) % 8])
    if values.dtype == np.uint32:  # planes of bytes, as most values are small
        return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return values.tobytes()


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    if np.dtype(kind) == bool:
        bits = np.unpackbits(np.frombuffer(data, np.uint8)[:-1]).view(bool)
        return bits[: len(bits) - (8 - data[-1]) % 8]
    if np.dtype(kind) == np.uint32:
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.frombuffer(data, kind)


def post(replies: DataFrame, name: str) -> str:
    """Writes answers to the shared folder by scan partition; returns the place."""
    spark = replies.sparkSession
    path = common.folder(spark, name)
    replies.repartition(common.shuffles(spark), "part").write.partitionBy("part").parquet(path)
    return path


def fetch(path: str, part: int) -> dict[int, list[bytes]]:
    """The answers to a scan partition: for each chunk the replies in the order of the buckets."""
    fs, root = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/*", "/", re.sub("^s3[an]:", "s3:", path)))
    where = pyarrow.fs.FileSelector(f"{root}/part={part}", allow_not_found=True)
    found: dict[int, list] = {}
    for file in fs.get_file_info(where):
        if file.base_name.endswith(".parquet"):
            with fs.open_input_file(file.path) as f:
                for row in pq.ParquetFile(f).read(columns=["chunk", "bucket", "reply"]).to_pylist():
                    found.setdefault(row["chunk"], []).append((row["bucket"], row["reply"]))
    return {chunk: [reply for _, reply in sorted(rows)] for chunk, rows in found.items()}


def told(docs: DataFrame, path: str, kind, use, schema: str) -> DataFrame:
    """use(part, number of the chunk's first row, slices, values in the order of the chunk's keys) yields record batches."""

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        answers = fetch(path, part)
        for held in chunks(batches):
            yield from use(part, row, held, _values(answers, row, kind))
            row += sum(x.num_rows for x in held)

    return docs.mapInArrow(common.tidied(run), schema)


def told_twice(docs: DataFrame, path: str, second: str, kind, use, schema: str) -> DataFrame:
    """As told, with the values of two places."""

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        one, two = fetch(path, part), fetch(second, part)
        for held in chunks(batches):
            yield from use(part, row, held, _values(one, row, kind), _values(two, row, kind))
            row += sum(x.num_rows for x in held)

    return docs.mapInArrow(common.tidied(run), schema)


def _values(answers: dict[int, list[bytes]], row: int, kind) -> np.ndarray:
    replies = answers.pop(row, [])
    return np.concatenate([unpack(x, kind) for x in replies]) if replies else np.zeros(0, kind)


def row_key(part: int, row: int, n: int) -> np.ndarray:
    """Keys of n rows of a scan partition: the same in each scan."""
    return (np.int64(part) << np.int64(32)) + np.arange(row, row + n, dtype=np.int64)


def post_rows(rows: DataFrame) -> str:
    """Writes row numbers (of the keys in column key) by scan partition; returns the place."""

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = np.sort(table.column("key").to_numpy() & 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"part": [key[0].as_py()], "chunk": [0], "bucket": [0], "reply": [rows.tobytes()]}, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("reply", pa.binary())]))

    return post(rows.select("key", F.shiftright("key", 32).cast("int").alias("part")).groupBy("part").applyInArrow(packed, REPLY), "rows")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, which must be steady, without the rows of the keys in dropped's column key."""
    place = post_rows(dropped)

    def run(batches):
        found, row = fetch(place, TaskContext.get().partitionId()), 0
        gone = np.frombuffer(b"".join(found.get(0, [])), np.uint32)
        for batch in batches:
            keep = ~np.isin(np.arange(row, row + batch.num_rows), gone)
            row += batch.num_rows
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return docs.mapInArrow(common.tidied(run), docs.schema)


def volume(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def digit_bits(size: int, spare: int = 9) -> int:
    """Bits of a digit that tells apart the items of so many bytes of text, with 2**-spare of them meeting another by chance."""
    return min(64, max(24, (size // 5 + 1).bit_length() + spare))


def seen_twice(keys: np.ndarray, many: np.ndarray | None = None) -> np.ndarray:
    """Whether each key occurs elsewhere in keys too, or many of it says so somewhere."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    found = np.bincount(group) > 1
    if many is not None:
        found |= np.bincount(group, weights=many[order]) > 0
    out = np.empty(len(k), bool)
    out[order] = found[group]
    return out
