"""Line dedup with a sharded minimal perfect hash.

A line that occurs more than ``MAX_COPIES`` times in the table (1 by default)
stays where it occurs first and goes everywhere else; first is the least
(doc_id, hash of the text, line number), a null doc_id being last.

Distinct line hashes are spread over shards. A shard puts its hashes in a minimal
perfect hash (levels of bit arrays: a hash alone in its cell of a level stays
there, the others go on; its index is the rank of its cell), which indexes three
compact arrays: fingerprints (32 bits of a second hash), counts, and the first
occurrence of lines that repeat. Chunks of documents probe those arrays (see
``ask``); lines are never joined or moved. Two lines that agree in the 64-bit hash
but not in the fingerprint count as different, and the later one is kept.

Defined results: a line is what lies between line feeds; lines without other
characters than white space aren't counted and stay. A null or empty text has
none and comes back as an empty one. Rows that repeat doc_id and text are one
document for the rule: they keep the same lines, their counts add up. Columns
other than text pass through; columns named as results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ask, common

MAX_COPIES = 1
RESULTS = "lines int, removed int"
#: Cells a hash at each level of the perfect hash.
SPARSE = 2
_FEED = np.zeros(256, bool)
_FEED[10] = True
_LAST = np.iinfo(np.int64).max
_EXTRA = np.dtype([("mark", "<u4"), ("count", "<u4"), ("doc", "<i8"), ("text", "<i8"), ("line", "<u4")])


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: 0 to n - 1, without keeping the keys."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        total, seed = 0, 0
        while len(keys):
            cells = max(64, len(keys) * SPARSE)
            at = self._cell(keys, seed, cells)
            count = np.bincount(at, minlength=cells)
            alone = count == 1
            rank = np.zeros(cells // 64 + 2, np.int64)
            bits = np.zeros((cells // 64 + 1) * 64, bool)
            bits[:cells] = alone
            np.cumsum(bits.reshape(-1, 64).sum(1), out=rank[1:])
            self.levels.append((cells, np.packbits(bits), rank + total))
            total += int(rank[-1])
            keys = keys[~alone[at]]
            seed += 1
        self.size = total

    @staticmethod
    def _cell(keys: np.ndarray, seed: int, cells: int) -> np.ndarray:
        return (common.mix(keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(cells)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of keys that were built in; any index, or -1, for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, (cells, packed, rank) in enumerate(self.levels):
            at = self._cell(keys[left], seed, cells)
            here = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            hit, cell = left[here], at[here]
            word = np.zeros((len(cell), 8), np.uint8)
            base = cell >> 6 << 3
            for i in range(8):
                word[:, i] = packed[base + i]
            bits = np.unpackbits(word, axis=1)
            before = (bits * (np.arange(64) < (cell & 63)[:, None])).sum(1)
            out[hit] = rank[cell >> 6] + before
            left = left[~here]
            if not len(left):
                break
        return out


def _lines(part: pa.RecordBatch):
    """Starts and ends in bytes of all lines of a slice, their document, number in it, whether they count; bytes and offsets."""
    data, offsets = common.flat(part.column("text"))
    data = data.copy()
    data[offsets[1:] - 1] = 10  # the byte after each text
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    doc, first = common.owners(starts, offsets)
    filled = np.concatenate(([0], np.cumsum(~common.SPACE[data])))
    return data, starts, ends, doc, np.arange(len(starts)) - first[doc], filled[ends] > filled[starts]


def _found(held: list[pa.RecordBatch], hashed: str):
    """Hash, fingerprint and place of all counted lines of a chunk; the lines of each slice."""
    slices, hashes, marks, docs, texts, numbers = [], [], [], [], [], []
    for part in held:
        data, starts, ends, doc, number, real = got = _lines(part)
        slices.append(got)
        s, e = starts[real], ends[real]
        h = common.span_hash(data, s, e)
        key = part.column("doc_id")
        ids = pc.fill_null(pc.cast(key, pa.int64()), _LAST).to_numpy(zero_copy_only=False)[doc[real]]
        hashes.append(h)
        marks.append((common.span_hash(data[::-1], len(data) - e, len(data) - s) >> np.uint64(32)).astype(np.uint32))
        docs.append(ids)
        texts.append(part.column(hashed).to_numpy(zero_copy_only=False)[doc[real]])
        numbers.append(number[real].astype(np.uint32))
    return [np.concatenate(x) for x in (hashes, marks, docs, texts, numbers)], slices


def _distinct(held, hashed):
    (h, mark, doc, text, number), slices = _found(held, hashed)
    order = np.lexsort((number, text, doc, h))
    k = h[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = order[new]
    extra = np.zeros(len(first), _EXTRA)
    for name, x in (("mark", mark), ("doc", doc), ("text", text), ("line", number)):
        extra[name] = x[first]
    extra["count"] = np.diff(np.append(np.flatnonzero(new), len(k)))
    return k[new], extra


def shard_arrays(keys: np.ndarray, extra: np.ndarray):
    """The perfect hash of the distinct keys and the fingerprint, count and first-occurrence arrays that it indexes."""
    order = np.lexsort((extra["line"], extra["text"], extra["doc"], keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    index = PerfectHash(k[new])
    at = index(k[new])
    marks, counts = np.zeros(index.size, np.uint32), np.zeros(index.size, np.int64)
    first = np.zeros(index.size, _EXTRA)
    head = order[new]
    marks[at], first[at] = extra["mark"][head], extra[head]
    counts[at] = np.add.reduceat(extra["count"][order].astype(np.int64), np.flatnonzero(new)) if len(k) else 0
    return index, marks, counts, first


def _answer(max_copies: int):
    def answer(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """0: keep all; 1: keep none; 2: keep that at the first place."""
        index, marks, counts, first = shard_arrays(keys, extra)
        at = index(keys)
        many = (counts[at] > max_copies) & (marks[at] == extra["mark"])
        mine = (first["doc"][at] == extra["doc"]) & (first["text"][at] == extra["text"]) & (first["line"][at] == extra["line"])
        return np.where(many, np.where(mine, 2, 1), 0).astype(np.uint8)

    return answer


def _asked(docs: DataFrame, max_copies: int) -> tuple[DataFrame, str, str]:
    """docs, steady and with a hash of the text, that column's name, and the place of the answers for their lines."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    hashed = common.unused("_h", docs)
    docs = ask.steady(docs).withColumn(hashed, F.xxhash64("text"))
    asked = ask.requests(docs.select("doc_id", "text", hashed), lambda part, number, held: _distinct(held, hashed), common.shuffles(docs.sparkSession))
    return docs, hashed, ask.post(ask.answered(asked, _answer(max_copies), _EXTRA), "lines")


def _verdicts(values: np.ndarray, h: np.ndarray) -> np.ndarray:
    keys, which = np.unique(h, return_inverse=True)
    if len(values) != len(keys):
        raise ValueError("the documents changed between two scans")
    return values[which]


def holding(docs: DataFrame, max_copies: int, name: str) -> DataFrame:
    """docs with a column ``name``: whether a text has a line that occurs more than max_copies times, at its first place or not."""
    docs, hashed, place = _asked(docs, max_copies)
    columns = [c for c in docs.columns if c != hashed]
    schema = common.extended(docs.drop(hashed), f"`{name}` boolean")

    def use(part, number, held, values):
        (h, *_), slices = _found(held, hashed)
        many = _verdicts(values, h) > 0
        at = 0
        for batch, (_, _, _, doc, _, real) in zip(held, slices):
            n = int(real.sum())
            some = np.bincount(doc[real][many[at : at + n]], minlength=batch.num_rows) > 0
            at += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(some)], [*columns, name])

    return ask.told(docs, place, np.uint8, use, schema)


def dedup(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """docs with the text without repeated lines, the number of lines it had, and how many went."""
    docs, hashed, place = _asked(docs.drop("lines", "removed"), max_copies)
    columns = [c for c in docs.columns if c != hashed]
    plain = docs.drop(hashed)
    schema = common.extended(plain, RESULTS)

    def use(part, number, held, values):
        (h, _, ids, texts, numbers), slices = _found(held, hashed)
        verdict = _verdicts(values, h)
        drop = verdict == 1
        group = np.flatnonzero(verdict == 2)
        if len(group):  # of the lines of a kind, those at its first place stay
            order = group[np.lexsort((numbers[group], texts[group], ids[group], h[group]))]
            new = np.ones(len(order), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            head = order[new][np.cumsum(new) - 1]
            drop[order] = (ids[order] != ids[head]) | (texts[order] != texts[head]) | (numbers[order] != numbers[head])
        at = 0
        for batch, (data, starts, ends, doc, _, real) in zip(held, slices):
            gone = np.zeros(len(starts), bool)
            n = int(real.sum())
            gone[real] = drop[at : at + n]
            at += n
            total, removed = np.bincount(doc, minlength=batch.num_rows), np.bincount(doc[gone], minlength=batch.num_rows)
            text = batch.column("text")
            if gone.any():
                lines = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(total - removed))), pa.int32()), _strings(data, starts[~gone], ends[~gone]))
                text = pc.cast(pc.binary_join(lines, "\n"), pa.string())
            counted = np.bincount(doc[real], minlength=batch.num_rows)
            by = {c: batch.column(c) for c in columns} | {"text": text, "lines": pa.array(counted, pa.int32()), "removed": pa.array(removed, pa.int32())}
            yield pa.RecordBatch.from_arrays([by[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return ask.told(docs, place, np.uint8, use, schema)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings; the spans ascend."""
    sizes = ends - starts
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    taken = data[np.cumsum(keep[:-1]) > 0]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(taken))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return dedup(docs.select("doc_id", "text"))


ORACLE_SQL = r"""
WITH line AS (
  SELECT doc_id, i, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
ranked AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\t\n\v\f\r ]') AS counts,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS place
  FROM line)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (place = 1 OR NOT counts), '') AS text,
       CAST(count(*) FILTER (counts) AS INTEGER) AS lines,
       CAST(count(*) FILTER (counts AND place > 1) AS INTEGER) AS removed
FROM ranked GROUP BY doc_id
"""
