"""Token ids in compressed blocks: an adaptive context-mixing range coder.

The ids of the documents of a chunk (of the piece model, see op9) follow each other
in blocks of ``BLOCK`` ids. Each block starts from nothing, so any block is decoded
alone, and has a CRC-32 of its ids. An id's probability mixes

- order 2: the ids that followed the same two ids in the block so far,
- order 1: the ids that followed the same id,
- order 0: all ids of the block so far,
- equal shares of the vocabulary; besides, each id has one part of ``TOTAL``.

Counts go on with each id. An order takes N / (N + c * D) of what the higher orders
left, N being what its context has been followed by so far and D the different ids
among that, so a context that proved to foretell gets more. All of it is in integers,
so that both sides agree to the bit. The encoder finds all counts of a chunk's blocks
by sorting contexts; the decoder keeps a sorted list for each context.
The coder has a 64-bit range, gives out 32 bits at a time, and settles carries at the
end. All blocks of a chunk are coded in lockstep, one id of each block at a time.

Columns: block (a key, ascending within a scan partition), doc_ids, counts (ids of
each document in this block; a document may go on in the next block), continued
(whether the first document began in an earlier block), n, checksum, payload.

Defined results: null and empty texts have no ids and are listed with count 0.
Repeated rows are coded as often as they come. An empty table gives no block.
A text of any length is coded whole, over as many blocks as it takes. Other columns
are left out.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ask, common, op9_sentencepiece

BLOCK = 8192
#: Text whose blocks are coded in lockstep.
CHUNK_BYTES = 16 << 20
TOTAL_BITS = 22
TOTAL = 1 << TOTAL_BITS
#: c of orders 0, 1 and 2.
ESCAPE = (1, 3, 3)
#: Ids of a group that are compared at once, as the bits of a number.
LANES = 64
#: Blocks that are counted together.
TOGETHER = 4
BLOCKS = "block bigint, doc_ids array<bigint>, counts array<int>, continued boolean, n int, checksum bigint, payload binary"
_LOW32 = 1 << 32
_ONE = np.uint64(1)


def _lower(key: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of keys with a different lane (their low bits, after turn) each: the rows sorted, and how many of those before a key have a lower lane.

    The lanes that came before are the bits of one number."""
    key = np.sort(key, 1) ^ np.uint32(turn)
    bit = _ONE << (key & np.uint32(LANES - 1)).astype(np.uint64)
    seen = np.cumsum(bit, 1) - bit
    return key, np.bitwise_count(seen & (bit - _ONE))


def _both_before(time: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each member of groups (consecutive, in the groups' order; time is a permutation of 0, 1, ... in each) how many of its group come before it in both order and time.

    Order and time are taken in steps of LANES. Before it in both are: the lower ones of its step of time, those of its
    step of the order from earlier steps of time, and all of a lower step in both, which sums over a table of the steps give."""
    steps = -(-sizes // LANES)
    base = np.repeat((np.cumsum(steps) - steps) * LANES, steps)[:, None]
    local = np.arange(len(base) * LANES).reshape(-1, LANES) - base
    # a group's last step is filled with members that come last in both
    held = local < np.repeat(sizes, steps)[:, None]
    padded = local.copy()
    padded[held] = time
    order, out = np.empty(local.size, np.uint32), np.empty(local.size, np.int32)
    order[(padded + base).ravel()] = local.ravel()
    lane, step = np.arange(LANES, dtype=np.uint32), padded // LANES
    key, less = _lower(order.reshape(-1, LANES) * np.uint32(LANES) | lane)
    out[(base + key // LANES).ravel()] = less.ravel()
    key, less = _lower(step.astype(np.uint32) * np.uint32(LANES) | lane[::-1], LANES - 1)
    more = np.empty(local.size, np.uint8)
    more[(key % LANES + np.arange(0, local.size, LANES)[:, None]).ravel()] = less.ravel()
    out = (out + more).reshape(-1, LANES)
    # tables of groups of about as many steps have one size
    near = np.frexp(steps - 1)[1] // 2
    for size in np.flatnonzero(np.bincount(near)):
        some = near == size
        rows = np.flatnonzero(np.repeat(some, steps))
        count, wide = int(some.sum()), int(steps[some].max()) + 1
        group = np.repeat(np.arange(count), steps[some])[:, None]
        own = local[rows, :1] // LANES
        cell = (step[rows] * count + group) * wide + own
        table = np.bincount((cell + count * wide + 1).ravel(), minlength=count * wide * wide).astype(np.uint16).reshape(wide, count, wide)
        for over, under in zip(table, table[1:]):
            under += over
        out[rows] += np.cumsum(table, 2, dtype=np.uint16).reshape(-1).take(cell)
    return out[held]


def counted(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, and each place of blocks of one length (rows): of what followed the place's context in its block before, how many ids, smaller ones, the same, and different ones.

    A sort by the ids of k + 1 places, and time, shows an order's repetitions; shifted by a place it has the groups of the next order.
    Both have a group's places at the same stretch, there by id and here by time."""
    rows, n = ids.shape
    size = rows * n
    bits = max(1, int(n).bit_length())
    mask = (1 << bits) - 1
    time, base, every = np.arange(n), (np.arange(rows) * n)[:, None], np.arange(size, dtype=np.int32)
    changes = lambda key: np.concatenate((np.ones((rows, 1), bool), key[:, 1:] != key[:, :-1]), 1).ravel()
    since = lambda heads: np.maximum.accumulate(every * heads)
    key = np.sort(ids.astype(np.int64) << bits | time, 1)
    # ids by their rank among those of the block
    rank, new = np.empty(size, np.int64), changes(key >> bits)
    rank[((key & mask) + base).ravel()] = (np.cumsum(new.reshape(rows, n), 1) - 1).ravel()
    back = [np.concatenate((np.full((rows, k), n, np.int64), rank.reshape(rows, n)[:, : max(0, n - k)]), 1)[:, :n] for k in range(3)]
    group, heads = np.arange(size), every % n == 0
    out, rest = [], []
    for k in range(3):
        within = key & mask
        at = (within + base).ravel()
        start, starts = since(heads), np.flatnonzero(heads)
        sizes = np.diff(np.append(starts, size))
        put = [np.empty(size, np.int32) for _ in range(4)]
        put[0][group] = every - start
        repeated = every - since(new)
        put[2][at] = repeated
        # the ids of a group that came before in its order are bits of one number, by time; of the same id, all of them
        past = put[0].take(at)
        large = sizes > LANES
        if large.all():
            rest.append((put[1], at, past, repeated, sizes))
        else:
            bit = _ONE << past.astype(np.uint64)
            seen = np.cumsum(bit) - bit
            put[1][at] = np.bitwise_count((seen - seen.take(start)) & (bit - _ONE)) - repeated
            if large.any():
                among = op9_sentencepiece.ragged(starts[large], sizes[large])
                rest.append((put[1], at.take(among), past.take(among), repeated.take(among), sizes[large]))
        once = put[2].take(group) == 0
        fresh = np.cumsum(once, dtype=np.int32) - once
        put[3][group] = fresh - fresh.take(start)
        out.append(tuple(put))
        if k == 2:
            break
        # the next order: this order's runs of one place before; the block's last place has no next, its first k + 1 have no context and sort behind
        real = (within < n - 1) & (within >= k)
        lone = base + np.arange(min(k + 1, n))[::-1]
        group = np.concatenate(((at[real.ravel()] + 1).reshape(rows, max(0, n - 1 - k)), lone), 1).ravel()
        wide = back[k + 1]
        for i in range(k, -1, -1):
            wide = wide << bits | back[i]
        key = np.sort(wide << bits | time, 1)
        new, heads = changes(key >> bits), changes(key >> 2 * bits)
    if rest:
        less, a = _both_before(*(np.concatenate(x) for x in list(zip(*rest))[2::2])), 0
        for into, at, _, repeated, _ in rest:
            into[at] = less[a : a + len(at)] - repeated
            a += len(at)
    return out


def intervals(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and width, out of TOTAL, of each id of blocks of one length (rows)."""
    # whole numbers this small, and their quotients rounded down, are exact in floating point
    x = ids.astype(np.float64).ravel()
    low, high, left = x.copy(), x + 1, np.full(len(x), float(TOTAL - vocabulary))
    share = lambda w, part, whole: np.floor(w * part / whole)
    for c, (n, less, same, kinds) in list(zip(ESCAPE, counted(ids)))[::-1]:
        w = share(left, n, np.maximum(n + c * kinds, 1))
        n = np.maximum(n, 1)
        low += share(w, less, n)
        high += share(w, less + same, n)
        left -= w
    low += share(left, x, vocabulary)
    high += share(left, x + 1, vocabulary)
    return low.astype(np.int64).reshape(ids.shape), (high - low).astype(np.int64).reshape(ids.shape)


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The payload of each block, all in lockstep."""
    if not blocks:
        return []
    steps, lanes = max(map(len, blocks)), len(blocks)
    start, size = np.zeros((steps, lanes), np.uint64), np.full((steps, lanes), TOTAL, np.uint64)
    for n in sorted({len(b) for b in blocks} - {0}):
        of = [k for k, b in enumerate(blocks) if len(b) == n]
        for part in (of[i : i + TOGETHER] for i in range(0, len(of), TOGETHER)):
            low, width = intervals(np.stack([blocks[k] for k in part]), vocabulary)
            start[:n, part], size[:n, part] = low.T, width.T
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    full, carry = np.empty((steps, lanes), bool), np.empty((steps, lanes), bool)
    bits, half, least = np.uint64(TOTAL_BITS), np.uint64(32), np.uint64(_LOW32)
    for t in range(steps):
        part = span >> bits
        more = low + part * start[t]
        np.less(more, low, out=carry[t])
        span = part * size[t]
        shift = np.less(span, least, out=full[t]) * half
        start[t] = more  # its upper half is given out if the step is full
        low, span = more << shift, span << shift
    words, count = np.zeros((lanes, steps * TOTAL_BITS // 32 + 4), np.uint64), np.zeros(lanes, np.int32)
    for a in range(0, steps, 1024):
        some, over = np.flatnonzero(full[a : a + 1024]), np.flatnonzero(carry[a : a + 1024])
        place = np.cumsum(full[a : a + 1024], 0, dtype=np.int32) + count
        words[some % lanes, place.ravel().take(some) - 1] = start[a : a + 1024].ravel().take(some) >> half
        # a carry goes to the last word that was given out before its step
        np.add.at(words, (over % lanes, place.ravel().take(over) - full[a : a + 1024].ravel().take(over) - 1), _ONE)
        count = place[-1]
    k = np.arange(lanes)
    words[k, count] = low >> half
    words[k, count + 1] = low & np.uint64(_LOW32 - 1)
    while True:
        over = words >> half
        if not over.any():
            break
        words &= np.uint64(_LOW32 - 1)
        words[:, :-1] += over[:, 1:]
    return [words[i, : count[i] + 2].astype(">u4").tobytes() for i in range(lanes)]


def decode_block(payload: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The ids of a block, one by one."""
    words = iter(np.frombuffer(payload, ">u4").tolist())
    code, span = next(words) << 32 | next(words), (1 << 64) - 1
    ids: list[int] = []
    followed: tuple[dict, ...] = ({}, {}, {})
    for t in range(n):
        contexts = [tuple(ids[t - k :]) if k else () for k in range(3) if t >= k]
        left, parts = TOTAL - vocabulary, []
        for k in range(len(contexts) - 1, -1, -1):
            seen, kinds = followed[k].get(contexts[k], ((), ()))
            if seen:
                w = left * len(seen) // (len(seen) + ESCAPE[k] * len(kinds))
                left -= w
                parts.append((w, seen, len(seen)))

        def total(x):
            return x + left * x // vocabulary + sum([w * bisect.bisect_left(seen, x) // size for w, seen, size in parts])

        part = span >> TOTAL_BITS
        target = min(code // part, TOTAL - 1)
        a, b = 0, vocabulary
        while b - a > 1:
            middle = (a + b) >> 1
            if total(middle) <= target:
                a = middle
            else:
                b = middle
        low = total(a)
        code -= low * part
        span = part * (total(a + 1) - low)
        if span < _LOW32:
            code, span = code << 32 | next(words, 0), span << 32
        for by, c in zip(followed, contexts):
            seen, kinds = by.setdefault(c, ([], set()))
            bisect.insort(seen, a)
            kinds.add(a)
        ids.append(a)
    return np.array(ids, np.int64)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def blocks(docs: DataFrame, path: str = op9_sentencepiece.MODEL, size: int = BLOCK) -> DataFrame:
    """The coded blocks of all documents."""
    vocabulary = op9_sentencepiece.model(path).get_piece_size()

    def run(batches):
        block = (TaskContext.get().partitionId() << 32) - 1
        for held in ask.chunks(batches, CHUNK_BYTES):
            ids, counts = op9_sentencepiece.encoded([x.column("text") for x in held], path)
            doc = pa.concat_arrays([pc.cast(x.column("doc_id"), pa.int64()) for x in held])
            total = np.concatenate(([0], np.cumsum(counts)))
            edges = list(range(0, max(len(ids), 1), size)) + [max(len(ids), 1)]
            cut = [ids[a:b] for a, b in zip(edges, edges[1:])]
            packed = encode_blocks(cut, vocabulary)
            rows = []
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                block += 1
                # documents with ids here, and empty ones at their place
                i = int(np.searchsorted(total[1:], a, "right")) if k else 0
                j = int(np.searchsorted(total[:-1], b, "left")) if k < len(cut) - 1 else len(doc)
                own = np.minimum(total[i + 1 : j + 1], b) - np.maximum(total[i:j], a)
                rows.append((block, doc.slice(i, j - i).to_pylist(), np.maximum(own, 0).tolist(), bool(i < j and total[i] < a), len(cut[k]), checksum(cut[k]), packed[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.int32(), pa.int64(), pa.binary()))],
                ["block", "doc_ids", "counts", "continued", "n", "checksum", "payload"],
            )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(common.tidied(run), BLOCKS)


def decoded(coded: DataFrame, path: str = op9_sentencepiece.MODEL) -> DataFrame:
    """(block, place, doc_id, continued, ids): the documents' ids by block; a damaged block raises ValueError."""
    vocabulary = op9_sentencepiece.model(path).get_piece_size()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["payload"], r["n"], vocabulary)
                if checksum(ids) != r["checksum"]:
                    raise ValueError(f"block {r['block']} is damaged")
                cuts = np.concatenate(([0], np.cumsum(r["counts"]))).astype(int)
                yield pa.RecordBatch.from_pylist(
                    [{"block": r["block"], "place": i, "doc_id": d, "continued": i == 0 and r["continued"], "ids": ids[a:b].tolist()} for i, (d, a, b) in enumerate(zip(r["doc_ids"], cuts, cuts[1:]))],
                    pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("continued", pa.bool_()), ("ids", pa.list_(pa.int32()))]),
                )

    return coded.mapInArrow(common.tidied(run), "block bigint, place int, doc_id bigint, continued boolean, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(common.table(spark, sf_dir, "documents"))
