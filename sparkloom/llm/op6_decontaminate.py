"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

A window is as long, in words, as the benchmark item that it is held against, and
starts at every word. Shingles are pairs of consecutive words (runs of letters and
digits in lower case; a one-word item has that word). A shingle weighs
log(1 + items / items that have it), counted over the whole benchmark, times its
occurrences. The similarity is the weighted Jaccard similarity of the two bags.

Fingerprints have 64 bits. Eight blocks of eight bits index the items: within
radius RADIUS at least one block differs in RADIUS // 8 bits at most, so probing
every block with that many flips finds all items within the radius. Each
candidate within the radius is then verified by its exact similarity.

A window can reach the similarity only if the items' shingles that it holds weigh
enough. An upper bound, from running sums over the text, rules out windows before
any fingerprint is made; it never rules out one that would verify. Fingerprints of
the others are differences of running sums, too.

The benchmark reaches the tasks in parts of ``PART_CHARS`` characters at most, a
scan of the documents a part.

Defined results: a document that is shorter than an item is one window. Texts and
items without words never match; null texts and items are empty ones. Of equal
windows of a document for one item the most similar and then the first is given.
Repeated rows give repeated results. Items of equal text each match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

SIMILARITY = 0.5
RADIUS = 23
PART_CHARS = 8 << 20
MATCH = "doc_id bigint, item_id bigint, first_word int, words int, hamming int, similarity double"
_FILTER = 20


def _shingles(h: np.ndarray) -> np.ndarray:
    return common.window_hash(h, 2) if len(h) > 1 else h


class Benchmark:
    """The items' shingle bags, weights, fingerprints, and the blocks that index them."""

    def __init__(self, ids: list[int | None], texts: list[str | None], counts: dict[int, int] | None = None, items: int = 0):
        """counts and items: the items that have each shingle and all items, if these are but a part of them."""
        found = []
        for i, text in zip(ids, texts):
            h, _, _ = common.words(pa.array([text], pa.string()))
            if len(h):
                found.append((i, h))
        self.ids = [i for i, _ in found]
        self.sizes = np.array([len(h) for _, h in found], np.int64)
        bags = [np.unique(_shingles(h), return_counts=True) for _, h in found]
        self.known = np.unique(np.concatenate([b for b, _ in bags])) if bags else np.zeros(0, np.uint64)
        has = np.zeros(len(self.known))
        self.bags = []
        for keys, times in bags:
            at = np.searchsorted(self.known, keys)
            has[at] += 1
            self.bags.append((at, times))
        if counts is not None:
            has = np.array([counts[k] for k in self.known.tolist()], float)
        items = items or len(bags)
        self.weight = np.log1p(items / np.maximum(has, 1))
        self.other = float(np.log1p(items))  # of a shingle that no item has
        self.total = np.array([(self.weight[at] * n).sum() for at, n in self.bags])
        self.prints = np.array([fingerprint(self.known[at], self.weight[at] * n) for at, n in self.bags], np.uint64)
        self.maybe = np.zeros(1 << _FILTER, bool)
        self.maybe[self.known >> np.uint64(64 - _FILTER)] = True
        #: Item and shingle numbers in one, sorted.
        self.members = np.concatenate([i * len(self.known) + at for i, (at, _) in enumerate(self.bags)]) if bags else np.zeros(0, np.int64)
        self.by_size = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes)}
        self.tables = {n: block_tables(self.prints[x]) for n, x in self.by_size.items()}

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The number of each shingle, or -1."""
        out = np.full(len(keys), -1, np.int64)
        near = np.flatnonzero(self.maybe[keys >> np.uint64(64 - _FILTER)])
        if len(near) and len(self.known):
            at = np.searchsorted(self.known, keys[near])
            at[at == len(self.known)] = 0
            out[near] = np.where(self.known[at] == keys[near], at, -1)
        return out


_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(keys: np.ndarray, weights: np.ndarray) -> np.uint64:
    signs = ((common.mix(keys.astype(np.uint64))[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1
    return np.bitwise_or.reduce(np.where(weights @ signs > 1e-7, np.uint64(1) << _BITS, np.uint64(0)))


def block_tables(prints: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """For each block of eight bits and each of its values, which fingerprints differ there in radius // 8 bits at most."""
    value = np.arange(256, dtype=np.uint8)
    out = []
    for block in range(8):
        own = ((prints >> np.uint64(8 * block)) & np.uint64(255)).astype(np.uint8)
        out.append(np.bitwise_count(value[:, None] ^ own[None, :]) <= radius // 8)
    return out


def candidates(tables: list[np.ndarray], prints: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (number of the query, number of the fingerprint) within the radius."""
    near = np.zeros((len(queries), len(prints)), bool)
    for block, table in enumerate(tables):
        near |= table[((queries >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)]
    q, i = np.nonzero(near)
    close = np.bitwise_count(prints[i] ^ queries[q]) <= radius
    return q[close], i[close]


def _windows(bench: Benchmark, weight: np.ndarray, own: np.ndarray, first: np.ndarray, similarity: float):
    """Places and sizes, in shingles, of the windows that may reach the similarity, by item size.

    With W the weight of the window and I that of the item, they share similarity / (1 + similarity) * (W + I)
    at least, and no more than what the window holds of the items' shingles."""
    share = similarity / (1 + similarity)
    gain = np.concatenate(([0.0], np.cumsum(own - share * weight)))
    words = np.diff(first)
    low = np.minimum(first[:-1], len(gain) - 1)
    high = np.maximum(np.minimum(first[1:] - 1, len(gain) - 1), low)
    whole = gain[high] - gain[low]
    for size, items in bench.by_size.items():
        if size == 1:
            continue
        pairs, least = size - 1, share * bench.total[items].min() - 1e-6
        at = np.flatnonzero(gain[pairs:] - gain[:-pairs] >= least) if pairs < len(gain) else np.zeros(0, np.int64)
        short = np.flatnonzero((words > 1) & (words < size) & (whole >= least))
        yield size, np.concatenate((at, low[short])), np.concatenate((np.full(len(at), pairs), words[short] - 1))


def _may(bench: Benchmark, number: np.ndarray, total: np.ndarray, at: np.ndarray, n: np.ndarray, item: np.ndarray, similarity: float) -> np.ndarray:
    """Which windows hold enough of their item's own shingles, repeated ones counted in full."""
    share, out = similarity / (1 + similarity), np.zeros(len(at), bool)
    for pairs in np.unique(n).tolist():
        some = np.flatnonzero(n == pairs)
        for lot in np.array_split(some, 1 + len(some) * pairs // (1 << 20)):
            found = number[at[lot][:, None] + np.arange(pairs)]
            key = item[lot][:, None] * len(bench.known) + found
            place = np.minimum(np.searchsorted(bench.members, key), len(bench.members) - 1)
            held = (bench.weight[np.maximum(found, 0)] * ((bench.members[place] == key) & (found >= 0))).sum(1)
            out[lot] = held >= share * (total[at[lot] + pairs] - total[at[lot]] + bench.total[item[lot]]) - 1e-6
    return out


def _scan(bench: Benchmark, part: pa.RecordBatch, similarity: float, radius: int = RADIUS):
    """(row, item, first word, words, hamming, similarity) of a slice's matches, the best window for each row and item."""
    h, doc, first = common.words(part.column("text"))
    if not len(bench.ids) or not len(h):
        return
    best: dict[tuple[int, int], tuple] = {}
    if 1 in bench.by_size:  # an item of one word is held by a document of that word alone
        for row in np.flatnonzero(np.diff(first) == 1).tolist():
            for item in bench.by_size[1].tolist():
                if bench.known[bench.bags[item][0][0]] == h[first[row]]:
                    best[row, item] = (0, 1, 0, 1.0)
    keys = common.window_hash(h, 2)
    number = bench.look(keys)
    held = np.where(number >= 0, bench.weight[np.maximum(number, 0)], 0.0)
    weight = np.where(number >= 0, held, bench.other)
    # no window may hold the pair of two documents' words
    apart = doc[1:] != doc[:-1]
    cost, own = np.where(apart, 1e9, weight), np.where(apart, 0.0, held)
    total = np.concatenate(([0.0], np.cumsum(weight)))
    windows = [(size, at, n) for size, at, n in _windows(bench, cost, own, first, similarity) if len(at)]
    if windows:
        covered = np.zeros(len(keys) + 1, np.int64)
        for _, at, n in windows:
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
        rank = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
        used = np.flatnonzero(np.diff(rank))
        signs = ((common.mix(keys[used])[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1
        sums = np.zeros((len(used) + 1, 64))
        np.cumsum(signs * weight[used][:, None], axis=0, out=sums[1:])
    for size, at, n in windows:
        items = bench.by_size[size]
        for lot in range(0, len(at), 8192):
            a, m = at[lot : lot + 8192], n[lot : lot + 8192]
            prints = np.bitwise_or.reduce(np.where(sums[rank[a + m]] - sums[rank[a]] > 1e-7, np.uint64(1) << _BITS, np.uint64(0)), axis=1)
            q, i = candidates(bench.tables[size], bench.prints[items], prints, radius)
            enough = _may(bench, number, total, a[q], m[q], items[i], similarity)
            for q, i in zip(q[enough].tolist(), i[enough].tolist()):
                item, start, pairs = int(items[i]), int(a[q]), int(m[q])
                numbers = number[start : start + pairs]
                known, counts = np.unique(numbers[numbers >= 0], return_counts=True)
                bag, times = bench.bags[item]
                _, x, y = np.intersect1d(known, bag, assume_unique=True, return_indices=True)
                shared = (np.minimum(counts[x], times[y]) * bench.weight[known[x]]).sum()
                whole = (bench.weight[known] * counts).sum() + bench.other * (pairs - counts.sum())
                value = float(shared / (whole + bench.total[item] - shared))
                row = int(doc[start])
                if value >= similarity - 1e-9 and ((row, item) not in best or (-round(value, 12), start) < (-round(best[row, item][3], 12), best[row, item][0] + first[row])):
                    best[row, item] = (start - int(first[row]), pairs + 1, int(np.bitwise_count(bench.prints[item] ^ prints[q])), value)
    for (row, item), found in sorted(best.items()):
        yield row, item, *found


def _parts(benchmark: DataFrame, most: int):
    """The benchmark in parts of bounded size, by a hash of the item, with counts of the whole."""
    benchmark = benchmark.select("item_id", "text")
    size = benchmark.select(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + size // most
    if n == 1:
        rows = benchmark.collect()
        yield Benchmark([r.item_id for r in rows], [r.text for r in rows])
        return
    parts = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))

    def shingles(batches):
        for batch in batches:
            for text, part in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist()):
                h, _, _ = common.words(pa.array([text], pa.string()))
                own = np.unique(_shingles(h)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([part] * len(own), pa.int64()), pa.array(np.arange(len(own)) == 0)], ["shingle", "part", "head"])

    held = common.stored(parts.mapInArrow(common.tidied(shingles), "shingle bigint, part bigint, head boolean"), "shingles")
    items = held.where("head").count()
    counted = held.groupBy("shingle").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts"))
    for i in range(n):
        rows = parts.where(F.col("part") == i).collect()
        counts = {r.shingle % (1 << 64): r.n for r in counted.where(F.array_contains("parts", F.lit(i).cast("bigint"))).collect()}
        yield Benchmark([r.item_id for r in rows], [r.text for r in rows], counts, items)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = PART_CHARS) -> DataFrame:
    """A row for each document and item that it holds."""
    found = None
    for bench in _parts(benchmark, most):

        def run(batches, bench=bench):
            for batch in batches:
                for part in common.slices(batch):
                    rows = list(_scan(bench, part, similarity))
                    if rows:
                        row, item, a, span, hamming, value = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [pc.cast(part.column("doc_id"), pa.int64()).take(pa.array(row)), pa.array([bench.ids[x] for x in item], pa.int64()), pa.array(a, pa.int32()), pa.array(span, pa.int32()), pa.array(hamming, pa.int32()), pa.array(value, pa.float64())],
                            ["doc_id", "item_id", "first_word", "words", "hamming", "similarity"],
                        )

        own = docs.select("doc_id", "text").mapInArrow(common.tidied(run), MATCH)
        found = own if found is None else found.unionByName(own)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = PART_CHARS) -> DataFrame:
    """docs without the rows that hold an item."""
    for bench in _parts(benchmark, most):

        def run(batches, bench=bench):
            for batch in batches:
                for part in common.slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[sorted({row for row, *_ in _scan(bench, part, similarity)})] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(common.tidied(run), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
