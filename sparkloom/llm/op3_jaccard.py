"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word 3-grams (words are runs of letters and digits in
lower case; a text of fewer words is one gram). Documents of Jaccard similarity
``THRESHOLD`` or more are linked. Equal texts are one node of the join, found by a
hash of 96 bits, and nodes of equal sets are one class of it; no pairs of either are made.

Grams are ordered by the number of distinct texts that hold them, counted over the
whole table. With o = size - ceil(t * size), two similar texts share at least l grams
among their first o + l, for any l. Each takes the l at which gathering its lists
and verifying the candidates left is cheapest, as estimated from its grams'
frequencies; a pair needs the smaller l of the two as shared prefix grams. A
text with more than o grams of its own has no partner and sends nothing.

Classes are linked in two rounds. First each is held against one that shares its
least grams under fixed hashes, which finds most groups with one verification a
member. Then all pairs that share enough prefix grams and aren't in one group yet
are verified, so the groups are exactly the connected components of the join.
Links are then counted within each group, in blocks of whole sets, without pairs
being written out. Lists of grams and groups beyond the size of a block are split
into cells that hold two blocks at most.

Defined results: texts without words (null and empty ones too) are in no group. Rows that repeat are distinct
copies of one text. The row that stays is that of the least doc_id (a null one is
last), then of the least text hash, then the first read. Columns pass through; nothing
is added to documents. An empty table has no groups; long texts are compared whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ask, common
from sparkloom.llm.components import components

N = 3
THRESHOLD = 0.5
LONGEST = 6
#: Cost of a list entry and of one gram of a candidate's verification.
ENTRY, GRAM = 1.0, 0.02
#: Least hashes of a set by which the first round finds a partner.
BANDS = 3
#: A gram of more texts than this has its list split; a group of more bytes of sets is compared in blocks.
HOT, BLOCK_BYTES = 4096, 4 << 20
ROW = "key bigint, first bigint, copies bigint, doc_id bigint, h bigint"
NODE = "key bigint, size int, need int, sig bigint, least array<bigint>, cold int, hot array<int>, prefix array<bigint>, grams binary"


def grams(held: list[pa.RecordBatch], n: int = N) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all grams of a chunk, the row of each in the chunk, and the number of rows."""
    found, rows, base = [], [], 0
    for part in held:
        h, doc, first = common.words(part.column("text"))
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < n))
        g = common.window_hash(h, n)
        inside = doc[: len(g)] == doc[n - 1 :] if len(g) else np.zeros(0, bool)
        found.append(g[inside])
        rows.append(doc[: len(g)][inside] + base)
        for d in short:
            found.append(common.window_hash(h[first[d] : first[d + 1]], int(count[d])))
            rows.append(np.array([d + base]))
        base += part.num_rows
    g = np.concatenate(found) if found else np.zeros(0, np.uint64)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.lexsort((r, g))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new], base


def _cut(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _frequency(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    new = _cut(keys[order])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=counts[order])
    out = np.empty(len(keys), np.uint32)
    out[order] = total.astype(np.uint32)[group]
    return out


def prefix_length(df: np.ndarray, size: int, unique: int, spare: int) -> tuple[int, int]:
    """The number of shared grams to need, and of grams to post; df ascends and leaves out grams of one text."""
    others = np.cumsum(df.astype(np.float64) - 1)
    best, found = None, (1, 0)
    for need in range(1, LONGEST + 1):
        length = spare - unique + need
        if length < need or length > len(df):
            break
        lists = others[length - 1]
        cost = lists * ENTRY + lists / need * size * GRAM
        if best is None or cost < best:
            best, found = cost, (need, length)
    return found


def rows(docs: DataFrame) -> DataFrame:
    """Each row that has words, with the key of the first row of its text and the number of those; docs must be steady."""
    text = F.coalesce("text", F.lit(""))
    place = F.monotonically_increasing_id()
    every = docs.select(
        (F.shiftleft(F.shiftright(place, 33), 32) + place.bitwiseAND(F.lit((1 << 33) - 1))).alias("key"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), text.rlike(r"[A-Za-z0-9]|[^\x00-\x7f]").alias("wordy"),
    )
    every = common.stored(every.where("wordy").drop("wordy"), "rows")
    first = every.groupBy("h", "c").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    return common.stored(every.join(first.hint("merge"), ["h", "c"]).select("key", "first", "copies", "doc_id", "h"), "copies")


@functools.lru_cache(2)
def _repeated(place: str, part: int) -> np.ndarray:
    """Numbers of the rows of a scan partition whose text came before."""
    return np.frombuffer(b"".join(ask.fetch(place, part).get(0, [])), np.uint32)


def _first_only(place: str, part: int, row: int, held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The slices with texts that came before made empty."""
    gone, out = _repeated(place, part), []
    for x in held:
        n = x.num_rows
        again = np.isin(np.arange(row, row + n), gone)
        row += n
        if again.any():
            at = x.schema.get_field_index("text")
            x = x.set_column(at, "text", pc.if_else(pa.array(again), "", x.column(at)))
        out.append(x)
    return out


def nodes(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, n: int = N, hot: int = HOT) -> DataFrame:
    """The texts that may have a partner, with prefix and set; docs must be steady, and found its rows()."""
    volume = ask.volume(docs)
    shift = np.uint64(64 - (bits := ask.digit_bits(volume)))
    skip = ask.post_rows(found.where("key <> first").select("key"))

    def keys(part, row, held):
        g, _, _ = grams(_first_only(skip, part, row, held), n)
        g >>= shift
        new = _cut(g)
        return g[new], np.diff(np.append(np.flatnonzero(new), len(g))).astype(np.uint32)

    asked = ask.requests(docs.select("text"), keys, ask.buckets(docs.sparkSession, volume), bits)
    place = ask.post(ask.answered(asked, _frequency, np.dtype(np.uint32)), "frequency")

    def use(part, row, held, df):
        g, r, total = grams(_first_only(skip, part, row, held), n)
        if not len(g):
            return
        which = np.cumsum(_cut(g >> shift)) - 1
        if which[-1] + 1 != len(df):
            raise ValueError("the documents changed between two scans")
        df = df[which]
        size = np.bincount(r, minlength=total)
        unique = np.bincount(r[df == 1], minlength=total)
        spare = size - np.ceil(threshold * size - 1e-9).astype(np.int64)
        live = (unique <= spare) & (size > 0)
        kept = live[r]
        g, r, df = g[kept], r[kept], df[kept]
        order = np.lexsort((g, df, r))
        g, df, r = g[order], df[order], r[order]
        ids = np.flatnonzero(live)
        cuts = np.searchsorted(r, np.append(ids, total))
        key = ask.row_key(part, row, total)[ids]
        made: list[tuple] = []
        for at, d in enumerate(ids):
            a, b = cuts[at], cuts[at + 1]
            low = a + int(unique[d])  # grams of one text come first
            if low == b:
                continue
            own = g[low:b]
            need, length = prefix_length(df[low:b], int(size[d]), int(unique[d]), int(spare[d]))
            sig = common.mix(own).sum(dtype=np.uint64) if unique[d] == 0 else common.mix(np.array([key[at]], np.uint64))[0]
            least = [common.mix(g[a:b] ^ np.uint64(k + 1)).min().astype(np.int64) for k in range(BANDS)]
            cold = int(np.searchsorted(df[low : low + length], hot, "right"))
            made.append((at, need, sig.astype(np.int64), least, cold, df[low + cold : low + length], own[:length].astype(np.int64), np.sort(own).tobytes()))
        if made:
            at = np.array([x[0] for x in made])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[at]),
                    pa.array(size[ids[at]], pa.int32()),
                    pa.array([x[1] for x in made], pa.int32()),
                    pa.array([x[2] for x in made], pa.int64()),
                    pa.array([x[3] for x in made], pa.list_(pa.int64())),
                    pa.array([x[4] for x in made], pa.int32()),
                    common.lists(np.concatenate([x[5] for x in made]), np.array([len(x[5]) for x in made]), pa.int32()),
                    common.lists(np.concatenate([x[6] for x in made]), np.array([len(x[6]) for x in made]), pa.int64()),
                    pa.array([x[7] for x in made], pa.binary()),
                ],
                ["key", "size", "need", "sig", "least", "cold", "hot", "prefix", "grams"],
            )

    return common.stored(ask.told(docs.select("text"), place, np.dtype(np.uint32), use, NODE), "nodes")


def _sets(found: DataFrame) -> DataFrame:
    return found.select("key", "size", "grams")


def verified(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least the similarity. Only sets that are in a pair move."""
    a = pairs.hint("merge").join(_sets(found).withColumnRenamed("key", "u"), "u").select("u", "v", F.col("size").alias("su"), F.col("grams").alias("gu"))
    b = pairs.select("v").distinct().hint("merge").join(_sets(found).withColumnRenamed("key", "v"), "v").select("v", F.col("size").alias("sv"), F.col("grams").alias("gv"))
    both = a.hint("merge").join(b, "v").select("u", "v", "su", "sv", "gu", "gv")

    def run(batches):
        for batch in batches:
            su, sv = batch.column("su").to_numpy(), batch.column("sv").to_numpy()
            shared = np.array([_overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column("gu"), batch.column("gv"))], np.int64)
            keep = pa.array(shared >= threshold * (su + sv - shared) - 1e-9, pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    return both.mapInArrow(common.tidied(run), "u bigint, v bigint")


def _overlap(a: bytes, b: bytes) -> int:
    x = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    x.sort()
    return int((x[1:] == x[:-1]).sum())


def _runs(batches, *names: str):
    """The rows of sorted batches, in tables that end where the values of the named columns change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        by = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in by], 0)) + 1
        joins = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in names)
        if held and not joins:
            yield pa.Table.from_batches(held)
            held = []
        if len(edges):
            cut = int(edges[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def across(posts: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """(u, v) of different groups that share as many prefix grams as they need.

    posts: key, size, need, root, cold, hot, prefix. A gram that more than ``hot`` texts
    hold has its list in cells of two blocks, unless all of it is in one group."""
    cold = posts.select("key", "size", "need", "root", F.explode(F.expr("slice(prefix, 1, cold)")).alias("gram")).withColumns({"i": F.lit(0), "j": F.lit(0), "own": F.lit(0)})
    many = posts.select("key", "size", "need", "root", F.inline(F.arrays_zip(F.expr("slice(prefix, cold + 1, size(prefix))"), "hot")).alias("gram", "df"))
    open_ = many.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("gram")
    many = many.join(open_, "gram", "left_semi").withColumn("blocks", F.ceil(F.col("df") / hot).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    many = many.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", "size", "need", "root", "gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    ready = cold.unionByName(many).repartition(common.shuffles(posts.sparkSession), "gram", "i", "j").sortWithinPartitions("gram", "i", "j")

    def run(batches):
        for table in _runs(batches, "gram", "i", "j"):
            gram, i, j, key, size, need, root, own = (table.column(c).to_numpy() for c in ("gram", "i", "j", "key", "size", "need", "root", "own"))
            heads = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            mixed = np.minimum.reduceat(root, heads) < np.maximum.reduceat(root, heads)
            us, vs, needs = [], [], []
            for a, b in zip(heads[mixed], np.append(heads[1:], len(gram))[mixed]):
                k, z, l, r, o = key[a:b], size[a:b], need[a:b], root[a:b], own[a:b]
                one_block = i[a] == j[a]
                for x in range(b - a):
                    y = np.flatnonzero((r != r[x]) & (k > k[x]) & (z >= z[x] * threshold - 1e-9) & (z[x] >= z * threshold - 1e-9) & (one_block | (o != o[x])))
                    us.append(np.full(len(y), k[x]))
                    vs.append(k[y])
                    needs.append(np.minimum(l[y], l[x]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(needs), pa.int32())], ["u", "v", "need"])

    found = ready.mapInArrow(common.tidied(run), "u bigint, v bigint, need int")
    return found.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("u", "v")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two sets share."""
    n = len(sets)
    every, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = _cut(every)
    column = np.cumsum(new) - 1
    again = (np.bincount(column) > 1)[column]
    column, row = column[again], row[again]
    column = np.cumsum(_cut(column)) - 1
    out = np.zeros((n, n), np.float32)
    wide = max(64, (4 << 20) // n)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        low, high = np.searchsorted(column, [a, a + wide])
        held = np.zeros((n, wide), np.float32)
        held[row[low:high], column[low:high] - a] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _linked_texts(kinds: DataFrame, found: DataFrame, threshold: float, block: int = BLOCK_BYTES) -> DataFrame:
    """(key, texts): how many texts of other classes a class is linked to. kinds: key, root, texts, size."""
    group = kinds.groupBy("root").agg(F.count("*").alias("n"), F.sum("texts").alias("all"), F.ceil(F.sum(F.col("size").cast("bigint") * 8) / block).cast("int").alias("blocks")).where("n > 1")
    kinds = kinds.join(group.hint("merge"), "root")
    two = kinds.where("n = 2").select("key", (F.col("all") - F.col("texts")).alias("linked"))  # a group of two is one link
    more = kinds.where("n > 2").select("key", "root", "texts", "blocks").hint("merge").join(_sets(found), "key")
    more = more.withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    more = more.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "texts", "size", "grams")
    ready = more.repartition(common.shuffles(kinds.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches):
        for table in _runs(batches, "root", "i", "j"):
            root, i, j, own, key, texts, size = (table.column(c).to_numpy() for c in ("root", "i", "j", "own", "key", "texts", "size"))
            grams_ = table.column("grams").combine_chunks()
            heads = np.flatnonzero(np.concatenate(([True], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            keys, sums = [], []
            for a, b in zip(heads, np.append(heads[1:], len(root))):
                shared = overlaps([np.frombuffer(grams_[int(x)].as_py(), np.uint64) for x in range(a, b)])
                z = size[a:b]
                near = shared >= threshold * (z[:, None] + z[None, :] - shared) - 1e-9
                near &= own[a:b, None] != own[None, a:b] if i[a] != j[a] else ~np.eye(b - a, dtype=bool)
                keys.append(key[a:b])
                sums.append(near @ texts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sums))], ["key", "linked"])

    counted = ready.mapInArrow(common.tidied(run), "key bigint, linked bigint")
    return two.unionByName(counted).groupBy("key").agg(F.sum("linked").alias("linked"))


def linked(found: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(key, kind, texts, size, root) of each node: the first node of its set, how many have that set, and its group."""
    small = found.select("key", "size", "sig")
    equal = small.groupBy("sig", "size").agg(F.min("key").alias("kind"), F.count("*").alias("texts"))
    kinds = common.stored(small.join(equal.hint("merge"), ["sig", "size"]).select("key", "kind", "texts", "size"), "kinds")
    first = kinds.where("key = kind").select("key")
    bands = found.select("key", F.posexplode("least").alias("band", "least")).join(first.hint("merge"), "key")
    hubs = bands.groupBy("band", "least").agg(F.min("key").alias("v"), F.max("key").alias("last")).where("v < last").select("band", "least", "v")
    stars = bands.join(hubs.hint("merge"), ["band", "least"]).where("key <> v").groupBy("key", "v").count()
    best = stars.groupBy("key").agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("v")).select(F.col("key").alias("u"), "v")
    root = components(verified(common.stored(best, "stars"), found, threshold))
    labels = common.stored(first.join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "roots")
    posts = found.select("key", "size", "need", "cold", "hot", "prefix").join(labels.hint("merge"), "key")
    edges = verified(common.stored(across(posts, threshold, hot), "across"), found, threshold)
    of = lambda c: labels.select(F.col("key").alias(c), F.col("root").alias(f"{c}_root"))
    joined = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    top = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    labels = labels.join(top, "root", "left").select(F.col("key").alias("kind"), F.coalesce("top", "root").alias("root"))
    return common.stored(kinds.join(labels.hint("merge"), "kind").select("key", "kind", "texts", "size", "root"), "groups")


def groups(docs: DataFrame, threshold: float = THRESHOLD, links: bool = True, hot: int = HOT, block: int = BLOCK_BYTES) -> DataFrame:
    """(key, doc_id, h, root, copies, links) of each row that has copies or links; docs must be steady.

    copies counts the rows of the same text, links the different texts that are similar."""
    with common.scratch(docs.sparkSession):
        every = rows(docs)
        found = nodes(docs, every, threshold, hot=hot)
        members = linked(found, threshold, hot)
        if links:
            kinds = members.where("key = kind").select("key", "root", "texts", "size")
            counted = _linked_texts(kinds, found, threshold, block).withColumnRenamed("key", "kind")
            members = members.join(counted.hint("merge"), "kind", "left").withColumn("links", F.coalesce("linked", F.lit(0)) + F.col("texts") - 1)
        else:
            members = members.withColumn("links", F.lit(None).cast("bigint"))
        grouped = members.groupBy("root").agg(F.count("*").alias("nodes"))
        members = members.join(grouped, "root").where("nodes > 1").select(F.col("key").alias("first"), "root", "links")
        out = every.join(members.hint("merge"), "first", "left").where("root is not null or copies > 1")
        out = out.select("key", "doc_id", "h", F.coalesce("root", "first").alias("root"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
        return common.stored(out, "grouped", kept=True)


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group."""
    docs = ask.steady(docs)
    found = groups(docs, threshold, links=False)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "key")
    stays = found.groupBy("root").agg(F.min_by("key", order).alias("key"))
    return ask.without(docs, found.join(stays.select("key"), "key", "left_anti").select("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document that has copies or links: the least doc_id of its group, the documents of its text, and its links to different texts."""
    docs = ask.steady(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = groups(docs)
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return found.join(least.hint("merge"), "root").select("doc_id", "class_id", F.col("copies").cast("int").alias("copies"), F.col("links").cast("int").alias("links"))
