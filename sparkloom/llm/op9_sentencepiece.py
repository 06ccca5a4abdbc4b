"""SentencePiece encoding and decoding with a max-plus scan over giant documents.

The model is a byte-pair model whose pieces hold spaces only in front (or nothing
but spaces) and never a line feed, which always falls back to its byte. No merge
crosses the start of a unit (spaces and what follows up to the next space or line
feed), so a text's encoding is that of its units, one after the other; the
distinct units of a chunk of documents are encoded once by the library.

A text of more than ``GIANT_BYTES`` is cut about every ``CUT_BYTES``, between any two
characters, within a unit too. Around a cut all pieces of the vocabulary that fit the
text are edges of a lattice; a step from one piece to the next scores the piece if
the two keep apart when they are merged by themselves, and -inf if not. Merging works
by pairs, so a way of whole pieces that all keep apart is the encoding, and there
is only one. The state at a cut is the piece that covers the byte before it. A chunk
yields the max-plus matrix of the best score from each state at its start to each
at its end (units that no cut touches are edges of their own); the matrices are
combined by an associative scan, which gives the state at each cut, and every chunk is
then backtraced alone between its two states. The ids are those that the library
gives for the whole text. Shorter texts have no cuts and need no matrices.

Results: doc_id, n_tokens, ids, and whether the decoded ids are the text.

Defined results: null and empty texts have no ids and are exact. A text that holds
U+2581, which the model reads as a space, is encoded by the library at once and
isn't exact. Rows that repeat get equal rows. An empty table gives none. Other columns are left out.
"""

from __future__ import annotations

import functools
import itertools
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ask, common

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
GIANT_BYTES = 1 << 16
#: Units that the library gets as one text.
TOGETHER = 32
CUT_BYTES = 1 << 14
ENCODED = "doc_id bigint, n_tokens int, ids array<int>, exact boolean"
_NONE = -np.inf
_SPACE_MARK = "▁"


@functools.lru_cache(4)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(4)
def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, one after the other, their n + 1 offsets, and their scores."""
    sp = model(path)
    out, scores = [], []
    for i in range(sp.get_piece_size()):
        out.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(_SPACE_MARK, " ").encode())
        scores.append(0.0 if sp.is_byte(i) else sp.get_score(i))
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in out]))), np.array(scores)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + length - 1 of each, in a row."""
    total = np.cumsum(lengths)
    out = np.ones(int(total[-1]) if len(total) else 0, np.int64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    if len(s):
        out[0] = s[0]
        out[np.cumsum(n)[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def decoded(ids: np.ndarray, counts: np.ndarray, path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets, from all ids and their number in each."""
    data, offsets, _ = piece_bytes(path)
    lengths = np.diff(offsets)[ids]
    flat = data[ragged(offsets[ids], lengths)]
    ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
    drop = ends[:-1][(counts > 0)]  # the space before each text
    keep = np.ones(len(flat), bool)
    keep[drop] = False
    return flat[keep], ends - np.concatenate(([0], np.cumsum(counts > 0)))


def decode(ids: list[int], path: str = MODEL) -> str:
    return decoded(np.array(ids, np.int64), np.array([len(ids)]), path)[0].tobytes().decode("utf-8", "replace")


def _units(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Starts of the units; heads are the starts of texts."""
    first = np.zeros(len(data), bool)
    space, feed = data == 32, data == 10
    first[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    first[heads] = True
    return np.flatnonzero(first)


def _encode_units(units: list[bytes], path: str) -> list[list[int]]:
    """Ids of each unit; the library adds a space in front, so one is taken away or hidden by a line feed."""
    sp = model(path)
    out: list = [None] * len(units)
    spaced = [i for i, u in enumerate(units) if u[:1] == b" "]
    bare = [i for i, u in enumerate(units) if u[:1] != b" "]
    for i, ids in zip(spaced, sp.encode([units[i][1:].decode() for i in spaced], num_threads=1)):
        out[i] = ids or _lone(path)
    for i, ids in zip(bare, sp.encode(["\n" + units[i].decode() for i in bare], num_threads=1)):
        out[i] = ids[2:]
    return out


def _encode_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the units at these places of data, and the number of each one's. Data goes on behind each.

    The library gets some units as one text, with a line feed before each; none but a unit of its own holds one."""
    sp = model(path)
    feed = sp.piece_to_id("<0x0A>")
    alone = (ends - starts == 1) & (data[starts] == 10)
    lengths = (ends - starts)[~alone] + 1
    at = np.concatenate(([0], np.cumsum(lengths)))
    joined = np.concatenate((data[:1], data[ragged(starts[~alone], lengths)]))
    joined[at] = 10
    raw, cuts = joined.tobytes(), [*at[:-1:TOGETHER].tolist(), int(at[-1])]
    found = sp.encode([raw[a:b].decode() for a, b in itertools.pairwise(cuts)], num_threads=1)
    # without the space that the library adds to each text
    ids = np.fromiter(itertools.chain.from_iterable(x[1:] for x in found), np.int32, sum(map(len, found)) - len(found))
    heads = np.flatnonzero(ids == feed)
    size = np.ones(len(starts), np.int64)
    size[~alone] = np.diff(np.append(heads, len(ids))) - 1
    keep = ids != feed
    if alone.any():
        out = np.full(int(size.sum()), feed, np.int32)
        out[np.repeat(~alone, size)] = ids[keep]
        return out, size
    return ids[keep], size


@functools.lru_cache(4)
def _lone(path: str) -> list[int]:
    """A single space: what the library puts before a line feed."""
    return model(path).encode("\n")[:1]


class Units:
    """Encoded units by hash. A worker keeps up to ``MOST`` of them from chunk to chunk and then starts anew."""

    MOST = 1 << 19

    def __init__(self):
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def lacking(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.arange(len(h))
        return np.flatnonzero(self.hash[np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)] != h)

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """h is sorted and new; all ids, and the number of each one's."""
        at = len(self.pool) + np.cumsum(size) - size
        place = np.searchsorted(self.hash, h)
        self.hash, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.hash, h), (self.at, at), (self.size, size)))
        self.pool = np.concatenate([self.pool, ids])


@functools.lru_cache(1)
def _kept(path: str) -> list[Units]:
    return [Units()]


def encoded(texts: list[pa.Array], path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a chunk, and the number of each text's."""
    hashes, places, owner, base = [], [], [], 0
    flats = []
    for column in texts:
        column = pc.fill_null(column, "")
        filled = pc.greater(pc.binary_length(column), 0)
        spaced = pc.if_else(filled, pc.binary_join_element_wise(" ", column, ""), column)
        data, offsets = common.flat(spaced)
        # flat puts a space behind each text; it is made a line feed, a unit of its own that is left out
        data = data.copy()
        data[offsets[1:] - 1] = 10
        starts = _units(data, offsets[:-1])
        ends = np.append(starts[1:], len(data))
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, offsets[1:] - 1)] = False
        starts, ends = starts[real], ends[real]
        doc, _ = common.owners(starts, offsets)
        hashes.append(common.span_hash(data, starts, ends))
        places.append(np.stack([np.full(len(starts), len(flats)), starts, ends], 1))
        owner.append(doc + base)
        flats.append(data)
        base += len(column)
    h, place, doc = np.concatenate(hashes), np.concatenate(places), np.concatenate(owner)
    # the distinct units are few, so only they are sorted
    found = pa.array(h).dictionary_encode()
    keys = found.dictionary.to_numpy()
    order = np.argsort(keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, which = keys[order], rank[found.indices.to_numpy()]
    first = np.empty(len(keys), np.int64)  # a place of each
    first[which] = np.arange(len(h))
    kept = _kept(path)
    if len(kept[0].hash) > Units.MOST:
        kept[0] = Units()
    units = kept[0]
    new = units.lacking(keys)
    if len(new):
        part, a, b = place[first[new]].T
        shift = (np.cumsum([0, *map(len, flats)])[:-1])[part]
        units.add(keys[new], *_encode_spans(np.concatenate(flats), a + shift, b + shift, path))
    found = np.searchsorted(units.hash, keys)
    sizes, starts = units.size[found], units.at[found]
    lengths = sizes[which]
    flat = units.pool[ragged(starts[which], lengths)] if len(which) else np.zeros(0, np.int32)
    counts = np.bincount(doc, weights=lengths, minlength=base).astype(np.int64)
    marked = np.concatenate([pc.fill_null(pc.match_substring(x, _SPACE_MARK), False).to_numpy(zero_copy_only=False) for x in texts])
    if marked.any():
        rows = np.split(flat, np.cumsum(counts)[:-1])
        for r in np.flatnonzero(marked):
            text = next(x for i, x in enumerate(y for t in texts for y in t) if i == r).as_py()
            rows[r] = np.array(model(path).encode(text), np.int32)
        flat, counts = np.concatenate(rows), np.array([len(x) for x in rows])
    return flat, counts


def _small(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        for held in ask.chunks(batches, common.SLICE_BYTES):
            texts = [x.column("text") for x in held]
            ids, counts = encoded(texts, path)
            cuts, at = np.concatenate(([0], np.cumsum(counts))), 0
            for part, column in zip(held, texts):
                n = part.num_rows
                back, offsets = decoded(ids[cuts[at] : cuts[at + n]], counts[at : at + n], path)
                data, own = common.flat(column)
                own = own - np.arange(n + 1)  # without the spaces behind
                same = np.diff(own) == np.diff(offsets)
                keep = np.ones(len(data), bool)
                keep[own[1:] + np.arange(n)] = False
                given = data[keep]
                if not (same.all() and np.array_equal(given, back)):
                    a, b = given.tobytes(), back.tobytes()
                    same = np.array([a[own[i] : own[i + 1]] == b[offsets[i] : offsets[i + 1]] for i in range(n)])
                yield pa.RecordBatch.from_arrays(
                    [pc.cast(part.column("doc_id"), pa.int64()), pa.array(counts[at : at + n], pa.int32()), common.lists(ids[cuts[at] : cuts[at + n]], counts[at : at + n], pa.int32()), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "exact"],
                )
                at += n

    return docs.mapInArrow(common.tidied(run), ENCODED)


# Giant documents.


class Span(NamedTuple):
    """A piece of the lattice: its place in the text with a space in front, and its ids (the bytes of a character that is no piece)."""

    start: int
    end: int
    ids: tuple[int, ...]


class Pieces:
    """The vocabulary by its bytes, and which pieces keep apart."""

    def __init__(self, path: str):
        self.path = path
        data, offsets, self.scores = piece_bytes(path)
        sp = model(path)
        raw = data.tobytes()
        self.by: dict[bytes, int] = {}
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[raw[offsets[i]]] = i
            elif offsets[i] < offsets[i + 1]:
                self.by[raw[offsets[i] : offsets[i + 1]]] = i
        self.reach = max(map(len, self.by))
        self.apart: dict[tuple[bytes, bytes], bool] = {}

    def at(self, data: bytes, start: int, end: int, offset: int) -> list[Span]:
        """The pieces that start at a place and end in the unit."""
        out = [Span(offset + start, offset + e, (i,)) for e in range(start + 1, min(end, start + self.reach) + 1) if (i := self.by.get(data[start:e])) is not None]
        size = 1
        while start + size < end and data[start + size] & 0xC0 == 0x80:
            size += 1
        if data[start : start + size] not in self.by:  # a character that is no piece
            out.append(Span(offset + start, offset + start + size, tuple(self.byte[x] for x in data[start : start + size])))
        return out

    def score(self, span: Span) -> float:
        return float(sum(self.scores[i] for i in span.ids))

    def keep_apart(self, a: bytes, b: bytes, ids: tuple[int, ...]) -> bool:
        """Whether merging the bytes of two pieces gives the ids of both."""
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 1 << 18:
                self.apart.clear()
            found = self.apart[a, b] = tuple(_encode_units([a + b], self.path)[0]) == ids
        return found


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def cut_points(data: bytes, cut: int, path: str = MODEL) -> list[tuple[int, int, int, int]]:
    """(start, end) of chunks and of the bytes around that they see, in bytes of the text with its space in front."""
    points = [0]
    while points[-1] < len(data):
        at = points[-1] + cut
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        points.append(min(at, len(data)))
    flat = np.frombuffer(data, np.uint8)
    starts = np.append(_units(flat, np.array([0])), len(data))
    # a cut unit is seen as far as a piece that covers the cut may reach, and one byte on
    wide = 2 * pieces(path).reach + 4
    out = []
    for a, b in zip(points, points[1:]):
        low = max(int(starts[np.searchsorted(starts, a, "right") - 1]), a - wide)
        high = min(int(starts[np.searchsorted(starts, b, "left")]), b + wide)
        while data[low] & 0xC0 == 0x80:
            low += 1
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        out.append((a, b, low, high))
    return out


class Chunk:
    """The lattice of a chunk: bytes a to b of a text of which it sees data, from low on."""

    def __init__(self, data: bytes, low: int, a: int, b: int, path: str = MODEL):
        self.data, self.low, self.a, self.b, self.p = data, low, a, b, pieces(path)
        heads = _units(np.frombuffer(data, np.uint8), np.array([0]))
        self.heads = np.append(heads, len(data)) + low
        self.into, self.out = self.states(a), self.states(b)

    def states(self, cut: int) -> list[Span | None]:
        """The pieces that cover the byte before a cut; None at the start of a unit, where nothing goes on."""
        k = int(np.searchsorted(self.heads, cut, "right")) - 1
        if self.heads[k] == cut:
            return [None]
        first, last = int(self.heads[k]), int(self.heads[k + 1])
        found = []
        for start in range(max(first, cut - self.p.reach), cut):
            if self.data[start - self.low] & 0xC0 != 0x80:
                found += [x for x in self.p.at(self.data, start - self.low, last - self.low, self.low) if x.end >= cut]
        return found

    def _bytes(self, x: Span) -> bytes:
        return self.data[x.start - self.low : x.end - self.low]

    def ways(self, state: Span | None):
        """The states at the end that a state at the start leads to, each with its score and last step; and for each step the one before, with the ids of whole units between.

        A step is a span, or the start of a unit as its place."""
        at = self.a if state is None else state.end
        heads = set(self.heads.tolist())
        ends: dict[Span | None, tuple[float, Span | int]] = {}
        back: dict[Span | int, tuple[Span | int, list[int]]] = {}
        todo: dict[int, dict[Span | int, float]] = {at: {self.a if state is None else state: 0.0}}
        while todo:
            at = min(todo)
            steps = todo.pop(at)
            if at > self.b or at == self.b and at not in heads:
                ends |= {step: (score, step) for step, score in steps.items()}
                continue
            if at in heads:  # only one way comes to the start of a unit
                step, score = max(steps.items(), key=lambda x: x[1])
                k = last = int(np.searchsorted(self.heads, at))
                while last + 1 < len(self.heads) and self.heads[last + 1] <= self.b:
                    last += 1
                cuts = self.heads[k : last + 1] - self.low
                ids = [i for unit in _encode_units([self.data[x:y] for x, y in itertools.pairwise(cuts)], self.p.path) for i in unit]
                score += float(self.p.scores[ids].sum())
                at = int(self.heads[last])
                if at != step:
                    back[at] = (step, ids)
                steps = {at: score}
                if at >= self.b:
                    ends[None] = (score, at)
                    continue
            stop = int(self.heads[np.searchsorted(self.heads, at, "right")]) - self.low
            for x in self.p.at(self.data, at - self.low, stop, self.low):
                fit = [(score, step) for step, score in steps.items() if isinstance(step, int) or self.p.keep_apart(self._bytes(step), self._bytes(x), step.ids + x.ids)]
                if fit:
                    score, step = max(fit, key=lambda y: y[0])
                    back[x] = (step, [])
                    todo.setdefault(x.end, {})[x] = score + self.p.score(x)
        return ends, back

    def transfer(self) -> np.ndarray:
        """The max-plus matrix from states at the chunk's start to those at its end."""
        out = np.full((len(self.into), len(self.out)), _NONE)
        for i, state in enumerate(self.into):
            for end, (score, _) in self.ways(state)[0].items():
                out[i, self.out.index(end)] = score
        return out

    def backtrace(self, start: int, stop: int) -> list[int]:
        """Ids of the best way from one state to the other, without those of the first, which the chunk before has."""
        state, parts = self.into[start], []
        ends, back = self.ways(state)
        step = ends[self.out[stop]][1]
        while step in back:
            if not isinstance(step, int):
                parts.append(list(step.ids))
            step, between = back[step]
            parts.append(between)
        return [i for part in parts[::-1] for i in part]


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All products of the first 1, 2, ... matrices, by an associative scan in log n rounds."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [times(out[i - step], x) if i >= step else x for i, x in enumerate(out)]
        step *= 2
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states at the start and end of each chunk on the best way through all."""
    sums, state, out = scan(matrices), 0, []
    for i in range(len(matrices) - 1, -1, -1):
        before = 0 if i == 0 else int((sums[i - 1][0] + matrices[i][:, state]).argmax())
        out.append((before, state))
        state = before
    return out[::-1]


def _giant(docs: DataFrame, path: str, cut: int) -> DataFrame:
    one = docs.groupBy("doc_id", "text").agg(F.count("*").alias("n")).withColumn("uid", F.xxhash64("doc_id", "text"))
    one = common.stored(one.withColumn("uid", F.struct("uid", F.crc32(F.col("text").cast("binary")).alias("crc")).cast("string")), "giants")
    chunk = "uid string, no int, a int, b int, low int, seen binary"

    def cuts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = b" " + row["text"].encode()
                for part in itertools.batched(enumerate(cut_points(data, cut, path)), 64):
                    yield pa.RecordBatch.from_pylist(
                        [{"uid": row["uid"], "no": no, "a": a, "b": b, "low": low, "seen": data[low:high]} for no, (a, b, low, high) in part],
                        pa.schema([("uid", pa.string()), ("no", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("low", pa.int32()), ("seen", pa.binary())]),
                    )

    spread = common.shuffles(docs.sparkSession)
    chunks = common.stored(one.select("uid", "text").mapInArrow(common.tidied(cuts), chunk).repartition(spread, "uid", "no"), "chunks")

    def made(row) -> Chunk:
        return Chunk(row["seen"], row["low"], row["a"], row["b"], path)

    def matrices(batches):
        for batch in batches:
            found = [made(r).transfer() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("no"), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], ["uid", "no", "states", "matrix"]
            )

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        found = boundary_states([np.frombuffer(x).reshape(n, -1) for n, x in zip(table.column("states").to_pylist(), table.column("matrix").to_pylist())])
        return pa.table({"uid": table.column("uid"), "no": table.column("no"), "start": pa.array([s for s, _ in found], pa.int32()), "stop": pa.array([e for _, e in found], pa.int32())})

    at = chunks.mapInArrow(common.tidied(matrices), "uid string, no int, states int, matrix binary").groupBy("uid").applyInArrow(between, "uid string, no int, start int, stop int")

    def traced(batches):
        for batch in batches:
            found = [made(r).backtrace(r["start"], r["stop"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("no"), pa.array(found, pa.list_(pa.int32()))], ["uid", "no", "ids"])

    # a given number of partitions stays, however small the shuffle: the work is in the backtraces
    ids = chunks.join(at, ["uid", "no"]).repartition(spread, "uid", "no").mapInArrow(common.tidied(traced), "uid string, no int, ids array<int>")
    whole = ids.groupBy("uid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    both = one.join(whole, "uid").select("doc_id", "text", "n", "ids")

    def check(batches):
        for batch in batches:
            same = [decode(i, path) == t for i, t in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("ids"), pa.array(same, pa.bool_())], ["doc_id", "n", "ids", "exact"])

    done = both.mapInArrow(common.tidied(check), "doc_id bigint, n bigint, ids array<int>, exact boolean")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "exact")


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT_BYTES, cut: int = CUT_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids and exact of each row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    large = (F.octet_length("text") > giant) & ~F.col("text").contains(_SPACE_MARK)
    return _small(docs.where(~large), path).unionByName(_giant(docs.where(large), path, cut))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
