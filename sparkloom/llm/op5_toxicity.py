"""Toxicity of text restored by a noisy-channel decoder.

A lexicon of toxic words is fitted for each language on labelled documents, and a
character 4-gram model is counted over all documents. Writers hide a word by look-alike
characters (1d10t, letters of other scripts), by spacing or marking it out (i d i o t,
i.d.i.o.t, id iot) and by repetition (iiidiot, i d i oo t), often without its accents.
Such a piece of text is a lattice: each character stands for one of the letters that it
resembles, or repeats its forerunner, or is a mark between letters, or stands for
itself, each at a cost. The Viterbi path through the lattice under the character model
is the restored word, and the restored words of a document are scored by the lexicon.

Only pieces whose lattice holds a lexicon word can change a score. A path keeps the
skeleton of a piece (look-alikes folded, marks dropped, repetitions merged), so
pieces whose skeleton no lexicon word has are passed over; that test runs on whole
slices, and leaves few pieces to decode. Pieces are runs between white space, and runs
of parts of up to ``PART`` letters that are at most ``GAP`` characters apart. Words
written plainly stand for themselves; a piece without digits has to have the accents
of the word, as another word may differ from it by them alone.

Copies of a labelled document would make all of its words look toxic. A word therefore
counts as often as its documents show it between different neighbours.

Defined results: null and empty texts score 0; a text is read whole, however long. A row
for each document whose score is ``LEAST_SCORE`` or more, a word counting once for a
document; repeated rows give repeated results. A language is the column lang (a null is
one too; without that column all rows are of one language); documents of a language
without toxic words are scored by those of all. Without toxic labels the lexicon is
empty and no row comes. A label row with a null counts for nothing; repeated labels of a
document count once, as toxic if one of them is. Of two words that restore to the same
letters the one of more weight counts. Other columns are left out.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

#: Labelled documents of each language and class on which the lexicon is fitted, at most.
FIT_ROWS = 4000
#: A lexicon word is in this share of its language's toxic sample and so many of its documents, and this much likelier there (natural logarithm).
MIN_SHARE, MIN_ROWS, MIN_ODDS, MIN_LETTERS = 0.05, 5, 3.0, 3
#: Log odds of a document's words, at least: of two of the weakest words, or of one that is hardly ever in other documents.
LEAST_SCORE = 6.0
#: Letters of a part, and characters between parts, of a word that is written in parts.
PART, GAP = 3, 3
FLAGGED = "doc_id bigint, score double, words array<string>, restored int"
#: Costs of the channel, in nats: a look-alike, a first and a further repetition (doubled letters are common), a mark, a character as itself where it is no letter.
ALIKE, REPEAT, AGAIN, MARK, ITSELF = 1.0, 6.0, 0.2, 0.7, 9.0

LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "у": "y", "ο": "o", "α": "a", "ν": "v",
}
_FOLD = {"l": "i", "z": "z", "b": "g"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ORDER = 4
_SIZE = 27
_PLANE = 1 << 16


@functools.lru_cache(1 << 12)
def bare(c: str) -> str:
    """A letter without its accents."""
    first = unicodedata.normalize("NFD", c)[:1]
    return first if first in _LETTERS and first else c


def folded(word: str) -> str:
    return "".join(map(bare, word))


def _fold(c: str) -> int:
    c = LOOK_ALIKES.get(c, bare(c))[0]
    return ord(_FOLD.get(c, c))


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code, for the first plane: the fold in runs and in marked text (0 parts pieces, 1 is dropped), whether it is a letter, its model symbol."""
    runs, letters, symbols = np.zeros(_PLANE, np.uint32), np.zeros(_PLANE, bool), np.zeros(_PLANE, np.int64)
    for code in range(_PLANE):
        c = chr(code)
        if c.isalpha() or c in LOOK_ALIKES:
            runs[code] = _fold(c)
            letters[code] = c.isalpha()
            if bare(c) in _LETTERS:
                symbols[code] = ord(bare(c)) - 96
    marked = runs.copy()
    for code in range(33, 127):
        if not chr(code).isalnum():
            marked[code] = 1
    return runs, marked, letters, symbols


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in lower case, each with a space after it, and the n + 1 offsets of the texts."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    data, _ = common.flat(low)
    # characters beyond the first plane are no letters of a lexicon
    codes = np.minimum(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), _PLANE - 1)
    return codes, np.concatenate(([0], np.cumsum(sizes)))


def skeleton(word: str) -> str:
    out = ""
    for c in word:
        f = chr(_fold(c))
        if out[-1:] != f:
            out += f
    return out


# The character model.


def counts(docs: DataFrame) -> np.ndarray:
    """Counts of all character 4-grams of all documents: letters without accents, and one symbol for what is between them."""
    cells = _SIZE**_ORDER

    def run(batches):
        total = np.zeros(cells, np.int64)
        symbol = _tables()[3]
        for batch in batches:
            for part in common.slices(batch):
                data, _ = _codes(part.column("text"))
                s = symbol[np.concatenate((np.full(3, 32, np.uint32), data))]
                total += np.bincount(((s[:-3] * _SIZE + s[1:-2]) * _SIZE + s[2:-1]) * _SIZE + s[3:], minlength=cells)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(common.tidied(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_model(count: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after three, backed off over shorter contexts."""
    c4 = count.reshape((_SIZE,) * 4).astype(np.float64)
    p = np.full((_SIZE,) * 4, 1 / _SIZE)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = c4.sum(axes, keepdims=True) if axes else c4
        p = (c + 5 * p) / (c.sum(3, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def restore(piece: str, model: np.ndarray) -> str:
    """The Viterbi path of a piece of text: the letters (without accents) that it most likely stands for."""
    # state: the last three symbols, the last letter read and whether it was repeated
    beam: dict[tuple, tuple[float, str]] = {(0, 0, 0, "", False): (0.0, "")}
    for c in piece.lower():
        now: dict[tuple, tuple[float, str]] = {}

        def put(state, cost, text, now=now):
            if state not in now or cost < now[state][0]:
                now[state] = (cost, text)

        plain = bare(c)
        same = _fold(c) if c in LOOK_ALIKES or plain in _LETTERS else 0
        for (x, y, z, last, more), (cost, text) in beam.items():
            options = [(plain, 0.0)] if plain in _LETTERS else [(o, ALIKE) for o in LOOK_ALIKES.get(c, "")]
            for letter, extra in options:
                s = ord(letter) - 96
                put((y, z, s, letter, False), cost + extra - float(model[x, y, z, s]), text + letter)
            if same and last and _fold(last) == same:
                put((x, y, z, last, True), cost + (AGAIN if more else REPEAT), text)
            if plain not in _LETTERS:
                if c not in LOOK_ALIKES:
                    put((x, y, z, last, more), cost + MARK, text)
                put((y, z, 0, last, False), cost + ITSELF - float(model[x, y, z, 0]), text + c)
        beam = now or beam
    return min((cost - float(model[x, y, z, 0]), text) for (x, y, z, *_), (cost, text) in beam.items())[1]


# The lexicon.


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[str | None, dict[str, float]]:
    """Toxic words and their weights by language, from ``rows`` labelled documents a language and class at most (those with the least hash of doc_id)."""
    by = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kinds = docs.select("doc_id", lang.alias("lang")).dropDuplicates(["doc_id"]).join(by, "doc_id")
    order = Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = kinds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= int(rows)).drop("r")
    # at most `rows` ids a language and class, whatever the tables' size
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    sample = common.stored(sample.withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).select("doc_id", "lang", "toxic", "w"), "labelled")
    size: dict = {}
    for r in sample.groupBy("lang", "toxic").agg(F.count("*").alias("n")).collect():
        size.setdefault(r.lang, {})[r.toxic] = r.n
    near = F.transform("w", lambda x, i: F.struct(x.alias("w"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    words = sample.select("doc_id", "lang", "toxic", F.explode(near).alias("x")).select("doc_id", "lang", "toxic", "x.*")
    by_doc = words.groupBy("lang", "w", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("near").alias("near"))
    found = by_doc.groupBy("lang", "w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("near"))).alias("places"))
    out: dict = {}
    for r in found.where((F.col("a") >= MIN_ROWS) & (F.char_length("w") >= MIN_LETTERS)).collect():
        bad, good = size[r.lang].get(1, 0), size[r.lang].get(0, 0)
        odds = math.log((r.a + 0.5) / (bad + 1)) - math.log((r.b + 0.5) / (good + 1))
        if r.a >= MIN_SHARE * bad and r.places >= max(MIN_ROWS, r.a / 2) and odds >= MIN_ODDS:
            out.setdefault(r.lang, {})[r.w] = odds
    return out


class Finder:
    """Finds plain and hidden words of a lexicon in slices of text."""

    def __init__(self, lexicon: dict[str, float], model: np.ndarray):
        self.lexicon, self.model = lexicon, model
        words = sorted(lexicon)
        hashed = self._hash(words)
        order = np.argsort(hashed)
        self.plain, self.names = hashed[order], [words[i] for i in order]
        self.texts = sorted({skeleton(w) for w in words})
        self.skeletons = np.sort(self._hash(self.texts))
        #: The word that restored letters stand for.
        self.stands: dict[str, str] = {}
        for w in sorted(words, key=lexicon.get):
            self.stands[folded(w)] = w
        self.restored = functools.lru_cache(1 << 14)(lambda piece: restore(piece, model))

    @staticmethod
    def _hash(items: list[str]) -> np.ndarray:
        if not items:
            return np.zeros(0, np.uint64)
        data = np.array([ord(c) for x in items for c in x], np.uint32)
        ends = np.cumsum([len(x) for x in items])
        return common.span_hash(data, np.concatenate(([0], ends[:-1])), ends)

    @staticmethod
    def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(keys), bool)
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return known[at] == keys

    def pieces(self, data: np.ndarray):
        """Starts and ends of pieces of which a lexicon word may have been made; data are codes of lower case."""
        runs, marked, is_letter, _ = _tables()
        letters = is_letter[data]
        solid = letters | ((data >= 48) & (data <= 57))
        some = np.concatenate(([0], np.cumsum(letters)))
        out = [self._parts(data, runs[data])]
        for fold in (runs[data], marked[data]):
            starts, ends = _spans(fold > 0)
            if not len(starts):
                continue
            real = fold > 1
            # the fold before each, dropped ones left out
            index = np.flatnonzero(real)
            kinds = fold[index]
            fresh = np.ones(len(index), bool)
            fresh[1:] = kinds[1:] != kinds[:-1]
            run = np.searchsorted(starts, index, "right") - 1
            fresh[1:] |= run[1:] != run[:-1]
            kept = kinds[fresh]
            rank = np.zeros(len(data) + 1, np.int64)
            mark = np.zeros(len(data), np.int64)
            mark[index[fresh]] = 1
            np.cumsum(mark, out=rank[1:])
            lettered = some[ends] > some[starts]
            starts, ends = starts[lettered], ends[lettered]
            if not len(starts):
                continue
            at = np.flatnonzero(solid)  # marks at either end may be punctuation
            inner = np.stack([at[np.searchsorted(at, starts)], at[np.searchsorted(at, ends) - 1] + 1])
            for s in (starts, inner[0]):
                for e in (ends, inner[1]):
                    # a trimmed start may lie within a repetition that began before it
                    low = np.where(mark[s] | ~real[s], rank[s], rank[s] - 1)
                    high = rank[e]
                    use = high > low
                    hit = np.zeros(len(s), bool)
                    hit[use] = self._in(common.span_hash(kept, low[use], high[use]), self.skeletons)
                    out.append(np.stack([s[hit], e[hit]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def _parts(self, data: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Consecutive short parts, near each other, that together spell a lexicon skeleton."""
        none = np.zeros((0, 2), np.int64)
        starts, ends = _spans(fold > 0)
        if not len(starts):
            return none
        change = np.concatenate(([0], np.cumsum(np.concatenate(([True], fold[1:] != fold[:-1])) & (fold > 0))))
        first = change[starts + 1]
        short = change[ends] - first + 1 <= PART
        near = short[1:] & short[:-1] & (starts[1:] - ends[:-1] <= GAP)
        joined = np.concatenate(([False], near)) | np.concatenate((near, [False]))
        if not joined.any():
            return none
        group = np.cumsum(np.concatenate(([True], ~near)))[joined]
        s, e = starts[joined], ends[joined]
        size = e - s
        index = np.repeat(s - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        owner = np.repeat(group, size)
        kinds = fold[index]
        fresh = np.ones(len(index), bool)
        fresh[1:] = (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(index)) - 1
        begins, stops = np.isin(index[heads], s), np.isin(index[tails] + 1, e)
        breaks = np.flatnonzero(np.concatenate(([False], owner[heads][1:] != owner[heads][:-1])))
        text = np.insert(kinds[fresh], breaks, 0)
        place = np.insert(np.arange(len(heads)), breaks, -1)
        text = text.astype("<u4").tobytes().decode("utf-32-le")
        found = []
        for word in self.texts:
            i = text.find(word)
            while i >= 0:
                a, b = place[i], place[i + len(word) - 1]
                if begins[a] and stops[b] and index[tails[b]] - index[heads[a]] >= tails[b] - heads[a] + 1:
                    found.append((index[heads[a]], index[tails[b]] + 1))
                i = text.find(word, i + 1)
        return np.array(found, np.int64).reshape(-1, 2)

    def scan(self, column: pa.Array) -> dict[int, tuple[dict[str, float], int]]:
        """Words found in each text, and how many of them were hidden."""
        data, offsets = _codes(column)
        out: dict[int, tuple[set, set]] = {}
        starts, ends = _spans(_tables()[2][data])
        h = common.span_hash(data, starts, ends)
        hit = np.flatnonzero(self._in(h, self.plain))
        for row, i in zip(np.searchsorted(offsets, starts[hit], "right") - 1, np.searchsorted(self.plain, h[hit])):
            out.setdefault(int(row), (set(), set()))[0].add(self.names[i])
        for a, b in self.pieces(data).tolist():
            piece = data[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace")
            word = self.stands.get(self.restored(piece))
            if word and (any(c.isdigit() for c in piece) or accents(piece) == accents(word)):
                found = out.setdefault(int(np.searchsorted(offsets, a, "right") - 1), (set(), set()))
                if word not in found[0]:
                    found[1].add(word)
        return {row: ({w: self.lexicon[w] for w in sorted(plain | hidden)}, len(hidden)) for row, (plain, hidden) in out.items()}


def accents(word: str) -> str:
    """The accented letters, without repetitions."""
    found = [c for c in word if bare(c) != c]
    return "".join(c for i, c in enumerate(found) if not i or c != found[i - 1])


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs; the last one must be outside."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    return edge[0::2], edge[1::2]


class Scorer:
    """A finder for each language that has a lexicon, and one of all words for the others."""

    def __init__(self, lexicons: dict[str | None, dict[str, float]], model: np.ndarray):
        every: dict[str, float] = {}
        for words in lexicons.values():
            every |= {w: max(o, every.get(w, 0.0)) for w, o in words.items()}
        self.by = {lang: Finder(words, model) for lang, words in lexicons.items()}
        self.other = Finder(every, model)

    def scan(self, texts: pa.Array, langs: list[str | None]) -> dict[int, tuple[dict[str, float], int]]:
        """Words found in each text, and how many of them were hidden."""
        rows: dict[Finder, list[int]] = {}
        for i, lang in enumerate(langs):
            rows.setdefault(self.by.get(lang, self.other), []).append(i)
        out = {}
        for finder, at in rows.items():
            if finder.lexicon:
                out |= {at[i]: x for i, x in finder.scan(texts.take(pa.array(at))).items()}
        return out


def flagged(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """A row for each toxic document: its score, the lexicon words, and how many had to be restored."""
    lexicons = fit(docs, labels)
    model = log_model(counts(docs))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        scorer = Scorer(lexicons, model)
        for batch in batches:
            for part in common.slices(batch):
                found = scorer.scan(part.column("text"), part.column("lang").to_pylist())
                found = [(row, sum(words.values()), list(words), hidden) for row, (words, hidden) in sorted(found.items()) if sum(words.values()) >= least]
                if found:
                    row, score, words, hidden = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pc.cast(part.column("doc_id"), pa.int64()).take(pa.array(row)), pa.array(score, pa.float64()), pa.array(words, pa.list_(pa.string())), pa.array(hidden, pa.int32())],
                        ["doc_id", "score", "words", "restored"],
                    )

    return docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(common.tidied(run), FLAGGED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
