"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram abc is bound into
rot(rot(A)) * rot(B) * C, elementwise, where rot is a fixed permutation (a
rotation); a text is the sum (bundle) of its trigram vectors. A language's
prototype is the sum of the unit vectors of its labelled texts, and a text gets
the language whose prototype has the largest cosine with it.

Bundling is one matrix product a slice: counts of trigrams by text, times the
vectors of the slice's distinct trigrams.

Defined results: runs of characters that aren't letters count as one boundary
symbol; a text without letters (empty, null, digits only) has language null and
cosine 0, and is rejected. Letters outside the basic plane count as boundaries.
Ties go to the language that sorts first. Repeated rows get equal results. An
empty table, or one without labels, gives no accepted row. Other columns pass
through; columns named as results are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

DIM = 1024
#: Labelled texts a language from which prototypes are fitted, at most.
FIT_ROWS = 400
#: A text is accepted from this cosine and this lead over the second language. The cosine of n
#: trigrams with their own language grows as sqrt(n / (n + SHORT)), and so does what is asked of it.
MIN_COSINE = 0.25
SHORT = 128
MIN_MARGIN = 0.02
DOCS_AT_ONCE = 128
_DENSE = 1 << 22
RESULTS = "language string, cosine double, margin double"


@functools.lru_cache(None)
def _letters() -> np.ndarray:
    """The symbol of each code point of the basic plane: itself for a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint16)


@functools.lru_cache(1 << 16)
def letter_vector(symbol: int, dim: int) -> np.ndarray:
    return (np.random.default_rng([7, symbol]).integers(0, 2, dim) * 2 - 1).astype(np.float32)


def trigram_vector(a: int, b: int, c: int, dim: int = DIM) -> np.ndarray:
    return np.roll(letter_vector(a, dim), 2) * np.roll(letter_vector(b, dim), 1) * letter_vector(c, dim)


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols with runs of boundaries as one, and the text of each."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    data = pc.binary_join_element_wise("", texts, "", " ")  # a boundary before and after
    code = np.frombuffer("".join(data.to_pylist()).encode("utf-32-le", "replace"), np.uint32)
    symbol = _letters()[np.where(code < 1 << 16, code, 0)]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (doc[1:] != doc[:-1])
    return symbol[keep], doc[keep]


def bundles(texts: pa.Array, dim: int = DIM):
    """The bundle of each text, a block of texts at a time."""
    for block, _ in _counted(texts, dim):
        yield block


def _counted(texts: pa.Array, dim: int):
    """As bundles, with the number of trigrams of each text."""
    symbol, doc = _symbols(texts)
    used = np.unique(symbol)
    rank = np.zeros(1 << 16, np.int64)
    rank[used] = np.arange(len(used))
    k = max(1, len(used))
    s = rank[symbol]
    gram = (s[:-2] * k + s[1:-1]) * k + s[2:]
    inside = doc[:-2] == doc[2:]
    gram, doc = gram[inside], doc[:-2][inside]
    if k**3 <= _DENSE:
        there = np.zeros(k**3, bool)
        there[gram] = True
        distinct = np.flatnonzero(there)
        at = np.zeros(k**3, np.int32)
        at[distinct] = np.arange(len(distinct))
        gram = at[gram]
    else:
        distinct, gram = np.unique(gram, return_inverse=True)
    base = np.stack([letter_vector(int(x), dim) for x in used]) if len(used) else np.zeros((1, dim), np.float32)
    vectors = np.roll(base, 2, axis=1)[distinct // (k * k)] * np.roll(base, 1, axis=1)[distinct // k % k] * base[distinct % k]
    u, n = len(distinct), len(texts)
    for low in range(0, n, DOCS_AT_ONCE):
        high = min(n, low + DOCS_AT_ONCE)
        i, j = np.searchsorted(doc, [low, high])
        counts = np.bincount((doc[i:j] - low) * u + gram[i:j], minlength=(high - low) * u).reshape(high - low, u)
        yield counts.astype(np.float32) @ vectors, counts.sum(1)


def fit(labelled: DataFrame, dim: int = DIM, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from ``rows`` labelled texts a language at most.

    The texts are those with the least hash of doc_id; rows with a null lang don't count."""
    ranked = labelled.where("lang is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("_o"))
    ranked.createOrReplaceTempView("_lang_rows")
    chosen = labelled.sparkSession.sql(
        f"select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by _o, doc_id) as r from _lang_rows) where r <= {int(rows)}"
    ).where("doc_id is not null").distinct()
    # at most `rows` ids a language: its size is set by the parameter, not by the data
    sample = labelled.where("lang is not null").select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")

    def bundle(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = np.zeros(dim, np.float64)
        for batch in group.select(["text"]).combine_chunks().to_batches():
            for part in common.slices(batch):
                for block in bundles(part.column("text"), dim):
                    norm = np.linalg.norm(block, axis=1, keepdims=True)
                    total += (block / np.maximum(norm, 1e-9)).sum(0)
        return pa.table({"lang": [key[0].as_py()], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    found = sorted((r.lang, r.v) for r in sample.groupBy("lang").applyInArrow(bundle, "lang string, v array<double>").collect())
    vectors = np.array([v for _, v in found], np.float64).reshape(len(found), dim)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [x for x, _ in found], (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


def least_cosine(trigrams: np.ndarray) -> np.ndarray:
    """The cosine from which a text of so many trigrams is accepted."""
    return MIN_COSINE * np.sqrt(trigrams / (trigrams + SHORT))


def score(texts: pa.Array, names: list[str], prototypes: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, its cosine, its lead over the second, and the number of trigrams, of each text."""
    cosines, sizes = [], [np.zeros(0, np.int64)]
    for block, size in _counted(texts, prototypes.shape[1]):
        sizes.append(size)
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        cosines.append(block @ prototypes.T / np.maximum(norm, 1e-9))
    c = np.concatenate(cosines).astype(np.float64) if cosines else np.zeros((0, len(names)))
    if not names:
        return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.concatenate(sizes)
    best = c.argmax(1)
    top = c[np.arange(len(c)), best]
    c[np.arange(len(c)), best] = -2
    second = np.where(len(names) > 1, c.max(1), 0.0)
    empty = top == 0
    return [None if e else names[b] for b, e in zip(best, empty)], top, np.where(empty, 0, top - second), np.concatenate(sizes)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, recognised: bool = False) -> DataFrame:
    """docs with language, cosine and margin; only those whose language is recognised, if so wished."""
    names, prototypes = list(names), np.asarray(prototypes)
    docs = docs.drop("language", "cosine", "margin")
    names_out = [*docs.columns, "language", "cosine", "margin"]

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                language, top, margin, size = score(part.column("text"), names, prototypes)
                out = pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(language, pa.string()), pa.array(top), pa.array(margin)],
                    names_out,
                )
                keep = (top >= least_cosine(size)) & (margin >= MIN_MARGIN)
                yield out if not recognised or keep.all() else out.filter(pa.array(keep))

    return docs.mapInArrow(common.tidied(run), common.extended(docs, RESULTS))


def accepted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose language is recognised, with language, cosine and margin."""
    names, prototypes = fit(docs if labelled is None else labelled)
    return identify(docs, names, prototypes, recognised=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return accepted(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "language", "cosine", "margin")
