"""Repeated passages by a depth-limited radix sort of all suffixes.

Words are maximal runs of characters other than white space, as written. The
suffixes of all documents (from each word on that has ``WINDOW`` words) are
ordered through WINDOW words only, by passes over digits, the most significant
first. A digit is a hash of consecutive words of the suffix; a pass sends the
digit of each suffix still in play to its bucket, where equal digits meet, and a
suffix that is alone with its digit is out of play. The first digit (short, enough
to part nearly all suffixes) covers the first ``HEAD`` words, the last one (64
bits) all WINDOW of them; suffixes that agree in it are compared by 32 bits of another
hash before they count as equal. Groups that are equal through the last digit are the
windows that occur more than once in the table, in different documents or in one; their
order among each other isn't needed and never materialised. Two different windows are
taken for equal with a chance of 2**-96 a pair.

Overlapping repeated windows of a document are merged into passages. Digits travel
as sorted differences, answers as bits (see ``ask``); texts are scanned again for
each pass instead of being moved.

Defined results: documents under WINDOW words (null and empty ones too) have no
passage. Repeated rows repeat each other wholly. Long texts are read whole, an empty
table has no passage, and extra columns don't matter. A null doc_id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import ask, common

WINDOW = 50
HEAD = 20
_OTHER = 0xC2B2AE3D27D4EB4F
_EXTRA = np.dtype([("mark", "<u4"), ("many", "?")])
PASSAGE = "doc_id bigint, first_word int, words int, first_byte int, bytes int"


class Suffixes:
    """The words of a chunk: their hashes, their row in the chunk, their place in the text, and where suffixes start."""

    def __init__(self, held: list[pa.RecordBatch], window: int):
        hashes, rows, spans, first, base = [], [], [], [], 0
        for part in held:
            data, offsets = common.flat(part.column("text"))
            starts, ends = common.spans(data, common.NOT_SPACE)
            doc, heads = common.owners(starts, offsets)
            hashes.append(common.span_hash(data, starts, ends))
            rows.append(doc + base)
            spans.append(np.stack([starts - offsets[doc], ends - offsets[doc]], 1))
            base += part.num_rows
        self.h = np.concatenate(hashes)
        self.row = np.concatenate(rows)
        self.span = np.concatenate(spans)
        n = max(0, len(self.h) - window + 1)
        self.start = np.flatnonzero(self.row[:n] == self.row[window - 1 :][:n])

    def mark(self, words: int, at: np.ndarray) -> np.ndarray:
        """The hash that verifies the last digit."""
        return (common.window_hash(self.h, words, _OTHER)[at] >> np.uint64(32)).astype(np.uint32)

    def digit(self, words: int, bits: int, at: np.ndarray) -> np.ndarray:
        """The digit of so many words and bits of the suffixes from the given words on."""
        return common.window_hash(self.h, words)[at] >> np.uint64(64 - bits)


def _groups(digit: np.ndarray, mark: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order by digit and mark, and where a group of equal ones begins in it."""
    order = np.argsort(digit)
    k = digit[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if mark is not None:
        m = mark[order]
        if (~new[1:] & (m[1:] != m[:-1])).any():
            order = np.lexsort((mark, digit))
            k, m = digit[order], mark[order]
            new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    return order, new


def _distinct(digit: np.ndarray, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct digits (with marks) in their order, and whether the chunk itself has each more than once."""
    order, new = _groups(digit, mark)
    return order[new], np.diff(np.append(np.flatnonzero(new), len(digit))) > 1


def _met_pairs(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Whether each digit occurs with the same mark elsewhere in keys too, or more than once in its chunk."""
    order, new = _groups(keys, extra["mark"])
    group = np.cumsum(new) - 1
    found = (np.bincount(group) > 1) | (np.bincount(group, weights=extra["many"][order]) > 0)
    out = np.empty(len(keys), bool)
    out[order] = found[group]
    return out


def _met(values: np.ndarray, digit: np.ndarray, mark: np.ndarray | None = None) -> np.ndarray:
    """Which suffixes have a digit that the bucket has seen twice."""
    order, new = _groups(digit, mark)
    group = np.cumsum(new) - 1
    if len(values) != (group[-1] + 1 if len(group) else 0):
        raise ValueError("the documents changed between two scans")
    out = np.zeros(len(digit), bool)
    out[order] = values[group]
    return out


def passages(docs: DataFrame, window: int = WINDOW, head: int = HEAD) -> DataFrame:
    """The repeated passages: place and length, in words (from 0) and bytes of the text."""
    head = min(head, window)
    docs = ask.steady(docs.select("doc_id", "text"))
    volume = ask.volume(docs)
    buckets, short = ask.buckets(docs.sparkSession, volume), ask.digit_bits(volume)

    def first_digit(part, row, held):
        s = Suffixes(held, window)
        digit = s.digit(head, short, s.start)
        one, many = _distinct(digit)
        return digit[one], many

    one = ask.post(ask.answered(ask.requests(docs.select("text"), first_digit, buckets, short), ask.seen_twice, np.dtype(bool)), "digit-one")

    def survivors(held, values):
        s = Suffixes(held, window)
        return s, s.start[_met(values, s.digit(head, short, s.start))]

    def last_digit(part, row, held, values):
        s, at = survivors(held, values)
        digit, mark = s.digit(window, 64, at), s.mark(window, at)
        one, many = _distinct(digit, mark)
        extra = np.zeros(len(one), _EXTRA)
        extra["mark"], extra["many"] = mark[one], many
        yield from ask.request_rows(part, row, digit[one], extra, buckets)

    asked = ask.told(docs.select("text"), one, bool, last_digit, ask.REQUEST)
    two = ask.post(ask.answered(asked, _met_pairs, _EXTRA), "digit-two")
    place = docs.select("doc_id", "text")

    def run(part, row, held, values, second):
        s, at = survivors(held, values)
        at = at[_met(second, s.digit(window, 64, at), s.mark(window, at))]
        if not len(at):
            return
        # windows that overlap or touch within a document make one passage
        apart = np.ones(len(at), bool)
        apart[1:] = (s.row[at[1:]] != s.row[at[:-1]]) | (at[1:] > at[:-1] + window)
        begin = at[apart]
        end = np.append(at[:-1][apart[1:]], at[-1]) + window - 1
        doc_id = pa.concat_arrays([pc.cast(x.column("doc_id"), pa.int64()) for x in held])
        of_row = np.searchsorted(s.row, s.row[begin])
        yield pa.RecordBatch.from_arrays(
            [
                doc_id.take(pa.array(s.row[begin])),
                pa.array(begin - of_row, pa.int32()),
                pa.array(end - begin + 1, pa.int32()),
                pa.array(s.span[begin, 0], pa.int32()),
                pa.array(s.span[end, 1] - s.span[begin, 0], pa.int32()),
            ],
            ["doc_id", "first_word", "words", "first_byte", "bytes"],
        )

    return ask.told_twice(place, one, two, bool, run, PASSAGE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH doc AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\v\f\r ]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM doc WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM win WHERE key IN (SELECT key FROM win GROUP BY key HAVING count(*) > 1)),
part AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM again)),
span AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW - 1} AS b FROM part GROUP BY doc_id, g),
place AS (
  SELECT doc_id, a, b,
         strlen(regexp_extract(text, '^[\t\n\v\f\r ]*')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '[^\t\n\v\f\r ]+[\t\n\v\f\r ]*')[1:a - 1], lambda x: strlen(x))), 0) AS first_byte,
         strlen(regexp_replace(array_to_string(regexp_extract_all(text, '[^\t\n\v\f\r ]+[\t\n\v\f\r ]*')[a:b], ''), '[\t\n\v\f\r ]+$', '')) AS bytes
  FROM span JOIN doc USING (doc_id))
SELECT doc_id, CAST(a - 1 AS INTEGER) AS first_word, CAST(b - a + 1 AS INTEGER) AS words,
       CAST(first_byte AS INTEGER) AS first_byte, CAST(bytes AS INTEGER) AS bytes
FROM place
"""
