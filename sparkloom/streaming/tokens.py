"""Streams of lines and tokens. Tokenization has no state, so the batch function serves streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.cascade import exploded, tokenized


def token_stream(lines: DataFrame) -> DataFrame:
    """Tokens of a stream of lines (text, lang, and any others)."""
    return exploded(tokenized(lines), *[c for c in lines.columns if c not in ("text", "lang")])


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window, tumbling or sliding; rows later than the watermark are left out of a stream."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, length, slide) if slide else F.window(time, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by session: rows of a key with no longer gap between."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")
