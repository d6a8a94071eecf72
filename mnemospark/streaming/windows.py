"""Exact repeats and sessions by event time; the same functions over a table and over a stream.

Over a stream, a key is remembered for `delay` after its first row, and a session is given out once the watermark has passed its end; rows
that are later than the watermark change nothing. Over a table there is no watermark, so every row counts, and of a key's rows any
one stays. What is kept for keys and sessions that are over is dropped from the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def with_hash(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds text_hash: the hash by which exact repeats are known, blank and null texts alike."""
    return df.withColumn("text_hash", text.content_hash(F.coalesce(F.col(column), F.lit(""))))


def first_of_each(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row of each key; over a stream, one of those that lie less than `delay` after the key's first one."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(df: DataFrame, by: str, *measures: Column, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """by, began, ended (the last row's time plus the gap), n and the measures of each run of rows less than `gap` apart."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    found = timed.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), *measures)
    return found.select(by, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), *[c for c in found.columns if c not in ("w", by)])
