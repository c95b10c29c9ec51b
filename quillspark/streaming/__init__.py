"""References that arrive as a stream: duplicates dropped within a watermark, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.text import fingerprint


def first_seen(refs: DataFrame, time: str = "extracted_at", delay: str = "1 day") -> DataFrame:
    """Each reference of a paper once, as long as its copies come within `delay` of each other."""
    r = refs.filter(F.col(time).isNotNull()).withColumn("fingerprint", fingerprint(F.coalesce("raw_text", F.lit(""))))
    return r.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["paper_id", "fingerprint"])


def windowed_counts(refs: DataFrame, time: str = "extracted_at", window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """How many references of each type came in each window; rows later than `delay` are left out."""
    r = refs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return r.groupBy(F.window(time, window), "type").agg(F.count("*").alias("n"))
