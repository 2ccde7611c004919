"""Streaming form of reference extraction: the same column functions over a stream, and windowed counts of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import references


def extract(stream: DataFrame, text: str, time: str) -> DataFrame:
    return stream.select(time, F.explode(references(F.col(text))).alias("r")).select(time, "r.type", "r.key")


def windowed(stream: DataFrame, text: str, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """References per window, type and key, with a watermark for late rows."""
    rows = extract(stream.withWatermark(time, late), text, time)
    return rows.groupBy(F.window(time, window), "type", "key").count()
