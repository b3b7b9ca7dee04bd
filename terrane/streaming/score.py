"""Cleaning-free stream helpers: the latest row per key within a watermark, and scoring with any fitted column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def first_per_key(stream: DataFrame, key: str, when: str, delay: str = "10 minutes") -> DataFrame:
    """Repeats of a key within the watermark are dropped; state is bounded by the delay."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def scored(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Fitted models are expressions, so a stream is scored like a table."""
    return stream.withColumns(columns)
