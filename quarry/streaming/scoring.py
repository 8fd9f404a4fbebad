"""Scoring a stream with fitted models: the operators are stateless for each row, so they run on a stream as on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True):
    """Starts a query that writes score(stream) as Parquet, exactly once for each input row. once: all there is, then stop."""
    out = score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
