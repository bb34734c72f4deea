"""Scoring of streams: a fitted model applied to a streaming frame, with an exactly-once file sink."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model: Any, stream: DataFrame, path: str, checkpoint: str, keep: list[str] | None = None) -> StreamingQuery:
    """Writes ``model.transform`` of every arriving row to Parquet; all that is available is read, then the query ends."""
    scored = model.transform(stream)
    scored = scored.select(*keep) if keep else scored
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
