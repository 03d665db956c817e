"""Classifying records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tierwatch.plans.taxonomy import Taxonomy


def score_stream(
    records: DataFrame, taxonomy: Taxonomy, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append each record with its level labels and group to Parquet files under `path`.

    Classification is a projection, so the stream keeps no state.
    """
    return (
        taxonomy.classify(records)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
