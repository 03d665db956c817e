"""Counts of groups by time window as records arrive, with running statistics of each group.

Two queries with state. The first counts records per window and group under a watermark (partially
before the shuffle, so a group with very many records is no bottleneck); a window is written once, when
the watermark has passed it, and later records are dropped and counted by Spark. The second follows that
table: each group keeps its number of windows, mean and squared deviations, and every closed window
comes out with the statistics up to it.

The closed windows are a table that `time_anomalies` takes as it is, so that the report after all records
equals the batch report.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tierwatch.functions.names import quoted

COUNT = "timestamp timestamp, grupo string, n long"
POINT = "timestamp timestamp, grupo string, n long, windows long, mean double, m2 double"
STATE = "windows long, mean double, m2 double"


def count_windows(
    records: DataFrame,
    ts: str,
    group: str,
    path: str,
    checkpoint: str,
    window: str = "1 hour",
    delay: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append `(timestamp, grupo, n)` of each window that has records to Parquet files, once it is closed.

    Records later than `delay` behind the newest are dropped; `late_counts` tells of them. A record without a
    time is dropped. Windows that the watermark has not passed when the stream stops stay open in its
    state and go on when it is started again with the same `checkpoint`.
    """
    timed = records.select(F.col(quoted(ts)).cast("timestamp").alias("at"), F.col(quoted(group)).cast("string").alias("grupo"))
    counted = timed.withWatermark("at", delay).groupBy(F.window("at", window), "grupo").agg(F.count(F.lit(1)).alias("n"))
    return _written(counted.select(F.col("window.start").alias("timestamp"), "grupo", "n"), path, checkpoint, trigger)


def _written(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_running_statistics(counts: DataFrame) -> DataFrame:
    """Each closed window with its group's number of windows, mean and squared deviations up to it."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = []
        # The windows of a group that this step closes, in order.
        for at, n in sorted((at, n) for batch in batches for at, n in zip(batch["timestamp"], batch["n"])):
            windows += 1
            gap = n - mean
            mean += gap / windows
            m2 += gap * (n - mean)
            rows.append((at, key[0], n, windows, mean, m2))
        state.update((windows, mean, m2))
        yield pd.DataFrame(rows, columns=["timestamp", "grupo", "n", "windows", "mean", "m2"])

    return (
        counts.select("timestamp", "grupo", "n")
        .groupBy("grupo")
        .applyInPandasWithState(follow, POINT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def follow_windows(
    spark: SparkSession, counts_path: str, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append the windows that `count_windows` has written, with their groups' running statistics.

    The windows of a group that one step brings are taken in order of time.
    """
    counts = spark.readStream.schema(COUNT).parquet(counts_path)
    return _written(with_running_statistics(counts), path, checkpoint, trigger)


def late_counts(query: StreamingQuery) -> int:
    """How many counts came after their window was closed, over the progress that the query remembers.

    Records are counted before they meet the watermark, so late records of one task, window and group are one.
    """
    return sum(
        operator.get("numRowsDroppedByWatermark", 0) for step in query.recentProgress for operator in step["stateOperators"]
    )
