"""Totals along the prefixes of the composite group: levels 0, 0 and 1, and so on.

Every record counts once for each depth. Records are counted at full depth first, and only those counts are
expanded to the shorter prefixes, so the expansion is as large as the groups, not the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import join_small
from tierwatch.operators.anomaly import NORMAL, OUTLIER


def level_rollup(df: DataFrame, levels: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """`(*extra, *levels, depth, grouping_id, n)`: sizes of every prefix of `levels`, from none to all.

    Levels beyond the depth are null, and `grouping_id` has a bit for each of them as in a grouping set, so
    that a label that is null itself is told apart. `extra` columns are part of every group.
    """
    keys = [quoted(c) for c in levels]
    full = df.groupBy(*[quoted(c) for c in extra], *keys).agg(F.count(F.lit(1)).alias("n"))
    depth = F.explode(F.sequence(F.lit(0), F.lit(len(levels))))
    held = full.withColumn("depth", depth)
    cut = held.withColumns({c: F.when(F.col("depth") > i, F.col(quoted(c))) for i, c in enumerate(levels)})
    sums = cut.groupBy(*[quoted(c) for c in extra], *keys, "depth").agg(F.sum("n").alias("n"))
    hidden = (F.shiftleft(F.lit(1), len(levels)) - 1).cast("long")
    grouping = F.expr(f"(1L << ({len(levels)} - depth)) - 1") if levels else F.lit(0).cast("long")
    return sums.withColumn("grouping_id", grouping if levels else hidden).select(
        *[quoted(c) for c in extra], *keys, "depth", "grouping_id", "n"
    )


def rollup_time_anomalies(df: DataFrame, ts: str, levels: Sequence[str], n: float = 3.0, bucket: str | None = None) -> DataFrame:
    """Time points of every prefix whose size lies n sample deviations from the prefix's mean over its points.

    `(timestamp, *levels, depth, n, outliers)`; points at which a prefix has no record do not occur.
    """
    at = F.date_trunc(bucket, F.col(quoted(ts))) if bucket else F.col(quoted(ts))
    counts = level_rollup(df.withColumn("timestamp", at), levels, ["timestamp"])
    keys = [*levels, "depth"]
    bands = counts.groupBy(*[quoted(c) for c in keys]).agg(F.avg("n").alias("__m"), F.stddev_samp("n").alias("__s"))
    bands = bands.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(keys)})
    same = F.expr(" AND ".join(f"{quoted(c)} <=> __{i}" for i, c in enumerate(keys)))
    inside = F.coalesce(F.abs(F.col("n") - F.col("__m")) < n * F.col("__s"), F.lit(False))
    both = join_small(counts, bands, same)
    return both.withColumn("outliers", F.when(inside, NORMAL).otherwise(OUTLIER)).select("timestamp", *[quoted(c) for c in keys], "n", "outliers")
