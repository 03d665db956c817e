"""Row numbers, dense ranks, running totals and exact quantiles without a one-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import join_small, stage


def top_k(df: DataFrame, score: str, tiebreak: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tiebreak)).limit(k)


def best(df: DataFrame, name: str, score: str) -> DataFrame:
    """The single `(name, score)` with the highest score; ties go to the smallest name."""
    winner = F.min_by(F.struct(name, score), F.struct(-F.col(score), F.col(name)))
    return df.agg(winner.alias("w")).select("w.*")


def recode_levels(df: DataFrame, score: str, out: str = "level") -> DataFrame:
    """Dense ranks from 0 by descending score. Meant for one row per variable group."""
    return df.withColumn(out, F.dense_rank().over(Window.orderBy(F.desc(score))) - 1)


def cumulative_cut(
    df: DataFrame, group: str, order: str, share: str, threshold: float = 0.99999999, out: str = "Variance"
) -> DataFrame:
    """Running share per group, up to and including the row that crosses `threshold`."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.withColumn(out, F.sum(share).over(w))
    before = F.col(out) - F.col(share)
    return running.filter(before <= threshold)


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Global 1-based row numbers along `order`.

    A range partitioning is written once, so positions stay fixed if tasks are
    re-run; only one count per partition is then summed up in order.
    """
    segment, position = "__segment", "__position"
    order_cols = [F.col(quoted(c)) for c in order]
    located = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn(segment, F.shiftright("__id", 33))
        .withColumn(position, F.col("__id").bitwiseAND((1 << 33) - 1))
        .drop("__id")
    )
    fixed = stage(located, "ordered")
    earlier = Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy(segment)
        .count()
        .select(segment, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    )
    return (
        join_small(fixed, offsets, segment)
        .withColumn(name, F.col("__before") + F.col(position) + 1)
        .drop(segment, position, "__before")
    )


def paste(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Put two tables side by side by position, each along its own explicit order."""
    a = with_row_number(left, left_order)
    b = with_row_number(right, right_order)
    return a.join(b, "row_number").drop("row_number")


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """`(*by, variable, prob, value)` with linear interpolation between order statistics.

    Equal values are merged first, so a hot value is one row. The distinct values are
    then laid out in ranges, and only the ranges that hold a wanted rank are ranked.
    """
    keys = [*by, "variable"]
    values = (
        df.select(
            *by,
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("variable"), F.col(quoted(c)).cast("double").alias("value"))
                        for c in cols
                    ]
                )
            ),
        )
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranges = stage(
        values.repartitionByRange(*keys, "value").withColumn("segment", F.spark_partition_id()),
        "quantile-ranges",
    )
    by_group = Window.partitionBy(*keys)
    totals = (
        ranges.groupBy(*keys, "segment")
        .agg(F.sum("n").alias("size"))
        .withColumn("total", F.sum("size").over(by_group))
        .withColumn("before", F.sum("size").over(by_group.orderBy("segment")) - F.col("size"))
    )
    rank = F.col("prob") * (F.col("total") - 1)
    wanted = (
        totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
    )
    inside = Window.partitionBy(*keys, "segment").orderBy("value")
    picked = ranges.join(wanted.select(*keys, "segment").distinct(), [*keys, "segment"], "left_semi")
    ranked = picked.withColumn("upto", F.sum("n").over(inside)).withColumn("from", F.col("upto") - F.col("n"))
    local_rank = F.col("rank") - F.col("before")
    hits = ranked.join(wanted, [*keys, "segment"]).filter(
        (local_rank >= F.col("from")) & (local_rank < F.col("upto"))
    )
    low, high = F.min("value"), F.max("value")
    weight = F.first("prob") * (F.first("total") - 1)
    return hits.groupBy(*keys, "prob").agg(
        (low + (high - low) * (weight - F.floor(weight))).alias("value")
    )
