"""Joins along time: the latest row at or before, runs of points, and rows inside intervals.

None of them compares every row with every other. Rows are laid out in ranges of (keys, time), so that one
key with very many rows fills several tasks; what a range needs from the ranges before it is one row for
each key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import join_small, measured, stage

# Intervals are cut into bins so that there are about so many pieces in all, besides one for each interval.
PIECES = 100_000


def _in_ranges(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """`df` written in ranges along `order`, with the number of each row's range as `__range`."""
    laid = df.repartitionByRange(*[F.col(quoted(c)) for c in order])
    return stage(laid.withColumn("__range", F.spark_partition_id()), label, codec="zstd")


def as_of_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Every row of `left` with the columns of the latest row of `right` at or before it, of the same key.

    Rows without such a match have nulls, and so have rows without a time. Of right rows with the same key and
    time the largest counts, column by column. Right columns (other than `by`) must not repeat names of `left`.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    own = [c for c in right.columns if c not in by]
    clash = sorted(set(own) & set(left.columns))
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    named = lambda df: [F.col(quoted(c)).alias(k) for c, k in zip(by, keys)]
    values = F.struct(*[F.col(quoted(c)) for c in own])
    rows = F.struct(*[F.col(quoted(c)) for c in left.columns])
    later = left.select(*named(left), F.col(quoted(left_ts)).alias("__ts"), F.lit(1).alias("__side"), rows.alias("__row"))
    earlier = right.where(F.col(quoted(right_ts)).isNotNull()).select(
        *named(right), F.col(quoted(right_ts)).alias("__ts"), F.lit(0).alias("__side"), values.alias("__value")
    )
    # At one time, right rows come first.
    laid = _in_ranges(later.unionByName(earlier, allowMissingColumns=True), [*keys, "__ts", "__side"], "as-of")
    inside = Window.partitionBy("__range", *keys).orderBy("__ts", "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    carried = laid.withColumn("__found", F.last("__value", ignorenulls=True).over(inside)).where("__side = 1")
    # What a range hands on: the last value of the ranges before it. One row for each key and range.
    last = F.max(F.when(F.col("__side") == 0, F.struct("__ts", "__value")))
    spans = laid.groupBy("__range", *keys).agg(last.alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    handed = spans.select(
        F.col("__range").alias("__r"), *[F.col(k).alias(f"{k}r") for k in keys],
        F.last("__end", ignorenulls=True).over(before)["__value"].alias("__handed"),
    ).where("__handed is not null")
    same = F.expr(" AND ".join(["__range = __r", *[f"{k} <=> {k}r" for k in keys]]))
    both = join_small(carried, handed, same)
    found = F.when(F.col("__ts").isNotNull(), F.coalesce("__found", "__handed"))
    both = both.withColumn("__match", found)
    return both.select(
        *[F.col("__row").getField(c).alias(c) for c in left.columns], *[F.col("__match").getField(c).alias(c) for c in own]
    )


def merge_runs(points: DataFrame, ts: str, gap_seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """`(*by, start, end, n)`: points of a key that are at most `gap_seconds` apart, merged into one interval.

    Points without a time are left out. Both ends are times of points.
    """
    keys = [quoted(c) for c in by]
    rows = points.where(F.col(quoted(ts)).isNotNull()).select(*keys, F.col(quoted(ts)).cast("timestamp").alias("__ts"))
    laid = _in_ranges(rows, [*by, "__ts"], "runs")

    def numbered(df: DataFrame, within: Sequence[str], start: str, end: str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(start, end)
        fresh = F.unix_micros(start) - F.unix_micros(F.lag(end).over(order)) > F.lit(int(gap_seconds * 1_000_000))
        return df.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(order))

    local = numbered(laid, ["__range", *keys], "__ts", "__ts").groupBy("__range", *keys, "__run").agg(
        F.min("__ts").alias("start"), F.max("__ts").alias("end"), F.count(F.lit(1)).alias("n")
    )
    ends = Window.partitionBy("__range", *keys)
    local = local.withColumn("__edge", (F.col("__run") == 1) | (F.col("__run") == F.max("__run").over(ends)))
    local = stage(local, "local-runs", codec="zstd")
    # Only the first and last run of a key in a range may go on in another: two rows for each key and range.
    edges = numbered(local.where("__edge").drop("__run"), keys, "start", "end") if keys else _numbered_alone(local, gap_seconds)
    merged = edges.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    result = [*keys, "start", "end", "n"]
    return merged.select(*result).unionByName(local.where("NOT __edge").select(*result))


def _numbered_alone(local: DataFrame, gap_seconds: float) -> DataFrame:
    """The edges of a table without keys: two rows for each range, so one task orders them."""
    order = Window.partitionBy(F.lit(0)).orderBy("start", "end")
    fresh = F.unix_micros("start") - F.unix_micros(F.lag("end").over(order)) > F.lit(int(gap_seconds * 1_000_000))
    edges = local.where("__edge").drop("__run").withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int"))
    return edges.withColumn("__run", F.sum("__new").over(order))


def _bin_micros(intervals: DataFrame) -> int:
    """A width of bins under which the intervals have about `PIECES` pieces besides one each."""
    span = intervals.agg(F.sum((F.unix_micros("end") - F.unix_micros("start")).cast("decimal(38,0)")).alias("s")).first()["s"]
    return max(int(span or 0) // PIECES, 1_000_000)


def _in_bins(intervals: DataFrame, width: int) -> DataFrame:
    """One row for each bin that an interval touches."""
    number = lambda c: F.floor(F.unix_micros(c) / width).cast("long")
    return intervals.where("start <= end").withColumn("__bin", F.explode(F.sequence(number("start"), number("end"))))


def rows_in_intervals(rows: DataFrame, ts: str, intervals: DataFrame, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows with every interval `(*by, start, end, ...)` of their key that holds them, ends included.

    An interval is cut into bins, a row has one bin, and both meet there; so a pair comes out once, and an
    interval over all time is spread over its bins. `how` is "inner" or "left".
    """
    width = _bin_micros(intervals)
    at = F.col(quoted(ts)).cast("timestamp")
    left = rows.withColumns({"__at": at, "__bin": F.floor(F.unix_micros(at) / width).cast("long")})
    pieces = _in_bins(intervals, width).withColumnsRenamed({c: f"__by{i}" for i, c in enumerate(by)}).withColumnRenamed("__bin", "__piece")
    same = ["__bin = __piece", "__at >= start", "__at <= end", *[f"{quoted(c)} <=> __by{i}" for i, c in enumerate(by)]]
    small = measured(pieces)
    joined = left.join(pieces if small is None else F.broadcast(small), F.expr(" AND ".join(same)), how)
    return joined.drop("__at", "__bin", "__piece", *[f"__by{i}" for i in range(len(by))])


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of intervals that share a time, ends included; both sides have `start` and `end`.

    The right side's become `other_start` and `other_end`. Both sides are cut into the same bins; a pair comes
    out in the bin where the later one starts, once.
    """
    width = max(_bin_micros(left), _bin_micros(right))
    own = _in_bins(left, width)
    other = _in_bins(right, width).withColumnsRenamed({"start": "other_start", "end": "other_end", "__bin": "__piece"})
    later = F.floor(F.greatest(F.unix_micros("start"), F.unix_micros("other_start")) / width)
    meet = (F.col("__bin") == F.col("__piece")) & (F.col("start") <= F.col("other_end")) & (F.col("other_start") <= F.col("end"))
    return own.join(other, meet & (F.col("__bin") == later)).drop("__bin", "__piece")
