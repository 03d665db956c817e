"""Cuts of continuous variables that say most about a label.

The counts of every (variable, value) by label come from one shuffle, equal values merged first. They are
laid out in ranges of (variable, value) and summed up along them, so that a variable with very many
values is spread over many tasks. From these running counts the entropy of both sides of any cut within
any interval follows directly. Each pass cuts all open intervals of all variables at their best place; an
interval stays whole when the cut does not pay for its description (the rule of minimum description
length). What reaches the driver is one row for each open interval.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import join_small, stage
from tierwatch.operators.cleaning import distinct_values
from tierwatch.operators.counting import value_counts


@dataclass(frozen=True)
class _Interval:
    """Values above `low` up to `high` of variable `v`, with the running counts before and at its end."""

    v: int
    low: float
    high: float
    before: tuple[int, ...]
    upto: tuple[int, ...]


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of rows of counts."""
    n = counts.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(n > 0, counts / n, 0.0)
        return -np.where(p > 0, p * np.log2(p), 0.0).sum(axis=-1)


def _pays(whole: np.ndarray, left: np.ndarray) -> bool:
    """Whether a cut pays for its description, given the counts of the interval and of its left side."""
    right = whole - left
    n = int(whole.sum())
    h, h1, h2 = (float(_entropy(x)) for x in (whole, left, right))
    k, k1, k2 = (int((x > 0).sum()) for x in (whole, left, right))
    gain = h - (left.sum() * h1 + right.sum() * h2) / n
    return gain > (math.log2(n - 1) + math.log2(3**k - 2) - (k * h - k1 * h1 - k2 * h2)) / n


def running_counts(df: DataFrame, label: str, cols: Sequence[str], labels: Sequence) -> DataFrame:
    """(v, value, upto): counts by label of all values of variable v up to `value`, staged.

    Missing values are left out.
    """
    names = [f"n{j}" for j in range(len(labels))]
    counts = value_counts(df.select(quoted(label), *[quoted(c) for c in cols]), label, cols, labels)
    counts = counts.select("v", F.col("value").cast("double").alias("value"), *names)
    counts = counts.where(F.col("value").isNotNull() & ~F.isnan("value"))
    ranges = stage(
        counts.repartitionByRange("v", "value").withColumn("segment", F.spark_partition_id()), "value-counts", codec="zstd"
    )
    earlier = Window.partitionBy("v").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("v", "segment").agg(*[F.sum(n).alias(n) for n in names])
    # One row for each variable and range that holds it.
    offsets = totals.select("v", "segment", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in names])
    inside = Window.partitionBy("v", "segment").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.array(*[F.sum(n).over(inside) + F.col(f"before_{n}") for n in names])
    return stage(join_small(ranges, offsets, ["v", "segment"]).select("v", "value", upto.alias("upto")), "running-counts", codec="zstd")


def supervised_cuts(
    df: DataFrame, label: str, cols: Sequence[str], labels: Sequence | None = None, depth: int | None = None
) -> dict[str, list[float]]:
    """For each column, the values that end an interval (the largest value ends none).

    A cut is the value whose two sides have the least mean entropy of the label, the smallest among equals.
    `depth` limits how often an interval may be cut again; None means as often as it pays.
    """
    found = distinct_values(df, label) if labels is None else list(labels)
    if not found:
        return {c: [] for c in cols}
    running = running_counts(df, label, cols, found)
    ends = running.groupBy("v").agg(F.max_by("upto", "value").alias("upto"), F.max("value").alias("high"))
    none = (0,) * len(found)
    open_ = [_Interval(r["v"], -math.inf, r["high"], none, tuple(r["upto"])) for r in ends.collect()]
    cuts: dict[int, list[float]] = {i: [] for i in range(len(cols))}
    level = 0
    while open_ and (depth is None or level < depth):
        level += 1
        after = []
        for at, (value, upto) in _best_cuts(running, open_).items():
            one = open_[at]
            whole, left = np.array(one.upto) - one.before, np.array(upto) - one.before
            if _pays(whole, left):
                cuts[one.v].append(value)
                after.append(_Interval(one.v, one.low, value, one.before, tuple(upto)))
                after.append(_Interval(one.v, value, one.high, tuple(upto), one.upto))
        open_ = after
    return {c: sorted(cuts[i]) for i, c in enumerate(cols)}


def _best_cuts(running: DataFrame, open_: list[_Interval]) -> dict[int, tuple[float, list[int]]]:
    """For each open interval that can be cut: the value that ends its best left side, and the counts up to it."""
    order = sorted(range(len(open_)), key=lambda i: (open_[i].v, open_[i].high))
    plain = [(i, open_[i].v, open_[i].low, open_[i].high, open_[i].before, open_[i].upto) for i in order]
    shared = running.sparkSession.sparkContext.broadcast(plain)

    def best(batches) -> Iterator[pa.RecordBatch]:
        by_variable: dict[int, list[tuple]] = {}
        for i, variable, *one in shared.value:
            by_variable.setdefault(variable, []).append((i, *one))
        top: dict[int, tuple] = {}
        for batch in batches:
            v, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            upto = batch.column(2).flatten().to_numpy().reshape(len(v), -1)
            for variable in np.unique(v).tolist():
                own = by_variable.get(variable, [])
                rows = np.flatnonzero(v == variable)
                place = np.searchsorted(np.array([one[2] for one in own]), value[rows], "left")
                for nth, (i, low, high, before, end) in enumerate(own):
                    mine = rows[(place == nth) & (value[rows] > low) & (value[rows] < high)]
                    if not len(mine):
                        continue
                    left, right = upto[mine] - np.array(before), np.array(end) - upto[mine]
                    cost = np.round(left.sum(axis=1) * _entropy(left) + right.sum(axis=1) * _entropy(right), 6)
                    at = np.lexsort((value[mine], cost))[0]
                    new = (float(cost[at]), float(value[mine[at]]), upto[mine[at]].tolist())
                    if i not in top or new[:2] < top[i][:2]:
                        top[i] = new
        rows = [(i, *x) for i, x in top.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[3] for r in rows], pa.list_(pa.int64())),
            ],
            ["i", "cost", "value", "upto"],
        )

    sent = running.mapInArrow(best, "i int, cost double, value double, upto array<long>")
    # One row for each open interval.
    chosen = sent.groupBy("i").agg(F.min(F.struct("cost", "value", "upto")).alias("b")).collect()
    return {r["i"]: (r["b"]["value"], r["b"]["upto"]) for r in chosen}


def cut_columns(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Replace columns by the number of their interval, from 0; missing values stay missing.

    One projection, with the cuts as literals.
    """

    def number(c: str):
        x = F.col(quoted(c)).cast("double")
        ends = F.array(*[F.lit(float(e)) for e in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
        return F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(ends, lambda e: e < x)))

    return df.withColumns({c: number(c) for c in cuts})
