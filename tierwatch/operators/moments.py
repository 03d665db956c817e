"""Counts, means and squared deviations that can be merged: per level, cluster and variable.

One pass over the rows serves every level. A task keeps one row for each (level, cluster, variable); two such
rows merge into one without the values behind them, so the statistics of a new day are added to stored
ones, and scalers and bands follow from the sums without a rescan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = "level int, cluster int, variable string, n long, mean double, m2 double"
KEYS = ("level", "cluster", "variable")


def moments(df: DataFrame, levels: Sequence[tuple[int, Column, Sequence[tuple[str, Column]]]]) -> DataFrame:
    """`(level, cluster, variable, n, mean, m2)` of every cluster, from one pass over `df`.

    A level is its number, the cluster label of a row, and its variables as (name, value). Missing values are
    left out, and so are rows without a label.
    """
    plain, shape = [], []
    for number, label, variables in levels:
        shape.append((number, len(plain), [name for name, _ in variables]))
        plain.append(label.cast("int"))
        plain += [value.cast("double") for _, value in variables]
    held = df.select(*[c.alias(f"c{i}") for i, c in enumerate(plain)])

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, str], tuple[int, float, float]] = {}
        for batch in batches:
            for number, first, names in shape:
                labels = batch.column(first).to_numpy(zero_copy_only=False).astype(float)
                found = np.unique(labels[~np.isnan(labels)])
                for at, name in enumerate(names, first + 1):
                    x = batch.column(at).to_numpy(zero_copy_only=False)
                    for cluster in found.tolist():
                        own = x[(labels == cluster) & ~np.isnan(x)]
                        if not len(own):
                            continue
                        mean = float(own.mean())
                        new = (len(own), mean, float(((own - mean) ** 2).sum()))
                        key = (number, int(cluster), name)
                        total[key] = _added(total[key], new) if key in total else new
        rows = [(*key, *value) for key, value in total.items()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEYS, "n", "mean", "m2"])

    return merge_moments(held.mapInArrow(add_up, MOMENTS))


def _added(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def merge_moments(*tables: DataFrame) -> DataFrame:
    """One row for each level, cluster and variable of all `tables`.

    A key has at most one row for each task, or stored day, so its rows are merged in one fold, in a fixed order.
    """
    rows = reduce(DataFrame.unionByName, tables)
    part = F.struct("n", "mean", "m2")
    ordered = F.sort_array(F.collect_list(part))
    kind = "struct<n:bigint,mean:double,m2:double>"
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).cast(kind)

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(
            n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2")
        ).cast(kind)

    merged = rows.where("n > 0").groupBy(*KEYS).agg(F.aggregate(ordered, start, add).alias("s"))
    return merged.select(*KEYS, "s.n", "s.mean", "s.m2")


def cluster_scalers_from(table: DataFrame) -> DataFrame:
    """`(level, cluster, variable, mean, std)` with the population deviation, as scalers use it."""
    return table.select(*KEYS, "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))


def bands_from(table: DataFrame, n: float = 3.0) -> DataFrame:
    """`(level, cluster, variable, low, high)`: n sample deviations around the mean.

    As in `anomaly_fields`: a constant variable has no bounds, a single row has none that holds (null).
    """
    std = F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1))
    width = F.when(std == 0, F.lit(float("inf"))).otherwise(n * std)
    return table.select(*KEYS, (F.col("mean") - width).alias("low"), (F.col("mean") + width).alias("high"))
