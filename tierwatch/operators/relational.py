"""Joins by record key, unions, and group-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import join_small
from tierwatch.operators.cleaning import distinct_values
from tierwatch.operators.ordering import exact_quantiles


def join_on_key(*tables: DataFrame, key: str, how: str = "full_outer") -> DataFrame:
    """Glue tables side by side by record key, keeping records that only some of them hold."""
    return reduce(lambda a, b: a.join(b, key, how), tables)


def append_rows(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def outer_weights(tables: Sequence[DataFrame], on: str = "variable") -> DataFrame:
    """Outer-join one weight table per cluster and fill the gaps with 0."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), tables).na.fill(0.0)


def group_sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def check_key(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """`(n_rows, n_keys, n_repeated)` for a record key.

    Exact counting groups by the key with partial aggregation, so a key that repeats
    very often costs one row per task and not one task.
    """
    if approximate:
        counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct(key).alias("n_keys"))
    else:
        counts = (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys"))
        )
    return counts.withColumn("n_repeated", F.col("n_rows") - F.col("n_keys"))


def require_unique(df: DataFrame, key: str) -> None:
    """Raise if a record key repeats: joins by it would multiply rows."""
    found = check_key(df, key).first()
    if found["n_repeated"]:
        raise ValueError(f"{key} repeats: {found['n_rows']} rows, {found['n_keys']} keys")


def col_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(quoted(c)).alias(c) for c in cols])


def with_mean_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Append the column means as one more row; other columns are null there."""
    return df.unionByName(col_means(df, cols), allowMissingColumns=True)


def divide_by_max(df: DataFrame, col: str, out: str) -> DataFrame:
    top = df.agg(F.max(quoted(col))).first()[0]
    return df.withColumn(out, F.col(quoted(col)) / F.lit(top))


def describe_cols(
    df: DataFrame, cols: Sequence[str], by: str | None = None, quartiles: str | None = "exact"
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per variable (and group).

    `quartiles` is "exact" (range-partitioned ranking), "approx" (a sketch) or None.
    """
    keys = [by] if by else []
    probs = (0.25, 0.5, 0.75)
    aggregates = []
    for i, c in enumerate(cols):
        x = F.col(quoted(c)).cast("double")
        fields = [
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]
        if quartiles == "approx":
            sketch = F.percentile_approx(x, list(probs))
            fields += [sketch[j].alias(f"p{int(p * 100)}") for j, p in enumerate(probs)]
        aggregates.append(F.struct(*fields).alias(f"d{i}"))
    wide = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"d{i}").alias("d")) for i, c in enumerate(cols)]
    stats = wide.select(*keys, F.inline(F.array(*rows))).select(*keys, "variable", "d.*")
    if quartiles != "exact":
        return stats
    cuts = (
        exact_quantiles(df, cols, probs, keys)
        .groupBy(*keys, "variable")
        .pivot("prob", list(probs))
        .agg(F.first("value"))
        .withColumnsRenamed({str(p): f"p{int(p * 100)}" for p in probs})
    )
    return stats.join(cuts, [*keys, "variable"], "left")


def time_group_matrix(df: DataFrame, ts: str, group: str, groups: Sequence | None = None) -> DataFrame:
    """Timestamps by groups, absent combinations as 0. Wide, so meant for a modest number of groups."""
    names = distinct_values(df, group) if groups is None else list(groups)
    return df.groupBy(ts).pivot(group, names).count().na.fill(0)


def attach_levels(groups: DataFrame, levels: DataFrame, on: str = "cluster") -> DataFrame:
    """Give every variable the level of its group."""
    return join_small(levels, groups, on)
