"""Distances and nearest centers as column expressions."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Generated code stays small enough for the JVM to compile up to about this many
# center coordinates; beyond it one Arrow batch product per partition is faster
# (280 coordinates over 2M rows: 8.0 s generated, 0.9 s batched).
UNROLL_TERMS = 120


def squared_distance(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    return reduce(operator.add, [(x - y) * (x - y) for x, y in zip(xs, ys, strict=True)])


def array_squared_distance(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d)


def euclidean(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(xs, ys))


def nearest(xs: Sequence[Column], centers: Sequence[Sequence[float]]) -> Column:
    """Index of the closest center; ties go to the lowest index.

    |x - c|^2 differs from |c|^2 - 2xc by |x|^2, which is the same for every center.
    A missing value (null or NaN) counts as 0 in either form of the computation.
    """
    if len(centers) == 1:
        return F.lit(0)
    if len(centers) * len(xs) > UNROLL_TERMS:
        return _nearest_batched(xs, centers)
    filled = [F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(0.0)).otherwise(x.cast("double")) for x in xs]
    scored = [
        F.struct(
            reduce(
                operator.add,
                [x * F.lit(-float(v)) for x, v in zip(filled, c, strict=True)],
                F.lit(sum(v * v for v in c) / 2.0),
            ).alias("score"),
            F.lit(i).alias("center"),
        )
        for i, c in enumerate(centers)
    ]
    return F.least(*scored)["center"]


def _nearest_batched(xs: Sequence[Column], centers: Sequence[Sequence[float]]) -> Column:
    points = np.asarray(centers, dtype="float64")
    half_norms = np.array([sum(v * v for v in c) / 2.0 for c in points.tolist()])

    @F.pandas_udf("int")
    def closest(*columns: pd.Series) -> pd.Series:
        # The same sums in the same order as the generated form, so that the labels agree.
        score = np.repeat(half_norms[None, :], len(columns[0]), axis=0)
        with np.errstate(invalid="ignore"):
            for column, weight in zip(columns, points.T):
                values = column.to_numpy(dtype="float64")
                score += np.where(np.isnan(values), 0.0, values)[:, None] * -weight
        # A score that is not a number is never the least, except if all are.
        least = np.where(np.isnan(score), np.inf, score).min(axis=1)
        return pd.Series(np.argmax(score == least[:, None], axis=1).astype("int32"))

    return closest(*xs)


def own_center_distance(
    xs: Sequence[Column], label: Column, centers: Sequence[Sequence[float]], squared: bool = False
) -> Column:
    """Distance of a row to the center of its own cluster, without a join."""
    tables = [F.array(*[F.lit(float(c[i])) for c in centers]) for i in range(len(xs))]
    own = [F.get(t, label.cast("int")) for t in tables]
    d2 = squared_distance(xs, own)
    return d2 if squared else F.sqrt(d2)
