"""Z-scores. Scaling uses the population deviation; a constant column scales to zero."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation per variable: as many numbers as there are columns."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], ddof: int = 0) -> Scaler:
        deviation = F.stddev_samp if ddof else F.stddev_pop
        row = df.agg(
            *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)],
            *[deviation(quoted(c)).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        return cls(
            {c: row[f"m{i}"] for i, c in enumerate(cols)},
            {c: row[f"s{i}"] for i, c in enumerate(cols)},
        )

    @classmethod
    def from_rows(cls, rows) -> Scaler:
        return cls({r["variable"]: r["mean"] for r in rows}, {r["variable"]: r["std"] for r in rows})

    def only(self, cols: Sequence[str]) -> Scaler:
        return Scaler({c: self.mean[c] for c in cols}, {c: self.std[c] for c in cols})

    def z(self, col: str) -> Column:
        mean, std = self.mean[col], self.std[col]
        if mean is None:
            return F.lit(None).cast("double")
        return (F.col(quoted(col)) - F.lit(mean)) / F.lit(std or 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.z(c) for c in self.mean})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.mean[c], self.std[c]) for c in self.mean]
        return spark.createDataFrame(rows, "variable string, mean double, std double")


def zscore(
    df: DataFrame, cols: Sequence[str], passthrough: Sequence[str] = (), ddof: int = 0
) -> tuple[DataFrame, Scaler]:
    """Scale `cols` in place, leaving every other column (and `passthrough`) untouched."""
    scaled = [c for c in cols if c not in set(passthrough)]
    scaler = Scaler.fit(df, scaled, ddof)
    return scaler.apply(df), scaler


def apply_scaler(df: DataFrame, scalers: DataFrame | Scaler) -> DataFrame:
    """Apply stored `(variable, mean, std)` values; the result is a plain projection."""
    if isinstance(scalers, DataFrame):
        scalers = Scaler.from_rows(scalers.collect())
    return scalers.apply(df)


def cluster_scalers(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """`(cluster, variable, mean, std)` for every cluster from one aggregation."""
    wide = df.groupBy(F.col(by).alias("cluster")).agg(
        *[F.struct(F.avg(quoted(c)).alias("m"), F.stddev_pop(quoted(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(cols)]
    )
    return wide.select(
        "cluster",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("variable"),
                        F.col(f"c{i}.m").alias("mean"),
                        F.col(f"c{i}.s").alias("std"),
                    )
                    for i, c in enumerate(cols)
                ]
            )
        ),
    )
