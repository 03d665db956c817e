"""Learning, storing and applying a taxonomy of variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.functions.names import numeric, quoted
from tierwatch.functions.shared import stage
from tierwatch.functions.vectors import nearest
from tierwatch.operators.clustering import MAX_ITER, Centers, best_ks, kmeans_fit, ward_groups
from tierwatch.operators.components import pca_variance
from tierwatch.operators.moments import cluster_scalers_from, moments
from tierwatch.operators.ordering import recode_levels
from tierwatch.operators.ranking import (
    SUPERVISED,
    cluster_weights,
    discriminating_variables,
    gbt_importance,
    rf_importance,
    su_importance,
)
from tierwatch.operators.relational import attach_levels, require_unique
from tierwatch.operators.scaling import Scaler

# Score given to a group whose cumulative variances sum to 1 at most.
SINGLETON_SCORE = 9.0

RANKERS = {"gbt": gbt_importance, "rf": rf_importance, "su": su_importance}


def variance_by_group(var_table: DataFrame) -> DataFrame:
    return var_table.groupBy("cluster").agg(F.sum("Variance").alias("Variance_sum"))


def variable_levels(
    var_table: DataFrame, groups: DataFrame, singleton_score: float = SINGLETON_SCORE
) -> DataFrame:
    """`(variable, cluster, Nivel)`: groups ordered by explained-variance mass, 0 being the most."""
    score = F.when(F.round("Variance_sum", 9) <= 1, F.lit(singleton_score)).otherwise(F.round("Variance_sum", 9))
    scored = variance_by_group(var_table).withColumn("score", score)
    ranked = recode_levels(scored, "score", "Nivel").select("cluster", "Nivel")
    return attach_levels(ranked, groups.select("variable", "cluster")).select("variable", "cluster", "Nivel")


@dataclass(frozen=True)
class Level:
    """The model of one level: its scaler fitted on raw values, and centers in scaled space."""

    number: int
    scaler: Scaler
    centers: Centers
    cluster_scalers: tuple[tuple[int, str, float, float], ...] = ()
    score: float | None = None  # silhouette of the chosen k
    exhausted: bool | None = None  # no further distinct rows to cluster
    converged: bool | None = None

    @property
    def variables(self) -> tuple[str, ...]:
        return self.centers.cols

    @property
    def label(self) -> str:
        return f"nivel_{self.number}"

    def scaled(self) -> list:
        return [self.scaler.z(c) for c in self.centers.cols]

    def predict(self):
        return nearest(self.scaled(), self.centers.points)


def level_moments(df: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """Mergeable statistics of the scaled variables of all levels by cluster, from one pass over `df`."""
    return moments(df, [(lv.number, lv.predict(), list(zip(lv.variables, lv.scaled(), strict=True))) for lv in levels])


def _with_cluster_scalers(df: DataFrame, levels: Sequence[Level]) -> list[Level]:
    """`levels` with the scalers of their clusters, all from one pass."""
    return list(Taxonomy(tuple(levels), {}).with_statistics(level_moments(df, levels)).levels)


def fit_levels(
    df: DataFrame,
    levels: DataFrame,
    key: str | None = None,
    max_k: int = 15,
    patience: int = 3,
    seed: int = 42,
    max_iter: int = MAX_ITER,
    restarts: int = 1,
) -> list[Level]:
    """One model per level of a `(variable, cluster, Nivel)` table, all fitted in the same passes."""
    members: dict[int, list[str]] = {}
    for r in levels.orderBy("Nivel", "variable").collect():
        members.setdefault(int(r["Nivel"]), []).append(r["variable"])
    cols = [c for vs in members.values() for c in vs]
    scaler = Scaler.fit(df, cols)
    scaled = df.select(*([quoted(key)] if key else []), *[scaler.z(c).alias(c) for c in cols])
    best = best_ks(scaled, members, max_k, patience, seed, key, max_iter, restarts)
    fitted = [
        Level(
            n,
            scaler.only(members[n]),
            best[n].centers,
            score=best[n].score,
            exhausted=best[n].exhausted,
            converged=best[n].converged,
        )
        for n in sorted(members)
    ]
    return _with_cluster_scalers(df, fitted)


@dataclass(frozen=True)
class Taxonomy:
    levels: tuple[Level, ...]
    groups: Mapping[str, int]

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        key: str,
        cols: Sequence[str] | None = None,
        ts: str | None = None,
        clusters: int = 5,
        top: int = 20,
        groups: int = 5,
        max_k: int = 15,
        patience: int = 3,
        seed: int = 42,
        ranker: str = "gbt",
        grouping: str = "ward",
        bins: int | str | None = SUPERVISED,
        max_iter: int = MAX_ITER,
        restarts: int = 1,
        check: bool = True,
    ) -> Taxonomy:
        """Learn the levels of the numeric variables of an imputed table.

        `ranker` is "gbt", "rf" (fewer passes over the data) or "su". The weights take the values in
        `bins`: at the cuts that say most about the clusters, a number of quantiles, or as they are (None).
        With `check`, a key that repeats is refused.
        """
        names = list(cols) if cols is not None else numeric(df, exclude=[key, ts or key])
        data = stage(df.select(key, *[F.col(quoted(c)).cast("double").alias(c) for c in names]), "features", spread=True)
        if check:
            require_unique(data, key)
        scaler = Scaler.fit(data, names)
        scaled = data.select(key, *[scaler.z(c).alias(c) for c in names])
        centers, _ = kmeans_fit(scaled, names, clusters, seed, key, max_iter=max_iter, restarts=restarts)
        z = [scaler.z(c) for c in names]
        labelled = data.withColumn("prediction", nearest(z, centers.points))
        seeded = {"seed": seed} if ranker == "rf" else {}
        ranked = RANKERS[ranker](labelled, "prediction", names, **seeded)
        chosen = [r["variable"] for r in ranked.orderBy(F.desc("importance_norm"), "variable").limit(top).collect()]
        weights = stage(cluster_weights(labelled, "prediction", chosen, range(centers.k), bins), "weights")
        profiles = [c for c in weights.columns if c != "variable"]
        weights = Scaler.fit(weights, profiles).apply(weights)
        grouped = ward_groups(weights, groups, grouping, seed)
        picked = discriminating_variables(weights, grouped, max(1, centers.k - 1)).collect()
        by_group: dict[int, list[str]] = {}
        for r in sorted(picked, key=lambda r: r["pos"]):
            by_group.setdefault(r["cluster"], []).append(r["variable"])
        levels = variable_levels(pca_variance(data, by_group), grouped)
        membership = {r["variable"]: r["cluster"] for r in grouped.collect()}
        return cls(tuple(fit_levels(data, levels, key, max_k, patience, seed, max_iter, restarts)), membership)

    @classmethod
    def given(cls, df: DataFrame, levels: Sequence[tuple[int, Sequence[str], Centers]]) -> Taxonomy:
        """A taxonomy from supplied centers (in scaled space); scalers are fitted on `df`."""
        built = []
        groups = {}
        for number, cols, centers in levels:
            built.append(Level(number, Scaler.fit(df, cols), centers))
            groups.update(dict.fromkeys(cols, number))
        return cls(tuple(_with_cluster_scalers(df, built)), groups)

    def with_statistics(self, table: DataFrame) -> Taxonomy:
        """The same levels with cluster scalers from mergeable statistics, such as the merged ones of several days."""
        found: dict[int, list[tuple]] = {}
        for r in cluster_scalers_from(table).collect():  # one row for each cluster and variable
            found.setdefault(r["level"], []).append((r["cluster"], r["variable"], r["mean"], r["std"]))
        return replace(self, levels=tuple(replace(lv, cluster_scalers=tuple(sorted(found.get(lv.number, [])))) for lv in self.levels))

    def levels_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.groups.get(c, -1), lv.number) for lv in self.levels for c in lv.variables]
        return spark.createDataFrame(rows, "variable string, cluster int, Nivel int")

    def classify(self, df: DataFrame, group: str = "group") -> DataFrame:
        """Add `nivel_<n>` and their underscore join: one projection, without a shuffle.

        It reads raw values, so training rows get their training labels back. Works on
        streaming tables too.
        """
        labelled = df.withColumns({lv.label: lv.predict() for lv in self.levels})
        return labelled.withColumn(group, F.concat_ws("_", *[F.col(lv.label).cast("string") for lv in self.levels]))

    def level_labels(self, df: DataFrame, key: str) -> DataFrame:
        return df.select(key, *[lv.predict().alias(lv.label) for lv in self.levels])

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        scalers = [(lv.number, c, lv.scaler.mean[c], lv.scaler.std[c]) for lv in self.levels for c in lv.variables]
        centers = [
            (lv.number, i, c, v)
            for lv in self.levels
            for i, p in enumerate(lv.centers.points)
            for c, v in zip(lv.centers.cols, p, strict=True)
        ]
        per_cluster = [(lv.number, *row) for lv in self.levels for row in lv.cluster_scalers]
        return {
            "level_variables": self.levels_table(spark),
            "scalers": spark.createDataFrame(scalers, "level int, variable string, mean double, std double"),
            "centers": spark.createDataFrame(centers, "level int, cluster int, variable string, value double"),
            "cluster_scalers": spark.createDataFrame(
                per_cluster, "level int, cluster int, variable string, mean double, std double"
            ),
            "diagnostics": spark.createDataFrame(
                [(lv.number, lv.score, lv.exhausted, lv.converged) for lv in self.levels],
                "level int, score double, exhausted boolean, converged boolean",
            ),
        }

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        spark = spark or SparkSession.getActiveSession()
        for name, table in self.tables(spark).items():
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Taxonomy:
        """The stored tables hold one row per variable or per center coordinate."""
        read = {
            name: spark.read.parquet(f"{path}/{name}").collect()
            for name in ("level_variables", "scalers", "centers", "cluster_scalers", "diagnostics")
        }
        levels = []
        for number in sorted({r["level"] for r in read["scalers"]}):
            mine = {name: [r for r in rows if r["level"] == number] for name, rows in read.items() if name != "level_variables"}
            stats = tuple(sorted((r["cluster"], r["variable"], r["mean"], r["std"]) for r in mine["cluster_scalers"]))
            levels.append(
                Level(
                    number,
                    Scaler.from_rows(mine["scalers"]),
                    Centers.from_rows(mine["centers"]),
                    stats,
                    **{k: mine["diagnostics"][0][k] for k in ("score", "exhausted", "converged")},
                )
            )
        groups = {r["variable"]: r["cluster"] for r in read["level_variables"]}
        return cls(tuple(levels), groups)
