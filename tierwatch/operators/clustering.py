"""K-means, the silhouette, the choice of k, and grouping of variables."""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tierwatch.functions.names import quoted
from tierwatch.functions.vectors import nearest, own_center_distance
from tierwatch.operators.cleaning import distinct_values

# Passes after which a fit ends even if its centers still move.
MAX_ITER = 300


@dataclass(frozen=True)
class Centers:
    """Cluster centers, k by number of variables. The id of a center is its position."""

    cols: tuple[str, ...]
    points: tuple[tuple[float, ...], ...]

    @classmethod
    def given(cls, cols: Sequence[str], points: Sequence[Sequence[float]]) -> Centers:
        return cls(tuple(cols), tuple(tuple(float(v) for v in p) for p in points))

    def canonical(self) -> Centers:
        """Number the centers by their coordinates, so that equal centers get equal ids."""
        return Centers(self.cols, tuple(sorted(self.points)))

    @classmethod
    def from_rows(cls, rows) -> Centers:
        by_cluster: dict[int, dict[str, float]] = {}
        for r in rows:
            by_cluster.setdefault(r["cluster"], {})[r["variable"]] = r["value"]
        cols = sorted(by_cluster[min(by_cluster)])
        return cls.given(cols, [[by_cluster[c][v] for v in cols] for c in sorted(by_cluster)])

    @property
    def k(self) -> int:
        return len(self.points)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, v) for i, p in enumerate(self.points) for c, v in zip(self.cols, p, strict=True)]
        return spark.createDataFrame(rows, "cluster int, variable string, value double")


def group_means(df: DataFrame, cols: Sequence[str], by: str, limit: int = 10_000) -> Centers:
    """Centers from an existing grouping, numbered in the order of the group values."""
    rows = df.groupBy(by).agg(*[F.avg(quoted(c)).alias(f"a{i}") for i, c in enumerate(cols)]).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{by} has more than {limit} groups")
    rows = sorted(rows, key=lambda r: r[by])
    return Centers.given(cols, [[r[f"a{i}"] for i in range(len(cols))] for r in rows])


def assign_nearest(df: DataFrame, centers: Centers, out: str = "prediction") -> DataFrame:
    """Label each row with its closest center: a projection, without a join or a shuffle."""
    return df.withColumn(out, nearest([F.col(quoted(c)) for c in centers.cols], centers.points))


def centroid_distance(
    df: DataFrame, label: str, centers: Centers, out: str = "distancia", squared: bool = False
) -> DataFrame:
    """Distance of each row to the center of its own cluster."""
    xs = [F.col(quoted(c)) for c in centers.cols]
    return df.withColumn(out, own_center_distance(xs, F.col(label), centers.points, squared))


def assemble(df: DataFrame, exclude: Sequence[str] = (), out: str = "features") -> DataFrame:
    """Add a vector of all columns but the excluded ones. Impute first: nulls are an error."""
    cols = [c for c in df.columns if c not in set(exclude)]
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def kmeans_fit(
    df: DataFrame,
    cols: Sequence[str],
    k: int | None = None,
    seed: int = 42,
    key: str | None = None,
    init_centers: Centers | None = None,
    max_iter: int = MAX_ITER,
    distance: str = "euclidean",
    restarts: int = 1,
) -> tuple[Centers, DataFrame]:
    """Fit k-means and label the rows with `prediction`.

    With `init_centers` the iterations start there. Otherwise the starts are drawn from all rows
    by seed and by the values of the rows, so that neither the partitioning nor `key` matters; of
    `restarts` fits the one with the least squared distances is taken. `distance="cosine"` groups
    by direction; its rows are labelled by the model itself.
    """
    if distance != "euclidean":
        return _directional(df, cols, k, seed, max_iter, distance)
    if init_centers is not None:
        centers = lloyd_sweep(df, {0: init_centers}, max_iter)[0]
    else:
        drawn = draw_candidates(df, {0: cols}, k, seed)[0]
        starts = {r: Centers.given(cols, spread_points(*drawn, k, seed + r)) for r in range(restarts)}
        fitted = lloyd_sweep(df, starts, max_iter)
        centers = fitted[_tightest(df, fitted)].canonical()
    return centers, assign_nearest(df, centers)


def _directional(df, cols, k, seed, max_iter, distance) -> tuple[Centers, DataFrame]:
    data = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=seed, distanceMeasure=distance, maxIter=max_iter).fit(data)
    finally:
        data.unpersist()
    centers = Centers.given(cols, [c.tolist() for c in model.clusterCenters()])
    return centers, model.transform(data).drop("features")


def silhouette(
    df: DataFrame, cols: Sequence[str], label: str, metric: str = "squaredEuclidean"
) -> float:
    """Mean silhouette of a labelling, from per-cluster sums: linear in the rows.

    `metric` is "squaredEuclidean" or "cosine".
    """
    data = VectorAssembler(inputCols=list(cols), outputCol="features").transform(
        df.select(F.col(label).cast("double").alias("prediction"), *[quoted(c) for c in cols if c != label])
    )
    return ClusteringEvaluator(distanceMeasure=metric).evaluate(data)


@dataclass
class KSweep:
    """Keeps the best score seen so far and stops after `patience` scores without a gain."""

    patience: int = 3
    k: int = 0
    score: float = 0.0
    misses: int = 0
    trace: list[tuple[int, float, int, int]] = field(default_factory=list)

    @property
    def stopped(self) -> bool:
        return self.misses >= self.patience

    def offer(self, k: int, score: float) -> bool:
        gained = score > self.score
        if gained:
            self.k, self.score, self.misses = k, score, 0
        else:
            self.misses += 1
        self.trace.append((k, score, self.k, self.misses))
        return gained

    @classmethod
    def replay(cls, scores: Sequence[tuple[int, float]], patience: int = 3) -> KSweep:
        sweep = cls(patience)
        for k, score in sorted(scores):
            sweep.offer(k, score)
            if sweep.stopped:
                break
        return sweep

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, "k int, score double, best_k int, misses int")


@dataclass(frozen=True)
class BestK:
    k: int
    score: float
    centers: Centers
    trace: DataFrame
    exhausted: bool
    converged: bool = True


def best_k(
    df: DataFrame,
    cols: Sequence[str],
    max_k: int = 15,
    patience: int = 3,
    seed: int = 42,
    key: str | None = None,
    max_iter: int = MAX_ITER,
    restarts: int = 1,
) -> BestK:
    """Try k = 2 .. max_k - 1 and keep the highest squared-distance silhouette.

    `exhausted` tells that the table has no further distinct rows to cluster. If no score is
    positive, k = 2 is used.
    """
    return best_ks(df, {0: cols}, max_k, patience, seed, key, max_iter, restarts)[0]


def best_ks(
    df: DataFrame,
    groups: Mapping[int, Sequence[str]],
    max_k: int = 15,
    patience: int = 3,
    seed: int = 42,
    key: str | None = None,
    max_iter: int = MAX_ITER,
    restarts: int = 1,
) -> dict[int, BestK]:
    """`best_k` for several groups of columns at once.

    Several k of every group, and every restart, are fitted side by side, so that a pass over the rows
    serves all of them; a fit that no longer moves is left out of later passes. After the first few k the
    stopping rule is applied to the scores in order, and a group that it stops takes no part in the next.
    The result depends on the values of the rows only.
    """
    candidates = draw_candidates(df, groups, max(1, max_k - 1), seed)
    fitted: dict[tuple[int, int], Centers] = {}
    settled: dict[tuple[int, int], bool] = {}
    scores: dict[tuple[int, int], float] = {}
    open_ = list(groups)
    for some in _batches(max_k, patience):
        starts: dict[tuple[int, int, int], Centers] = {}
        for g in open_:
            for k in some:
                for r in range(restarts if k > 1 else 1):
                    points = spread_points(*candidates[g], k, seed + r)
                    if len(points) == k:
                        starts[g, k, r] = Centers.given(groups[g], points)
        if not starts:
            break
        converged: dict = {}
        every = lloyd_sweep(df, starts, max_iter, converged=converged)
        inertia = _inertia(df, every) if restarts > 1 else {}
        new = {}
        for g, k in dict.fromkeys((g, k) for g, k, _ in every):
            r = min((r for own, n, r in every if (own, n) == (g, k)), key=lambda r: (inertia.get((g, k, r), 0.0), r))
            new[g, k], settled[g, k] = every[g, k, r], converged[g, k, r]
        fitted |= new
        scores |= silhouette_sweep(df, {i: c for i, c in new.items() if i[1] > 1})
        tried = {g for g, _ in new}
        open_ = [g for g in open_ if g in tried and not _replayed(scores, g, patience).stopped]
    chosen = {}
    for g in groups:
        sweep = _replayed(scores, g, patience)
        last = max(k for own, k in fitted if own == g)
        winner = sweep.k or min(2, last)
        chosen[g] = BestK(
            winner,
            sweep.score,
            fitted[g, winner].canonical(),
            sweep.table(df.sparkSession),
            last < max_k - 1 and not sweep.stopped,
            settled[g, winner],
        )
    return chosen


def _batches(max_k: int, patience: int) -> list[list[int]]:
    """The k to try: first those that the rule needs before it can stop, then as many more as may stop it again."""
    ks = list(range(1, max(2, max_k)))
    first = 2 + patience  # 1, 2, and `patience` that are no better
    return [ks[:first], *[ks[i : i + patience] for i in range(first, len(ks), max(1, patience))]]


def _replayed(scores: Mapping[tuple[int, int], float], group: int, patience: int) -> KSweep:
    return KSweep.replay(sorted((k, s) for (own, k), s in scores.items() if own == group), patience)


# Passes that look for starts, and rows that each pass brings for every center wanted.
DRAW_PASSES = 5
DRAW_FACTOR = 2


def draw_candidates(
    df: DataFrame, groups: Mapping[Hashable, Sequence[str]], k: int, seed: int
) -> dict[Hashable, tuple[np.ndarray, np.ndarray]]:
    """Points from which k starting centers can be chosen, with the number of rows closest to each.

    Each pass over all rows brings up to `DRAW_FACTOR * k` distinct rows, drawn with odds by the
    squared distance to those drawn before: the rows with the smallest `-log(u) / d2`, where u is a
    hash of seed, pass and the row's values. Equal rows have equal draws, so neither the partitioning
    nor the number of copies decides, and rows far from all others are found however rare they are. If
    a pass finds no row at a distance, all distinct rows are candidates. A task sends on at most the
    rows that a pass may bring.
    """
    found: dict[Hashable, np.ndarray] = {g: np.zeros((0, len(cols))) for g, cols in groups.items()}
    ids, names = list(groups), list(dict.fromkeys(c for cols in groups.values() for c in cols))
    places = [[names.index(c) for c in groups[g]] for g in ids]
    wanted = DRAW_FACTOR * k
    growing = set(ids)
    for nth in range(DRAW_PASSES):
        known = [found[g] if g in growing else None for g in ids]

        def draw(batches, known=known, nth=nth):
            best: dict[int, dict[float, list[float]]] = {g: {} for g in range(len(known))}
            for batch in batches:
                everything = _matrix(batch)
                for g, (at, points) in enumerate(zip(places, known, strict=True)):
                    if points is None or not len(everything):
                        continue
                    rows = everything[:, at] + 0.0
                    gap = np.ones(len(rows))
                    if len(points):
                        gap = ((rows - points[_closest(rows, points)]) ** 2).sum(axis=1)
                    far = np.flatnonzero(gap > 0)
                    order = -np.log(_uniform(rows[far], seed * 31 + nth)) / gap[far]
                    order, first = np.unique(order, return_index=True)
                    best[g].update(zip(order[:wanted].tolist(), rows[far[first[:wanted]]].tolist()))
                    best[g] = dict(sorted(best[g].items())[:wanted])
            rows = [(g, o, v) for g, own in best.items() for o, v in own.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ],
                ["g", "o", "v"],
            )

        drawn = df.select(*[quoted(c) for c in names]).mapInArrow(draw, "g int, o double, v array<double>").distinct()
        least = Window.partitionBy("g").orderBy("o", "v")
        rows = drawn.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= wanted).collect()
        for i, g in enumerate(ids):
            new = [r["v"] for r in rows if r["g"] == i]
            if new:
                found[g] = np.concatenate([found[g], np.array(new)])
            else:
                growing.discard(g)
        if not growing:
            break
    models = {g: Centers.given(groups[g], points) for g, points in found.items() if len(points)}
    sizes = cluster_sums(df, models) if models else {}
    out = {}
    for g, points in found.items():
        order = np.lexsort(points.T[::-1]) if len(points) else np.zeros(0, int)
        weight = np.array([sizes.get((g, i), (0.0,))[0] for i in range(len(points))])
        out[g] = points[order], weight[order]
    return out


def _uniform(rows: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row, from its values alone.

    Values are taken in single precision, since scaling by sums that were added in another order
    changes the last digits of a double.
    """
    state = np.full(len(rows), (seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
    for column in np.ascontiguousarray(rows.T.astype("float32")):
        state ^= column.view(np.uint32).astype(np.uint64)
        state ^= state >> np.uint64(30)
        state *= np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(27)
        state *= np.uint64(0x94D049BB133111EB)
        state ^= state >> np.uint64(31)
    return (state >> np.uint64(11)).astype("float64") / (1 << 53) + 1.0 / (1 << 54)


def spread_points(rows: np.ndarray, weight: np.ndarray, k: int, seed: int) -> list[list[float]]:
    """Starting centers that lie apart: each is drawn with odds by its weight and its squared
    distance to those drawn before. Fewer than k come back if there are fewer distinct rows."""
    if not len(rows):
        return []
    draw = np.random.default_rng(seed)
    weight = np.maximum(weight, 1.0)
    chosen = [rows[draw.choice(len(rows), p=weight / weight.sum())]]
    gap = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.sum() > 0:
        odds = weight * gap
        chosen.append(rows[draw.choice(len(rows), p=odds / odds.sum())])
        gap = np.minimum(gap, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return [p.tolist() for p in chosen]


def _inertia(df: DataFrame, models: Mapping[Hashable, Centers]) -> dict[Hashable, float]:
    """The sum of squared distances of the rows to the means of their clusters."""
    out = dict.fromkeys(models, 0.0)
    for (i, _), (n, q, sums) in cluster_sums(df, models).items():
        out[i] += q - sum(s * s for s in sums) / n
    return out


def _tightest(df: DataFrame, models: Mapping[Hashable, Centers]) -> Hashable:
    if len(models) == 1:
        return next(iter(models))
    inertia = _inertia(df, models)
    return min(inertia, key=lambda i: (inertia[i], i))


def _layout(models: Mapping[Hashable, Centers]) -> tuple[list[str], list[tuple[list[int], np.ndarray]]]:
    """The columns to read, and each model's column positions and center matrix."""
    cols = list(dict.fromkeys(c for m in models.values() for c in m.cols))
    return cols, [([cols.index(c) for c in m.cols], np.asarray(m.points)) for m in models.values()]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _closest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.argmin((points * points).sum(axis=1) / 2.0 - rows @ points.T, axis=1)


def cluster_sums(df: DataFrame, models: Mapping[Hashable, Centers]) -> dict:
    """`{(model, cluster): (rows, sum of squared norms, sums per column)}` for several models.

    One pass: a task sends on one row per center, and these are added up.
    """
    ids = list(models)
    cols, layout = _layout(models)
    width = max(len(m.cols) for m in models.values())
    names = ["m", "c", "n", "q", *[f"s{i}" for i in range(width)]]
    schema = "m int, c int, n double, q double, " + ", ".join(f"s{i} double" for i in range(width))

    def partial(batches):
        totals = [np.zeros((len(points), width + 2)) for _, points in layout]
        for batch in batches:
            everything = _matrix(batch)
            for (at, points), total in zip(layout, totals, strict=True):
                rows = everything[:, at]
                own = _closest(rows, points)
                total[:, 0] += np.bincount(own, minlength=len(points))
                total[:, 1] += np.bincount(own, (rows * rows).sum(axis=1), len(points))
                for j in range(len(at)):
                    total[:, j + 2] += np.bincount(own, rows[:, j], len(points))
        for m, total in enumerate(totals):
            numbers = [pa.array([m] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32())]
            yield pa.RecordBatch.from_arrays(numbers + [pa.array(v) for v in total.T.copy()], names)

    sums = (
        df.select(*[quoted(c) for c in cols])
        .mapInArrow(partial, schema)
        .groupBy("m", "c")
        .agg(*[F.sum(n).alias(n) for n in names[2:]])
        .filter(F.col("n") > 0)
    )
    out = {
        (ids[r["m"]], r["c"]): (r["n"], r["q"], [r[f"s{i}"] for i in range(len(models[ids[r["m"]]].cols))])
        for r in sums.collect()
    }
    missing = {models[i].cols[j] for (i, _), (_, _, s) in out.items() for j, v in enumerate(s) if math.isnan(v)}
    if missing:
        raise ValueError(f"missing values in {', '.join(sorted(missing))}: fill them before clustering")
    return out


def lloyd_sweep(
    df: DataFrame,
    starts: Mapping[Hashable, Centers],
    max_iter: int = MAX_ITER,
    tol: float = 1e-4,
    converged: dict | None = None,
) -> dict[Hashable, Centers]:
    """Move several sets of centers to the means of their rows, all in the same passes.

    A center that attracts no row stays. A set is left out of later passes once the squares of its
    moves add up to at most `tol` times the mean variance of its columns. `converged`, if given, tells for each set whether that happened within `max_iter` passes.
    """
    fitted = dict(starts)
    moving = dict(starts)
    for _ in range(max_iter):
        if not moving:
            break
        points = {i: list(m.points) for i, m in moving.items()}
        totals: dict = {}
        for (i, c), (n, q, sums) in cluster_sums(df, moving).items():
            points[i][c] = tuple(s / n for s in sums)
            rows, norm, whole = totals.get(i, (0.0, 0.0, [0.0] * len(sums)))
            totals[i] = (rows + n, norm + q, [a + b for a, b in zip(whole, sums, strict=True)])
        for i, before in list(moving.items()):
            fitted[i] = Centers.given(before.cols, points[i])
            rows, norm, whole = totals.get(i, (1.0, 0.0, [0.0]))
            variance = max(norm / rows - sum((s / rows) ** 2 for s in whole), 0.0) / len(whole)
            if sum(math.dist(a, b) ** 2 for a, b in zip(before.points, fitted[i].points, strict=True)) <= tol * variance:
                del moving[i]
            else:
                moving[i] = fitted[i]
    if converged is not None:
        converged.update({i: i not in moving for i in starts})
    return fitted


def silhouette_sweep(df: DataFrame, models: Mapping[Hashable, Centers]) -> dict[Hashable, float]:
    """Mean squared-distance silhouette of several models: two passes in all."""
    if not models:
        return {}
    stats: dict[Hashable, dict[int, tuple]] = {i: {} for i in models}
    for (i, c), (n, q, sums) in cluster_sums(df, models).items():
        stats[i][c] = (n, q / n, [s / n for s in sums])
    scored = {
        i: Centers.given(m.cols, [m.points[c] for c in sorted(stats[i])])
        for i, m in models.items()
        if len(stats[i]) > 1
    }
    ids = list(scored)
    cols, layout = _layout(scored)
    tables = [[np.asarray(v) for v in zip(*[stats[i][c] for c in sorted(stats[i])], strict=True)] for i in ids]

    def partial(batches):
        total = np.zeros(len(ids))
        count = 0
        for batch in batches:
            everything = _matrix(batch)
            nth = np.arange(len(everything))
            count += len(everything)
            for m, ((at, points), (size, norm, mean)) in enumerate(zip(layout, tables, strict=True)):
                rows = everything[:, at]
                own = _closest(rows, points)
                far = np.maximum((rows * rows).sum(axis=1)[:, None] - 2.0 * rows @ mean.T + norm, 0.0)
                inner = far[nth, own] * size[own] / np.maximum(size[own] - 1.0, 1.0)
                far[nth, own] = np.inf
                outer = far.min(axis=1)
                top = np.maximum(inner, outer)
                scorable = (size[own] > 1) & (top > 0)
                total[m] += ((outer - inner)[scorable] / top[scorable]).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(ids)), pa.int32()), pa.array(total), pa.array([float(count)] * len(ids))],
            ["m", "s", "n"],
        )

    sums = (
        df.select(*[quoted(c) for c in cols])
        .mapInArrow(partial, "m int, s double, n double")
        .groupBy("m")
        .agg((F.sum("s") / F.sum("n")).alias("score"))
    )
    return {ids[r["m"]]: r["score"] for r in sums.collect()}


def _merge_costs(clusters: DataFrame) -> DataFrame:
    a = clusters.select(F.col("cid").alias("a"), F.col("size").alias("na"), "profile", F.col("weight").alias("wa"))
    b = clusters.select(F.col("cid").alias("b"), F.col("size").alias("nb"), "profile", F.col("weight").alias("wb"))
    gap = F.col("wa") - F.col("wb")
    return (
        a.join(b, "profile")
        .filter(F.col("a") != F.col("b"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum(gap * gap).alias("d2"))
        .select("a", "b", (F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * F.col("d2")).alias("cost"))
    )


def ward_costs(clusters: DataFrame) -> DataFrame:
    """`(a, b, cost)` for each pair of variable clusters given as `(cid, size, profile, weight)`.

    The cost is the rise in within-cluster variance if the two were merged. The join is on
    the profile, of which each cluster has one row; there are as many clusters as variables.
    """
    return _merge_costs(clusters).filter(F.col("a") < F.col("b"))


def ward_merges(weights: DataFrame) -> list[tuple[str, str, float]]:
    """All merges `(kept, absorbed, cost)` of Ward clustering of variables by weight profile.

    Clusters that are each other's nearest neighbor merge in the same round, which gives
    the same tree as merging one pair at a time. A round is one small Spark job; the
    driver holds one entry per variable.
    """
    spark = weights.sparkSession
    profiles = [c for c in weights.columns if c != "variable"]
    owner = {r[0]: r[0] for r in weights.select("variable").collect()}
    points = weights.unpivot(["variable"], profiles, "profile", "weight")
    # A few variables fit into one task, which spares every round its exchanges.
    points = (points.coalesce(1) if len(owner) <= 200 else points).persist()
    rank = F.struct(F.round("cost", 12), F.least("a", "b"), F.greatest("a", "b"))
    merges: list[tuple[str, str, float]] = []
    try:
        while len(set(owner.values())) > 1:
            members = spark.createDataFrame(pa.table({"variable": list(owner), "cid": list(owner.values())}))
            clusters = (
                points.join(F.broadcast(members), "variable")
                .groupBy("cid", "profile")
                .agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).cast("double").alias("size"))
            )
            closest = _merge_costs(clusters).groupBy("a").agg(F.min_by(F.struct("b", "cost"), rank).alias("m"))
            to = {r["a"]: (r["m"]["b"], r["m"]["cost"]) for r in closest.collect()}
            found = [(a, b, cost) for a, (b, cost) in sorted(to.items()) if a < b and to[b][0] == a]
            merges += found
            into = {b: a for a, b, _ in found}
            owner = {v: into.get(c, c) for v, c in owner.items()}
    finally:
        points.unpersist()
    return merges


def cut_tree(variables: Sequence[str], merges: Sequence[tuple[str, str, float]], k: int) -> dict[str, int]:
    """Undo the k - 1 costliest merges. Groups are numbered by their first variable."""
    kept = sorted(merges, key=lambda m: m[2])[: max(0, len(variables) - k)]
    parent = {absorbed: keeper for keeper, absorbed, _ in kept}

    def root(v: str) -> str:
        while v in parent:
            v = parent[v]
        return v

    roots = {v: root(v) for v in variables}
    number = {r: i for i, r in enumerate(sorted(set(roots.values())))}
    return {v: number[r] for v, r in roots.items()}


def ward_groups(weights: DataFrame, k: int = 5, method: str = "ward", seed: int = 42) -> DataFrame:
    """`(variable, cluster)`: at most k groups of variables with similar weight profiles."""
    names = distinct_values(weights, "variable")
    k = min(k, len(names))
    if method == "bisecting":
        return _bisecting(weights, k, seed)
    groups = cut_tree(names, ward_merges(weights), k)
    return weights.sparkSession.createDataFrame(sorted(groups.items()), "variable string, cluster int")


def _bisecting(weights: DataFrame, k: int, seed: int) -> DataFrame:
    data = assemble(weights, exclude=["variable"])
    model = BisectingKMeans(k=k, minDivisibleClusterSize=1.0, seed=seed).fit(data)
    return model.transform(data).select("variable", F.col("prediction").alias("cluster"))


def bisecting_sweep(weights: DataFrame, ks: Sequence[int] = range(2, 8), seed: int = 42) -> DataFrame:
    """Groupings for several k: `(k, variable, cluster)`."""
    names = distinct_values(weights, "variable")
    parts = [
        _bisecting(weights, k, seed).select(F.lit(k).alias("k"), "variable", "cluster")
        for k in ks
        if k <= len(names)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
