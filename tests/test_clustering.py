import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwatch.functions import vectors
from tierwatch.operators import clustering as op
from tierwatch.operators.components import pca_project, pca_variance


def frame(spark, matrix, label=None):
    cols = [f"x{i}" for i in range(matrix.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in cols))
    if label is not None:
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "id bigint, label int")
        df = df.join(names, "id")
    return df, cols


def blobs(k=3, per=100, dims=4, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, dims)) * 12
    truth = np.repeat(np.arange(k), per)
    return centers[truth] + rng.normal(size=(k * per, dims)), truth


def silhouette_by_pairs(x, y):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def agree(a, b):
    """Adjusted Rand index."""
    table = np.zeros((max(a) + 1, max(b) + 1))
    for i, j in zip(a, b):
        table[i, j] += 1
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, rows, cols = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected = rows * cols / pairs(np.array([len(a)]))
    return (both - expected) / ((rows + cols) / 2 - expected)


def labels(df, col="prediction"):
    return [r[col] for r in df.orderBy("id").select(col).collect()]


def test_both_forms_of_nearest_agree(spark, monkeypatch):
    x, _ = blobs()
    df, cols = frame(spark, x)
    centers = op.Centers.given(cols, x[::60])
    unrolled = labels(op.assign_nearest(df, centers))
    monkeypatch.setattr(vectors, "UNROLL_TERMS", 1)
    assert labels(op.assign_nearest(df, centers)) == unrolled
    assert unrolled == [int(np.argmin(((x[i] - x[::60]) ** 2).sum(1))) for i in range(len(x))]


def test_nearest_ties_go_to_the_lowest_id(spark):
    df = spark.createDataFrame([(0, 0.0)], "id int, x double")
    assert labels(op.assign_nearest(df, op.Centers.given(["x"], [[1.0], [-1.0]]))) == [0]


def test_kmeans_recovers_blobs_whatever_the_partitioning(spark):
    x, truth = blobs()
    df, cols = frame(spark, x)
    one, labelled = op.kmeans_fit(df.coalesce(1), cols, 3, key="id")
    many, _ = op.kmeans_fit(df.repartition(8), cols, 3, key="id")
    assert agree(truth, labels(labelled)) == 1.0
    assert np.allclose(one.points, many.points)


def test_given_start_moves_to_the_means_and_keeps_empty_centers(spark):
    df, cols = frame(spark, np.array([[0.0], [2.0], [10.0]]))
    centers, labelled = op.kmeans_fit(df, cols, init_centers=op.Centers.given(cols, [[0.0], [9.0], [99.0]]))
    assert centers.points == ((1.0,), (10.0,), (99.0,))
    assert labels(labelled) == [0, 0, 1]


def test_silhouette_equals_all_pairs(spark):
    x, y = blobs(per=15)
    y[0] = 3
    df, cols = frame(spark, x, y)
    assert op.silhouette(df, cols, "label") == pytest.approx(silhouette_by_pairs(x, y))
    centers = {k: op.Centers.given(cols, x[:: 45 // k][:k]) for k in (2, 3, 5)}
    for k, score in op.silhouette_sweep(df, centers).items():
        own = np.array(labels(op.assign_nearest(df, centers[k])))
        assert score == pytest.approx(silhouette_by_pairs(x, own))


def test_best_k_finds_the_number_of_blobs_and_stops(spark):
    x, truth = blobs(k=4, per=60, dims=3, seed=3)
    df, cols = frame(spark, x)
    best = op.best_k(df, cols, key="id")
    assert best.k == 4
    assert agree(truth, labels(op.assign_nearest(df, best.centers))) == 1.0
    assert best.trace.count() == 6 and not best.exhausted


def test_best_ks_of_several_groups_equals_one_at_a_time(spark):
    x, _ = blobs(k=3, per=50, dims=4, seed=4)
    df, cols = frame(spark, x)
    both = op.best_ks(df, {0: cols[:2], 1: cols[2:]}, max_k=6, key="id")
    for g, own in ((0, cols[:2]), (1, cols[2:])):
        alone = op.best_k(df, own, max_k=6, key="id")
        assert alone.k == both[g].k and np.allclose(alone.centers.points, both[g].centers.points)


def test_best_k_reports_that_the_data_ran_out(spark):
    df, cols = frame(spark, np.array([[0.0], [0.0], [5.0], [5.0], [9.0], [9.0]]))
    best = op.best_k(df, cols, key="id")
    assert best.exhausted and best.k == 3
    constant, cols = frame(spark, np.zeros((6, 2)))
    assert op.best_k(constant, cols, key="id").k == 1


def test_stop_rule():
    sweep = op.KSweep.replay([(2, 0.3), (3, 0.5), (4, 0.4), (5, 0.5), (6, 0.1), (7, 0.9)])
    assert (sweep.k, sweep.score, len(sweep.trace)) == (3, 0.5, 5)
    negative = op.KSweep.replay([(2, -0.1), (3, -0.2), (4, 0.0), (5, 0.9)])
    assert (negative.k, negative.score, len(negative.trace)) == (0, 0.0, 3)


def greedy_ward(points, k):
    groups = {i: [i] for i in range(len(points))}
    while len(groups) > k:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    na, nb = len(groups[a]), len(groups[b])
                    gap = points[groups[a]].mean(0) - points[groups[b]].mean(0)
                    cost = na * nb / (na + nb) * (gap @ gap)
                    if best is None or cost < best[0]:
                        best = (cost, a, b)
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(v) for v in groups.values()}


@pytest.mark.parametrize("seed,v", [(0, 12), (1, 20), (2, 4)])
def test_ward_equals_greedy_merging(spark, seed, v):
    points = np.random.default_rng(seed).random((v, 5))
    names = [f"v{i:02d}" for i in range(v)]
    weights = spark.createDataFrame(
        [(n, *map(float, p)) for n, p in zip(names, points)], "variable string, " + ", ".join(f"peso_{i} double" for i in range(5))
    )
    groups = {}
    for r in op.ward_groups(weights, 5).collect():
        groups.setdefault(r["cluster"], set()).add(names.index(r["variable"]))
    assert {frozenset(g) for g in groups.values()} == greedy_ward(points, min(5, v))
    assert sorted(groups) == list(range(min(5, v)))


def test_ward_with_identical_profiles(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 5.0)], "variable string, peso_0 double")
    got = {r["variable"]: r["cluster"] for r in op.ward_groups(weights, 2).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1}


def test_bisecting_groups(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.1), ("c", 9.0), ("d", 9.1)], "variable string, peso_0 double")
    got = {r["variable"]: r["cluster"] for r in op.ward_groups(weights, 2, method="bisecting").collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]
    assert op.bisecting_sweep(weights).select("k").distinct().count() == 3


def test_variance_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 5))
    x[:, 1] += 2 * x[:, 0]
    x[:, 4] = 3.0
    df, cols = frame(spark, x)
    got = pca_variance(df, {0: cols[:3], 1: cols[3:4], 2: [cols[3], cols[4]]}).collect()
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    singular = np.linalg.svd(z, compute_uv=False)
    share = np.cumsum(singular**2 / (singular**2).sum())
    first = [r for r in got if r["cluster"] == 0]
    assert [r["Component"] for r in first] == ["PC1", "PC2", "PC3"]
    assert [r["Variance"] for r in first] == pytest.approx(list(share))
    assert [r["singular_value"] for r in first] == pytest.approx(list(singular))
    for g in (1, 2):
        assert [r["Variance"] for r in got if r["cluster"] == g] == [pytest.approx(1.0)]


def test_projection_has_decreasing_variance(spark):
    rng = np.random.default_rng(8)
    df, cols = frame(spark, rng.normal(size=(150, 4)) * [5, 3, 1, 0.1])
    row = pca_project(df, cols, 3, keep=["id"]).agg(*[F.variance(f"pca_{i}") for i in range(3)]).first()
    assert row[0] > row[1] > row[2]


def test_cosine_groups_by_direction(spark):
    angles = np.repeat([0.1, 1.4], 20)
    length = np.tile(np.arange(1, 21), 2)
    df, cols = frame(spark, np.column_stack([np.cos(angles) * length, np.sin(angles) * length]))
    _, labelled = op.kmeans_fit(df, cols, 2, distance="cosine")
    got = labels(labelled)
    assert len(set(got[:20])) == len(set(got[20:])) == 1 and got[0] != got[20]
    assert op.silhouette(labelled, cols, "prediction", metric="cosine") > 0.99
