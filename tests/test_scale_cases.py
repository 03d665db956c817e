"""Cases that only large or awkward tables bring up."""

import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierwatch.functions import vectors
from tierwatch.operators import clustering as op
from tierwatch.operators.anomaly import time_anomalies
from tierwatch.operators.ranking import entropies, symmetrical_uncertainty
from tierwatch.operators.relational import require_unique

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rare(spark, common, partitions):
    """Many rows at 0 and three rare clusters far away, under a key that repeats."""
    return spark.range(0, common + 60, 1, partitions).select(
        (F.col("id") % 3).alias("id"),
        F.when(F.col("id") < common, 0.0).otherwise(100.0 * (1 + (F.col("id") - common) % 3)).alias("x"),
    )


@pytest.mark.parametrize("seed", [1, 2, 42])
def test_rare_clusters_are_found_whatever_the_seed(spark, seed):
    best = op.best_k(rare(spark, 200_000, 4), ["x"], max_k=6, seed=seed, key="id")
    assert best.k == 4 and best.exhausted and best.converged
    assert sorted(p[0] for p in best.centers.points) == [0.0, 100.0, 200.0, 300.0]


def test_starts_depend_on_values_alone(spark):
    random = np.random.default_rng(4)
    rows = [(0, *map(float, r)) for r in random.normal(size=(3000, 3))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    one = op.best_k(df.repartition(1), ["a", "b", "c"], max_k=5, key="id")
    two = op.best_k(df.repartition(8), ["a", "b", "c"], max_k=5, key="id")
    assert one.k == two.k and np.allclose(one.centers.points, two.centers.points, atol=1e-9)


def test_restarts_never_fit_worse(spark):
    random = np.random.default_rng(8)
    rows = [tuple(map(float, r)) for c in range(6) for r in random.normal(size=(40, 2)) + random.normal(size=2) * 9]
    df = spark.createDataFrame(rows, "a double, b double")

    def spread(restarts):
        centers, labelled = op.kmeans_fit(df, ["a", "b"], 6, seed=3, restarts=restarts)
        x = np.array([(r["a"], r["b"]) for r in labelled.collect()])
        return ((x[:, None] - np.array(centers.points)[None]) ** 2).sum(-1).min(axis=1).sum()

    assert spread(4) <= spread(1) + 1e-9


def test_missing_values_are_refused_by_name(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, None), (9.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError, match="missing values in b"):
        op.kmeans_fit(df, ["a", "b"], 2)
    with pytest.raises(ValueError, match="missing values in b"):
        op.kmeans_fit(df, ["a", "b"], init_centers=op.Centers.given(["a", "b"], [[0, 0], [9, 9]]))


def test_nearest_is_the_same_in_both_forms(spark, monkeypatch):
    centers = [[9.0, 0.5, -1.0], [1.0, 0.0, 2.0], [5.0, -3.0, 0.25]]
    odd = [float("nan"), None, float("inf"), float("-inf"), 0.0, -0.0, 1e300, 5.0]
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in odd for b in odd for c in (0.0, None, -2.5, float("inf")))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    found = []
    for limit in (1000, 0):
        monkeypatch.setattr(vectors, "UNROLL_TERMS", limit)
        column = vectors.nearest([F.col("a"), F.col("b"), F.col("c")], centers)
        found.append({r["id"]: r["n"] for r in df.select("id", column.alias("n")).collect()})
    assert found[0] == found[1]


def wide_distances(counts):
    table = counts.pivot(index="timestamp", columns="grupo", values="n").fillna(0.0).astype(float)
    sigma = table.std(ddof=0).replace(0.0, 1.0)
    return np.sqrt((((table - table.mean()) / sigma) ** 2).sum(axis=1))


@pytest.mark.parametrize("scale, hours", [(4_000_000_000, 6), (280_000_000, 720)])
def test_time_anomalies_at_production_counts(spark, scale, hours):
    random = np.random.default_rng(1)
    rows = [
        (h, f"g{g}", int(scale + random.integers(0, scale // 1000)))
        for h in range(hours) for g in range(5) if (h + g) % 7
    ]
    counts = spark.createDataFrame(rows, "timestamp int, grupo string, n bigint")
    got = {r["timestamp"]: r["distancia"] for r in time_anomalies(counts).collect()}
    expected = wide_distances(pd.DataFrame(rows, columns=["timestamp", "grupo", "n"]))
    assert max(abs(got[t] - d) / max(d, 1.0) for t, d in expected.items()) < 1e-9


def test_uncertainty_keeps_large_integers_apart(spark):
    base = 1 << 60
    df = spark.createDataFrame([(base + i, i % 2) for i in range(1000)], "id bigint, y int")
    got = symmetrical_uncertainty(df, "y", ["id"], delta=None).first()["su"]
    assert abs(got - 2.0 / (math.log2(1000) + 1)) < 1e-9


def test_zero_has_one_sign_next_to_any_type(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "b")], "x double, s string")
    assert entropies(df, [("x",)])[("x",)] == 0.0
    assert entropies(df, [("x",), ("s",)])[("x",)] == 0.0
    assert symmetrical_uncertainty(df, "s", ["x"], delta=None).first()["su"] == 0.0


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError, match="id repeats: 3 rows, 2 keys"):
        require_unique(spark.createDataFrame([(1,), (1,), (2,)], "id int"), "id")


def test_workers_need_no_package(tmp_path):
    """Only the driver can import the package: task code travels with the tasks."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from tierwatch.operators.clustering import kmeans_fit
df = spark.createDataFrame([(0.0,), (0.5,), (9.0,), (9.5,)], "x double")
centers, _ = kmeans_fit(df, ["x"], 2)
assert [p[0] for p in centers.points] == [0.25, 9.25], centers
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
