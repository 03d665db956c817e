import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwatch.functions import shared
from tierwatch.operators import anomaly as op
from tierwatch.operators.clustering import Centers, centroid_distance
from tierwatch.operators.relational import time_group_matrix


def test_three_sigma_with_sample_deviation(spark):
    values = [0.0] * 20 + [10.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, d double")
    got = [r["outliers"] for r in op.sigma_label(df, "d").orderBy("id").collect()]
    assert got == ["Normal"] * 20 + ["Outlier"]


def test_constant_distances_and_single_rows_are_not_provably_normal(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "b", 1.0)], "id int, g string, d double")
    assert {r["outliers"] for r in op.sigma_label(df.filter("g = 'a'"), "d").collect()} == {"Outlier"}
    by_group = {r["id"]: r["outliers"] for r in op.sigma_label(df, "d", by="g").collect()}
    assert by_group == {1: "Outlier", 2: "Outlier", 3: "Outlier"}


def fields(spark):
    rows = [(i, 0, 0.0 + i % 2, 5.0) for i in range(30)] + [(30, 0, 50.0, 5.0), (31, 1, 7.0, 1.0)]
    return spark.createDataFrame(rows, "id int, prediction int, a double, b double")


def test_fields_flag_every_cluster_and_never_a_constant(spark):
    got = sorted(map(tuple, op.anomaly_fields(fields(spark), ["b", "a"], "prediction", "id").collect()))
    assert got == [(30, 0, "a", 50.0), (31, 1, "a", 7.0), (31, 1, "b", 1.0)]
    big = op.anomaly_fields(fields(spark), ["b", "a"], "prediction", "id", min_cluster_size=2)
    assert [tuple(r) for r in big.collect()] == [(30, 0, "a", 50.0)]


def test_field_text(spark):
    out = op.anomaly_fields_text(fields(spark), ["b", "a"], "prediction")
    got = {r["id"]: r["AnomalyFields"] for r in out.collect()}
    assert got[30] == "a:50.0" and got[31] == "a:7.0;b:1.0" and got[0] == ""
    assert out.columns == ["id", "prediction", "a", "b", "AnomalyFields"]


def test_fields_without_broadcast_are_the_same(spark, monkeypatch):
    want = sorted(map(tuple, op.anomaly_fields(fields(spark), ["a", "b"], "prediction", "id").collect()))
    monkeypatch.setattr(shared, "SMALL_ROWS", 1)
    assert sorted(map(tuple, op.anomaly_fields(fields(spark), ["a", "b"], "prediction", "id").collect())) == want


def test_missing_values_are_flagged_and_unlabelled_rows_are_kept(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 1.1), (3, 0, None), (4, 0, 2.0), (5, 0, 2.1)], "id int, prediction int, a double")
    out = op.anomaly_fields_text(df, ["a"], "prediction")
    got = {r["id"]: r["AnomalyFields"] for r in out.collect()}
    assert got == {1: "", 2: "", 3: "a:null", 4: "", 5: ""}


def test_distance_to_own_center(spark):
    df = spark.createDataFrame([(1, 0, 3.0, 4.0), (2, 1, 1.0, 1.0)], "id int, prediction int, a double, b double")
    centers = Centers.given(["a", "b"], [[0.0, 0.0], [1.0, 0.0]])
    assert [r["distancia"] for r in centroid_distance(df, "prediction", centers).orderBy("id").collect()] == [5.0, 1.0]
    assert [r["distancia"] for r in centroid_distance(df, "prediction", centers, squared=True).orderBy("id").collect()] == [25.0, 1.0]


def test_composite_group_stops_at_a_gap(spark):
    df = spark.createDataFrame([(1, 4, 2, 9)], "id int, nivel_0 int, nivel_1 int, nivel_3 int")
    assert op.composite_group(df).first()["grupo"] == "4_2"


def wide_distances(matrix, center):
    mean, std = matrix.mean(0), matrix.std(0)
    z = (matrix - mean) / np.where(std == 0, 1, std)
    return np.sqrt(((z - (mean if center == "raw_mean" else 0)) ** 2).sum(1))


@pytest.mark.parametrize("center", ["zero", "raw_mean"])
@pytest.mark.parametrize("partitions", [1, 8])
def test_sparse_time_distances_equal_the_wide_matrix(spark, center, partitions):
    rng = np.random.default_rng(0)
    t, g = rng.integers(0, 40, 3000), np.minimum(rng.geometric(0.3, 3000), 9)
    t[:1000], g[:1000] = 7, 1
    df = spark.createDataFrame([(int(a), str(b)) for a, b in zip(t, g)], "timestamp int, grupo string").repartition(partitions)
    counts = op.time_group_counts(df, "timestamp")
    got = {r["timestamp"]: r for r in op.time_anomalies(counts, center=center).collect()}
    wide = time_group_matrix(df, "timestamp", "grupo").orderBy("timestamp").toPandas()
    want = wide_distances(wide.drop(columns="timestamp").to_numpy(dtype=float), center)
    assert [got[k]["distancia"] for k in wide["timestamp"]] == pytest.approx(list(want))
    band = np.abs(want - want.mean()) < 3 * want.std(ddof=1)
    assert [got[k]["outliers"] == "Normal" for k in wide["timestamp"]] == list(band)
    assert got[7]["outliers"] == "Outlier"


def test_counts_join_timestamps_by_key(spark):
    labels = spark.createDataFrame([(1, "0_0"), (2, "0_0"), (3, "1_0")], "k int, grupo string")
    times = spark.createDataFrame([(1, "t1"), (2, "t1"), (3, "t2")], "k int, timestamp string")
    got = op.time_group_counts(labels, "timestamp", times=times, key="k").collect()
    assert sorted(map(tuple, got)) == [("t1", "0_0", 2), ("t2", "1_0", 1)]


def test_summary_counts_patterns(spark):
    df = spark.createDataFrame(
        [("Normal", ""), ("Normal", ""), ("Outlier", "a:1.0")], "outliers_0 string, fieldsAnomaly_Nivel_0 string"
    ).withColumn("id", F.monotonically_increasing_id())
    assert sorted(map(tuple, op.anomaly_summary(df).collect())) == [("Normal", "", 2), ("Outlier", "a:1.0", 1)]
