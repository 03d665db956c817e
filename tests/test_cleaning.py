import math

import pytest
from pyspark.sql import functions as F

from tierwatch.operators import cleaning as op
from tierwatch.operators.relational import check_key, divide_by_max
from tierwatch.operators.scaling import Scaler, apply_scaler, cluster_scalers, zscore
from tierwatch.sources import read_table, write_report

NULLS = [(1, 1.0, None, None), (2, None, 4.0, None), (3, float("nan"), 2.0, None), (4, 3.0, 6.0, None)]
SCHEMA = "id int, a double, b double, c double"


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame(NULLS, SCHEMA)


def values(df, col):
    return [r[0] for r in df.orderBy("id").select(col).collect()]


def test_fill_extreme_uses_minus_the_maximum_and_treats_nan_as_missing(nulls):
    out = op.fill_extreme(nulls, ["a", "b", "c"])
    assert values(out, "a") == [1.0, -3.0, -3.0, 3.0]
    assert values(out, "b") == [-6.0, 4.0, 2.0, 6.0]
    assert values(out, "c") == [None] * 4
    assert values(op.fill_const(out), "c") == [0.0] * 4
    assert values(op.fill_extreme(nulls, ["c"], otherwise=0.0), "c") == [0.0] * 4


def test_fill_mean(nulls):
    out = op.fill_mean(nulls, ["a", "b", "c"])
    assert values(out, "a") == [1.0, 2.0, 2.0, 3.0]
    assert values(out, "b") == [4.0, 4.0, 2.0, 6.0]


def test_null_audit(nulls):
    got = {r["variable"]: (r["n_null"], r["any_null"]) for r in op.null_audit(nulls).collect()}
    assert got == {"id": (0, False), "a": (2, True), "b": (1, True), "c": (4, True)}


def test_to_double_turns_nan_into_null(nulls):
    assert values(op.to_double(nulls, ["a"]), "a") == [1.0, None, None, 3.0]


def test_drop_named_strict(nulls):
    assert op.drop_named(nulls, "a", "nope").columns == ["id", "b", "c"]
    with pytest.raises(KeyError):
        op.drop_named(nulls, "nope", strict=True)


def test_names_with_dots_survive_the_cleaning_chain(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "key int, `T_x.y` double")
    kept = op.select_matching(df, "T_", "key")
    filled = op.fill_extreme(kept, ["T_x.y"])
    assert op.strip_prefix(filled, "T_").columns == ["x.y", "key"]
    assert sorted(r[0] for r in filled.collect()) == [-2.0, 2.0]


def test_one_hot_and_dummies(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "id int, prediction int")
    hot = op.one_hot(df, "prediction")
    assert hot.columns == ["prediction_0", "prediction_1", "id"]
    assert values(hot, "prediction_0") == [1, 0, 1]
    assert op.dummies(df, "prediction").columns == ["prediction_0", "prediction_1", "id", "prediction"]


def test_distinct_values_never_truncates(spark):
    with pytest.raises(ValueError):
        op.distinct_values(spark.range(20), "id", limit=10)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0), (2, 0.1, 3.0)], "id int, a double, b double")
    out, scaler = zscore(df, ["a", "b"])
    assert values(out, "a") == [0.0, 0.0]
    assert values(out, "b") == [-1.0, 1.0]
    again = apply_scaler(df, scaler.table(spark))
    assert values(again, "b") == [-1.0, 1.0]


def test_passthrough_is_untouched(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 7.0)], "id int, a double, y double")
    out, scaler = zscore(df, ["a", "y"], passthrough=["y"])
    assert values(out, "y") == [5.0, 7.0]
    assert list(scaler.mean) == ["a"]


def test_cluster_scalers_match_one_fit_per_cluster(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("prediction"), F.sqrt("id").alias("a"), (-F.col("id")).cast("double").alias("b"))
    got = {(r["cluster"], r["variable"]): (r["mean"], r["std"]) for r in cluster_scalers(df, "prediction", ["a", "b"]).collect()}
    for c in range(3):
        one = Scaler.fit(df.filter(F.col("prediction") == c), ["a", "b"])
        for v in ("a", "b"):
            assert got[c, v] == pytest.approx((one.mean[v], one.std[v]))


def test_transpose(spark):
    df = spark.createDataFrame([("v1", 1.0, 2.0), ("v2", 3.0, 4.0)], "variable string, p0 double, p1 double")
    got = {r["name"]: (r["v1"], r["v2"]) for r in op.transpose(df, "variable").collect()}
    assert got == {"p0": (1.0, 3.0), "p1": (2.0, 4.0)}


def test_csv_round_trip_with_inference(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", 2.5), (2, None, None)], "k int, s string, x double")
    path = str(tmp_path / "t")
    write_report(df, path, sep=";")
    back = read_table(spark, path)
    assert [f.dataType.typeName() for f in back.schema] == ["integer", "string", "double"]
    assert sorted(map(tuple, back.collect())) == [(1, "a;b", 2.5), (2, None, None)]


def test_check_key_with_a_hot_key(spark):
    df = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("k"))
    assert tuple(check_key(df, "k").first()) == (300, 201, 99)


def test_divide_by_max(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 8.0)], "id int, x double")
    assert values(divide_by_max(df, "x", "y"), "y") == [0.25, 1.0]
    assert math.isclose(sum(values(divide_by_max(df, "x", "y"), "y")), 1.25)
