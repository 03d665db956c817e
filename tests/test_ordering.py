import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwatch.operators import ordering as op
from tierwatch.operators.relational import describe_cols, join_on_key
from tierwatch.functions import shared


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x")).repartition(7)
    rows = op.with_row_number(df, ["x"]).orderBy("x").collect()
    assert [r["row_number"] for r in rows] == list(range(1, 1001))


def test_paste_pairs_by_position(spark):
    a = spark.createDataFrame([(3,), (1,), (2,)], "a int")
    b = spark.createDataFrame([("z",), ("x",), ("y",)], "b string")
    assert sorted(map(tuple, op.paste(a, b, ["a"], ["b"]).collect())) == [(1, "x"), (2, "y"), (3, "z")]


@pytest.mark.parametrize("partitions", [1, 8])
def test_exact_quantiles_with_a_hot_value(spark, partitions):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(3000) < 0.35, 5.0, rng.normal(size=3000))
    g = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double").repartition(partitions)
    got = {(r["g"], r["prob"]): r["value"] for r in op.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], ["g"]).collect()}
    for group in range(3):
        for p in (0.1, 0.5, 0.9):
            assert got[group, p] == pytest.approx(np.quantile(x[g == group], p))


def test_describe_modes_agree_on_moments(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    exact = describe_cols(df, ["x"]).first()
    sketch = describe_cols(df, ["x"], quartiles="approx").first()
    assert (exact["p25"], exact["p50"], exact["p75"]) == (25.0, 50.0, 75.0)
    assert (sketch["mean"], sketch["std"], sketch["n"]) == (exact["mean"], exact["std"], exact["n"])


def test_cumulative_cut_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.4), (0, 3, 0.0), (1, 1, 1.0)], "g int, pc int, share double")
    got = [(r["g"], r["pc"]) for r in op.cumulative_cut(df, "g", "pc", "share").orderBy("g", "pc").collect()]
    assert got == [(0, 1), (0, 2), (1, 1)]


def test_levels_are_dense_and_ties_share_one(spark):
    df = spark.createDataFrame([(0, 9.0), (1, 2.5), (2, 9.0), (3, 1.5)], "cluster int, score double")
    got = {r["cluster"]: r["level"] for r in op.recode_levels(df, "score").collect()}
    assert got == {0: 0, 2: 0, 1: 1, 3: 2}


def test_best_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "variable string, su double")
    assert tuple(op.best(df, "variable", "su").first()) == ("a", 0.5)


def test_join_on_key_keeps_unmatched_records(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, y string")
    assert sorted(map(tuple, join_on_key(a, b, key="k").collect())) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]


def test_join_small_gives_the_same_rows_beyond_the_bound(spark, monkeypatch):
    big = spark.range(500).select((F.col("id") % 50).alias("g"), "id")
    side = spark.range(50).select(F.col("id").alias("g"), (F.col("id") * 2).alias("v"))
    small = shared.join_small(big, side, "g")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(shared, "SMALL_ROWS", 10)
    assert shared.measured(side) is None
    large = shared.join_small(big, side, "g")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
