import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tierwatch.functions.shared import scratch_path
from tierwatch.operators import anomaly, temporal
from tierwatch.streaming.time_points import COUNT, POINT, count_windows, follow_windows, late_counts

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def test_as_of_join_by_hand(spark):
    pick = random.Random(1)
    left = [(i, pick.choice(["a", "b", None, "hot", "hot", "hot"]), pick.choice([None, *range(0, 200, 3)])) for i in range(400)]
    right = [(pick.choice(["a", None, "hot"]), pick.choice([None, *range(0, 200, 7)]), pick.choice([None, 1.5, 2.5])) for _ in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, `k.x` string, ts timestamp")
        other = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "`k.x` string, seen timestamp, value double")
        got = temporal.as_of_join(df, other, "ts", "seen", ["k.x"]).collect()
        rows = temporal.as_of_join(df, other.drop("k.x"), "ts", "seen").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    least = (-1, -1.0)

    def best(k, t, keyed):
        # Nulls of a column come before its values.
        found = [(s, least[1] if v is None else v) for kk, s, v in right if s is not None and t is not None and s <= t and (kk == k or not keyed)]
        s, v = max(found, default=(None, None))
        return (at(s), None if v == least[1] else v)

    for result, keyed in ((got, True), (rows, False)):
        assert sorted(r["id"] for r in result) == list(range(400))
        assert {r["id"]: (r["seen"], r["value"]) for r in result} == {i: best(k, t, keyed) for i, k, t in left}


def test_as_of_join_refuses_names_of_both_sides_and_takes_empty_ones(spark):
    df = spark.createDataFrame([(1, at(5))], "id long, ts timestamp")
    with pytest.raises(ValueError, match="ts"):
        temporal.as_of_join(df, df, "ts", "ts")
    none = spark.createDataFrame([], "seen timestamp, v int")
    assert [tuple(r) for r in temporal.as_of_join(df, none, "ts", "seen").collect()] == [(1, at(5), None, None)]
    assert temporal.as_of_join(df.limit(0), none, "ts", "seen").collect() == []


@pytest.mark.parametrize("by", [[], ["k"]])
def test_runs_by_hand(spark, by):
    pick = random.Random(2)
    points = [(pick.choice(["hot", "hot", "hot", "x", None]), pick.choice([None, *range(0, 5000, 2)])) for _ in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame([(k, at(t)) for k, t in points], "k string, ts timestamp")
        got = sorted(map(tuple, temporal.merge_runs(df, "ts", 8 * 60, by).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = []
    for key in {k for k, _ in points} if by else {None}:
        times = sorted(t for k, t in points if t is not None and (k == key or not by))
        runs = []
        for t in times:
            if runs and t - runs[-1][1] <= 8:
                runs[-1][1:] = [t, runs[-1][2] + 1]
            else:
                runs.append([t, t, 1])
        want += [(*([key] if by else []), at(a), at(b), n) for a, b, n in runs]
    assert got == sorted(want, key=str)


def test_rows_in_intervals_and_overlaps_by_hand(spark, monkeypatch):
    monkeypatch.setattr(temporal, "PIECES", 50)
    pick = random.Random(3)
    rows = [(i, pick.choice(["a", "b"]), pick.choice([None, *range(0, 3000)])) for i in range(300)]
    spans = [(j, pick.choice(["a", "b"]), a, a + pick.choice([0, 5, 400])) for j, a in enumerate(pick.sample(range(0, 3000), 25))]
    spans += [(99, "a", 0, 3000), (100, "b", 50, 10)]  # all the time; and none
    df = spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "id long, k string, ts timestamp")
    intervals = spark.createDataFrame([(j, k, at(a), at(b)) for j, k, a, b in spans], "j long, k string, start timestamp, end timestamp")
    got = sorted((r["id"], r["j"]) for r in temporal.rows_in_intervals(df, "ts", intervals.withColumnRenamed("k", "kk")).collect())
    assert got == sorted((i, j) for i, _, t in rows for j, _, a, b in spans if t is not None and a <= t <= b)
    keyed = sorted((r["id"], r["j"]) for r in temporal.rows_in_intervals(df, "ts", intervals, ["k"]).collect())
    assert keyed == sorted((i, j) for i, k, t in rows for j, q, a, b in spans if t is not None and k == q and a <= t <= b)
    left = temporal.rows_in_intervals(df, "ts", intervals.where("j = 0"), ["k"], "left")
    assert left.select("id").distinct().count() == 300
    others = intervals.select(F.col("j").alias("other"), "start", "end")
    pairs = sorted((r["j"], r["other"]) for r in temporal.overlapping(intervals.drop("k"), others).collect())
    sound = [s for s in spans if s[2] <= s[3]]
    assert pairs == sorted((x[0], y[0]) for x in sound for y in sound if x[2] <= y[3] and y[2] <= x[3])


def test_stream_equals_batch_and_counts_late_counts(spark, tmp_path):
    pick = random.Random(4)
    early = [(pick.choice(["x", "y.z"]), at(pick.randint(0, 600))) for _ in range(300)]
    shape = "`g.1` string, `t.1` timestamp"
    source = str(tmp_path / "in")
    paths = {name: str(tmp_path / name) for name in ("counts", "points", "c1", "c2")}

    def step(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        query = count_windows(stream, "t.1", "g.1", paths["counts"], paths["c1"])
        query.awaitTermination()
        follow_windows(spark, paths["counts"], paths["points"], paths["c2"]).awaitTermination()
        return late_counts(query)

    assert step(early) == 0
    # Hours behind the watermark: two late records of one window. The last record closes all windows before it.
    assert step([("x", at(20)), ("x", at(30)), ("y.z", at(700)), ("x", at(5000))]) == 1
    late = step([("x", at(25)), ("x", at(9000))])
    assert late >= 1
    counts = spark.read.schema(COUNT).parquet(paths["counts"]).where("timestamp < '2024-01-02'")
    kept = [*early, ("y.z", at(700))]
    batch = anomaly.time_group_counts(spark.createDataFrame(kept, shape), "t.1", "g.1", bucket="hour")
    as_rows = lambda df: sorted((r["timestamp"], r["grupo"], r["n"]) for r in df.collect())
    assert as_rows(counts) == as_rows(batch)
    points = spark.read.schema(POINT).parquet(paths["points"]).where("timestamp < '2024-01-02'").collect()
    for group in ("x", "y.z"):
        own = sorted((r["windows"], r["timestamp"], r["n"], r["mean"], r["m2"]) for r in points if r["grupo"] == group)
        seen = []
        for nth, (windows, _, n, mean, m2) in enumerate(own, 1):
            seen.append(n)
            assert windows == nth and mean == pytest.approx(sum(seen) / nth)
            assert m2 == pytest.approx(sum((x - sum(seen) / nth) ** 2 for x in seen))
    assert scratch_path(spark, "x")
