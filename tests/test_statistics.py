import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwatch.operators import components, cutting, drift, moments, ranking, rollup
from tierwatch.operators.anomaly import anomaly_fields, time_anomalies, time_group_counts


def test_merged_days_equal_all_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3)), int(d), float(1e6 + rng.normal()), None if rng.random() < 0.1 else float(rng.normal())) for d in range(7) for _ in range(60)]
    df = spark.createDataFrame([*rows, (None, 1, 5.0, 5.0), (2, 3, float("nan"), 1.0)], "c int, day int, x double, `y.z` double")
    levels = [(0, F.col("c"), [("x", F.col("x")), ("y.z", F.col("`y.z`"))]), (4, F.col("c") % 2, [("x", F.col("x"))])]
    days = [moments.moments(df.where(F.col("day") == d).repartition(3), levels) for d in range(7)]
    merged = {tuple(r[:3]): r for r in moments.merge_moments(*days).collect()}
    whole = {tuple(r[:3]): r for r in moments.moments(df, levels).collect()}
    assert merged.keys() == whole.keys() and len(whole) == 8
    scalers = {tuple(r[:3]): r for r in moments.cluster_scalers_from(moments.moments(df, levels)).collect()}
    for key in whole:
        assert merged[key]["n"] == whole[key]["n"]
        assert merged[key]["mean"] == pytest.approx(whole[key]["mean"], rel=1e-12)
        assert merged[key]["m2"] == pytest.approx(whole[key]["m2"], rel=1e-9)
        own = [r[2] if key[2] == "x" else r[3] for r in [*rows, (2, 3, None, 1.0)] if (r[0] if key[0] == 0 else r[0] % 2) == key[1]]
        own = np.array([v for v in own if v is not None])
        assert scalers[key]["std"] == pytest.approx(own.std(), rel=1e-6)


def cuts_by_hand(x, y):
    """Recursive cuts with the description-length stop, in plain Python."""

    def entropy(labels):
        return -sum(c / len(labels) * math.log2(c / len(labels)) for c in Counter(labels).values())

    def cut(rows):
        whole, n = [l for _, l in rows], len(rows)
        best = None
        for v in sorted({a for a, _ in rows})[:-1]:
            left, right = [l for a, l in rows if a <= v], [l for a, l in rows if a > v]
            cost = round(len(left) * entropy(left) + len(right) * entropy(right), 6)
            if best is None or (cost, v) < best[:2]:
                best = (cost, v, left, right)
        if best is None:
            return []
        _, v, left, right = best
        h, h1, h2 = map(entropy, (whole, left, right))
        k, k1, k2 = (len(set(s)) for s in (whole, left, right))
        gain = h - (len(left) * h1 + len(right) * h2) / n
        if gain <= (math.log2(n - 1) + math.log2(3**k - 2) - (k * h - k1 * h1 - k2 * h2)) / n:
            return []
        return cut([r for r in rows if r[0] <= v]) + [v] + cut([r for r in rows if r[0] > v])

    return cut(list(zip(x, y)))


def test_supervised_cuts_by_hand(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=400), 2)
    y = (x > 0.3).astype(int) + (x > 1.1) + (rng.random(400) < 0.1)
    noise = rng.integers(0, 50, 400).astype(float)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(x, noise, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1), (float("nan"), 2.0, 0)], "`a.b` double, noise double, `y.l` int").repartition(4)
    got = cutting.supervised_cuts(df, "y.l", ["a.b", "noise"])
    assert got["a.b"] == cuts_by_hand([r[0] for r in rows], [r[2] for r in rows]) and len(got["a.b"]) >= 2
    assert got["noise"] == cuts_by_hand([*(r[1] for r in rows), 1.0, 2.0], [*(r[2] for r in rows), 1, 0]) == []
    binned = cutting.cut_columns(df, got).collect()
    assert {r["a.b"] for r in binned} == {None, *range(len(got["a.b"]) + 1)} and {r["noise"] for r in binned} == {0}
    assert cutting.supervised_cuts(df, "y.l", ["a.b"], depth=1)["a.b"][0] in got["a.b"]
    assert cutting.supervised_cuts(df.limit(0), "y.l", ["noise"]) == {"noise": []}


def test_uncertainty_of_columns_with_dots(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), int(a > 0), str(i)) for i, a in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "`v.1` double, `lab.x` int, `a.key` string")
    assert ranking.symmetrical_uncertainty(df, "lab.x", ["v.1"], bins=ranking.SUPERVISED).first()["su"] == pytest.approx(1.0)
    assert ranking.symmetrical_uncertainty(df, "lab.x", ["v.1"], bins=4).count() == 1
    assert ranking.fcbf(df, "lab.x", ["v.1"]).count() == 1
    assert anomaly_fields(df, ["v.1"], "lab.x", "a.key").columns == ["a.key", "cluster", "variable", "value"]
    timed = df.withColumn("t.s", F.timestamp_seconds(F.lit(0)))
    assert time_group_counts(timed, "t.s", "lab.x", bucket="hour", times=timed.select("`a.key`", "`t.s`"), key="a.key").count() == 2
    assert time_anomalies(time_group_counts(timed, "t.s", "lab.x")).count() == 1


def test_spectra_by_tiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(components, "TILE", 3)
    monkeypatch.setattr(components, "PASS_CELLS", 30)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 9)) @ rng.normal(size=(9, 9))
    x[:, 8] = 2.0
    names = [f"c.{i}" for i in range(9)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(3)
    groups = {0: names[:7], 3: [names[7], names[8]], 5: [names[8]]}
    got = {}
    for r in components.variance_shares(df, groups).orderBy("cluster", "pc").collect():
        got.setdefault(r["cluster"], []).append((r["share"], r["singular_value"]))
    values = np.linalg.eigvalsh(np.corrcoef(x[:, :7].T))[::-1]
    assert [s for s, _ in got[0]] == pytest.approx((values / values.sum()).tolist(), abs=1e-9)
    assert [s for _, s in got[0]] == pytest.approx(np.sqrt(200 * values).tolist(), rel=1e-9)
    assert got[3] == [pytest.approx((1.0, math.sqrt(200))), (0.0, 0.0)] and 5 not in got


def test_range_finder_equals_numpy_on_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 60)) * np.linspace(1, 9, 60) + 5
    names = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(2)
    values, directions = components.principal_directions(df, names, 3)
    own, vectors = np.linalg.eigh(np.cov(x.T))
    assert values == pytest.approx(own[::-1][:3], rel=1e-8)
    assert np.abs((directions * vectors[:, ::-1][:, :3]).sum(axis=0)) == pytest.approx(np.ones(3), abs=1e-6)
    scores = components.pca_project(df.withColumn("id", F.lit(1)), names, 3, keep=["id"])
    assert scores.columns == ["id", "pca_0", "pca_1", "pca_2"] and scores.count() == 300
    with pytest.raises(Exception, match="missing values"):
        components.principal_directions(df.withColumn("c0", F.lit(None).cast("double")), names, 2)


def test_rollup_tells_null_labels_from_totals(spark):
    rows = [(0, 1), (0, None), (0, None), (None, None), (2, 1)]
    got = {(r["nivel_0"], r["n.1"], r["depth"]): (r["n"], r["grouping_id"]) for r in rollup.level_rollup(
        spark.createDataFrame(rows, "nivel_0 int, `n.1` int"), ["nivel_0", "n.1"]).collect()}
    assert got[None, None, 0] == (5, 3) and got[None, None, 1] == (1, 1) and got[None, None, 2] == (1, 0)
    assert got[0, None, 1] == (3, 1) and got[0, None, 2] == (2, 0) and got[0, 1, 2] == (1, 0)


def test_relabelled_clusters_are_no_drift(spark):
    pick = random.Random(6)
    before = [(i, pick.randint(0, 4)) for i in range(300)]
    rename = [3, 4, 0, 1, 2]
    old = spark.createDataFrame(before, "id long, c int")
    same = spark.createDataFrame([(i, rename[c]) for i, c in before], "id long, c int")
    assert drift.moved_records(old, same, "id", "c").collect() == []
    assert {(r["old"], r["new"]) for r in drift.match_clusters(old, same, "id", "c").collect()} == set(enumerate(rename))
    changed = spark.createDataFrame([(i, 9 if i == 7 else rename[c]) for i, c in before if i != 8] + [(900, 3)], "id long, c int")
    got = {r["id"]: (r["old"], r["new"], r["change"]) for r in drift.moved_records(old, changed, "id", "c").collect()}
    assert got == {7: (before[7][1], 9, "moved"), 8: (before[8][1], None, "gone"), 900: (None, 3, "new")}


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", 1.0)], "`k.k` string, v double")
    b = spark.createDataFrame([("x", None), ("z", 1.0)], "`k.k` string, v double")
    got = sorted(map(tuple, drift.multiset_difference(a, b).collect()), key=str)
    assert got == [("x", None, 2, 1), ("y", 1.0, 1, 0), ("z", 1.0, 0, 1)]
    assert drift.multiset_difference(a, a).collect() == []
