import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tierwatch.operators import ranking as op


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values())


def su(x, y):
    hx, hy, hxy = entropy(x), entropy(y), entropy(list(zip(x, y)))
    return 0.0 if hx + hy == 0 else 2 * (hx + hy - hxy) / (hx + hy)


def frame(spark, columns):
    names = list(columns)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{n} double" for n in names))


def scores(df):
    return {r["variable"]: r["su"] for r in df.collect()}


def test_bounds(spark):
    y = [0, 0, 1, 1, 2, 2, 0, 1]
    df = frame(spark, {"y": y, "same": y, "const": [3] * 8, "unique": range(8), "free": [0, 1, 0, 1, 0, 1, 1, 0]})
    got = scores(op.symmetrical_uncertainty(df, "y", ["same", "const", "unique", "free"], delta=None))
    assert got["same"] == pytest.approx(1.0)
    assert got["const"] == 0.0
    assert got["unique"] == pytest.approx(su(list(range(8)), y))
    kept = scores(op.symmetrical_uncertainty(df, "y", ["same", "const"]))
    assert set(kept) == {"same"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 2)), min_size=2, max_size=60))
def test_matches_the_definition_and_is_symmetric(spark, records):
    a, b, y = map(list, zip(*records))
    df = frame(spark, {"a": a, "b": b, "y": y})
    got = scores(op.symmetrical_uncertainty(df, "y", ["a", "b"], delta=None))
    assert got == pytest.approx({"a": su(a, y), "b": su(b, y)}, abs=1e-9)
    assert scores(op.symmetrical_uncertainty(df, "a", ["y"], delta=None))["y"] == pytest.approx(su(a, y), abs=1e-9)


def test_many_labels_take_the_other_path_with_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = frame(spark, {"y": rng.integers(0, 20, 400), "a": rng.integers(0, 5, 400), "b": rng.integers(0, 9, 400)})
    few = scores(op.symmetrical_uncertainty(df, "y", ["a", "b"]))
    monkeypatch.setattr(op, "MAX_COUNTERS", 4)
    assert scores(op.symmetrical_uncertainty(df, "y", ["a", "b"])) == pytest.approx(few)


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, {"y": rng.integers(0, 3, 500), "a": rng.integers(0, 50, 500)})
    one = scores(op.symmetrical_uncertainty(df.coalesce(1), "y", ["a"]))
    assert scores(op.symmetrical_uncertainty(df.repartition(8), "y", ["a"])) == pytest.approx(one)


def test_fcbf_drops_the_copy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    f1 = np.where(rng.random(300) < 0.9, y, 0)
    f2 = np.where(rng.random(300) < 0.5, y, rng.integers(0, 3, 300))
    df = frame(spark, {"y": y, "f1": f1, "f1_copy": f1, "f2": f2})
    picked = [r["variable"] for r in op.fcbf(df, "y", ["f2", "f1_copy", "f1"]).orderBy("rank").collect()]
    assert picked[0] == "f1" and "f1_copy" not in picked
    keeps_f2 = su(list(f1), list(f2)) < su(list(f2), list(y))
    assert ("f2" in picked) == keeps_f2


def test_weights_equal_one_vs_rest_uncertainty(spark):
    rng = np.random.default_rng(4)
    y, a, b = rng.integers(0, 3, 300), rng.integers(0, 4, 300), rng.integers(0, 9, 300)
    df = frame(spark, {"y": y, "a": a, "b": b})
    rows = {r["variable"]: r for r in op.cluster_weights(df, "y", ["a", "b"], [0.0, 1.0, 2.0]).collect()}
    for c in range(3):
        raw = {v: su(list(x), list(y == c)) for v, x in (("a", a), ("b", b))}
        top = max(raw.values())
        for v in raw:
            assert rows[v][f"peso_{float(c)}"] == pytest.approx(raw[v] / top)


def test_weights_of_many_clusters_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = frame(spark, {"y": rng.integers(0, 7, 300), "a": rng.integers(0, 4, 300), "b": rng.integers(0, 9, 300)})
    want = sorted(map(tuple, op.cluster_weights(df, "y", ["a", "b"]).collect()))
    monkeypatch.setattr(op, "MAX_COUNTERS", 3)
    got = sorted(map(tuple, op.cluster_weights(df, "y", ["a", "b"]).collect()))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1:] for r in got] == [pytest.approx(r[1:]) for r in want]


def test_discriminating_variables_skip_constant_profiles(spark):
    weights = spark.createDataFrame(
        [("a", 0.0, 1.0), ("b", 0.5, 0.5), ("c", 0.2, 0.4), ("d", 0.3, 0.3)], "variable string, peso_0 double, peso_1 double"
    )
    groups = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1)], "variable string, cluster int")
    got = {(r["cluster"], r["variable"]) for r in op.discriminating_variables(weights, groups, 5).collect()}
    assert got == {(0, "a"), (0, "c"), (1, "d")}
    one = {(r["cluster"], r["variable"]) for r in op.discriminating_variables(weights, groups, 1).collect()}
    assert one == {(0, "a"), (1, "d")}


def planted(spark, n=600):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    return frame(spark, {"prediction": y, "good": y + rng.normal(0, 0.1, n), "noise": rng.normal(size=n), "other": rng.normal(size=n)})


@pytest.mark.parametrize("ranker", [lambda df, cols: op.gbt_importance(df, "prediction", cols, max_iter=2), lambda df, cols: op.rf_importance(df, "prediction", cols)])
def test_tree_importance_finds_the_planted_variable(spark, ranker):
    rows = ranker(planted(spark), ["noise", "good", "other"]).collect()
    assert rows[0]["variable"] == "good" and rows[0]["importance_norm"] == 1.0
    assert all(r["valor"] > 1e-4 for r in rows)


def test_bins_undo_the_inflation_of_unique_values(spark):
    df = planted(spark)
    exact = scores(op.symmetrical_uncertainty(df, "prediction", ["noise"]))["noise"]
    binned = scores(op.symmetrical_uncertainty(df, "prediction", ["noise"], bins=5))["noise"]
    assert binned < 0.05 < exact


def boost_by_hand(x, y, rounds, depth, rate=0.1):
    """Importances of softmax boosting with all values as cuts, in plain Python."""
    n, cols = x.shape
    classes = sorted(set(y))
    scores = np.log([[np.mean(y == c)] * n for c in classes])
    gains = np.zeros(cols)
    for _ in range(rounds):
        odds = np.exp(scores - scores.max(axis=0))
        p = odds / odds.sum(axis=0)
        for k, c in enumerate(classes):
            r = (y == c) - p[k]
            leaves = [np.arange(n)]
            done = []
            for _ in range(depth):
                after = []
                for rows in leaves:
                    best = (1e-20, None)
                    for v in range(cols):
                        for cut in sorted(set(x[rows, v]))[:-1]:
                            left, right = rows[x[rows, v] <= cut], rows[x[rows, v] > cut]
                            gain = len(left) * len(right) / len(rows) * (r[left].mean() - r[right].mean()) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (v, left, right))
                    if best[1] is None:
                        done.append(rows)
                    else:
                        gains[best[1][0]] += best[0]
                        after += best[1][1:]
                leaves = after
            for rows in done + leaves:
                size = (np.abs(r[rows]) * (1 - np.abs(r[rows]))).sum()
                scores[k, rows] += rate * (len(classes) - 1) / len(classes) * r[rows].sum() / size
    return gains / gains.sum()


@pytest.mark.parametrize("classes", [2, 4])
def test_boosting_equals_plain_python(spark, monkeypatch, classes):
    from tierwatch.operators import boosting

    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(7)
    y = rng.integers(0, classes, 120)
    x = np.stack([np.round(y + rng.normal(0, 1, 120), 1), rng.integers(0, 5, 120), (y == 1) * 2 + rng.integers(0, 3, 120)], axis=1)
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    model = boosting.fit_booster(df.repartition(3), "y", ["a", "b", "c"], rounds=5, depth=3)
    assert model.importances() == pytest.approx(boost_by_hand(x, y, 5, 3), abs=1e-6)
    again = boosting.fit_booster(df.coalesce(1), "y", ["a", "b", "c"], rounds=5, depth=3)
    assert (again.importances() == model.importances()).all()


def test_boosting_passes_do_not_grow_with_classes(spark, monkeypatch):
    from tierwatch.operators import boosting

    passes = []
    plain = boosting._level_cuts
    monkeypatch.setattr(boosting, "_level_cuts", lambda *a: passes.append(a[4]) or plain(*a))
    rng = np.random.default_rng(8)
    df = frame(spark, {"a": rng.normal(size=300), "b": rng.integers(0, 9, 300), "y": rng.integers(0, 9, 300)})
    boosting.fit_booster(df, "y", ["a", "b"], rounds=2, depth=3, bins=8)
    assert passes == [0, 1, 2, 0, 1, 2]


def test_boosting_places_rows_by_bytes_as_a_walk_does():
    from tierwatch.operators import boosting

    rng = np.random.default_rng(9)
    for levels in range(5):
        variable, cut = rng.integers(-1, 4, 31), rng.integers(0, 256, 31)
        cells = rng.integers(0, 256, (4, 500)).astype(np.uint8)
        by_hand = []
        for row in cells.T:
            node = 0
            for _ in range(levels):
                if variable[node] >= 0:
                    node = 2 * node + 1 + int(row[variable[node]] > cut[node])
            by_hand.append(node)
        got = boosting._reached(variable, levels)[boosting._places(variable, cut, cells, levels)]
        assert got.tolist() == by_hand
        assert boosting._places(variable, cut, cells, levels).itemsize == 1


def test_boosting_works_on_a_bounded_number_of_rows_at_once(spark, monkeypatch):
    from tierwatch.operators import boosting

    # A count and the largest sum of curvatures of a chunk fit into one exact double.
    assert boosting.CHUNK_ROWS * boosting.UNIT / 4 < boosting.CURVATURES and boosting.CHUNK_ROWS * boosting.CURVATURES < 1 << 53
    rng = np.random.default_rng(10)
    df = frame(spark, {"a": rng.normal(size=400), "b": rng.integers(0, 9, 400), "y": rng.integers(0, 3, 400)})
    whole = boosting.fit_booster(df, "y", ["a", "b"], rounds=4)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 7)
    again = boosting.fit_booster(df.coalesce(1), "y", ["a", "b"], rounds=4)
    assert (again.gains == whole.gains).all()


def test_boosting_refuses_and_degenerates(spark):
    from tierwatch.operators import boosting

    df = spark.createDataFrame([(1.0, None, 0.0), (2.0, 1.0, 1.0)], "a double, b double, y double")
    with pytest.raises(ValueError, match="b"):
        boosting.fit_booster(df, "y", ["a", "b"])
    with pytest.raises(ValueError, match="without a value"):
        boosting.fit_booster(df, "b", ["a"])
    assert boosting.fit_booster(df.limit(1), "y", ["a"]).importances().tolist() == [0.0]
    flat = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "a double, y double")
    assert op.gbt_importance(flat, "y", ["a"]).collect() == []


def test_wide_and_null_symbols_count_once(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("p", None), ("p|", "x"), ("p", "|x")], "`a.b` string, `c` string")
    got = op.entropies(df, [("a.b",), ("a.b", "c")])
    assert got[("a.b",)] == pytest.approx(entropy([None, None, "p", "p|", "p"]))
    assert got[("a.b", "c")] == pytest.approx(entropy([(None, "x"), (None, "x"), ("p", None), ("p|", "x"), ("p", "|x")]))


def test_boosting_sends_few_blocks_at_a_time(spark, monkeypatch):
    """A task holds a few blocks of bounded size, not all that Spark's own batches would take in."""
    import pyarrow as pa

    from tierwatch.operators import boosting

    monkeypatch.setattr(boosting, "BLOCK_BYTES", 1800)  # 100 rows of two variables and two classes
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = []
    plain = boosting._level_cuts

    def watched(blocks, *rest):
        sizes = blocks.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([max(b.column(0).to_pylist())])], ["b", "n"]) for b in bs), "b long, n long")
        seen.extend(tuple(r) for r in sizes.collect())
        return plain(blocks, *rest)

    monkeypatch.setattr(boosting, "_level_cuts", watched)
    rng = np.random.default_rng(12)
    df = frame(spark, {"a": rng.normal(size=3000), "b": rng.integers(0, 9, 3000), "y": rng.integers(0, 2, 3000)}).coalesce(1)
    boosting.fit_booster(df, "y", ["a", "b"], rounds=1)
    assert len(seen) > 3 and max(b for b, _ in seen) <= boosting.BATCH_BLOCKS and max(n for _, n in seen) <= 100
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_boosting_counts_many_variables_and_rows_by_parts(monkeypatch):
    from tierwatch.operators import boosting

    rng = np.random.default_rng(13)
    classes, nodes, cols, bins, n = 2, 4, 5, 7, 60
    cells, places = rng.integers(0, bins, (cols, n)).astype(np.uint8), rng.integers(0, nodes, (classes, n)).astype(np.uint8)
    residual = rng.integers(-(1 << 28), 1 << 28, (classes, n)).astype(float)
    size = rng.integers(0, 1 << 26, (classes, n)).astype(float)
    found = np.zeros((classes, 3, nodes, cols, bins))
    room = np.empty((3, 3 * 20))
    for first in range(0, n, 20):
        some = slice(first, first + 20)
        for v in range(0, cols, 3):
            boosting._count(found[:, :, :, v : v + 3], cells[v : v + 3, some], places[:, some], residual[:, some] + boosting.CURVATURES, size[:, some], room)
    hand = np.zeros_like(found)
    for k in range(classes):
        for v in range(cols):
            for i in range(n):
                hand[k, :, places[k, i], v, cells[v, i]] += [1, residual[k, i], size[k, i]]
    assert (found == hand).all()
    # The largest residuals of a chunk still leave its count to be told from their sum.
    assert boosting.CHUNK_ROWS * boosting.UNIT < boosting.CURVATURES / 2


def test_boosting_adds_trees_together_as_one_by_one():
    from tierwatch.operators import boosting

    rng = np.random.default_rng(14)
    depth, classes = 3, 2
    cells = rng.integers(0, 256, (4, 300)).astype(np.uint8)
    rounds = [[(rng.integers(-1, 4, 7), rng.integers(0, 255, 7), rng.normal(size=15)) for _ in range(classes)] for _ in range(6)]
    scores = rng.normal(size=(classes, 300))
    by_hand = scores.copy()
    for trees in rounds:
        for k, (variable, cut, value) in enumerate(trees):
            by_hand[k] += 0.1 * value[boosting._reached(variable, depth)][boosting._places(variable, cut, cells, depth)]
    got = boosting._advanced(scores, cells, boosting._steps(rounds, 0.1, depth), depth)
    assert np.allclose(got, by_hand, rtol=0, atol=1e-12)
    assert (boosting._advanced(scores, cells, boosting._steps([], 0.1, depth), depth) == scores).all()
