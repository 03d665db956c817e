import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwatch import Taxonomy, detect
from tierwatch.operators.clustering import Centers
from tierwatch.plans.taxonomy import variable_levels
from tierwatch.streaming import score_stream

COLS = [f"x{i}" for i in range(6)]


def records(spark, n=400):
    """Three blobs on six variables; x1 copies x0, and one record is far away on x2."""
    rng = np.random.default_rng(11)
    truth = rng.integers(0, 3, n)
    x = (rng.normal(size=(3, 6)) * 10)[truth] + rng.normal(size=(n, 6))
    x[:, 1] = x[:, 0]
    x[5, 2] += 500.0
    rows = [(i, f"t{i % 20:02d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, ts string, " + ", ".join(f"{c} double" for c in COLS))


@pytest.fixture(scope="module")
def fitted(spark):
    df = records(spark)
    return df, Taxonomy.fit(df, "id", ts="ts", max_k=6, ranker="rf", clusters=4)


def test_levels_are_dense_and_hold_every_chosen_variable_once(fitted):
    _, taxonomy = fitted
    assert [lv.number for lv in taxonomy.levels] == list(range(len(taxonomy.levels)))
    members = [c for lv in taxonomy.levels for c in lv.variables]
    assert len(members) == len(set(members)) and set(members) <= set(COLS)


def test_copies_share_a_group(fitted):
    _, taxonomy = fitted
    assert taxonomy.groups["x0"] == taxonomy.groups["x1"]


def test_saved_taxonomy_classifies_alike(spark, fitted, tmp_path):
    df, taxonomy = fitted
    taxonomy.save(str(tmp_path / "t"), spark)
    loaded = Taxonomy.load(spark, str(tmp_path / "t"))
    assert loaded.levels == taxonomy.levels and dict(loaded.groups) == dict(taxonomy.groups)
    a, b = taxonomy.classify(df), loaded.classify(df)
    assert a.exceptAll(b).count() == 0


def test_classify_is_a_projection(fitted):
    df, taxonomy = fitted
    plan = taxonomy.classify(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_training_rows_get_their_training_labels(fitted):
    df, taxonomy = fitted
    out = detect(df, "id", taxonomy=taxonomy, ts="ts").rows.select("id", F.col("grupo").alias("a"))
    both = out.join(taxonomy.classify(df).select("id", F.col("group").alias("b")), "id")
    assert both.count() == 400 and both.filter("a <> b").count() == 0


def test_detection_finds_the_planted_record_and_its_field(fitted):
    df, taxonomy = fitted
    level = next(lv for lv in taxonomy.levels if "x2" in lv.variables)
    found = detect(df, "id", taxonomy=taxonomy, ts="ts")
    row = found.rows.filter("id = 5").first()
    assert "x2:" in row[f"fieldsAnomaly_Nivel_{level.number}"]
    assert found.time_points.count() == 20
    apart = detect(df.drop("ts"), "id", taxonomy=taxonomy, ts="ts", times=df.select("id", "ts"))
    assert apart.time_points.exceptAll(found.time_points).count() == 0
    assert found.summary.agg(F.sum("n")).first()[0] == 400


def test_far_record_is_an_outlier_of_its_level(fitted):
    df, _ = fitted
    one_center = Taxonomy.given(df, [(0, ["x2"], Centers.given(["x2"], [[0.0]]))])
    rows = detect(df, "id", taxonomy=one_center).rows
    assert [r["id"] for r in rows.filter("outliers_0 = 'Outlier'").collect()] == [5]
    assert rows.filter("id = 5").first()["fieldsAnomaly_Nivel_0"].startswith("x2:")


def test_refitted_levels_equal_stored_ones(fitted):
    df, taxonomy = fitted
    levels = taxonomy.levels_table(df.sparkSession)
    again = detect(df, "id", levels=levels, max_k=6).rows
    stored = detect(df, "id", taxonomy=taxonomy).rows
    assert again.select(sorted(again.columns)).exceptAll(stored.select(sorted(stored.columns))).count() == 0


def test_raw_space_measures_unscaled_values(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(10)], "id bigint, a double, b double")
    taxonomy = Taxonomy.given(df, [(0, ["a", "b"], Centers.given(["a", "b"], [[-1.0, 0.0], [1.0, 0.0]]))])
    scaled = detect(df, "id", taxonomy=taxonomy).rows.count()
    raw = detect(df, "id", taxonomy=taxonomy, space="raw").rows.count()
    assert scaled == raw == 10


def test_singletons_come_first_and_ties_share_a_level(spark):
    table = spark.createDataFrame(
        [("PC1", 0.6, 0), ("PC2", 1.0, 0), ("PC1", 1.0, 1), ("PC1", 0.7, 2), ("PC2", 1.0, 2), ("PC1", 0.6, 3), ("PC2", 1.0, 3)],
        "Component string, Variance double, cluster int",
    )
    groups = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 0)], "variable string, cluster int")
    got = {r["variable"]: r["Nivel"] for r in variable_levels(table, groups).collect()}
    assert got == {"b": 0, "c": 1, "a": 2, "e": 2, "d": 2}


@pytest.mark.parametrize("options", [{"ranker": "su", "bins": 8}, {"ranker": "su", "grouping": "bisecting"}])
def test_other_rankers_and_groupings(spark, options):
    taxonomy = Taxonomy.fit(records(spark, 200), "id", ts="ts", max_k=4, **options)
    assert taxonomy.levels


def test_stream_scores_equal_batch_scores(spark, fitted, tmp_path):
    df, taxonomy = fitted
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score_stream(stream, taxonomy, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    scored = spark.read.parquet(str(tmp_path / "out"))
    assert scored.count() == 400
    assert scored.exceptAll(taxonomy.classify(df).select(scored.columns)).count() == 0


def test_table_function_takes_rows_in_batches_and_keeps_all_columns(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from tierwatch.operators.clustering import Centers
    from tierwatch.sources import table_function

    made = []
    plain = table_function.udtf
    monkeypatch.setattr(table_function, "udtf", lambda cls, **how: made.append(how) or plain(cls, **how))
    monkeypatch.setattr(table_function, "HELD_ROWS", 3)
    rows = [(i, None if i == 4 else float(i % 5), float(i), datetime(2024, 1, 1 + i), [i, None], None if i == 2 else "x") for i in range(11)]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, ts timestamp, list array<long>, word string")
    filled = df.fillna(0.0, ["a"])
    levels = [(0, ["a"], Centers.given(["a"], [[-1.0], [1.0]])), (1, ["b.c"], Centers.given(["b.c"], [[-1.0], [0.0], [1.0]]))]
    taxonomy = Taxonomy.given(filled, levels)
    taxonomy.save(str(tmp_path / "t"), spark)
    table_function.register_taxonomy(spark, str(tmp_path / "t"), "classify_here")
    filled.createOrReplaceTempView("records_here")
    got = spark.sql("SELECT * FROM classify_here(TABLE(records_here))")
    expected = taxonomy.classify(filled)
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert made == [{"useArrow": False}]  # over Arrow, each row's result would be a table of its own
