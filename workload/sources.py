"""Reading, writing and round trips."""

from pyspark.sql import functions as F

from tierwatch.functions.shared import scratch_path
from tierwatch.operators.clustering import group_means
from tierwatch.operators.scaling import zscore
from tierwatch.plans.taxonomy import Taxonomy
from tierwatch.sources import read_table, register_taxonomy, write_report
from workload.common import (
    SCALED,
    PROFILE,
    VARS,
    centers_cte,
    clean_profile,
    each,
    order_profile,
    query,
    r6,
    rounded,
    scaled_profile,
    assign_cte,
    with_,
)

TIER0 = ("v_lines", "v_price", "v_qty", "v_total")
TIER1 = ("v_disc", "v_doy", "v_ret", "v_tax")


def given_taxonomy(clean):
    """Two levels with centers taken from the order priority and the order status."""
    scaled, _ = zscore(clean, VARS)
    return Taxonomy.given(
        clean,
        [(0, TIER0, group_means(scaled, TIER0, "pri")), (1, TIER1, group_means(scaled, TIER1, "st"))],
    )


@query(with_(PROFILE, f"SELECT rec_id, CAST(ts AS VARCHAR) AS ts, pri, st, {each(r6('{v}', '{v}'))} FROM profile"))
def delimited_scan(spark, sf_dir):
    profile = order_profile(spark, sf_dir).withColumn("ts", F.col("ts").cast("string"))
    path = scratch_path(spark, "scan")
    profile.write.csv(path, sep=";", header=True)
    return rounded(read_table(spark, path, schema=profile.schema), *VARS)


@query("SELECT o_orderstatus AS st, o_orderpriority AS pri, COUNT(*) AS n FROM orders GROUP BY ALL")
def report_round_trip(spark, sf_dir):
    report = (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pri"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    path = scratch_path(spark, "report")
    write_report(report, path)
    return read_table(spark, path, sep=",", schema="st string, pri string, n bigint")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def columnar_report_round_trip(spark, sf_dir):
    report = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "report")
    write_report(report, path, fmt="parquet")
    return read_table(spark, path, fmt="parquet")


_CENTERS = SCALED + ",\n" + centers_cte("c0", TIER0, "pri") + ",\n" + centers_cte("c1", TIER1, "st")


def _center_rows(level, names):
    return " UNION ALL ".join(
        f"SELECT {level} AS level, c AS cluster, '{v}' AS variable, {r6('c_' + v, 'value')} FROM c{level}" for v in names
    )


@query(with_(_CENTERS, _center_rows(0, TIER0) + " UNION ALL " + _center_rows(1, TIER1)))
def taxonomy_centers_round_trip(spark, sf_dir):
    path = scratch_path(spark, "taxonomy")
    given_taxonomy(clean_profile(spark, sf_dir)).save(path, spark)
    return rounded(Taxonomy.load(spark, path).tables(spark)["centers"], "value")


_VARIABLE_ROWS = " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {level} AS cluster, {level} AS \"Nivel\"" for level, names in enumerate((TIER0, TIER1)) for v in names
)


@query(_VARIABLE_ROWS + " WHERE EXISTS (SELECT 1 FROM orders)")
def taxonomy_variables_round_trip(spark, sf_dir):
    """The index of variables by level, saved and loaded."""
    path = scratch_path(spark, "taxonomy")
    given_taxonomy(clean_profile(spark, sf_dir)).save(path, spark)
    return Taxonomy.load(spark, path).tables(spark)["level_variables"]


_ODD_LINES = "o_orderkey % 10 = 3"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR {_ODD_LINES} THEN NULL ELSE o_totalprice END AS o_totalprice,
CASE WHEN {_ODD_LINES} THEN CAST(o_orderkey AS VARCHAR) || ';oops;' || o_orderstatus END AS rejected, o_orderstatus FROM orders"""
)
def strict_scan(spark, sf_dir):
    """Lines with words for missing values, and lines whose price is no number, which are kept apart."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.when(F.expr(_ODD_LINES), "oops").when(F.col("o_orderkey") % 7 == 0, F.lit("N/A"))
    lines = orders.select("o_orderkey", F.coalesce(price, F.col("o_totalprice").cast("string")).alias("o_totalprice"), "o_orderstatus")
    path = scratch_path(spark, "lines")
    lines.write.csv(path, sep=";", header=True)
    shape = "o_orderkey bigint, o_totalprice double, o_orderstatus string"
    return read_table(spark, path, schema=shape, null_values=["N/A", "-"], rejected="rejected")


def _scaler_rows(level, names):
    return " UNION ALL ".join(
        f"SELECT {level} AS level, '{v}' AS variable, {r6('a_' + v, 'mean')}, {r6('s_' + v, 'std')} FROM moments"
        for v in names
    )


@query(with_(SCALED, _scaler_rows(0, TIER0) + " UNION ALL " + _scaler_rows(1, TIER1)))
def taxonomy_scalers_round_trip(spark, sf_dir):
    path = scratch_path(spark, "taxonomy")
    given_taxonomy(clean_profile(spark, sf_dir)).save(path, spark)
    return rounded(Taxonomy.load(spark, path).tables(spark)["scalers"], "mean", "std")


_ASSIGNED = _CENTERS + ",\n" + assign_cte("t0", TIER0, "c0") + ",\n" + assign_cte("t1", TIER1, "c1")


def _cluster_scaler_rows(level, names):
    return " UNION ALL ".join(
        f"SELECT {level} AS level, c AS cluster, '{v}' AS variable, {r6(f'AVG({v})', 'mean')}, "
        f"{r6(f'STDDEV_POP({v})', 'std')} FROM t{level} GROUP BY c"
        for v in names
    )


@query(with_(_ASSIGNED, _cluster_scaler_rows(0, TIER0) + " UNION ALL " + _cluster_scaler_rows(1, TIER1)))
def taxonomy_cluster_scalers_round_trip(spark, sf_dir):
    path = scratch_path(spark, "taxonomy")
    given_taxonomy(clean_profile(spark, sf_dir)).save(path, spark)
    return rounded(Taxonomy.load(spark, path).tables(spark)["cluster_scalers"], "mean", "std")


@query(
    with_(
        _ASSIGNED,
        """SELECT t0.rec_id AS rec_id, t0.c AS nivel_0, t1.c AS nivel_1,
  CONCAT(CAST(t0.c AS VARCHAR), '_', CAST(t1.c AS VARCHAR)) AS "group"
FROM t0 JOIN t1 ON t0.rec_id = t1.rec_id""",
    )
)
def classify(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    return given_taxonomy(clean).classify(clean).select("rec_id", "nivel_0", "nivel_1", "group")


@query(
    with_(
        _ASSIGNED,
        """SELECT t0.rec_id AS rec_id, t0.c AS nivel_0, t1.c AS nivel_1,
  CONCAT(CAST(t0.c AS VARCHAR), '_', CAST(t1.c AS VARCHAR)) AS "group"
FROM t0 JOIN t1 ON t0.rec_id = t1.rec_id""",
    )
)
def classify_in_sql(spark, sf_dir):
    """The same in SQL text: a table function that takes the records and a saved taxonomy."""
    path = scratch_path(spark, "taxonomy")
    clean = clean_profile(spark, sf_dir)
    given_taxonomy(clean).save(path, spark)
    register_taxonomy(spark, path, "classify_records")
    clean.select("rec_id", *TIER0, *TIER1).createOrReplaceTempView("records_to_classify")
    return spark.sql("SELECT rec_id, nivel_0, nivel_1, `group` FROM classify_records(TABLE(records_to_classify))")


@query(with_(_ASSIGNED, "SELECT t0.rec_id AS rec_id, t0.c AS nivel_0, t1.c AS nivel_1 FROM t0 JOIN t1 ON t0.rec_id = t1.rec_id"))
def level_labels(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    return given_taxonomy(clean).level_labels(clean, "rec_id")
