"""Projection, imputation and scaling."""

from pyspark.sql import functions as F

from tierwatch.operators import cleaning as op
from tierwatch.operators.scaling import apply_scaler, cluster_scalers, zscore
from workload.common import (
    CLEAN,
    PROFILE,
    SCALED,
    VARS,
    clean_profile,
    each,
    long_form,
    order_profile,
    query,
    r6,
    rounded,
    scaled_profile,
    table,
    with_,
)


def _raw_names(spark, sf_dir):
    """Orders with the kind of column names a raw capture has."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("KEY"),
        F.col("o_custkey").alias("cust_id"),
        F.col("o_orderdate").alias("cap_Timestamp"),
        F.col("o_orderdate").alias("cap_Timestamp_raw"),
        F.col("o_orderstatus").alias("META_A"),
        F.col("o_orderpriority").alias("META_B"),
        F.col("o_totalprice").alias("X_TRANSFORM_total"),
        (F.col("o_custkey") % 7).alias("X_TRANSFORM_mod"),
    )


@query(
    'SELECT o_orderkey AS "KEY", o_orderstatus AS "META_A", o_orderpriority AS "META_B", '
    'o_totalprice AS "X_TRANSFORM_total", o_custkey % 7 AS "X_TRANSFORM_mod" FROM orders'
)
def drop_matching(spark, sf_dir):
    return op.drop_matching(_raw_names(spark, sf_dir), contains=["_Timestamp"], suffixes=["_id", "_timestamp"])


@query('SELECT o_orderkey AS "KEY", o_totalprice AS "X_TRANSFORM_total", o_custkey % 7 AS "X_TRANSFORM_mod" FROM orders')
def drop_named(spark, sf_dir):
    kept = op.drop_matching(_raw_names(spark, sf_dir), contains=["_Timestamp"], suffixes=["_id"])
    return op.drop_named(kept, "META_A", "META_B", strict=True)


@query('SELECT o_totalprice AS "X_TRANSFORM_total", o_custkey % 7 AS "X_TRANSFORM_mod", o_orderkey AS "KEY" FROM orders')
def select_matching(spark, sf_dir):
    return op.select_matching(_raw_names(spark, sf_dir), "TRANSFORM_", "KEY")


@query('SELECT o_totalprice AS total, o_custkey % 7 AS "mod", o_orderkey AS "KEY" FROM orders')
def strip_prefix(spark, sf_dir):
    return op.strip_prefix(op.select_matching(_raw_names(spark, sf_dir), "TRANSFORM_", "KEY"), "X_TRANSFORM_")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")
def unify_types(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return op.to_double(parts, ["p_size", "p_retailprice"])


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05")
def row_filters(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05))
        .select("l_orderkey", "l_partkey", "l_quantity")
    )


_STATUS = ("F", "O", "P")
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS \"prediction_{s}\"" for s in _STATUS)
    + " FROM orders"
)
def one_hot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return op.one_hot(orders, "o_orderstatus", "prediction")


@query(
    "SELECT "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + ", c_custkey, c_mktsegment FROM customer"
)
def dummies(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return op.dummies(customers, "c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def first_rows(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_acctbal")
        .orderBy(F.desc("c_acctbal"), "c_custkey")
        .limit(10)
    )


@query(
    "SELECT name, "
    + ", ".join(f"MAX(CASE WHEN st = '{s}' THEN value END) AS \"{s}\"" for s in _STATUS)
    + " FROM (SELECT o_orderstatus AS st, 'n' AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM orders GROUP BY 1 UNION ALL "
    "SELECT o_orderstatus, 'top', MAX(o_totalprice) FROM orders GROUP BY 1) GROUP BY name"
)
def transpose(spark, sf_dir):
    by_status = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("st"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("o_totalprice").alias("top"))
    )
    return op.transpose(by_status, "st")


@query(
    with_(
        PROFILE + f", means AS (SELECT {each('AVG({v}) AS m_{v}')} FROM profile)",
        f"SELECT rec_id, {each(r6('COALESCE({v}, m_{v})', '{v}'))} FROM profile, means",
    )
)
def fill_mean(spark, sf_dir):
    return rounded(op.fill_mean(order_profile(spark, sf_dir), VARS).select("rec_id", *VARS), *VARS)


@query(
    with_(
        PROFILE + f", top AS (SELECT {each('MAX({v}) AS m_{v}')} FROM profile)",
        f"SELECT rec_id, {each(r6('COALESCE({v}, -m_{v})', '{v}'))} FROM profile, top",
    )
)
def fill_extreme(spark, sf_dir):
    return rounded(op.fill_extreme(order_profile(spark, sf_dir), VARS).select("rec_id", *VARS), *VARS)


@query(with_(PROFILE, f"SELECT rec_id, {each(r6('COALESCE({v}, 0.0)', '{v}'))} FROM profile"))
def fill_const(spark, sf_dir):
    return rounded(op.fill_const(order_profile(spark, sf_dir), 0.0).select("rec_id", *VARS), *VARS)


@query(
    with_(
        PROFILE,
        f"SELECT variable, COUNT(*) FILTER (WHERE value IS NULL) AS n_null, "
        f"COUNT(*) FILTER (WHERE value IS NULL) > 0 AS any_null FROM ({long_form('profile')}) GROUP BY variable",
    )
)
def null_audit(spark, sf_dir):
    return op.null_audit(order_profile(spark, sf_dir), VARS)


@query(with_(SCALED, f"SELECT rec_id, pri, {each(r6('{v}', '{v}'))} FROM scaled"))
def zscore_scale(spark, sf_dir):
    return rounded(scaled_profile(spark, sf_dir).select("rec_id", "pri", *VARS), *VARS)


@query(
    with_(
        CLEAN,
        f"SELECT pri AS cluster, variable, {r6('AVG(value)', 'mean')}, {r6('STDDEV_POP(value)', 'std')} "
        f"FROM ({long_form('clean', keep='pri')}) GROUP BY pri, variable",
    )
)
def cluster_scaler_stats(spark, sf_dir):
    return rounded(cluster_scalers(clean_profile(spark, sf_dir), "pri", VARS), "mean", "std")


@query(
    with_(
        CLEAN
        + f""",
early AS (SELECT {each('AVG({v}) AS a_{v}')}, {each('STDDEV_POP({v}) AS s_{v}')} FROM clean WHERE st = 'F')""",
        f"SELECT rec_id, {each(r6('({v} - a_{v}) / (CASE WHEN s_{v} = 0 THEN 1 ELSE s_{v} END)', '{v}'))} FROM clean, early",
    )
)
def apply_stored_scaler(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    _, scaler = zscore(clean.filter(F.col("st") == "F"), VARS)
    return rounded(apply_scaler(clean, scaler.table(spark)).select("rec_id", *VARS), *VARS)
