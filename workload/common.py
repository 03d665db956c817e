"""The record table that the queries share, its SQL text, and the registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.operators.cleaning import fill_extreme, to_double
from tierwatch.operators.scaling import zscore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VARS = (
    "v_total", "v_lines", "v_qty", "v_qty_max", "v_price", "v_price_max",
    "v_disc", "v_tax", "v_supp", "v_ret", "v_doy",
)
KEYS = ("rec_id", "ts", "pri", "st")


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL counterpart if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: key, time, two labels and eleven variables, null where an order has no lines."""

    def cents(name):
        # Sums of whole cents are exact in any order and stay in one machine word.
        return F.sum(F.rint(F.col(name) * 100).cast("bigint"))

    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            cents("l_quantity").alias("qty"),
            F.max("l_quantity").alias("qty_max"),
            cents("l_extendedprice").alias("price"),
            F.max("l_extendedprice").alias("price_max"),
            cents("l_discount").alias("disc"),
            cents("l_tax").alias("tax"),
            F.countDistinct("l_suppkey").alias("n_supp"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
            F.max(F.dayofyear("l_shipdate")).alias("doy"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    d = "double"
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("rec_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("pri"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_totalprice").alias("v_total"),
        F.col("n_lines").cast(d).alias("v_lines"),
        (F.col("qty") / 100).alias("v_qty"),
        F.col("qty_max").alias("v_qty_max"),
        (F.col("price") / 100).alias("v_price"),
        F.col("price_max").alias("v_price_max"),
        (F.col("disc") / 100 / F.col("n_lines")).alias("v_disc"),
        (F.col("tax") / 100 / F.col("n_lines")).alias("v_tax"),
        F.col("n_supp").cast(d).alias("v_supp"),
        F.when(F.col("n_lines").isNotNull(), F.col("n_ret")).cast(d).alias("v_ret"),
        F.col("doy").cast(d).alias("v_doy"),
    )


def clean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile without gaps. It is written once, since every fit reads it several times."""
    staged = stage(to_double(order_profile(spark, sf_dir), VARS), "profile", spread=True)
    return fill_extreme(staged, VARS, otherwise=0.0)


def scaled_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore(clean_profile(spark, sf_dir), VARS)[0]


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Round to 6 places and turn -0.0 into 0.0, since engines add doubles in different orders."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def r6(expr: str, alias: str | None = None) -> str:
    return f"ROUND({expr}, 6) + 0.0 AS {alias or expr}"


def each(template: str, names: Sequence[str] = VARS, sep: str = ", ") -> str:
    return sep.join(template.replace("{v}", v) for v in names)


PROFILE = """
lines AS (
  SELECT l_orderkey AS k, COUNT(*) AS n_lines,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty, MAX(l_quantity) AS qty_max,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, MAX(l_extendedprice) AS price_max,
         SUM(CAST(l_discount AS DECIMAL(18,2))) AS disc, SUM(CAST(l_tax AS DECIMAL(18,2))) AS tax,
         COUNT(DISTINCT l_suppkey) AS n_supp,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         MAX(EXTRACT(DOY FROM l_shipdate)) AS doy
  FROM lineitem GROUP BY l_orderkey),
profile AS (
  SELECT o_orderkey AS rec_id, o_orderdate AS ts, o_orderpriority AS pri, o_orderstatus AS st,
         o_totalprice AS v_total, CAST(n_lines AS DOUBLE) AS v_lines,
         CAST(qty AS DOUBLE) AS v_qty, qty_max AS v_qty_max,
         CAST(price AS DOUBLE) AS v_price, price_max AS v_price_max,
         CAST(disc AS DOUBLE) / n_lines AS v_disc, CAST(tax AS DOUBLE) / n_lines AS v_tax,
         CAST(n_supp AS DOUBLE) AS v_supp, CAST(n_ret AS DOUBLE) AS v_ret,
         CAST(doy AS DOUBLE) AS v_doy
  FROM orders LEFT JOIN lines ON k = o_orderkey)"""

CLEAN = (
    PROFILE
    + f""",
top AS (SELECT {each('MAX({v}) AS m_{v}')} FROM profile),
clean AS MATERIALIZED (SELECT rec_id, ts, pri, st, {each('COALESCE({v}, -m_{v}, 0.0) AS {v}')} FROM profile, top)"""
)

SCALED = (
    CLEAN
    + f""",
moments AS (SELECT {each('AVG({v}) AS a_{v}')}, {each('STDDEV_POP({v}) AS s_{v}')} FROM clean),
scaled AS MATERIALIZED (SELECT rec_id, ts, pri, st,
  {each('({v} - a_{v}) / (CASE WHEN s_{v} = 0 THEN 1 ELSE s_{v} END) AS {v}')} FROM clean, moments)"""
)


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.lstrip()}\n{body}"


def long_form(source: str, names: Sequence[str] = VARS, keep: str = "") -> str:
    """A `(keep, variable, value)` relation from the columns of `source`."""
    keep = keep + ", " if keep else ""
    return " UNION ALL ".join(f"SELECT {keep}'{v}' AS variable, {v} AS value FROM {source}" for v in names)


def centers_cte(name: str, names: Sequence[str], by: str, source: str = "scaled") -> str:
    """Group means as centers, numbered from 0 by group value."""
    return (
        f"{name} AS (SELECT CAST(DENSE_RANK() OVER (ORDER BY {by}) - 1 AS INTEGER) AS c, "
        f"{each('AVG({v}) AS c_{v}', names)} FROM {source} GROUP BY {by})"
    )


def distance2(names: Sequence[str], left: str = "", right: str = "c_") -> str:
    return " + ".join(f"({left}{v} - {right}{v}) * ({left}{v} - {right}{v})" for v in names)


def assign_cte(name: str, names: Sequence[str], centers: str, source: str = "scaled", keep: str = "rec_id") -> str:
    """The closest center of each row; ties go to the lowest number."""
    return f"""{name}_d AS (SELECT s.*, c, {distance2(names)} AS d2 FROM {source} s CROSS JOIN {centers}),
{name} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keep} ORDER BY d2, c) AS rn FROM {name}_d) WHERE rn = 1)"""
