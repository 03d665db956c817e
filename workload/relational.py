"""Joins, aggregates, ordering and windows."""

from pyspark.sql import functions as F

from tierwatch.operators import relational as op
from tierwatch.operators.ordering import best, cumulative_cut, paste, recode_levels, top_k, with_row_number
from tierwatch.operators.ranking import su_importance
from tierwatch.plans.taxonomy import variance_by_group
from workload.common import CLEAN, PROFILE, VARS, clean_profile, each, long_form, order_profile, query, r6, rounded, table, with_

FLAGS = ("A", "N", "R")
SU_VARS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def su_sql(label: str, names=SU_VARS, source: str = "lineitem") -> str:
    """Symmetrical uncertainty of each column against `label`, by the engine's own entropy."""
    rows = []
    for v in names:
        h = f"ENTROPY({v})", f"ENTROPY({label})", f"ENTROPY(CAST({v} AS VARCHAR) || '|' || CAST({label} AS VARCHAR))"
        rows.append(
            f"SELECT '{v}' AS variable, CASE WHEN {h[0]} + {h[1]} <= 1e-12 THEN 0.0 ELSE "
            f"2 * ({h[0]} + {h[1]} - {h[2]}) / ({h[0]} + {h[1]}) END AS su FROM {source}"
        )
    return " UNION ALL ".join(rows)


_OUTER_FLOOR = 0.00025


def _flag_weight(flag):
    label = f"(CASE WHEN l_returnflag = '{flag}' THEN 1 ELSE 0 END)"
    return (
        f"w_{flag} AS (SELECT variable, su AS peso_{flag} FROM ({su_sql(label)}) WHERE su > "
        f"(SELECT AVG(su) FROM ({su_sql(label)})))"
    )


@query(
    f"WITH {', '.join(_flag_weight(f) for f in FLAGS)} "
    + "SELECT variable, "
    + ", ".join(r6(f"COALESCE(peso_{f}, 0)", f'"peso_{f}"') for f in FLAGS)
    + " FROM w_A FULL JOIN w_N USING (variable) FULL JOIN w_R USING (variable)"
)
def outer_join_weights(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*SU_VARS, "l_returnflag")
    parts = []
    for f in FLAGS:
        is_flag = lines.withColumn("y", (F.col("l_returnflag") == f).cast("int"))
        scores = su_importance(is_flag, "y", SU_VARS)
        mean = scores.agg(F.avg("valor")).first()[0]
        parts.append(scores.filter(F.col("valor") > mean).select("variable", F.col("valor").alias(f"peso_{f}")))
    return rounded(op.outer_weights(parts), *[f"peso_{f}" for f in FLAGS])


@query(
    """SELECT k AS rec_id, total, n_lines FROM
(SELECT o_orderkey AS k, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F') FULL JOIN
(SELECT l_orderkey AS k, COUNT(*) AS n_lines FROM lineitem GROUP BY 1) USING (k)"""
)
def join_on_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("rec_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    totals = orders.select(F.col("o_orderkey").alias("rec_id"), F.col("o_totalprice").alias("total"))
    return op.join_on_key(totals, lines, key="rec_id")


@query(
    """WITH s AS (SELECT p_brand AS cluster, MAX(p_retailprice) AS score FROM part GROUP BY 1),
l AS (SELECT cluster, CAST(DENSE_RANK() OVER (ORDER BY score DESC) - 1 AS INTEGER) AS level FROM s)
SELECT p_partkey AS variable, p_brand AS cluster, level FROM part LEFT JOIN l ON p_brand = cluster"""
)
def attach_levels(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("variable"), F.col("p_brand").alias("cluster"), "p_retailprice"
    )
    scores = parts.groupBy("cluster").agg(F.max("p_retailprice").alias("score"))
    levels = recode_levels(scores, "score").select("cluster", "level")
    return op.attach_levels(levels, parts.select("variable", "cluster"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def group_sizes(spark, sf_dir):
    return op.group_sizes(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


_DESCRIBE = ("v_total", "v_qty", "v_disc")
_STATS = f"""COUNT(value) AS n, {r6('AVG(value)', 'mean')}, {r6('STDDEV_SAMP(value)', 'std')},
{r6('MIN(value)', 'min')}, {r6('MAX(value)', 'max')}, {r6('QUANTILE_CONT(value, 0.25)', 'p25')},
{r6('QUANTILE_CONT(value, 0.5)', 'p50')}, {r6('QUANTILE_CONT(value, 0.75)', 'p75')}"""
_STAT_COLS = ("mean", "std", "min", "max", "p25", "p50", "p75")


@query(with_(PROFILE, f"SELECT variable, {_STATS} FROM ({long_form('profile', _DESCRIBE)}) GROUP BY variable"))
def describe_table(spark, sf_dir):
    return rounded(op.describe_cols(order_profile(spark, sf_dir), _DESCRIBE), *_STAT_COLS)


@query(with_(PROFILE, f"SELECT pri, variable, {_STATS} FROM ({long_form('profile', _DESCRIBE, 'pri')}) GROUP BY pri, variable"))
def describe_groups(spark, sf_dir):
    return rounded(op.describe_cols(order_profile(spark, sf_dir), _DESCRIBE, by="pri"), *_STAT_COLS)


@query(with_(CLEAN, f"SELECT {each(r6('AVG({v})', '{v}'))} FROM clean"))
def column_means(spark, sf_dir):
    return rounded(op.col_means(clean_profile(spark, sf_dir), VARS), *VARS)


@query(f"SELECT p_partkey, {r6('p_retailprice / (SELECT MAX(p_retailprice) FROM part)', 'share')} FROM part")
def divide_by_max(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return rounded(op.divide_by_max(parts, "p_retailprice", "share"), "share").drop("p_retailprice")


@query(
    f"""SELECT l_linestatus AS cluster, {r6('SUM(v)', 'Variance_sum')} FROM (
SELECT l_linestatus, l_returnflag, AVG(CAST(l_discount AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def variance_sums(spark, sf_dir):
    parts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linestatus").alias("cluster"), "l_returnflag")
        .agg((F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("l_discount")).alias("Variance"))
    )
    return rounded(variance_by_group(parts), "Variance_sum")


@query(
    "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT l_orderkey) AS n_keys, COUNT(*) - COUNT(DISTINCT l_orderkey) AS n_repeated FROM lineitem"
)
def key_check(spark, sf_dir):
    return op.check_key(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "SELECT CAST(o_orderdate AS VARCHAR) AS timestamp, "
    + ", ".join(f"COUNT(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in ("F", "O", "P"))
    + " FROM orders GROUP BY o_orderdate"
)
def time_group_matrix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("timestamp"), "o_orderstatus")
    return op.time_group_matrix(orders, "timestamp", "o_orderstatus")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT o_orderpriority AS pri, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, pri")
def sorted_sizes(spark, sf_dir):
    sizes = op.group_sizes(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "pri"), "pri")
    return sizes.orderBy(F.desc("n"), "pri")


@query(
    "SELECT l_partkey AS variable, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem GROUP BY 1 ORDER BY qty DESC, variable LIMIT 20"
)
def top_variables(spark, sf_dir):
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("variable"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    )
    return top_k(totals, "qty", "variable", 20)


@query(f"SELECT variable, {r6('su')} FROM ({su_sql('l_returnflag')}) ORDER BY su DESC, variable LIMIT 1")
def best_variable(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*SU_VARS, "l_returnflag")
    scores = su_importance(lines, "l_returnflag", SU_VARS).withColumnRenamed("valor", "su")
    return rounded(best(scores, "variable", "su"), "su")


@query(
    """SELECT c_nationkey AS cluster, n, CAST(DENSE_RANK() OVER (ORDER BY n DESC) - 1 AS INTEGER) AS level
FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1)"""
)
def level_recode(spark, sf_dir):
    sizes = op.group_sizes(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "cluster"), "cluster")
    return recode_levels(sizes, "n")


_MONTHLY = """monthly AS (SELECT o_orderstatus AS cluster, CAST(DATE_TRUNC('month', o_orderdate) AS VARCHAR) AS m,
  COUNT(*) AS n FROM orders GROUP BY 1, 2),
shares AS (SELECT cluster, SUBSTRING(m, 1, 7) AS pc, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY cluster) AS share FROM monthly),
running AS (SELECT *, SUM(share) OVER (PARTITION BY cluster ORDER BY pc ROWS UNBOUNDED PRECEDING) AS cum FROM shares)"""


@query(f"WITH {_MONTHLY} SELECT cluster, pc, {r6('share')}, {r6('cum', chr(34) + 'Variance' + chr(34))} FROM running WHERE cum - share <= 0.5")
def cumulative_shares(spark, sf_dir):
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("cluster"), F.date_format("o_orderdate", "yyyy-MM").alias("pc"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = monthly.groupBy("cluster").agg(F.sum("n").alias("total"))
    shares = monthly.join(totals, "cluster").select("cluster", "pc", (F.col("n") / F.col("total")).alias("share"))
    return rounded(cumulative_cut(shares, "cluster", "pc", "share", 0.5), "share", "Variance")


@query(
    """SELECT c_custkey AS entity, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier"""
)
def append_rows(spark, sf_dir):
    def renamed(name, p):
        return table(spark, sf_dir, name).select(
            F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").alias("entity"),
            F.col(f"{p}_nationkey").alias("nation"),
            F.col(f"{p}_acctbal").alias("balance"),
        )

    return op.append_rows(renamed("customer", "c"), renamed("supplier", "s"))


@query(
    """SELECT rn AS pos, o_orderkey, c_custkey FROM
(SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) a JOIN
(SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer) b USING (rn)"""
)
def paste_by_position(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    numbered = with_row_number(orders, ["o_totalprice", "o_orderkey"], "pos")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    pasted = paste(numbered, customers, ["pos"], ["c_acctbal", "c_custkey"])
    return pasted.select("pos", "o_orderkey", "c_custkey")


@query(
    f"""SELECT s_nationkey AS nation, {r6('AVG(s_acctbal)', 'balance')} FROM supplier GROUP BY 1 UNION ALL
SELECT NULL, {r6('AVG(b)', 'balance')} FROM (SELECT AVG(s_acctbal) AS b FROM supplier GROUP BY s_nationkey)"""
)
def mean_row(spark, sf_dir):
    by_nation = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("balance"))
    return rounded(op.with_mean_row(by_nation, ["balance"]), "balance")


@query(
    """SELECT o_orderkey, CONCAT('status:', o_orderstatus) AS tag, CONCAT(o_orderstatus, '_', o_orderpriority) AS joined,
CASE WHEN ABS(o_totalprice - 250000) < 100000 THEN 'Normal' ELSE 'Outlier' END AS flag,
CAST(o_custkey AS VARCHAR) AS cust FROM orders"""
)
def string_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.format_string("status:%s", "o_orderstatus").alias("tag"),
        F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("joined"),
        F.when(F.abs(F.col("o_totalprice") - 250000) < 100000, "Normal").otherwise("Outlier").alias("flag"),
        F.col("o_custkey").cast("string").alias("cust"),
    )
