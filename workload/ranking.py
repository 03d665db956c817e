"""Ranking of variables."""

from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.operators import cutting as cut
from tierwatch.operators import ranking as op
from workload.common import CLEAN, VARS, clean_profile, query, r6, rounded, table, with_
from workload.relational import FLAGS, SU_VARS, su_sql

LABEL = "l_returnflag"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*SU_VARS, LABEL)


def _labelled(spark, sf_dir):
    return stage(clean_profile(spark, sf_dir).select("rec_id", "pri", "st", *VARS), "labelled")


@query(f"SELECT variable, {r6('su')} FROM ({su_sql(LABEL)}) WHERE su > 0")
def symmetrical_uncertainty(spark, sf_dir):
    return rounded(op.symmetrical_uncertainty(_lines(spark, sf_dir), LABEL, SU_VARS), "su")


@query(with_(CLEAN, f"SELECT variable, {r6('su')} FROM ({su_sql('pri', VARS, 'clean')}) WHERE su > 0"))
def symmetrical_uncertainty_continuous(spark, sf_dir):
    clean = clean_profile(spark, sf_dir).select("pri", *VARS)
    return rounded(op.symmetrical_uncertainty(clean, "pri", VARS), "su")


@query(f"SELECT variable, {r6('su')} FROM ({su_sql('l_suppkey')}) WHERE su > 0")
def symmetrical_uncertainty_many_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*SU_VARS, "l_suppkey")
    return rounded(op.symmetrical_uncertainty(lines, "l_suppkey", SU_VARS), "su")


# Keys shifted to where a double no longer holds every integer.
_LARGE = "(SELECT *, CAST(l_orderkey AS BIGINT) + 1152921504606846976 AS big_key FROM lineitem)"


@query(f"SELECT variable, {r6('su')} FROM ({su_sql(LABEL, ('big_key', 'l_quantity'), _LARGE)}) WHERE su > 0")
def symmetrical_uncertainty_large_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("big_key", F.col("l_orderkey") + F.lit(1 << 60))
    return rounded(op.symmetrical_uncertainty(lines, LABEL, ("big_key", "l_quantity")), "su")


_TEXT_LABEL = "(SELECT *, 's' || CAST(l_suppkey AS VARCHAR) AS supp FROM lineitem)"


@query(f"SELECT variable, {r6('su')} FROM ({su_sql('supp', SU_VARS, _TEXT_LABEL)}) WHERE su > 0")
def symmetrical_uncertainty_string_label(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("supp", F.concat(F.lit("s"), F.col("l_suppkey")))
    return rounded(op.symmetrical_uncertainty(lines, "supp", SU_VARS), "su")


@query(
    f"WITH s AS ({su_sql(LABEL)}) SELECT variable, {r6('su', 'valor')}, "
    f"{r6('su / (SELECT MAX(su) FROM s)', 'importance_norm')} FROM s WHERE su > 0"
)
def su_importance(spark, sf_dir):
    return rounded(op.su_importance(_lines(spark, sf_dir), LABEL, SU_VARS), "valor", "importance_norm")


def _pair_sql(a, b, source="lineitem"):
    h = f"ENTROPY({a})", f"ENTROPY({b})", f"ENTROPY(CAST({a} AS VARCHAR) || '|' || CAST({b} AS VARCHAR))"
    return (
        f"SELECT '{a}' AS variable, '{b}' AS other, 2 * ({h[0]} + {h[1]} - {h[2]}) / ({h[0]} + {h[1]}) AS su FROM {source}"
    )


_PAIRS = " UNION ALL ".join(_pair_sql(a, b) for i, a in enumerate(SU_VARS) for b in SU_VARS[i + 1 :])


@query(f"SELECT variable, other, {r6('su')} FROM ({_PAIRS})")
def pairwise_uncertainty(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*SU_VARS)
    return rounded(op.pairwise_su(lines, SU_VARS), "su")


# The filter walks down the uncertainties; with four variables the walk can be written out.
FCBF_VARS = ("v_supp", "v_ret", "v_qty_max", "v_doy")
_FCBF = (
    CLEAN
    + f""",
s AS ({su_sql('v_lines', FCBF_VARS, 'clean')}),
p AS (SELECT variable AS a, other AS b, su FROM ({" UNION ALL ".join(_pair_sql(a, b, "clean") for a in FCBF_VARS for b in FCBF_VARS if a != b)})),
o AS (SELECT variable, su, ROW_NUMBER() OVER (ORDER BY su DESC, variable) AS pos FROM s WHERE su > 0),
k1 AS (SELECT variable FROM o WHERE pos = 1),
k2 AS (SELECT * FROM k1 UNION ALL SELECT variable FROM o WHERE pos = 2 AND NOT EXISTS
  (SELECT 1 FROM p JOIN k1 ON p.a = k1.variable WHERE p.b = o.variable AND p.su >= o.su)),
k3 AS (SELECT * FROM k2 UNION ALL SELECT variable FROM o WHERE pos = 3 AND NOT EXISTS
  (SELECT 1 FROM p JOIN k2 ON p.a = k2.variable WHERE p.b = o.variable AND p.su >= o.su)),
k4 AS (SELECT * FROM k3 UNION ALL SELECT variable FROM o WHERE pos = 4 AND NOT EXISTS
  (SELECT 1 FROM p JOIN k3 ON p.a = k3.variable WHERE p.b = o.variable AND p.su >= o.su))"""
)


@query(
    with_(
        _FCBF,
        f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY pos) AS INTEGER) AS rank, o.variable AS variable, {r6('su')},
{r6('su / MAX(su) OVER ()', 'importance_norm')} FROM o JOIN k4 ON o.variable = k4.variable""",
    )
)
def fcbf_selection(spark, sf_dir):
    clean = stage(clean_profile(spark, sf_dir).select("v_lines", *FCBF_VARS), "fcbf")
    return rounded(op.fcbf(clean, "v_lines", FCBF_VARS), "su", "importance_norm")


@query(
    f"WITH s AS ({su_sql(LABEL)}), p AS (SELECT variable AS a, other AS b, su FROM ({_PAIRS}) UNION ALL "
    f"SELECT other, variable, su FROM ({_PAIRS})), "
    "o AS (SELECT variable, su, ROW_NUMBER() OVER (ORDER BY su DESC, variable) AS pos FROM s WHERE su > 0), "
    "k1 AS (SELECT variable FROM o WHERE pos = 1), "
    + ", ".join(
        f"k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT variable FROM o WHERE pos = {i} AND NOT EXISTS "
        f"(SELECT 1 FROM p JOIN k{i - 1} ON p.a = k{i - 1}.variable WHERE p.b = o.variable AND p.su >= o.su))"
        for i in (2, 3, 4)
    )
    + f" SELECT CAST(ROW_NUMBER() OVER (ORDER BY pos) AS INTEGER) AS rank, o.variable AS variable, {r6('su')}, "
    f"{r6('su / MAX(su) OVER ()', 'importance_norm')} FROM o JOIN k4 ON o.variable = k4.variable"
)
def fcbf_line_variables(spark, sf_dir):
    return rounded(op.fcbf(_lines(spark, sf_dir), LABEL, SU_VARS), "su", "importance_norm")


def weights_cte(labels, label, names, source):
    """`w(variable, peso_...)`: uncertainty against each label value, over its largest one."""
    parts = []
    for i, y in enumerate(labels):
        flag = f"(CASE WHEN {label} = '{y}' THEN 1 ELSE 0 END)"
        parts.append(f"u{i} AS ({su_sql(flag, names, source)})")
    cols = ", ".join(f"u{i}.su / (SELECT MAX(su) FROM u{i}) AS \"peso_{y}\"" for i, y in enumerate(labels))
    joins = " ".join(f"JOIN u{i} ON u{i}.variable = u0.variable" for i in range(1, len(labels)))
    return ",\n".join(parts) + f",\nw AS MATERIALIZED (SELECT u0.variable AS variable, {cols} FROM u0 {joins})"


_PESOS = [f"peso_{p}" for p in PRIORITIES]


@query(
    with_(
        CLEAN + ",\n" + weights_cte(PRIORITIES, "pri", VARS, "clean"),
        "SELECT variable, " + ", ".join(r6(f'"{p}"', f'"{p}"') for p in _PESOS) + " FROM w",
    )
)
def weight_matrix(spark, sf_dir):
    clean = clean_profile(spark, sf_dir).select("pri", *VARS)
    return rounded(op.cluster_weights(clean, "pri", VARS, PRIORITIES), *_PESOS)


@query(
    f"WITH {weights_cte(FLAGS, LABEL, SU_VARS, 'lineitem')} SELECT variable, "
    + ", ".join(r6(f'"peso_{f}"', f'"peso_{f}"') for f in FLAGS)
    + " FROM w"
)
def weight_matrix_lines(spark, sf_dir):
    return rounded(op.cluster_weights(_lines(spark, sf_dir), LABEL, SU_VARS), *[f"peso_{f}" for f in FLAGS])


_GROUPS = {v: i % 3 for i, v in enumerate(sorted(VARS))}
_MEAN = "(" + " + ".join(f'"{p}"' for p in _PESOS) + f") / {len(_PESOS)}"
_SPREAD = "(" + " + ".join(f'("{p}" - m) * ("{p}" - m)' for p in _PESOS) + f") / {len(_PESOS)}"


@query(
    with_(
        CLEAN
        + ",\n"
        + weights_cte(PRIORITIES, "pri", VARS, "clean")
        + f""",
g AS (SELECT *, {_MEAN} AS m, CASE {" ".join(f"WHEN variable = '{v}' THEN {g}" for v, g in _GROUPS.items())} END AS cluster FROM w),
d AS (SELECT variable, cluster, {_SPREAD} AS spread FROM g),
n AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY ROUND(spread, 12) DESC, variable) AS INTEGER) AS pos FROM d)""",
        "SELECT variable, CAST(cluster AS INTEGER) AS cluster, ROUND(spread, 9) + 0.0 AS spread, pos FROM n "
        "WHERE (pos <= 2 AND spread > 1e-12) OR pos = 1",
    )
)
def discriminating_variables(spark, sf_dir):
    clean = clean_profile(spark, sf_dir).select("pri", *VARS)
    weights = op.cluster_weights(clean, "pri", VARS, PRIORITIES)
    groups = spark.createDataFrame(sorted(_GROUPS.items()), "variable string, cluster int")
    picked = op.discriminating_variables(weights, groups, 2)
    return picked.withColumn("spread", F.round("spread", 9) + F.lit(0.0))


# One round of stumps: the cut of each class that takes most off its squared residuals, by all values.
_STUMP_VARS = ("v_lines", "v_supp", "v_ret", "v_qty_max")


def _stumps_sql() -> str:
    gains = []
    for i, p in enumerate(PRIORITIES):
        for v in _STUMP_VARS:
            gains.append(
                f"SELECT {i} AS k, {_STUMP_VARS.index(v)} AS v, '{v}' AS variable, x, n1, n - n1 AS n2, g1, g - g1 AS g2, n FROM ("
                f"SELECT x, SUM(m) OVER (ORDER BY x) AS n1, SUM(r) OVER (ORDER BY x) AS g1, SUM(m) OVER () AS n, SUM(r) OVER () AS g FROM ("
                f"SELECT {v} AS x, COUNT(*) AS m, SUM((CASE WHEN pri = '{p}' THEN 1.0 ELSE 0.0 END) - share) AS r FROM clean, "
                f"(SELECT AVG(CASE WHEN pri = '{p}' THEN 1.0 ELSE 0.0 END) AS share FROM clean) GROUP BY x))"
            )
    return with_(
        CLEAN
        + f""",
sides AS ({" UNION ALL ".join(gains)}),
gains AS (SELECT k, v, variable, MAX(n1 * n2 / n * (g1 / n1 - g2 / n2) * (g1 / n1 - g2 / n2)) AS gain FROM sides WHERE n2 > 0 GROUP BY k, v, variable),
best AS (SELECT variable, gain FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY ROUND(gain, 9) DESC, v) AS nth FROM gains) WHERE nth = 1),
shares AS (SELECT variable, SUM(gain) / (SELECT SUM(gain) FROM best) AS valor FROM best GROUP BY variable)""",
        f"SELECT variable, {r6('valor')}, {r6('valor / (SELECT MAX(valor) FROM shares)', 'importance_norm')} FROM shares WHERE valor > 1e-4",
    )


@query(_stumps_sql())
def boosted_stumps(spark, sf_dir):
    """The first round of the booster, one level deep, which SQL can follow."""
    found = op.gbt_importance(_labelled(spark, sf_dir), "pri", _STUMP_VARS, max_iter=1, max_depth=1)
    return rounded(found, "valor", "importance_norm")


@query()
def boosted_importance(spark, sf_dir):
    """All rounds at full depth, five classes at once."""
    return op.gbt_importance(_labelled(spark, sf_dir), "pri", VARS)


_CUT_VARS = ("v_qty", "v_tax")
_CUT_DEPTH = 3


def _level_sql(v: str, i: int) -> str:
    """One pass over the intervals iv{i}(lo, hi) of variable v: the cut of each that pays."""
    nlogn = lambda x: f"CASE WHEN {x} > 0 THEN {x} * LOG2({x}) ELSE 0.0 END"
    return f"""
{v}_s{i} AS (
  SELECT lo, hi, x, SUM(l) AS n1, SUM(t - l) AS n2, SUM(t) AS n, SUM({nlogn('l')}) AS f1, SUM({nlogn('(t - l)')}) AS f2, SUM({nlogn('t')}) AS f,
         COUNT_IF(t > 0) AS k, COUNT_IF(l > 0) AS k1, COUNT_IF(t > l) AS k2
  FROM (
    SELECT iv.lo, iv.hi, m.x, CAST(m.upto - COALESCE(a.upto, 0) AS DOUBLE) AS l, CAST(b.upto - COALESCE(a.upto, 0) AS DOUBLE) AS t
    FROM {v}_iv{i} iv JOIN {v}_run m ON m.x > iv.lo AND m.x < iv.hi JOIN {v}_run b ON b.x = iv.hi AND b.y = m.y
    LEFT JOIN {v}_run a ON a.x = iv.lo AND a.y = m.y)
  GROUP BY lo, hi, x),
{v}_h{i} AS (
  SELECT *, LOG2(n) - f / n AS h, LOG2(n1) - f1 / n1 AS h1, LOG2(n2) - f2 / n2 AS h2,
         ROUND(n1 * LOG2(n1) - f1 + n2 * LOG2(n2) - f2, 6) AS cost FROM {v}_s{i}),
{v}_c{i} AS (
  SELECT lo, hi, x FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lo, hi ORDER BY cost, x) AS nth FROM {v}_h{i})
  WHERE nth = 1 AND h - (n1 * h1 + n2 * h2) / n > (LOG2(n - 1) + LOG2(POW(3, k) - 2) - (k * h - k1 * h1 - k2 * h2)) / n),
{v}_iv{i + 1} AS (SELECT lo, x AS hi FROM {v}_c{i} UNION ALL SELECT x AS lo, hi FROM {v}_c{i})"""


def _cuts_cte(v: str) -> str:
    start = f"""
{v}_xy AS (SELECT {v} AS x, v_lines AS y, COUNT(*) AS n FROM clean GROUP BY ALL),
{v}_run AS (
  SELECT x, y, SUM(COALESCE(n, 0)) OVER (PARTITION BY y ORDER BY x) AS upto
  FROM (SELECT DISTINCT x FROM {v}_xy) CROSS JOIN (SELECT DISTINCT y FROM {v}_xy) LEFT JOIN {v}_xy USING (x, y)),
{v}_iv0 AS (SELECT CAST('-infinity' AS DOUBLE) AS lo, MAX(x) AS hi FROM {v}_run)"""
    cuts = f"{v}_cuts AS (" + " UNION ALL ".join(f"SELECT x FROM {v}_c{i}" for i in range(_CUT_DEPTH)) + ")"
    return ",".join([start, *[_level_sql(v, i) for i in range(_CUT_DEPTH)]]) + ",\n" + cuts


_CUTS = CLEAN + "," + ",".join(map(_cuts_cte, _CUT_VARS))


@query(with_(_CUTS, " UNION ALL ".join(f"SELECT '{v}' AS variable, ROUND(x, 6) + 0.0 AS cut FROM {v}_cuts" for v in _CUT_VARS)))
def supervised_cuts(spark, sf_dir):
    """Where two sums over the lines of an order are cut to tell the number of its lines."""
    clean = stage(clean_profile(spark, sf_dir).select("v_lines", *_CUT_VARS), "cuts")
    cuts = cut.supervised_cuts(clean, "v_lines", _CUT_VARS, depth=_CUT_DEPTH)
    return rounded(spark.createDataFrame([(v, x) for v in cuts for x in cuts[v]], "variable string, cut double"), "cut")


_BINNED = ", ".join(f"(SELECT COUNT(*) FROM {v}_cuts WHERE x < {v}) AS {v}" for v in _CUT_VARS)


@query(
    with_(
        _CUTS + f",\nbinned AS MATERIALIZED (SELECT v_lines, {_BINNED} FROM clean)",
        f"SELECT variable, {r6('su')} FROM ({su_sql('v_lines', _CUT_VARS, 'binned')}) WHERE su > 0",
    )
)
def supervised_uncertainty(spark, sf_dir):
    """Uncertainty of variables that were cut for the label."""
    clean = stage(clean_profile(spark, sf_dir).select("v_lines", *_CUT_VARS), "cuts")
    cuts = cut.supervised_cuts(clean, "v_lines", _CUT_VARS, depth=_CUT_DEPTH)
    return rounded(op.symmetrical_uncertainty(cut.cut_columns(clean, cuts), "v_lines", _CUT_VARS), "su")


@query()
def forest_importance(spark, sf_dir):
    return op.rf_importance(_labelled(spark, sf_dir), "pri", VARS)


_TENTHS = [(i + 1) / 10 for i in range(9)]
_IN_TENTHS = ", ".join(f"LEN(LIST_FILTER(LIST_DISTINCT(q.{v}), lambda e: e < clean.{v})) AS {v}" for v in VARS)


@query(
    with_(
        CLEAN
        + f""",
q AS (SELECT {", ".join(f"QUANTILE_CONT({v}, {_TENTHS}) AS {v}" for v in VARS)} FROM clean),
binned AS MATERIALIZED (SELECT clean.pri, {_IN_TENTHS} FROM clean, q)""",
        f"SELECT variable, {r6('su')} FROM ({su_sql('pri', VARS, 'binned')}) WHERE su > 0",
    )
)
def binned_uncertainty(spark, sf_dir):
    return rounded(op.symmetrical_uncertainty(_labelled(spark, sf_dir), "pri", VARS, bins=10), "su")
