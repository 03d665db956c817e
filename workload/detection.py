"""Row anomalies, responsible fields, composite groups and anomalous time points."""

from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.operators import anomaly as op
from tierwatch.operators import drift as change
from tierwatch.operators import moments as mom
from tierwatch.operators import rollup as roll
from tierwatch.operators.clustering import centroid_distance, group_means
from tierwatch.operators.ordering import recode_levels
from tierwatch.operators.scaling import zscore
from tierwatch.plans.detection import detect
from workload.clustering import level_members
from workload.common import (
    CLEAN,
    SCALED,
    VARS,
    centers_cte,
    clean_profile,
    distance2,
    each,
    long_form,
    query,
    r6,
    rounded,
    table,
    with_,
)
from workload.sources import _ASSIGNED, TIER0, TIER1, given_taxonomy

_DIST = SCALED + ",\n" + centers_cte("cen", VARS, "pri") + f""",
dist AS (SELECT s.*, c, SQRT({distance2(VARS)}) AS d FROM scaled s JOIN cen ON c = CAST(SUBSTRING(pri, 1, 1) AS INTEGER) - 1)"""


def _labelled(spark, sf_dir):
    """The scaled profile with the order priority as cluster label, and that label's centers."""
    scaled, _ = zscore(clean_profile(spark, sf_dir), VARS)
    scaled = scaled.withColumn("prediction", F.substring("pri", 1, 1).cast("int") - 1)
    return scaled, group_means(scaled, VARS, "prediction")


@query(with_(_DIST, f"SELECT rec_id, c AS prediction, {r6('d', 'distancia')} FROM dist"))
def center_distance(spark, sf_dir):
    scaled, centers = _labelled(spark, sf_dir)
    out = centroid_distance(scaled, "prediction", centers).select("rec_id", "prediction", "distancia")
    return rounded(out, "distancia")


@query(
    with_(
        _DIST,
        """SELECT rec_id, CASE WHEN COALESCE(ABS(d - (SELECT AVG(d) FROM dist)) < 3 * (SELECT STDDEV_SAMP(d) FROM dist), FALSE)
THEN 'Normal' ELSE 'Outlier' END AS outliers FROM dist""",
    )
)
def row_outliers(spark, sf_dir):
    scaled, centers = _labelled(spark, sf_dir)
    return op.sigma_label(centroid_distance(scaled, "prediction", centers), "distancia").select("rec_id", "outliers")


@query(
    with_(
        _DIST,
        """SELECT rec_id, CASE WHEN COALESCE(ABS(d - m) < 3 * s, FALSE) THEN 'Normal' ELSE 'Outlier' END AS outliers
FROM dist JOIN (SELECT c AS k, AVG(d) AS m, STDDEV_SAMP(d) AS s FROM dist GROUP BY c) ON k = c""",
    )
)
def row_outliers_by_cluster(spark, sf_dir):
    scaled, centers = _labelled(spark, sf_dir)
    distances = centroid_distance(scaled, "prediction", centers)
    return op.sigma_label(distances, "distancia", by="prediction").select("rec_id", "outliers")


_FIELD_FLAGS = f""",
long AS ({long_form('clean', keep='rec_id, pri')}),
band AS (SELECT pri, variable, AVG(value) AS m, STDDEV_SAMP(value) AS s FROM long GROUP BY pri, variable),
flagged AS (SELECT rec_id, l.pri, l.variable, value FROM long l JOIN band b ON b.pri = l.pri AND b.variable = l.variable
  WHERE NOT COALESCE(ABS(value - m) < 3 * (CASE WHEN s = 0 THEN 1e10 ELSE s END), FALSE))"""


@query(with_(CLEAN + _FIELD_FLAGS, f"SELECT rec_id, pri AS cluster, variable, {r6('value')} FROM flagged"))
def responsible_fields(spark, sf_dir):
    return rounded(op.anomaly_fields(clean_profile(spark, sf_dir), VARS, "pri", "rec_id"), "value")


@query(
    with_(
        CLEAN + _FIELD_FLAGS,
        """SELECT c.rec_id AS rec_id, COALESCE(t, '') AS "AnomalyFields" FROM clean c LEFT JOIN
(SELECT rec_id, STRING_AGG(variable || ':' || CAST(value AS VARCHAR), ';' ORDER BY variable) AS t
 FROM flagged GROUP BY rec_id) f ON f.rec_id = c.rec_id""",
    )
)
def responsible_field_text(spark, sf_dir):
    return op.anomaly_fields_text(clean_profile(spark, sf_dir), VARS, "pri").select("rec_id", "AnomalyFields")


_NIVELES = """niv AS (SELECT o_orderkey AS rec_id, o_orderdate AS ts,
  CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS nivel_0,
  CAST(DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS nivel_1 FROM orders),
grp AS (SELECT *, CONCAT(CAST(nivel_0 AS VARCHAR), '_', CAST(nivel_1 AS VARCHAR)) AS grupo FROM niv)"""


def _levelled(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ranks = []
    for col, out in (("o_orderpriority", "nivel_0"), ("o_orderstatus", "nivel_1")):
        values = orders.select(col).distinct()
        descending = recode_levels(values, col, "r")
        last = descending.agg(F.max("r")).first()[0]
        ranks.append(descending.select(col, (F.lit(last) - F.col("r")).alias(out)))
    for r in ranks:
        orders = orders.join(F.broadcast(r), r.columns[0])
    return op.composite_group(
        orders.select(F.col("o_orderkey").alias("rec_id"), F.col("o_orderdate").alias("ts"), "nivel_0", "nivel_1")
    )


@query(f"WITH {_NIVELES} SELECT grupo, COUNT(*) AS n FROM grp GROUP BY grupo ORDER BY grupo")
def composite_group_sizes(spark, sf_dir):
    return _levelled(spark, sf_dir).groupBy("grupo").agg(F.count(F.lit(1)).alias("n")).orderBy("grupo")


@query(f"WITH {_NIVELES} SELECT CAST(ts AS VARCHAR) AS timestamp, grupo, COUNT(*) AS n FROM grp GROUP BY ts, grupo")
def time_group_counts(spark, sf_dir):
    counts = op.time_group_counts(_levelled(spark, sf_dir), "ts")
    return counts.withColumn("timestamp", F.col("timestamp").cast("string"))


@query(
    f"WITH {_NIVELES} SELECT CAST(DATE_TRUNC('month', o_orderdate)::TIMESTAMP AS VARCHAR) AS timestamp, grupo, COUNT(*) AS n "
    "FROM grp JOIN orders ON o_orderkey = rec_id GROUP BY ALL"
)
def time_group_counts_joined(spark, sf_dir):
    labels = _levelled(spark, sf_dir).drop("ts")
    times = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), F.col("o_orderdate").alias("ts"))
    counts = op.time_group_counts(labels, "ts", bucket="month", times=times, key="rec_id")
    return counts.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz").cast("string"))


def _time_sql(counts, center):
    """The wide form: every timestamp crossed with every group."""
    return f"""{counts},
grid AS (SELECT a.timestamp, b.grupo, COALESCE(c.n, 0) AS n FROM (SELECT DISTINCT timestamp FROM counts) a
  CROSS JOIN (SELECT DISTINCT grupo FROM counts) b LEFT JOIN counts c ON c.timestamp = a.timestamp AND c.grupo = b.grupo),
gs AS (SELECT grupo, AVG(n) AS mu, STDDEV_POP(n) AS sd FROM grid GROUP BY grupo),
dd AS (SELECT timestamp, SQRT(SUM(POWER((n - mu) / (CASE WHEN sd = 0 THEN 1 ELSE sd END) - {center}, 2))) AS d
  FROM grid JOIN gs USING (grupo) GROUP BY timestamp)
SELECT CAST(timestamp AS VARCHAR) AS timestamp, {r6('d', 'distancia')},
  CASE WHEN COALESCE(ABS(d - (SELECT AVG(d) FROM dd)) < 3 * (SELECT STDDEV_SAMP(d) FROM dd), FALSE) THEN 'Normal' ELSE 'Outlier' END AS outliers
FROM dd"""


_COUNTS = f"WITH {_NIVELES}, counts AS (SELECT ts AS timestamp, grupo, COUNT(*) AS n FROM grp GROUP BY 1, 2)"
_EVENTS = """WITH counts AS (SELECT DATE_TRUNC('hour', ts)::TIMESTAMP AS timestamp, event_type AS grupo, COUNT(*) AS n
  FROM events GROUP BY 1, 2)"""


def _as_text(df):
    return rounded(df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz").cast("string")), "distancia")


@query(_time_sql(_COUNTS, "0"))
def time_point_anomalies(spark, sf_dir):
    counts = stage(op.time_group_counts(_levelled(spark, sf_dir), "ts"), "counts")
    return _as_text(op.time_anomalies(counts))


@query(_time_sql(_COUNTS, "mu"))
def time_point_anomalies_raw_mean(spark, sf_dir):
    counts = stage(op.time_group_counts(_levelled(spark, sf_dir), "ts"), "counts")
    return _as_text(op.time_anomalies(counts, center="raw_mean"))


@query(_time_sql(_EVENTS, "0"))
def hourly_event_anomalies(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = stage(op.time_group_counts(events, "ts", "event_type", bucket="hour"), "counts")
    return _as_text(op.time_anomalies(counts))


def _band(level, names):
    return f"""o{level}_d AS (SELECT t.rec_id, t.c, SQRT({distance2(names, 't.')}) AS d FROM t{level} t JOIN c{level} ON c{level}.c = t.c),
o{level} AS (SELECT rec_id, c, CASE WHEN COALESCE(ABS(d - (SELECT AVG(d) FROM o{level}_d)) < 3 * (SELECT STDDEV_SAMP(d) FROM o{level}_d), FALSE)
  THEN 'Normal' ELSE 'Outlier' END AS flag FROM o{level}_d),
n{level} AS (SELECT k.rec_id, t.c, {each('k.{v} AS {v}', names)} FROM clean k JOIN t{level} t ON t.rec_id = k.rec_id),
l{level} AS ({long_form(f'n{level}', names, 'rec_id, c')}),
b{level} AS (SELECT c, variable, AVG(value) AS m, STDDEV_SAMP(value) AS s FROM l{level} GROUP BY 1, 2),
f{level} AS (SELECT rec_id, STRING_AGG(l.variable || ':' || CAST(value AS VARCHAR), ';' ORDER BY l.variable) AS txt
  FROM l{level} l JOIN b{level} b ON b.c = l.c AND b.variable = l.variable
  WHERE NOT COALESCE(ABS(value - m) < 3 * (CASE WHEN s = 0 THEN 1e10 ELSE s END), FALSE) GROUP BY rec_id)"""


_DETECT = _ASSIGNED + ",\n" + _band(0, TIER0) + ",\n" + _band(1, TIER1) + """,
detected AS (SELECT o0.rec_id AS rec_id, o0.flag AS outliers_0, o0.c AS nivel_0, COALESCE(f0.txt, '') AS "fieldsAnomaly_Nivel_0",
  o1.flag AS outliers_1, o1.c AS nivel_1, COALESCE(f1.txt, '') AS "fieldsAnomaly_Nivel_1",
  CONCAT(CAST(o0.c AS VARCHAR), '_', CAST(o1.c AS VARCHAR)) AS grupo
FROM o0 JOIN o1 ON o0.rec_id = o1.rec_id LEFT JOIN f0 ON f0.rec_id = o0.rec_id LEFT JOIN f1 ON f1.rec_id = o0.rec_id)"""


def _detected(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    return detect(clean, "rec_id", taxonomy=given_taxonomy(clean), ts="ts")


@query(with_(_DETECT, "SELECT * FROM detected"))
def detect_rows(spark, sf_dir):
    return _detected(spark, sf_dir).rows.drop("ts")


@query(
    with_(
        _DETECT,
        'SELECT outliers_0, outliers_1, "fieldsAnomaly_Nivel_0", "fieldsAnomaly_Nivel_1", COUNT(*) AS n FROM detected GROUP BY ALL',
    )
)
def detection_summary(spark, sf_dir):
    return _detected(spark, sf_dir).summary


@query(
    _time_sql(
        "WITH " + _DETECT.lstrip() + """,
counts AS (SELECT o_orderdate AS timestamp, grupo, COUNT(*) AS n FROM detected JOIN orders ON o_orderkey = rec_id GROUP BY 1, 2)""",
        "0",
    )
)
def detect_time_points(spark, sf_dir):
    return _as_text(_detected(spark, sf_dir).time_points)


@query(
    f"WITH {_NIVELES} SELECT nivel_0, nivel_1, CAST(2 - BIT_COUNT(g) AS INTEGER) AS depth, g AS grouping_id, n FROM "
    "(SELECT nivel_0, nivel_1, CAST(GROUPING_ID(nivel_0, nivel_1) AS BIGINT) AS g, COUNT(*) AS n FROM grp GROUP BY ROLLUP (nivel_0, nivel_1))"
)
def level_rollup(spark, sf_dir):
    """Sizes of the composite group's prefixes."""
    return roll.level_rollup(_levelled(spark, sf_dir), ["nivel_0", "nivel_1"])


@query(
    f"""WITH {_NIVELES}, c AS (
  SELECT DATE_TRUNC('month', ts)::TIMESTAMP AS t, nivel_0, nivel_1, CAST(GROUPING_ID(nivel_0, nivel_1) AS BIGINT) AS g, COUNT(*) AS n
  FROM grp GROUP BY GROUPING SETS ((t), (t, nivel_0), (t, nivel_0, nivel_1))),
b AS (SELECT nivel_0, nivel_1, g, AVG(n) AS m, STDDEV_SAMP(n) AS s FROM c GROUP BY ALL)
SELECT CAST(t AS VARCHAR) AS timestamp, c.nivel_0, c.nivel_1, CAST(2 - BIT_COUNT(c.g) AS INTEGER) AS depth, n,
  CASE WHEN COALESCE(ABS(n - m) < 1.5 * s, FALSE) THEN 'Normal' ELSE 'Outlier' END AS outliers
FROM c JOIN b ON c.nivel_0 IS NOT DISTINCT FROM b.nivel_0 AND c.nivel_1 IS NOT DISTINCT FROM b.nivel_1 AND c.g = b.g"""
)
def rollup_time_anomalies(spark, sf_dir):
    """Months that stand out at any depth of the composite group."""
    found = roll.rollup_time_anomalies(_levelled(spark, sf_dir), "ts", ["nivel_0", "nivel_1"], n=1.5, bucket="month")
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz").cast("string"))


# A second run that renames all groups, moves each fiftieth record, and lacks some.
_RUNS = f"""WITH {_NIVELES},
old AS (SELECT rec_id, nivel_0 AS nivel FROM grp),
renamed AS (SELECT rec_id, CAST(CASE WHEN rec_id % 50 = 0 THEN nivel ELSE (nivel + 2) % 5 END AS INTEGER) AS nivel FROM old WHERE rec_id % 997 <> 5)"""


def _two_runs(spark, sf_dir):
    old = stage(_levelled(spark, sf_dir).select("rec_id", F.col("nivel_0").alias("nivel")), "run")
    shifted = F.when(F.col("rec_id") % 50 == 0, F.col("nivel")).otherwise((F.col("nivel") + 2) % 5)
    return old, old.where("rec_id % 997 <> 5").withColumn("nivel", shifted.cast("int"))


@query(
    f"""{_RUNS},
best AS (SELECT old, new FROM (
  SELECT o.nivel AS old, n.nivel AS new, ROW_NUMBER() OVER (PARTITION BY o.nivel ORDER BY COUNT(*) DESC) AS nth
  FROM old o JOIN renamed n USING (rec_id) GROUP BY 1, 2) WHERE nth = 1)
SELECT rec_id, o.nivel AS old, n.nivel AS new, CASE WHEN n.rec_id IS NULL THEN 'gone' ELSE 'moved' END AS change
FROM old o LEFT JOIN renamed n USING (rec_id) JOIN best ON best.old = o.nivel WHERE n.nivel IS DISTINCT FROM best.new"""
)
def moved_between_runs(spark, sf_dir):
    """Records that changed their group between two runs which name the groups differently."""
    return change.moved_records(*_two_runs(spark, sf_dir), "rec_id", "nivel")


_REPORT = "SELECT outliers_0, outliers_1, nivel_0, nivel_1 FROM detected WHERE rec_id % 2"


@query(
    with_(
        _DETECT,
        f"SELECT outliers_0, outliers_1, nivel_0, nivel_1, COUNT(*) AS missing FROM ({_REPORT} = 0 EXCEPT ALL {_REPORT} = 1) GROUP BY ALL",
    )
)
def report_difference(spark, sf_dir):
    """Rows of the report on even records that the report on odd ones lacks."""
    rows = _detected(spark, sf_dir).staged
    cols = ["outliers_0", "outliers_1", "nivel_0", "nivel_1"]
    found = change.multiset_difference(rows.where("rec_id % 2 = 0"), rows.where("rec_id % 2 = 1"), cols)
    return found.where("before > after").select(*cols, (F.col("before") - F.col("after")).alias("missing"))


_PER_LEVEL = " UNION ALL ".join(
    f"SELECT {i} AS level, t.c AS cluster, l.variable, COUNT(value) AS n, AVG(value) AS mean, STDDEV_POP(value) AS std, "
    f"AVG(value) - 3 * STDDEV_SAMP(value) AS low FROM t{i} t JOIN ({long_form('clean', names, 'rec_id')}) l USING (rec_id) GROUP BY ALL"
    for i, names in enumerate((TIER0, TIER1))
)


@query(with_(_ASSIGNED, f"SELECT level, cluster, variable, n, {r6('mean')}, {r6('std')}, {r6('low')} FROM ({_PER_LEVEL})"))
def merged_level_statistics(spark, sf_dir):
    """Scalers and bands of every level, merged from the statistics of four quarters that were stored apart."""
    clean = clean_profile(spark, sf_dir)
    levels = [(lv.number, lv.predict(), [(c, F.col(c)) for c in lv.variables]) for lv in given_taxonomy(clean).levels]
    quarters = [stage(mom.moments(clean.where(F.quarter("ts") == q), levels), "quarter") for q in range(1, 5)]
    merged = stage(mom.merge_moments(*quarters), "merged")
    both = mom.cluster_scalers_from(merged).join(mom.bands_from(merged).drop("high"), list(mom.KEYS))
    return rounded(both.join(merged.select(*mom.KEYS, "n"), list(mom.KEYS)), "mean", "std", "low")


@query()
def detect_refitted(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    return detect(clean, "rec_id", levels=level_members(spark), ts="ts").rows


@query(
    with_(
        _DIST
        + _FIELD_FLAGS
        + """,
mark AS (SELECT rec_id, d, CASE WHEN COALESCE(ABS(d - (SELECT AVG(d) FROM dist)) < 3 * (SELECT STDDEV_SAMP(d) FROM dist), FALSE)
  THEN 'Normal' ELSE 'Outlier' END AS outliers FROM dist)""",
        f"""SELECT m.rec_id AS rec_id, f.pri AS cluster, {r6('d', 'distancia')}, outliers, variable, {r6('value')}
FROM mark m JOIN flagged f ON f.rec_id = m.rec_id WHERE outliers = 'Outlier'""",
    )
)
def abnormal_orders(spark, sf_dir):
    """Which orders are abnormal for their priority group, and because of which fields."""
    clean = clean_profile(spark, sf_dir)
    scaled, _ = zscore(clean, VARS)
    scaled = scaled.withColumn("prediction", F.substring("pri", 1, 1).cast("int") - 1)
    distances = centroid_distance(scaled, "prediction", group_means(scaled, VARS, "prediction"))
    outliers = op.sigma_label(distances, "distancia").filter(F.col("outliers") == op.OUTLIER)
    fields = op.anomaly_fields(clean, VARS, "pri", "rec_id")
    found = outliers.select("rec_id", "distancia", "outliers").join(fields, "rec_id")
    return rounded(found, "distancia", "value")
