"""Clustering of rows and of variables, components, levels."""

from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.operators import clustering as op
from tierwatch.operators.components import pca_project, pca_variance, vector_columns
from tierwatch.operators.ranking import cluster_weights
from tierwatch.operators.scaling import zscore
from tierwatch.plans.taxonomy import Taxonomy, fit_levels, variable_levels
from workload.common import (
    CLEAN,
    SCALED,
    VARS,
    assign_cte,
    centers_cte,
    clean_profile,
    each,
    query,
    r6,
    rounded,
    scaled_profile,
    table,
    with_,
)
from workload.ranking import PRIORITIES, weights_cte

DIM = 64
E = tuple(f"e_{i}" for i in range(DIM))
LLOYD_VARS = ("v_price", "v_qty", "v_lines")


def _embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return vector_columns(vectors, "embedding", DIM, "e_")


@query(
    "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e_{i}" for i in range(DIM)) + " FROM embeddings"
)
def vector_to_columns(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", *E)


_EMB = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT vec_id, label, UNNEST(x) AS w, GENERATE_SUBSCRIPTS(x, 1) AS i FROM v),
m AS (SELECT label AS c, i, AVG(w) AS w FROM e GROUP BY 1, 2),
d AS (SELECT vec_id, e.label, c, SUM((e.w - m.w) * (e.w - m.w)) AS d2 FROM e JOIN m ON e.i = m.i GROUP BY 1, 2, 3),
a AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d2, c) AS rn FROM d) WHERE rn = 1)"""


@query(f"WITH {_EMB} SELECT vec_id, c AS prediction FROM a")
def assign_nearest(spark, sf_dir):
    vectors = stage(_embeddings(spark, sf_dir), "vectors")
    return op.assign_nearest(vectors, op.group_means(vectors, E, "label")).select("vec_id", "prediction")


@query(f"WITH {_EMB} SELECT vec_id, c AS label, {r6('d2', 'distance')} FROM d WHERE c = label")
def squared_center_distance(spark, sf_dir):
    vectors = stage(_embeddings(spark, sf_dir), "vectors")
    centers = op.group_means(vectors, E, "label")
    out = op.centroid_distance(vectors, "label", centers, "distance", squared=True)
    return rounded(out.select("vec_id", "label", "distance"), "distance")


@query(
    f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id, a.label AS own, b.label AS other, SUM(POWER(LIST_DISTANCE(a.x, b.x), 2)) AS s, COUNT(*) AS n
  FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
q AS (SELECT vec_id, MAX(CASE WHEN own = other THEN s / n END) AS a, MIN(CASE WHEN own <> other THEN s / n END) AS b
  FROM p GROUP BY 1)
SELECT {r6('AVG(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / GREATEST(a, b) END)', 'silhouette')} FROM q"""
)
def silhouette(spark, sf_dir):
    vectors = stage(_embeddings(spark, sf_dir), "vectors")
    score = op.silhouette(vectors, E, "label")
    return rounded(spark.createDataFrame([(score,)], "silhouette double"), "silhouette")


def _silhouette_sql(k):
    """Closed form of the squared-distance silhouette for the labelling by line count."""
    return f"""SELECT {k} AS k, AVG(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END) AS score FROM (
SELECT rec_id, MAX(CASE WHEN y = c THEN n END) AS n_own, MAX(CASE WHEN y = c THEN d * n / (n - 1) END) AS a,
  MIN(CASE WHEN y <> c THEN d END) AS b
FROM (SELECT rec_id, y, c, n, q - 2 * (v_qty * mq + v_price * mp) + mn AS d FROM
  (SELECT rec_id, v_qty, v_price, v_qty * v_qty + v_price * v_price AS q, y{k} AS y FROM labelled) CROSS JOIN
  (SELECT y{k} AS c, COUNT(*) AS n, AVG(v_qty) AS mq, AVG(v_price) AS mp, AVG(v_qty * v_qty + v_price * v_price) AS mn
   FROM labelled GROUP BY 1)) GROUP BY rec_id)"""


SWEEP = range(2, 7)


@query(
    with_(
        SCALED
        + f""",
labelled AS (SELECT s.rec_id, s.v_qty, s.v_price, {", ".join(f"GREATEST(0, LEAST(CAST(c.v_lines AS INTEGER), {k - 1})) AS y{k}" for k in SWEEP)}
  FROM scaled s JOIN clean c ON s.rec_id = c.rec_id),
t AS ({" UNION ALL ".join(_silhouette_sql(k) for k in SWEEP)}),
u AS (SELECT k, score, score > GREATEST(0, COALESCE(MAX(score) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gained FROM t),
g AS (SELECT *, SUM(CASE WHEN gained THEN 1 ELSE 0 END) OVER (ORDER BY k) AS run FROM u),
h AS (SELECT k, score, COALESCE(MAX(CASE WHEN gained THEN k END) OVER (PARTITION BY run), 0) AS best_k,
  SUM(CASE WHEN gained THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY k) AS misses FROM g)""",
        f"SELECT k, {r6('score')}, CAST(best_k AS INTEGER) AS best_k, CAST(misses AS INTEGER) AS misses FROM h "
        "WHERE k <= COALESCE((SELECT MIN(k) FROM h WHERE misses >= 3), 99)",
    )
)
def best_k_trace(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    lines = F.col("v_lines").cast("int")
    labels = [F.greatest(F.lit(0), F.least(lines, F.lit(k - 1))).alias(f"y{k}") for k in SWEEP]
    scaled, _ = zscore(clean.select("v_qty", "v_price", *labels), ["v_qty", "v_price"])
    staged = stage(scaled, "sweep")
    scores = [(k, op.silhouette(staged, ["v_qty", "v_price"], f"y{k}")) for k in SWEEP]
    return rounded(op.KSweep.replay(scores).table(spark), "score")


_START = SCALED + ",\n" + centers_cte("s0", LLOYD_VARS, "pri")


def _step(i):
    """One pass: closest centers, then their means."""
    means = each("AVG({v}) AS c_{v}", LLOYD_VARS)
    return ",\n" + assign_cte(f"a{i}", LLOYD_VARS, f"s{i}") + f",\ns{i + 1} AS (SELECT c, {means} FROM a{i} GROUP BY c)"


@query(
    with_(
        _START + _step(0) + _step(1) + ",\n" + assign_cte("a2", LLOYD_VARS, "s2"),
        "SELECT rec_id, CAST(c AS INTEGER) AS prediction FROM a2",
    )
)
def kmeans_given_start(spark, sf_dir):
    scaled = stage(scaled_profile(spark, sf_dir).select("rec_id", "pri", *LLOYD_VARS), "lloyd", spread=True)
    start = op.group_means(scaled, LLOYD_VARS, "pri")
    _, labelled = op.kmeans_fit(scaled, LLOYD_VARS, init_centers=start, max_iter=2)
    return labelled.select("rec_id", "prediction")


@query(
    with_(
        _START + _step(0) + _step(1),
        f"SELECT CAST(c AS INTEGER) AS cluster, {each(r6('c_{v}', '{v}'), LLOYD_VARS)} FROM s2",
    )
)
def kmeans_centers_given_start(spark, sf_dir):
    scaled = stage(scaled_profile(spark, sf_dir).select("pri", *LLOYD_VARS), "lloyd", spread=True)
    start = op.group_means(scaled, LLOYD_VARS, "pri")
    centers, _ = op.kmeans_fit(scaled, LLOYD_VARS, init_centers=start, max_iter=2)
    wide = centers.table(spark).groupBy("cluster").pivot("variable", list(LLOYD_VARS)).agg(F.first("value"))
    return rounded(wide, *LLOYD_VARS)


@query()
def kmeans_seeded(spark, sf_dir):
    scaled = stage(scaled_profile(spark, sf_dir).select("rec_id", *VARS), "kmeans", spread=True)
    _, labelled = op.kmeans_fit(scaled, VARS, 5, key="rec_id")
    return labelled.select("rec_id", "prediction")


@query("SELECT COUNT(*) AS n_rows, 5 AS n_clusters, CAST(0 AS BIGINT) AS n_not_nearest, CAST(0 AS DOUBLE) AS farthest_mean FROM orders")
def kmeans_invariants(spark, sf_dir):
    """What holds for any finished fit: rows are with their nearest center, centers are means of their rows."""
    scaled = stage(scaled_profile(spark, sf_dir).select("rec_id", *VARS), "kmeans", spread=True)
    centers, labelled = op.kmeans_fit(scaled, VARS, 5)
    labelled = stage(labelled, "fitted")
    gaps = F.array(*[sum(((F.col(v) - F.lit(x)) ** 2 for v, x in zip(VARS, p)), F.lit(0.0)) for p in centers.points])
    own = F.get(gaps, F.col("prediction"))
    moved = [F.abs(F.avg(v) - F.get(F.array(*[F.lit(p[i]) for p in centers.points]), F.first("prediction"))) for i, v in enumerate(VARS)]
    far = labelled.groupBy("prediction").agg(F.greatest(*moved).alias("far"))
    wrong = labelled.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.count_if(own > F.array_min(gaps) + 1e-9).alias("wrong"))
    return wrong.join(far, "prediction").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_clusters"),
        F.sum("wrong").alias("n_not_nearest"),
        (F.round(F.max("far"), 2) + F.lit(0.0)).alias("farthest_mean"),
    )


@query()
def kmeans_cosine(spark, sf_dir):
    vectors = _embeddings(spark, sf_dir)
    _, labelled = op.kmeans_fit(vectors, E, 5, distance="cosine")
    return labelled.select("vec_id", "prediction")


@query()
def best_k_sweep(spark, sf_dir):
    scaled = stage(scaled_profile(spark, sf_dir).select("rec_id", *VARS), "sweep", spread=True)
    return op.best_k(scaled, VARS, key="rec_id").trace


_LONG_WEIGHTS = (
    CLEAN
    + ",\n"
    + weights_cte(PRIORITIES, "pri", VARS, "clean")
    + ",\nx AS ("
    + " UNION ALL ".join(f"SELECT variable, '{p}' AS profile, \"peso_{p}\" AS weight FROM w" for p in PRIORITIES)
    + """),
cost AS (SELECT p.variable AS a, q.variable AS b, 0.5 * SUM((p.weight - q.weight) * (p.weight - q.weight)) AS cost
  FROM x p JOIN x q ON p.profile = q.profile AND p.variable < q.variable GROUP BY 1, 2)"""
)


def _weights(spark, sf_dir):
    return stage(cluster_weights(clean_profile(spark, sf_dir).select("pri", *VARS), "pri", VARS, PRIORITIES), "weights")


@query(with_(_LONG_WEIGHTS, f"SELECT a, b, {r6('cost')} FROM cost"))
def ward_pair_costs(spark, sf_dir):
    weights = _weights(spark, sf_dir)
    profiles = [c for c in weights.columns if c != "variable"]
    points = weights.unpivot(["variable"], profiles, "profile", "weight").withColumn("size", F.lit(1.0))
    return rounded(op.ward_costs(points.withColumnRenamed("variable", "cid")), "cost")


@query(with_(_LONG_WEIGHTS, f"SELECT a, b, {r6('cost')} FROM cost ORDER BY cost.cost, a, b LIMIT 1"))
def ward_first_merge(spark, sf_dir):
    merges = op.ward_merges(_weights(spark, sf_dir))
    cheapest = min(merges, key=lambda m: m[2])
    return rounded(spark.createDataFrame([cheapest], "a string, b string, cost double"), "cost")


@query()
def ward_variable_groups(spark, sf_dir):
    return op.ward_groups(_weights(spark, sf_dir), 5)


@query()
def bisecting_variable_groups(spark, sf_dir):
    return op.bisecting_sweep(_weights(spark, sf_dir), range(2, 8))


# Groups of at most two variables, whose components have the shares (1 + |r|) / 2 and (1 - |r|) / 2.
GROUPS = {0: ["v_qty", "v_price"], 1: ["v_disc", "v_tax"], 2: ["v_lines", "v_ret"], 3: ["v_total"], 4: ["v_doy", "v_supp"]}


def _variance_cte():
    rows = []
    for g, names in GROUPS.items():
        if len(names) == 1:
            rows.append(f"SELECT {g}, 1, 1.0::DOUBLE, SQRT(COUNT(*)) FROM clean")
        else:
            r = f"ABS(CORR({names[0]}, {names[1]}))"
            rows += [
                f"SELECT {g}, 1, (1 + {r}) / 2, SQRT(COUNT(*) * (1 + {r})) FROM clean",
                f"SELECT {g}, 2, (1 - {r}) / 2, SQRT(COUNT(*) * (1 - {r})) FROM clean",
            ]
    return (
        f",\nshares (cluster, pc, share, sv) AS ({' UNION ALL '.join(rows)}),\n"
        "cum AS (SELECT *, SUM(share) OVER (PARTITION BY cluster ORDER BY pc ROWS UNBOUNDED PRECEDING) AS run FROM shares),\n"
        "var_table AS (SELECT cluster, pc, run, sv FROM cum WHERE run - share <= 0.99999999)"
    )


@query(
    with_(
        CLEAN + _variance_cte(),
        f"""SELECT 'PC' || CAST(pc AS VARCHAR) AS "Component", {r6('run', '"Variance"')}, CAST(cluster AS INTEGER) AS cluster,
{r6('sv', 'singular_value')} FROM var_table""",
    )
)
def explained_variance(spark, sf_dir):
    return rounded(pca_variance(clean_profile(spark, sf_dir), GROUPS), "Variance", "singular_value")


_MEMBERS = " UNION ALL ".join(f"SELECT '{v}' AS variable, {g} AS cluster" for g, vs in GROUPS.items() for v in vs)


@query(
    with_(
        CLEAN
        + _variance_cte()
        + f""",
sums AS (SELECT cluster, ROUND(SUM(run), 9) AS total FROM var_table GROUP BY cluster),
lv AS (SELECT cluster, CAST(DENSE_RANK() OVER (ORDER BY CASE WHEN total <= 1 THEN 9 ELSE total END DESC) - 1 AS INTEGER) AS lvl FROM sums),
members AS ({_MEMBERS})""",
        'SELECT variable, CAST(m.cluster AS INTEGER) AS cluster, lvl AS "Nivel" FROM members m JOIN lv ON lv.cluster = m.cluster',
    )
)
def variable_level_table(spark, sf_dir):
    members = spark.createDataFrame([(v, g) for g, vs in GROUPS.items() for v in vs], "variable string, cluster int")
    return variable_levels(pca_variance(clean_profile(spark, sf_dir), GROUPS), members)


@query()
def component_scores(spark, sf_dir):
    return pca_project(scaled_profile(spark, sf_dir), VARS, 3, keep=["rec_id"])


@query(
    with_(
        CLEAN,
        f"""SELECT rec_id, {r6('c * v_qty + s * v_supp', 'pca_0')}, {r6('c * v_supp - s * v_qty', 'pca_1')}
FROM clean, (SELECT COS(a) AS c, SIN(a) AS s FROM (SELECT 0.5 * ATAN2(2 * COVAR_SAMP(v_qty, v_supp), VAR_SAMP(v_qty) - VAR_SAMP(v_supp)) AS a FROM clean))""",
    )
)
def component_scores_pair(spark, sf_dir):
    """Two components of two variables, whose directions SQL has in closed form."""
    found = pca_project(clean_profile(spark, sf_dir), ["v_qty", "v_supp"], 2, keep=["rec_id"])
    return rounded(found, "pca_0", "pca_1")


@query(with_(CLEAN, "SELECT rec_id, " + ", ".join(f"{v} AS x_{i}" for i, v in enumerate(VARS)) + " FROM clean"))
def assembled_vectors(spark, sf_dir):
    vectors = op.assemble(clean_profile(spark, sf_dir), exclude=["rec_id", "ts", "pri", "st"])
    return vector_columns(vectors.select("rec_id", "features"), "features", len(VARS), "x_")


def level_members(spark):
    """All variables on the levels of their groups."""
    rows = [(v, g, g) for g, vs in GROUPS.items() for v in vs] + [("v_qty_max", 0, 0), ("v_price_max", 0, 0)]
    return spark.createDataFrame(rows, "variable string, cluster int, Nivel int")


@query()
def level_models(spark, sf_dir):
    clean = clean_profile(spark, sf_dir)
    levels = fit_levels(clean, level_members(spark), "rec_id")
    return Taxonomy(tuple(levels), {}).tables(spark)["centers"]


@query()
def learned_taxonomy(spark, sf_dir):
    """The default path: boosted importance, supervised cuts, Ward groups."""
    return Taxonomy.fit(clean_profile(spark, sf_dir), "rec_id", VARS).levels_table(spark)


@query()
def learned_taxonomy_forest(spark, sf_dir):
    taxonomy = Taxonomy.fit(clean_profile(spark, sf_dir), "rec_id", VARS, ranker="rf", bins=None)
    return taxonomy.levels_table(spark)
