"""Three-sigma labels, responsible fields, composite groups and anomalous time points.

The three-sigma rule uses the sample deviation. A value is Normal only if it is shown to
be inside the band: an undefined deviation (one row) leaves it an Outlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted, starting
from tierwatch.functions.shared import join_small

NORMAL, OUTLIER = "Normal", "Outlier"
# Deviation assumed for a constant field, so that it never raises a flag.
CONSTANT_FIELD_STD = 1e10


def _label(value: Column, mean: Column, std: Column, n: float) -> Column:
    inside = F.coalesce(F.abs(value - mean) < n * std, F.lit(False))
    return F.when(inside, NORMAL).otherwise(OUTLIER)


def sigma_label(
    df: DataFrame, col: str, n: float = 3.0, by: str | None = None, out: str = "outliers"
) -> DataFrame:
    """Label each row by whether `col` lies within n deviations of its mean."""
    return sigma_labels(df, {col: out}, n) if by is None else _sigma_by(df, col, n, by, out)


def sigma_labels(df: DataFrame, cols: dict[str, str], n: float = 3.0) -> DataFrame:
    """Label several columns at once; their statistics come from a single aggregation."""
    stats = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(quoted(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return df.withColumns(
        {
            out: _label(
                F.col(quoted(c)),
                F.lit(stats[f"m{i}"]).cast("double"),
                F.lit(stats[f"s{i}"]).cast("double"),
                n,
            )
            for i, (c, out) in enumerate(cols.items())
        }
    )


def _sigma_by(df: DataFrame, col: str, n: float, by: str, out: str) -> DataFrame:
    stats = df.groupBy(quoted(by)).agg(F.avg(quoted(col)).alias("__m"), F.stddev_samp(quoted(col)).alias("__s"))
    joined = join_small(df, stats, by)
    return joined.withColumn(out, _label(F.col(quoted(col)), F.col("__m"), F.col("__s"), n)).drop("__m", "__s")


def _banded(
    df: DataFrame, cols: Sequence[str], label: str, n: float, min_cluster_size: int, source: DataFrame | None = None
):
    """Rows joined with the band of each field in their cluster.

    Returns the joined table, whether any field of a row is outside its band, and the array
    of `(variable, value)` that are. The array is only built for rows with such a field, and
    the test itself is kept short so that it runs as compiled code.
    """
    size, key = F.count(F.lit(1)), "__label"
    moments = (df if source is None else source).groupBy(F.col(quoted(label)).alias(key)).agg(
        (size >= min_cluster_size).alias("__big"),
        *[F.avg(quoted(c)).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(quoted(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    )

    def width(s: str) -> Column:
        return F.coalesce(n * F.when(F.col(s) == 0, CONSTANT_FIELD_STD).otherwise(F.col(s)), F.lit(0.0))

    bands = moments.select(
        key,
        "__big",
        *[F.coalesce(f"a{i}", F.lit(0.0)).alias(f"__m{i}") for i in range(len(cols))],
        *[width(f"s{i}").alias(f"__w{i}") for i in range(len(cols))],
    )
    joined = join_small(df, bands, F.col(quoted(label)).eqNullSafe(F.col(key)), "inner")
    # A missing value becomes NaN, which is not below any width.
    xs = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(float("nan"))) for c in cols]
    outside = F.lit(False)
    for i, x in enumerate(xs):
        outside = outside | ~(F.abs(x - F.col(f"__m{i}")) < F.col(f"__w{i}"))
    cells = F.arrays_zip(
        F.array(*[F.lit(c) for c in cols]).alias("variable"),
        F.array(*[F.col(quoted(c)).cast("double") for c in cols]).alias("value"),
        F.array(*[F.col(f"__m{i}") for i in range(len(cols))]).alias("m"),
        F.array(*[F.col(f"__w{i}") for i in range(len(cols))]).alias("w"),
    )
    found = F.filter(
        cells, lambda f: ~(F.abs(F.coalesce(f["value"], F.lit(float("nan"))) - f["m"]) < f["w"])
    )
    return joined, F.col("__big") & outside, found


def anomaly_fields(
    df: DataFrame, cols: Sequence[str], label: str, key: str, n: float = 3.0, min_cluster_size: int = 1
) -> DataFrame:
    """`(key, cluster, variable, value)` for every value outside its cluster's band."""
    joined, outside, found = _banded(df, sorted(cols), label, n, min_cluster_size)
    return (
        joined.filter(outside)
        .select(quoted(key), F.col(quoted(label)).alias("cluster"), F.explode(found).alias("f"))
        .select(quoted(key), "cluster", "f.variable", "f.value")
    )


def anomaly_fields_text(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    n: float = 3.0,
    min_cluster_size: int = 1,
    out: str = "AnomalyFields",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add a column listing `variable:value` for the flagged fields, by variable name.

    The bands come from `source`, which holds the same rows in a cheaper form, or from `df`.
    """
    joined, outside, found = _banded(df, sorted(cols), label, n, min_cluster_size, source)
    texts = F.transform(
        found, lambda f: F.concat(f["variable"], F.lit(":"), F.coalesce(f["value"].cast("string"), F.lit("null")))
    )
    listed = F.when(outside, F.array_join(texts, ";")).otherwise(F.lit(""))
    return joined.withColumn(out, listed).select(*[quoted(c) for c in df.columns], out)


def level_columns(columns: Sequence[str]) -> list[str]:
    """`nivel_0, nivel_1, ...` up to the first gap."""
    found = []
    while f"nivel_{len(found)}" in columns:
        found.append(f"nivel_{len(found)}")
    return found


def composite_group(df: DataFrame, out: str = "grupo") -> DataFrame:
    """Join the level labels of a row with underscores."""
    cols = level_columns(df.columns)
    return df.withColumn(out, F.concat_ws("_", *[F.col(c).cast("string") for c in cols]))


def time_group_counts(
    df: DataFrame,
    ts: str,
    group: str = "grupo",
    bucket: str | None = None,
    times: DataFrame | None = None,
    key: str | None = None,
) -> DataFrame:
    """Long `(timestamp, grupo, n)`; combinations that do not occur are absent.

    Timestamps may sit in a table of their own, joined by record key.
    """
    at, name = F.col(quoted(ts)), F.col(quoted(group))
    if times is None:
        rows = df.select(at.alias("at"), name.alias("grupo"))
    else:
        stamped = times.select(F.col(quoted(key)).alias("key"), at.alias("at"))
        rows = df.select(F.col(quoted(key)).alias("key"), name.alias("grupo")).join(stamped, "key")
    point = F.date_trunc(bucket, "at") if bucket else F.col("at")
    return (
        rows.groupBy(point.alias("timestamp"), "grupo")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def time_anomalies(counts: DataFrame, n: float = 3.0, center: str = "zero") -> DataFrame:
    """`(timestamp, distancia, outliers)` from long counts.

    A timestamp is a vector of z-scored counts over all groups. Absent cells all look the
    same within a group, so their part of the squared distance is one constant per group;
    only present cells are visited and the wide matrix is never built.
    `center` is "zero" (the mean in z-space) or "raw_mean" (unscaled column means).
    """
    t = float(counts.select("timestamp").distinct().count())
    counts = counts.withColumn("n", F.col("n").cast("double"))
    means = counts.groupBy("grupo").agg((F.sum("n") / t).alias("mu"))
    # Squared differences from the mean, with those of the absent cells: nothing large cancels.
    gap = F.col("n") - F.col("mu")
    groups = (
        join_small(counts, means, "grupo")
        .groupBy("grupo", "mu")
        .agg(F.sum(gap * gap).alias("present"), F.count(F.lit(1)).alias("m"))
        .withColumn("sigma", F.sqrt((F.col("present") + (t - F.col("m")) * F.col("mu") * F.col("mu")) / t))
    )
    shift = F.col("mu") if center == "raw_mean" else F.lit(0.0)
    groups = groups.select(
        "grupo",
        "mu",
        F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0).alias("unit"),
        shift.alias("c"),
    )
    absent = -F.col("mu") / F.col("unit") - F.col("c")
    groups = groups.withColumn("absent2", absent * absent)
    constant = groups.agg(F.sum("absent2")).first()[0] or 0.0
    z = (F.col("n") - F.col("mu")) / F.col("unit") - F.col("c")
    distance2 = F.lit(constant) + F.sum(z * z - F.col("absent2"))
    distances = (
        join_small(counts, groups, "grupo")
        .groupBy("timestamp")
        .agg(F.sqrt(F.greatest(distance2, F.lit(0.0))).alias("distancia"))
    )
    return sigma_label(distances, "distancia", n)


def time_report(counts: DataFrame, groups: Sequence, n: float = 3.0, center: str = "zero") -> DataFrame:
    """`(timestamp, <a count for each group>, distancia, outliers)` from long counts; absent combinations are 0.

    Wide, so meant for a modest number of groups; `time_anomalies` is the same report without the counts.
    """
    wide = counts.groupBy("timestamp").pivot("grupo", list(groups)).agg(F.sum("n")).na.fill(0)
    return wide.join(time_anomalies(counts, n, center), "timestamp")


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Distinct combinations of outlier flags and responsible-field texts, with their sizes."""
    pattern = starting(df, "outliers_", "fieldsAnomaly_Nivel_")
    return df.groupBy(*pattern).agg(F.count(F.lit(1)).alias("n"))
