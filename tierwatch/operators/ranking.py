"""Which variables say most about a label.

All entropies come from value counts: with f(n) = n log2 n, the entropy of a column over
N rows is log2 N - sum f(n_v) / N. Counts are partially aggregated before each shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import stage
from tierwatch.operators.boosting import MAX_BINS, fit_booster
from tierwatch.operators.cleaning import distinct_values
from tierwatch.operators.counting import joint_counts, value_counts
from tierwatch.operators.cutting import cut_columns, supervised_cuts
from tierwatch.operators.ordering import exact_quantiles

# Label values that fit as separate counters into one aggregation row.
MAX_COUNTERS = 64


def _nlogn(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


SUPERVISED = "supervised"


def discretize(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Replace continuous columns by bin numbers at quantiles of their values; missing values stay missing."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    if not shares:
        return cut_columns(df, {c: [] for c in cols})
    found: dict[str, set[float]] = {c: set() for c in cols}
    for r in exact_quantiles(df, cols, shares).collect():  # bins - 1 rows a column
        found[r["variable"]].add(r["value"])
    return cut_columns(df, {c: sorted(v) for c, v in found.items()})


def _binned(df: DataFrame, label: str, cols: Sequence[str], bins: int | str | None) -> DataFrame:
    """`df` with `cols` in bins: a number of quantiles, the cuts that say most about the label, or as they are."""
    if bins == SUPERVISED:
        return cut_columns(df, supervised_cuts(df, label, cols))
    return discretize(df, cols, bins) if bins else df


def _named(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return df.withColumn("variable", F.get(names, F.col("v"))).drop("v")


def _su(hx: Column, hy: Column, hxy: Column) -> Column:
    total = hx + hy
    su = 2.0 * (total - hxy) / total
    return F.when(total > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), su))).otherwise(F.lit(0.0))


def symmetrical_uncertainty(
    df: DataFrame, label: str, cols: Sequence[str], delta: float | None = 0.0, bins: int | str | None = None
) -> DataFrame:
    """`(variable, su)` of each variable against a discrete label, keeping su > delta.

    Every distinct value is a symbol, so near-unique columns score high; `bins` groups values first: a number
    of quantile bins, or "supervised" for the cuts that say most about the label. `delta=None` keeps all
    variables.
    """
    df = _binned(df, label, cols, bins)
    seen = df.select(quoted(label)).distinct().limit(MAX_COUNTERS + 1).collect()
    if len(seen) <= MAX_COUNTERS:
        scores = _su_few_labels(df, label, cols, [r[0] for r in seen])
    else:
        scores = _su_many_labels(df, label, cols)
    return scores if delta is None else scores.filter(F.col("su") > delta)


def _su_few_labels(df: DataFrame, label: str, cols: Sequence[str], labels: Sequence) -> DataFrame:
    counts = value_counts(df, label, cols, labels)
    per_label = [F.col(f"n{j}") for j in range(len(labels))]
    n_value = sum(per_label[1:], per_label[0])
    sums = counts.groupBy("v").agg(
        F.sum(_nlogn(n_value)).alias("fx"),
        F.sum(sum([_nlogn(n) for n in per_label], F.lit(0.0))).alias("fxy"),
        *[F.sum(n).alias(f"n{j}") for j, n in enumerate(per_label)],
    )
    total = sum(per_label[1:], per_label[0])
    fy = sum([_nlogn(n) for n in per_label], F.lit(0.0))
    log_n = F.log2(total)
    scored = sums.select(
        "v",
        _su(log_n - F.col("fx") / total, log_n - fy / total, log_n - F.col("fxy") / total).alias("su"),
    )
    return _named(scored, cols).select("variable", "su")


def _su_many_labels(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    marginals = entropies(df, [(c,) for c in [*cols, label]])
    joints = entropies(df, [(c, label) for c in cols])
    hy = marginals[(label,)]
    rows = [(c, _su_value(marginals[(c,)], hy, joints[(c, label)])) for c in cols]
    return df.sparkSession.createDataFrame(rows, "variable string, su double")


def _su_value(hx: float, hy: float, hxy: float) -> float:
    total = hx + hy
    return 0.0 if total <= 1e-12 else min(1.0, max(0.0, 2.0 * (total - hxy) / total))


def entropies(df: DataFrame, groups: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    """Entropy in bits of single columns and column pairs; one shuffle for all of them."""
    counted = joint_counts(df, groups)
    sums = counted.groupBy("g").agg(F.sum("n").alias("total"), F.sum(_nlogn(F.col("n"))).alias("f")).collect()
    return {groups[r["g"]]: math.log2(r["total"]) - r["f"] / r["total"] for r in sums}


def pairwise_su(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(variable, other, su)` for every unordered pair of columns."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    h = entropies(df, [*[(c,) for c in cols], *pairs])
    rows = [(a, b, _su_value(h[(a,)], h[(b,)], h[(a, b)])) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "variable string, other string, su double")


def su_importance(df: DataFrame, label: str, cols: Sequence[str], bins: int | str | None = None) -> DataFrame:
    """`(variable, valor, importance_norm)`: uncertainty and its share of the largest one."""
    scores = symmetrical_uncertainty(df, label, cols, bins=bins).withColumnRenamed("su", "valor")
    return scores.withColumn("importance_norm", F.col("valor") / F.max("valor").over(Window.partitionBy()))


def fcbf(
    df: DataFrame, label: str, cols: Sequence[str], delta: float = 0.0, bins: int | str | None = None
) -> DataFrame:
    """Fast correlation-based filter: `(rank, variable, su, importance_norm)`.

    Takes the variable with the highest uncertainty and drops those it predicts at least
    as well as they predict the label. Each round counts only the pairs it needs.
    """
    df = _binned(df, label, cols, bins)
    df = stage(df.select(quoted(label), *[quoted(c) for c in cols]), "fcbf", codec="zstd")
    marginal = entropies(df, [(c,) for c in cols])
    scores = {r["variable"]: r["su"] for r in symmetrical_uncertainty(df, label, cols, delta).collect()}
    # Rounded, so that ties do not hang on the order in which counts were added up.
    scores = {c: round(su, 12) for c, su in scores.items()}
    waiting = sorted(scores, key=lambda c: (-scores[c], c))
    chosen: list[str] = []
    while waiting:
        lead, *rest = waiting
        chosen.append(lead)
        if not rest:
            break
        joint = entropies(df, [(lead, c) for c in rest])
        waiting = [
            c
            for c in rest
            if round(_su_value(marginal[(lead,)], marginal[(c,)], joint[(lead, c)]), 12) < scores[c]
        ]
    top = scores[chosen[0]] if chosen else 1.0
    rows = [(i + 1, c, scores[c], scores[c] / top) for i, c in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, "rank int, variable string, su double, importance_norm double")


def cluster_weights(
    df: DataFrame, label: str, cols: Sequence[str], labels: Sequence | None = None, bins: int | str | None = None
) -> DataFrame:
    """Weight matrix: `variable, peso_<c>...`.

    `peso_<c>` is the uncertainty against "row is in cluster c", over that cluster's
    largest one. The count for "not in c" is the total minus the count for c, so one
    table of counts serves all clusters.
    """
    df = _binned(df, label, cols, bins)
    found = distinct_values(df, label) if labels is None else list(labels)
    parts = [
        _weights_for(df, label, cols, found[i : i + MAX_COUNTERS]) for i in range(0, len(found), MAX_COUNTERS)
    ]
    return reduce(lambda a, b: a.join(b, "variable"), parts)


def _weights_for(df: DataFrame, label: str, cols: Sequence[str], labels: Sequence) -> DataFrame:
    counts = value_counts(df, label, cols, labels)
    n = [F.col(f"n{j}") for j in range(len(labels))]
    total = F.col("total")
    sums = counts.groupBy("v").agg(
        F.sum(_nlogn(total)).alias("fx"),
        F.sum("total").alias("total"),
        *[F.sum(_nlogn(nj) + _nlogn(total - nj)).alias(f"f{j}") for j, nj in enumerate(n)],
        *[F.sum(nj).alias(f"n{j}") for j, nj in enumerate(n)],
    )
    log_n = F.log2(total)
    hx = log_n - F.col("fx") / total
    scored = sums.select(
        "v",
        *[
            _su(
                hx,
                log_n - (_nlogn(nj) + _nlogn(total - nj)) / total,
                log_n - F.col(f"f{j}") / total,
            ).alias(f"su{j}")
            for j, nj in enumerate(n)
        ],
    )
    everything = Window.partitionBy()
    weights = [
        F.coalesce(F.try_divide(F.col(f"su{j}"), F.max(f"su{j}").over(everything)), F.lit(0.0)).alias(f"peso_{y}")
        for j, y in enumerate(labels)
    ]
    return _named(scored, cols).select("variable", *weights)


def _importance_table(df: DataFrame, cols: Sequence[str], values: Sequence[float], floor: float) -> DataFrame:
    kept = [(c, float(v)) for c, v in zip(cols, values, strict=True) if v > floor]
    top = max((v for _, v in kept), default=1.0)
    rows = sorted(((c, v, v / top) for c, v in kept), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "variable string, valor double, importance_norm double")


def _vectors(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features")
    labelled = df.select(F.col(quoted(label)).alias("y"), *[quoted(c) for c in cols])
    return assembler.transform(labelled).select("y", "features")


def gbt_importance(
    df: DataFrame,
    label: str,
    cols: Sequence[str],
    max_iter: int = 100,
    max_depth: int = 3,
    floor: float = 1e-4,
    rate: float = 0.1,
    bins: int = MAX_BINS,
) -> DataFrame:
    """Boosted-tree importance of each variable for a cluster label, after `max_iter` rounds.

    One softmax booster over all clusters: a variable's importance is its share of what all cuts take off
    the squared residuals. Values are cut at `bins` places at most.
    """
    model = fit_booster(df, label, cols, max_iter, max_depth, rate, bins)
    return _importance_table(df, cols, model.importances(), floor)


def rf_importance(
    df: DataFrame,
    label: str,
    cols: Sequence[str],
    trees: int = 10,
    depth: int = 10,
    seed: int = 42,
    floor: float = 1e-4,
) -> DataFrame:
    """Random-forest importance: all clusters in one fit, so far fewer passes than boosting."""
    labels = distinct_values(df, label)
    index = F.create_map(*[F.lit(x) for i, y in enumerate(labels) for x in (y, float(i))])
    data = _vectors(df, label, cols).withColumn("target", F.element_at(index, F.col("y")))
    model = RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    return _importance_table(df, cols, model.featureImportances.toArray(), floor)


def discriminating_variables(
    weights: DataFrame, groups: DataFrame, max_vars: int, group: str = "cluster"
) -> DataFrame:
    """Per variable group, the variables whose weights differ most between clusters.

    A group whose weights do not vary at all keeps its first variable.
    """
    profiles = [c for c in weights.columns if c.startswith("peso_")]
    mean = sum([F.col(c) for c in profiles[1:]], F.col(profiles[0])) / len(profiles)
    spread = sum([(F.col(c) - mean) * (F.col(c) - mean) for c in profiles], F.lit(0.0)) / len(profiles)
    order = Window.partitionBy(group).orderBy(F.desc(F.round("spread", 12)), "variable")
    return (
        weights.withColumn("spread", spread)
        .join(groups.select("variable", group), "variable")
        .withColumn("pos", F.row_number().over(order))
        .filter(((F.col("pos") <= max_vars) & (F.col("spread") > 1e-12)) | (F.col("pos") == 1))
        .select("variable", group, "spread", "pos")
    )
