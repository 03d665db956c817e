"""A quality classifier on document statistics.

Statistics of each whole text are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Every partition adds up its share of the normal equations, per fold;
their sum gives a ridge regression of the labels. Scores of the rows of each fold by the equations of
the other folds, which are the total minus the fold's own, calibrate it by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.llm import texts
from tierwatch.llm.folds import held_out
from tierwatch.llm.rows import map_rows

FEATURES = 256
RIDGE = 1e-3
FOLDS = 4
BINS = 2048
SEED = 20

STATISTICS = (
    "log_bytes", "lower", "upper", "digit", "blank", "line_feed", "full_stop", "comma", "mark", "other_sign",
    "high", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "repeated_next",
    "distinct_pairs", "signed_ends", "capital_starts", "upper_words", "words_a_line", "signs_alone", "log_words",
)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 8, np.uint8)  # other signs
    kinds[97:123], kinds[65:91], kinds[48:58] = 0, 1, 2
    kinds[[9, 11, 12, 13, 32]], kinds[10] = 3, 4
    kinds[ord(".")], kinds[ord(",")] = 5, 6
    kinds[[ord("!"), ord("?")]] = 7
    kinds[128:] = 9
    return kinds


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `STATISTICS` per document; all but the logarithms are 0 for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _byte_kinds()[data]
    shares = np.bincount(owner * 10 + kind, minlength=10 * n).reshape(n, 10) / np.maximum(size, 1)[:, None]
    lines = np.bincount(owner[data == 10], minlength=n) + 1.0
    starts, ends, of = texts.word_spans(data, offsets)
    words = np.bincount(of, minlength=n).astype(float)
    safe = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(of, length, n) / safe
    spread = np.sqrt(np.maximum(np.bincount(of, length * length, n) / safe - mean * mean, 0))
    longest, distinct, top, pairs, again = (np.zeros(n) for _ in range(5))
    upper_words, alone, signed, capital = (np.zeros(n) for _ in range(4))
    if len(starts):
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        longest[of[heads]] = np.maximum.reduceat(length, heads)
        hashes = texts.span_hashes(data, starts, ends)
        high = of.astype(np.uint64) << np.uint64(40)
        key, times = np.unique(high | hashes >> np.uint64(24), return_counts=True)
        docs = (key >> np.uint64(40)).astype(np.int64)
        distinct += np.bincount(docs, minlength=n)
        np.maximum.at(top, docs, times)
        same = of[1:] == of[:-1]
        again += np.bincount(of[1:][same & (hashes[1:] == hashes[:-1])], minlength=n)
        both = texts.mix(hashes[:-1] + texts.mix(hashes[1:]))[same]
        key, _ = np.unique(high[1:][same] | both >> np.uint64(24), return_counts=True)
        pairs += np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
        letter = np.concatenate([[0], np.cumsum((kind <= 1) | (kind == 9))])
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        lower = np.concatenate([[0], np.cumsum(kind == 0)])
        has = letter[ends] - letter[starts]
        upper_words += np.bincount(of[(upper[ends] > upper[starts]) & (lower[ends] == lower[starts])], minlength=n)
        alone += np.bincount(of[has == 0], minlength=n)
        signed += np.bincount(of[kind[ends - 1] == 8], minlength=n)
        capital += np.bincount(of[kind[starts] == 1], minlength=n)
    columns = [
        np.log1p(size), *shares.T, mean, spread, np.log1p(longest), distinct / safe, top / safe, again / safe,
        pairs / safe, signed / safe, capital / safe, upper_words / safe, np.log1p(words / lines), alone / safe,
        np.log1p(words),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs; without labels to learn from, every score is 0.5."""

    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = fourier(x, self.center, self.scale) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fourier(x: np.ndarray, center: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    random = np.random.default_rng(SEED)
    width = x.shape[1]
    frequency = random.normal(0.0, 1.0 / np.sqrt(width), (width, features))
    phase = random.uniform(0.0, 2.0 * np.pi, features)
    clean = np.clip((x - center) / scale, -6.0, 6.0)
    waves = np.sqrt(2.0 / features) * np.cos(clean @ frequency + phase)
    return np.concatenate([waves, np.ones((len(x), 1))], axis=1)


def isotonic(center: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means in rising order by pooling neighbours that violate it; knots at the pools' centers."""
    pools: list[list[float]] = []
    for c, m, w in zip(center.tolist(), mean.tolist(), weight.tolist()):
        pools.append([c * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    rows = np.array(pools)
    return rows[:, 0] / rows[:, 2], rows[:, 1] / rows[:, 2]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each whole text; a null text is empty."""

    def measure(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in texts.slices(batch.column(1)):
                x = statistics(data, offsets)
                cuts = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                rows = pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))
                ids = batch.column(0).slice(first, end - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, rows], ["doc_id", "x"])

    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return whole.mapInArrow(measure, "doc_id long, x array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `values` added up per key, in two steps so that no task gets more than a share of the parts."""

    def add(key, rows):
        values = rows.column("values").combine_chunks()
        total = _rows(values).sum(axis=0)
        names = [*by, "values"]
        return pa.table([*(rows.column(c).slice(0, 1) for c in by), pa.array([total.tolist()])], names)

    schema = "".join(f"{c} int, " for c in by) + "values array<double>"
    for keys in ([*by, "part"], by):
        parts = parts.groupBy(*keys).applyInArrow(add, schema)
    return parts


def fit(features: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from the rows of `features` (doc_id, x) whose doc_id has a label.

    Only rows that may be learned from are passed. Labels of a repeated doc_id are averaged, null
    labels are ignored. All labelled rows are used.
    """
    target = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    train = features.join(target, "doc_id").select(
        "x", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    )
    train = stage(train, "training", spread=True)
    width = len(STATISTICS)
    moments = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)],
    ).first()
    if not moments["n"]:
        return QualityModel()
    center = np.array([moments[f"m{i}"] for i in range(width)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(width)])

    def equations(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _rows(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = np.concatenate([fourier(x, center, scale), y[:, None]], axis=1)
            for f in np.unique(fold).tolist():
                own = z[fold == f]
                sums[f] = sums.get(f, 0) + own[:, :-1].T @ own
        part = TaskContext.get().partitionId() % 64
        for f, total in sums.items():
            n = len(total)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (n + 1), pa.int32()), pa.array(total.ravel()))
            ints = lambda v: pa.array(np.asarray(v, np.int32))
            yield pa.RecordBatch.from_arrays(
                [ints([f] * n), ints(range(n)), ints([part] * n), cells], ["fold", "line", "part", "values"]
            )

    parts = train.mapInArrow(equations, "fold int, line int, part int, values array<double>")
    n = FEATURES + 1
    total = np.zeros((FOLDS, n, n + 1))
    for row in _summed(parts, ["fold", "line"]).collect():  # FOLDS * (FEATURES + 1) rows at any size
        total[row["fold"], row["line"]] = row["values"]

    def solved(equations: np.ndarray) -> np.ndarray:
        weight = max(equations[-1, n - 1], 1.0)
        penalty = np.full(n, RIDGE * weight)
        penalty[-1] = 1e-9 * weight
        return np.linalg.solve(equations[:, :n] + np.diag(penalty), equations[:, n])

    everything = total.sum(axis=0)
    others = [solved(everything - own) if (everything - own)[-1, n - 1] > 0 else solved(everything) for own in total]

    def out_of_fold(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, fold = fourier(_rows(batch.column(0)), center, scale), batch.column(2).to_numpy()
            raw = np.einsum("ij,ij->i", z, np.stack(others)[fold])
            cell = np.clip(((raw + 0.5) / 2.0 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(raw), batch.column(1)], ["cell", "raw", "y"])

    cells = train.mapInArrow(out_of_fold, "cell int, raw double, y double").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")
    )
    table = sorted((r["cell"], r["raw"], r["y"], r["n"]) for r in cells.collect())  # at most BINS rows
    _, raw, y, times = (np.array(c, float) for c in zip(*table))
    knots, values = isotonic(raw, y, times)
    return QualityModel(center, scale, solved(everything), knots, values)


def scored(features: DataFrame, model: QualityModel) -> DataFrame:
    """`features` (doc_id, x) as (doc_id, score)."""

    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_rows(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones. A null doc_id counts as held out and has no label. Repeated
    ids are scored row by row. Other columns are ignored. Without any label, scores are 0.5; an empty
    table gives an empty result.
    """
    features = stage(measured(docs), "statistics", codec="zstd")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(features.where(~out), labels)
    return scored(features, model).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject."""
    model = fit(measured(docs.where(~held_out(F.col("doc_id"), 3, 1))), labels)
    at = docs.columns.index("text")

    def keep(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [
                model.scores(statistics(data, offsets)) >= 0.5
                for _, _, data, offsets in texts.slices(batch.column(at))
            ]
            yield batch.filter(pa.array(np.concatenate(mask))) if mask else batch

    return map_rows(docs, keep)
