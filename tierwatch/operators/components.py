"""Principal components: variance explained per group of variables, and projections."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import stage
from tierwatch.operators.ordering import cumulative_cut
from tierwatch.operators.scaling import Scaler

_SHARES = "cluster int, pc int, share double, singular_value double"
# Columns of a tile, cells that a task adds up in one pass, and directions beyond those asked for.
TILE = 256
PASS_CELLS = 1 << 22
OVERSAMPLE = 8
MAX_PASSES = 60
TOLERANCE = 1e-10


def _matrix(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    out = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in columns], axis=1)
    if np.isnan(out).any():
        raise ValueError("missing values; fill them first")
    return out


def _summed(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One block for each key: the sum of what the tasks sent."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), "<f8") for b in table.column("block"))
        first = table.slice(0, 1).drop_columns(["block"])
        return first.append_column("block", pa.array([total.tobytes()], pa.binary()))

    return blocks.groupBy(*keys).applyInArrow(add, blocks.schema)


def gram_blocks(df: DataFrame, groups: Mapping[int, Sequence[str]]) -> DataFrame:
    """`(cluster, i, j, block)`: products of the column tiles i <= j of each group, added over all rows.

    Columns of different groups do not meet. A pass adds up at most `PASS_CELLS` cells in a task.
    """
    jobs = []
    for g in sorted(groups):
        tiles = -(-len(groups[g]) // TILE)
        jobs += [(g, i, j) for i in range(tiles) for j in range(i, tiles)]
    per_pass = max(PASS_CELLS // TILE**2, 1)
    tile = lambda g, i: list(groups[g][i * TILE : (i + 1) * TILE])

    def one_pass(some: list[tuple[int, int, int]]) -> DataFrame:
        names = sorted({c for g, i, j in some for c in (*tile(g, i), *tile(g, j))})
        at = {c: n for n, c in enumerate(names)}
        plain = [(g, i, j, [at[c] for c in tile(g, i)], [at[c] for c in tile(g, j)]) for g, i, j in some]

        def multiply(batches) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(a), len(b))) for *_, a, b in plain]
            for batch in batches:
                for block, (*_, a, b) in zip(total, plain):
                    block += _matrix(batch, a).T @ _matrix(batch, b)
            g, i, j = zip(*[p[:3] for p in plain])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int32()) for x in (g, i, j)], pa.array([b.tobytes() for b in total], pa.binary())],
                ["cluster", "i", "j", "block"],
            )

        held = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{n}") for n, c in enumerate(names)])
        return held.mapInArrow(multiply, "cluster int, i int, j int, block binary")

    passes = [one_pass(jobs[first : first + per_pass]) for first in range(0, len(jobs), per_pass)]
    return _summed(reduce(DataFrame.unionByName, passes), ["cluster", "i", "j"])


def variance_shares(df: DataFrame, groups: Mapping[int, Sequence[str]]) -> DataFrame:
    """`(cluster, pc, share, singular_value)` of the z-scored variables of each group.

    Correlations are added up by tiles of a group's columns; a group's matrix is put together and decomposed
    in a task of its own, and the driver sees none of it.
    """
    spark = df.sparkSession
    cols = list(dict.fromkeys(c for g in sorted(groups) for c in groups[g]))
    scaler = Scaler.fit(df, cols)
    inside = {g: [c for c in groups[g] if scaler.std[c]] for g in groups}
    inside = {g: own for g, own in inside.items() if own}
    if not inside:
        return spark.createDataFrame([], _SHARES)
    n = df.count()
    sizes = {int(g): (len(inside[g]), len(groups[g])) for g in inside}
    scaled = df.select(*[scaler.z(c).alias(c) for c in cols if scaler.std[c]])

    def spectrum(table: pa.Table) -> pa.Table:
        g = table.column("cluster")[0].as_py()
        varying, size = sizes[g]
        matrix = np.zeros((varying, varying))
        for i, j, block in zip(*(table.column(c).to_pylist() for c in ("i", "j", "block"))):
            rows, columns = slice(i * TILE, min((i + 1) * TILE, varying)), slice(j * TILE, min((j + 1) * TILE, varying))
            part = np.frombuffer(block, "<f8").reshape(rows.stop - rows.start, -1) / n
            matrix[rows, columns], matrix[columns, rows] = part, part.T
        values = np.linalg.eigvalsh((matrix + matrix.T) / 2)[::-1].clip(min=0.0)
        values = np.concatenate([values, np.zeros(size - varying)])
        return pa.table(
            [pa.array([g] * size, pa.int32()), pa.array(range(1, size + 1), pa.int32()), values / values.sum(), np.sqrt(n * values)],
            ["cluster", "pc", "share", "singular_value"],
        )

    return gram_blocks(scaled, inside).groupBy("cluster").applyInArrow(spectrum, _SHARES)


def pca_variance(df: DataFrame, groups: Mapping[int, Sequence[str]], threshold: float = 0.99999999) -> DataFrame:
    """Cumulative explained variance: `(Component, Variance, cluster, singular_value)`."""
    shares = variance_shares(df, groups)
    cut = cumulative_cut(shares, "cluster", "pc", "share", threshold)
    return cut.select(
        F.concat(F.lit("PC"), F.col("pc").cast("string")).alias("Component"), "Variance", "cluster", "singular_value"
    )


def vector_columns(df: DataFrame, col: str, size: int, prefix: str) -> DataFrame:
    """Spread a vector or array column over columns `<prefix>0 .. <prefix><size-1>`."""
    array = F.col(quoted(col)) if df.schema[col].dataType.typeName() == "array" else vector_to_array(col)
    held = df.withColumn("__array", array)
    return held.select(*df.columns, *[F.get("__array", F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]).drop(col)


def principal_directions(df: DataFrame, cols: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of the sample covariance of `cols`, and their directions as columns.

    A range finder: a thin matrix of k + `OVERSAMPLE` directions is multiplied by the covariance in passes over
    the rows, without the covariance itself, until the leading directions no longer turn. The largest
    weight of a direction is positive.
    """
    spark = df.sparkSession
    held = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = held.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in held.columns]).first()
    n, width = means["n"], min(len(cols), k + OVERSAMPLE)
    mean = np.array([means[c] if means[c] is not None else 0.0 for c in held.columns])
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(len(cols), width)))[0]
    for _ in range(MAX_PASSES):
        shared = spark.sparkContext.broadcast((mean, basis))

        def multiply(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            mean, basis = shared.value
            total = np.zeros(basis.shape)
            for batch in batches:
                x = _matrix(batch, range(len(mean))) - mean
                total += x.T @ (x @ basis)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "block"])

        sent = _summed(held.mapInArrow(multiply, "part int, block binary"), ["part"]).first()
        image = np.frombuffer(sent["block"], "<f8").reshape(basis.shape) / max(n - 1, 1)  # columns times width
        values, turn = np.linalg.eigh(basis.T @ image)
        order = np.argsort(values)[::-1][:k]
        values, directions = values[order], basis @ turn[:, order]
        apart = np.linalg.norm(image @ turn[:, order] - directions * values, axis=0)
        if (apart <= TOLERANCE * max(float(np.abs(values).max(initial=0.0)), 1e-300)).all() or width == len(cols):
            break
        basis = np.linalg.qr(image)[0]
    signs = np.sign(directions[np.abs(np.round(directions, 12)).argmax(axis=0), range(directions.shape[1])])
    return values, directions * np.where(signs == 0, 1.0, signs)


def pca_project(df: DataFrame, cols: Sequence[str], k: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Scores on the first k components as columns `pca_0 ..`; values are not centered first."""
    data = stage(df.select(*[quoted(c) for c in dict.fromkeys([*keep, *cols])]), "components", codec="zstd")
    _, directions = principal_directions(data, cols, k)
    shared = df.sparkSession.sparkContext.broadcast(directions)
    rows = data.select(
        F.struct(*[quoted(c) for c in keep] or [F.lit(1).alias("none")]).alias("kept"),
        *[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
    )
    k = directions.shape[1]

    def project(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _matrix(batch, range(1, len(shared.value) + 1)) @ shared.value
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(scores[:, i])) for i in range(k)]],
                ["kept", *[f"pca_{i}" for i in range(k)]],
            )

    shape = f"kept {rows.schema['kept'].dataType.simpleString()}" + "".join(f", pca_{i} double" for i in range(k))
    names = [F.col("kept").getField(c).alias(c) for c in keep]
    return rows.mapInArrow(project, shape).select(*names, *[f"pca_{i}" for i in range(k)])
