"""Joint value counts of many columns, added up before anything is shuffled.

Rows are taken a block at a time. A column of a block becomes codes into its own few values, and the
joint counts of two columns are one pass over their codes. So a record is never written out once per
variable or per pair of variables: what leaves a task is one row per block and distinct value, or pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.names import quoted

BLOCK_ROWS = 1 << 18
SEND_ROWS = 50_000

# Types whose values a double holds exactly.
_EXACT = {"double", "float", "integer", "short", "byte"}


def symbol_kind(df: DataFrame, names: Sequence[str]) -> str:
    """The common type of symbols: double if that keeps all values apart, else string."""
    return "double" if {df.schema[c].dataType.typeName() for c in names} <= _EXACT else "string"


def symbols(df: DataFrame, cols: Sequence[str], kind: str | None = None) -> dict[str, Column]:
    """Columns as comparable symbols. Values that differ stay apart, and 0.0 equals -0.0."""
    out = {}
    for c in cols:
        column = F.col(quoted(c))
        if df.schema[c].dataType.typeName() in ("double", "float"):
            column = column.cast("double") + F.lit(0.0)
        out[c] = column.cast(kind or symbol_kind(df, cols))
    return out


def _blocks(batches) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column and its values; null is a value."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pairs(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and counts of the pairs that occur."""
    joint = a * n_b + b
    if n_a * n_b <= 4 * len(a) + 1024:
        counts = np.bincount(joint, minlength=n_a * n_b)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(joint, return_counts=True)
    return found // n_b, found % n_b, counts


def _sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, SEND_ROWS):
        yield batch.slice(first, SEND_ROWS)


def joint_counts(df: DataFrame, groups: Sequence[tuple[str, ...]]) -> DataFrame:
    """(g, a, b, n): how often each value, or pair of values, of the columns in `groups[g]` occurs.

    Groups are of one or two columns; b is null for one. Null is a value like any other.
    """
    names = sorted({c for g in groups for c in g})
    kind = symbol_kind(df, names)
    own = symbols(df, names, kind)
    at = {c: i for i, c in enumerate(names)}
    wanted = [tuple(at[c] for c in g) for g in groups]
    arrow = pa.float64() if kind == "double" else pa.string()

    def count(batches) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            coded = [_coded(table.column(i)) for i in range(len(names))]
            for g, members in enumerate(wanted):
                a, a_values = coded[members[0]]
                if len(members) == 1:
                    n = np.bincount(a, minlength=len(a_values))
                    left, right = a_values, pa.nulls(len(a_values), arrow)
                else:
                    b, b_values = coded[members[1]]
                    i, j, n = _pairs(a, len(a_values), b, len(b_values))
                    left, right = a_values.take(pa.array(i)), b_values.take(pa.array(j))
                yield from _sent(
                    pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), g, np.int32)), left.cast(arrow), right.cast(arrow), pa.array(n)],
                        ["g", "a", "b", "n"],
                    )
                )

    plain = df.select(*[own[c].alias(f"c{i}") for i, c in enumerate(names)])
    sent = plain.mapInArrow(count, f"g int, a {kind}, b {kind}, n long")
    return sent.groupBy("g", "a", "b").agg(F.sum("n").alias("n"))


def value_counts(df: DataFrame, label: str, cols: Sequence[str], labels: Sequence) -> DataFrame:
    """One row per (v: index in `cols`, value): `total`, and counters `n0`, `n1` ... of the values in `labels`.

    A label that is not in `labels` counts in the total alone.
    """
    kind = symbol_kind(df, cols)
    own = symbols(df, cols, kind)
    mark = F.lit(len(labels))
    for j, y in reversed(list(enumerate(labels))):
        mark = F.when(F.col(quoted(label)).eqNullSafe(F.lit(y)), F.lit(j)).otherwise(mark)
    arrow = pa.float64() if kind == "double" else pa.string()
    counters = [f"n{j}" for j in range(len(labels))]

    def count(batches) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            y = table.column(0).to_numpy().astype(np.int64)
            for v in range(len(cols)):
                code, values = _coded(table.column(v + 1))
                width = len(labels) + 1
                joint = np.bincount(code * width + y, minlength=len(values) * width).reshape(-1, width)
                columns = [joint.sum(axis=1), *joint.T[: len(labels)]]
                yield from _sent(
                    pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), v, np.int32)), values.cast(arrow), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
                        ["v", "value", "total", *counters],
                    )
                )

    plain = df.select(mark.cast("int").alias("y"), *[own[c].alias(f"c{i}") for i, c in enumerate(cols)])
    schema = f"v int, value {kind}, total long" + "".join(f", {c} long" for c in counters)
    sent = plain.mapInArrow(count, schema)
    return sent.groupBy("v", "value").agg(*[F.sum(c).alias(c) for c in ("total", *counters)])
