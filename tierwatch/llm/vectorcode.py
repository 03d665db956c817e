"""Codes for vectors: each part of a vector is named by the nearest entry of its part's codebook.

Nearest entries are found by Orchard's search. Every entry has the list of all entries sorted by their
distance from it. A search starts at some entry and walks down its list; when an entry is nearer to the
part, the search goes on in that entry's list. Entries once measured are marked, and a list is left as
soon as its next entry lies beyond twice the current distance: by the triangle inequality no entry from
there on can be as near. All numbers are whole and all distances squared, so that ties are exact.

All parts of a batch walk side by side, one step of each search at a time. A codebook is bounded by
`entries` and the width of a part; it is all that is broadcast, and the sums of each entry are all that
comes back from a round. Nothing is staged but the codes: a round reads the vectors and keeps nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.shared import join_small, stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
BATCH_ROWS = 16_384


def whole_bound(width: int) -> int:
    """The power of two that components are held within, so that any sum of squares fits 64 bits."""
    return 1 << ((60 - max(width, 1).bit_length()) // 2)


def whole_vectors(column: pa.Array, width: int, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) of each component as one row a vector, filled up with zeros to `width`.

    Components beyond `whole_bound` are held there.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = float(whole_bound(width))
    out = np.zeros((len(lengths), width), np.int64)
    with np.errstate(over="ignore"):
        out[np.arange(width) < lengths[:, None]] = np.clip(np.floor(values * scale), -bound, bound).astype(np.int64)
    return out


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of a codebook (entries, width): all entries by distance from it, itself first,
    and those squared distances."""
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    first = np.where(np.eye(len(book), dtype=bool), -1, gaps)
    order = np.argsort(first, axis=1, kind="stable").astype(np.int64)
    return order, np.take_along_axis(gaps, order, axis=1)


def orchard(parts: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of `book` for each row of `parts`, the lower index among equals, and its
    squared distance."""
    order, gaps = lists
    n, k = len(parts), len(book)
    # Any entry may start a search; the one next to the part in the first component is rarely far.
    if book.shape[1]:
        by_first = np.argsort(book[:, 0], kind="stable")
        at = by_first[np.minimum(np.searchsorted(book[by_first, 0], parts[:, 0]), k - 1)]
    else:
        at = np.zeros(n, np.int64)
    near = ((parts - book[at]) ** 2).sum(axis=1)
    marks = np.zeros((n, k), bool)
    marks[np.arange(n), at] = True
    place = np.ones(n, np.int64)
    open_ = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(open_):
        here, step = at[open_], place[open_]
        within = gaps[here, step] <= 4 * near[open_]
        open_, here, step = open_[within], here[within], step[within]
        other = order[here, step]
        new = ~marks[open_, other]
        marks[open_, other] = True
        who, entry = open_[new], other[new]
        far = ((parts[who] - book[entry]) ** 2).sum(axis=1)
        better = (far < near[who]) | ((far == near[who]) & (entry < at[who]))
        place[open_] += 1
        jump = who[better]
        at[jump], near[jump], place[jump] = entry[better], far[better], 1
        open_ = open_[place[open_] < k]
    return at, near


def assigned(vectors: np.ndarray, books: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows, parts) and squared distances of the parts of `vectors` under `books` (parts, entries, width)."""
    width = books.shape[2]
    found = [orchard(vectors[:, p * width : (p + 1) * width], book, lists[p]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x, label) of the rows whose vector is not null and holds only finite components."""
    x = F.col(column)
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"), F.col("label").alias("label")
    )


def start(rows: DataFrame, width: int, parts: int, entries: int, scale: float) -> np.ndarray:
    """Books (parts, entries, width of a part) of the rows with the smallest ids; null ids come last, equal
    ids go by their vectors."""
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").toArrow()
    vectors = whole_vectors(least.column("x"), width, scale)
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2))


def moved(rows: DataFrame, books: np.ndarray, scale: float) -> np.ndarray:
    """`books` with every entry at the componentwise floor of its parts' mean; unused entries stay.

    A task sends one row for each entry it has met: the count and the sums.
    """
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, [neighbour_lists(b) for b in books]))

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        count = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                vectors = whole_vectors(batch.column(0).slice(first, BATCH_ROWS), parts * width, scale)
                at, _ = assigned(vectors, *shared.value)
                slot = (at + np.arange(parts) * entries).ravel()
                count += np.bincount(slot, minlength=len(count))
                np.add.at(total, slot, vectors.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(count[used]),
                pa.array(total[used].tolist(), pa.list_(pa.int64())),
            ],
            ["slot", "n", "sums"],
        )

    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = rows.select("x").mapInArrow(add_up, "slot int, n long, sums array<long>")
    out = books.copy().reshape(-1, width)
    for row in found.groupBy("slot").agg(F.sum("n").alias("n"), *sums).collect():  # at most parts * entries rows
        out[row["slot"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


CODES = "vec_id long, code string, error long, label {label}"


def coded(rows: DataFrame, books: np.ndarray, scale: float) -> DataFrame:
    """(vec_id, code, error, label) of every row of `rows`: two hex digits a part, and the squared distance."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, [neighbour_lists(b) for b in books]))
    digits = 2 if entries <= 256 else 4

    def name(batches) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:0{digits}x}" for i in range(entries)])
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(first, BATCH_ROWS)
                at, far = assigned(whole_vectors(some.column(1), parts * width, scale), *shared.value)
                codes = np.ascontiguousarray(hexes[at]).view(f"U{digits * parts}").ravel()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(codes.tolist(), pa.string()), pa.array(far.sum(axis=1)), some.column(2)],
                    ["vec_id", "code", "error", "label"],
                )

    return rows.select("vec_id", "x", "label").mapInArrow(name, CODES.format(label=rows.schema["label"].dataType.simpleString()))


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    column: str = "embedding",
) -> DataFrame:
    """The codes of all sound rows of `vectors`: vec_id, code, error, label_error, codebooks_sha256.

    A component x counts as floor(scale * x), held within `whole_bound`. Rows whose vector is null or holds
    a null, NaN or infinite component are left out. Vectors are cut into `parts` equal parts; those
    that are shorter than the longest, or than a multiple of `parts`, are filled up with zeros, to one component
    a part at least. Codebooks
    start at the rows with the `entries` smallest ids (null ids last, equal ids by their vectors) and are
    moved `rounds` times. Rows that repeat an id, or lack one, are coded each. label_error is the sum of the
    errors of all rows with the same label, nulls together; null if it is beyond 64 bits. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = sound(vectors, column)
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    width = max(-(-(longest or 0) // parts), 1)
    books = start(rows, width * parts, parts, entries, scale)
    if not books.shape[1]:
        none = {"vec_id": "long", "code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return vectors.limit(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    for _ in range(rounds):
        books = moved(rows, books, scale)
    codes = stage(coded(rows, books, scale), "vector-codes", codec="zstd")
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "same_label")
    # Labels may be many: a measured broadcast, or a join that Spark splits where one label is hot.
    both = join_small(codes, sums, F.expr("label <=> same_label"))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
