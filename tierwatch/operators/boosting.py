"""Boosted trees for any number of classes, fitted on histograms.

Values are replaced once by the numbers of the ranges they lie in, and the rows are packed into blocks, one
row of the staged table each. Every round grows one tree a class. A level of all trees takes one pass: a
task adds up, for every class, node, variable and range, the count, the residuals and the curvatures of
its rows; the sums are shuffled by (class, node, variable) and the best cut of each comes back. So the
number of passes is rounds times depth, whatever the number of classes or rows, and what the driver sees
is one row for each class, node and variable.

Residuals are rounded to whole multiples of 2 ** -28, so that the sums, and with them the trees, do not
depend on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwatch.functions.names import quoted
from tierwatch.functions.shared import delete_path, scratch_path
from tierwatch.operators.cleaning import distinct_values

MAX_BINS = 255
# A block, which is one staged row, has at most so many rows and bytes. A reader or an Arrow batch holds a few
# blocks and no more, a row group of a file some.
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 832 << 10
BATCH_BLOCKS = 4
GROUP_BYTES = 16 << 20
UNIT = float(1 << 28)
LEAST_GAIN = 1e-6  # in squared units: less is rounding
# After so many rounds the scores are written, so that a pass replays a bounded number of trees.
WRITE_ROUNDS = 8
# Rows that a task works on at once: few enough for the caches, and for a count and a sum of residuals to be
# held exactly by one double, the count in units of CURVATURES (CHUNK_ROWS * UNIT is less than half of that).
CHUNK_ROWS = 4000
CURVATURES = 1 << 41
# Scores are advanced for so many times as many rows at once, and so many variables are counted at once.
STRETCH = 4
COUNTED = 16
CODE_BITS = 12  # places in so many levels of a class's trees are looked up at once

BLOCKS = "n long, labels binary, cells binary, scores binary"


@dataclass
class Tree:
    """A complete binary tree: the variable (-1 in a leaf) and last range of the left side of each inner
    node, and the value of each node that is a leaf."""

    variable: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(np.full(inner, -1, np.int64), np.zeros(inner, np.int64), np.zeros(2 * inner + 1))

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tree as it is sent to tasks, which know none of this module's classes."""
        return self.variable, self.cut, self.value


def _plain(rounds: list[list[Tree]]) -> list[list[tuple]]:
    return [[tree.plain() for tree in trees] for trees in rounds]


def _all_places(variable: np.ndarray, cut: np.ndarray, cells: np.ndarray, levels: int) -> np.ndarray:
    """The places of each row of `cells` (variables, rows) in several trees (trees, nodes) among the 2 ** levels nodes
    below the root, where what reaches a leaf goes on to the left. A node of all trees takes a few passes over bytes."""
    at = np.zeros((len(variable), cells.shape[1]), np.min_scalar_type((1 << levels) - 1))
    leaf = variable < 0
    variable, cut = np.where(leaf, 0, variable), np.where(leaf, 255, cut).astype(np.uint8)[:, :, None]
    for level in range(levels):
        right = np.zeros(at.shape, bool)
        for place in range(1 << level):
            node = place + (1 << level) - 1
            if not leaf[:, node].all():
                beyond = cells[variable[:, node]] > cut[:, node]
                if level:
                    beyond &= at == place
                right |= beyond
        at += at
        at += right
    return at


def _places(variable: np.ndarray, cut: np.ndarray, cells: np.ndarray, levels: int) -> np.ndarray:
    """The same for one tree."""
    return _all_places(variable[None], cut[None], cells, levels)[0]


def _reached(variable: np.ndarray, levels: int) -> np.ndarray:
    """The node that the rows at each place of `_places` have reached; leaves are not left."""
    at = np.zeros(1, np.int64)
    for _ in range(levels):
        inner = variable[at] >= 0
        at = np.stack([np.where(inner, 2 * at + 1, at), np.where(inner, 2 * at + 2, at)], axis=1).ravel()
    return at


@dataclass
class Booster:
    """What was learned: cuts of each variable, first scores, trees by round and class, and importances."""

    classes: list
    cuts: list[np.ndarray]
    first: np.ndarray
    depth: int
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray = None

    def importances(self) -> np.ndarray:
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains


def value_cuts(df: DataFrame, cols: Sequence[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """For each column, the values that end a range: all but the largest of a column with at most `bins`
    values, else distinct quantiles.

    A task sends at most `bins` + 1 values a column. Missing values are refused by name.
    """
    plain = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def values(batches) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0)] * len(cols)
        lacking = [False] * len(cols)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                x = column.to_numpy(zero_copy_only=False)
                lacking[i] |= bool(np.isnan(x).any())
                if len(held[i]) <= bins:
                    held[i] = np.unique(np.concatenate([held[i], x + 0.0]))[: bins + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(cols)), pa.int32()), pa.array([h.tolist() for h in held], pa.list_(pa.float64())), pa.array(lacking)],
            ["v", "vals", "lacks"],
        )

    sent = plain.mapInArrow(values, "v int, vals array<double>, lacks boolean")
    rows = sent.groupBy("v").agg(
        F.max("lacks").alias("lacks"),
        F.max(F.size("vals")).alias("widest"),
    )
    facts = {r["v"]: r for r in rows.collect()}
    missing = [c for i, c in enumerate(cols) if i in facts and facts[i]["lacks"]]
    if missing:
        raise ValueError(f"missing values in {', '.join(missing)}")
    few = [i for i in facts if facts[i]["widest"] <= bins]
    found = sent.where(F.col("v").isin(few)).select("v", F.explode("vals").alias("x")).distinct()
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("x"))).where(F.col("nth") <= bins + 1)
    exact: dict[int, list[float]] = {}
    for r in ranked.collect():  # at most bins + 1 values a column
        exact.setdefault(r["v"], []).append(r["x"])
    many = [i for i in facts if facts[i]["widest"] > bins or len(exact.get(i, [])) > bins]
    shares = [(k + 1) / (bins + 1) for k in range(bins)]
    cuts = [np.sort(np.array(exact.get(i, [])))[:-1] for i in range(len(cols))]
    if many:
        quantiles = plain.agg(*[F.percentile_approx(f"c{i}", shares, 100_000).alias(f"c{i}") for i in many]).first()
        for i in many:
            cuts[i] = np.unique(np.array(quantiles[f"c{i}"]))
    return cuts


def _blocks(
    df: DataFrame, label: str, cols: Sequence[str], classes: list, cuts: list[np.ndarray], first: np.ndarray, n_rows: int
) -> DataFrame:
    """Rows packed into blocks: class numbers, range numbers by variable, and the first scores."""
    index = F.create_map(*[F.lit(x) for i, y in enumerate(classes) for x in (y, i)])
    plain = df.select(
        F.element_at(index, F.col(quoted(label))).cast("short").alias("y"),
        *[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
    )
    shared = df.sparkSession.sparkContext.broadcast(cuts)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (1 + len(cols) + 8 * len(classes))))

    def pack(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block():
            table = pa.Table.from_batches(held)
            cells = np.empty((len(cols), table.num_rows), np.uint8)
            for i, cut in enumerate(shared.value):
                cells[i] = np.searchsorted(cut, table.column(i + 1).to_numpy(), "left")
            scores = np.repeat(first[:, None], table.num_rows, axis=1)
            return _block(table.column(0).to_numpy().astype(np.uint8 if len(classes) < 256 else np.int16), cells, scores)

        for batch in batches:
            while n + batch.num_rows >= most:
                held.append(batch.slice(0, most - n))
                batch = batch.slice(most - n)
                yield block()
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield block()

    # Small tables fill few blocks; a larger one has more partitions of its own, which stay as they are.
    return plain.coalesce(-(-n_rows // most)).mapInArrow(pack, BLOCKS)


def _block(labels: np.ndarray, cells: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    columns = [[labels.tobytes()], [cells.tobytes()], [scores.astype("<f8").tobytes()]]
    return pa.RecordBatch.from_arrays(
        [pa.array([len(labels)], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["n", "labels", "cells", "scores"]
    )


def _unpacked(batches, n_cols: int, n_classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kind = np.uint8 if n_classes < 256 else np.int16
    for batch in batches:
        for row in range(batch.num_rows):
            labels, cells, scores = (batch.column(c)[row].as_buffer() for c in ("labels", "cells", "scores"))
            yield (
                np.frombuffer(labels, kind),
                np.frombuffer(cells, np.uint8).reshape(n_cols, -1),
                np.frombuffer(scores, "<f8").reshape(n_classes, -1),
            )


def _chunks(blocks: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same rows, at most STRETCH * CHUNK_ROWS at a time."""
    for labels, cells, scores in blocks:
        for first in range(0, len(labels), STRETCH * CHUNK_ROWS):
            some = slice(first, first + STRETCH * CHUNK_ROWS)
            yield labels[some], np.ascontiguousarray(cells[:, some]), scores[:, some]


def _steps(rounds: list[list[tuple]], rate: float, depth: int) -> tuple:
    """The trees of some rounds, those of a class together, and what each joint place in as many trees of it as
    `CODE_BITS` allow adds to its scores."""
    several = max(1, CODE_BITS // depth)
    trees, tables = [], []
    for own in zip(*rounds):
        trees += own
        tables.append([])
        for first in range(0, len(own), several):
            table = np.zeros(1)
            for variable, _, value in own[first : first + several]:
                table = np.add.outer(table, rate * value[_reached(variable, depth)]).ravel()
            tables[-1].append((len(own[first : first + several]), table))
    if not trees:
        return None, None, []
    return np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees]), tables


def _advanced(scores: np.ndarray, cells: np.ndarray, steps: tuple, depth: int) -> np.ndarray:
    out = scores.copy()
    variable, cut, tables = steps
    if not tables:
        return out
    at = iter(_all_places(variable, cut, cells, depth))
    for k, own in enumerate(tables):
        for several, table in own:
            code = next(at)
            if several > 1:
                code = code.astype(np.uint16)
            for _ in range(several - 1):
                code <<= depth
                code |= next(at)
            out[k] += table.take(code.astype(np.intp), mode="clip")
    return out


def _residuals(labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """1 or 0 less the probability of each class, in whole units."""
    odds = scores - scores.max(axis=0)
    np.exp(odds, out=odds)
    odds /= -odds.sum(axis=0)
    for k, own in enumerate(odds):
        own += labels == k
    odds *= UNIT
    return np.rint(odds, out=odds)


def _count(
    found: np.ndarray, cells: np.ndarray, places: np.ndarray, both: np.ndarray, size: np.ndarray | None, held: np.ndarray
) -> None:
    """Add to `found` (classes; counts, residuals, curvatures; nodes; variables; ranges) at most CHUNK_ROWS rows:
    their places by class, residuals with CURVATURES for each row, and curvatures, if these are wanted by range.
    `held` is room for three numbers of each cell."""
    _, _, nodes, cols, bins = found.shape
    width = cols * bins
    wide, slots, weights = (part.reshape(-1)[: cells.size].reshape(cells.shape) for part in held)
    wide, slots = wide.view(np.intp), slots.view(np.intp)
    np.add(cells, (np.arange(cols) * bins)[:, None], out=wide)
    if nodes == 1:
        slots = wide
    flat, heavy = slots.reshape(-1), weights.reshape(-1)
    for k, own in enumerate(found):
        if nodes > 1:
            np.add(wide, places[k] * np.intp(width), out=slots)
        weights[:] = both[k]
        packed = np.bincount(flat, heavy, nodes * width).reshape(nodes, cols, bins)
        counts = packed * (1.0 / CURVATURES)
        np.rint(counts, out=counts)
        own[0] += counts
        counts *= CURVATURES
        packed -= counts
        own[1] += packed
        if size is not None:
            weights[:] = size[k]
            own[2] += np.bincount(flat, heavy, nodes * width).reshape(nodes, cols, bins)


HISTOGRAM = "slot long, sums binary"
CUT = "slot long, gain double, bin int, ln long, lg long, lh long, n long, g long, h long"


def _best_bins(slots: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """The best cut of every histogram in `sums` (slots; counts, residuals, curvatures; ranges)."""
    upto = np.cumsum(sums, axis=2)
    total = upto[:, :, -1:]
    n_left, g_left = upto[:, 0].astype(float), upto[:, 1].astype(float)
    n, g = total[:, 0].astype(float), total[:, 1].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n_left * (n - n_left) / n * (g_left / n_left - (g - g_left) / (n - n_left)) ** 2
    gain = np.where((n_left > 0) & (n_left < n), gain, -1.0)
    at = gain.argmax(axis=1)
    rows = np.arange(len(slots))
    columns = [*upto[rows, :, at].T, *total[:, :, 0].T]
    return pa.RecordBatch.from_arrays(
        [pa.array(slots), pa.array(gain[rows, at]), pa.array(at, pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
        [part.split()[0] for part in CUT.split(", ")],
    )


def _level_cuts(blocks: DataFrame, model: Booster, since: list[list[Tree]], growing: list[Tree], level: int, tasks: int) -> dict:
    """The best cut of every node that the growing trees have at `level`, with both sides' sums: by (class, node)."""
    classes, cols, nodes = len(growing), len(model.cuts), 1 << level
    bins = max(len(c) for c in model.cuts) + 1
    rate, depth = model.rate, model.depth
    shared = blocks.sparkSession.sparkContext.broadcast((_plain(since), _plain([growing])[0]))

    last = level == depth - 1

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        since, growing = shared.value
        steps = _steps(since, rate, depth)
        variable, cut, _ = (np.stack(part) for part in zip(*growing))
        inside = [_reached(own, level) >= nodes - 1 for own in variable]  # places whose node may still be cut
        # Doubles hold these sums exactly up to 2 ** 25 rows; before that they are moved to whole numbers.
        total = np.zeros((classes, 3, nodes, cols, bins), np.int64)
        found = np.zeros((classes, 3, nodes, cols, bins))
        held = 0
        room = np.empty((3, min(cols, COUNTED) * CHUNK_ROWS))
        for labels, cells, scores in _chunks(_unpacked(batches, cols, classes)):
            residual = _residuals(labels, _advanced(scores, cells, steps, depth))
            places = _all_places(variable, cut, cells, level)
            size = np.abs(residual)
            size = np.rint(size * (UNIT - size) / UNIT)
            both = residual + CURVATURES
            for k, open_ in enumerate(inside):
                if not open_.all():
                    size[k] *= open_[places[k]]
                    both[k] *= open_[places[k]]
                if not last:  # the curvature of a whole node will do: its sides are added up at the next level
                    found[k, 2, :, :, 0] += np.bincount(places[k], size[k], nodes)[:, None]
            for first in range(0, len(labels), CHUNK_ROWS):
                some = slice(first, first + CHUNK_ROWS)
                for v in range(0, cols, COUNTED):
                    _count(found[:, :, :, v : v + COUNTED], cells[v : v + COUNTED, some], places[:, some], both[:, some], size[:, some] if last else None, room)
            held += len(labels)
            if held >= 1 << 24:
                total += found.astype(np.int64)
                found[:], held = 0.0, 0
        total += found.astype(np.int64)
        sums = total.reshape(classes, 3, nodes * cols, bins).transpose(0, 2, 1, 3).reshape(-1, 3, bins)
        used = np.flatnonzero(sums[:, 0].any(axis=1))
        rows = [sums[i].tobytes() for i in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows, pa.binary())], ["slot", "sums"])

    def choose(batches) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(sums.as_buffer(), np.int64).reshape(3, bins)
                found[slot] = found[slot] + own if slot in found else own
        if found:
            yield _best_bins(np.array(list(found), np.int64), np.stack(list(found.values())))

    sent = blocks.mapInArrow(add_up, HISTOGRAM)
    if tasks > 1:  # a single task has all sums
        sent = sent.repartition(min(tasks, classes), "slot")
    best: dict = {}
    for row in sent.mapInArrow(choose, CUT).collect():  # one row for each class, node and variable
        key, v = divmod(row["slot"], cols)
        rank = (-row["gain"], v)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, row)
    return {divmod(key, nodes): (rank[1], row) for key, (rank, row) in best.items()}


def fit_booster(
    df: DataFrame,
    label: str,
    cols: Sequence[str],
    rounds: int = 100,
    depth: int = 3,
    rate: float = 0.1,
    bins: int = MAX_BINS,
) -> Booster:
    """Boost softmax scores of the classes in `label` by regression trees on `cols`.

    Each tree is grown on the residuals of its class; a node is cut where the squared difference of its
    sides' means, weighted by n_left * n_right / n, is largest (the first variable and lowest value among
    equals), and a leaf takes the usual Newton step (K - 1) / K * sum(r) / sum(|r| (1 - |r|)). Rows without a
    label are refused, and so are missing values in `cols`, by name.
    """
    if not 1 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be from 1 to {MAX_BINS}")
    spark = df.sparkSession
    counts = df.groupBy(F.col(quoted(label)).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    classes = distinct_values(counts, "y")
    if None in classes:
        raise ValueError(f"{label} has rows without a value")
    sizes = {r["y"]: r["n"] for r in counts.collect()}  # as many as distinct_values allows
    n_rows = sum(sizes.values())
    model = Booster(classes, value_cuts(df, cols, bins), np.log([sizes[y] / n_rows for y in classes]), depth, rate)
    model.gains = np.zeros(len(cols))
    if len(classes) < 2 or not cols:
        return model

    written: list[str] = []
    # Batches of Spark's own size would hold a whole row group in the reader, and up to 64 MB of blocks on either
    # side of the pipe to Python. A session of its own leaves the caller's settings as they are.
    own = spark.newSession()
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        own.conf.set(name, BATCH_BLOCKS)

    def write(blocks: DataFrame) -> DataFrame:
        written.append(scratch_path(spark, "boosting"))
        # Read up to 24 times: lz4 is read in half the time of zstd.
        writer = blocks.write.option("compression", "lz4").option("parquet.enable.dictionary", "false")
        writer.option("parquet.block.size", GROUP_BYTES).parquet(written[-1])
        for path in written[:-1]:
            delete_path(spark, path)
        del written[:-1]
        return own.read.schema(BLOCKS).parquet(written[-1])

    def advance(blocks: DataFrame, since: list[list[Tree]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(_plain(since))

        def step(batches) -> Iterator[pa.RecordBatch]:
            steps = _steps(shared.value, rate, depth)
            for labels, cells, scores in _unpacked(batches, len(cols), len(classes)):
                kind = np.uint8 if len(classes) < 256 else np.int16
                done = [_advanced(s, c, steps, depth) for _, c, s in _chunks([(labels, cells, scores)])]
                yield _block(labels.astype(kind), cells, np.concatenate(done, axis=1))

        return blocks.mapInArrow(step, BLOCKS)

    blocks = write(_blocks(df, label, cols, classes, model.cuts, model.first, n_rows))
    tasks = blocks.rdd.getNumPartitions()
    factor = (len(classes) - 1) / len(classes)
    since: list[list[Tree]] = []
    for number in range(rounds):
        growing = [Tree.empty(depth) for _ in classes]
        cut_any = False
        for level in range(depth):
            for (k, place), (v, best) in sorted(_level_cuts(blocks, model, since, growing, level, tasks).items()):
                node, tree = place + (1 << level) - 1, growing[k]
                leaf = lambda g, h: factor * g / h if h > 0 else 0.0
                tree.value[node] = leaf(best["g"], best["h"])
                if best["gain"] > LEAST_GAIN:
                    tree.variable[node], tree.cut[node] = v, best["bin"]
                    if level == depth - 1:  # the next level has the sums of other sides
                        tree.value[2 * node + 1] = leaf(best["lg"], best["lh"])
                        tree.value[2 * node + 2] = leaf(best["g"] - best["lg"], best["h"] - best["lh"])
                    model.gains[v] += best["gain"] / UNIT / UNIT / n_rows
                    cut_any = True
            if not cut_any:
                break
        if not cut_any:
            break
        since.append(growing)
        model.rounds.append(growing)
        if len(since) == WRITE_ROUNDS and number + 1 < rounds:
            blocks, since = write(advance(blocks, since)), []
            tasks = blocks.rdd.getNumPartitions()
    for path in written:
        delete_path(spark, path)
    return model
