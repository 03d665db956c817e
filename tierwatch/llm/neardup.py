"""Near-duplicates by min-max hashing.

Of each permutation of the shingles both the smallest and the largest value are kept, so a signature
of 2k values takes k hash evaluations; both are unbiased for the resemblance, and together they vary
less than 2k separate minima. Signatures are cut into bands, and documents that agree in a band are
candidates. With 32 bands of 4 values, a pair at the threshold is missed with a chance of about
0.000005, and more similar pairs far less.

Texts with equal sets are one class, represented by one row, before anything else. Candidates are
then confirmed on the full sets without ever listing the pairs of a bucket: first each member against the
smallest of its bucket; what is linked becomes one component. Buckets that still hold several
components are dealt into cells of bounded size, in which every row outside the largest component meets every row
of its bucket, however many there are of either; pairs whose signatures may reach the threshold are compared on
their full sets inside the task. What leaves it are links that connect what was apart, fewer than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.shared import scratch, stage
from tierwatch.llm import exactdup, texts
from tierwatch.llm.links import components

WORDS = 5
PERMUTATIONS = 64
BAND_VALUES = 4
CELL_ROWS = 1024
BLOCK_HASHES = 4096
# Equal sets are merged in runs, and the runs in one round, so that a set of very many rows fills several tasks.
CLASS_RUNS = 64
FILTER_BITS = 1 << 26
# Pairs at the threshold agree in 96 of 128 values on average, with a deviation of 4.9.
SKETCH_DEVIATIONS = 5


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return texts.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each document.

    Words are compared with A-Z in lower case. A document of fewer words is one shingle.
    """
    data = texts.lower_ascii(data)
    starts, ends, owner = texts.word_spans(data, offsets)
    n_docs = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n_docs
    hashes = texts.span_hashes(data, starts, ends)
    factors = constants(words, 5)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    place = np.arange(len(hashes))
    begin = np.searchsorted(owner, np.arange(n_docs + 1))
    counts = np.diff(begin)
    left = begin[owner + 1] - place
    total = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        total += np.where(left > j, padded[j : j + len(hashes)] * factors[j], np.uint64(0))
    whole = texts.mix(total + np.minimum(left, words).astype(np.uint64))
    out = []
    for d in range(n_docs):
        n = max(counts[d] - words + 1, min(counts[d], 1))
        out.append(np.unique_values(whole[begin[d] : begin[d] + n]) if n > 1 else whole[begin[d] : begin[d] + n])
        if n > 1:
            out[-1].sort()
    return out


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Smallest and largest value of each set under each permutation; the sets are not empty."""
    joined = np.concatenate(sets)
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k, (a, b) in enumerate(zip(constants(permutations, 11), constants(permutations, 13))):
        values = joined * a + b
        out[:, 2 * k] = np.minimum.reduceat(values, heads)
        out[:, 2 * k + 1] = np.maximum.reduceat(values, heads)
    return out


def pack_set(hashes: np.ndarray) -> bytes:
    """Sorted hashes, cut to 48 bits, as planes of bytes of their differences."""
    short = hashes >> np.uint64(16)
    return np.diff(short, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:6].tobytes()


def unpack_set(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


SIGNED = (
    "row long, doc_id long, n_shingles long, digest binary, check long, size long, bands array<long>, "
    "sketch binary, hashes binary"
)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: its set, what identifies the set, its bands and a short signature."""

    def sign(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, data, offsets in texts.slices(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if full:
                    values = signatures([sets[i] for i in full])
                    parts = values.reshape(len(full), -1, BAND_VALUES)
                    keys = (parts * constants(BAND_VALUES, 17)).sum(axis=2, dtype=np.uint64)
                    keys = texts.mix(keys + constants(keys.shape[1], 19)).view(np.int64)
                    short = (texts.mix(values) & np.uint64(255)).astype(np.uint8)
                    for at, i in enumerate(full):
                        bands[i], sketch[i] = keys[at], short[at].tobytes()
                sums = [texts.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]
                more = [texts.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for s in sets]
                sizes = [len(s) for s in sets]
                columns = [
                    pa.array(np.arange(row, row + len(sets)), pa.int64()),
                    batch.column(0).slice(first, end - first).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big") for a, b in zip(sums, more)], pa.binary()),
                    pa.array(np.array(more, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                    pa.array([pack_set(s) for s in sets], pa.binary()),
                ]
                row += len(sets)
                names = [part.split()[0] for part in SIGNED.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)

    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return whole.mapInArrow(sign, SIGNED)


def likely(threshold_agree: int):
    """A task that keeps the pairs (a, b, sketch_a, sketch_b) whose signatures agree often enough."""

    def keep(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                texts.byte_view(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (2, 3)
            )
            close = np.flatnonzero((one == two).sum(axis=1) >= threshold_agree)
            yield batch.select([0, 1]).take(pa.array(close))

    return keep


def only_wanted(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `sets` (row, hashes) whose number is in `rows`, and a few others, without moving any.

    A bit map of hashed row numbers, of at most `FILTER_BITS` bits at any size, is broadcast. What else it lets
    through has no partner in the inner join on `row` that has to follow.
    """
    wanted = stage(rows.distinct(), "wanted", codec="zstd")
    n = wanted.count()
    bits = 1 << min(max((16 * n - 1).bit_length(), 10), FILTER_BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    words = wanted.groupBy((place / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(row), {bits}) % 64 as int))")).alias("mask")
    )
    table = words.toArrow()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    shared = sets.sparkSession.sparkContext.broadcast(bitmap)

    def sift(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.uint64)
            hit = shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return sets.select("row", "hashes", place.alias("place")).mapInArrow(sift, "row long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach `percent` in intersection over union."""

    def compare(batches) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            good = []
            for a, packed, other in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:
                    last, one = a, unpack_set(packed)
                good.append(_alike(one, unpack_set(other), percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = stage(pairs, "pairs", codec="zstd")
    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    own = stage(only_wanted(sets, ends), "sets", codec="zstd")
    left = own.select(F.col("row").alias("a"), F.col("hashes").alias("one"))
    right = own.select(F.col("row").alias("b"), F.col("hashes").alias("two"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "one", "two")
    return both.mapInArrow(compare, "a long, b long")


def _root(parent: dict, node: int) -> int:
    while parent[node] != node:
        parent[node] = node = parent[parent[node]]
    return node


def dealt_cells(members: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of `members` in the cells of their bucket: each in its chunk of every part, and those outside the
    largest component in every chunk of their part too. No row comes to a cell twice: `asked` and `asks` tell
    what it does there."""
    chunks = F.ceil(F.col("size") / cell_rows).cast("int")
    parts = F.ceil(F.col("outside") / cell_rows).cast("int") if "outside" in members.columns else F.lit(1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    some = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")
    shape = lambda rows, asked, asks: rows.select(
        "key", "part", "chunk", "row", "component", "sketch", "hashes", asked.alias("asked"), asks.alias("asks")
    )
    outside = F.col("component") != F.col("top")
    asked = members.withColumns({"own": some(parts, 1), "part": every(parts), "chunk": some(chunks, 0)})
    asking = members.where(outside).withColumns({"own": some(chunks, 0), "part": some(parts, 1), "chunk": every(chunks)})
    elsewhere = asking.where("chunk != own")
    return shape(asked, F.lit(True), outside & (F.col("part") == F.col("own"))).unionByName(
        shape(elsewhere, F.lit(False), F.lit(True))
    )


def links_in_cells(members: DataFrame, threshold_agree: int, percent: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that join the components which meet in a bucket of `members` (key, row, component, top, size,
    sketch, hashes).

    A bucket is dealt into chunks of about `cell_rows` rows, and its rows outside its largest component, `top`, into
    parts of as many; each part meets each chunk in a cell. `members` may give the number of those rows as
    `outside`; else they are one part. Inside a task, pairs of different components whose signatures may reach the
    threshold are compared on their full sets, and a link is sent unless those found in the cell already connect
    the pair. So a cell sends fewer links than it has components, and loses no connection.
    """
    dealt = dealt_cells(members, cell_rows)

    def meet(cell: pa.Table) -> pa.Table:
        row, component = (cell.column(c).to_numpy() for c in ("row", "component"))
        asked, asks = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("asked", "asks"))
        sketch = texts.byte_view(cell.column("sketch"))[0].reshape(len(row), -1)
        packed = cell.column("hashes").combine_chunks()
        sizes = np.array([len(h.as_buffer()) // 6 for h in packed])
        asking_rows, to = np.flatnonzero(asks), np.flatnonzero(asked)
        near = np.zeros((len(asking_rows), len(to)), bool)
        for nth, at in enumerate(asking_rows.tolist()):
            agree = (sketch[to] == sketch[at]).sum(axis=1)
            low, high = np.minimum(sizes[to], sizes[at]), np.maximum(sizes[to], sizes[at])
            near[nth] = (agree >= threshold_agree) & (component[to] != component[at]) & (100 * low >= percent * high)
        asking_rows, near = asking_rows[some := near.any(axis=1)], near[some]
        to, near = to[some := near.any(axis=0)], near[:, some]
        common = _common([unpack_set(packed[i].as_py()) for i in asking_rows], [unpack_set(packed[i].as_py()) for i in to])
        whole = sizes[asking_rows][:, None] + sizes[to] - common
        alike = near & (100 * common >= percent * whole)
        parent = {c: c for c in component.tolist()}
        a, b = [], []
        for nth, at in enumerate(asking_rows.tolist()):
            # One link to each component is enough.
            found = to[np.flatnonzero(alike[nth])]
            for i in found[np.unique(component[found], return_index=True)[1]].tolist():
                mine, other = _root(parent, component[at].item()), _root(parent, component[i].item())
                if mine != other:
                    parent[max(mine, other)] = min(mine, other)
                    a.append(min(row[at], row[i]))
                    b.append(max(row[at], row[i]))
        return pa.table([np.array(a, np.int64), np.array(b, np.int64)], ["a", "b"])

    return dealt.groupBy("key", "part", "chunk").applyInArrow(meet, "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of `left` shares with each of `right`: products of 0/1 matrices, a block of hashes
    at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return out.astype(np.int64)
    joined = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, number = np.unique(joined, return_inverse=True)
    on_left = owner < len(left)
    both = np.zeros(number.max() + 1, bool)
    both[number[on_left]] = True
    only = np.zeros_like(both)
    only[number[~on_left]] = True
    both &= only  # hashes of one side alone are shared by no pair
    place = np.cumsum(both) - 1
    keep = both[number]
    owner, number = owner[keep], place[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, BLOCK_HASHES):
        low, high = np.searchsorted(number, (first, first + BLOCK_HASHES))
        cells = np.zeros((len(left) + len(right), BLOCK_HASHES), np.float32)
        cells[owner[low:high], number[low:high] - first] = 1.0
        out += cells[: len(left)] @ cells[len(left) :].T
    return np.rint(out).astype(np.int64)


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach `percent` in intersection over union."""
    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
    common = int((one[at] == two).sum())
    return 100 * common >= percent * (len(one) + len(two) - common)


def linked_rows(table: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """(node, component) for the representatives of `table` (row, bands, sketch) that have links.

    `sets` (row, hashes) has their full sets.
    """
    agree = 2 * PERMUTATIONS * percent / 100
    spread = (agree * (1 - percent / 100)) ** 0.5
    least = int(agree - SKETCH_DEVIATIONS * spread)
    spark = table.sparkSession
    # Dealt by key once: counting the buckets and reading them share the exchange.
    entries = table.select(F.explode("bands").alias("key"), "row").repartition("key")
    # Buckets that hold the same rows are one: copies that agree in many bands meet once.
    held = entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("row").alias("hub"), F.bit_xor(F.xxhash64("row")).alias("mark")
    )
    shared = held.where("size > 1").groupBy("size", "hub", "mark").agg(F.min("key").alias("key")).drop("mark")
    buckets = stage(entries.join(shared, "key"), "buckets", codec="zstd")
    sketches = table.select("row", "sketch")
    named = lambda name: sketches.select(
        F.col("row").alias(name), F.col("sketch").alias(f"sketch_{name}")
    )

    def confirm(pairs: DataFrame) -> DataFrame:
        with scratch(spark) as own:
            return own.keep(stage(confirmed(pairs, sets, percent), "confirmed", codec="zstd"))

    def by_sketch(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(named("b"), "b").join(named("a"), "a").select("a", "b", "sketch_a", "sketch_b")
        return both.mapInArrow(likely(least), "a long, b long")

    def mixed(open_: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components: key, row, component, and the bucket's `size`,
        largest component `top` and number of rows outside it; of buckets with the same rows, one."""
        placed = open_.select("key", "row").join(found.withColumnRenamed("node", "row"), "row", "left").withColumn(
            "component", F.coalesce("component", "row")
        )
        held = placed.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("mark"), F.min("row").alias("low")
        )
        largest = held.groupBy("key").agg(
            F.sum("n").alias("size"), F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("largest"),
            F.count(F.lit(1)).alias("kinds"), F.bit_xor("mark").alias("mark"), F.min("low").alias("low"),
        )
        several = largest.where("kinds > 1").groupBy("size", "mark", "low", "largest").agg(F.min("key").alias("key"))
        several = several.select(
            "key", "size", (-F.col("largest.minus")).alias("top"), (F.col("size") - F.col("largest.n")).alias("outside")
        )
        return placed.join(several, "key")

    # Each row against the smallest of its bucket; in buckets of two rows that is every pair.
    pairs = buckets.where("row != hub").select(F.col("hub").alias("a"), F.col("row").alias("b"))
    links = confirm(by_sketch(pairs))
    found = components(links)
    rest = stage(mixed(buckets.where("size > 2"), found), "mixed", codec="zstd")
    if not rest.limit(1).count():
        return found
    with scratch(spark) as own:
        full = stage(only_wanted(sets, rest.select("row")), "sets", codec="zstd")
        cells = links_in_cells(rest.join(sketches, "row").join(full, "row"), least, percent, CELL_ROWS)
        more = own.keep(stage(cells, "more-links", codec="zstd"))
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach. Documents without a word are linked with
    nothing. A row with a null doc_id takes part, but names no component: if all rows of a component
    lack an id, component_id is null and they are kept. Rows that repeat an id are documents of their
    own that share the id. Other columns are ignored; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as own:
        placed = own.keep(stage(_placed(docs, percent, words), "placed", codec="zstd"))
    # In two steps, so that a component of very many rows meets its name under several keys.
    parts = placed.groupBy("component", "part").agg(F.min("doc_id").alias("low"))
    names = parts.groupBy("component").agg(F.min("low").alias("component_id"))
    named = parts.select("component", "part").join(names, "component")
    return placed.join(named, ["component", "part"]).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def _placed(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(doc_id, n_shingles, component, part) of every row; a component is named by one of its rows."""
    table = stage(signed(docs, words), "signed", codec="zstd")
    runs = CLASS_RUNS
    same = ["digest", "check", "size"]
    runs_of = table.where("n_shingles > 0").select(
        F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int").alias("run"), *same, F.col("row").alias("doc_id")
    )
    with scratch(docs.sparkSession) as own:
        classes = runs_of.join(exactdup.exact_groups(runs_of, runs, fan=runs), ["run", *same]).select(
            F.col("doc_id").alias("row"), F.col("keep_id").alias("class")
        )
        classes = own.keep(stage(classes, "classes", codec="zstd"))
    first = table.select("row", "bands", "sketch").join(classes.where("row = class").select("row"), "row", "left_semi")
    representatives = stage(first, "representatives", codec="zstd")
    found = linked_rows(representatives, table.select("row", "hashes"), percent).select(F.col("node").alias("class"), "component")
    return (
        table.select("row", "doc_id", "n_shingles")
        .join(classes, "row", "left")
        .withColumn("class", F.coalesce("class", "row"))
        .join(found, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
        .select("doc_id", "n_shingles", "component", F.pmod(F.xxhash64("row"), F.lit(runs)).alias("part"))
    )


def one_of_each(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """The rows of `docs`, all columns, whose id names their component; rows without an id stay.

    Rows that repeat an id stay together.
    """
    found = near_duplicates(docs, percent, words).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"))
    dropped = ids.where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"))
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
