"""The distinct words of a corpus, met once each.

Documents are gathered into blocks of a bounded size. A block keeps the sequence of its words as
positions in its own dictionary, and only the dictionaries are exchanged: one row per block and
distinct word, dealt out by the word. What is found for a word goes back to the blocks that hold it,
where the documents are put together again by position.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierwatch.functions.shared import scratch_path
from tierwatch.llm.texts import byte_view

BLOCK_BYTES = 32 << 20
HEAD_WORDS = 4096


def gathered(batches, limit: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.Table]:
    """Record batches joined, or cut between rows, into tables of about `limit` bytes of text."""
    held, size = [], 0
    for batch in batches:
        lengths = np.zeros(batch.num_rows + 1, np.int64)
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        lengths[1:] = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()])
        first = 0
        while first < batch.num_rows:
            end = int(np.searchsorted(lengths, lengths[first] + limit - size, "right")) - 1
            if end <= first and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            end = min(max(end, first + 1), batch.num_rows)
            held.append(batch.slice(first, end - first))
            size += int(lengths[end] - lengths[first])
            first = end
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def frequent_first(coded: pa.DictionaryArray, head: int = HEAD_WORDS) -> tuple[np.ndarray, pa.Array]:
    """Positions in a dictionary that begins with the most frequent words, and that dictionary.

    The frequent ones get small positions, which compress well; the others are sorted, since
    neighbours that share a beginning compress well too.
    """
    index = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
    rest = order[head:]
    rest = rest[pa.compute.sort_indices(coded.dictionary.take(pa.array(rest))).to_numpy()]
    order = np.concatenate([order[:head], rest])
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return place[index], coded.dictionary.take(pa.array(order))


def pack_positions(index: np.ndarray) -> bytes:
    """Positions below 2 ** 24 as three planes of bytes, which compress well."""
    return index.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def unpack_positions(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(3, -1).astype(np.uint32)
    return planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16)


def staged_by_block(df: DataFrame, label: str) -> DataFrame:
    """`df` (kind, block, ...) written once, bucketed by block, so that later joins on block need not
    move the documents. The table is dropped when the process ends."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    writer = df.write.partitionBy("kind").bucketBy(buckets, "block").option("compression", "zstd")
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)

    def drop():
        with contextlib.suppress(Exception):  # the session may be gone by then
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)
    return spark.table(name)


def block_numbers() -> Iterator[int]:
    """Numbers that no other task of this stage gives."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    while True:
        yield number
        number += 1


def squeezed(values: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit numbers."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueezed(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


PACKED = "block long, places binary, id_sizes binary, ids binary, byte_sizes binary, bytes binary"


def packed_answers(found: DataFrame, width: str) -> DataFrame:
    """`found` (block, place, ids, bytes): a few rows for each block, with the places, the ids as numbers of
    `width`, and the bytes of many words."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            place, lists, text = place[order], batch.column(2).take(pa.array(order)), batch.column(3).take(pa.array(order))
            ends = lists.offsets.to_numpy()
            ids, begin = lists.values.to_numpy().astype(width), ends - ends[0]
            raw, cuts = byte_view(text)
            heads = np.flatnonzero(np.diff(block[order], prepend=block[order][0] - 1))
            rows: list[list] = [[] for _ in range(6)]
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
                values = (
                    int(block[order[a]]),
                    squeezed(np.diff(place[a:b], prepend=0)),  # wraps around where it falls
                    squeezed(np.diff(begin[a : b + 1])),
                    ids[begin[a] : begin[b]].tobytes(),
                    squeezed(np.diff(cuts[a : b + 1])),
                    raw[cuts[a] : cuts[b]].tobytes(),
                )
                for row, value in zip(rows, values):
                    row.append(value)
            kinds = [pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], [p.split()[0] for p in PACKED.split(", ")])

    return found.select("block", "place", "ids", "bytes").mapInArrow(pack, PACKED)


def assembled(answers: pa.Table, sizes: str, values: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What the words of a block were answered, joined in the order of its dictionary, and the n + 1 offsets.

    `sizes` and `values` name the columns, `kind` the type of a value.
    """
    if not answers.num_rows:
        return np.zeros(0, kind), np.zeros(1, np.int64)
    place = np.concatenate([np.cumsum(unsqueezed(p), dtype=np.uint32) for p in answers.column("places").to_pylist()])
    size = np.concatenate([unsqueezed(s) for s in answers.column(sizes).to_pylist()]).astype(np.int64)
    data = np.frombuffer(b"".join(answers.column(values).to_pylist()), kind)
    source = np.concatenate([[0], np.cumsum(size)])[:-1]
    order = np.argsort(place)
    lengths = size[order]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    where = np.repeat(source[order] - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[where], offsets
