"""Byte-level BPE encoding and decoding with one visit to each distinct pre-token of the corpus.

Texts are split into pre-tokens, which stay with their positions in their block; the distinct ones of
every block are shuffled by the word and encoded once, and the ids are joined back to the blocks and
laid out by position (`wordtable`). Decoding explodes the ids of every distinct word with their positions,
joins them with the table of token bytes and lays the bytes back by position. That table and the ranks
are a fixed vocabulary, whose size does not depend on the data; it is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.llm import texts, wordtable

SPLIT_BYTES = 2 << 20


def split(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Positions of all pre-tokens of a block in its dictionary, the dictionary, and the pre-tokens
    before each document.

    The dictionary is joined from slices, so that the code points of a whole block are never held.
    """
    column = table.column("text").combine_chunks()
    words, per_document = [], []
    for _, _, data, offsets in texts.slices(column, SPLIT_BYTES):
        if not len(data):
            per_document.append(np.zeros(len(offsets) - 1, np.int64))
            continue
        points = texts.code_points(data.tobytes().decode())
        at = texts.character_offsets(data)
        firsts = np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])
        cuts = at[np.append(np.flatnonzero(texts.pretoken_starts(points, firsts, spaced=True)), len(points))]
        words.append(texts.tiled_spans(data, cuts).dictionary_encode())
        per_document.append(np.diff(np.searchsorted(cuts[:-1], offsets)))
    before = np.concatenate([[0], np.cumsum(np.concatenate(per_document))]) if per_document else np.zeros(1, np.int64)
    if not words:
        return np.zeros(0, np.uint32), pa.array([], pa.large_binary()), before
    index, dictionary = wordtable.frequent_first(pa.chunked_array(words).unify_dictionaries().combine_chunks())
    return index, dictionary, before


ROWS = "kind string, block long, doc_id long, place int, payload binary"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """For every block the rows of its documents (positions) and of its dictionary (words)."""
    numbers = wordtable.block_numbers()
    for table in wordtable.gathered(batches):
        block = next(numbers)
        index, dictionary, before = split(table)
        cuts = before.tolist()
        packed = [wordtable.pack_positions(index[a:b]) for a, b in zip(cuts, cuts[1:])]
        for kind, ids, place, payload in (
            ("doc", table.column("doc_id").combine_chunks(), None, pa.array(packed, pa.binary())),
            ("word", None, np.arange(len(dictionary), dtype=np.int32), dictionary.cast(pa.binary())),
        ):
            n = len(payload)
            none = lambda k, n=n: pa.nulls(n, k)
            columns = [
                pa.array(np.repeat(kind, n), pa.string()),
                pa.array(np.full(n, block), pa.int64()),
                none(pa.int64()) if ids is None else ids.cast(pa.int64()),
                none(pa.int32()) if place is None else pa.array(place),
                payload,
            ]
            whole = pa.RecordBatch.from_arrays(columns, ["kind", "block", "doc_id", "place", "payload"])
            for first in range(0, n, 50_000):
                yield whole.slice(first, 50_000)


def vocabulary(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """`(id, bytes)` of a vocabulary, which does not grow with the data."""
    rows = pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array(list(ranks), pa.binary())], ["id", "bytes"])
    return spark.createDataFrame(rows)


def spelled(words: DataFrame, coded: DataFrame, tokens: DataFrame) -> DataFrame:
    """`words` (block, place, word) with the ids of each word in `coded` (word, ids) and the bytes these stand for.

    Every distinct word is exploded into its ids with their positions, joined with the table of token bytes,
    and laid back by position.
    """
    placed = coded.select("word", F.posexplode("ids").alias("at", "id")).join(F.broadcast(tokens), "id")
    again = placed.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "id", "bytes"))).alias("cells"))
    joined = F.aggregate("cells", F.lit(b""), lambda done, cell: F.concat(done, cell["bytes"]))
    table = again.select("word", F.transform("cells", lambda cell: cell["id"]).alias("ids"), joined.alias("bytes"))
    return words.join(table, "word")


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False, digests: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text as little-endian unsigned 32-bit integers.

    With `decoded`, also the bytes that the ids stand for. With `digests`, n_tokens and the SHA-256 of ids and of
    decoded bytes instead, so that neither leaves the task. Every match of `pattern` is encoded by itself,
    without special tokens. Null and empty texts have no ids. Rows that repeat an id are encoded each. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = vocabulary(ranks_path)
    ranks = spark.sparkContext.broadcast(known)
    width = "<u2" if max(known.values(), default=0) < 1 << 16 else "<u4"

    def to_ids(batches) -> Iterator[pa.RecordBatch]:
        cache = texts.worker_cache()
        if ("encoding", ranks_path) not in cache:
            import tiktoken

            cache["encoding", ranks_path] = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}
            )
        one = cache["encoding", ranks_path].encode_ordinary
        for batch in batches:
            ids = [one(w.decode()) for w in texts.byte_strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    if digests:
        schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema = "doc_id long, ids binary" + ", decoded binary" * decoded
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), *[pa.binary()] * (1 + decoded)]

    def lay_out(documents, answers):
        if not documents.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        table, offsets = wordtable.assembled(answers, "id_sizes", "ids", width)
        data, cuts = wordtable.assembled(answers, "byte_sizes", "bytes", "u1")
        out: list[list] = [[] for _ in names[1:]]
        for packed in documents.column("payload"):
            index = wordtable.unpack_positions(packed.as_py())
            ids = _laid(table, offsets, index).astype("<u4")
            if digests:
                text = _laid(data, cuts, index)
                values = (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
            else:
                values = (ids.tobytes(), *[_laid(data, cuts, index).tobytes()] * decoded)
            for column, value in zip(out, values):
                column.append(value)
        return pa.table([documents.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds[1:])]], names)

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = wordtable.staged_by_block(whole.mapInArrow(_blocks, ROWS), "pretokens")
    words = rows.where("kind = 'word'").select("block", "place", F.col("payload").alias("word"))
    coded = words.select("word").distinct().mapInArrow(to_ids, "word binary, ids array<int>")
    found = wordtable.packed_answers(spelled(words, coded, token_table(spark, known)), width)
    documents = rows.where("kind = 'doc'").select("block", "doc_id", "payload")
    return documents.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lay_out, schema)


def _laid(table: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """What the words at `index` were answered, one after the other."""
    size = offsets[index + 1] - offsets[index]
    after = np.concatenate([[0], np.cumsum(size)])
    return table[np.repeat(offsets[index] - after[:-1], size) + np.arange(after[-1])]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with `decoded`, the bytes of its ids; null ids give null.

    The ids of a row are exploded with their positions, joined with the table of token bytes, and laid back by
    position. Ids that the vocabulary lacks stand for no bytes. Rows that repeat an id are decoded each.
    """
    spark = encoded.sparkSession

    def numbers(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [None if i is None else np.frombuffer(i, "<u4").tolist() for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["ids", "parts"])

    distinct = encoded.where("ids is not null").select("ids").distinct()  # equal sequences are decoded once
    parts = distinct.mapInArrow(numbers, "ids binary, parts array<long>").select("ids", F.posexplode("parts").alias("at", "id"))
    cells = parts.join(F.broadcast(token_table(spark, vocabulary(ranks_path))), "id")
    laid = cells.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("cells"))
    joined = F.aggregate("cells", F.lit(b""), lambda done, cell: F.concat(done, cell["bytes"]))
    found = encoded.select("doc_id", "ids").join(laid.select("ids", joined.alias("decoded")), "ids", "left")
    return found.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.coalesce("decoded", F.lit(b""))).alias("decoded"))
