"""Packing documents into sequences of a fixed length by best-fit decreasing.

A document is cut into full windows first; what is left is packed whole. The remainders are dealt
into groups of a bounded number by a hash, and each group is packed by itself: remainders in falling
length, each into the open window with the tightest room, which a segment tree over the remaining
capacities finds. A sequence is padded to its full length unless its length is a power of two, so the
few windows that stay poorly filled are opened again: their remainders are cut at the bits of their
lengths, and those powers of two fill windows without any padding.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.shared import stage
from tierwatch.llm import texts

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 16384
# Windows with more padding than this share of their length are opened again.
LOOSE = 1 / 16
SLICE_BYTES = 8 << 20
CACHED_WORDS = 400_000
CAPITAL_DOTTED_I = "\u0130"

PIECE = "slot long, doc_id long, start long, length int, ids_crc32 long, bits array<long>, doc_tokens long"


class SegmentTree:
    """The open windows by remaining capacity: finds the smallest capacity of at least `need`."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A window with the least sufficient room, taken out, and that room."""
        node, count = need + self.size, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node <<= 1
            if not count[node]:
                node += 1
        room = node - self.size
        window = self.open[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return window, room


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, by best-fit decreasing, and the number of windows."""
    tree, n = SegmentTree(window), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, n = (n, window), n + 1
        at, room = found
        where[i], offset[i] = at, window - room
        if room > need:
            tree.add(room - need, at)
    return where, offset, n


def fill_powers(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of pieces whose lengths are powers of two.

    In falling order they fill windows exactly; the rest is split where its length has a bit, so that
    every last sequence has a power of two as its length.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = np.concatenate([[0], np.cumsum(sizes[order])])
    total, begin = int(begin[-1]), begin[:-1]
    full, rest = divmod(total, window)
    cuts, at = [], full * window
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    starts = np.array([i * window for i in range(full)] + cuts, np.int64)
    number = np.searchsorted(starts, begin, "right") - 1
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    where[order], offset[order] = number, begin - starts[number] if len(sizes) else begin
    return where, offset, len(starts)


def bit_lengths(length: int) -> list[int]:
    return [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]


def _word_ids(tokenizer, last: np.ndarray, words: list[bytes]) -> list[bytes]:
    """The ids of each word, packed. Words are encoded side by side; each ends with a final token."""
    out: list[bytes] = []
    for first in range(0, len(words), 4096):
        line = b" ".join(words[first : first + 4096]).decode()
        ids = np.array(tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(words[first : first + 4096]):  # not one final token each: one at a time
            out += [
                np.array(tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint16).tobytes()
                for w in words[first : first + 4096]
            ]
            continue
        packed, cuts = ids.tobytes(), (2 * np.concatenate([[0], ends])).tolist()
        out += [packed[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def _tokenizer(path: str, definition: str | None = None):
    """The tokenizer, which tokens end a word, and the words met so far, kept by the worker."""
    cache = texts.worker_cache()
    if ("tokenizer", path) not in cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition) if definition else Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        last = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            last[number] = token.endswith("</w>")
        cache["tokenizer", path] = tokenizer, last
        cache["words", path] = {}
    return *cache["tokenizer", path], cache["words", path]


def _whole_tokenizer(path: str, definition: str | None = None):
    """The tokenizer as it comes, which knows its special tokens in a text, and their strings."""
    cache = texts.worker_cache()
    if ("whole", path) not in cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition) if definition else Tokenizer.from_file(path)
        cache["whole", path] = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return cache["whole", path]


def document_ids(documents: list[str], path: str, definition: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text, `END_ID` after each, joined, and the n + 1 offsets of the documents.

    Each distinct word is encoded once. Texts that hold the string of a special token, or the one letter
    whose lower case depends on the marks after it, are given to the tokenizer whole.
    """
    whole, special = _whole_tokenizer(path, definition)
    clean = [unicodedata.normalize("NFC", d).replace("Σ", "σ").lower() for d in documents]
    odd = [i for i, c in enumerate(clean) if CAPITAL_DOTTED_I in documents[i] or any(t in c or t in documents[i] for t in special)]
    for i in odd:
        clean[i] = ""
    ids, offsets = _ids_by_word(clean, path, definition)
    if not odd:
        return ids, offsets
    own = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
    for i in odd:
        own[i] = np.array([*whole.encode(documents[i], add_special_tokens=False).ids, END_ID], np.uint32)
    return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def _ids_by_word(clean: list[str], path: str, definition: str | None) -> tuple[np.ndarray, np.ndarray]:
    """`document_ids` of texts in lower case."""
    tokenizer, last, known = _tokenizer(path, definition)
    sizes = np.array([len(d) for d in clean], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    joined = "".join(clean)
    n_docs = len(clean)
    if not joined:
        return np.full(n_docs, END_ID, np.uint32), np.arange(n_docs + 1)
    points = texts.code_points(joined)
    starts = np.flatnonzero(texts.pretoken_starts(points, bounds[:-1][sizes > 0], spaced=False))
    solid = texts.character_classes()[points[starts]] != texts.SPACE
    coded = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    cuts = texts.character_offsets(coded)[np.append(starts, len(points))]
    coded = texts.tiled_spans(coded, cuts).filter(pa.array(solid)).dictionary_encode()
    words = texts.byte_strings(coded.dictionary)
    if len(known) > CACHED_WORDS:
        known.clear()
    new = [w for w in words if w not in known]
    known.update(zip(new, _word_ids(tokenizer, last, new)))
    packed = [known[w] for w in words]
    table = np.frombuffer(b"".join(packed), np.uint16)
    length = np.array([len(p) for p in packed], np.int64) // 2
    begin = np.concatenate([[0], np.cumsum(length)])
    index = coded.indices.to_numpy()
    document = np.searchsorted(bounds, starts[solid], "right") - 1
    # Positions in the result: each word after all before it and after the ends of earlier documents.
    counts = length[index] if len(index) else np.zeros(0, np.int64)
    after = np.concatenate([[0], np.cumsum(counts)])
    ids = np.full(int(after[-1]) + n_docs, END_ID, np.uint32)
    if len(index):
        target = np.repeat(document, counts) + np.arange(after[-1])
        source = np.repeat(begin[index] - after[:-1], counts) + np.arange(after[-1])
        ids[target] = table[source]
    words_before = np.searchsorted(document, np.arange(n_docs + 1))
    return ids, after[words_before] + np.arange(n_docs + 1)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of every document: full windows and what is left, with checksums.

    `bits` has the checksums of the parts that a remainder would be cut into at the bits of its length.
    """

    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a fixed vocabulary

    def cut(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() << 33
        for batch in batches:
            column = batch.column(1)
            for first, end, _, _ in texts.slices(column, SLICE_BYTES):
                part = [t or "" for t in column.slice(first, end - first).to_pylist()]
                ids, offsets = document_ids(part, tokenizer_path, shared.value)
                raw = memoryview(ids.astype("<u4").tobytes())
                owner = batch.column(0).slice(first, end - first).to_pylist()
                rows = []
                for i in range(len(part)):
                    low, high = int(offsets[i]), int(offsets[i + 1])
                    for a in range(low, high, window):
                        b = min(a + window, high)
                        bits, c = [], a
                        for size in bit_lengths(b - a) if b - a < window else ():
                            bits.append(zlib.crc32(raw[4 * c : 4 * (c + size)]))
                            c += size
                        crc = bits[0] if len(bits) == 1 else zlib.crc32(raw[4 * a : 4 * b])
                        rows.append((slot, owner[i], a - low, b - a, crc, bits, high - low))
                        slot += 1
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
                names = ["slot", "doc_id", "start", "length", "ids_crc32", "bits", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return whole.mapInArrow(cut, PIECE)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty; an empty text still has its end id. Rows that repeat an id are packed as
    documents of their own. Sequence ids are unique but not dense. Strings that name special tokens
    have the tokens' ids, as the tokenizer gives them. Other columns are ignored; an empty table gives an empty result.
    """
    cut = stage(pieces(docs, tokenizer_path, window), "pieces", codec="zstd")
    rest = cut.where(F.col("length") < window)
    groups = math.ceil(rest.count() / group_pieces) or 1

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("slot", "ascending")])
        length = group.column("length").to_numpy().astype(np.int64)
        where, offset, n = best_fit(length, window)
        used = np.bincount(where, length, n).astype(np.int64)
        loose = ((used & (used - 1)) != 0) & (window - used > LOOSE * window)
        opened = loose[where]
        keep = np.flatnonzero(~opened)
        out = {name: [group.column(name).take(keep)] for name in ("doc_id", "start", "ids_crc32", "doc_tokens")}
        numbers, offsets, lengths = [where[keep]], [offset[keep]], [length[keep]]
        parts = [
            (doc, start + begin, crc, tokens, size)
            for doc, start, bits, tokens, n_ids in zip(
                *(group.column(c).take(np.flatnonzero(opened)).to_pylist()
                  for c in ("doc_id", "start", "bits", "doc_tokens", "length"))
            )
            for size, begin, crc in zip(
                bit_lengths(n_ids), np.cumsum([0, *bit_lengths(n_ids)]).tolist(), bits
            )
        ]
        if parts:
            doc, start, crc, tokens, size = zip(*parts)
            for name, values in (("doc_id", doc), ("start", start), ("ids_crc32", crc), ("doc_tokens", tokens)):
                out[name].append(pa.chunked_array([pa.array(values, pa.int64())]))
            again, begin, _ = fill_powers(np.array(size, np.int64), window)
            numbers.append(again + n)
            offsets.append(begin)
            lengths.append(np.array(size, np.int64))
        joined = {name: pa.chunked_array([c for x in v for c in x.chunks], pa.int64()) for name, v in out.items()}
        return pa.table(
            [joined["doc_id"], joined["start"], np.concatenate(lengths), joined["ids_crc32"],
             joined["doc_tokens"], np.concatenate(numbers), np.concatenate(offsets)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "offset"],
        )

    def fit_group(key, group):
        packed = fit(group)
        number = packed.column("number").to_numpy() + (key[0].as_py() << 32)
        return packed.set_column(5, "number", pa.array(number, pa.int64()))

    group = F.pmod(F.xxhash64("slot"), F.lit(groups)).alias("group")
    packed = rest.groupBy(group).applyInArrow(fit_group, PACKED)
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = packed.withColumn("sequence_id", F.col("number") * 2).select(result)
    alone = cut.where(F.col("length") == window).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("slot") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(alone)
