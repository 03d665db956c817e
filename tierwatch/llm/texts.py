"""Whole texts as flat arrays: a batch of documents becomes one byte array and its offsets.

The functions here run inside Arrow tasks. Each looks at a bounded slice of documents at a time
(a single document is never cut), so memory follows the slice and the longest document.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

# Character classes of the pre-token patterns.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# Bytes that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
WORD_GAPS = (9, 10, 11, 12, 13, 32)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, shared by all its tasks."""
    return sys.modules.setdefault("_tierwatch_worker", types.ModuleType("_tierwatch_worker")).__dict__


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
        column = pc.fill_null(column, "") if column.null_count else column
    else:
        column = column.cast(pa.large_binary())
        column = pc.fill_null(column, b"") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`(first, end, bytes, offsets)` of runs of documents with about `limit` bytes each."""
    data, offsets = byte_view(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << np.uint8(5))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each word's document.

    A document's end ends its last word.
    """
    inside = np.ones(256, bool)
    inside[list(WORD_GAPS)] = False
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cuts[1:] - 1] |= word[cuts[1:] - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings between starts and ends."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    where = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    packed = np.ascontiguousarray(data[where])
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    )


def tiled_spans(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The byte strings between neighbouring cuts, without copying the bytes."""
    cuts = np.ascontiguousarray(cuts, np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial in the bytes, then scrambled with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=total[1:])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    terms = mix(data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1))
    terms *= powers(base | 1, int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, total[:-1]) + mix(lengths.astype(np.uint64)))


def character_classes() -> np.ndarray:
    """The class of every code point, one byte each, by the tables of the library that the ids must match."""
    cache = worker_cache()
    if "classes" not in cache:
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            matches = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            table[code_points(bytes(matches.encode_ordinary(points)).decode())] = kind
        cache["classes"] = table
    return cache["classes"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def character_offsets(coded: np.ndarray) -> np.ndarray:
    """Where each character of UTF-8 bytes begins, and the end."""
    return np.append(np.flatnonzero((coded & 0xC0) != 0x80), len(coded))


def byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls, as Python bytes."""
    data, offsets = byte_view(column)
    raw, cuts = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _contractions(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lengths of 's 't 'm 'd 're 've 'll among the apostrophes that may start a token.

    `stop` holds the end of the document of each position.
    """
    at = np.flatnonzero(start & (points == 39))
    ahead = lambda k: np.where(at + k < stop[at], points[np.minimum(at + k, len(points) - 1)], 0)
    one, two = ahead(1), ahead(2)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(short, 2, np.where(long, 3, 0))
    return at[size > 0], size[size > 0]


def pretoken_starts(points: np.ndarray, firsts: np.ndarray, spaced: bool) -> np.ndarray:
    """Where the pre-tokens start, as a mask over the code points of joined documents.

    `firsts` are the starts of the documents that are not empty. With `spaced`, a pre-token takes one
    blank before it, numbers are runs, and white space is kept; without, white space is left out by
    the caller and every number is a pre-token of its own.
    """
    n = len(points)
    kind = character_classes()[points]
    begin = np.zeros(n, bool)
    begin[firsts] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[begin] = 255
    start = kind != before
    stop = np.repeat(np.append(firsts[1:], n), np.diff(np.append(firsts, n)))
    if spaced:
        blank = points == 32
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1]
        after_blank &= ~begin
        solid = kind != SPACE
        # The last white space before a solid run leaves its run; a blank joins the run after it.
        leaves = np.zeros(n, bool)
        leaves[:-1] = (kind[:-1] == SPACE) & solid[1:] & ~begin[1:]
        joins = start & solid & after_blank
        may = start & (kind == OTHER) & ~after_blank
        start = (start & ~joins) | leaves
    else:
        start |= kind == NUMBER
        may = start & (kind == OTHER)
    at, size = _contractions(points, may, stop)
    if len(at):
        start[at + 1] = False
        end = at + size
        start[end[end < n]] = True
    start[firsts] = True
    return start
