"""Words of any class of bytes in flat arrays of documents."""

from __future__ import annotations

import numpy as np


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# ASCII letters and digits, and every byte of a character beyond ASCII.
TERM_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# The same for texts whose A-Z are in lower case.
LOWER_WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def class_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of the class `inside`, and each run's document.

    A document's end ends its last run.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = inside[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | fresh[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | fresh[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1
