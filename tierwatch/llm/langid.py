"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors, each
permuted by its place; a text is the bundle (sum) of its trigrams. Languages are the bundles of their
texts, and a text gets the language whose prototype has the largest cosine with its own bundle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.llm import texts
from tierwatch.llm.folds import held_out

DIMENSIONS = 1024
SLICE_BYTES = 384 << 10
CACHED_TRIGRAMS = 60_000
CELLS = 4 << 20
UNKNOWN = "und"
_POINT_BITS = np.uint64(21)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of each code point, from a scramble of its number."""
    lanes = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = texts.mix(texts.mix(points.astype(np.uint64) + np.uint64(77))[:, None] + lanes * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    mask = (np.uint64(1) << _POINT_BITS) - np.uint64(1)
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(3):
        letters, at = np.unique((grams >> (_POINT_BITS * np.uint64(place))) & mask, return_inverse=True)
        out *= np.roll(letter_vectors(letters), place, axis=1)[at]
    return out


def cached_vectors(grams: np.ndarray) -> np.ndarray:
    """`trigram_vectors`, each made once per worker."""
    cache = texts.worker_cache()
    known, table = cache.get("trigrams", ({}, np.zeros((0, DIMENSIONS), np.int8)))
    if len(known) > CACHED_TRIGRAMS:
        known, table = {}, table[:0]
    values = grams.tolist()
    new = [g for g in values if g not in known]
    if new:
        known.update(zip(new, range(len(known), len(known) + len(new))))
        table = np.concatenate([table, trigram_vectors(np.array(new, np.uint64))])
    cache["trigrams"] = known, table
    return table[[known[g] for g in values]]


def trigrams(documents: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams, position of each trigram among them, its document, letters per document).

    Letters are lower-cased; each run of other characters, and each end of a text, is one blank.
    """
    clean = [f" {(d or '').lower()} " for d in documents]
    points = texts.code_points("".join(clean)).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    letter = texts.character_classes()[points] == texts.LETTER
    letters = np.bincount(owner[letter], minlength=len(clean))
    same = np.zeros(len(points), bool)
    same[1:] = owner[1:] == owner[:-1]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | ~same[1:]
    points, owner = np.where(letter, points, np.uint64(32))[keep], owner[keep]
    whole = np.flatnonzero(owner[2:] == owner[:-2])
    grams = (points[whole] << (_POINT_BITS * np.uint64(2))) | (points[whole + 1] << _POINT_BITS) | points[whole + 2]
    coded = pa.array(grams).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(), owner[whole], letters


def _bundles(grams: np.ndarray, index: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of the vectors of each document's trigrams, over blocks of documents with at most `CELLS`
    counts (a single document is never cut). The sums are whole numbers, so blocks do not change them."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    step = max(1, CELLS // len(grams))
    begin = np.searchsorted(owner, np.arange(0, n + step, step))
    for first, a, b in zip(range(0, n, step), begin.tolist(), begin[1:].tolist()):
        if a == b:
            continue
        rows = min(step, n - first)
        some, at = np.unique(index[a:b], return_inverse=True)
        counts = np.bincount((owner[a:b] - first) * len(some) + at, minlength=rows * len(some)).reshape(rows, -1)
        out[first : first + rows] = counts.astype(np.float32) @ cached_vectors(grams[some]).astype(np.float32)
    return out


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray

    def predict(self, documents: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, index, owner, letters = trigrams(documents)
        if not self.languages or not len(grams):
            return [UNKNOWN] * len(documents), np.zeros(len(documents))
        bundle = _bundles(grams, index, owner, len(documents))
        size = np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)
        cosine = (bundle @ self.vectors.T) / size[:, None]
        best = np.argmax(cosine, axis=1)
        none = letters == 0
        score = np.where(none, 0.0, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0))
        return [UNKNOWN if n else self.languages[b] for n, b in zip(none.tolist(), best.tolist())], score


def learn(docs: DataFrame) -> Prototypes:
    """Prototypes of the languages in `docs` (lang, text); rows without a language or text are left out.

    Each task sends one bundle per language, in whole numbers, so the sum does not depend on the order.
    The driver receives one row per language.
    """

    def bundle(batches) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, end, _, _ in texts.slices(batch.column(1), SLICE_BYTES):
                names, code = np.unique(np.array(langs[first:end], object).astype(str), return_inverse=True)
                grams, index, owner, _ = trigrams(batch.column(1).slice(first, end - first).to_pylist())
                if not len(grams):
                    continue
                cells = np.bincount(code[owner] * len(grams) + index, minlength=len(names) * len(grams))
                sums = cells.reshape(len(names), -1).astype(np.float64) @ cached_vectors(grams).astype(np.float64)
                for name, row in zip(names.tolist(), sums.astype(np.int64)):
                    total[name] = total.get(name, 0) + row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))],
            ["lang", "cells"],
        )

    labelled = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    sums = (
        labelled.mapInArrow(bundle, "lang string, cells array<long>")
        .select("lang", F.posexplode("cells").alias("at", "cell"))
        .groupBy("lang", "at")
        .agg(F.sum("cell").alias("cell"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "cell"))).alias("cells"))
    )
    rows = sorted((r["lang"], [c["cell"] for c in r["cells"]]) for r in sums.collect())
    vectors = np.array([v for _, v in rows], np.float64).reshape(len(rows), DIMENSIONS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Prototypes([name for name, _ in rows], vectors.astype(np.float32))


def identify(docs: DataFrame, model: Prototypes) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def predict(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in texts.slices(batch.column(1), SLICE_BYTES):
                names, score = model.predict(batch.column(1).slice(first, end - first).to_pylist())
                ids = batch.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names, pa.string()), pa.array(score.astype(np.float64))],
                    ["doc_id", "lang_pred", "score"],
                )

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return whole.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (the cosine, at least 0).

    Texts that are null or have no letter are `und` with score 0; so is everything if there is nothing
    to learn from. Of equal cosines the language that sorts first is taken. A null doc_id is held out.
    Other columns are ignored; an empty table gives an empty result.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, learn(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
