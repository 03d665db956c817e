"""Licences named or quoted in documents, found through the positions of their rarest words.

The templates are phrases and notices of licences. A first pass counts in how many documents each of
their words stands. In the second, a file is a candidate for a template if it holds every word of the
template's mandatory phrases, beginning with the rarest. Of the template's words that the file holds, those
with the highest inverse document frequency are looked up: each place in the file less each place in the
template is a relative position, and places of different words that agree in it, within the
template's slack, are an alignment. An alignment counts if its mandatory phrases stand in it word by
word and enough of the template's words stand in their places.

A base phrase is a template without slack that is mandatory as a whole, so that every place where its
words stand consecutively is found. Templates are few and fixed by the caller; they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.llm import texts
from tierwatch.llm.lexical import Terms
from tierwatch.llm.spans import LOWER_WORD_BYTES, class_spans

ANCHORS = 6
SLACK = 3
LEAST_COVERAGE = 0.7

# Phrases that name a licence by themselves.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices of public licences, each with the phrases that may not be missing.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ("apache license version 2 0",)),
    ("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license as published", "version 3 of the license")),
    ("gpl-3", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3 0",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     ("gnu general public license as published", "version 2 of the license")),
    ("gpl-2", "spdx license identifier gpl 2 0", ("spdx license identifier gpl 2 0",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("bsd", "under the bsd license", ("under the bsd license",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
     ("neither the name of", "endorse or promote products")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("for any purpose with or without fee is hereby granted",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("epl-2", "eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("boost-1", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
     ("provided as is without any express or implied warranty", "in no event will the authors be held liable")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)


@dataclass(frozen=True)
class Template:
    """A text to look for, its mandatory phrases, and how far its words may be displaced."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    base: bool = False
    slack: int = SLACK

    def __post_init__(self):
        for phrase in self.phrases:
            if not phrase or self.place(phrase) < 0:
                raise ValueError(f"phrase {' '.join(phrase)!r} is not in the template of {self.label!r}")

    def place(self, phrase: tuple[str, ...]) -> int:
        n = len(phrase)
        return next((i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == phrase), -1)


def templates(base=BASE_PHRASES, notices=NOTICES) -> list[Template]:
    """Templates of base phrases (label, phrase) and of notices (label, text, mandatory phrases)."""
    own = [Template(label, w := tuple(text.split()), (w,), True, 0) for label, text in base]
    return own + [Template(label, tuple(text.split()), tuple(tuple(p.split()) for p in must)) for label, text, must in notices]


def vocabulary(known: list[Template]) -> list[str]:
    return sorted({w for t in known for w in t.words})


def located(column: pa.Array, terms: Terms) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every slice of documents: its first row, where each document's words begin (n + 1 places), and
    the places and numbers of the words that are in `terms`."""
    for first, _, data, offsets in texts.slices(column):
        data = texts.lower_ascii(data)
        starts, ends, owner = class_spans(data, offsets, LOWER_WORD_BYTES)
        hit, word = terms.find(data, starts, ends)
        yield first, np.searchsorted(owner, np.arange(len(offsets))), hit, word


def document_counts(docs: DataFrame, words: list[str]) -> np.ndarray:
    """In how many documents each of `words` stands, over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast([w.encode() for w in words])

    def count(batches) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value)
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, begin, hit, word in located(batch.column(0), terms):
                owner = np.searchsorted(begin, hit, "right") - 1
                total += np.bincount(np.unique(owner * len(words) + word) % len(words), minlength=len(words))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["word", "df"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "word int, df long")
    sums = found.groupBy("word").agg(F.sum("df").alias("df")).toArrow()  # one row for each word of the templates
    out = np.zeros(len(words), np.int64)
    out[sums.column("word").to_numpy()] = sums.column("df").to_numpy()
    return out


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the row of each of sum(c) items, and its number within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class Index:
    """Templates as numbers: postings of their words by rarity, and what is mandatory."""

    def __init__(self, known: list[Template], words: list[str], df: np.ndarray):
        number = {w: i for i, w in enumerate(words)}
        self.known, self.n_words = known, len(words)
        self.terms = Terms([w.encode() for w in words])
        rarity = np.lexsort((np.arange(len(words)), df))
        rank = np.empty(len(words), np.int64)
        rank[rarity] = np.arange(len(words))

        def padded(rows: list[list[int]]) -> np.ndarray:
            out = np.full((len(rows), max([len(r) for r in rows], default=1)), -1, np.int64)
            for i, r in enumerate(rows):
                out[i, : len(r)] = r
            return out

        self.text = padded([[number[w] for w in t.words] for t in known])
        self.sizes = np.array([len(t.words) for t in known], np.int64)
        by_rarity = lambda some: sorted({number[w] for w in some}, key=lambda i: rank[i])
        self.own = padded([by_rarity(t.words) for t in known])
        self.must = padded([by_rarity(w for p in t.phrases for w in p) for t in known])
        phrases = [(i, t.place(p), [number[w] for w in p]) for i, t in enumerate(known) for p in t.phrases]
        self.phrase_of = np.array([i for i, _, _ in phrases], np.int64)
        self.phrase_at = np.array([at for _, at, _ in phrases], np.int64)
        self.phrase_words = padded([w for _, _, w in phrases])
        self.slack = np.array([t.slack for t in known], np.int64)
        self.base = np.array([t.base for t in known], bool)
        # Templates by the rarest word that they cannot lack.
        self.by_first = np.argsort(self.must[:, 0], kind="stable")
        self.firsts = self.must[self.by_first, 0]
        # Places of each word in each template.
        t, q = np.nonzero(self.text >= 0)
        order = np.lexsort((q, self.text[t, q], t))
        self.place_key, self.place = (t * self.n_words + self.text[t, q])[order], q[order]

    def matches(self, begin: np.ndarray, hit: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents, templates, first and end places and coverages of all confirmed alignments of a slice."""
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
        if not len(hit) or not len(self.known):
            return none
        owner = np.searchsorted(begin, hit, "right") - 1
        full = np.full(int(begin[-1]), -1, np.int64)
        full[hit] = word
        order = np.lexsort((hit, word, owner))
        key, place = (owner * self.n_words + word)[order], hit[order]
        pairs = np.unique(key)
        # Candidates: documents with the rarest mandatory word, then with all of them.
        low, high = (np.searchsorted(self.firsts, pairs % self.n_words, side) for side in ("left", "right"))
        row, nth = _spread(high - low)
        doc, t = pairs[row] // self.n_words, self.by_first[low[row] + nth]
        wanted = self.must[t]
        doc, t = (x[(self._held(pairs, doc, wanted) | (wanted < 0)).all(axis=1)] for x in (doc, t))
        if not len(doc):
            return none
        # The highest-IDF words of the template that the file holds, at all their places.
        held = self._held(pairs, doc, self.own[t]) & (self.own[t] >= 0)
        chosen = held & (held.cumsum(axis=1) <= ANCHORS)
        pair, column = np.nonzero(chosen)
        anchor = self.own[t[pair], column]
        in_file, in_template = doc[pair] * self.n_words + anchor, t[pair] * self.n_words + anchor
        low, high = (np.searchsorted(key, in_file, side) for side in ("left", "right"))
        row, nth = _spread(high - low)
        p = place[low[row] + nth]
        low, high = (np.searchsorted(self.place_key, in_template[row], side) for side in ("left", "right"))
        again, nth = _spread(high - low)
        relative = p[again] - self.place[low[again] + nth]
        pair, anchor = pair[row[again]], anchor[row[again]]
        # Alignments: relative positions within the slack of the one before.
        order = np.lexsort((anchor, relative, pair))
        pair, relative, anchor = pair[order], relative[order], anchor[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (np.diff(relative) > self.slack[t[pair[1:]]])
        group = np.cumsum(new) - 1
        support = np.bincount(np.unique(group * self.n_words + anchor) // self.n_words, minlength=group[-1] + 1)
        n_anchors = chosen.sum(axis=1)
        group_pair = pair[new]
        need = np.where(self.base[t[group_pair]], n_anchors[group_pair], -(-n_anchors[group_pair] // 2))
        strong = support >= need
        some = strong[group]
        spots = np.unique(np.stack([group[some], relative[some]]), axis=1)
        group, relative = spots
        pair = group_pair[group]
        # Each phrase must stand at one of the alignment's relative positions.
        confirmed = strong.copy()
        for i, (of, at) in enumerate(zip(self.phrase_of, self.phrase_at)):
            mine = np.flatnonzero(t[pair] == of)
            if len(mine):
                words = self.phrase_words[i][self.phrase_words[i] >= 0]
                stands = self._stand(full, begin, doc[pair[mine]], relative[mine] + at, words).all(axis=1)
                found = np.zeros(len(strong), bool)
                found[group[mine[stands]]] = True
                confirmed &= found | (t[group_pair] != of)
        keep = confirmed[group]
        group, relative, pair = group[keep], relative[keep], pair[keep]
        out = []
        for of in np.unique(t[pair]).tolist():
            mine = np.flatnonzero(t[pair] == of)
            words = self.text[of, : self.sizes[of]]
            stands = self._stand(full, begin, doc[pair[mine]], relative[mine], words)
            heads = np.flatnonzero(np.diff(group[mine], prepend=-1))
            placed = np.logical_or.reduceat(stands, heads, axis=0)
            first = np.minimum.reduceat(np.where(stands, relative[mine][:, None] + np.arange(len(words)), len(full)).min(axis=1), heads)
            end = np.maximum.reduceat(np.where(stands, relative[mine][:, None] + np.arange(len(words)), -1).max(axis=1), heads) + 1
            owner = doc[pair[mine][heads]]
            out.append((owner, np.full(len(heads), of), first - begin[owner], end - begin[owner], placed.mean(axis=1)))
        if not out:
            return none
        doc, t, first, end, coverage = (np.concatenate(x) for x in zip(*out))
        good = coverage >= LEAST_COVERAGE
        order = np.flatnonzero(good)[np.lexsort((end[good], t[good], first[good], doc[good]))]
        return doc[order], t[order], first[order], end[order], coverage[order]

    def _held(self, pairs: np.ndarray, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
        wanted = doc[:, None] * self.n_words + np.maximum(words, 0)
        return pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted

    @staticmethod
    def _stand(full, begin, doc, start, words) -> np.ndarray:
        """Which of `words` stand at start, start + 1 ... within the document."""
        at = start[:, None] + np.arange(len(words))
        inside = (at >= begin[doc][:, None]) & (at < begin[doc + 1][:, None])
        return inside & (full[np.where(inside, at, 0)] == words)


FINDINGS = "array<struct<label:string,base:boolean,first_word:long,end_word:long,coverage:double>>"


def find_licences(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, findings.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A finding is a place
    where a template is confirmed: its label, whether it is a base phrase, its words from `first_word` to
    before `end_word`, counted from 0, and the share of the template's words that stand in their places. Null
    and empty texts have no words and no findings. Rows that repeat an id are searched each. Other columns
    are ignored; an empty table gives an empty result.
    """
    known = templates() if known is None else known
    words = vocabulary(known)
    plain = [(t.label, t.words, t.phrases, t.base, t.slack) for t in known]
    shared = docs.sparkSession.sparkContext.broadcast((plain, words, document_counts(docs, words)))

    def search(batches) -> Iterator[pa.RecordBatch]:
        plain, words, df = shared.value
        index = Index([Template(*t) for t in plain], words, df)
        labels = pa.array([t.label for t in index.known], pa.string())
        base = pa.array(index.base)
        for batch in batches:
            for first, begin, hit, word in located(batch.column(1), index.terms):
                n = len(begin) - 1
                doc, t, start, end, coverage = index.matches(begin, hit, word)
                offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays(
                    [labels.take(pa.array(t)), base.take(pa.array(t)), pa.array(start), pa.array(end), pa.array(coverage)],
                    ["label", "base", "first_word", "end_word", "coverage"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(begin)), pa.ListArray.from_arrays(pa.array(offsets), rows)],
                    ["doc_id", "n_words", "findings"],
                )

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(search, f"doc_id long, n_words long, findings {FINDINGS}")


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """`find_licences` in one line a document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    n_base counts the places of base phrases; first_word and last_word are their smallest and largest first
    word, null without one. Labels are distinct, sorted and joined by commas, an empty string without one.
    score is the largest coverage of a finding, 0 without one.
    """
    found = find_licences(docs, known).withColumn("base", F.filter("findings", lambda f: f["base"]))
    names = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda f: f["label"]))), ",")
    starts = F.transform("base", lambda f: f["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"),
        names("findings").alias("labels"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["coverage"])), F.lit(0.0)).alias("score"),
    )
