import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwatch.llm import lexical, licences, vectorcode

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Vector codes


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [
        (i, [math.floor(256 * v) for v in x], label)
        for i, x, label in rows
        if x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    longest = max((len(x) for _, x, _ in kept), default=0)
    width = max(-(-longest // parts), 1)
    kept = [(i, x + [0] * (width * parts - len(x)), label) for i, x, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            members = {}
            for _, x, _ in kept:
                members.setdefault(nearest(p, cut(x, p))[1], []).append(cut(x, p))
            moved.append(
                [[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(books[p])]
            )
        books = moved
    found = [(i, [nearest(p, cut(x, p)) for p in range(parts)], label) for i, x, label in kept]
    by_label = {}
    for _, f, label in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    text = ",".join(str(c) for b in books for e in b for c in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), by_label[label], sha) for i, f, label in found),
        key=str,
    )


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    pick = random.Random(3)
    rows = [(i, [pick.choice([-0.5, -0.01, 0.0, 0.02, 0.3, 0.9]) for _ in range(32)], pick.choice([1, 2, None])) for i in range(150)]
    rows += [(i, [0.25] * 32, 7) for i in range(200, 240)]  # ties
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 32, 1), (403, [float("-inf")] * 32, 2)]
    rows += [rows[3], (5, [0.5] * 32, 1), (None, [0.75] * 32, 2), (405, [1.0, 2.0], 1), (406, [], 1), (407, [1e30] + [0.0] * 31, 3)]
    return rows


def test_codes_by_hand(spark, vectors):
    ordinary = vectors[:-1]
    frame = spark.createDataFrame(ordinary, VECTORS).repartition(3)
    got = sorted((tuple(r) for r in vectorcode.vector_codes(frame).collect()), key=str)
    assert got == codes_by_hand(ordinary)
    clashing = frame.withColumns({c: F.lit(1) for c in ("code", "error", "x", "label_error", "same_label", "slot")})
    assert sorted((tuple(r) for r in vectorcode.vector_codes(clashing).collect()), key=str) == got


def test_few_none_and_large_vectors(spark, vectors):
    few = [(4, [0.1, 0.2, 0.3], 1), (2, [0.1, 0.2, 0.9], None)]
    assert sorted((tuple(r) for r in vectorcode.vector_codes(spark.createDataFrame(few, VECTORS)).collect()), key=str) == codes_by_hand(few)
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        found = vectorcode.vector_codes(spark.createDataFrame(rows, VECTORS))
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert [r["error"] for r in found.collect()] == [0] * (rows == [(1, [], 1)])
    whole = vectorcode.vector_codes(spark.createDataFrame(vectors, VECTORS)).collect()
    assert len(whole) == len(codes_by_hand(vectors[:-1])) + 1 and all(r["error"] >= 0 for r in whole)


@pytest.mark.parametrize("width,spread", [(4, 300), (4, 3), (1, 2), (3, 1)])
def test_orchard_is_exact(width, spread):
    rng = np.random.default_rng(width * spread)
    book, parts = rng.integers(-spread, spread + 1, (64, width)), rng.integers(-spread, spread + 1, (3000, width))
    at, near = vectorcode.orchard(parts, book, vectorcode.neighbour_lists(book))
    gaps = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (at == gaps.argmin(axis=1)).all() and (near == gaps.min(axis=1)).all()


# Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(docs, items, k=10):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, n_tokens = len(found), sum(len(t) for _, t in found)
    counts = [(i, {x: t.count(x) for x in set(t)}, len(t)) for i, t in found]
    df = {}
    for _, c, _ in counts:
        for x in c:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        terms = {x for x in TERM.findall((text or "").translate(LOWER)) if x in df}
        w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) for x in terms}
        scored = []
        for i, c, n in counts:
            m = 10 + (90 * n * n_docs) // n_tokens
            s = sum(w[x] * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms if x in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, "alpha1 BETA2 gamma3 alpha1 - delta4"), (2, "alpha1 alpha2 alpha3 beta4 nothing_here"), (3, ""), (4, None), (4, "one two"),
    (None, "grüße ÖRTLICHKEIT x 中文"), (5, "the mail token no id here at all"), (6, "kappa" + " kappa7" * 50), (2, "omicron5 sigma6 rho9"),
]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def ranked(docs, items, **more):
    return sorted((tuple(r) for r in lexical.ranked_search(docs, items, **more).collect()), key=str)


def test_ranked_by_hand(spark, docs, rows, asked, clashing, monkeypatch):
    plain = [(r[0], r[1]) for r in rows]
    want = ranked_by_hand(plain, ITEMS)
    assert ranked(docs, asked) == want
    assert ranked(clashing, asked.withColumns({c: F.lit(1) for c in ("item", "rank", "nth", "score", "doc_id")})) == want
    monkeypatch.setattr(lexical, "SHARD_BYTES", 900)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 2)
    monkeypatch.setattr(lexical, "FIRST_TAKE", 1)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    assert ranked(docs, asked) == want
    assert ranked(docs, asked, k=3) == ranked_by_hand(plain, ITEMS, 3)


def test_ranked_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 600)
    pick = random.Random(8)
    plain = [(pick.randint(0, 400), " ".join(pick.choice("abcdefgh") for _ in range(pick.choice([1, 2, 3, 9])))) for _ in range(500)]
    plain += [(i, "same words a b") for i in range(500, 700)]
    docs = spark.createDataFrame(plain, "doc_id long, text string").repartition(4)
    items = [(1, "a b c"), (2, "same words"), (3, "h"), (4, "a b c d e f g h same words")]
    assert ranked(docs, spark.createDataFrame(items, "item_id long, text string")) == ranked_by_hand(plain, items)


def test_ranked_on_empty_tables(spark, docs, asked, nothing):
    assert ranked(nothing, asked) == []
    assert ranked(docs, asked.limit(0)) == []
    assert ranked(nothing, asked.limit(0)) == []


# Licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
GPL = """GNU General Public License as published by the Free Software Foundation, either version 3
 * of the License, or (at your option) any later version."""

LICENSED = [
    (1, "Released under the MIT License."), (2, "x. Licensed under the Apache License, Version 2.0. Under\nthe MIT   license!"),
    (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0. cc-by-nc, CC/BY/NC"),
    (5, None), (6, ""), (7, "under the mit licence; apache license 2; by nc cc"), (8, "no words of that kind at all"), (9, "/* " + MIT + " */ " + GPL),
    (10, MIT.replace("this software", "this fine software")), (11, "license " * 3000 + "under the mit license " * 500), (1, "under the mit license"),
    (None, "UNDER THE MIT LICENSE"), (12, "Under the MİT license, under the mit licenseé, xunder the mit license"),
    (13, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (14, "gnu general public license as published and nothing more, version 3 of the license"), (15, "permission is hereby granted free of charge, he said"),
]


def base_by_hand(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [
        (i, label)
        for label, phrase in licences.BASE_PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


@pytest.fixture(scope="module")
def licensed(spark):
    return spark.createDataFrame(LICENSED, "doc_id long, text string").repartition(3)


def test_base_phrases_by_hand(spark, licensed, docs, rows, clashing):
    for frame, plain in ((licensed, LICENSED), (docs, rows), (clashing, rows)):
        got = licences.scan(frame).drop("labels", "score").collect()
        assert sorted(map(tuple, got), key=str) == sorted(((r[0], *base_by_hand(r[1])) for r in plain), key=str)


def test_notices(licensed):
    found = {r["doc_id"]: r for r in licences.scan(licensed).collect() if r["doc_id"] not in (None, 1)}
    labels = {i: r["labels"] for i, r in found.items()}
    assert labels[2] == "apache-2,mit" and labels[3] == "gpl-3" and labels[4] == "cc-by-nc"
    assert labels[9] == "gpl-3,mit" and labels[10] == "mit" and labels[13] == "bsd" and labels[11] == "mit"
    assert all(labels[i] == "" and found[i]["score"] == 0 for i in (5, 6, 7, 8, 14, 15))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[3]["n_base"] == 0 and found[3]["base_labels"] == "" and found[3]["first_word"] is None


def test_places_of_findings(licensed):
    rows = {r["doc_id"]: r["findings"] for r in licences.find_licences(licensed).collect()}
    words = WORD.findall(dict(LICENSED)[9].translate(LOWER))
    mit, gpl = sorted(rows[9], key=lambda f: f["first_word"])
    assert words[mit["first_word"] : mit["end_word"]] == WORD.findall(MIT.translate(LOWER)) and mit["coverage"] == 1
    assert words[gpl["first_word"]] == "gnu" and words[gpl["end_word"] - 1] == "version"


def test_own_templates_and_no_rows(spark, licensed, nothing):
    own = licences.templates((("z", "of that kind"), ("zz", "at at all")), ())
    got = {r["doc_id"]: r["labels"] for r in licences.scan(licensed, own).collect()}
    assert got[8] == "z" and {v for i, v in got.items() if i != 8} == {""}
    assert licences.scan(nothing).collect() == []
    assert licences.scan(licensed, []).where("labels != ''").count() == 0
    with pytest.raises(ValueError):
        licences.templates((), (("a", "some words", ("other words",)),))
