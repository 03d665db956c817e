import math
import re

import pytest

from tierwatch.llm import surrogates, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every=20, k=20):
    """Every row by itself, also those that repeat an id."""
    sound = [
        (i, [float(math.floor(64 * v)) for v in x])
        for i, x, _ in rows
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    out = []
    for at, (q, a) in enumerate(sound):
        if q % every:
            continue
        scored = []
        for other, (c, b) in enumerate(sound):
            if other != at:
                n = max(len(a), len(b))
                pad = lambda v: v + [0.0] * (n - len(v))
                scored.append((-int(sum(int(x) * int(y) for x, y in zip(pad(a), pad(b)))), c))
        out += [(q, r, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    import random

    pick = random.Random(9)
    rows = [(i, [float(pick.randint(-9, 9)) / 8 for _ in range(6)], 0) for i in range(130)]
    rows += [(i, [0.5] * 6, 0) for i in range(200, 260)]  # ties
    rows += [(400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0)]
    rows += [(404, [1.0, 2.0], 0), (405, [], 0), (None, [1.0] * 6, 0), rows[3], (7, [0.25] * 6, 0)]
    return rows


def test_top_k_by_hand(spark, vectors, monkeypatch):
    expected = by_hand(vectors)
    frame = spark.createDataFrame(vectors, VECTORS)
    for shard, tile, block, fan in ((4096, 256, 16 << 20, 8), (10, 2, 1000, 2)):
        monkeypatch.setattr(topk, "SHARD_ROWS", shard)
        monkeypatch.setattr(topk, "TILE_ROWS", tile)
        monkeypatch.setattr(topk, "BLOCK_BYTES", block)
        cells = topk.numbered(topk.quantised(frame.repartition(5)))
        got = topk.top_k(cells.where("vec_id % 20 = 0"), cells, 20, fan).collect()
        assert sorted(tuple(r) for r in got) == expected


def test_rows_that_repeat_an_id_are_candidates(spark):
    rows = [(20, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (1, [3.0, 0.0], 0), (2, [1.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = topk.search_embeddings(frame).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 12_288), (1, 8_192), (2, 4_096)]
    from pyspark.sql import functions as F

    clashing = frame.withColumns({c: F.lit(7) for c in ("tile", "shard", "rank", "row", "cells", "score", "query", "query_id")})
    assert sorted(map(tuple, topk.search_embeddings(clashing).collect())) == sorted(map(tuple, got))


def test_top_k_with_few_rows_and_large_numbers(spark):
    rows = [(0, [1e17, 3.0], 0), (1, [1e17, 1.0], 0), (2, [-1e17, 5.0], 0), (20, [0.015625, 1.0], 0)]
    got = sorted(tuple(r) for r in topk.search_embeddings(spark.createDataFrame(rows, VECTORS)).collect())
    exact = [(q, r, c, s) for q, r, c, s in by_hand([(i, [float(v) for v in x], n) for i, x, n in
                                                     [(i, spark_floats(x), n) for i, x, n in rows]])]
    assert got == exact
    assert topk.search_embeddings(spark.createDataFrame([], VECTORS)).collect() == []
    assert topk.search_embeddings(spark.createDataFrame([rows[0]], VECTORS)).collect() == []


def spark_floats(x):
    import struct

    return [struct.unpack("f", struct.pack("f", v))[0] for v in x]


TEXTS = [
    (1, "Mail John.Smith@Example.co.uk or john.smith@example.co.uk, call +1 (017) 555-7713 / +1 017 555 7713."),
    (2, "Frau Petra Schmidt traf Herr Schmidt und Mr. John Smith; John Smith. 4111 1111 1111 1111, 4111111111111111"),
    (3, None),
    (4, ""),
    (5, "г-жа Анна Петрова at 10.2.33.254"),
    (6, "clean text, 123 and v1.2.3, 2024-01-02"),
    (2, "SSN 123-45-6789 UND.34@MAIL7.EXAMPLE.COM!!"),
    (None, "a@b.de c@d.de"),
    (7, "IBAN GB29 NWBK 6016 1331 9268 19 or GB29NWBK60161331926819, not NU20 GAMMA17 UPSILON88 RHO3"),
]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = surrogates.with_surrogates(spark.createDataFrame(TEXTS, "doc_id long, text string"), "k").collect()
    return {(r["doc_id"], r["n_entities"]): r["text"] for r in rows}


def test_surrogates_keep_format_and_coreference(replaced):
    one = replaced[1, 4]
    found = re.fullmatch(r"Mail (\w{4}\.\w{5}@\w{7}\.\w\w\.uk) or (\S+), call (\+\d \(\d{3}\) \d{3}-\d{4}) / (\+\d [\d ]+)\.", one)
    assert found and found[1].lower() == found[2] and re.sub(r"\D", "", found[3]) == re.sub(r"\D", "", found[4])
    assert "Smith" not in one and "555-7713" not in one


def test_surrogates_of_persons_keep_titles_and_identity(replaced):
    two = replaced[2, 6] if (2, 6) in replaced else next(v for (d, n), v in replaced.items() if d == 2 and n > 3)
    m = re.match(r"Frau (\w+) (\w+) traf Herr (\w+) und Mr\. (\w+) (\w+); (\w+) (\w+)\. ([\d ]+), (\d+)$", two)
    assert m and m[2] == m[3] and (m[4], m[5]) == (m[6], m[7]) and m[8].replace(" ", "") == m[9]
    assert m[1].endswith("a") and not m[4].endswith("a")
    digits = [int(d) for d in reversed(m[9])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_of_accounts_keep_country_and_grouping(replaced):
    seven = replaced[7, 2]
    m = re.fullmatch(r"IBAN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) or (GB\d\d[A-Z]{4}\d{14}), not NU20 GAMMA17 UPSILON88 RHO3", seven)
    assert m and m[1].replace(" ", "") == m[2] != "GB29NWBK60161331926819"


def test_surrogates_leave_the_rest_alone(replaced):
    assert replaced[3, 0] is None and replaced[4, 0] == "" and replaced[6, 0] == TEXTS[5][1]
    five = replaced[5, 2]
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+ at \d\d\.\d\.\d\d\.\d{3}", five) and "Анна" not in five
    assert len(replaced) == len(TEXTS)


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"from {a}.{b}.1.1 by x@y{chr(97 + i % 26)}.de") for i, (a, b) in enumerate((a, b) for a in range(1, 10) for b in range(1, 10))]
    got = surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    new = {r["doc_id"]: r["text"].split()[1] for r in got}
    assert len(set(new.values())) == 81 and not set(new.values()) & {t.split()[1] for _, t in rows}
    mails = {}
    for i, t in rows:
        mails.setdefault(t.split()[3], set()).add(next(r["text"] for r in got if r["doc_id"] == i).split()[3])
    assert all(len(v) == 1 for v in mails.values()) and len({next(iter(v)) for v in mails.values()}) == 26


def test_surrogates_by_key_and_of_awkward_tables(spark, clashing, nothing, rows):
    df = spark.createDataFrame(TEXTS[:1], "doc_id long, text string")
    one, two = (surrogates.with_surrogates(df, k).first()["text"] for k in ("k", "other"))
    assert one != two and one == surrogates.with_surrogates(df, "k").first()["text"]
    assert surrogates.with_surrogates(nothing, "k").collect() == []
    got = {(r["doc_id"], r["text"]) for r in surrogates.with_surrogates(clashing, "k").collect()}
    same = {(r[0], r[1]) for r in rows if not (r[0] == 110 and "mail" in r[1])}
    assert same <= got and len(got) == len(same) + 1


def test_usual_phones_and_mails_are_replaced_whole(spark):
    from tierwatch.llm import surrogates as module

    whole = [
        "555-123-4567", "030 1234567", "+33 1 42 68 53 00", "+33 6 12 34 56 78", "+49 30 12 34 56 78", "06 12 34 56 78",
        "+1 (555) 123-4567", "(555) 123-4567", "0171/1234567", "+4915112345678",
    ]
    rows = [(i, f"call {v} now", None, None, 0) for i, v in enumerate(whole)]
    rows += [(100, "mail bob@example.com-y now", None, None, 0), (101, "mail bob@example.com.1 now", None, None, 0)]
    left = ["on 01-02-2024 and 05.06.2023", "version 1.2.3, 12345 items, 2024-01-02 10:30"]
    rows += [(200 + i, t, None, None, 0) for i, t in enumerate(left)]
    types = "doc_id long, text string, lang string, source string, n_chars long"
    got = {r["doc_id"]: r for r in module.with_surrogates(spark.createDataFrame(rows, types), "k").collect()}
    shape = lambda t: "".join("0" if c.isdigit() else c for c in t)
    for i, v in enumerate(whole):
        text = got[i]["text"]
        assert got[i]["n_entities"] == 1 and shape(text) == shape(rows[i][1]), (v, text)
        assert v not in text and len({c for c, d in zip(text, rows[i][1]) if c != d}) >= 3
        assert text.split(" now")[0][-2:] != v[-2:] or text.split(" now")[0][-4:] != v[-4:], (v, text)
    assert all("bob@example" not in got[i]["text"] and got[i]["n_entities"] == 1 for i in (100, 101))
    assert got[100]["text"].endswith(".com-y now") and got[101]["text"].endswith(".com.1 now")
    assert [got[200 + i]["text"] for i in range(2)] == left
    kind = lambda v: spark.range(1).select(module.kind_of(module.F.lit(v))).first()[0]
    assert [kind(v) for v in ("012-34-5678", "0123 4567 8901 2345", "10.20.30.40")] == ["ssn", "card", "ip"]


def test_names_and_numbers_that_stayed_in_clear(spark):
    types = "doc_id long, text string"
    cases = {
        "met Alice Johnson there": r"met (?!Alice)[A-Z][a-z]+ (?!Johnson)[A-Z][a-z]+ there",
        "met MARY SMITH there": r"met (?!MARY)[A-Z]+ (?!SMITH)[A-Z]+ there",
        "met John  Smith there": r"met (?!John)[A-Z][a-z]+  (?!Smith)[A-Z][a-z]+ there",
        "ask Mr McDonald.": r"ask Mr (?!McDonald)[A-Z][a-z]+\.",
        "ask Mr O'Brien.": r"ask Mr (?!O'Brien)[A-Z][a-z]+\.",
        "saw Priya Patel": r"saw (?!Priya)[A-Z][a-z]+ (?!Patel)[A-Z][a-z]+",
        "call 5551234567 now": r"call (?!5551234567)\d{10} now",
        "host fe80::1 up": r"host (?!fe80::1)[0-9a-f]{4}::[0-9a-f] up",
        "host 2001:DB8:0:0:8:800:200C:417A.": r"host (?!2001)[0-9A-F]{4}:[0-9A-F]{3}:[0-9A-F]:[0-9A-F]:[0-9A-F]:[0-9A-F]{3}:[0-9A-F]{4}:[0-9A-F]{4}\.",
        "ring 0049 30 123456": r"ring 00(?!49 30 123456)\d\d \d\d \d{6}",
        "Mr Smith came. Later Smith left; SMITH's coat, Smithson not": r"Mr (\w+) came\. Later (\w+) left; (\w+)'s coat, Smithson not",
    }
    left = ["at 10:30:00 and 12:15", "std::vector and add::be", "order 5551234567 of 2024", "Later Smith left", "ratio 1:2:3:4"]
    rows = list(enumerate([*cases, *left]))
    got = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(spark.createDataFrame(rows, types), "k").collect()}
    for i, (text, pattern) in enumerate(cases.items()):
        assert re.fullmatch(pattern, got[i]) and got[i] != text, (text, got[i])
    one, two, loud = re.fullmatch(cases["Mr Smith came. Later Smith left; SMITH's coat, Smithson not"], got[len(cases) - 1]).groups()
    assert one == two != "Smith" and loud == one.upper()
    assert one == re.match(r"met \w+  (\w+)", got[2])[1]  # the same name in another document
    assert [got[len(cases) + i] for i in range(len(left))] == left


def test_a_long_text_with_many_entities_and_ties(spark):
    text = " ".join(f"Mr Smith wrote to x{i % 40}@mail.example.com from 10.0.{i % 5}.1;" for i in range(3000))
    got = surrogates.with_surrogates(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), "k").collect()
    assert [r["n_entities"] for r in got] == [9000, 9000] and got[0]["text"] == got[1]["text"]
    words = got[0]["text"].split()
    assert "Smith" not in words and len(set(words[1::7])) == 1 and len(set(words[4::7])) == 40 and len(set(words[6::7])) == 5
