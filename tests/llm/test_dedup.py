import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import DOC_TYPE, prose
from tierwatch.llm import exactdup, links, neardup


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_by_hand(rows):
    ids, sizes = {}, Counter(clean(r[1]) for r in rows)
    for r in rows:
        t = clean(r[1])
        ids[t] = min((i for i in (ids.get(t), r[0]) if i is not None), default=None)
    return sorted(
        (
            (r[0], ids[clean(r[1])], sizes[clean(r[1])], r[0] == ids[clean(r[1])],
             hashlib.sha256(clean(r[1]).encode()).hexdigest())
            for r in rows
        ),
        key=str,
    )


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_exact_duplicates_by_hand(which, request, rows):
    got = exactdup.exact_duplicates(request.getfixturevalue(which)).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact_by_hand(rows)


def test_exact_duplicates_of_nothing(nothing):
    assert exactdup.exact_duplicates(nothing).collect() == []
    assert exactdup.distinct_documents(nothing).collect() == []


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}", None, None, None) for i in range(600)]
    got = {r["doc_id"]: r for r in exactdup.exact_duplicates(spark.createDataFrame(rows, DOC_TYPE)).collect()}
    assert got[300]["keep_id"] == 0 and got[300]["group_size"] == 200 and got[1]["kept"]
    assert sum(r["kept"] for r in got.values()) == 401


def test_distinct_documents_keep_columns_and_one_row(clashing, rows):
    kept = exactdup.distinct_documents(clashing)
    assert kept.columns == clashing.columns
    got = Counter((r["doc_id"], clean(r["text"])) for r in kept.collect())
    assert got == Counter({(d, k) for d, _, _, keep, h in exact_by_hand(rows) if keep for k in [
        next(clean(r[1]) for r in rows if r[0] == d and hashlib.sha256(clean(r[1]).encode()).hexdigest() == h)]})


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def near_by_hand(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        name = min(least[find(i)], default=None)
        out.append((r[0], len(sets[i]), name, name is None or r[0] == name))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_near_duplicates_by_hand(which, request, rows):
    got = neardup.near_duplicates(request.getfixturevalue(which)).collect()
    # A row without an id is never kept by comparison with a name that others give.
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted(
        r[:3] for r in near_by_hand(rows) if r[0] is not None
    )
    assert {r["doc_id"] for r in got if r["kept"]} == {r[0] for r in near_by_hand(rows) if r[3]}


def test_near_duplicates_of_nothing(nothing):
    assert neardup.near_duplicates(nothing).collect() == []


def test_a_chain_of_near_copies_is_one_component(spark):
    base = prose(120, 1).split()
    rows, text = [], list(base)
    for i in range(12):  # each step changes one more word, the ends share less than the threshold
        rows.append((i, " ".join(text), None, None, None))
        text[(i * 11) % 120] = f"new{i}"
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC_TYPE)).collect()}
    assert set(got.values()) == {0}
    assert 100 * len(shingles(rows[0][1]) & shingles(rows[11][1])) < 75 * len(shingles(rows[0][1]) | shingles(rows[11][1]))


def test_cells_connect_what_is_alike_and_send_few_links(spark):
    packed = [neardup.pack_set(np.sort(np.arange(40, dtype=np.uint64) + np.uint64(100 * (i % 2)) << np.uint64(20))) for i in range(11)]
    rows = [(key, i, i % 5, bytearray(128), bytearray(packed[i]), 11, 0) for i in range(11) for key in (1, 2)]
    shape = "key long, row long, component long, sketch binary, hashes binary, size long, top long"
    for cell_rows in (3, 100):
        got = {(r["a"], r["b"]) for r in neardup.links_in_cells(spark.createDataFrame(rows, shape), 70, 75, cell_rows).collect()}
        assert all(a % 2 == b % 2 and a % 5 != b % 5 for a, b in got)
        parent = list(range(5))  # over the components
        for a, b in got:
            x, y = parent[a % 5], parent[b % 5]
            parent = [x if p == y else p for p in parent]
        assert len(set(parent)) == 1  # rows 0, 5, 10 join even and odd ones
        if cell_rows == 100:
            assert len(got) <= 4


def test_a_bucket_of_many_components_is_met_whole_in_cells(spark):
    """Rows that share one band only, very many of them outside the largest component, lose no link."""
    packed = [neardup.pack_set(np.sort(np.arange(8, dtype=np.uint64) + np.uint64(100 * (i // 2)) << np.uint64(20))) for i in range(120)]
    rows = [(1, i, i, bytearray(128), bytearray(packed[i]), 120, 0, 119) for i in range(120)]
    shape = "key long, row long, component long, sketch binary, hashes binary, size long, top long, outside long"
    got = {(r["a"], r["b"]) for r in neardup.links_in_cells(spark.createDataFrame(rows, shape), 70, 75, 16).collect()}
    assert got == {(i, i + 1) for i in range(0, 120, 2)}


def test_no_row_comes_to_a_cell_twice(spark):
    rows = [(1, i, i // 2, bytearray(128), bytearray(6), 40, 0, 38) for i in range(40)]
    shape = "key long, row long, component long, sketch binary, hashes binary, size long, top long, outside long"
    for cell_rows in (7, 1024):
        dealt = neardup.dealt_cells(spark.createDataFrame(rows, shape), cell_rows).collect()
        assert len({(r["part"], r["chunk"], r["row"]) for r in dealt}) == len(dealt)
        met = {(a["row"], b["row"]) for a in dealt if a["asks"] for b in dealt if b["asked"] and (a["part"], a["chunk"]) == (b["part"], b["chunk"])}
        assert met == {(a, b) for a in range(2, 40) for b in range(40)}
        if cell_rows == 1024:
            assert len(dealt) == 40


def test_buckets_are_dealt_by_key_once(spark, monkeypatch):
    from pyspark.sql import DataFrame

    plans = []
    staged = neardup.stage

    def watched(df: DataFrame, label: str, **options):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, label, **options)

    monkeypatch.setattr(neardup, "stage", watched)
    rows = [(i, [7] + [1000 * i + b for b in range(1, 32)], bytearray(128)) for i in range(4)]
    full = spark.createDataFrame([(i, bytearray(neardup.pack_set(np.arange(8, dtype=np.uint64) << np.uint64(20)))) for i in range(4)], "row long, hashes binary")
    got = neardup.linked_rows(spark.createDataFrame(rows, "row long, bands array<long>, sketch binary"), full).collect()
    assert {r["component"] for r in got} == {0}
    plan = dict(plans)["buckets"]
    # The same exchange by key under the counts and under the join, which Spark runs once.
    dealt = [line.split("hashpartitioning")[1].split(",")[0] for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len(dealt) == 2 and all(key.startswith("(key") for key in dealt)


def test_rows_that_share_one_band_are_linked_at_any_size_of_the_bucket(spark, monkeypatch):
    sets = [np.sort(np.arange(8, dtype=np.uint64) + np.uint64(1000 + 100 * (i // 2)) << np.uint64(20)) for i in range(24)]
    # One band is common to all rows, every other one is a row's own.
    rows = [(i, [7] + [1000 * i + b for b in range(1, 32)], bytearray(128)) for i in range(24)]
    table = spark.createDataFrame(rows, "row long, bands array<long>, sketch binary")
    full = spark.createDataFrame([(i, bytearray(neardup.pack_set(s))) for i, s in enumerate(sets)], "row long, hashes binary")
    for rows_a_cell in (1024, 4):
        monkeypatch.setattr(neardup, "CELL_ROWS", rows_a_cell)
        got = {r["node"]: r["component"] for r in neardup.linked_rows(table, full).collect()}
        assert got == {i: i - i % 2 for i in range(24)}


def test_a_large_group_of_loose_copies(spark, monkeypatch):
    """A group in which most pairs are below the threshold, found whole by every way of searching."""
    import random

    pick, base, rows = random.Random(5), prose(100, 3).split(), []
    for i in range(60):
        text = list(base)
        for at in pick.sample(range(100), 3):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text), None, None, None))
    expected = {r[0]: r[2] for r in near_by_hand(rows)}
    for rows_a_cell in (1024, 2):  # with 2, buckets are cut by a second band
        monkeypatch.setattr(neardup, "CELL_ROWS", rows_a_cell)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC_TYPE)).collect()}
        assert got == expected


def test_recall_of_pairs_at_the_threshold(spark):
    rows = []
    for i in range(300):
        words = [f"w{i}x{j}" for j in range(200)]
        changed = words[: 200 - (22 + i % 7)] + [f"v{i}x{j}" for j in range(22 + i % 7)]  # 0.75 to 0.80
        rows += [(2 * i, " ".join(words), None, None, None), (2 * i + 1, " ".join(changed), None, None, None)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC_TYPE)).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(300)]
    assert all(got[2 * i] == 2 * i for i in range(300)) and sum(linked) >= 0.99 * len(linked)


def test_sets_round_trip_and_signatures_estimate():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 900).astype(np.uint64))
    assert neardup.unpack_set(neardup.pack_set(a)).tolist() == (a >> np.uint64(16)).tolist()
    one, two = a[:800], a[100:]
    s = neardup.signatures([one, two])
    assert abs((s[0] == s[1]).mean() - 700 / len(a)) < 0.15


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (8, 9), (7, 7), (20, 9), *[(100 + i, 99 + i) for i in range(30)]]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8, **{99 + i: 99 for i in range(31)}}


def test_one_of_each_keeps_rows_without_id(clashing, rows):
    got = neardup.one_of_each(clashing)
    assert got.columns == clashing.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert None in ids and 104 not in ids and 5 in ids
