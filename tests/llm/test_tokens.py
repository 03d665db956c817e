import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import DOC_TYPE
from tierwatch.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS), special_tokens={}
    )


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_ids_are_those_of_the_library_and_decode_to_the_text(which, request, rows):
    got = bpe.encode(request.getfixturevalue(which), RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    encode = library().encode_ordinary
    expected = sorted(
        ((r[0], np.array(encode(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows), key=str
    )
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=str) == expected


def test_decoding_by_itself(spark):
    ids = np.array(library().encode_ordinary("déjà vu  !"), "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids)), (2, None), (3, bytearray())], "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, RANKS).collect()}
    assert bytes(got[1]).decode() == "déjà vu  !" and got[2] is None and bytes(got[3]) == b""


def test_small_blocks_give_the_same_ids(spark, rows, monkeypatch):
    from tierwatch.llm import wordtable

    monkeypatch.setattr(wordtable.gathered, "__defaults__", (2000, "text"))
    monkeypatch.setattr(wordtable.frequent_first, "__defaults__", (3,))
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 24], DOC_TYPE).coalesce(1)
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    encode = library().encode_ordinary
    assert got == {r[0]: np.array(encode(r[1]), "<u4").tobytes() for r in rows if r[0] is not None and r[0] < 24}


def test_encoding_nothing(nothing):
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN, decoded=True).collect() == []


def check_packing(got, rows, window=packing.WINDOW):
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = sorted(
        ((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows), key=str
    )
    # Documents of one id are told apart by their number of tokens.
    by_document = {}
    for p in got:
        by_document.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for doc_id, ids in wanted:
        pieces = by_document[doc_id, len(ids)]
        crcs = {(p["start"], p["length"]): p["ids_crc32"] for p in pieces}
        at = 0
        while at < len(ids):
            (length,) = {n for s, n in crcs if s == at}
            raw = np.array(ids[at : at + length], "<u4").tobytes()
            assert crcs[at, length] == zlib.crc32(raw)
            at += length
        assert at == len(ids)
    assert sum(p["length"] for p in got) == sum(len(ids) for _, ids in wanted)
    sequences = {}
    for p in sorted(got, key=lambda p: p["offset"]):
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(sequences.values(), default=0) <= window
    return sequences


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_packing_keeps_every_id_once(which, request, rows):
    sequences = check_packing(packing.pack(request.getfixturevalue(which), WORDS).collect(), rows)
    padding = sum(packing.WINDOW - n for n in sequences.values() if n & (n - 1))
    assert padding <= packing.LOOSE * packing.WINDOW * len(sequences)


def test_packing_in_small_groups(docs, rows):
    check_packing(packing.pack(docs, WORDS, group_pieces=7).collect(), rows)


def test_packing_nothing(nothing):
    assert packing.pack(nothing, WORDS).collect() == []


def test_ids_of_awkward_texts():
    texts = ["", " ", "It's I'LL <|endoftext|>", "ΣΑΣ ΟΔΟΣ İx é １2½", "́a", "a\x00b\x1cc \x85d", "it' s 're"]
    tokenizer = Tokenizer.from_file(WORDS)
    ids, offsets = packing.document_ids(texts, WORDS)
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]


def test_best_fit_takes_the_tightest_window():
    lengths = np.array([60, 50, 41, 40, 8])
    where, offset, n = packing.best_fit(lengths, 100)
    # 60+40 fills a window; 8 goes to the tighter of the two open ones.
    assert n == 2 and where.tolist() == [0, 1, 1, 0, 1] and offset.tolist() == [0, 0, 50, 60, 91]


def test_best_fit_matches_a_plain_search():
    random = np.random.default_rng(5)
    for _ in range(20):
        lengths = random.integers(1, 64, 200)
        where, _, n = packing.best_fit(lengths, 64)
        rooms = []
        for need in sorted(lengths.tolist(), reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= need]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= need
            else:
                rooms.append(64 - need)
        assert n == len(rooms) and sorted(np.bincount(where, lengths)) == sorted(64 - r for r in rooms)


def test_powers_leave_no_padding():
    random = np.random.default_rng(6)
    for _ in range(30):
        sizes = 1 << random.integers(0, 11, random.integers(0, 40))
        where, offset, n = packing.fill_powers(sizes)
        used = np.bincount(where, sizes, n).astype(int) if len(sizes) else np.zeros(0, int)
        assert all(u & (u - 1) == 0 for u in used) and used.sum() == sizes.sum()
        for w in range(n):
            own = sorted(zip(offset[where == w].tolist(), sizes[where == w].tolist()))
            assert [o for o, _ in own] == np.cumsum([0, *[s for _, s in own]])[:-1].tolist()


def test_ids_of_many_odd_texts():
    import random

    pick = random.Random(11)
    marks = ["İ", "̧", "̇", "́", "Σ", "ς", "ß", "Ǆ", "ﬁ", "中", "🙂", "İ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    plain = list("abcABC019 \t\n.,'<|>-_") + ["'s", "'LL", " the", " ", " ", "\u0085"]
    odd = ["".join(pick.choice(marks if pick.random() < 0.3 else plain) for _ in range(pick.randint(0, 14))) for _ in range(20_000)]
    ids, offsets = packing.document_ids(odd, WORDS)
    tokenizer = Tokenizer.from_file(WORDS)
    for i, text in enumerate(odd):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)


def test_digests_are_of_ids_and_bytes(docs, rows):
    import hashlib

    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect()
    encode, sha = library().encode_ordinary, lambda b: hashlib.sha256(b).hexdigest()
    expected = [
        (r[0], len(ids := encode(r[1] or "")), sha(np.array(ids, "<u4").tobytes()), sha((r[1] or "").encode())) for r in rows
    ]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
