import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from tierwatch.llm import texts, wordtable

ALPHABET = "a b'sé \n\t  1२.,!’ſrelvmd  　\x1c\x85ǅ٣中'"


def joined(docs):
    whole = "".join(docs)
    lengths = np.array([len(d) for d in docs])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return whole, texts.code_points(whole), offsets[:-1][lengths > 0]


def pieces(docs, spaced):
    whole, points, firsts = joined(docs)
    at = [*np.flatnonzero(texts.pretoken_starts(points, firsts, spaced)).tolist(), len(points)]
    return [whole[a:b] for a, b in zip(at, at[1:])]


def test_pretokens_match_the_pattern():
    pick = random.Random(3)
    for _ in range(1500):
        docs = ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 12))) for _ in range(3)]
        if "".join(docs):
            assert pieces(docs, True) == [x for d in docs for x in regex.findall(public_tokenizers.PATTERN, d)]


def test_pretokens_of_single_numbers():
    plain = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    pick = random.Random(4)
    for _ in range(500):
        docs = [re.sub(r"\s+", " ", "".join(pick.choice(ALPHABET) for _ in range(9))) for _ in range(2)]
        assert [x for x in pieces(docs, False) if not x.isspace()] == [x for d in docs for x in regex.findall(plain, d)]


def test_words_end_with_their_document():
    docs = [b"ab cd", b"", b"ef\x0bg", b" ", b"h"]
    data, offsets = texts.byte_view(pa.array(docs, pa.binary()))
    starts, ends, owner = texts.word_spans(data, offsets)
    raw = data.tobytes()
    assert [(raw[a:b], o) for a, b, o in zip(starts, ends, owner)] == [
        (b"ab", 0), (b"cd", 0), (b"ef", 2), (b"g", 2), (b"h", 4),
    ]


def test_slices_cut_between_documents_and_keep_all():
    column = pa.array(["abc", None, "", "d" * 50, "é"])
    got = [(a, b, d.tobytes(), o.tolist()) for a, b, d, o in texts.slices(column, limit=4)]
    assert b"".join(g[2] for g in got) == ("abc" + "d" * 50 + "é").encode()
    assert [g[0] for g in got][0] == 0 and got[-1][1] == 5


def test_span_hashes_follow_the_bytes():
    data, offsets = texts.byte_view(pa.array(["same same other same!"]))
    starts, ends, _ = texts.word_spans(data, offsets)
    h = texts.span_hashes(data, starts, ends)
    assert h[0] == h[1] and len({int(x) for x in h}) == 3


def test_positions_and_blocks_round_trip():
    index = np.array([0, 1, 255, 256, 70_000, (1 << 24) - 1], np.uint32)
    assert wordtable.unpack_positions(wordtable.pack_positions(index)).tolist() == index.tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "b" * 30, None, "cc"])], ["text"])
    tables = list(wordtable.gathered([batch, batch], limit=10))
    assert [x for t in tables for x in t.column("text").to_pylist()] == ["aa", "b" * 30, None, "cc"] * 2


def test_classes_are_those_of_the_library():
    import tiktoken

    one = tiktoken.Encoding("c", pat_str=r"\p{L}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    for c in "aéß中1٣ _\x1c":
        assert (texts.character_classes()[ord(c)] == texts.LETTER) == bool(one.encode_ordinary(c)), c
    assert base64.b64encode(b"x")
