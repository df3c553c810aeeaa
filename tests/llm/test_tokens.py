import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import bpe, packing

HARD = ["", " ", "\n\n  \t x", "Hello, world!", "don't I'LL we've", "naïve café Äpfel", "日本語 テスト", "🙂🙃 👩‍👩‍👧", "a" * 500, "1234567890 12 3", "<|endoftext|>", "x\u00a0y\u2003z\x1c\x85", "  leading", "trailing   ", "#$%^&*()_+", "\r\n\r\nA\r", "e\u0301", "\ufeffbom", "Ω≈ç√", "\x00\x01", "ſtraße 'S 'ſ"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("ours", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(public_tokenizers.path(bpe.RANKS))


@pytest.mark.parametrize("text", HARD)
def test_encodes_as_the_library(reference, encoder, text):
    assert encoder.encode(text).tolist() == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encodes_any_text(reference, encoder, text):
    ids = encoder.encode(text).tolist()
    assert ids == reference.encode_ordinary(text)
    stream = bpe.Utf8Stream(encoder.v)
    assert "".join(stream.feed([i]) for i in ids) + stream.feed([], last=True) == text


def test_transducer_forgets_and_goes_on(encoder, reference):
    small = bpe.Transducer(encoder.v, most_states=50)
    for text in HARD[3:8] * 3:
        for piece in encoder.pieces.findall(text):
            assert small.encode(piece.encode()) == reference.encode_ordinary(piece)


def test_round_trip_query(spark, docs_of, prose, reference):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs_of(prose)).collect()}
    assert len(got) == len(prose)
    for d, t in prose:
        ids = reference.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs_of([])).count() == 0
    assert bpe.encode_documents(docs_of([(None, "a"), (None, "a")])).count() == 2


# packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(" \t\n\r\u00a0\u2003\u3000ab,.'1\u00e9s", max_size=14) | st.just("<|endoftext|>"), max_size=3).map("".join), min_size=1, max_size=4))
def test_words_are_encoded_as_the_library_does(texts):
    ids = packing.chunk_ids(public_tokenizers.path(packing.VOCABULARY))
    want = [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ids.encode(texts) == want


def test_full_tables_are_emptied():
    small = packing.ChunkIds(public_tokenizers.path(packing.VOCABULARY), most=5)
    for text in ("one two three four five six seven", "eight  nine ten, eleven", "one two"):
        assert small.encode([text]) == [np.array(small.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(small) <= 12


def check(rows, docs):
    """The pieces are right, and they fill their sequences without gaps or overlaps."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        size, at, k = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            want[(d, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))] += 1
            at, k, size = at + size, k + 1, 2048
    assert pieces == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(held), sum(r["length"] for r in rows)


def test_packing(spark, scratch, docs_of, prose):
    rows = packing.pack(docs_of(prose), scratch).collect()
    n, total = check(rows, prose)
    assert n == math.ceil(total / 2048)


def test_added_tokens_are_those_of_the_library():
    ids = packing.chunk_ids(public_tokenizers.path(packing.VOCABULARY))
    assert np.frombuffer(ids.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_packing_odd_inputs(spark, scratch, docs_of):
    assert packing.pack(docs_of([]), scratch).count() == 0
    odd = [(1, None), (1, None), (None, "a b"), (2, ""), (2, "x" * 9000), (3, "see <|endoftext|> and <|endoftext|>")]
    check(packing.pack(docs_of(odd), scratch).collect(), odd)


def test_packing_splits_a_hot_length(spark, scratch, docs_of):
    rows = packing.pack(docs_of([(i, "one two three") for i in range(2500)]), scratch).collect()
    check(rows, [(i, "one two three") for i in range(2500)])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), min_size=1, max_size=40))
def test_plan_places_every_item_once(histogram):
    bins = packing.fewest(histogram, 100)
    taken = Counter()
    for b in bins:
        used = sum(length * each for length, _, each, _ in b.items)
        assert used <= 100 and b.room == 100 - used
        at = 0
        for length, first, each, offset in b.items:
            assert offset == at
            at += length * each
            for j in range(b.count * each):
                taken[(length, first + j)] += 1
    assert all(v == 1 for v in taken.values())
    for length, n in histogram.items():
        assert {r for x, r in taken if x == length} == set(range(n))
    count, total = sum(b.count for b in bins), sum(k * v for k, v in histogram.items())
    decreasing = []  # best fit of the lengths from the longest down
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [i for i, r in enumerate(decreasing) if r >= length]
        if fits:
            decreasing[min(fits, key=lambda i: decreasing[i])] -= length
        else:
            decreasing.append(100 - length)
    assert math.ceil(total / 100) <= count <= len(decreasing) * 1.05 + 1
