import random

import pytest

import brute
from fleetscope.llm import ctw, quality, substring


def test_quality_counts(spark, docs_of, prose):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.quality_rules(docs_of(prose), labels).collect()}
    assert got == {d: brute.quality(t) for d, t in prose}


def test_quality_classifier_learns(spark, docs_of):
    rng = random.Random(2)
    good, bad = [f"fine{i}" for i in range(300)], [f"junk{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=60))) for i in range(300)] + [(900, None), (901, ""), (None, "a b"), (None, "a b")]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (199, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of(rows), labels).collect()}
    held_out = range(200, 300)
    assert sum(got[i]["kept"] == (i % 3 != 0) for i in held_out) >= 98
    assert all(0 <= got[i]["probability"] <= 1 for i in held_out)
    assert got[900]["base_failed"] and not got[900]["kept"]
    again = {r["doc_id"]: r["probability"] for r in quality.quality_rules(docs_of(rows).repartition(3), labels).collect()}
    assert again == {d: r["probability"] for d, r in got.items()}  # the fit repeats


def test_rejected_documents_go(spark, docs_of):
    good = " ".join(f"g{i}" for i in range(20))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.drop_rejected(docs_of([(1, good), (2, "short"), (3, None), (4, "la " * 40), (None, good), (1, good)]), labels)
    assert got.columns == docs_of([]).columns
    assert sorted(((r["doc_id"], r["text"], r["_q"]) for r in got.collect()), key=repr) == sorted([(1, good, 7), (1, good, 7), (None, good, 7)], key=repr)


def test_quality_empty(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs_of([]), labels).count() == 0


def test_substring_matches_brute_force(spark, scratch, docs_of, prose):
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.substring_digest(docs_of(prose), scratch).collect()}
    assert got == brute.substring(prose)
    assert sum(v[1] for v in got.values()) > 100


@pytest.mark.parametrize("seed", range(3))
def test_substring_over_a_tiny_vocabulary(spark, scratch, docs_of, seed):
    """Few words make many branches, self-overlaps and shared minimizers."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(5, 60)))) for i in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.substring_digest(docs_of(rows), scratch).collect()}
    assert got == brute.substring(rows)


def test_substring_odd_inputs(spark, scratch, docs_of):
    assert substring.substring_digest(docs_of([]), scratch).count() == 0
    text = " ".join(f"k{i}" for i in range(20))
    rows = [(None, text), (4, text), (4, text), (9, text), (1, None), (2, "")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.substring_digest(docs_of(rows), scratch).collect()), key=repr)
    assert got == sorted([(None, 20, 0), (4, 20, 0), (4, 20, 0), (9, 20, 20), (1, 0, 0), (2, 0, 0)], key=repr)


def test_substring_takes_ids_of_any_type(spark, scratch, prose):
    rows = [(f"d{d:04d}", t) for d, t in prose]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.substring_digest(spark.createDataFrame(rows, "doc_id string, text string"), scratch).collect()}
    assert got == brute.substring(rows)


def test_colliding_hashes_remove_nothing(spark, scratch, docs_of, monkeypatch):
    """All words hash alike: every window seems to repeat, but none has the words of its source."""
    import numpy as np

    monkeypatch.setattr(substring, "word_hashes", lambda words: np.zeros(len(words), np.uint64))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(6)]  # all bytes differ
    assert [r["n_removed"] for r in substring.substring_digest(docs_of(rows), scratch).collect()] == [0] * 6
    rows.append((9, rows[0][1]))
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_digest(docs_of(rows), scratch).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 40}


def test_nonbranching_paths_are_compacted(spark, scratch):
    edges = [(1, 7, 0, 4, 100, 101), (2, 7, 4, 2, 101, 102), (3, 7, 6, 1, 102, 103), (4, 8, 0, 3, 103, 104), (5, 9, 0, 1, 200, 201), (6, 9, 1, 1, 201, 202), (7, 5, 3, 1, 201, 203)]
    got = {r["key"]: r["path"] for r in substring.compacted(spark.createDataFrame(edges, "key long, src long, at int, n int, head long, tail long"), scratch).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}  # another source starts at 103; 201 is a branch


def test_drop_substrings_keeps_the_rest_of_the_text(spark, scratch, docs_of):
    shared = " ".join(f"k{i}" for i in range(15))
    rows = [(1, shared), (2, f"before\n\n{shared}\n  after  the end "), (3, "  untouched  \n text "), (4, None), (5, shared)]
    got = {r["doc_id"]: r for r in substring.drop_substrings(docs_of(rows), scratch).collect()}
    assert got[1]["text"] == shared and got[3]["text"] == "  untouched  \n text " and got[4]["text"] is None and got[5]["text"] == ""
    assert got[2]["text"].split() == ["before", "after", "the", "end"] and got[2]["n_chars"] == len(got[2]["text"])
    assert got[2]["least"] == 7 and got[2]["source"] == "x"


# context-tree weighting


def test_scores_match_a_plain_context_tree(spark, scratch, docs_of):
    import math
    import zlib

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["abra", "cadabra", "Abra", "xyz", "é"], k=rng.randint(0, 12)))) for i in range(40)] + [(77, None), (78, "")]
    train = [t or "" for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    tree = brute.Ctw([brute.lower(t).encode() for t in train], ctw.DEPTH)
    tokens = [w for t in train for w in [*brute.WORD.findall(brute.lower(t)), None]]
    counts = {w: tokens.count(w) for w in tokens}
    n, v = len(tokens), len(counts)
    got = {r["doc_id"]: r for r in ctw.language_model_scores(docs_of(rows), scratch).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        words = [*brute.WORD.findall(brute.lower(t)), None]
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1) and r["n_tokens"] == len(words) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in counts for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words), abs=1e-9)
        assert r["score"] == pytest.approx(tree.log10(brute.lower(t).encode()), abs=1e-6)


def test_scores_odd_inputs(spark, scratch, docs_of):
    assert ctw.language_model_scores(docs_of([]), scratch).count() == 0
    rows = ctw.language_model_scores(docs_of([(None, "a b"), (None, "a b"), (1, "a " * 3000)]), scratch).collect()
    assert len(rows) == 3 and not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_rare_tokens_and_grams_are_joined(spark, scratch, docs_of, prose, monkeypatch):
    one = {r["doc_id"]: tuple(r) for r in ctw.language_model_scores(docs_of(prose), scratch).collect()}
    monkeypatch.setattr(ctw, "MOST_TOKENS", 3)
    monkeypatch.setattr(ctw, "MOST_GRAMS", 3)
    two = {r["doc_id"]: tuple(r) for r in ctw.language_model_scores(docs_of(prose), scratch).collect()}
    for d in one:
        assert one[d][:5] == two[d][:5] and one[d][5:7] == pytest.approx(two[d][5:7], abs=1e-6)


def test_scores_of_a_larger_corpus(spark, scratch, docs_of, prose):
    """Every context is a node, however rare: the scores are those of the plain tree."""
    import zlib

    rows = [(d, t) for d, t in prose if d != 62]
    tree = brute.Ctw([brute.lower(t or "").encode() for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1], ctw.DEPTH)
    got = {r["doc_id"]: r for r in ctw.language_model_scores(docs_of(rows), scratch).collect()}
    for d, t in rows:
        data = brute.lower(t or "").encode()
        assert got[d]["score"] == pytest.approx(tree.log10(data), abs=1e-6)
        assert got[d]["bits_per_byte"] == (pytest.approx(-got[d]["score"] / 0.30102999566 / len(data)) if data else None)


def test_long_texts_in_steps():
    texts = [b"abcdefgh" * 40, b"", b"xyz", b"q" * 500]
    want = {(i, int.from_bytes((b"\0" * ctw.DEPTH + t)[p : p + ctw.DEPTH + 1], "big")) for i, t in enumerate(texts) for p in range(len(t))}
    for block in (7, 50, 1 << 20):
        got = [(int(o), int(c)) for owner, code in ctw.gram_blocks(texts, block) for o, c in zip(owner, code, strict=True)]
        assert len(got) == sum(map(len, texts)) and set(got) == want
