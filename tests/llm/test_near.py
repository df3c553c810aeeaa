import random

import numpy as np
import pytest

import brute
from fleetscope.llm import common, components, embedding, simhash


def test_simhash_matches_brute_force(spark, scratch, docs_of, prose):
    fps = {d: brute.fingerprint(t) for d, t in prose}
    ids = sorted(fps)
    root = brute.components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs_of(prose), scratch).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in ids}
    assert len(set(root.values())) < len(ids) - 3  # there are copies


def test_simhash_odd_inputs(spark, scratch, docs_of):
    assert simhash.simhash_components(docs_of([]), scratch).count() == 0
    odd = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "q"), (3, None), (9, "")]
    got = sorted(map(tuple, simhash.simhash_components(docs_of(odd), scratch).select("doc_id", "component_id").collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (3, 3), (9, 3)], key=repr)


def test_positions_are_guaranteed():
    groups = simhash.position_groups()
    from itertools import combinations

    assert all(any(set(g) <= set(same) for g in groups) for same in combinations(range(8), 5)) and len(groups) == 14


@pytest.mark.parametrize("tile", [2, 7])
def test_tiles_lose_no_link(spark, scratch, tile):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    kept = simhash.posting_lists.__defaults__
    simhash.posting_lists.__defaults__ = (tile,)
    try:
        links = simhash.linked_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), scratch).collect()
    finally:
        simhash.posting_lists.__defaults__ = kept
    ids = range(len(fps))
    want = brute.components(ids, [(i, j) for i in ids for j in ids if i < j and (fps[i] ^ fps[j]).bit_count() <= 3])
    at = {s: i for i, s in enumerate(signed)}
    assert brute.components(ids, [(at[r["a"]], at[r["b"]]) for r in links]) == want


def test_components_of_chains_and_stars(spark, scratch):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_near_duplicates_find_similar_texts(spark, scratch, docs_of):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(900)]
    rows, want = [], []
    for i in range(40):
        text = rng.choices(words, k=rng.randint(60, 400))
        rows.append((i, " ".join(text)))
        for m in (1, 2):
            other = list(text)
            for _ in range(max(1, len(text) // 150)):
                other[rng.randrange(len(other))] = "edit"
            rows.append((1000 * m + i, " ".join(other)))
            if brute.jaccard(rows[-1][1], rows[-2 if m == 1 else -3][1]) >= 0.85:
                want.append(1000 * m + i)
    rows += [(5000, rows[0][1].upper()), (5001, None), (5002, None), (5003, "")]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(rows), scratch).collect()}
    assert set(range(40)) <= kept and 5000 not in kept
    assert sum(d in kept for d in want) <= 0.02 * len(want)


def test_near_duplicates_find_every_pair_from_0_8(spark, scratch, docs_of):
    rng = random.Random(21)
    make = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(240):
        text = make(rng.randint(150, 600))
        n = max(1, round(len(text) * rng.uniform(0.02, 0.21)))
        at = rng.randrange(len(text) - n)
        other = [text + make(n), text[:at] + text[at + n :], text[:at] + make(n // 2) + text[at + n // 2 :], list(text)][i % 4]
        if i % 4 == 3:
            for _ in range(max(1, n // 5)):
                other[rng.randrange(len(other))] = "edit"
        rows += [(i, " ".join(text)), (1000 + i, " ".join(other))]
        if brute.jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            want.add(1000 + i)
    at_80 = [w for w in want if brute.jaccard(rows[2 * (w - 1000)][1], rows[2 * (w - 1000) + 1][1]) < 0.9]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(rows), scratch).select("doc_id").collect()}
    assert len(at_80) > 60 and kept == {d for d, _ in rows} - want


def test_count_filter_drops_no_similar_pair():
    rng = random.Random(31)
    sets = [set(rng.sample(range(10**6), rng.choice([1, 3, 10, 60, 400, 3000]))) for _ in range(12)]
    for s in list(sets):
        for part in (0.02, 0.1, 0.12, 0.3):
            sets.append({x if rng.random() > part else rng.randrange(10**7) for x in s})
    hashed = [np.unique(np.array(list(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    ok = simhash.may_reach(np.frombuffer(b"".join(map(simhash.parity_bytes, hashed)), np.uint64).reshape(-1, simhash.PARITY), np.array([len(s) for s in sets]))
    near = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near <= set(zip(*map(np.ndarray.tolist, np.nonzero(ok)), strict=True)) and len(near) > 20 and ok.sum() < 3 * len(near)


def test_near_duplicates_group_as_all_pairs_do(spark, scratch, docs_of):
    rng = random.Random(22)
    base, passage = [rng.choices("abcdefghijklmnop", k=120) for _ in range(4)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(160):  # chains of near copies around four texts, half of them with one passage that all share
        text = list(base[i % 4])
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(text + (passage if i % 8 < 4 else []))))
    root = brute.components(range(160), [(a, b) for a in range(160) for b in range(a) if brute.jaccard(rows[a][1], rows[b][1]) >= 0.8])
    got = {r["doc_id"]: r["keep"] for r in simhash.near_duplicates(docs_of(rows), scratch).collect()}
    assert got == root and 8 < len(set(root.values())) < 150


def test_near_duplicates_leave_different_texts_alone(spark, scratch, docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"u{j}" for j in range(3000)], k=100))) for i in range(300)]
    half = rows[0][1].split()
    rows.append((900, " ".join(half[:50] + rng.choices([f"u{j}" for j in range(3000)], k=50))))
    got = simhash.drop_near_duplicates(docs_of(rows), scratch)
    assert got.count() == len(rows) and got.columns == docs_of([]).columns
    assert simhash.drop_near_duplicates(docs_of([]), scratch).count() == 0


def test_near_duplicates_odd_rows(spark, scratch, docs_of):
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c"), (1, None), (2, ""), (3, " \n")]
    got = sorted((r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(rows), scratch).collect()), key=repr)
    assert got == sorted([None, None, 4, 4, 1], key=repr)


def test_near_duplicates_fetch_only_texts_they_compare(spark, scratch, docs_of, monkeypatch):
    rng = random.Random(23)
    make = lambda n: rng.choices([f"u{j}" for j in range(3000)], k=n)
    passages = [make(30) for _ in range(25)]
    rows = [(i, " ".join(make(90) + passages[i % 25])) for i in range(100)]  # keys in common, but not near
    rows.append((900, rows[0][1] + " more"))
    fetched, cut = [], common.Scratch.cut

    def watched(self, df):
        out = cut(self, df)
        if "text" in out.columns:
            fetched.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "cut", watched)
    kept = simhash.drop_near_duplicates(docs_of(rows), scratch)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(100))
    assert sum(fetched) == 2


def test_hubs_are_split(spark, scratch, monkeypatch):
    monkeypatch.setattr(components, "HUB_LEAST", 3)
    test_components_of_chains_and_stars(spark, scratch)


# embeddings


def brute_links(rows, threshold=0.98):
    ids, n, links = [r[0] for r in rows], dict.fromkeys((r[0] for r in rows), 0), []
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, np.float64))
    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    root = brute.components(ids, links)
    return {i: (n[i], root[i], root[i] == i) for i in ids}


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = rng.normal(size=16)
            for s in (0, 0.05, 0.1, 0.15, 0.2):
                rows.append((k, [float(np.float32(x)) for x in c + s * rng.normal(size=16)], label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [float("nan")] * 16, 0), (k + 3, [float("inf")] + [1.0] * 15, 0), (k + 4, [None] + [1.0] * 15, 0), (k + 5, [], 0), (k + 6, rows[0][1], 0), (k + 7, rows[0][1], 1), (k + 8, [1.0, 2.0], 0), (k + 9, [1.0, 2.0001], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, rep long, cell string"


@pytest.mark.parametrize("tile", [3, 768])
def test_embeddings_match_brute_force(spark, scratch, monkeypatch, tile):
    monkeypatch.setattr(embedding, "TILE", tile)
    monkeypatch.setattr(embedding, "MOST_DIMS", 4)
    rows = vectors()
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding.similar_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), scratch).collect()}
    assert got == brute_links(rows)
    assert sum(v[0] for v in got.values()) > 20


def test_embeddings_with_huge_groups_of_copies(spark, scratch):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(3000)] + [(3000, [1.0, 2.0, 3.001], 0)]
    got = embedding.similar_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), scratch)
    assert {tuple(r)[1:3] for r in got.collect()} == {(3000, 0)}


def test_embeddings_empty(spark, scratch):
    assert embedding.similar_vectors(spark.createDataFrame([], SCHEMA), scratch).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 0, 1, "x"), (4, [1.0], 0, 1, "x")], SCHEMA)
    assert sorted((tuple(r) for r in embedding.similar_vectors(odd, scratch).collect()), key=repr) == [(4, 1, 4, True), (None, 1, 4, True)]
