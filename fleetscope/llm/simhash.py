"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is a row of bytes. Fingerprints that differ in at most r bits share at least n - r of their n bytes in
place. The index posts each fingerprint under groups of positions chosen so that any n - r shared positions hold one whole
group; inside a posting list the shared positional bytes of each pair are tallied, pairs below the guaranteed number are
dropped and the rest verified. Long lists are cut into tiles that meet pairwise, and a tile or a pair of tiles gives the
edges of a spanning forest only, so neither memory nor output grows with the square of a group of near copies.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, as_long, map_arrow, mix, ragged, shingle_hashes, small_batches, word_hashes
from .components import connected_components

TILE = 512
BLOCK = 1 << 15


def fingerprint64(words: list[bytes], k: int = 3) -> int:
    """64-bit SimHash of the k-word shingles (XXH64, seed 42), repeats included; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, count=len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    h = xxhash.xxh64_digest
    for i in range(0, n, BLOCK):
        a, b = starts[i : min(i + BLOCK, n)].tolist(), ends[i + k - 1 : min(i + BLOCK, n) + k - 1].tolist()
        got = np.frombuffer(b"".join([h(text[x:y], 42) for x, y in zip(a, b, strict=True)]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(got, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def position_groups() -> list[tuple[int, ...]]:
    """The 14 groups of four of eight positions whose numbers cancel under exclusive or: the blocks of the Steiner system S(3, 4, 8).

    Any three positions lie in one of them, and the other four positions of a group are a group, too; so any five shared
    positions hold a whole group (the one beside that of the three others). Keys are four bytes long.
    """
    return [g for g in combinations(range(8), 4) if not g[0] ^ g[1] ^ g[2] ^ g[3]]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n = len(linked)
    new = np.ones(n, bool)
    out = []
    for s in range(n):
        if not new[s]:
            continue
        new[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & new)
            new[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def near64(fps: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs differ in at most ``radius`` bits, after the tally of shared positional bytes."""
    x = fps[:, None] ^ fps[None, :]
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2)
    near = shared >= 8 - radius
    near[near] = np.bitwise_count(x[near]) <= radius
    return near


def posting_lists(keyed: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(members: array of structs) of at most about two tiles each, for ``keyed`` (key, member), so that every two members of a key meet.

    A key's tiles are dealt by hash, their number following the counted length of its list; keys with one member go early.
    """
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = keyed.join(counts, "key").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("member"), F.col("tiles")).cast("int"))
    lists = dealt.groupBy("key", "tiles", "tile").agg(F.collect_list("member").alias("members"))
    lists = scratch.cut(lists)
    whole = lists.where("tiles = 1").select("members")
    other = F.explode(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = lists.where("tiles > 1").select("key", "tile", "members", other.alias("o"))
    met = met.groupBy("key", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b")).agg(F.flatten(F.collect_list("members")).alias("members"))
    return whole.unionByName(met.select("members")).where("size(members) > 1")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): A-Z are lower-cased, words are what ASCII white space parts; null is taken as empty."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint64((t or "").encode().lower().split(), k) for t in b.column(1).to_pylist()), np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), as_long(fps)], names=["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def linked_fingerprints(fps: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """(a, b): a spanning set of the links between distinct ``fp``, for a radius of 3 at most: five bytes at least are shared."""
    if radius > 3:
        raise ValueError("the position groups guarantee a radius of 3")
    groups = position_groups()

    def key(i: int, g: tuple[int, ...]) -> Column:
        value = F.lit(i)
        for p in g:
            value = value * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        return value.cast("long")

    keyed = fps.select("fp").distinct().select(F.explode(F.array(*[key(i, g) for i, g in enumerate(groups)])).alias("key"), F.col("fp").alias("member"))

    def run(batches):
        for b in batches:
            column = b.column(0)
            flat, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            left, right = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i == 2:
                    if (int(flat[i]) ^ int(flat[i + 1])).bit_count() <= radius:
                        left.append(flat[i])
                        right.append(flat[i + 1])
                else:
                    own = np.unique(flat[i:j])
                    for x, y in forest(near64(own, radius)):
                        left.append(own[x])
                        right.append(own[y])
            yield pa.RecordBatch.from_arrays([as_long(np.array(left, np.uint64)), as_long(np.array(right, np.uint64))], names=["a", "b"])

    return map_arrow(posting_lists(keyed, scratch), run, "a long, b long")


def simhash_components(docs: DataFrame, scratch: Scratch, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Fingerprints at ``radius`` or fewer differing bits are linked; component_id is the smallest doc_id reached. Null and
    empty texts have fingerprint 0, linked like any other. Repeated rows and ids give repeated results; a null id keeps
    its row and never names a component (a component of null ids alone has null). Other columns are not read.
    """
    fps = scratch.cut(fingerprints(docs, k))
    roots = connected_components(linked_fingerprints(fps, scratch, radius), scratch)
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = lowest.join(roots, lowest.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = scratch.cut(named.join(best, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))


# Similarity of word shingles: candidates by prefixes of the shingle sets, count filtering on a row of bytes, then the texts.

#: Documents whose shingles are counted at once; shingles whose counts are broadcast at most, which sets their order and no result.
COUNTED, MOST_COMMON = 4096, 1 << 18
#: 64-bit words of a parity fingerprint.
PARITY = 16


def shingle_set(text: str | None, k: int) -> tuple[int, np.ndarray]:
    """(hash of the word sequence, the sorted distinct k-word shingles)."""
    words = (text or "").encode().lower().split()
    return xxhash.xxh64_intdigest(b" ".join(words)), np.unique(shingle_hashes(word_hashes(words), k))


def parity_bytes(shingles: np.ndarray) -> bytes:
    """A fingerprint of ``8 * PARITY`` bytes: bit b is the parity of the number of shingles that fall on it.

    Sets that differ in d elements have fingerprints that differ in d bits at most, so at least n - d of n bytes agree in place.
    """
    bits = np.bincount((mix(shingles) >> U64(32)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def may_reach(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs of sets may have a similarity of 0.8 or more, by their sizes and parity fingerprints (rows of uint64).

    Such sets differ in (|a| + |b|) / 9 elements at most. First the bytes that agree in place are tallied against the guaranteed
    number, then differing bits are counted. No pair that reaches 0.8 is dropped.
    """
    both = sizes[:, None] + sizes[None, :]
    ok = 5 * np.minimum(sizes[:, None], sizes[None, :]) >= 4 * np.maximum(sizes[:, None], sizes[None, :])
    i, j = np.nonzero(np.triu(ok, 1))
    for s in range(0, len(i), 1 << 14):
        p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
        x = prints[p] ^ prints[q]
        differ = (x.view(np.uint8) != 0).sum(1)
        near = 9 * differ <= both[p, q]
        near[near] = 9 * np.bitwise_count(x[near]).sum(1, dtype=np.int64) <= both[p[near], q[near]]
        ok[p, q] = near
    ok = np.triu(ok, 1)
    return ok | ok.T


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, documents) of shingles that many documents hold, as far as documents of one block share them; sorted."""

    def run(batches):
        for b in (whole.slice(i, COUNTED) for whole in batches for i in range(0, whole.num_rows, COUNTED)):
            sets = [shingle_set(t, k)[1] for t in b.column(0).to_pylist()]
            key, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(key[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

    counts = map_arrow(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 32")
    common = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    key, n = common.column("key").to_numpy().astype(np.int64).view(np.uint64), common.column("n").to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def prefixes(docs: DataFrame, k: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, words: a hash of the word sequence, size, print: parity fingerprint, keys: array<long>).

    Shingles are ordered by their counts in ``common``, then by hash. Of two sets of similarity 0.8 or more, the first
    size - ceil(0.8 size) + 1 shingles of each have one in common, whatever the order; those are the keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # MOST_COMMON entries at most

    def run(batches):
        known, counts = shared.value
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            total, sizes, prints, keys = [], [], [], []
            for t in b.column(1).to_pylist():
                h, s = shingle_set(t, k)
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, counts[at], 0)
                total.append(h)
                sizes.append(len(s))
                prints.append(parity_bytes(s))
                keys.append(s[np.argsort(rank, kind="stable")[: len(s) - (4 * len(s) + 4) // 5 + 1]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), as_long(np.array(total, np.uint64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), ragged(as_long(np.concatenate(keys)), [len(x) for x in keys])],
                names=["doc_id", "words", "size", "print", "keys"],
            )

    rows = docs.select("doc_id", "text")
    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, words long, size long, print binary, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, near) for each pair of ``id``s: whether the shingle sets of their texts have a Jaccard similarity of 0.8 or more."""

    def run(batches):
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            held: dict[int, np.ndarray] = {}
            near = []
            for x, y, s, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for i, text in ((x, s), (y, t)):
                    if i not in held:
                        held[i] = shingle_set(text, k)[1]
                p, q = held[x], held[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(5 * both >= 4 * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    one, other = texts.select(F.col("id").alias("a"), F.col("text").alias("s")), texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    return map_arrow(pairs.join(one, "a").join(other, "b").select("a", "b", "s", "t"), run, "a long, b long, near boolean")


def possible_pairs(lists: DataFrame, spanning: bool) -> DataFrame:
    """(a, b): members of one list, of different roots, that pass may_reach; all of them, or those that span what they connect."""

    def run(batches):
        for b in batches:
            at, rows = b.column(0).offsets.to_numpy(), b.column(0).values
            ids, sizes, roots = (rows.field(c).to_numpy() for c in ("id", "size", "root"))
            prints = np.frombuffer(b"".join(rows.field("print").to_pylist()), np.uint64).reshape(-1, PARITY)
            two = at[:-1][np.diff(at) == 2]  # most lists: all at once
            p, q = ids[two], ids[two + 1]
            both = sizes[two] + sizes[two + 1]
            ok = (roots[two] != roots[two + 1]) & (5 * np.minimum(sizes[two], sizes[two + 1]) >= 4 * np.maximum(sizes[two], sizes[two + 1]))
            ok[ok] = 9 * np.bitwise_count(prints[two[ok]] ^ prints[two[ok] + 1]).sum(1, dtype=np.int64) <= both[ok]
            left, right = [np.minimum(p, q)[ok]], [np.maximum(p, q)[ok]]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i > 2:
                    near = may_reach(prints[i:j], sizes[i:j]) & (roots[i:j, None] != roots[None, i:j])
                    x, y = np.array(forest(near), np.int64).reshape(-1, 2).T if spanning else np.nonzero(np.triu(near, 1))
                    left.append(np.minimum(ids[i + x], ids[i + y]))
                    right.append(np.maximum(ids[i + x], ids[i + y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return map_arrow(lists, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """(doc_id, keep) of the documents that belong to a group of near copies; keep is the group's smallest doc_id.

    Near copies: k-word shingle sets of Jaccard similarity 0.8 or more, or equal word sequences; every such pair has a key in
    common and passes the count filter. To spare a group of near copies its square of pairs, a list of documents with a key in
    common first gives pairs that span what may be near in it; then all pairs that may be near, have a key in common and are in
    no group together are compared. Null and empty texts are copies of each other. Ties have no effect: the smallest id stays.
    Ids are taken as unique; rows with a null id are left out.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    fps = scratch.cut(prefixes(rows, k, common_shingles(rows, k)))
    held = scratch.cut(fps.select("doc_id", "words"))
    classes = scratch.cut(held.groupBy("words").agg(F.min("doc_id").alias("low")))
    lowest = classes.select(F.col("words").alias("id"), F.col("low").alias("doc_id"))
    first = fps.join(lowest, "doc_id").where("words = id").select("id", "size", "print", "keys")
    met = posting_lists(first.select(F.explode("keys").alias("key"), F.col("id").alias("member")), scratch, tile=256)
    # most lists hold the same few documents as others: each set of them is looked at once
    lists = scratch.cut(met.select(F.array_sort(F.array_distinct("members")).alias("ids")).where("size(ids) > 1").distinct().select(F.monotonically_increasing_id().alias("list"), "ids"))
    each = scratch.cut(lists.select("list", F.explode("ids").alias("id")))
    scratch.free()
    members = scratch.cut(first.select("id", "size", "print").join(each.select("id").distinct(), "id").dropDuplicates(["id"]))
    for done in (fps, lists):  # keys and lists take the most disk
        scratch.drop(done)
    seen = None
    for spanning in (True, False):
        found, of_lists = members.withColumn("root", F.col("id")), each
        if seen is not None:  # only lists with members of several groups are looked at again
            roots = connected_components(seen.where("near"), scratch).select(F.col("node").alias("id"), F.col("root").alias("r"))
            found = scratch.cut(members.join(roots, "id", "left").withColumn("root", F.coalesce("r", "id")).drop("r"))
            mixed = each.join(found.select("id", "root"), "id").groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
            of_lists = each.join(mixed.select("list"), "list")
        told = of_lists.join(found, "id").groupBy("list").agg(F.collect_list(F.struct("id", "size", "root", "print")).alias("rows"))
        pairs = possible_pairs(told.select("rows"), spanning)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.cut(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(lowest, "id")
        texts = scratch.cut(rows.join(wanted, "doc_id").dropDuplicates(["doc_id", "id"]).select("id", "text"))  # of these pairs only
        with small_batches(scratch.spark, 256):
            new = scratch.cut(similar(pairs, texts, k))
        scratch.drop(texts)
        seen = new if seen is None else seen.unionByName(new)
        scratch.free()
    roots = connected_components(seen.where("near"), scratch)
    named = classes.join(roots.withColumnRenamed("node", "words"), "words", "left").select("words", "low", F.coalesce("root", "words").alias("root"))
    best = scratch.cut(named.groupBy("root").agg(F.min("low").alias("keep")))
    named = scratch.cut(named.join(best, "root").select("words", "keep"))
    return held.join(named, "words").select("doc_id", "keep")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """The documents without all but the smallest doc_id of each group of near copies; rows with a null id stay."""
    own = Scratch(scratch.spark, scratch.release)
    groups = near_duplicates(docs, own, k)
    gone = scratch.cut(groups.where("doc_id <> keep").select("doc_id").distinct())
    own.clear()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept
