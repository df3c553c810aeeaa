"""Language-model scores by context-tree weighting over the bytes of a corpus.

Each byte is eight binary decisions; each decision has a context tree over the ``DEPTH`` bytes before. Counts of all
(DEPTH + 1)-grams of the training texts are summed in Spark and stay there: every context is a node, and the tree grows with the
corpus. Krichevsky-Trofimov estimates of all depths are mixed by the weights of the tree, from the leaves up and back down:
contexts of ``CUT`` bytes hold subtrees of bounded size that a task handles whole, the levels above are aggregates and joins.
Log probabilities of the commonest grams are broadcast; a text's other grams are looked up in the tree by joins, so scores are
those of the whole tree at any size. A text's score is the sum over its bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, as_long, map_arrow, word_hashes

DEPTH = 5
#: Grams whose log probabilities, and tokens whose counts, are broadcast at most; all others are joined.
MOST_GRAMS, MOST_TOKENS = 1 << 19, 1 << 18
BLOCK = 1 << 18


def gram_blocks(texts: list[bytes], block: int = BLOCK):
    """(text numbers of each position, code) by blocks: a code is a byte and the DEPTH bytes before it, zeros before the start."""
    pad = b"\0" * DEPTH
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= block):
            size += len(texts[j])
            j += 1
        if size > 2 * block:  # one very long text, in steps that overlap by the context
            data = pad + texts[i]
            for at in range(0, len(texts[i]), block):
                part = np.frombuffer(data[at : at + block + DEPTH], np.uint8).astype(np.uint64)
                code = _codes(part)[DEPTH:]
                yield np.full(len(code), i), code
        elif size:
            sizes = np.fromiter(map(len, texts[i:j]), np.int64, count=j - i)
            code = _codes(np.frombuffer(pad + pad.join(texts[i:j]), np.uint8).astype(np.uint64))
            owner = np.repeat(np.arange(i, j), sizes)
            yield owner, code[np.arange(size) + DEPTH * (owner - i + 1)]
        i = j


def _codes(x: np.ndarray) -> np.ndarray:
    two, four = x.copy(), None
    two[1:] |= x[:-1] << U64(8)
    four = two.copy()
    four[2:] |= two[:-2] << U64(16)
    four[4:] |= two[:-4] << U64(32)
    return four


class Tally:
    """Counts of keys, merged now and then, so that memory follows the distinct keys."""

    def __init__(self, most: int = 1 << 19) -> None:
        self.keys, self.counts, self.waiting, self.most = [], [], 0, most

    def add(self, key: np.ndarray) -> None:
        at, n = np.unique(key, return_counts=True)
        self.keys.append(at)
        self.counts.append(n)
        self.waiting += len(at)
        if self.waiting > self.most:
            self.merge()
            self.waiting = 0

    def merge(self) -> int:
        if len(self.keys) > 1:
            key, n = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.keys, self.counts = [key[first]], [np.add.reduceat(n, first)]
        return len(self.keys[0]) if self.keys else 0

    def batches(self, kind: int, size: int = 1 << 17):
        n = self.merge()
        for i in range(0, n, size):
            key, count = self.keys[0][i : i + size], self.counts[0][i : i + size]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), as_long(key), pa.array(count.astype(np.int64))], names=["kind", "key", "n"])
        self.keys, self.counts, self.waiting = [], [], 0


#: Documents in Python's hands at a time; distinct keys that a task keeps.
SLICE, MOST_KEPT = 512, 1 << 20


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over a column ``text``: kind 0 words by XXH64, 1 grams by code, 2 the number of texts."""

    def run(batches):
        words, grams, n = Tally(), Tally(), 0
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                data = [(t or "").encode().lower() for t in b.column(0).slice(i, SLICE).to_pylist()]
                n += len(data)
                for part in _joined(data):
                    words.add(word_hashes(part))
                for _, code in gram_blocks(data):
                    grams.add(code)
            for kind, t in ((0, words), (1, grams)):
                if t.keys and len(t.keys[0]) > MOST_KEPT:
                    yield from t.batches(kind)
        yield from words.batches(0)
        yield from grams.batches(1)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["kind", "key", "n"])

    return map_arrow(texts, run, "kind tinyint, key long, n long")


def _joined(data: list[bytes]):
    """The words of about a block of bytes of texts at a time."""
    part, size = [], 0
    for d in data:
        part += d.split()
        size += len(d)
        if size > BLOCK:
            yield part
            part, size = [], 0
    if part:
        yield part


_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series above 8, the recurrence below."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    series = sum(c / x ** (2 * i + 1) for i, c in enumerate(_STIRLING))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


# The tree. A node is (depth k, the last k bytes, the bits of the next byte so far behind a leading one), keyed by context << 8 | prefix.

HALF = math.log(0.5)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys in order, place of each row's key among them, sums of the values)."""
    at, place = np.unique(key, return_inverse=True)
    return at, place, [np.bincount(place, v, len(at)) for v in values]


def mixed(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """ln of the weighted probability of nodes with children: half the node's own estimate, half the product of those below."""
    return np.logaddexp(HALF + own, HALF + below)


def bit_nodes(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys, [zeros, ones]) of the deepest nodes of grams that come ``n`` times."""
    context, byte = codes >> U64(8) << U64(8), codes & U64(255)
    keys = np.concatenate([context | U64(1 << j) | byte >> U64(8 - j) for j in range(8)])
    ones = np.concatenate([(byte >> U64(7 - j) & U64(1)) * n for j in range(8)]).astype(float)
    key, _, sums = summed(keys, np.tile(n, 8) - ones, ones)
    return key, sums


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes above those of ``depth``: the oldest byte goes."""
    return key & U64((1 << 8 * depth) - 1)


class Level:
    """The nodes of one depth: their counts, own and weighted log probabilities, and where each node of the level below belongs."""

    def __init__(self, key, zeros, ones, weighted) -> None:
        self.key, self.zeros, self.ones, self.weighted = key, zeros, ones, weighted
        self.own = log_kt(zeros, ones)
        if weighted is None:
            self.weighted = self.own
        self.stop = np.exp(HALF + self.own - self.weighted) if weighted is not None else np.ones(len(key))

    def above(self, depth: int) -> Level:
        """The level above this one of ``depth``; ``self.up`` says which of its nodes each belongs to."""
        key, self.up, (zeros, ones, below) = summed(shorter(self.key, depth), self.zeros, self.ones, self.weighted)
        return Level(key, zeros, ones, mixed(log_kt(zeros, ones), below))

    def state(self, said: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(said, left) after these nodes, from those of the nodes above: the estimate mixed so far, and the weight of what is deeper."""
        return said + left * self.stop * (self.ones + 0.5) / (self.zeros + self.ones + 1), left * (1 - self.stop)


def by_groups(batches):
    """Batches sorted by their first column, cut anew so that no group of equal values is parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        if held and key[-1] == held[0].column(0)[0].as_py():  # one group so far
            held.append(b)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        done = [*held, *([b.slice(0, cut)] if cut else [])]
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Depth at which the tree is cut into subtrees that one task handles: contexts of so many bytes.
CUT = 3


def _context() -> Column:
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * CUT) - 1)).alias("c")


def subtree(codes: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH, DEPTH - 1 ... CUT of the contexts of some grams, all of a context's grams among them."""
    key, (zeros, ones) = bit_nodes(codes, n)
    levels = [Level(key, zeros, ones, None)]
    for depth in range(DEPTH, CUT, -1):
        levels.append(levels[-1].above(depth))
    return levels


_NODES, _STATES = "c long, p int, zeros double, ones double, weighted double", "c long, p int, said double, left double"


def cut_level(grams: DataFrame) -> DataFrame:
    """The nodes at depth CUT of grams (key, n). A context of CUT bytes has 2^24 grams at most, whatever the corpus' size."""

    def run(batches):
        for b in by_groups(batches):
            top = subtree(b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy().astype(float))[-1]
            yield pa.RecordBatch.from_arrays([as_long(top.key >> U64(8)), pa.array((top.key & U64(255)).astype(np.int32)), *map(pa.array, (top.zeros, top.ones, top.weighted))], names=["c", "p", "zeros", "ones", "weighted"])

    return map_arrow(grams.select(_context(), "key", "n").repartition("c").sortWithinPartitions("c"), run, _NODES)


def level_above(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes above those of ``depth``, added up by contexts and mixed."""
    sums = nodes.groupBy(F.col("c").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)).alias("c"), "p").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "weighted")))

    def run(batches):
        for b in batches:
            zeros, ones, below = (b.column(i).to_numpy() for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(mixed(log_kt(zeros, ones), below))], names=["c", "p", "zeros", "ones", "weighted"])

    return map_arrow(sums, run, _NODES)


class Top:
    """(said, left) after the nodes of depth 1 or, for contexts without one, of depth 0: 65,535 nodes at most."""

    def __init__(self, ones: pa.Table) -> None:
        c, p, zeros, one, weighted = (ones.column(x).to_numpy() for x in ("c", "p", "zeros", "ones", "weighted"))
        order = np.lexsort((p, c))
        level = Level((c.astype(np.uint64) << U64(8) | p.astype(np.uint64))[order], zeros[order], one[order], weighted[order])
        root = level.above(1)
        said, left = root.state(np.zeros(len(root.key)), np.ones(len(root.key)))
        self.keys = [root.key, level.key]
        self.states = [(said, left), level.state(said[level.up], left[level.up])]

    def state(self, context: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        said, left = np.zeros(len(context)), np.ones(len(context))
        for depth in (0, 1):
            if len(self.keys[depth]):
                at, hit = find(self.keys[depth], shorter(context << U64(8) | prefix, depth + 1))
                said[hit], left[hit] = (x[at[hit]] for x in self.states[depth])
        return said, left


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key in sorted, not empty keys."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """The states at depths 2 and CUT as tables, those above in hand; deeper ones are made where they are asked for."""

    def __init__(self, grams: DataFrame, scratch: Scratch) -> None:
        self.grams, self.scratch = grams, scratch
        three = scratch.cut(cut_level(grams))
        two = scratch.cut(level_above(three, CUT))
        self.top = scratch.spark.sparkContext.broadcast(Top(level_above(two, 2).toArrow()))  # 65,280 rows at most
        unknown = F.lit(None).cast("double")
        self.two = scratch.cut(self._after(two.select("*", unknown.alias("said"), unknown.alias("left"))))
        self.three = scratch.cut(self._after(self._beside_two(three)))

    def _beside_two(self, rows: DataFrame) -> DataFrame:
        """Rows (c, p, ...) beside the state (said, left) of depth 2 that they belong to, null if there is none."""
        two = self.two.select(F.col("c").alias("c2"), F.col("p").alias("p2"), "said", "left")
        return rows.join(two, (F.col("c").bitwiseAND(F.lit(0xFFFF)) == F.col("c2")) & (F.col("p") == F.col("p2")), "left").drop("c2", "p2")

    def _after(self, nodes: DataFrame) -> DataFrame:
        """(c, p, said, left) after nodes (c, p, zeros, ones, weighted) that stand beside the state above."""
        above = _Above(self.top)

        def run(batches):
            for b in batches:
                c, p, said, left = above(b)
                said, left = Level(c << U64(8) | p, *(b.column(i).to_numpy() for i in (2, 3, 4))).state(said, left)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said), pa.array(left)], names=["c", "p", "said", "left"])

        return map_arrow(nodes, run, _STATES)

    def _shallow(self, codes: DataFrame) -> DataFrame:
        """States for the bits of codes that no node of depth CUT has: those of the deepest node above."""
        bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")
        asked = codes.select(_context(), "key", bits).select("c", F.expr("CAST(shiftleft(1L, j) | shiftright(key & 255, 8 - j) AS INT)").alias("p")).distinct()
        above = _Above(self.top)

        def run(batches):
            for b in batches:
                _, _, said, left = above(b)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said), pa.array(left)], names=["c", "p", "said", "left"])

        return map_arrow(self._beside_two(asked.join(self.three.select("c", "p"), ["c", "p"], "left_anti")), run, _STATES)

    def log10(self, codes: DataFrame, seen: bool = False) -> DataFrame:
        """(key, log10 P(last byte | bytes before)) of distinct gram codes ``key``; ``seen``: all of them are training grams."""
        none = {"key": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "p": F.lit(0), "said": F.lit(0.0), "left": F.lit(0.0)}
        part = lambda rows, kind, *own: rows.select(*(_context() if c == "c" and "key" in own else F.lit(kind).cast("tinyint").alias(c) if c == "kind" else F.col(c) if c in (*own, "c") else none[c].alias(c) for c in ("c", "kind", "key", "n", "p", "said", "left")))
        states = self.three if seen else self.three.unionByName(self._shallow(codes))
        rows = part(self.grams, 0, "key", "n").unionByName(part(states, 1, "p", "said", "left")).unionByName(part(codes, 2, "key"))

        def run(batches):
            for b in by_groups(batches):
                kind, key = b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
                wanted = key[kind == 2]
                if len(wanted):
                    gram, state = kind == 0, kind == 1
                    c, n, p, said, left = (b.column(i).to_numpy() for i in (0, 3, 4, 5, 6))
                    at = (c[state].astype(np.uint64) << U64(8)) | p[state].astype(np.uint64)
                    order = np.argsort(at)
                    logs = gram_logs(wanted, key[gram], n[gram].astype(float), at[order], said[state][order], left[state][order])
                    yield pa.RecordBatch.from_arrays([as_long(wanted), pa.array(logs)], names=["key", "log"])

        return map_arrow(rows.repartition("c").sortWithinPartitions("c"), run, "key long, log double")


class _Above:
    """(context, prefix, said, left) of rows (c, p, ..., said, left): a null state is that of depth 1 or 0."""

    def __init__(self, top) -> None:
        self.top = top

    def __call__(self, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        c, p = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().astype(np.uint64)
        said, left = self.top.value.state(c, p)
        known = np.array(b.column("said").is_valid())
        for mine, name in ((said, "said"), (left, "left")):
            mine[known] = b.column(name).to_numpy(zero_copy_only=False)[known]
        return c, p, said, left


def gram_logs(wanted: np.ndarray, grams: np.ndarray, n: np.ndarray, states: np.ndarray, said: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 P of codes, given all grams of their contexts of CUT bytes and the states there (sorted by key)."""
    keys, after = [states], [(said, left)]
    if len(grams):
        levels = subtree(grams, n)
        at, _ = find(states, levels[-1].key)
        keys[0], after[0] = states, (said, left)
        said, left = said[at], left[at]  # the nodes of depth CUT themselves
        for level in levels[-2::-1]:
            said, left = level.state(said[level.up], left[level.up])
            keys.append(level.key)
            after.append((said, left))
    out = np.zeros(len(wanted))
    context, byte = wanted >> U64(8) << U64(8), wanted & U64(255)
    for j in range(8):
        node = context | U64(1 << j) | byte >> U64(8 - j)
        one, todo = np.full(len(wanted), 0.5), np.arange(len(wanted))
        for k in range(len(keys) - 1, -1, -1):
            at, hit = find(keys[k], node[todo] & U64((1 << 8 * (CUT + k + 1)) - 1))
            one[todo[hit]] = after[k][0][at[hit]] + after[k][1][at[hit]] * 0.5
            todo = todo[~hit]
        out += np.log10(np.where(byte >> U64(7 - j) & U64(1) == 1, one, 1 - one))
    return out


class Table:
    """An open-addressing hash table from 64-bit keys to numbers, filled and read a vector at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 1.5).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.full = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype), np.zeros(1 << bits, bool)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = ~self.full[slot]
            self.keys[slot[free]] = keys[todo[free]]
            self.full[slot[free]] = True
            won = np.zeros(len(todo), bool)
            won[free] = self.keys[slot[free]] == keys[todo[free]]
            self.values[slot[won]] = values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        slot = self._slot(keys)
        found = (self.keys[slot] == keys) & self.full[slot]
        out = self.values[slot]
        todo = np.flatnonzero(~found & self.full[slot])
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            open_ = self.full[slot]
            todo, slot = todo[open_], slot[open_]
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            found[todo[hit]] = True
            todo, slot = todo[~hit], slot[~hit]
        return out, found


class Scorer:
    """What is broadcast: log probabilities of the commonest grams and counts of the commonest tokens. Tables are made on first use."""

    def __init__(self, grams: pa.Table, tokens: pa.Table) -> None:
        self.parts = [(t.column("key").to_numpy().astype(np.int64).view(np.uint64), t.column(v).to_numpy()) for t, v in ((grams, "log"), (tokens, "n"))]
        self._tables = None

    def tables(self) -> list[Table]:
        """(of grams, of tokens)."""
        if self._tables is None:
            self._tables = [Table(*p) for p in self.parts]
            self.parts = None
        return self._tables


def commonest(counts: DataFrame, kind: int, most: int) -> DataFrame:
    """(key, n) of a kind: all whose count is at least the least power of two that ``most`` of them reach at most."""
    rows = counts.where(F.col("kind") == kind)
    sizes = {r["p"]: r["c"] for r in rows.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    power, total = 64, 0
    while power > 0 and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return rows.where(F.col("n") >= 2.0**power).select("key", "n")


def language_model_scores(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1. Null is taken as empty: one token, the end, a score of 0 and
    null bits. A null id counts as held in. Repeated rows are learnt and scored as often as they come. Without training rows
    base and score are those of the smoothing alone. Other columns are not read.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"))
    counts = scratch.cut(corpus_counts(rows.where("NOT held_out").select("text")).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    scratch.free()
    facts = {r["kind"]: (r["n"], r["keys"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).collect()}
    (words, distinct), (texts, _) = (facts.get(k, (0, 0)) for k in (0, 2))
    n_train = words + texts
    denominator = n_train + 0.5 * (distinct + (texts > 0) + 1)
    tree = Tree(counts.where("kind = 1").select("key", "n"), scratch)
    often = tree.log10(commonest(counts, 1, MOST_GRAMS).select("key"), seen=True).toArrow()
    scorer = Scorer(often, commonest(counts, 0, MOST_TOKENS).toArrow())
    shared = scratch.spark.sparkContext.broadcast(scorer)  # MOST_GRAMS and MOST_TOKENS entries
    scratch.free()

    def run(batches):
        grams, tokens = shared.value.tables()
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            data = [(t or "").encode().lower() for t in b.column(1).to_pylist()]
            n_tokens, known, base, score = [], [], [], np.zeros(len(data))
            asked: list[tuple] = []  # (row, kind, key) of what isn't at hand
            for i, d in enumerate(data):
                wh = word_hashes(d.split())
                c, found = tokens.get(wh)
                n_tokens.append(len(wh) + 1)
                known.append(int(found.sum()) + (texts > 0))
                base.append(float(np.log10((np.append(c[found], texts) + 0.5) / denominator).sum()))
                rare = wh[~found]
                asked.append((np.full(len(rare), i), np.zeros(len(rare), np.int8), rare))
            for owner, code in gram_blocks(data):
                logs, found = grams.get(code)
                score += np.bincount(owner[found], logs[found], len(data))
                rare = code[~found]
                asked.append((owner[~found], np.ones(len(rare), np.int8), rare))
            owner, kind, key = (np.concatenate(c) for c in zip(*asked, strict=True))
            order = np.lexsort((key, kind, owner))
            owner, kind, key = owner[order], kind[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(key)))
            offsets = pa.array(np.searchsorted(owner[first], np.arange(len(data) + 1)).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(kind[first]), as_long(key[first]), pa.array(times)], names=["kind", "key", "times"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), pa.array(map(len, data), pa.int64()), listed],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "size", "asked"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    scored = map_arrow(
        rows.withColumn("row", F.monotonically_increasing_id()), run,
        f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, base double, score double, size long, asked array<struct<kind: tinyint, key: long, times: long>>",
    )
    scored = scratch.cut(scored)
    shared.destroy()
    # what is not broadcast is looked up once each: tokens among the counts, grams in the tree
    each = scored.select("row", F.explode("asked").alias("a")).select("row", "a.*")
    distinct_ = scratch.cut(each.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")))
    tokens = distinct_.where("kind = 0").select("kind", "key").join(counts.where("kind = 0").select("key", "n"), "key", "left").select("kind", "key", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    logs = tree.log10(distinct_.where("kind = 1").select("key")).select(F.lit(1).cast("tinyint").alias("kind"), "key", F.col("log").alias("value"))
    values = scratch.cut(tokens.unionByName(logs))
    tree.top.destroy()
    many = distinct_.where(F.col("n") > max(256, (distinct_.agg(F.sum("n")).first()[0] or 0) // 4096)).select("kind", "key")
    hot = values.join(many, ["kind", "key"]).withColumnRenamed("value", "hot")  # 4096 rows at most
    marked = each.join(F.broadcast(hot), ["kind", "key"], "left")
    met = marked.where("hot IS NULL").drop("hot").join(values, ["kind", "key"]).unionByName(marked.where("hot IS NOT NULL").withColumnRenamed("hot", "value"))
    token = F.col("kind") == 0
    extra = met.groupBy("row").agg(
        F.sum(F.when(token & (F.col("value") > 0), F.col("times"))).alias("more"),
        F.sum(F.when(token, F.col("times") * F.log10((F.col("value") + 0.5) / F.lit(float(denominator))))).alias("base_add"),
        F.sum(F.when(~token, F.col("times") * F.col("value"))).alias("add"),
    )
    whole = lambda c, add: F.col(c) + F.coalesce(add, F.lit(0))
    score = whole("score", "add")
    return scored.join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", whole("known", "more").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), whole("base", "base_add").alias("base_score"), score.alias("score"),
        (-score / F.lit(math.log10(2)) / F.when(F.col("size") > 0, F.col("size"))).alias("bits_per_byte"),
    )


def op9_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
