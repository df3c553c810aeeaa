"""Best-fit packing of tokenised documents into sequences of a fixed length.

Linear grouping on the histogram of lengths, which has ``capacity`` bins however many documents there are: large lengths
are rounded up to the longest of their group of equal cardinality, a linear programme over configurations of the few
rounded lengths is solved by column generation, actual documents take the places of the rounded ones, and what is left,
with all small documents, goes where it fits best. Only counts reach the driver; each document finds its place from its
rank among those of its length.
"""

from __future__ import annotations

import math
import os
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CHUNK
from .common import Scratch, map_arrow

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END = 2048, 0
#: Pieces of one length that are ranked together, at least; a longer list is dealt over salts, as many as a salt has rows.
GROUP = 1_000
#: Chunks whose ids a worker remembers; it takes four times so many characters at a time.
MOST_CHUNKS = 500_000


class ChunkIds(dict):
    """The ids of text chunks by the tokenizers library, encoded a batch of new chunks at a time; emptied at a bound."""

    def __init__(self, path: str, most: int = MOST_CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; one that spells an added token is left to the library whole."""
        chunked = [CHUNK.findall(t) if not any(a in t for a in self.added) else [] for t in texts]
        distinct = set().union(*chunked)
        new = list(distinct.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(distinct)
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[c] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(self.__getitem__, chunks)) if chunks or not t else self._whole(t) for chunks, t in zip(chunked, texts, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def chunk_ids(path: str, most: int = MOST_CHUNKS) -> ChunkIds:
    return ChunkIds(path, most)


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, most_chunks: int = MOST_CHUNKS, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut from the back into full pieces.

    ``forget``: a worker drops the encoder and its table with the task, so that other work finds the memory free.
    """

    def run(batches):
        enc = chunk_ids(path, most_chunks)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < 4 * most_chunks:
                    size += len(texts[j] or "")
                    j += 1
                for doc, ids in zip(docs_[i:j], enc.encode([t or "" for t in texts[i:j]]), strict=True):
                    ids += end
                    n, at, k = len(ids) // 4, 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        for col, v in zip(out, (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                            col.append(v)
                        at, k, size = at + size, k + 1, capacity
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            chunk_ids.cache_clear()

    rows = docs.select("doc_id", "text")
    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """``count`` alike sequences; an item takes places ``first + j * each ...`` of its length in the j-th of them."""

    count: int
    room: int
    items: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, first rank, each, offset

    def split(self, n: int) -> Bins:
        """Cut the first n off; the rest stays here."""
        head = Bins(n, self.room, list(self.items))
        self.items = [(length, first + n * each, each, offset) for length, first, each, offset in self.items]
        self.count -= n
        return head


def best_configuration(sizes: np.ndarray, worth: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within capacity that is worth most (each size as often as it exists at most, if that matters)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(int(sizes.min()), capacity + 1):
        ok = sizes <= w
        v = value[w - sizes[ok]] + worth[ok]
        k = int(v.argmax())
        value[w], pick[w] = (value[w - 1], -1) if value[w - 1] >= v[k] else (v[k], np.flatnonzero(ok)[k])
    out, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            out[pick[w]] += 1
            w -= sizes[pick[w]]
    return np.minimum(out, limits)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 400) -> list[tuple[int, np.ndarray]]:
    """(how often, items of each size): the linear programme's basic solution, rounded down.

    ``most_steps`` bounds the columns that are tried; every basis on the way is a solution, so stopping early may cost a few
    sequences and places every document all the same.
    """
    g = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(most_steps):
        worth = np.linalg.solve(basis.T, np.ones(g))
        column = best_configuration(sizes, worth, demand, capacity).astype(float)
        if worth @ column <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        x = x - ratio[k] * step
        x[k] = ratio[k]
        basis[:, k] = column
    return [(int(x[k] + 1e-9), basis[:, k].astype(np.int64)) for k in range(g) if x[k] + 1e-9 >= 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 48, small: int | None = None) -> list[Bins]:
    """Sequences for ``histogram`` (length: count), all lengths from 1 to capacity."""
    left = {n: c for n, c in histogram.items() if c}
    taken = dict.fromkeys(left, 0)
    small = capacity // 8 if small is None else small
    done: list[Bins] = []

    def take(length: int, n: int) -> int:
        first = taken[length]
        taken[length] += n
        left[length] -= n
        return first

    if c := left.get(capacity, 0):
        done.append(Bins(c, 0, [(capacity, take(capacity, c), 1, 0)]))
    large = sorted((n for n in left if small < n and left[n]), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # groups of equal cardinality from the longest down; a length stays in one group
        members: list[list[int]] = []
        seen = 0
        for n in large:
            k = min(groups - 1, seen * groups // total)
            if not members or k >= len(members) and seen * groups >= len(members) * total:
                members.append([])
            members[-1].append(n)
            seen += left[n]
        sizes = np.array([m[0] for m in members])
        demand = np.array([sum(left[n] for n in m) for m in members], float)
        for times, items in sorted(configurations(sizes, demand, capacity), key=lambda c: -int(c[1] @ sizes)):
            todo = [Bins(times, capacity)]
            for k in np.flatnonzero(items):
                for _ in range(items[k]):
                    nxt: list[Bins] = []
                    for b in todo:  # actual documents, longest first, take the place of the rounded ones
                        while b.count:
                            n = next((n for n in members[k] if left[n]), None)
                            if n is None:
                                nxt.append(b)
                                break
                            head = b.split(min(b.count, left[n]))
                            head.items.append((n, take(n, head.count), 1, capacity - head.room))
                            head.room -= n
                            nxt.append(head)
                    todo = nxt
            done += [b for b in todo if b.items]
    by_room: dict[int, list[Bins]] = {}
    for b in done:
        by_room.setdefault(b.room, []).append(b)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            room = next((r for r in range(n, capacity) if by_room.get(r)), None)
            if room is None:
                each = min(capacity // n, left[n])
                b = Bins(max(1, left[n] // each), capacity)
                done.append(b)
            else:
                b = by_room[room].pop()
                each = min(b.room // n, left[n])
                if b.count > (full := max(1, left[n] // each)):
                    head = b.split(full)
                    by_room[room].append(b)
                    done.append(head)
                    b = head
            b.items.append((n, take(n, b.count * each), each, capacity - b.room))
            b.room -= n * each
            by_room.setdefault(b.room, []).append(b)
    return [b for b in done if b.count and b.items]


def fewest(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """The best plan over a few numbers of groups and bounds of small lengths."""
    plans = [plan(histogram, capacity, groups, small) for groups, small in ((48, capacity // 8), (96, capacity // 4), (48, capacity // 3), (96, capacity // 2))]
    return min(plans, key=lambda bins: sum(b.count for b in bins))


def pack(docs: DataFrame, scratch: Scratch, path: str | None = None, capacity: int = CAPACITY, most_chunks: int = MOST_CHUNKS, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A null or empty text is its end id alone. Rows that repeat are packed as often as they come; null ids too. Ranks are
    counted within (length, salt), so that a length that a third of all pieces have is spread. Other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = scratch.cut(pieces_of(docs, path, capacity, most_chunks, forget))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    bins = fewest(histogram, capacity)
    lengths = docs.sparkSession.createDataFrame([(n, -(-c // max(GROUP, math.isqrt(c)))) for n, c in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.cut(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(base, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))

    table, first_id = [], 0
    for b in bins:
        table += [(length, first, each, offset, first_id) for length, first, each, offset in b.items]
        first_id += b.count
    table.sort()
    cols = [np.array(c, np.int64) for c in zip(*table, strict=True)] if table else [np.empty(0, np.int64)] * 5
    key = cols[0] * 2**48 + cols[1]

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(key, length * 2**48 + rank, side="right") - 1
            j, i = np.divmod(rank - cols[1][k], cols[2][k])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(cols[4][k] + j), pa.array(cols[3][k] + i * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, place, f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
