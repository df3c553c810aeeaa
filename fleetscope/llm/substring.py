"""Substring dedup by compaction of the de Bruijn graph of word windows.

Nodes are sequences of ``WINDOW - 1`` words, edges the windows of ``WINDOW`` words. An edge is repeated if it starts in two
documents; its source is the smallest of them, at (doc, start).

1. Each text gives its runs: stretches of windows with one minimizer (the least hash of their ``SEED``-word grams). Equal
   windows have equal minimizers, so windows can only repeat among runs that share one. Runs of equal content are one edge
   stretch; where a minimizer has several contents, the runs are opened into single windows, taken from the text of their
   smallest document.
2. The stretches that repeat are the edges of the graph. A node with one stretch in and one out is no branch; stretches that
   follow each other in one source over such nodes are compacted into paths, by joins that double the distance they reach.
3. A document's stretches that lie alike on a path make one span. The words of each path are fetched at its source
   coordinates, and a span's words are compared with them one by one: only windows whose words are those of the source go.

Hashes of 64 bits bring candidates together; they never decide.
"""

from __future__ import annotations

import hashlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULT, U64, Scratch, as_long, fresh, gram_hashes, hot_keys, map_arrow, mix, word_hashes

WINDOW, SEED = 13, 5
#: Documents, and bytes of text, that are hashed together; their equal runs travel as one row.
SLICE, SLICE_BYTES = 1024, 4 << 20


class Runs:
    """The runs of some texts (lists of words), text after text.

    owner, at, windows: text, place in it and hash of each window; first, size, minimizer, content: of each run, ``first`` being
    the place of its first window among all.
    """

    def __init__(self, texts: list[list[bytes]], window: int = WINDOW, seed: int = SEED) -> None:
        counts = np.fromiter(map(len, texts), np.int64, count=len(texts))
        self.hashes = wh = word_hashes([w for words in texts for w in words])
        self.window = window
        owner = np.repeat(np.arange(len(texts)), counts)
        # windows that lie in one text
        self.place = place = np.flatnonzero(owner[: len(wh) - window + 1] == owner[window - 1 :]) if len(wh) >= window else np.empty(0, np.int64)
        self.owner = owner[place]
        self.at = place - (np.cumsum(counts) - counts)[self.owner]
        self.windows = gram_hashes(wh, window, salt=11)[place]
        n = len(place)
        if not n:
            self.first, self.size, self.minimizer, self.content = (np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
            return
        grams = gram_hashes(wh, seed)
        low = grams[: len(wh) - window + 1].copy()
        for j in range(1, window - seed + 1):
            np.minimum(low, grams[j : j + len(low)], out=low)
        low = low[place]
        self.first = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | (self.owner[1:] != self.owner[:-1])) + 1])
        self.minimizer = low[self.first]
        # a run's windows in order: a polynomial over their hashes, and their number
        self.size = np.diff(np.append(self.first, n))
        k = np.arange(n) - np.repeat(self.first, self.size)
        self.content = mix(np.add.reduceat(self.windows * mix(k.astype(np.uint64) + MULT[0]), self.first) + self.size.astype(np.uint64))

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """(node that it starts from, node that it ends in) of each window."""
        all_ = gram_hashes(self.hashes, self.window - 1, salt=7)
        return all_[self.place], all_[self.place + 1] if len(self.place) else all_[self.place]


def slices(batch: pa.RecordBatch, column: int):
    """A batch in parts of SLICE rows and about SLICE_BYTES of text at most."""
    sizes = [len(t or "") for t in batch.column(column).to_pylist()]
    i = 0
    while i < len(sizes):
        j, held = i, 0
        while j < len(sizes) and j - i < SLICE and (j == i or held + sizes[j] <= SLICE_BYTES):
            held += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def combined(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows of one key as one: (index of its first (doc, at), largest doc if there are more, the other (doc, at) pairs)."""
    order = np.argsort(key, kind="stable") if (doc[1:] >= doc[:-1]).all() and (at[1:] >= at[:-1])[doc[1:] == doc[:-1]].all() else np.lexsort((at, doc, key))
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    end = np.append(first[1:], len(k))
    pairs = np.stack([doc[order], at[order]], axis=1).astype("<i8")
    many = end - first > 1
    more: list[bytes | None] = [None] * len(first)
    for i in np.flatnonzero(many).tolist():
        more[i] = pairs[first[i] + 1 : end[i]].tobytes()
    most = pa.array(pairs[end - 1, 0] if len(k) else np.empty(0, np.int64), mask=~many)
    return order[first], most, pa.array(more, pa.binary())


def text_runs(docs: DataFrame) -> DataFrame:
    """(m, run, doc, at, most, more) of documents (n, text): each run of each, equal ones of a slice in one row."""

    def emit(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            r = Runs([split(t) for t in b.column(1).to_pylist()])
            doc, at = b.column(0).to_numpy()[r.owner[r.first]], r.at[r.first]
            rows, most, more = combined(r.content, doc, at)
            yield pa.RecordBatch.from_arrays([as_long(r.minimizer[rows]), as_long(r.content[rows]), pa.array(doc[rows]), pa.array(at[rows].astype(np.int32)), most, more], names=["m", "run", "doc", "at", "most", "more"])

    return map_arrow(docs.where("n IS NOT NULL").select("n", "text"), emit, "m long, run long, doc long, at int, most long, more binary")


_EDGE = "key long, doc long, at int, n int, head long, tail long"


def source_edges(docs: DataFrame) -> DataFrame:
    """(whole, key, doc, at, n, head, tail, most, more) of documents (n, text, runs, kinds) at the runs that they are the source of.

    A run of kind 1 or 3 gives its stretch (whole), one of kind 2 or 3 its windows; equal windows of a slice are one row.
    """

    def emit(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            r = Runs([split(t) for t in b.column(1).to_pylist()])
            head, tail = r.nodes()
            ids = b.column(0).to_numpy()
            # what is listed for each text, found again among its runs
            counts = np.diff(b.column(2).offsets.to_numpy())
            want, kinds = b.column(2).flatten().to_numpy().view(np.uint64), b.column(3).flatten().to_numpy()
            want = want + np.repeat(np.arange(len(counts)), counts).astype(np.uint64) * MULT[1]
            order = np.argsort(want)
            own = r.content + r.owner[r.first].astype(np.uint64) * MULT[1]
            i = np.minimum(np.searchsorted(want[order], own), len(want) - 1)
            kind = np.where(want[order[i]] == own, kinds[order[i]], 0)
            k = np.flatnonzero(kind & 1)
            k = k[np.unique(own[k], return_index=True)[1]]  # one place a text will do
            p = np.flatnonzero(np.repeat(kind & 2, r.size))
            f = r.first[k]
            for whole, cols in ((True, (r.content[k], ids[r.owner[f]], r.at[f], r.size[k], head[f], tail[f + r.size[k] - 1])), (False, (r.windows[p], ids[r.owner[p]], r.at[p], np.ones(len(p), np.int64), head[p], tail[p]))):
                rows, most, more = combined(*cols[:3])
                key, doc, at, n, h, t = (c[rows] for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), whole)), as_long(key), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), as_long(h), as_long(t), most, more],
                    names=["whole", "key", "doc", "at", "n", "head", "tail", "most", "more"],
                )

    return map_arrow(docs, emit, f"whole boolean, {_EDGE}, most long, more binary")


def compacted(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, path) of edges (key, src, at, n, head, tail): path is the key of the first edge of the nonbranching path.

    Two edges are linked at a node with one edge in and one out if the second starts where the first ends in their source.
    Each round joins what an edge points to with what that one points to, so a path of n edges takes log2(n) rounds.
    """
    out = edges.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    into = edges.groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    before = edges.select(F.col("tail").alias("node"), "src", (F.col("at") + F.col("n")).alias("at"), F.col("key").alias("up"))
    after = edges.select(F.col("head").alias("node"), "src", "at", "key")
    links = before.join(out.join(into, "node"), "node").join(after, ["node", "src", "at"]).select("key", "up")
    cur = scratch.cut(edges.select("key").join(links, "key", "left").select("key", F.coalesce("up", "key").alias("path"), F.col("up").isNotNull().alias("open")))
    while not cur.where("open").isEmpty():
        above = cur.select(F.col("key").alias("path"), F.col("path").alias("up"), F.col("open").alias("more"))
        moved = cur.where("open").join(above, "path").select("key", F.col("up").alias("path"), F.col("more").alias("open"))
        nxt = scratch.cut(cur.where("NOT open").unionByName(moved))
        scratch.drop(cur)
        cur = nxt
    return cur.select("key", "path")


def spans_on_paths(chunks: DataFrame) -> DataFrame:
    """(doc, path, base, lo, hi) of (path, src, offset, n, doc, at, more): the windows lo to hi - 1 of a document lie on the path, shifted by base."""

    def emit(batches):
        for b in batches:
            path, src, offset, n, doc, at = (b.column(i).to_numpy().astype(np.int64) for i in range(6))
            more = b.column(6).to_pylist()
            rest = [i for i, x in enumerate(more) if x is not None]
            pairs = [np.frombuffer(more[i], "<i8").reshape(-1, 2) for i in rest]
            owner = np.concatenate([np.arange(len(doc)), np.repeat(np.array(rest, np.int64), [len(p) for p in pairs])])
            doc, at = (np.concatenate([own, *(p[:, c] for p in pairs)]) for c, own in ((0, doc), (1, at)))
            keep = doc > src[owner]
            owner, doc, at = owner[keep], doc[keep], at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(path[owner]), pa.array(at - offset[owner]), pa.array(at), pa.array(at + n[owner])], names=["doc", "path", "base", "lo", "hi"])

    found = map_arrow(chunks.select("path", "src", "offset", "n", "doc", "at", "more"), emit, "doc long, path long, base long, lo long, hi long")
    return found.groupBy("doc", "path", "base").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def path_words(docs: DataFrame) -> DataFrame:
    """(path, words) of documents (n, text, paths: array of (path, start, windows)): the words at a path's source coordinates."""

    def emit(batches):
        for b in batches:
            path, said = [], []
            for t, listed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = split(t)
                for p in listed:
                    path.append(p["path"])
                    said.append(b" ".join(words[p["start"] : p["start"] + p["windows"] + WINDOW - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(said, pa.string())], names=["path", "words"])

    return map_arrow(docs, emit, "path long, words string")


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, spans: array of (lo, words)) of documents (n, text): where a document may repeat a smaller one, and the words of that one."""
    docs = docs.where("n IS NOT NULL").select("n", "text")
    runs = scratch.cut(text_runs(docs))
    shared = scratch.cut(runs.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.count("most").alias("many")).where("n > 1 OR many > 0").select(F.col("m").alias("key"), "n"))
    scratch.free()
    hot = hot_keys(shared, scratch).select(F.col("key").alias("m"), F.lit(True).alias("hot"))
    marked = runs.join(F.broadcast(hot), "m", "left")  # a hot minimizer's runs meet by content and window, never by minimizer
    rest = marked.where("hot IS NULL").join(shared.select(F.col("key").alias("m")), "m")
    hits = scratch.cut(rest.unionByName(marked.where("hot")).select("m", "run", "doc", "at", "most", "more", "hot"))
    scratch.drop(runs)
    scratch.free()
    least = scratch.cut(hits.groupBy("m", "run").agg(F.min("doc").alias("src"), F.max(F.coalesce("most", "doc")).alias("most"), F.max("hot").alias("hot")))
    several = least.where("hot IS NULL").groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m", F.lit(True).alias("open"))
    opened = least.where("hot IS NULL").join(several, "m", "left").unionByName(least.where("hot").withColumn("open", F.lit(True)))
    kind = F.when(F.col("src") < F.col("most"), 1).otherwise(0) + F.when(F.col("open"), 2).otherwise(0)
    listed = opened.select("src", "run", kind.cast("tinyint").alias("kind")).where("kind > 0").groupBy("src").agg(F.collect_list(F.struct("run", "kind")).alias("l"))
    listed = listed.select(F.col("src").alias("n"), F.col("l.run").alias("runs"), F.col("l.kind").alias("kinds"))
    found = scratch.cut(source_edges(docs.join(listed, "n").select("n", "text", "runs", "kinds")))
    scratch.free()

    place = F.min(F.struct("doc", "at", "n", "head", "tail")).alias("s")
    stretches = found.where("whole").groupBy("key").agg(place)
    windows = found.where("NOT whole").groupBy("key").agg(place, F.max(F.coalesce("most", "doc")).alias("most")).where("s.doc < most").drop("most")
    edges = scratch.cut(stretches.unionByName(windows).dropDuplicates(["key"]).select("key", F.col("s.doc").alias("src"), "s.at", "s.n", "s.head", "s.tail"))
    paths = compacted(edges, scratch)
    start = edges.select(F.col("key").alias("path"), F.col("at").alias("start"))
    located = scratch.cut(edges.join(paths, "key").join(start, "path").select("key", "path", "src", "start", (F.col("at") - F.col("start")).alias("offset"), "n"))
    chunks = hits.select(F.col("run").alias("key"), "doc", "at", "more").unionByName(found.where("NOT whole").select("key", "doc", "at", "more"))
    spans = scratch.cut(spans_on_paths(chunks.join(located, "key")))
    for done in (hits, least, found):
        scratch.drop(done)
    scratch.free()

    whole = located.groupBy("path").agg(F.first("src").alias("n"), F.first("start").alias("start"), F.max(F.col("offset") + F.col("n")).alias("windows"))
    wanted = whole.groupBy("n").agg(F.collect_list(F.struct("path", "start", "windows")).alias("paths"))
    words = path_words(docs.join(wanted, "n").select("n", "text", "paths"))
    # a path that many documents hold is met in as many places as it has shares of the spans
    counts = scratch.cut(spans.groupBy(F.col("path").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    often = hot_keys(counts, scratch).select(F.col("key").alias("path"), F.ceil(F.col("n") / 256).cast("int").alias("salts"))
    dealt = spans.join(F.broadcast(often), "path", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("doc"), "salts"), F.lit(0)))
    copies = words.join(F.broadcast(often), "path", "left").select("path", "words", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    piece = F.array_join(F.slice(F.split("words", " "), (F.col("lo") - F.col("base") + 1).cast("int"), (F.col("hi") - F.col("lo") + WINDOW - 1).cast("int")), " ")
    out = dealt.join(copies, ["path", "salt"]).select("doc", F.struct("lo", piece.alias("words")).alias("span"))
    out = scratch.cut(out.groupBy("doc").agg(F.collect_list("span").alias("spans")))
    for done in (edges, located, spans):
        scratch.drop(done)
    scratch.free()
    return out


def covered(words: list[bytes], los: list[int], sources: list[str], window: int = WINDOW) -> np.ndarray:
    """A bool for each word: whether a window covers it whose words are, one by one, those of its source.

    ``los``: where spans of windows start; ``sources``: the words there that a smaller document has.
    """
    out = np.zeros(len(words), bool)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, count=len(words)) + 1).tolist()  # one past the blank after each word
    for lo, source in zip(los, sources, strict=True):
        said = source.encode()
        n = said.count(b" ") + 1
        if lo + n <= len(words) and text[ends[lo - 1] if lo else 0 : ends[lo + n - 1] - 1] == said:  # most spans, at once
            out[lo : lo + n] = True
            continue
        theirs = said.split(b" ")
        own = words[lo : lo + n]
        same = np.fromiter(map(eq, own, theirs), bool, count=len(own))
        total = np.concatenate([[0], np.cumsum(same)])
        for at in np.flatnonzero(total[window:] - total[:-window] == window).tolist():
            out[lo + at : lo + at + window] = True
    return out


def _spans(column: pa.ListArray) -> list[tuple[list[int], list[str]] | None]:
    """(los, words) of each row's spans."""
    at, flat = column.offsets.to_pylist(), column.values
    los, said = flat.field("lo").to_pylist(), flat.field("words").to_pylist()
    return [(los[i:j], said[i:j]) if j > i else None for i, j in zip(at[:-1], at[1:], strict=True)]


def numbered(docs: DataFrame, n: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a long column ``n`` in the order of doc_id: an integral id itself, else its place in a range-partitioned sort."""
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn(n, F.col("doc_id").cast("long"))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy("doc_id")
    ids = scratch.cut(ids.select("doc_id", F.monotonically_increasing_id().alias(n)))
    return docs.join(ids, "doc_id", "left").select(*docs.columns, n)


def substring_digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id (of any type that has an
    order). Null, empty and shorter texts lose nothing; rows that share a doc_id don't touch each other; a row with a null id
    neither loses words nor takes any. Of equal windows the smallest doc_id keeps its own. Other columns are not read.
    """
    rows = numbered(docs.select("doc_id", "text"), "n", scratch)
    marked = rows.join(repeated(rows, scratch), F.col("n") == F.col("doc"), "left").select("doc_id", "text", "spans")

    def digest(batches):
        for b in batches:
            n, gone, said = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), _spans(b.column(2)), strict=True):
                words = split(t)
                n.append(len(words))
                if spans:
                    out = covered(words, *spans)
                    gone.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    gone.append(0)
                said.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(marked, digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def drop_substrings(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with repeated words cut out of ``text`` (a text that loses nothing is unchanged) and ``n_chars`` counted anew.

    Kept words keep the white space before them. A document that loses all words stays with an empty text. Null, empty and
    repeated rows and null ids are as in substring_digest; columns of any name may stand beside.
    """
    names = docs.columns
    n_, own, spans_ = (fresh(c, names) for c in ("_n", "_doc", "_spans"))
    rows = numbered(docs, n_, scratch)
    found = repeated(rows.select(F.col(n_).alias("n"), "text"), scratch).toDF(own, spans_)
    marked = rows.join(found, F.col(n_) == F.col(own), "left").drop(n_, own)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def cut(text: str, out: np.ndarray) -> str:
        data, kept, end = text.encode(), [], 0
        for w, gone in zip(data.split(), out.tolist(), strict=True):
            start = data.index(w, end)
            if not gone:
                kept.append(data[end if kept else start : start + len(w)])
            end = start + len(w)
        return b"".join(kept).decode()

    def run(batches):
        for b in batches:
            texts, sizes = [], []
            for t, spans in zip(b.column(at).to_pylist(), _spans(b.column(len(names))), strict=True):
                if spans:
                    out = covered(split(t), *spans)
                    t = cut(t, out) if out.any() else t
                texts.append(t)
                sizes.append(None if t is None else len(t))
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if chars >= 0:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(marked, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))


#: Windows as text, each with the smallest document that starts it; words that such a window covers go.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS said FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM d WHERE len(words) >= 13)),
f AS (SELECT said, min(doc_id) AS first FROM w GROUP BY said),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM w JOIN f USING (said) WHERE first < doc_id), generate_series(0, 12) AS s(k)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS said FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
