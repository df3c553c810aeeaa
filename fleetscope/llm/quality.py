"""Quality rules: counted base rules, and a calibrated logistic regression on hashed word and character n-grams.

The classifier is fitted on a bounded sample of labelled rows (``MOST_LABELLED``, those of lowest hash), calibrated on a
fifth of it that the fit doesn't see, and broadcast as a weight table of fixed size. Scoring is one narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, fresh, gram_hashes, map_arrow, word_hashes

#: Labelled rows in the sample, at most; buckets of hashed features; verdict threshold on the calibrated probability.
MOST_LABELLED, BUCKETS, THRESHOLD = 4096, 1 << 15, 0.5
SYMBOLS = b"#*$%&|<>"


def buckets(words: list[bytes], wh: np.ndarray) -> np.ndarray:
    """Hashed word 1- and 2-grams and character 3-grams (over the words joined by blanks) of a text."""
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(2654435761)
    return np.concatenate([(code >> np.uint32(17)).astype(np.int64), (wh % U64(BUCKETS)).astype(np.int64), (gram_hashes(wh, 2, salt=3) % U64(BUCKETS)).astype(np.int64)])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, relative frequencies) of a text."""
    words = text.encode().split()
    at, n = np.unique(buckets(words, word_hashes(words)), return_counts=True)
    return at, n / max(1, n.sum())


class Model:
    """Weights over buckets (applied to scaled relative frequencies), bias, and Platt's slope and shift."""

    SCALE = 100.0

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 250, l2: float = 1e-4) -> Model | None:
    """Full-batch Adam on sparse rows, classes weighted alike; None if a class is missing."""
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~held])) < 2:
        return None
    train = np.flatnonzero(~held)
    at = np.concatenate([rows[i][0] for i in train])
    value = np.concatenate([rows[i][1] for i in train]) * np.float32(Model.SCALE)
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(rows[i][0]) for i in train])
    y = labels[train].astype(float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[at], len(train)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        grad = np.append(np.bincount(at, value * g[row], BUCKETS), g.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    score = np.array([value_ @ w[at_] * Model.SCALE + w[-1] for at_, value_ in rows])
    # Platt: smoothed targets on the held-out fifth, by Newton steps
    z, y = score[held], labels[held].astype(float)
    a, b = 1.0, 0.0
    if len(set(y)) == 2:
        up, n = y.sum(), len(y)
        goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (n - up + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            g = np.array([((p - goal) * z).sum(), (p - goal).sum()])
            s = p * (1 - p)
            h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + np.eye(2) * 1e-6
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        if not np.isfinite(a + b) or a <= 0:
            a, b = 1.0, 0.0
    return Model(w[:-1], float(w[-1]), float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """Fit on at most ``most`` labelled rows; labels of null, or that contradict each other for a doc_id, are left out."""
    clear = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")
    some = clear.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most)

    def run(batches):
        for b in batches:
            got = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0].astype(np.int16) for g in got], pa.list_(pa.int16())), pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))],
                names=["quality", "at", "share"],
            )

    joined = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", "quality")), "doc_id")
    rows = map_arrow(joined.select("quality", "text", "doc_id"), lambda bs: run(b.select(["quality", "text"]) for b in bs), "quality int, at array<smallint>, share array<float>").toArrow()
    if not rows.num_rows:
        return None
    # a fixed order, so that the fit repeats
    got = [(np.array(a.values), np.array(s.values)) for a, s in zip(rows.column("at"), rows.column("share"), strict=True)]  # six bytes a feature
    quality = rows.column("quality").to_numpy()
    order = sorted(range(len(got)), key=lambda i: (xxhash.xxh64_intdigest(got[i][0].tobytes() + got[i][1].tobytes()), quality[i]))
    return fit([got[i] for i in order], quality[order])


def counts(text: str, data: bytes, words: list[bytes], wh: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeats = 0
    if len(words) > 5:
        _, inverse, n = np.unique(gram_hashes(wh, 5), return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        if twice.any():
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            repeats = int((np.cumsum(edge[:-1]) > 0).sum())
    return chars, symbols, len(lines) - len(set(lines)), repeats


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, model: Model | None, q: str = "_q") -> DataFrame:
    """All columns of ``docs`` (doc_id, text and others) after a struct ``q`` with the counts, base_failed, probability and kept."""
    names = docs.columns
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights
    text_at = names.index("text")

    def run(batches):
        model = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in b.column(text_at).to_pylist():
                t = t or ""
                data = t.encode()
                words = data.split()
                n = len(words)
                wh = word_hashes(words)
                row = (n, *counts(t, data, words, wh))
                failed = n < 10 or 100 * row[4] > 20 * n
                p = None
                if model and n:
                    p = model.probability(float(model.weights[buckets(words, wh)].mean()) * Model.SCALE + model.bias)
                for col, v in zip(out, (*row, failed, p, not failed and (p is None or p >= THRESHOLD)), strict=True):
                    col.append(v)
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
            labels = (*COUNTS, "base_failed", "probability", "kept")
            said = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(labels))
            yield pa.RecordBatch.from_arrays([said, *b.columns], names=[q, *names])

    schema = f"`{q}` struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, probability: double, kept: boolean>"
    return map_arrow(docs, run, ", ".join([schema, *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)]))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base rules and classifier keep, unchanged. Null and empty texts go; without labels of both classes only the base rules judge."""
    q = fresh("_q", docs.columns)
    return judged(docs, train(docs, labels), q).where(F.col(q)["kept"]).drop(q)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, probability, kept) of each row.

    Null and empty texts have no words, so that base_failed holds. Without labels of both classes the classifier keeps all
    (probability null). Repeated rows and null ids are judged like any other; other columns are not read.
    """
    rows = judged(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", *(F.col(f"_q.{c}").alias(c) for c in (*COUNTS, "base_failed", "probability", "kept")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
