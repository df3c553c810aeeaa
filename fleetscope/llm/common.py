"""Scratch tables, word hashing and row plumbing that the operators share."""

from __future__ import annotations

import gc
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.shared import folder
from fleetscope.shipping import ship

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
#: Odd multipliers of the multilinear hash over consecutive words.
MULT = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * U64(2) + U64(1)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every worker."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for what is computed meanwhile."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int):
    """Python gets batches of so many rows at most in what is computed meanwhile: for rows that hold several texts."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that an input doesn't have."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder: they cut the lineage, survive lost executors and give the planner true sizes.

    With ``release`` the shuffle files of a step go as soon as its table is written, not when Spark's cleaner gets to them.
    """

    def __init__(self, spark: SparkSession, release: bool = False) -> None:
        self.spark = spark
        self.release = release
        self.root = folder(spark, "fleetscope")
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true") if self.release else nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of cut() that no plan needs any more."""
        self._delete(df._scratch_path)

    def clear(self) -> None:
        """Delete all tables of cut(), when no plan needs any."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps."""
        gc.collect()
        self.spark._jvm.System.gc()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One XXH64 for each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_hashes(wh: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A mixed multilinear hash of every k consecutive words; empty if there are fewer."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, U64(salt * 0x9E3779B97F4A7C15 % 2**64), np.uint64)
    for j in range(k):
        out += wh[j : j + n] * MULT[(j + salt) % 64]
    return mix(out)


def shingle_hashes(wh: np.ndarray, k: int) -> np.ndarray:
    """gram_hashes, but a text of fewer words gives one hash of its whole sequence; no words, none."""
    if 0 < len(wh) < k:
        return gram_hashes(wh, len(wh), salt=len(wh))
    return gram_hashes(wh, k)


def hot_keys(counts: DataFrame, scratch: Scratch, share: int = 4096, least: int = 256) -> DataFrame:
    """(key, n) of ``counts`` (key, n) for keys with over 1 / share of all rows (and over ``least``): ``share`` keys at most, whatever the input's size."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return scratch.cut(counts.where(F.col("n") > max(least, total // share)))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ragged(flat: pa.Array, counts: list[int]) -> pa.ListArray:
    """A list column from its concatenated values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
