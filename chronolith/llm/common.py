"""Session settings, scratch tables and word hashes used by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.storage import new_path, written

__all__ = ["WORD", "Scratch", "fold_of", "new_path", "small_batches", "text_key", "word_hashes", "word_places", "written"]

#: A word of the contracts: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables that a step writes for itself. ``done`` deletes them once the step's own result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


_LETTERS = np.random.default_rng(51).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE, _ROOT = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each; kept up to 8 MB, enough for most texts."""
    if len(_powers[0]) >= n:
        return _powers
    size = 1 << n.bit_length()
    grown = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, _ROOT)]
    if size <= 1 << 19:
        _powers[:] = grown
    return grown


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last one."""
    b = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = (b != 32) & ((b - np.uint8(9)) > 4)
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' random numbers by powers of an odd number, from sums over the whole text."""
    first, end = word_places(raw)
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[np.frombuffer(raw, np.uint8)] * up[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[first]) * down[first]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds: rows, and bytes where Spark has that setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that identify a row by the given columns (null included)."""
    return [F.xxhash64(F.lit(11), *cols).alias("k1"), F.xxhash64(F.lit(7919), *cols).alias("k2")]
