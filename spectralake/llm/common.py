"""Helpers that the operators of this subpackage share: words, hashes, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.session import delete, reliable, shared_folder

U64 = np.uint64
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Separators of words: space and the five ASCII control spaces; bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words whose hashes a Python worker remembers before it starts anew.
VOCABULARY = 200_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; Spark's cleaner removes it with the last reference."""
    reliable(df.sparkSession)
    release(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


class Scratch:
    """Intermediate tables, written as Parquet in the shared folder, until ``drop`` or ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(path)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            delete(self.spark, path)

    def clear(self) -> None:
        self.drop(*[t for t, _ in list(self.paths.values())])


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = 256 << 10) -> Iterator[None]:
    """Within it no side of a join over ``most`` bytes is broadcast. Sides are judged by the compressed bytes of their files, and hashes and
    numbers of rows in order take many times as much in the driver, which builds each relation and holds it twice."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go only once Python and the JVM have collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def once(rows: DataFrame, key: str = "h") -> DataFrame:
    """One row for each ``key``, of rows that are equal where their keys are; repeated ones go before they are shuffled."""
    return rows.groupBy(key).agg(*[F.first(c).alias(c) for c in rows.columns if c != key])


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


_held: list[Callable[[], None]] = []
_owner = [""]


def holds(clear: Callable[[], None]) -> None:
    """Something that a Python worker remembers from task to task; ``clear`` is called when another operator starts there."""
    _held.append(clear)


def enter(operator: str) -> None:
    """Called at the start of each task: workers live on and are handed from operator to operator, what they remember isn't."""
    if _owner[0] != operator:
        for clear in _held:
            clear()
        _owner[0] = operator
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass


class Words(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = Words()
holds(_words.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, a bijection."""
    x = (x ^ (x >> U64(30))) * _B
    x = (x ^ (x >> U64(27))) * _C
    return x ^ (x >> U64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    g = h[:n].copy()
    for j in range(1, k):
        g = mix(g) * _A + h[j : j + n]
    return mix(g)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(column)))


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes; null as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc_bucket(column: str, mod: int):
    """crc32 of a key written as text, modulo mod: the fold of a row, the same at every size."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
