"""Vector code compression: integer product quantisation with one small codebook for each part of the vectors.

A component x becomes the integer floor(SCALE * x), a vector is cut into ``parts`` equal consecutive parts, and each part is
coded by the index of the nearest entry of its own codebook. Codebooks start as the parts of the ``entries`` smallest vec_ids.
In each round the codebooks (parts * entries * width integers, whatever the input) go to the tasks with the function; Arrow batches
compute all distances as |x|^2 - 2 x.c + |c|^2 by exact int64 matrix products and take the first least one; every task gives one sum
for each entry that it used, a grouped shuffle merges them, and entries become the floors of their means. Unused entries stay.

Rows whose vector is null or holds null or non-finite components are left out. Vectors that are shorter than the longest, or a
length that ``parts`` doesn't divide, are filled up with zeros at the end. Components beyond +-2^27 after scaling are held there, so
that no sum leaves 64 bits. Repeated vec_ids count each and start codebooks in the order of their integers; null vec_ids come
last. With fewer rows than ``entries`` a codebook is as long as there are rows; an empty table gives an empty table. Null
labels are a group of their own. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import enter, saved

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Largest integer of a component; vectors of one pass.
_MOST, _PASS = 1 << 27, 4096


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list column without nulls, filled up with zeros to ``width``."""
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -_MOST, _MOST).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = whole
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and the squared distance, for each row of ``x``."""
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _passes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    enter("vector_codes")
    for b in batches:
        for i in range(0, b.num_rows, _PASS):
            part = b.slice(i, _PASS)
            yield part, integers(part.column("_v"), width)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, total): what the vectors of each entry add up to; one row for each task and used entry before the merge."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, x in _passes(batches, parts * width):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                at, _ = nearest(own, books[p])
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    found = rows.select("_v").mapInArrow(work, "part int, entry int, n long, total array<long>")
    # an array of sums, element by element
    merged = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *merged)


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, width: int) -> np.ndarray:
    """Codebooks [part, entry, position] after ``rounds`` rounds; the driver holds these integers and nothing else."""
    first = rows.select("vec_id", F.transform("_v", lambda x: F.floor(x * SCALE)).alias("_i"), "_v")
    start = first.orderBy(F.asc_nulls_last("vec_id"), "_i").select("_v").limit(entries).toArrow().column("_v").combine_chunks()
    books = np.ascontiguousarray(integers(start, parts * width).reshape(-1, parts, width).swapaxes(0, 1))
    for _ in range(rounds):
        new = books.copy()
        for r in _sums(rows, books).collect():
            new[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
        books = new
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row for each kept row (vec_id, label, code, error, label_error), and the codebooks; entries must not exceed 256."""
    if not 0 < entries <= 256:
        raise ValueError("an index must fit in two hex digits")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v"))
    longest = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    books = codebooks(rows, parts, entries, rounds, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _passes(batches, parts * width):
            at, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at[:, p], far = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in at], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = saved(rows.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    # sums by label first, so that a label of many rows is one row for each task
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"])).select("vec_id", "label", "code", "error", "label_error"), books
