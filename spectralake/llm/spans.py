"""Spans of documents whose fixed-length windows occur elsewhere: the part that suffix-array and substring dedup share.

``rule`` says when a window goes: "again" (it starts anywhere else too) or "earlier" (it also starts in a document with
a smaller doc_id). The steps:

1. Every document is cut into phrases (see anchors). Phrases travel in packed blocks to the bucket of their seed; only
   those whose seed occurs again are kept. A seed that is common within one block stays out of its bucket: the block
   sends a mark there and keeps the phrases aside, so no bucket follows a hot seed.
2. Phrases that are equal as a whole (128 bits: seed and phrase) settle all their windows by a grouped count or minimum.
3. One copy of each phrase whose seed has other phrases too is sent as text to the shard of its seed, where ``judge``
   (an index over the shard's texts) says which of its windows go.
4. Seeds with more than ``hot`` phrases would make a shard as large as themselves: their windows are settled one by one by a
   grouped count or minimum over 128-bit hashes.

Rows are told apart by doc_id and the hash of the text, so repeated rows get the same spans and count as often as they
stand there; a null text has no window; with "earlier", a null doc_id is neither smaller nor larger than another, and a
doc_id that isn't an integer is refused. All other columns of the input are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from spectralake.llm.anchors import Rolling, phrases
from spectralake.llm.common import U64, Scratch, enter, partitions, saved

_SECOND = U64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Source:
    """How texts become symbols, how stretches of them travel, and how a shard judges them.

    ``judge(texts, starts, values)`` gets the phrases of a shard, the number of window starts that each owns and its value
    (occurrences for "again", least doc_id for "earlier") and returns, for each, which of its starts go.
    """

    symbols: Callable[[str | None], np.ndarray]
    pieces: Callable[[str, np.ndarray, np.ndarray], list[bytes]]
    judge: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]
    window: int
    seed: int
    #: Symbols of a shard; phrases of a block; occurrences in a block from which on a seed stays out of its bucket; phrases of
    #: a seed beyond which its windows are settled one by one.
    shard: int
    block: int = 300_000
    common: int = 64
    hot: int = 2000


def _keys(documents: DataFrame, again: bool) -> list[Column]:
    kind = documents.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        d = F.col("doc_id").cast("long")
    elif again:
        d = F.xxhash64("doc_id")
    else:
        raise ValueError("doc_id must be an integer: the rule asks for smaller ids")
    return [F.coalesce(d, F.lit(-(2**63)).cast("long")).alias("d"), F.xxhash64("text").alias("h")]


def _raw(x: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(x.astype(kind, copy=False)).tobytes()


_BLOCKS = "bucket long, seed binary, phrase binary, d binary, h binary, first binary, span binary, marks binary"
_ENTRIES = "seed long, phrase long, d long, h long, first int, span int"
_KINDS = {"seed": U64, "phrase": U64, "d": np.int64, "h": np.int64, "first": np.int32, "span": np.uint16}


def _blocks(documents: DataFrame, source: Source, again: bool, buckets: int) -> DataFrame:
    """Step 1, map side: packed phrases for each bucket; negative buckets hold phrases of seeds that are common in a block."""

    def flush(parts: list[tuple], rows: list[tuple[int, int]]) -> pa.RecordBatch:
        n = [len(x[0]) for x in parts]
        which = np.repeat(np.arange(len(n)), n)
        first, last, seed, phrase = (np.concatenate(c) for c in zip(*parts, strict=True))
        keys = np.array(rows, np.int64)
        order = np.argsort(seed)
        which = which[order]
        columns = {"seed": seed[order], "phrase": phrase[order], "d": keys[which, 0], "h": keys[which, 1], "first": first[order], "span": (last - first)[order]}
        s = columns["seed"]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        runs = np.diff(np.concatenate((starts, [len(s)])))
        common = np.repeat(runs >= source.common, runs)
        of = lambda x: ((x >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)  # noqa: E731  rises with x
        out: dict[str, list] = {c: [] for c in ("bucket", *columns, "marks")}

        def put(bucket: int, at: np.ndarray | slice, marks: np.ndarray) -> None:
            out["bucket"].append(bucket)
            out["marks"].append(_raw(marks, U64))
            for c, x in columns.items():
                out[c].append(_raw(x[at], _KINDS[c]))

        rare, marked = np.flatnonzero(~common), s[starts[runs >= source.common]]
        b, m = of(s[rare]), of(marked)
        for i in np.union1d(b, m):
            put(int(i), rare[np.searchsorted(b, i) : np.searchsorted(b, i, "right")], marked[np.searchsorted(m, i) : np.searchsorted(m, i, "right")])
        aside = np.flatnonzero(common)
        for i in range(0, len(aside), 5_000):
            at = aside[i : i + 5_000]
            put(-1 - int(columns["phrase"][at[0]] >> U64(2)), at, s[:0])
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in (*columns, "marks"))], names=list(out))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spans")
        parts, rows, total = [], [], 0
        for b in batches:
            for d, h, t in zip(b.column("d").to_pylist(), b.column("h").to_pylist(), b.column("text"), strict=True):
                symbols = source.symbols(t.as_py())
                if len(symbols) >= source.window:
                    parts.append(phrases(Rolling(symbols), source.window, source.seed))
                    rows.append((d, h))
                    total += len(parts[-1][0])
                    if total >= source.block:
                        yield flush(parts, rows)
                        parts, rows, total = [], [], 0
        if parts:
            yield flush(parts, rows)

    rows = documents.where(F.col("text").isNotNull() & (F.lit(again) | F.col("doc_id").isNotNull()))
    return rows.select(*_keys(documents, again), "text").mapInArrow(work, _BLOCKS)


def _entries(blocks: DataFrame, again: bool) -> DataFrame:
    """Step 1, reduce side: one row for each phrase whose seed occurs again."""

    def work(table: pa.Table) -> pa.Table:
        enter("spans")
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        x = {c: joined(c, kind) for c, kind in _KINDS.items()}
        if table.column("bucket")[0].as_py() >= 0:
            order = np.argsort(x["seed"], kind="stable")
            s = x["seed"][order]
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
            runs = np.diff(np.concatenate((starts, [len(s)])))
            if again or not len(s):
                shared = runs > 1
            else:
                d = x["d"][order]
                shared = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)
            shared |= np.isin(s[starts], joined("marks", U64))
            keep = order[np.repeat(shared, runs)]
            x = {c: v[keep] for c, v in x.items()}
        return pa.table({c: pa.array(v.view(np.int64) if v.dtype == U64 else v.astype(np.int32) if c in ("first", "span") else v) for c, v in x.items()})

    return blocks.groupBy("bucket").applyInArrow(work, _ENTRIES)


def _lists(scratch: Scratch, entries: DataFrame, source: Source, again: bool) -> DataFrame:
    """Step 2: for each document the runs of starts that go, and the phrases that a shard has to look into."""
    dictionary = scratch.saved(entries.groupBy("seed", "phrase").agg(F.count("*").alias("n"), F.min("d").alias("low")))
    kinds = scratch.saved(dictionary.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    known = scratch.saved(dictionary.join(kinds, "seed", "left"))
    scratch.drop(dictionary, kinds)
    rows = entries.join(known, ["seed", "phrase"])
    settled = F.col("n") > 1 if again else F.col("low") < F.col("d")
    opened = F.col("kinds").isNotNull() & (F.col("d") == F.col("low"))
    value = F.col("n") if again else F.col("low")
    marked = rows.select("d", "h", "first", "span", "seed", value.alias("v"), (F.coalesce("kinds", F.lit(0)) > source.hot).alias("hot"), settled.alias("settled"), opened.alias("opened")).where("settled or opened")
    out = scratch.saved(
        marked.groupBy("d", "h").agg(
            F.collect_list(F.when(F.col("settled"), F.struct("first", "span"))).alias("settled"),
            F.collect_list(F.when(F.col("opened"), F.struct("first", "span", "seed", "v", "hot"))).alias("opened"),
        )
    )
    scratch.drop(known)
    return out


_PIECES = "shard long, d long, h long, first int, span int, v long, piece binary, w1 long, w2 long"


def _pieces(documents: DataFrame, lists: DataFrame, source: Source, again: bool, shards: int) -> DataFrame:
    """The texts of opened phrases with their shard; for hot seeds, one row for each window with its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spans")
        for b in batches:
            for d, h, t, x in zip(b.column("d").to_pylist(), b.column("h").to_pylist(), b.column("text"), b.column("opened"), strict=True):
                text = t.as_py()
                first, span, seed, v, hot = (f.to_numpy(zero_copy_only=False) for f in x.values.flatten())
                columns = []
                if not hot.all():
                    at = np.flatnonzero(~hot)
                    n = len(at)
                    empty = pa.nulls(n, pa.int64())
                    piece = pa.array(source.pieces(text, first[at], first[at] + span[at] + source.window), pa.binary())
                    columns.append((pa.array((seed[at].view(U64) % U64(shards)).astype(np.int64)), n, first[at], span[at], v[at], piece, empty, empty))
                if hot.any():
                    at = np.flatnonzero(hot)
                    n = span[at] + 1
                    pos = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    symbols = source.symbols(text)
                    one, two = (Rolling(s).hashes(pos, pos + source.window).view(np.int64) for s in (symbols, symbols * _SECOND + U64(1)))
                    columns.append((pa.nulls(len(pos), pa.int64()), len(pos), pos, np.zeros(len(pos)), np.repeat(v[at], n), pa.nulls(len(pos), pa.binary()), pa.array(one), pa.array(two)))
                for shard, n, f, s, value, piece, w1, w2 in columns:
                    yield pa.RecordBatch.from_arrays(
                        [shard, pa.array(np.full(n, d, np.int64)), pa.array(np.full(n, h, np.int64)), pa.array(f.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(value.astype(np.int64)), piece, w1, w2],
                        names=["shard", "d", "h", "first", "span", "v", "piece", "w1", "w2"],
                    )

    opened = lists.where(F.size("opened") > 0).select("d", "h", "opened")
    return documents.select(*_keys(documents, again), "text").join(opened, ["d", "h"]).mapInArrow(work, _PIECES)


def _judged(pieces: DataFrame, source: Source) -> DataFrame:
    """Step 3: the runs of starts that go, by the index of each shard."""
    judge = source.judge

    def work(table: pa.Table) -> pa.Table:
        enter("spans")
        d, h, first, span, v = (table.column(c).to_numpy() for c in ("d", "h", "first", "span", "v"))
        gone = judge(table.column("piece").to_pylist(), span + 1, v)
        out: list[tuple] = []
        for i, g in enumerate(gone):
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                out += [(d[i], h[i], first[i] + a, b - a - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        a = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({"d": a[:, 0], "h": a[:, 1], "first": a[:, 2].astype(np.int32), "span": a[:, 3].astype(np.int32)})

    return pieces.where("shard is not null").groupBy("shard").applyInArrow(work, "d long, h long, first int, span int")


def spans(documents: DataFrame, source: Source, rule: str) -> DataFrame:
    """(d, h, spans): runs (first, span) of window starts that go; rows without any may be missing."""
    spark, again = documents.sparkSession, rule == "again"
    scratch = Scratch(spark)
    entries = scratch.saved(_entries(_blocks(documents, source, again, partitions(spark, 4)), again))
    lists = _lists(scratch, entries, source, again)
    scratch.drop(entries)
    symbols = lists.agg(F.sum(F.aggregate("opened", F.lit(0).cast("long"), lambda a, x: a + x["span"] + source.window))).first()[0] or 0
    pieces = scratch.saved(_pieces(documents, lists, source, again, 1 + symbols // source.shard))
    windows = pieces.where("shard is null")
    measure = F.sum("v").alias("c") if again else F.min("v").alias("c")
    common = scratch.saved(windows.groupBy("w1", "w2").agg(measure, F.max("v").alias("top")).where("c > 1" if again else "c < top").select("w1", "w2", "c"))
    hit = windows.join(common, ["w1", "w2"])
    single = (hit if again else hit.where("c < v")).select("d", "h", "first", "span")
    extra = _judged(pieces, source).unionByName(single).groupBy("d", "h").agg(F.collect_list(F.struct("first", "span")).alias("extra"))
    nothing = F.array().cast("array<struct<first:int,span:int>>")
    found = lists.join(extra, ["d", "h"], "left").select("d", "h", F.concat("settled", F.coalesce("extra", nothing)).alias("spans")).where(F.size("spans") > 0)
    out = saved(found)
    scratch.clear()
    return out


def covered(n: int, first: np.ndarray, span: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols stand in a window that goes."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + span + window, -1)
    return np.cumsum(edge)[:n] > 0


def cut(documents: DataFrame, found: DataFrame, columns: list[str], work: Callable[[str | None, tuple | None], tuple], shape: str, again: bool) -> DataFrame:
    """``work(text, (firsts, spans) or None)`` for every row; its results (``shape``) are added to ``columns``."""
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text", *_keys(documents, again))
    added = StructType.fromDDL(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spans")
        for b in batches:
            out = [work(t.as_py(), tuple(f.to_numpy(zero_copy_only=False).astype(np.int64) for f in s.values.flatten()) if s.is_valid else None) for t, s in zip(b.column("text"), b.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array([x[i] for x in out]) for i in range(len(added)))], names=["row", *added.names])

    schema = StructType([StructField("row", base.schema["row"].dataType), *added.fields])
    return base.join(found, ["d", "h"], "left").select("row", "text", "spans").mapInArrow(run, schema)
