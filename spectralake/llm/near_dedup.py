"""MinHash near-dedup by fast similarity sketching, banding and exact verification on full sets.

A set of shingle hashes is sketched into BINS coordinates by rounds: in the first BINS rounds every element is thrown into
a bin by the round's hash, in the next BINS rounds all elements go to bin (round - BINS), so every coordinate fills;
a coordinate keeps the least (round, value). Work stops when all bins are full, so a set of n elements costs about
n + BINS log BINS. The chance that a pair of similarity 0.8 shares none of the 48 bands of 6 is below 1e-6.

Documents whose whole sets have the same 128-bit digest are one class from the start. In a bucket, classes are linked to a
leader, not to each other; pairs are verified on full sets, components are contracted, and members of a bucket that still
stand in different components get other leaders in further rounds. What is left after ROUNDS of them is compared in tiles
of TILE members: a pair of tiles counts common shingles as a product of matrices and gives only links that
join components, so a bucket of any size is searched whole without one row for each pair. Only the sets of classes that
share a bucket are made again from their texts and travel.

Null and empty texts have no set and are alone; a null doc_id is never the least of a component that has another. Repeated
rows are one class. An empty table gives an empty table. A very long text costs memory in proportion to its distinct
shingles. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import _A, U64, Scratch, encoded, enter, grams, mix, saved, word_hashes
from spectralake.operators.graphs import components

BINS, ROWS = 288, 6
BANDS = BINS // ROWS
#: Rounds of leaders; members of a tile.
ROUNDS, TILE = 3, 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (of the whole sequence where there are fewer words)."""
    words = encoded(text).translate(_LOWER).split()
    if not words:
        return np.empty(0, U64)
    return np.unique(grams(word_hashes(words), min(k, len(words))))


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One 64-bit value per bin: round in the upper bits, value below."""
    out = np.full(bins, np.iinfo(U64).max, U64)
    full, n, step = False, len(elements), 0
    while step < bins and not full:
        many = min(max(1, 2048 // n), bins - step)
        h = mix(elements[None, :] + (np.arange(step, step + many, dtype=U64) * _A)[:, None])
        value = (np.arange(step, step + many, dtype=U64) << U64(48))[:, None] | (mix(h) >> U64(16))
        np.minimum.at(out, ((h >> U64(32)) % U64(bins)).astype(np.int64).ravel(), value.ravel())
        step += many
        full = bool((out < (U64(step) << U64(48))).all())
    if not full:
        empty = np.flatnonzero(out == np.iinfo(U64).max).astype(U64) + U64(bins)
        least = mix(mix(elements[None, :] + (empty * _A)[:, None])).min(axis=1) >> U64(16)
        out[(empty - U64(bins)).astype(np.int64)] = (empty << U64(48)) | least
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    folded = sketched.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=U64)
    for j in range(ROWS):
        h = mix(h * _A + folded[:, j])
    return h


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set, as two signed numbers."""
    return tuple(np.frombuffer(hashlib.blake2b(elements.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _digests(documents: DataFrame, k: int) -> DataFrame:
    """One row for each document: doc_id, key of the row, size and digest of its set, bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column("text")]
            ids = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            banded = [bands(sketch(s)).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(banded, pa.list_(pa.int64()))],
                names=["doc_id", "k", "n_shingles", "c0", "c1", "bands"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", _row().alias("k"), "text").mapInArrow(work, f"doc_id {kind}, k long, n_shingles long, c0 long, c1 long, bands array<long>")


def _row():
    return F.xxhash64("doc_id", "text")


def _sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, items): the full sets of ``wanted`` (k, node, c0, c1), made from the texts of their rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        for b in batches:
            nodes, sets = [], []
            for t, node, c0, c1 in zip(b.column("text"), b.column("node"), b.column("c0").to_pylist(), b.column("c1").to_pylist(), strict=True):
                s = shingles(t.as_py(), k)
                if digest(s) == (c0, c1):
                    nodes.append(node.as_py())
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    return documents.select(_row().alias("k"), "text").join(wanted, "k").select("text", "node", "c0", "c1").mapInArrow(work, "node long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set; elements are columns of matrices, ``width`` at a time."""
    sets, n = [*left, *right], len(left)
    out = np.zeros((n, len(right)), np.int64)
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = counts[which] > 1
    column, owner = (np.cumsum(counts > 1) - 1)[which[often]], owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        out += (m[:n] @ m[n:].T).astype(np.int64)
    return out


def _tiles(scratch: Scratch, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket with different roots: enough of them to join all that are alike.

    Of a bucket's largest component no two members are compared, only the others with each other and with it: tiles
    0 to s - 1 hold the others, tiles from s on the component, and a group is a pair (i, j) of tiles with i < s.
    """

    def work(table: pa.Table) -> pa.Table:
        enter("near_dedup")
        node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        items = [x.values.to_numpy(zero_copy_only=False) for x in table.column("items")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        if len(left) and len(right):
            both = common_counts([items[x] for x in left], [items[x] for x in right])
            size = np.array([len(x) for x in items])
            alike = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            if i == j:
                alike = np.triu(alike, 1)
            head: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := head.get(x, x)) != x:
                    head[x] = head.get(up, up)
                    x = up
                return x

            for x, y in zip(*np.nonzero(alike), strict=True):
                if (p := find(int(root[left[x]]))) != (q := find(int(root[right[y]]))):
                    head[p] = q
                    a.append(int(node[left[x]]))
                    b.append(int(node[right[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    counts = rows.groupBy("band", "root").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("big"), F.max("c").alias("n_big"), F.sum("c").alias("n"))
    tiles = lambda c, size: F.ceil(c / size).cast("int")
    sizes = scratch.saved(sizes.select("band", "big", tiles(F.col("n") - F.col("n_big"), TILE).alias("s"), tiles(F.col("n_big"), 2 * TILE).alias("b")))
    rest = F.col("root") != F.col("big")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = rows.join(sizes, "band").withColumn("own", F.when(rest, deal(F.col("s"))).otherwise(F.col("s") + deal(F.col("b"))))
    others = F.sequence(F.lit(0), F.when(rest, F.col("s") + F.col("b")).otherwise(F.col("s")) - 1)
    dealt = dealt.withColumn("other", F.explode(others)).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    return dealt.join(sets, "node").groupBy("band", "i", "j").applyInArrow(work, "a long, b long")


def group(documents: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(documents.sparkSession)
    rows = saved(_digests(documents, k))
    classes = rows.where("n_shingles > 0").groupBy("c0", "c1").agg(F.min("doc_id").alias("low"), F.min("k").alias("k"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.saved(classes.withColumn("node", F.monotonically_increasing_id()))
    raw = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = scratch.saved(raw.groupBy("band").agg(F.count("*").alias("many")).where("many > 1").select("band"))
    buckets = scratch.saved(raw.join(shared, "band"))
    scratch.drop(shared)
    wanted = buckets.select("node").distinct().join(classes.select("node", "k", "c0", "c1"), "node")
    sets = scratch.saved(_sets(documents, wanted, k))
    links, roots = None, None
    alike = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    for turn in range(ROUNDS + 1):
        if roots is None:
            members = buckets.withColumn("root", F.col("node"))
        else:
            members = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
            apart = scratch.saved(members.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band"))
            members = scratch.saved(members.join(apart, "band"))
            scratch.drop(apart)
        if turn < ROUNDS:
            # what many rows share is saved before it is joined back, so that adaptive execution can split a crowded bucket
            leader = scratch.saved(members.groupBy("band").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn))).alias("l")))
            pairs = members.join(leader, "band").select("node", "n", "root", F.col("l.node").alias("m"), F.col("l.n").alias("n2"), F.col("l.root").alias("r2"))
            pairs = pairs.where(F.col("root") != F.col("r2")).where(alike).select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()
            found = scratch.saved(_verified(pairs, sets, percent))
            scratch.drop(leader)
        else:
            found = scratch.saved(_tiles(scratch, members, sets, percent))
        if roots is not None:
            scratch.drop(members)
        if links is not None and found.isEmpty():
            scratch.drop(found)
            continue  # no new link: the components stay as they are
        links = found if links is None else links.unionByName(found)
        roots = components(links, "a", "b")
    lows = roots.join(classes.select("node", "low"), "node")
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    joined = classes.select("c0", "c1", "low", "node").join(roots, "node", "left").join(least, "component", "left").select("c0", "c1", F.coalesce("component_id", "low").alias("_c"))
    joined = saved(joined)
    scratch.clear()
    out = rows.select("doc_id", "n_shingles", "c0", "c1").join(joined, ["c0", "c1"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("_c")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose doc_id is the least of its component; of rows with one doc_id all stay."""
    kept = group(documents, k, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(kept, documents.doc_id.eqNullSafe(kept._id), "left_semi")
