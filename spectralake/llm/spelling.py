"""Spelling variant grouping by letter-parity masks in three bands.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One inserted or deleted code point
flips one bit of it, one replaced code point flips two, so of three bands of the mask at least one stays the same. Words are joined
on an equal band, with a length filter: under (band, value, n) meet the words of n code points with each other and with
those of n + 1. Of these only pairs whose masks differ in two bits (equal lengths) or one (lengths n and n + 1) are
verified letter by letter; a pair with several equal bands counts in the first of them. Each task gives one partial result for a
word and group (count of near words, best of them), which a grouped shuffle merges, so no pair leaves its task.

A group of more than TILE words is dealt to tiles, and each pair of tiles is a group of its own: memory is bounded,
and only the words of such a group are repeated, once for each tile. Groups travel in buckets, several to one task call.

Null and empty texts have no words. A null doc_id is hashed as an empty key. Repeated rows count each; their words are hashed
alike. A very long run is one word like any other. An empty table gives an empty table. Of near words that occur equally
often the smallest in code-point order is the form. Forms occur at least twice as often as their words, so following them ends.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import Scratch, encoded, enter, partitions, saved

#: Bands of a mask; words of a tile; pairs and code points of one pass.
BANDS, TILE, _PAIRS, _CELLS = 3, 50_000, 1_000_000, 8_000_000
#: One run in DELETE loses a code point.
DELETE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Bits of a band, and the two bands that a mask is made of beside the joined one.
_BITS = 30
_PARTS = ((1 << _BITS) - 1, ((1 << _BITS) - 1) << _BITS)
#: Distinct runs that a task counts before it sends them on.
MEMORY = 250_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Counter(dict):
    """run (lower-cased UTF-8 bytes) -> index, with the CRC and length of each; counts of runs, and of what deletions made of them."""

    def __init__(self):
        self.crc, self.size, self.n, self.made = array("L"), array("l"), np.zeros(0, np.int64), {}

    def __missing__(self, run: bytes) -> int:
        at = self[run] = len(self)
        self.crc.append(zlib.crc32(run))
        self.size.append(len(run))
        return at

    def add(self, key: bytes, runs: list[bytes]) -> None:
        """Count the runs of a document; ``key`` is what stands before a run where it is hashed.

        CRCs are linear: that of key + run is that of the run xor a term that only depends on the key and the run's length.
        """
        at = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        crc, size = np.frombuffer(self.crc, np.uint64)[at], np.frombuffer(self.size, np.int64)[at]
        start = zlib.crc32(key)
        terms = np.zeros(int(size.max()) + 1, np.uint64)
        for k in np.flatnonzero(np.bincount(size)).tolist():
            terms[k] = zlib.crc32(z := bytes(k), start) ^ zlib.crc32(z)
        h = crc ^ terms[size]
        hit = h % np.uint64(DELETE) == 0
        for i in np.flatnonzero(hit).tolist():
            run = runs[i].decode()
            place = int(h[i]) % len(run)
            word = run[:place] + run[place + 1 :]
            self.made[word] = self.made.get(word, 0) + 1
        if len(self.n) < len(self):
            self.n = np.concatenate((self.n, np.zeros(len(self), np.int64)))
        np.add.at(self.n, at[~hit], 1)

    def flush(self) -> pa.RecordBatch:
        words, n = [*map(bytes.decode, self), *self.made], [*self.n[: len(self)].tolist(), *self.made.values()]
        kept = [(w, k) for w, k in zip(words, n, strict=True) if k and len(w) >= LEAST_LENGTH]
        self.clear()
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())], names=["word", "n"])


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as UTF-8: letters beyond ASCII are C3 and a byte that continues it."""
    a = np.frombuffer(encoded(text).translate(_LOWER), np.uint8)
    beyond = np.zeros(len(a), bool)
    np.logical_and(a[:-1] == 0xC3, a[1:] >> 6 == 2, out=beyond[:-1])
    beyond[1:] |= beyond[:-1]
    return np.where(beyond | ((a >= 97) & (a <= 122)), a, 32).astype(np.uint8).tobytes().split()


def words(documents: DataFrame) -> DataFrame:
    """(word, n): the distinct words, after the deletions, and how often they occur. Tasks count up to MEMORY runs before they send them on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        counter = _Counter()
        for b in batches:
            for d, t in zip(b.column("d").to_pylist(), b.column("text"), strict=True):
                if runs := runs_of(t.as_py()):
                    counter.add(d.encode() + b":", runs)
                if len(counter) > MEMORY:
                    yield counter.flush()
        yield counter.flush()

    keyed = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), "text").where(F.col("text").isNotNull())
    found = keyed.mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def masks(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[word, band]: letters are dealt to the bands by turns, and a letter is a bit of its band."""
    letter = np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    out = np.zeros((len(ends), BANDS), np.int64)
    for b in range(BANDS):
        own = letter % BANDS == b
        np.bitwise_xor.at(out[:, b], owner[own], np.int64(1) << (letter[own] // BANDS))
    return out


def _points(column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(column).encode("utf-32-le"), np.uint32), np.cumsum([len(w) for w in column])


_ROWS = "band int, value long, size int, word string, n long, mask long"


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """Six rows for each word: its three bands, as a word of that size and as one that is longer by one; mask: the other two bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        for b in batches:
            points, ends = _points(b.column("word").to_pylist())
            m = masks(points, ends)
            lengths = np.diff(np.concatenate(([0], ends))).astype(np.int32)
            for band in range(BANDS):
                low, high = (x for x in range(BANDS) if x != band)
                mask, value = pa.array(m[:, low] | m[:, high] << _BITS), pa.array(np.ascontiguousarray(m[:, band]))
                for longer in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), band, np.int32)), value, pa.array(lengths - np.int32(longer)), b.column("word"), b.column("n"), mask], names=["band", "value", "size", "word", "n", "mask"])

    return vocabulary.select("word", "n").mapInArrow(work, _ROWS)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of the code points ``a`` [pairs, n] and ``b`` [pairs, n or n + 1] are exactly one edit apart."""
    n = a.shape[1]
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.minimum.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def _flips(used: int, bits: int, band: int) -> list[int]:
    """What an edit may flip in a mask: ``bits`` of the ``used`` ones, some in each band before ``band`` (else the pair counts there)."""
    single = [1 << i for i in range(2 * _BITS) if used >> i & 1]
    own = single if bits == 1 else [a | b for i, a in enumerate(single) for b in single[i + 1 :]]
    return [x for x in own if all(x & p for p in _PARTS[:band])]


def _compared(left: np.ndarray, right: np.ndarray, bits: int, band: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _looked_up, by comparing all masks: for small groups."""
    step = max(1, _PAIRS // len(right))
    for k in range(0, len(left), step):
        x = left[k : k + step, None] ^ right[None, :]
        ok = np.bitwise_count(x) == bits
        for p in _PARTS[:band]:
            ok &= (x & p) != 0
        i, j = np.nonzero(ok)
        yield (i[i + k < j] + k, j[i + k < j]) if same else (i + k, j)


def _looked_up(left: np.ndarray, right: np.ndarray, flips: list[int], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places with right[j] == left[i] ^ flip for one of the flips, in passes; where ``same``, each pair once."""
    order = np.argsort(right, kind="stable")
    known, first, n = np.unique(right[order], return_index=True, return_counts=True)
    # a linear hash, so that what a flip does to it doesn't depend on the mask
    fold = lambda x: (x ^ (x >> np.int64(20)) ^ (x >> np.int64(40))) & np.int64((1 << 20) - 1)
    there = np.zeros(1 << 20, bool)
    there[fold(known)] = True
    base = fold(left)
    for flip in flips:
        at = np.flatnonzero(there[base ^ fold(np.int64(flip))])
        want = left[at] ^ np.int64(flip)
        if same:
            at, want = at[left[at] < want], want[left[at] < want]
        k = np.minimum(np.searchsorted(known, want), len(known) - 1)
        at, k = at[known[k] == want], k[known[k] == want]
        begin = 0
        while begin < len(at):
            stop = begin + max(1, int(np.searchsorted(np.cumsum(n[k[begin:]]), _PAIRS, "right")))
            many = n[k[begin:stop]]
            i = np.repeat(at[begin:stop], many)
            yield i, order[np.repeat(first[k[begin:stop]] - np.cumsum(many) + many, many) + np.arange(len(i))]
            begin = stop


def candidates(m: np.ndarray, long: np.ndarray, own: np.ndarray, band: int, tiles: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in one group that may be near, the shorter first: masks, whether longer by one, own tile; one of each of the tiles."""
    used = int(np.bitwise_or.reduce(m))
    short, longer = ([np.flatnonzero((long == x) & (own == t)) for t in tiles] for x in (False, True))
    one, two = _flips(used, 1, band), _flips(used, 2, band)
    same = tiles[0] == tiles[1]
    for a, b, flips, bits in ((short[0], short[1], two, 2), (short[0], longer[1], one, 1), *([] if same else [(short[1], longer[0], one, 1)])):
        if len(a) and len(b) and flips:
            once = same and bits == 2
            dear = len(a) * len(b) > len(flips) * (2500 + len(a))
            for x, y in _looked_up(m[a], m[b], flips, once) if dear else _compared(m[a], m[b], bits, band, once):
                yield a[x], b[y]


_PARTIAL = "word string, n_near long, form_n long, form string"


def _near(table: pa.Table) -> pa.Table:
    """For a bucket of groups, each word's number of near words and the best of them."""
    enter("spelling")
    key = ("band", "value", "size", "i", "j")
    table = table.sort_by([(c, "ascending") for c in key])
    columns = [table.column(c).to_numpy() for c in key]
    starts = np.flatnonzero(np.concatenate(([True], np.any([np.diff(c) != 0 for c in columns], axis=0))))
    band, _, size, ti, tj = columns
    words_ = table.column("word").combine_chunks()
    points, ends = _points(words_.to_pylist())
    lengths = np.diff(np.concatenate(([0], ends)))
    begin = ends - lengths
    long, own, m, n = lengths > size, table.column("own").to_numpy(), table.column("mask").to_numpy(), table.column("n").to_numpy()
    pairs = [np.empty((2, 0), np.int64)]
    for lo, hi in zip(starts, [*starts[1:], len(m)], strict=True):
        wide = int(size[lo])
        step = max(1, _CELLS // (wide + 1))
        for x, y in candidates(m[lo:hi], long[lo:hi], own[lo:hi], int(band[lo]), (int(ti[lo]), int(tj[lo]))):
            for k in range(0, len(x), step):  # all of one pass are equally long, or all longer by one
                a, b = lo + x[k : k + step], lo + y[k : k + step]
                ok = one_edit(points[begin[a][:, None] + np.arange(wide)], points[begin[b][:, None] + np.arange(wide + int(long[b[0]]))])
                pairs.append(np.stack((a[ok], b[ok])))
    a, b = np.concatenate(pairs, axis=1)
    word, other = np.concatenate((a, b)), np.concatenate((b, a))
    # of each word the most frequent other, the first by code points
    rank = pa.compute.rank(words_, tiebreaker="first").to_numpy()
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    firsts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))[: len(word)])
    counts = np.diff(np.concatenate((firsts, [len(word)])))
    # rows of a word in several groups of the bucket stay apart: the shuffle merges them
    return pa.table({"word": words_.take(pa.array(word[firsts])), "n_near": pa.array(counts.astype(np.int64)), "form_n": pa.array(n[other[firsts]]), "form": words_.take(pa.array(other[firsts]))})


def _groups(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Rows with the pair of tiles (i, j) of their group and their own tile; groups of one word are left out."""
    key = ["band", "value", "size"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("many")).where("many > 1")
    sizes = scratch.saved(sizes.select(*key, F.ceil(F.col("many") / TILE).cast("int").alias("tiles")))
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(*key, "word", "n", "mask", "own", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): number of near words and the best one, for every word that has any."""
    scratch = Scratch(vocabulary.sparkSession)
    rows = scratch.saved(_keyed(vocabulary))
    # tasks are sized by what meets in them: words, and a group of whole tiles has a bucket of its own
    total = rows.count()
    buckets = max(partitions(vocabulary.sparkSession), 1 + total // (2 * TILE))
    bucket: Column = F.pmod(F.xxhash64("band", "value", "size", "i", "j"), F.lit(buckets))
    partial = _groups(scratch, rows).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_near, _PARTIAL)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w"))).alias("b")
    out = saved(partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.w").alias("form")))
    scratch.clear()
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain word -> form. Every round doubles the steps; counts double at each, so few are needed."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(at.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group(documents: DataFrame) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    vocabulary = saved(words(documents))
    near = near_words(vocabulary).withColumnsRenamed({"n_near": "_near", "form_n": "_form_n", "form": "_form"})
    both = vocabulary.join(near, "word", "left")
    up = F.col("_form_n") >= 2 * F.col("n")
    judged = saved(both.select("word", "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.when(up, F.col("_form")).alias("form"), F.when(up, F.col("_form_n")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
