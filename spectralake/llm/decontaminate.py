"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Texts are lower-cased and split into runs of letters and digits. A mask looks at some words of a short window and ignores
the others; test and training windows with the same hash under a mask meet in a join, and each hit fixes a diagonal
(item, shift). On it the two texts are compared word by word: a leak is a stretch of ``WINDOW`` words (the whole item, if
shorter) of which at least PERCENT per cent are equal. With 13 words and two substitutions the mask 11011 always hits: it has
nine places, and each substituted word spoils four at most. For items shorter than ``WINDOW`` further masks are added where
the benchmark has such items and the given ones would miss an allowed substitution; items of up to four words are met whole.

Hits are found first, as keys and places alone; only rows with a hit are split again and compared. Null and empty texts have
no word and are clean. Repeated rows and repeated items meet like others and give one row for each pair of ids; ties don't
matter, as every stretch counts. Empty tables give no pair and lose no row. Very long texts stay one row; their hits are
grouped by document. Only doc_id, text and item_id are read, so other columns may have any name. The benchmark is broadcast
only while its words and items are at most ``BROADCAST_WORDS``, the keys of rows with a hit only up to ``BROADCAST_KEYS``;
beyond that the joins are shuffled, and adaptive execution splits hot seeds.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import saved

#: Places of the words that a mask looks at.
MASKS = ((0, 1, 3, 4), (0, 2, 3, 6))
WINDOW, PERCENT = 13, 80
BROADCAST_WORDS, BROADCAST_KEYS = 400_000, 500_000


def words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(rows: DataFrame, keys: list[str], masks: tuple[tuple[int, ...], ...], place: str) -> DataFrame:
    """One row for each mask and place of ``_words``: keys, mask, seed, place."""

    def at(mask: tuple[int, ...], number: int) -> Column:
        last = F.size("_words") - (mask[-1] + 1)
        hashed = lambda i: F.xxhash64(F.lit(number), *[F.element_at("_words", i + m + 1) for m in mask])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), hashed)).otherwise(F.array().cast("array<bigint>"))

    return rows.select(*keys, F.explode(F.array(*[at(m, i) for i, m in enumerate(masks)])).alias("_all")).select(*keys, F.posexplode("_all").alias(place, "_seed"))


def with_short(masks: tuple[tuple[int, ...], ...], lengths: list[int], percent: int) -> tuple[tuple[int, ...], ...]:
    """``masks`` and those that items of these lengths need so that every allowed set of substituted words leaves a hit."""
    masks = list(masks)
    for n in sorted(lengths):
        for changed in combinations(range(n), n * (100 - percent) // 100):
            if not any({p + m for m in mask}.isdisjoint(changed) for mask in masks for p in range(n - mask[-1])):
                left = [i for i in range(n) if i not in changed]
                masks.append(tuple(i - left[0] for i in left))
    return tuple(masks)


def leaks(documents: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """One row for each leaked pair: doc_id, item_id, n_windows, best (equal words of the best window)."""
    items = benchmark.select("item_id", words("text").alias("_words"))
    short = items.select(F.size("_words").alias("_n")).where((F.col("_n") > 0) & (F.col("_n") < window)).distinct().collect()
    masks = with_short(masks, [r["_n"] for r in short], percent)
    seeds = _seeds(items, ["item_id"], masks, "_ipos").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.size("_words")).alias("words")).first()
    bounded = size["n"] + (size["words"] or 0) <= BROADCAST_WORDS
    near = F.broadcast if bounded else lambda t: t
    key = F.xxhash64("doc_id", "text").alias("_k")
    rows = documents.select("doc_id", key, words("text").alias("_words"))
    met = _seeds(rows, ["_k"], masks, "_pos").join(near(seeds), "_seed")
    # a key that two rows share by chance costs a comparison more, nothing else
    hits = saved(met.select("_k", "item_id", (F.col("_pos") - F.col("_ipos")).alias("_shift")).distinct())
    keys = hits.select("_k").distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    hit = documents.select("doc_id", "text", key).join(F.broadcast(keys) if few else keys, "_k", "left_semi")
    lengths = items.select("item_id", F.size("_words").alias("_n"))
    grouped = hits.join(near(lengths), "item_id").groupBy("_k").agg(F.collect_list(F.struct("item_id", "_shift", "_n")).alias("_hits"))
    start = lambda h: F.greatest(h["_shift"], F.lit(0))
    stretch = F.transform("_hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["_shift"].alias("shift"), F.slice("_words", start(h) + 1, h["_n"] + F.least(h["_shift"], F.lit(0))).alias("w")))
    texts = near(items.withColumnRenamed("_words", "_item"))
    pairs = hit.join(grouped, "_k").select("doc_id", words("text").alias("_words"), "_hits").select("doc_id", F.explode(stretch).alias("_h")).select("doc_id", "_h.*")
    aligned = pairs.join(texts, "item_id").withColumn("_part", F.slice("_item", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("w")))
    equal = F.zip_with("w", "_part", lambda x, y: F.when(x == y, 1).otherwise(0))
    width = F.least(F.lit(window), F.size("_item"))
    sums = F.when(
        (F.size("_e") >= width) & (width > 0),
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("_e") - width, F.lit(0))), lambda i: F.aggregate(F.slice("_e", i + 1, F.greatest(width, F.lit(1))), F.lit(0), lambda a, x: a + x)),
    )
    good = F.filter("_sums", lambda s: 100 * s >= percent * width)
    found = aligned.withColumn("_e", equal).withColumn("_sums", sums).select("doc_id", "item_id", "shift", F.size(good).alias("n_windows"), F.array_max("_sums").alias("best")).where("n_windows > 0")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"), F.max("best").cast("long").alias("best"))


def keep(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a leak, unchanged; rows without a doc_id are looked up by null."""
    bad = leaks(documents, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(bad, documents.doc_id.eqNullSafe(bad._id), "left_anti")
