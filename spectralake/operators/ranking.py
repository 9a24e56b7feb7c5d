"""Top-k, tie-aware ranks and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.session import dealt


def topk(rows: DataFrame, keys: list[str], order: list[Column], k: int, count: str | None = None) -> DataFrame:
    """The first k rows of each group with their ``rank``; ``count`` names a column for the whole group's size."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    if count:
        out = out.withColumn(count, F.count("*").over(w))
    return out.where(F.col("rank") <= k)


def best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topk(rows, keys, order, 1).drop("rank")


def tolerance_rank(rows: DataFrame, keys: list[str], score: str, order: list[Column], tolerance: float = 1e-9) -> DataFrame:
    """Dense rank by falling score in which neighbours within the tolerance share a rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *order)
    step = F.when(F.abs(F.col(score) - F.lag(score).over(w)) <= tolerance, 0).otherwise(1)
    return rows.withColumn("_step", step).withColumn("rank", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def topk_ties(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows ranked up to k, with all that share the last rank."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def tiers(rows: DataFrame, keys: list[str], kind: str, score: str, fragments: str, order: list[Column], tolerance: float = 1e-9) -> DataFrame:
    """Adds ``tier`` and ``demoted``: scores within the tolerance of the best are the top, of which rows with fewer fragments than
    the most of their kind are demoted to the second tier; below, a row opens a tier where it lies beyond the tolerance of the row before it.
    """
    w = Window.partitionBy(*keys)
    top = F.abs(F.col(score) - F.max(score).over(w)) <= tolerance
    out = dealt(rows, *keys).withColumn("_top", top)
    most = F.max(F.when(F.col("_top"), F.col(fragments))).over(Window.partitionBy(*keys, kind))
    out = out.withColumn("demoted", F.col("_top") & (F.col(fragments) < most))
    out = out.withColumn("_part", F.when(~F.col("_top"), 2).otherwise(F.col("demoted").cast("int")))
    o = w.orderBy("_part", F.desc(score), *order)
    far = F.abs(F.col(score) - F.lag(score).over(o)) > tolerance
    opens = F.when(F.lag("_part").over(o).isNull(), True).when((F.col("_part") == 1) & (F.lag("_part").over(o) == 0), True).when(F.col("_part") == 2, far).otherwise(False)
    return out.withColumn("_opens", opens.cast("int")).withColumn("tier", F.sum("_opens").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_top", "_part", "_opens")


def result_ranks(rows: DataFrame, keys: list[str], kind: str, score: str, fragments: str, place: list[Column], tolerance: float = 1e-9) -> DataFrame:
    """Ranks of rows in their selected order: 1 for the first; from 1 to 2 at a demoted row or at an equal score of the same kind with
    another number of fragments; elsewhere one more where the score differs from the row before.
    """
    o = Window.partitionBy(*keys).orderBy(*place)
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    tied = F.abs(F.col(score) - F.lag(score).over(o)) <= tolerance
    first = F.lag(score).over(o).isNull()
    leaves = F.col("demoted") | (tied & (F.col(kind) == F.lag(kind).over(o)) & (F.col(fragments) != F.lag(fragments).over(o)))
    out = rows.withColumn("_far", ~first & ~tied).withColumn("_any", ~first & (~tied | leaves))
    out = out.withColumn("_n", F.sum(F.col("_any").cast("int")).over(upto))
    step = (F.col("_any") & (F.col("_n") == 1)) | (F.col("_far") & (F.col("_n") > 1))
    return out.withColumn("_step", step.cast("int")).withColumn("rank", 1 + F.sum("_step").over(upto)).drop("_far", "_any", "_n", "_step")


def rank_metrics(score: Column, ppm: Column, full: float = 10.0) -> list[Column]:
    """normalized, ppm_score and rank_score: the score over 100 and the nearness in mass, both within 0 and 1."""
    normal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100))
    return [normal.alias("normalized"), F.greatest(F.lit(0.0), 1 - F.least(F.abs(ppm), F.lit(full)) / full).alias("ppm_score"), normal.alias("rank_score")]


def selected(rows: DataFrame, keys: list[str], rank: str, place: list[Column], qualifies: Column, top_n: int, capped: Column) -> DataFrame:
    """The first row, rows tied with the one before, and qualified rows, until ``top_n`` are taken and a new rank begins; of ``capped``
    rows at most min(top_n, 3). Only rows up to the rank at which selection stops are looked at, so a cumulative count decides.
    """
    o = Window.partitionBy(*keys).orderBy(*place)
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    tied = F.col(rank) == F.lag(rank).over(o)
    out = rows.withColumn("_taken", F.coalesce(tied, F.lit(True)) | qualifies).withColumn("_tied", F.coalesce(tied, F.lit(False)))
    out = out.withColumn("_stop", ~F.col("_tied") & (F.coalesce(F.sum(F.col("_taken").cast("int")).over(before), F.lit(0)) >= top_n))
    out = out.withColumn("_over", F.max("_stop").over(o.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_taken") & ~F.col("_over"))
    out = out.withColumn("_capped", F.sum(capped.cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(~capped | (F.col("_capped") <= min(top_n, 3))).drop("_taken", "_tied", "_stop", "_over", "_capped")


def scope(name: Column, compound_class: Column) -> Column:
    """main, fa or nae: precursor-only channels are ranked apart."""
    kind, said = F.upper(F.trim(F.coalesce(compound_class, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(kind == "FA", "fa").when(kind == "NAE", "nae").when(said.isin("fa", "nae"), said).otherwise("main")


def first_order(rows: DataFrame, keys: list[str], order: str, name: str = "group_order") -> DataFrame:
    """Adds the first order number of each group, by which groups come out in the order of their first row."""
    firsts = rows.groupBy(*keys).agg(F.min(order).alias(name))
    return rows.join(firsts, keys)


def distinct_identities(rows: DataFrame, keys: list[str], identity: str, order: list[Column], k: int = 3) -> DataFrame:
    """The first k distinct identities of each group in the order, each by its first row, with ``place`` from 1."""
    once = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, identity).orderBy(*order))).where("place = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def per_carbon(rows: DataFrame, keys: list[str], score: str, rt: str, order: str) -> DataFrame:
    """One row for each group: of those with the best score (of all, where no row has one) the one nearest their median time, first of equals."""
    best = rows.where(" and ".join(f"{k} is not null" for k in keys)).where(F.col(rt).isNotNull())
    top = best.groupBy(*keys).agg(F.max(score).alias("_top"))
    contenders = best.join(top, keys).where(F.col("_top").isNull() | (F.col(score) == F.col("_top")))
    middle = contenders.groupBy(*keys).agg(F.median(rt).alias("_mid"))
    pick = F.min(F.struct(F.abs(F.col(rt) - F.col("_mid")).alias("off"), F.col(order).alias("o")))
    chosen = contenders.join(middle, keys).groupBy(*keys).agg(pick.alias("_p")).select(*keys, F.col("_p.o").alias(order))
    return rows.join(chosen, [*keys, order], "left_semi")


def binned_points(rows: DataFrame, keys: list[str], carbon: str, rt: str, order: list[Column], width: float = 0.05, most: int = 20) -> DataFrame:
    """The first row of each time bin (bins round half to even) and of those at most ``most`` of each carbon."""
    binned = rows.withColumn("_bin", F.bround(F.col(rt) / width).cast("long"))
    once = topk(binned, [*keys, carbon, "_bin"], order, 1).drop("rank")
    return topk(once, [*keys, carbon], order, most).drop("_bin", "rank")


def without_repeated_acids(rows: DataFrame, order: str) -> DataFrame:
    """One row for each file, name and adduct of free fatty acids: linked first, then intensity, relative intensity, fragments, error, time.

    Other classes stay as they are. Rows: compound_class, source_file, matched_name, adduct, feature_id, intensity, relative_intensity,
    n_fragments, ppm_error, rt.
    """
    acid = F.upper(F.trim(F.coalesce("compound_class", F.lit("")))) == "FA"
    number = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    linked = F.trim(F.coalesce(F.col("feature_id").cast("string"), F.lit(""))) != ""
    by = [F.desc(linked), F.desc(number("intensity", 0.0)), F.desc(number("relative_intensity", 0.0)), F.desc(number("n_fragments", 0)), F.abs(number("ppm_error", float("inf"))), number("rt", float("inf")), F.col(order)]
    return rows.where(~acid).unionByName(best(rows.where(acid), ["source_file", "matched_name", "adduct"], by))


PRIORITY = {"double_bond_level": 4, "tentative_double_bond_level": 3, "chain_level": 3, "tentative_chain_level": 2, "species_level": 2, "tentative_species_level": 1}


def collapse_reports(rows: DataFrame, keys: list[str], resolution: str, score: str, fragments: str, ppm: str, order: str) -> DataFrame:
    """One row for each reported identity (``keys``): by resolution, score, fragments and error, the first of equals; ``group_order``
    is the place of the identity's first row, in which order the reference order of results is kept.
    """
    level = F.lit(0)
    for name, value in PRIORITY.items():
        level = F.when(F.col(resolution) == name, value).otherwise(level)
    by = [F.desc(level), F.desc(score), F.desc(fragments), F.abs(ppm), F.col(order)]
    return best(first_order(rows, keys, order), keys, by)


def library_order(rows: DataFrame, mass: str, order: str, width: float = 10.0) -> DataFrame:
    """Adds ``position``, the place by mass and then input order: counts of mass bins are summed apart, so rows are numbered bin by bin."""
    binned = rows.withColumn("_bin", F.floor(F.col(mass) / width))
    sizes = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).select("_bin", "_before")
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(mass, order))
    return binned.withColumn("position", place).join(before, "_bin").withColumn("position", F.col("position") + F.col("_before")).drop("_bin", "_before")
