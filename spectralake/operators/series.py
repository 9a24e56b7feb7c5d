"""Chromatogram-like series: extraction, signal profiles, anchor clusters, residual filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.operators.clusters import with_stretch


def extracted(rows: DataFrame, keys: list[str], mz: str, intensity: str, targets: list[float], tolerance: float) -> DataFrame:
    """For each group and target: the intensity nearest in mass (the larger of equals) and the sum over the window."""
    every = rows.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    off = F.abs(F.col(mz) - F.col("target"))
    inside = every.where(off <= tolerance)
    least = F.min(F.struct(off.alias("off"), (-F.col(intensity)).alias("minus")))
    return inside.groupBy(*keys, "target").agg((-least["minus"]).alias("nearest"), F.sum(intensity).alias("window_sum"), F.count("*").alias("n_points"))


def signal_profile(rows: DataFrame, keys: list[str], order: list[str], time: str, value: str) -> DataFrame:
    """Values clipped at 0 and smoothed by a triangle of three (edges repeated): count, 20 % background, largest, median cadence, baseline, noise.

    The baseline is the median of the lowest 20 % of raw values. Noise, 1 at least, is the scaled median absolute deviation of the steps between neighbours that are both within the lowest
    20 % of raw values, or of those values themselves where there are fewer than three such steps.
    """
    w, group = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    y = F.greatest(F.col(value), F.lit(0.0))
    smooth = (F.coalesce(F.lag(y).over(w), y) + 2 * y + F.coalesce(F.lead(y).over(w), y)) / 4
    profile = rows.withColumn("_y", smooth).withColumn("_dt", F.col(time) - F.lag(time).over(w)).withColumn("_raw", y).withColumn("_last", F.lag(y).over(w))
    profile = profile.withColumn("_edge", F.percentile("_raw", F.lit(0.2)).over(group))
    low = F.col("_raw") <= F.col("_edge")
    profile = profile.withColumn("_low", F.when(low, F.col("_raw"))).withColumn("_step", F.when(low & (F.col("_last") <= F.col("_edge")), F.col("_raw") - F.col("_last")))
    profile = profile.withColumn("_step_off", F.abs(F.col("_step") - F.median("_step").over(group))).withColumn("_low_off", F.abs(F.col("_low") - F.median("_low").over(group)))
    spread = F.when(F.count("_step") >= 3, F.median("_step_off") / 2**0.5).otherwise(F.median("_low_off"))
    return profile.groupBy(*keys).agg(F.count("*").alias("n_points"), F.percentile("_y", F.lit(0.2)).alias("background"), F.max("_y").alias("apex"), F.median("_dt").alias("cadence"), F.median("_low").alias("baseline"), F.greatest(1.4826 * spread, F.lit(1.0)).alias("noise"))


def areas(rows: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Trapezoid area, and the area of what stands over the line between a group's first and last value."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t, y = F.col(time), F.col(value)
    t0, t1, y0, y1 = F.first(time).over(whole), F.last(time).over(whole), F.first(value).over(whole), F.last(value).over(whole)
    out = rows.withColumn("_base", F.when(t1 > t0, y0 + (y1 - y0) * (t - t0) / (t1 - t0)).otherwise(y0)).withColumn("_over", F.greatest(y - F.col("_base"), F.lit(0.0)))
    part = lambda c: (F.col(c) + F.lag(c).over(w)) / 2 * (t - F.lag(time).over(w))
    return out.withColumn("_a", part(value)).withColumn("_k", part("_over")).groupBy(*keys).agg(F.sum("_a").alias("area"), F.sum("_k").alias("corrected"))


def anchor_clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Sorted values; a new cluster begins farther than the tolerance from the first member. One row for each cluster.

    Stretches without a gap beyond the tolerance are independent, so only the distinct values of one stretch meet in a row.
    """
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    # values with an empty bin of the tolerance's width between them are farther apart than the tolerance
    placed = with_stretch(counted, keys, F.col("_v"), tolerance, "_stretch")
    lists = placed.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_all"))
    empty = F.array().cast("array<struct<anchor:double,n:bigint>>")
    one = lambda v, n: F.struct(v.alias("anchor"), n.alias("n"))

    def add(acc: Column, x: Column) -> Column:
        near = x["_v"] - acc["last"]["anchor"] <= tolerance
        return F.when(near, F.struct(acc["done"].alias("done"), one(acc["last"]["anchor"], acc["last"]["n"] + x["_n"]).alias("last"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["last"])).alias("done"), one(x["_v"], x["_n"]).alias("last"))
        )

    start = F.struct(empty.alias("done"), one(F.col("_all")[0]["_v"], F.lit(0).cast("bigint")).alias("last"))
    folded = F.aggregate("_all", start, add, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    return lists.select(*keys, F.explode(folded).alias("_c")).select(*keys, F.col("_c.anchor").alias("anchor"), F.col("_c.n").alias("n"))


def residual_actions(rows: DataFrame, keys: list[str], y: str, x: str, accept: float, suspect: float) -> DataFrame:
    """Rows with their residual from the group's line, in units of its root mean square, and keep, suspect or reject.

    Of a group that lies on its line every residual is 0; a group without a line (one x) keeps null residuals and is kept.
    """
    sums = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"), F.regr_syy(y, x).alias("_syy"), F.regr_r2(y, x).alias("_r2"), F.count("*").alias("_n"))
    fit = sums.withColumn("_rms", F.sqrt(F.col("_syy") * (1 - F.col("_r2")) / F.col("_n"))).drop("_syy", "_r2", "_n")
    plain = F.abs(F.col(y) - F.col("_a") * F.col(x) - F.col("_b"))
    off = F.when(F.col("_rms") > 0, F.try_divide(plain, F.col("_rms"))).when(plain.isNotNull(), 0.0)
    action = F.when(F.col("residual").isNull() | (F.col("residual") <= accept), "keep").when(F.col("residual") <= suspect, "suspect").otherwise("reject")
    return rows.join(fit, keys).withColumn("residual", off).withColumn("action", action).drop("_a", "_b", "_rms")
