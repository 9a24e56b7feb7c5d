"""Links of spectra to features, unique matches and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectralake.operators.joins import interval_join


def link_nearest(spectra: DataFrame, features: DataFrame, on: list[str], key: str, tolerance: float, window: float, width: float) -> DataFrame:
    """One row for each spectrum (``key``, mz, rt): the nearest feature (feature_id, feature_mz, rt_min, rt_max) or a reason.

    The mass tolerance is relative to the feature's mass, the time has to lie within the peak's bounds. Distance is the
    mass difference over the tolerance plus the time difference from the middle of the peak over ``window``. Reasons:
    linked, outside_rt (a mass matched), no_mass.
    """
    tol = tolerance * (1 + 1e-12)
    near = interval_join(spectra, features, F.col("mz") / (1 + tol), F.col("mz") / (1 - tol), F.col("feature_mz"), width, on=on)
    relative = F.abs(F.col("mz") - F.col("feature_mz")) / F.col("feature_mz")
    inside = F.col("rt").between(F.col("rt_min"), F.col("rt_max"))
    distance = relative / tolerance + F.abs(F.col("rt") - (F.col("rt_min") + F.col("rt_max")) / 2) / window
    # the least of (distance, id) is a plain aggregate with partial sums, so a crowded spectrum needs no sort
    best = near.where(relative <= tolerance).groupBy(key).agg(F.min(F.when(inside, F.struct(distance.alias("distance"), F.col("feature_id")))).alias("_best"))
    reason = F.when(F.col("_best").isNotNull(), "linked").when(F.col("_met"), "outside_rt").otherwise("no_mass")
    return spectra.join(best.withColumn("_met", F.lit(True)), key, "left").select(*spectra.columns, F.col("_best.feature_id").alias("feature_id"), F.col("_best.distance").alias("distance"), reason.alias("reason"))


def unique_only(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches whose key has just one."""
    columns = [c for c in matches.columns if c not in keys]
    one = matches.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    return one.where("_n = 1").select(*matches.columns)


def latest_before(rows: DataFrame, surveys: DataFrame, on: list[str], time: str, survey: str, limit: float) -> DataFrame:
    """Each row with the latest survey of its group at or before it, at most ``limit`` before; of equals the greatest id.

    Surveys go to the time bucket of their own and to the next, rows to one, so windows stay short however long a group is.
    """
    bucket = F.floor(F.col(time) / limit)
    marks = surveys.select(*on, time, F.struct(F.col(time).alias("t"), F.col(survey).alias("id")).alias("_survey"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    left = rows.withColumn("_bucket", bucket).withColumn("_survey", F.lit(None).cast(marks.schema["_survey"].dataType))
    order = [F.col(time), F.col("_survey").isNull(), F.col("_survey.id")]
    w = Window.partitionBy(*on, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = left.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    found = both.withColumn("_last", F.last("_survey", ignorenulls=True).over(w)).where("_row")
    ok = F.col(time) - F.col("_last.t") <= limit
    return found.select(*rows.columns, F.when(ok, F.col("_last.id")).alias(survey), F.when(ok, F.col(time) - F.col("_last.t")).alias("gap"))
