"""Quality summaries, group summaries, correlations, votes and curve areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality_summary(rows: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """QC count, mean and relative deviation, blank mean and the ratio of samples to blanks."""
    of = lambda k: F.when(F.col(kind) == k, F.col(value))
    out = rows.groupBy(*keys).agg(
        F.count(of("QC")).alias("qc_n"), F.avg(of("QC")).alias("qc_mean"), F.stddev_samp(of("QC")).alias("_sd"), F.avg(of("Blank")).alias("blank_mean"), F.avg(of("Sample")).alias("_sample")
    )
    rsd = F.when((F.col("qc_n") >= 2) & (F.col("qc_mean") > 0), F.col("_sd") / F.col("qc_mean") * 100)
    return out.select(*keys, "qc_n", "qc_mean", rsd.alias("qc_rsd"), "blank_mean", F.when(F.col("blank_mean") > 0, F.col("_sample") / F.col("blank_mean")).alias("sample_blank_ratio"))


def group_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("sample_count"), F.count(value).alias("recorded"), F.count_if(F.col(value) > 0).alias("detected"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def metadata_counts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key tuple with how often it came and its first order number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first_id"))


def trapezoid(rows: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time, tie)
    part = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(time) - F.lag(time).over(w))
    return rows.withColumn("_part", part).groupBy(*keys).agg(F.sum("_part").alias("area"))


def consensus(rows: DataFrame, feature: str, sample: str, identity: str) -> DataFrame:
    """Samples with a single identity vote for it; the winner needs more votes than any other."""
    votes = rows.groupBy(feature, sample).agg(F.min(identity).alias("_a"), F.max(identity).alias("_b")).where("_a = _b")
    counted = votes.groupBy(feature, F.col("_a").alias("identity")).agg(F.count("*").alias("support"))
    w = Window.partitionBy(feature)
    counted = counted.withColumn("voting", F.sum("support").over(w)).withColumn("_rank", F.rank().over(w.orderBy(F.desc("support")))).withColumn("_first", F.count_if(F.col("_rank") == 1).over(w))
    return counted.where("_rank = 1 and _first = 1").select(feature, "identity", "support", "voting")


def linear_fit(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def normalised_peaks(rows: DataFrame, keys: list[str], intensity: str, least: float) -> DataFrame:
    """Intensities relative to the group's largest, those of at least ``least``."""
    top = F.max(intensity).over(Window.partitionBy(*keys))
    return rows.withColumn("relative", F.when(top > 0, F.col(intensity) / top)).where(F.col("relative") >= least)
