"""Scores: saturation quality, pools with renormalised weights, rank metrics, guarded correlation, cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saturation(intensity: Column, half: float) -> Column:
    return F.least((1 + half) * intensity / (intensity + half), F.lit(1.0))


def pool_scores(rows: DataFrame, keys: list[str], pool: str, quality: Column, weights: dict[str, float]) -> DataFrame:
    """Largest quality of each pool, averaged with the weights of the pools that are there, times 100, clamped to 0 to 100."""
    best = rows.groupBy(*keys).agg(*[F.max(F.when(F.col(pool) == p, quality)).alias(f"pool_{p}") for p in weights])
    part = sum((F.coalesce(F.col(f"pool_{p}"), F.lit(0.0)) * w for p, w in weights.items()), F.lit(0.0))
    there = sum((F.when(F.col(f"pool_{p}").isNotNull(), w).otherwise(0.0) for p, w in weights.items()), F.lit(0.0))
    return best.withColumn("total_score", F.when(there > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * part / there))))


def ppm_score(ppm: Column) -> Column:
    return 1 - F.least(F.abs(ppm), F.lit(10.0)) / 10


def guarded_corr(a: Column, b: Column, least: int = 5, spread: float = 1e-6) -> Column:
    """Correlation of logarithms over rows where both are positive; null for too few rows or a constant side."""
    both = (a > 0) & (b > 0)
    x, y = F.when(both, F.ln(a)), F.when(both, F.ln(b))
    return F.when((F.count(x) >= least) & (F.stddev_pop(x) >= spread) & (F.stddev_pop(y) >= spread), F.corr(x, y))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
