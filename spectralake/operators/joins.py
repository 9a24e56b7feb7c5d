"""Tolerance and link joins: equi-joins on bins with the exact predicate kept as the residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.functions.masses import ppm_error
from spectralake.session import dealt


#: Bins that one probe row may touch.
MOST_BINS = 100_000


def interval_join(probe: DataFrame, build: DataFrame, low: Column, high: Column, value: Column, width: float, on: list[str] | None = None, deal: bool = False) -> DataFrame:
    """Rows of probe with the rows of build whose ``value`` lies in [low, high]; ``width`` is the bin, about high - low.

    The probe side goes to every bin its interval touches, the build side to one, so no pair is made twice and the join is
    an equi-join that shuffles by bin and the columns of ``on``. Nulls, NaN and empty intervals match nothing; an interval of
    more than MOST_BINS bins is an error, as it asks for a larger width. ``deal`` keeps the parts of both sides from being merged.
    """
    left = probe.withColumn("_low", low).withColumn("_high", high).where("_low <= _high and not isnan(_low) and not isnan(_high)")
    first, last = F.floor(F.col("_low") / width), F.floor(F.col("_high") / width)
    wide = F.when(last - first >= MOST_BINS, F.raise_error(F.lit("an interval is far wider than the bins")).cast("long")).otherwise(last)
    left = left.withColumn("_bin", F.explode(F.sequence(first, wide)))
    right = build.withColumn("_value", value).where("_value is not null and not isnan(_value)").withColumn("_bin", F.floor(F.col("_value") / width))
    keys = [*(on or []), "_bin"]
    out = dealt(left, *keys).join(dealt(right, *keys).hint("merge"), keys) if deal else left.join(right, keys)
    return out.where(F.col("_value").between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high", "_value")


def near_masses(probe: DataFrame, build: DataFrame, mass: Column, value: Column, ppm: float, on: list[str] | None = None) -> DataFrame:
    """Rows of probe with the rows of build whose ``value`` lies within ppm of ``mass``, by bins on a logarithmic axis.

    A tolerance in ppm touches two or three bins there whatever the mass; bins of one width would be many for heavy masses.
    """
    axis = lambda x: F.signum(x) * F.log1p(F.abs(x))
    left, right = probe.withColumn("_mass", mass), build.withColumn("_near", value)
    tol, slack = F.abs("_mass") * ppm * 1e-6, 1e-9
    out = interval_join(left, right, axis(F.col("_mass") - tol) - slack, axis(F.col("_mass") + tol) + slack, axis(F.col("_near")), max(2e-6 * ppm, 1e-8), on=on)
    return out.where(F.col("_near").between(F.col("_mass") - tol, F.col("_mass") + tol)).drop("_mass", "_near")


def mass_candidates(features: DataFrame, library: DataFrame, mz: str, theoretical: str, ppm: float, width: float = 0.05, on: list[str] | None = None) -> DataFrame:
    """Candidates within ppm of the theoretical mass (and equal in ``on``, such as the polarity), with the signed error ``ppm_error``."""
    f = ppm * 1e-6
    out = interval_join(features, library, F.col(mz) / (1 + f), F.col(mz) / (1 - f), F.col(theoretical), width, on=on)
    return out.withColumn("ppm_error", ppm_error(F.col(mz), F.col(theoretical)))


def precursor_candidates(spectra: DataFrame, library: DataFrame, mz: str, theoretical: str, ppm: float, width: float = 0.05) -> DataFrame:
    """Candidates within ppm of the observed mass."""
    tol = F.col(mz) * ppm * 1e-6
    return interval_join(spectra, library, F.col(mz) - tol, F.col(mz) + tol, F.col(theoretical), width)


def unsupported(rows: DataFrame, support: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a supporting row."""
    return rows.join(support.select(*on).distinct(), on, "left_anti")
