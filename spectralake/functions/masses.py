"""Masses: errors, windows, fatty acids, neutral masses, hit counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses, and the masses that ions add to the neutral molecule.
CARBON, HYDROGEN, OXYGEN, PROTON = 12.0, 1.00782503223, 15.99491462, 1.007276466621
ION_MASSES = {
    "positive": {"[M+H]+": 1.007276466621, "[M+NH4]+": 18.033825553, "[M+Na]+": 22.989220702, "[M+K]+": 38.963157906},
    "negative": {"[M-H]-": -1.007276466621, "[M+HCOO]-": 44.998202851, "[M+CH3COO]-": 59.013852915},
}


def ppm_error(observed: Column, reference: Column) -> Column:
    """Null where either isn't finite or the reference is 0."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite(observed) & finite(reference) & (reference != 0), F.try_divide(observed - reference, reference) * 1e6)


def window(mz: Column, da: Column | float | None = None, ppm: Column | float | None = None, default_ppm: float | None = None, default_da: float = 0.01) -> Column:
    """The absolute tolerance if there is one, else the relative one, else the default."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("double")
    fallback = F.abs(mz) * default_ppm * 1e-6 if default_ppm is not None else F.lit(default_da)
    return F.coalesce(as_column(da), F.abs(mz) * as_column(ppm) * 1e-6, fallback)


def fatty_acid(carbons: Column, double_bonds: Column, oxygens: Column | int = 2) -> Column:
    """Neutral mass."""
    n = oxygens if isinstance(oxygens, Column) else F.lit(oxygens)
    return carbons * CARBON + (2 * carbons - 2 * double_bonds) * HYDROGEN + n * OXYGEN


def fatty_acid_anion(carbons: Column, double_bonds: Column) -> Column:
    return fatty_acid(carbons, double_bonds) - PROTON


def acylium(carbons: Column, double_bonds: Column, oxygens: Column | int = 2) -> Column:
    return fatty_acid(carbons, double_bonds, oxygens) - (HYDROGEN + OXYGEN)


def ion_shift(ion: Column, mode: str) -> Column:
    out = F.lit(None).cast("double")
    for name, mass in ION_MASSES[mode].items():
        out = F.when(ion == name, mass).otherwise(out)
    return out


def neutral_mass(mz: Column, ion: Column, mode: str) -> Column:
    """Of a singly charged ion; null for an unknown form."""
    return mz - ion_shift(ion, mode)


def rt_delta_seconds(rt: Column, reference: Column) -> Column:
    return F.coalesce(F.abs(rt - reference) * 60, F.lit(0.0))


def fractional_hits(total: Column, fraction: float, least: int) -> Column:
    """How many of ``total`` are asked for: the larger of the share (rounded up) and ``least``, 1 to total; 0 if neither is set."""
    if fraction <= 0 and least <= 0:
        return F.lit(0)
    share = F.ceil(total * max(fraction, 0.0)).cast("int") if fraction > 0 else F.lit(0)
    return F.when(total <= 0, 0).otherwise(F.least(F.greatest(share, F.lit(max(least, 0)), F.lit(1)), total)).cast("int")


def half_hits(total: Column, configured: int = 0) -> Column:
    """Half of ``total``, rounded up and at least 1, or the configured number; never more than total."""
    asked = F.lit(configured) if configured > 0 else F.greatest(F.lit(1), F.ceil(total / 2).cast("int"))
    return F.when(total <= 0, 0).otherwise(F.least(total, asked)).cast("int")
