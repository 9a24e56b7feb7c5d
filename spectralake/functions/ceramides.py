"""Formulas and masses of ceramides with an esterified omega-hydroxy acyl chain, from their names."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectralake.functions.masses import PROTON

# The form of the names, masses of the elements.
NAME = r"^Cer\s*d(\d+):(\d+)/(\d+):(\d+)\(O-(\d+):(\d+)\)$"
CARBON, HYDROGEN, NITROGEN, OXYGEN = 12.0, 1.00782503223, 14.00307400443, 15.99491461957
FORMATE, ACETATE = CARBON + 2 * HYDROGEN + 2 * OXYGEN, 2 * CARBON + 4 * HYDROGEN + 2 * OXYGEN


def _number(name: Column, i: int) -> Column:
    return F.regexp_extract(name, NAME, i).try_cast("int")


def _counts(name: Column) -> tuple[Column, Column]:
    carbons = reduce(add, [_number(name, i) for i in (1, 3, 5)])
    return carbons, carbons * 2 - 1 - reduce(add, [_number(name, i) * 2 for i in (2, 4, 6)])


def formula(name: Column) -> Column:
    """Null for other names."""
    c, h = _counts(name)
    return F.when(name.rlike(NAME), F.concat(F.lit("C"), c, F.lit("H"), h, F.lit("NO5")))


def precursor(name: Column, adduct: Column) -> Column:
    """Null for other names and adducts."""
    c, h = _counts(name)
    shift = F.when(adduct == "[M+H]+", PROTON).when(adduct == "[M-H]-", -PROTON).when(adduct == "[M+HCOO]-", FORMATE - PROTON).when(adduct == "[M+CH3COO]-", ACETATE - PROTON)
    return F.when(name.rlike(NAME), c * CARBON + h * HYDROGEN + (NITROGEN + 5 * OXYGEN) + shift)


def outer_loss(name: Column, adduct: Column) -> Column:
    """The ion left when the esterified acid goes: with a water for [M+H]+, from [M-H]- for anions."""
    acid = _number(name, 5) * (CARBON + 2 * HYDROGEN) - _number(name, 6) * (2 * HYDROGEN) + 2 * OXYGEN
    positive = adduct == "[M+H]+"
    ion = F.when(positive, precursor(name, adduct) - (2 * HYDROGEN + OXYGEN)).otherwise(precursor(name, F.lit("[M-H]-")))
    return F.when(positive | adduct.isin("[M-H]-", "[M+HCOO]-", "[M+CH3COO]-"), ion - acid)
