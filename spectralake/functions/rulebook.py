"""The rules on sphingolipid fragments and the class rules as rows of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators.rules import RULE

RULEBOOK = f"{RULE}, hg_fallback boolean, chain_fallback boolean"

# Fragment types and names, and what each class and adduct asks of them.
HG, FA, FA_LOSS, LOSS, PRECURSOR = "Diagnostic_HG", "Diagnostic_FA", "Diagnostic_FA_Loss", "Neutral_Loss", "Precursor Ion"
C, LCB, ACYL, NAE = "C类碎片", "LCB碎片", "FA类碎片", "NAE碎片"
_D2, _D3 = ["LCB-H2O", "LCB-2H2O"], ["LCB-H2O", "LCB-2H2O", "LCB-CH2O-H2O"]
_HEX = {"d": ["LCB-H2O", "LCB-2H2O", "LCB-CH4O2"], "t": ["LCB-H2O", "LCB-2H2O", "LCB-3H2O", "LCB-CH6O3"]}
_U = "Ceramide fragment U"
_CERAMIDE = {"counts": [([PRECURSOR, C], 2)], "counts_any": [[([LCB], 2), ([ACYL, NAE], 2)]]}
_HALVES = {"shares": [([HG], 0.5), ([LCB], 0.5)], "strict": True}
_HEXCER = {"shares": [([HG], 0.5), ([FA], 0.5), ([LCB], 0.5)], "strict": True}
_AHEXCER = {"shares": [([FA, FA_LOSS], 0.5), ([HG], 0.5)], "patterns": [("LCB-C2H7NO", 0.5)], "strict": True}
_PE_CER = {"any": [["PO3-", "H2PO4-", "[C2H7NO4P]-"]], "types": [[HG], [FA, FA_LOSS, C]]}
_PI_CER = {"any": [["[C6H8O7P]-", "[C6H10O8P]-", "[C6H12O9P]-"]], "types": [[HG], [FA, FA_LOSS, C]]}
_SM_NEGATIVE = {"any": [["[C4H11NO4P]-", "M-CH3"]], "types": [[HG]]}
_LACTOSYL = {"all": ["M+H-H2O", "M+H-C6H10O5", "M+H-C12H20O10", "LCB-2H2O"], "series": _HEX}
_OUTER = [(r"^(?:\[RCOO\]-|M-H-RCOOH|M-H-ketene)\(", 0.5), (r"^T ion \(omega-hydroxy ", 1.0)]
_SULFATE = {"all": ["M+H-H2SO4"], "series": {"d": _D3}}
RULES: dict[str, dict] = {
    "PE-Cer_[M+H]+": {"all": ["M+H-141", "LCB-2H2O"], **_HALVES},
    "ASM_[M+H]+": {"all": ["[C5H15NO4P]+", "M+H-RCOOH(head-acyl)"]},
    "SM_[M+H]+": {
        "any": [["[M+H]+", "M+H-H2O", "M+H-2H2O", "M+H-trimethylamine(-59)", "[C5H15NO4P]+"]],
        "series": {"d": ["LCB", *_D2], "t": ["LCB-2H2O", "LCB-3H2O"]}, "types": [[PRECURSOR, C, LOSS, HG], [LCB]],
    },
    "LSM_[M+H]+": {"all": ["[C5H15NO4P]+"], "series": {"m": _D2, "d": _D2, "t": _D2}, "types": [[HG], [LCB]]},
    "SM_[M+Na]+": {"counts": [([HG], 2)], "strict": True},
    "Cer_[M+H]+": {
        "any": [["[M+H]+", "M+H-H2O", "M+H-2H2O", "M+H-CH2O-H2O", "M+H-3H2O", "M+H-CH2O-3H2O"]],
        "series": {"m": ["LCB", "LCB-H2O", _U], "d": ["LCB", *_D3, _U], "t": ["LCB", *_D2, "LCB-3H2O", "LCB-C1H4O2", "LCB-C1H6O3", _U]},
        "types": [[PRECURSOR, C], [LCB]], "counts": [([LCB], 2)],
    },
    "Cer_[M-H]-": _CERAMIDE, "Cer_[M+CH3COO]-": _CERAMIDE, "Cer_[M+HCOO]-": _CERAMIDE,
    "Hex3Cer_[M+H]+": {"all": ["M+H-3Hex"], "series": {"d": _D3}},
    "SHexCer_[M+H]+": _SULFATE, "SHexCer+O_[M+H]+": _SULFATE,
    "GM3_[M+H]+": _HALVES,
    "GM3_[M-H]-": {"all": ["[C11H17O8N1-H]-"], "types": [[HG]], "strict": True},
    "GM1_[M+2NH4]2+": {"all": ["Reference-HG-366.1400"], "series": {"d": _D2}},
    "GD1a_[M+2NH4]2+": {"all": ["Reference-HG-657.2354"], "series": {"d": _D2}},
    "GD1b_[M+2NH4]2+": {"all": ["Reference-HG-366.1400"], "series": {"d": _D2}},
    "GQ1b_[M+2NH4]2+": {"all": ["Reference-HG-657.2354"], "series": {"d": _D2}},
    "GT1b_[M+2NH4]2+": {"all": ["Reference-HG-657.2354"], "series": {"d": _D2}},
    "AHexCer_[M+H]+": _HALVES,
    "HexCer_[M+H]+": {
        "any": [["[M+H]+", "M+H-H2O", "M+H-C6H10O5", "M+H-C6H10O5-H2O", "M+H-C6H10O5-2H2O", "Cer+H-H2O"]],
        "series": {s: [*names, _U] for s, names in _HEX.items()}, "types": [[PRECURSOR, C, HG], [LCB]], **_HALVES,
    },
    "HexCer_[M-H]-": _HEXCER, "HexCer_[M+CH3COO]-": _HEXCER, "HexCer_[M+HCOO]-": _HEXCER,
    "LacCer_[M+H]+": _LACTOSYL, "Hex2Cer_[M+H]+": _LACTOSYL,
    "Cer1P_[M+H]+": {"all": ["M+H-H3PO4", "LCB-2H2O"], "types": [[HG], [LCB]]},
    "Cer1P_[M-H]-": {"types": [[HG]]},
    "SM_[M+CH3COO]-": _SM_NEGATIVE, "SM_[M+HCOO]-": _SM_NEGATIVE,
    "AHexCer_[M+CH3COO]-": _AHEXCER, "AHexCer_[M+HCOO]-": _AHEXCER,
    "PE-Cer_[M-H]-": _PE_CER, "PE-Cer+O_[M-H]-": _PE_CER, "PI-Cer_[M-H]-": _PI_CER, "PI-Cer+O_[M-H]-": _PI_CER,
    "SL_[M-H]-": {"any": [["[SO3]-", "[HSO3]-"]], "types": [[HG], [FA]]},
    "SL+O_[M-H]-": {"any": [["[SO3]-", "[HSO3]-"]], "types": [[HG], [FA, FA_LOSS]]},
    "SPB_[M+H]+": {
        "any": [["M+H-H2O", "M+H-2H2O", "M+H-3H2O", "M+H-CH2O", "M+H-CH4O2", "M+H-CH6O3", "M+H-NH3", "M+H-H2O-NH3"]], "types": [[C]], "counts": [([C], 2)],
    },
    "Cer-esterified_[M+H]+": {"shares": [([FA_LOSS], 0.5), ([LCB], 0.5)], "counts": [([LCB], 2)], "strict": True},
    "Cer-esterified_[M-H]-": {"patterns": _OUTER, "strict": True},
    "Cer-esterified_[M+HCOO]-": {"all": ["[M-H]-"], "patterns": _OUTER, "strict": True},
    "Cer-esterified_[M+CH3COO]-": {"all": ["[M-H]-"], "patterns": _OUTER, "strict": True},
}
# What a class asks of head groups, chains and losses; missing fields have the defaults, which come first.
CLASS_RULE = (
    "compound_class string, chain_level_min_fah int, hg_only_if_no_fah boolean, hg_min_if_no_fah int, hg_min_fraction double, hg_min int, loss_min_fraction double, loss_min int, "
    "complete_hg_resolves boolean, signature_min_if_no_fah int, loss_only_if_no_fah boolean, negative_hg_min int, negative_all_fah boolean, fah double, hg double, other double"
)
_DEFAULTS = {"chain_level_min_fah": 2, "hg_only_if_no_fah": False, "hg_min_if_no_fah": 1, "hg_min_fraction": 0.0, "hg_min": 0, "loss_min_fraction": 0.0, "loss_min": 0, "complete_hg_resolves": False, "signature_min_if_no_fah": 0, "loss_only_if_no_fah": False, "negative_hg_min": 0, "negative_all_fah": False, "fah": 60.0, "hg": 20.0, "other": 20.0}
_PLAIN = "PC PC-P PE PG PI PS PC-O PE-O PI-O PS-O PA PIP PIP2 PIP3 CL DLCL MLCL".split()
_LYSO = "LPC LPE LPG LPI LPS LPC-O LPE-O LPE-P LPG-O LPI-O".split()
_HEAD_FIRST = {"fah": 20.0, "hg": 60.0, "other": 20.0}
_ONE = {"chain_level_min_fah": 1}
_HEAD_ONLY = {**_ONE, "hg_only_if_no_fah": True}
_PAIR = {"hg_min_if_no_fah": 2, "hg_min_fraction": 1.0, "hg_min": 2, "complete_hg_resolves": True}
_SINGLE = {"hg_min_fraction": 1.0, "hg_min": 1, "negative_hg_min": 2, "negative_all_fah": True}
CLASS_RULES: dict[str, dict] = {
    "DEFAULT": {}, **{c: {} for c in _PLAIN}, **{c: _HEAD_ONLY for c in _LYSO}, "LPS": {**_HEAD_ONLY, **_HEAD_FIRST},
    "LNAPE": {"negative_hg_min": 1, "negative_all_fah": True, **_HEAD_FIRST},
    "LPE-P": {**_HEAD_ONLY, "hg_min": 1, "hg_min_fraction": 0.5, "complete_hg_resolves": True},
    "BMP": {**_HEAD_ONLY, "hg_min_if_no_fah": 2, "complete_hg_resolves": True},
    **{c: {**_HEAD_ONLY, "signature_min_if_no_fah": 3} for c in ("GPNAE", "NAGly", "NAGlySer", "NAOrn")},
    "NAE": {**_ONE, "fah": 100.0, "hg": 0.0, "other": 0.0},
    **{c: _HEAD_ONLY for c in ("BA", "BASulfate", "SSulfate", "NAT", "NAGPS")}, "MG": {**_HEAD_ONLY, "complete_hg_resolves": True, "fah": 0.0, "hg": 75.0, "other": 25.0},
    "VD": {**_HEAD_ONLY, **_PAIR}, "VE": {**_HEAD_ONLY, "complete_hg_resolves": True}, "HBMP": {**_ONE, "loss_only_if_no_fah": True},
    "NAPE": _PAIR, "NAPS": {**_PAIR, "negative_hg_min": 1, "negative_all_fah": True}, "Am-PS": _SINGLE, "CE-PE": _SINGLE,
    "APCS": {**_ONE, "hg_min_fraction": 0.5, "hg_min": 1, "loss_min_fraction": 0.5, "loss_min": 1}, "PHEG": {"negative_hg_min": 2, "negative_all_fah": True},
    **{c: {"negative_hg_min": 1, "negative_all_fah": True} for c in ("Glc-GP", "6-Ac-Glc-GP", "PtdGlc")},
    "ADGGA": {"hg_min_fraction": 0.5, "hg_min": 1, "loss_min_fraction": 1.0, "loss_min": 1, "negative_all_fah": True},
}
_LYSO_NAMES = [f"L{head}{link}" for head in ("PA", "PC", "PE", "PG", "PI", "PS") for link in ("", "-O", "-P")]


def rulebook(spark: SparkSession) -> DataFrame:
    """The rules on sphingolipids, one row for each class and adduct."""
    rows = []
    for key, r in RULES.items():
        numbers = lambda groups: None if groups is None else [(types, float(n)) for types, n in groups]
        rows.append((key, r.get("all"), r.get("any"), r.get("series"), r.get("types"), numbers(r.get("counts")), None if "counts_any" not in r else [numbers(g) for g in r["counts_any"]], r.get("shares"), r.get("patterns"), not r.get("strict", False), not r.get("strict", False)))
    return spark.createDataFrame(rows, RULEBOOK)


def class_rules(spark: SparkSession) -> DataFrame:
    """The class rules, one row for each class; DEFAULT is that of any other. Lyso phospholipids ask for half of their head-group ions."""
    table = {**CLASS_RULES, **{c: {**CLASS_RULES.get(c, {}), "hg_min_fraction": 0.5} for c in _LYSO_NAMES}}
    fields = [c.split()[0] for c in CLASS_RULE.split(", ")][1:]
    return spark.createDataFrame([(c, *[{**_DEFAULTS, **r}[f] for f in fields]) for c, r in table.items()], CLASS_RULE)


def rule_key(compound_class: Column, adduct: Column, name: Column) -> Column:
    """The rulebook's key of a record: esterified ceramides, told by their name, have rules of their own."""
    esterified = (compound_class == "Cer") & F.coalesce(name, F.lit("")).rlike(r"^Cer\s*d\d+:\d+/\d+:\d+\(O-\d+:\d+\)$")
    return F.concat(F.when(esterified, "Cer-esterified").otherwise(compound_class), F.lit("_"), adduct)
