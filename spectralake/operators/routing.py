"""Fragment routing: a decision table from class, adduct, type and name to the pools and roles of a fragment.

The table is rows (POOLS, ROLES); each states what must hold, and the first row that holds decides. ``routed`` compiles the
rows to one expression, so a library is routed in one projection, without a join, a shuffle or Python. Facts of a record (class key,
sign, what types its fragments have) are columns worked out once for each record.

Nulls count as empty texts; a record without fragments has an empty array; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class keys (upper case, without hyphens) and names that decide what a fragment stands for.
NO_ACYL_LOSS = "PA PE OXPE PG PI PS PAO PEO PGO PIO PSO PEP DMPE MMPE PMEOH PETOH PGCN OXPGCN LPE LPETOH PLASMENYLPNE PNEP".split()
GLYCERIDES, FREE_BASES = "TG DG TGO OXTG".split(), "SPB SPH DHSPH PHYTOSPH".split()
ACYL_ION_IS_LOSS = "PA PE PG PI".split()
LYSO = [f"L{head}{link}" for head in ("PA", "PC", "PE", "PG", "PI", "PS") for link in ("", "O", "P")]
HEAD_MASSES = {"PG": (152.9933, 171.0064, 209.0221, 227.0326), "PETOH": (181.0271, 181.0280), "PMEOH": (167.0109,), "DMPE": (168.0411, 168.0431)}
HEAD_WIDTH = 0.02
LPC_HEADS, LPE_HEADS, ETHER_LPC_HEAD = ("[M-CH3]-", "[C4H11NO4P]-"), ("[C2H7NO4P]-", "[M-H-C2H7NO]-"), "[C5H15NO4P]+"
LPC_ADDUCTS = ("[M+HCOO]-", "[M+CH3COO]-", "[M+C2H3O2]-")
ONE_CHAIN = r"(?i)^(?:L{0}(?:-{1})?|{0})(?:\(|\s+)(?:{1}-)?(\d+):(\d+)(?:[/_]0:0)?\)?$"
PS_HEADS, PS_KETENES = ("[M-C3H8O6NP+H]+", "[M-C3H8NO6P+H]+"), ("[M-R=O-C3H8O6NP+H]+(", "[M-R=O-C3H8NO6P+H]+(")
WATER_LOSS = r"^M(?:\+H)?-(?:[123])?H2O(?:[+-])?$"
C, LCB, CERAMIDE_CHAINS = "C类碎片", "LCB碎片", ("LCB碎片", "FA类碎片", "NAE碎片")


@dataclass(frozen=True)
class Row:
    """What must hold of record and fragment, all of it, and the pools that the fragment then belongs to."""

    pools: tuple[str, ...]
    types: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    facts: tuple[str, ...] = ()
    prefix: str = ""


#: The pools of a fragment, first row first. Facts are those of ``facts_of`` (records) and ``fragment_facts``, with ! for not.
POOLS = (
    Row(("fah", "lcb"), types=("Diagnostic_FA",), facts=("negative_hexcer", "also_lcb")),
    Row(("fah", "other"), types=("Diagnostic_FA_Loss",), facts=("negative_ahexcer", "base_loss")),
    Row(("hg",), facts=("lyso_by_head", "hg")),
    Row(("fah",), types=("Precursor Ion",), facts=("negative_lpe", "at_precursor")),
    Row(("other",), facts=("lyso_by_head",)),
    Row(("other",), prefix="OX", facts=("water_loss",)),
    Row(("lcb",), types=(LCB,), facts=("base_pool",)),
    Row(("hg",), facts=("positive_ps", "ps_head_loss")),
    Row(("fah",), types=("Diagnostic_FA_Loss",), facts=("positive_ps", "ps_ketene_loss")),
    Row(("other",), facts=("positive_ps",)),
    Row(("fah",), types=("Precursor Ion",), classes=("FA", "OXFA"), facts=("rcoo",)),
    Row(("other",), types=("FA_Frag",), facts=("positive_glyceride", "rco")),
    Row(("other",), types=("Diagnostic_FA_Loss",), facts=("positive_glyceride", "glycerol_loss")),
    Row(("other",), types=("Diagnostic_FA_Loss",), facts=("!positive", "no_acyl_loss")),
    Row(("fah",), types=("Diagnostic_FA", "Diagnostic_FA_Loss")),
    Row(("fah",), types=("FA_Frag",), facts=("acyl_ion_is_loss",)),
    Row(("fah",), types=(C,), classes=tuple(FREE_BASES)),
    Row(("other",), classes=tuple(FREE_BASES), facts=("unassigned_base",)),
    Row(("fah",), types=CERAMIDE_CHAINS, classes=("CER",), facts=("!positive",)),
    Row(("fah",), types=(LCB,)),
    Row(("hg",), facts=("hg",)),
    Row(("other",)),
)
#: Whether a fragment counts for its head group: the first row that holds decides.
HEADS = (
    (True, Row((), types=("Diagnostic_HG",), facts=("ether_lpc", "ether_lpc_head"))), (False, Row((), facts=("ether_lpc",))),
    (True, Row((), types=("Diagnostic_HG",), facts=("negative_lpc", "lpc_head"))), (False, Row((), facts=("negative_lpc",))),
    (True, Row((), types=("Diagnostic_HG",), facts=("negative_lpe", "lpe_head"))), (False, Row((), facts=("negative_lpe",))),
    (True, Row((), facts=("positive_ps", "ps_head_loss"))), (False, Row((), facts=("positive_ps",))),
    (True, Row((), facts=("positive_mg", "water_loss_ion"))), (False, Row((), facts=("positive_mg",))),
    (True, Row((), types=("Diagnostic_HG",))), (True, Row((), facts=("head_mass",))), (False, Row((), facts=("has_head",))),
    (True, Row((), types=("Candidate_HG",))), (True, Row((), types=("Precursor Ion",), facts=("has_candidate",))),
)
#: Whether a fragment is a loss that counts, and whether it counts for the gate on fatty-acid losses.
LOSSES = (
    (True, Row((), types=("Diagnostic_FA_Loss",), facts=("positive_ps", "ps_ketene_loss"))), (False, Row((), facts=("positive_ps",))),
    (False, Row((), types=("Diagnostic_FA_Loss",), facts=("positive_glyceride", "glycerol_loss"))),
    (True, Row((), types=("Neutral_Loss", "Diagnostic_FA_Loss"))), (True, Row((), types=("FA_Frag",), facts=("acyl_ion_is_loss",))),
)
ACYL_LOSSES = (*LOSSES[:3], (True, Row((), types=("Diagnostic_FA_Loss",))), LOSSES[-1])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def facts_of(compound_class: Column, adduct: Column, name: Column, fragments: Column) -> dict[str, Column]:
    """What the table may ask of a record."""
    key = F.replace(F.upper(F.trim(_text(compound_class))), F.lit("-"), F.lit(""))
    parent = F.regexp_replace(F.regexp_replace(F.upper(_text(compound_class)), "[^A-Z0-9]", ""), "^OX", "")
    sign, plain = F.trim(_text(adduct)), _text(compound_class)
    positive, plain_key = sign.endswith("+"), F.upper(F.trim(plain))
    # one chain with an ether link, of more carbons than double bonds
    text = F.trim(_text(name))

    def one_chain(head: str, link: str) -> Column:
        pattern = ONE_CHAIN.format(head, link)
        carbons, bonds = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
        return text.rlike(pattern) & (carbons > 0) & (bonds < carbons)

    negative_lpc = (plain_key == "LPC-O") & sign.isin(*LPC_ADDUCTS) & one_chain("PC", "O")
    negative_lpe = (plain_key == "LPE-O") & (sign == "[M-H]-") & one_chain("PE", "O")
    ether_lpc = (sign == "[M+H]+") & (((plain_key == "LPC-O") & one_chain("PC", "O")) | ((plain_key == "LPC-P") & one_chain("PC", "P")))
    esterified = (plain == "Cer") & _text(name).rlike(r"^Cer\s*d\d+:\d+/\d+:\d+\(O-\d+:\d+\)$")
    negative_hexcer = (plain == "HexCer") & sign.isin("[M-H]-", "[M+HCOO]-", "[M+CH3COO]-")
    heads = F.array().cast("array<double>")
    for c, masses in HEAD_MASSES.items():
        heads = F.when((key == c) & ~positive, F.array(*[F.lit(m) for m in masses])).otherwise(heads)
    kinds = F.transform(fragments, lambda f: f["type"])
    return {
        "key": key, "parent": parent, "positive": positive, "heads": heads, "negative_lpc": negative_lpc, "negative_lpe": negative_lpe, "ether_lpc": ether_lpc,
        "lyso_by_head": ether_lpc | (positive & key.isin(*LYSO)) | negative_lpc | negative_lpe, "negative_hexcer": negative_hexcer, "negative_ahexcer": ~positive & (key == "AHEXCER"),
        "base_pool": (esterified & positive) | negative_hexcer | (plain.isin("GM3", "PE-Cer") & (sign == "[M+H]+")) | ((plain == "GM3") & (sign == "[M-H]-")),
        "positive_ps": positive & (key == "PS"), "positive_glyceride": positive & key.isin(*GLYCERIDES), "positive_mg": positive & (key == "MG"), "no_acyl_loss": parent.isin(*NO_ACYL_LOSS),
        "acyl_ion_is_loss": positive & parent.isin(*ACYL_ION_IS_LOSS), "has_candidate": F.array_contains(kinds, "Candidate_HG"),
        "has_head": F.array_contains(kinds, "Diagnostic_HG") | F.exists(fragments, lambda f: _head_mass(f, heads)),
    }


def _head_mass(f: Column, heads: Column) -> Column:
    return f["type"].isin("Common", "Candidate_HG") & F.exists(heads, lambda m: F.abs(f["mz"] - m) <= HEAD_WIDTH)


def fragment_facts(f: Column, record: dict[str, Column], precursor: Column) -> dict[str, Column]:
    """What the table may ask of a fragment."""
    name = F.trim(_text(f["name"]))
    upper = F.upper(name)
    compact = F.regexp_replace(upper, r"\s+", "")
    return {
        "also_lcb": F.coalesce(F.array_contains(f["also"], LCB), F.lit(False)), "base_loss": upper.contains("LCB-C2H7NO"), "at_precursor": F.abs(f["mz"] - precursor) <= 1e-6,
        "water_loss": F.regexp_replace(upper, r"[\s\[\]]", "").rlike(WATER_LOSS), "rcoo": upper.contains("RCOO"), "rco": upper.startswith("(R=O)+(") | upper.startswith("RCO(") | upper.startswith("[RCO]+"),
        "glycerol_loss": upper.contains("C3H6O2") & ~upper.contains("ROOH") & ~upper.contains("M-NH3"), "unassigned_base": name.isin("SPB-Diagnostic-1", "SPB-Diagnostic-2"),
        "ps_head_loss": compact.isin(*PS_HEADS), "ps_ketene_loss": (f["type"] == "Diagnostic_FA_Loss") & (compact.startswith(PS_KETENES[0]) | compact.startswith(PS_KETENES[1])),
        "ether_lpc_head": f["name"] == ETHER_LPC_HEAD, "lpc_head": f["name"].isin(*LPC_HEADS), "lpe_head": f["name"].isin(*LPE_HEADS), "water_loss_ion": name == "[M-H2O+H]+", "head_mass": _head_mass(f, record["heads"]),
    }


def _holds(row: Row, f: Column, facts: dict[str, Column]) -> Column:
    out = F.lit(True)
    if row.types:
        out = out & f["type"].isin(*row.types)
    if row.classes:
        out = out & facts["key"].isin(*row.classes)
    if row.prefix:
        out = out & facts["key"].startswith(row.prefix)
    for fact in row.facts:
        out = out & (~facts[fact[1:]] if fact.startswith("!") else facts[fact])
    return F.coalesce(out, F.lit(False))


def _first(rows, f: Column, facts: dict[str, Column]) -> Column:
    """Of (value, row) the value of the first row that holds; false without one."""
    out = F.lit(False)
    for value, row in reversed(rows):
        out = F.when(_holds(row, f, facts), F.lit(value)).otherwise(out)
    return out


def routed(records: DataFrame) -> DataFrame:
    """Adds ``routes``: for each fragment its pools and whether it counts as head group, loss and fatty-acid loss.

    Records: compound_class, adduct, chain_name, precursor_mz and fragments (array of mz, name, type, also: further types of the same ion).
    """
    own = facts_of(F.col("compound_class"), F.col("adduct"), F.col("chain_name"), F.col("fragments"))
    # facts are columns, so that they are worked out once for a record
    names = [f"_{k}" for k in own]
    rows = records.withColumns({f"_{k}": v for k, v in own.items()})
    record = {k: F.col(f"_{k}") for k in own}

    def route(f: Column) -> Column:
        facts = {**record, **fragment_facts(f, record, F.col("precursor_mz"))}
        facts["hg"] = _first(HEADS, f, facts)
        pools = F.array(F.lit("other"))
        for row in reversed(POOLS):
            pools = F.when(_holds(row, f, facts), F.array(*[F.lit(p) for p in row.pools])).otherwise(pools)
        return F.struct(pools.alias("pools"), facts["hg"].alias("hg"), _first(LOSSES, f, facts).alias("loss"), _first(ACYL_LOSSES, f, facts).alias("acyl_loss"))

    return rows.withColumn("routes", F.transform("fragments", route)).drop(*names)


def matched_heads(bmp: Column, fragments: Column, routes: Column, places: Column) -> Column:
    """Number of matched head-group fragments; of a positive BMP every entry at a matched mass counts, though peaks are used once."""
    pairs = F.zip_with(fragments, routes, lambda f, r: F.struct(f["mz"].alias("mz"), r["hg"].alias("hg")))
    hit = F.filter(pairs, lambda p, i: p["hg"] & F.array_contains(places, i.cast("int")))
    same = F.filter(pairs, lambda p: p["hg"] & F.exists(hit, lambda h: F.abs(h["mz"] - p["mz"]) <= 1e-6))
    return F.when(bmp, F.size(same)).otherwise(F.size(hit)).cast("int")
