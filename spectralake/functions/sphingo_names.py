"""One spelling for names of sphingolipids with further chains, N-acyl and single-chain lipids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings by class and the name they stand for. {a}, {b}, {c} are chains such as 16:0, {L} is one with its m, d or t,
# a blank is optional white space; other parts stand for themselves in any case.
SPELLINGS = {
    "CER": {"Cer({L}/h{a})": "Cer({L}/h{a})", "Cer({L}/{a})(OH)": "Cer({L}/h{a})"},
    "HEXCER": {"HexCer({L}/h{a})": "HexCer({L}/h{a})", "HexCer({L}/{a})(OH)": "HexCer({L}/h{a})"},
    "PE-CER+O": {"PE-Cer+O(m{a}/{b};2O)": "PE-Cer+O(m{a}/{b};2O)", "PE-Cer+O({a};2O/{b};O)": "PE-Cer+O(m{a}/{b};2O)"},
    "PI-CER+O": {"PI-Cer+O(m{a}/{b};2O)": "PI-Cer+O(m{a}/{b};2O)", "PI-Cer+O({a};2O/{b};O)": "PI-Cer+O(m{a}/{b};2O)"},
    "SHEXCER": {"SHexCer({L}/{a})": "SHexCer({L}/{a})", "SHexCer({a}/{L})": "SHexCer({L}/{a})"},
    "SHEXCER+O": {"SHexCer+O({L}/h{a})": "SHexCer+O({L}/h{a})", "SHexCer+O({L}/{a})(OH)": "SHexCer+O({L}/h{a})", "SHexCer+O({a})(OH/{L})": "SHexCer+O({L}/h{a})"},
    "SL": {"SL(m{a}/{b})": "SL(m{a}/{b})", "SL({a};O/{b})": "SL(m{a}/{b})", "SL({b}/m{a})": "SL(m{a}/{b})", "SL({b}/{a};O)": "SL(m{a}/{b})"},
    "SL+O": {"SL+O(m{a}/h{b})": "SL+O(m{a}/h{b})", "SL+O({a};O/{b};O)": "SL+O(m{a}/h{b})"},
    "ASM": {"ASM d{a}(O-{b})": "ASM d{a}(O-{b})", "ASM d{a}/{b}": "ASM d{a}(O-{b})", "ASM({L}/{a})": "ASM {L}/{a}"},
}
ESTER = {"Cer {L}/{a}(O-{b})": "Cer{L}/{a}(O-{b})"}
COMPLETE = {"CER": [*ESTER], "SHEXCER": ["SHexCer({L}/{a})"], "SHEXCER+O": ["SHexCer+O({L}/h{a})"], "SL": ["SL(m{a}/{b})"], "SL+O": ["SL+O(m{a}/h{b})"]}
OUTER = (r"(?i)^AHexCer\s+\(O-(\d+:\d+)\)(\d+:\d+);(\d*)O/(\d+:\d+);(\d*)O$", r"(?i)^AHexCer\((\d+:\d+)/(\d+:\d+);(\d*)O/(\d+:\d+);(\d*)O\)$")
OUTER_SPECIES = r"(?i)^AHexCer\((\d+:\d+)/(\d+:\d+;\d*O)\)$"
OUTER_NAME = r"(?i)^AHexCer\s+[mdt]\d+:\d+\(O-\d+:\d+\)/\d+:\d+\(\d*OH\)$"
CORE_TOTAL = r"(?i)^ASM\s+(\d+:\d+);\d*O\(FA\s+(\d+:\d+)\)$"
CORE_CHAINS = r"(?i)^ASM(?:\s+|\()[mdt](\d+):(\d+)/(\d+):(\d+)(?:-O-|\(FA\s+)(\d+:\d+)\)?\)?$"
ACYL_LAST = r"(?i)^(NAPE|NAPS)\(((?:O-|P-)?\d+:\d+)_((?:O-|P-)?\d+:\d+)-N-((?:O-|P-)?\d+:\d+)\)$"
ACYL_FIRST = r"(?i)^(NAPE|NAPS)\(((?:O-|P-)?\d+:\d+)-N-((?:O-|P-)?\d+:\d+)_((?:O-|P-)?\d+:\d+)\)$"
SINGLE = r"(?i)^LCE-PE\(([^()/]+)[/_]([^()/]+)\)$"


def _pattern(form: str) -> tuple[str, list[str]]:
    places = re.findall(r"\{(\w)\}", form)
    text = re.sub(r"\\\{(\w)\\\}", lambda m: r"([mdt]\d+:\d+)" if m[1] == "L" else r"(\d+:\d+)", re.escape(form)).replace(r"\ ", r"\s*")
    return f"(?i)^{text}$", places


def _spelled(name: Column, forms: dict[str, str], out: Column | None = None) -> Column:
    for form, target in forms.items():
        pattern, places = _pattern(form)
        put = F.regexp_replace(name, pattern, re.sub(r"\{(\w)\}", lambda m: f"${places.index(m[1]) + 1}", target))  # noqa: B023
        out = F.when(name.rlike(pattern), put) if out is None else out.when(name.rlike(pattern), put)
    return out


def _class(name: Column, compound_class: Column) -> Column:
    given = F.upper(F.trim(F.coalesce(compound_class, F.lit(""))))
    return F.when(given != "", given).otherwise(F.upper(F.trim(F.substring_index(F.substring_index(name, "(", 1), " ", 1))))


def canonical(value: Column, compound_class: Column) -> Column:
    """The one spelling of a name; names without a known form stay, trimmed. An empty class is read off the name."""
    name = F.trim(F.coalesce(value, F.lit("")))
    kind, part = _class(name, compound_class), lambda p, i: F.regexp_extract(name, p, i)
    outer = F.when(name.rlike(OUTER_NAME), name)
    for p in OUTER:
        base = F.when(part(p, 3).isin("", "0", "1"), "m").when(part(p, 3) == "3", "t").otherwise("d")
        tail = F.when(part(p, 5).isin("", "1"), "(OH)").otherwise(F.concat(F.lit("("), part(p, 5), F.lit("OH)")))
        outer = outer.when(name.rlike(p), F.concat(F.lit("AHexCer "), base, part(p, 2), F.lit("(O-"), part(p, 1), F.lit(")/"), part(p, 4), tail))
    outer = outer.when(name.rlike(OUTER_SPECIES), F.concat(F.lit("AHexCer "), part(OUTER_SPECIES, 2), F.lit("(O-"), part(OUTER_SPECIES, 1), F.lit(")")))
    total = lambda i: part(CORE_CHAINS, i).try_cast("int") + part(CORE_CHAINS, i + 2).try_cast("int")
    core = F.when(name.rlike(CORE_TOTAL), F.concat(F.lit("ASM d"), part(CORE_TOTAL, 1), F.lit("(O-"), part(CORE_TOTAL, 2), F.lit(")")))
    core = core.when(name.rlike(CORE_CHAINS), F.concat(F.lit("ASM d"), total(1), F.lit(":"), total(2), F.lit("(O-"), part(CORE_CHAINS, 5), F.lit(")")))
    out = _spelled(name, ESTER).when(kind == "AHEXCER", outer)
    for k, forms in SPELLINGS.items():
        out = out.when(kind == k, F.coalesce(_spelled(name, forms), core) if k == "ASM" else _spelled(name, forms))
    acyl = lambda p, g, n: F.concat(F.upper(part(p, 1)), F.lit("("), F.array_join(F.array_sort(F.array(*[part(p, i) for i in g])), "_"), F.lit("-N-"), part(p, n), F.lit(")"))
    nape = kind.isin("NAPE", "NAPS")
    out = out.when(nape & name.rlike(ACYL_LAST), acyl(ACYL_LAST, (2, 3), 4)).when(nape & name.rlike(ACYL_FIRST), acyl(ACYL_FIRST, (3, 4), 2))
    empty = [part(SINGLE, i) == "0:0" for i in (1, 2)]
    out = out.when((kind == "LCE-PE") & name.rlike(SINGLE) & (empty[0] != empty[1]), F.concat(F.lit("LCE-PE("), F.when(empty[0], part(SINGLE, 2)).otherwise(part(SINGLE, 1)), F.lit(")")))
    return F.coalesce(out, name)


def complete(value: Column, compound_class: Column) -> Column:
    """All chains of the name are told, as far as its class has a spelling for that."""
    name = canonical(value, compound_class)
    kind = _class(name, compound_class)
    told = name.rlike(_pattern(COMPLETE["CER"][0])[0]) | ((kind == "AHEXCER") & name.rlike(OUTER_NAME))
    for k, forms in COMPLETE.items():
        if k != "CER":
            told = told | ((kind == k) & name.rlike(_pattern(forms[0])[0]))
    return told & (kind != "ASM")
