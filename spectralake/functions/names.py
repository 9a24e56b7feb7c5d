"""Names of lipids: class, chains, totals, normalised and reported names, identity keys, adducts, formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = r"(O-|P-|d|m|t)?(\d{1,3}):(\d{1,2})"
CHAIN = CORE + r"((?:;[A-Za-z0-9]+|,[A-Za-z0-9]+|\([^)]+\))*)"
#: Text, the outer parentheses' content (up to three levels deep), the rest.
OUTER = r"^([^(]*)\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)(.*)$"
ETHER_LYSO = r"^(LPE|LPC)\(O-(\d+):(\d+)\)/\1\(P-(\d+):(\d+)\)$"
TG_EST = r"(?i)^TG-EST(?:\s+|\()(\d+):(\d+)_(\d+):(\d+)_(\d+):(\d+);O\(FA\s+(\d+):(\d+)\)\)?$"
AHEXCER = r"(?i)^[dmt]\d+:\d+\(O-\d+:\d+\)/\d+:\d+\([^)]*OH\)$"
TOKEN = r"(?i)(?:[mdt]|O-|P-)?\d+:\d+(?:\((?:\d+)?OH\)|;\d*O(?:H)?|,O\d*)?"
FRAGMENT = r"([OP]-)?(\d+:\d+)((?:\(\d*O\))|(?:,O\d*)|(?:;O\d*)|(?:;\(?\d+OH\)?))?"

# Classes that report a lyso sum, classes whose sphingoid base comes first.
LYSO_SUM = ["LPA", "LPAO", "LPC", "LPCO", "LPE", "LPEO", "LPG", "LPGO", "LPI", "LPIO", "LPS", "LPSO", "LDMPE", "LPETOH", "LPMEOH", "LPHEG", "LPNE"]
BASE_FIRST = ["CER", "GM3", "PE-CER", "HEXCER", "LACCER", "HEX2CER", "CER1P", "CERP", "SM", "LSM", "SPB", "DHSPH", "SPH", "PHYTOSPH"]


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _numbers(text: Column, pattern: str, groups: list[int]) -> Column:
    """Sum over groups of all matches; null without a match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    total = sum((F.aggregate(f, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")) for f in found), F.lit(0).cast("bigint"))
    return F.when(F.size(found[0]) > 0, total)


def with_parsed(rows: DataFrame, name: Column, fallback: Column | None = None, into: str = "parsed") -> DataFrame:
    """Adds a struct lipidname_norm, total_c, total_db, subclass: chains are sorted unless one is a sphingoid base; all cores count.

    Done in steps, each a projection of its own, so that no part of the name is taken apart twice.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    raw, text, first = F.col("_raw"), F.col("_text"), F.col("_first")
    out = rows.withColumn("_raw", F.trim(_empty(name))).withColumn("_fall", clean(_empty(F.lit("") if fallback is None else fallback)))
    out = out.withColumn("_text", clean(raw)).withColumn("_first", F.regexp_instr(text, F.lit(CHAIN)))
    paren = F.instr(text, "(")
    base_first = F.regexp_extract(text, CHAIN, 1).isin("d", "m", "t") & ((paren == 0) | (first < paren)) & (first > 0)
    out = out.withColumn("_style", F.when(base_first, "space").when(text.rlike(OUTER), "paren").when(first > 0, "space").otherwise("plain"))
    style = F.col("_style")
    at_first = F.when(first > 0, first).otherwise(1)
    head = F.when(style == "paren", F.regexp_extract(text, OUTER, 1)).when(style == "space", text.substr(F.lit(1), at_first - 1)).otherwise("")
    chains = F.when(style == "paren", F.regexp_extract(text, OUTER, 2)).when(style == "space", F.trim(text.substr(at_first, F.length(text)))).otherwise(text)
    tail = F.when(style == "paren", F.trim(F.regexp_extract(text, OUTER, 3))).otherwise("")
    out = out.withColumns({"_head": clean(head), "_chains": chains, "_tail": tail})
    chains = F.col("_chains")
    tokens = F.transform(
        F.regexp_extract_all(chains, F.lit(CHAIN), F.lit(0)),
        lambda t: F.struct(F.regexp_extract(t, CORE, 2).cast("int").alias("c"), F.regexp_extract(t, CORE, 3).cast("int").alias("b"), F.regexp_extract(t, CORE, 1).alias("p"), t.alias("t")),
    )
    out = out.withColumns({"_tokens": tokens, "_sub": F.when(F.col("_head") != "", F.col("_head")).otherwise(F.col("_fall"))})
    tokens, subclass = F.col("_tokens"), F.col("_sub")
    based = F.exists(tokens, lambda t: t["p"].isin("d", "m", "t"))
    ordered = F.when((F.size(tokens) > 1) & ~based, F.array_sort(tokens)).otherwise(tokens)
    separator = F.when(chains.contains("_"), "_").when(chains.contains("/"), "/").otherwise("_")
    out = out.withColumn("_joined", F.replace(F.array_join(F.transform(ordered, lambda t: t["t"]), "\u0001"), F.lit("\u0001"), separator))
    joined = F.col("_joined")
    whole = (F.upper(subclass) == "AHEXCER") & (style == "space") & chains.rlike(AHEXCER)
    norm = (
        F.when(whole | (F.size(tokens) == 0), raw).when(style == "paren", F.trim(F.concat(subclass, F.lit("("), joined, F.lit(")"), F.col("_tail"))))
        .when(subclass != "", F.trim(F.concat_ws(" ", subclass, joined))).otherwise(joined)
    )
    plain = F.struct(norm.alias("lipidname_norm"), _numbers(chains, CORE, [2]).alias("total_c"), _numbers(chains, CORE, [3]).alias("total_db"), subclass.alias("subclass"))
    at = lambda p, g: F.regexp_extract(raw, p, g).try_cast("bigint")
    ether = raw.rlike(ETHER_LYSO) & (at(ETHER_LYSO, 2) == at(ETHER_LYSO, 4)) & (at(ETHER_LYSO, 3) == at(ETHER_LYSO, 5) + 1)
    special = lambda c, db, sub: F.struct(raw.alias("lipidname_norm"), c.alias("total_c"), db.alias("total_db"), sub.alias("subclass"))
    out = out.withColumn(
        into,
        F.when(ether, special(at(ETHER_LYSO, 2), at(ETHER_LYSO, 3), F.concat(F.regexp_extract(raw, ETHER_LYSO, 1), F.lit("-O"))))
        .when(raw.rlike(TG_EST), special(_numbers(raw, TG_EST, [1, 3, 5, 7]), _numbers(raw, TG_EST, [2, 4, 6, 8]), F.lit("TG-EST")))
        .otherwise(plain),
    )
    return out.drop("_raw", "_fall", "_text", "_first", "_style", "_head", "_chains", "_tail", "_tokens", "_sub", "_joined")


def sum_candidate(name: Column, compound_class: Column, formula: Column) -> Column:
    """(name, resolution): chains and hydroxyl places dropped where every part is a chain, else class and formula."""
    form, part = r"^([^()]+)\(([^()]+)\)$", r"^([OP]-)?[mdth]?(\d+):(\d+)(?:;O\d*)?$"
    text = F.trim(_empty(name))
    parts = F.transform(F.split(F.regexp_extract(text, form, 2), "[/_]"), lambda p: F.trim(p))
    ethers = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, part, 1)), lambda e: e != "")
    total = lambda g: F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(F.regexp_extract(p, part, g).try_cast("bigint"), F.lit(0)))
    chains = text.rlike(form) & F.forall(parts, lambda p: p.rlike(part)) & (F.size(ethers) <= 1)
    summed = F.concat(F.trim(F.regexp_extract(text, form, 1)), F.lit("("), F.array_join(ethers, ""), total(2), F.lit(":"), total(3), F.lit(")"))
    plain = F.trim(F.concat(_empty(compound_class), F.lit(" "), _empty(formula)))
    return F.struct(F.when(chains, summed).otherwise(plain).alias("name"), F.when(chains, "sum_composition").when(_empty(formula) != "", "class_formula").otherwise("class_only").alias("resolution"))


def total_name(name: Column, compound_class: Column, formula: Column) -> Column:
    """As sum_candidate, but a name that is a total already stays as the library writes it."""
    text = F.trim(_empty(name))
    inner = F.regexp_extract(text, r"^[^()]+\(([^()]*)\)$", 1)
    kept = inner.rlike(r"\d+:\d+") & ~inner.rlike("[/_]")
    return F.when(kept, F.struct(text.alias("name"), F.lit("sum_composition").alias("resolution"))).otherwise(sum_candidate(name, compound_class, formula))


def sum_name(name: Column, parsed: Column) -> Column:
    """The class with the totals of a parsed name; the name itself where it has no chain."""
    return F.when(parsed["total_c"].isNull(), name).otherwise(F.concat(parsed["subclass"], F.lit("("), parsed["total_c"], F.lit(":"), parsed["total_db"], F.lit(")")))


def identity(compound_class: Column, name: Column) -> Column:
    squash = lambda c: F.lower(F.trim(F.regexp_replace(_empty(c), r"\s+", " ")))
    return F.concat_ws("|", squash(compound_class), squash(name))


def chain_tokens(name: Column) -> Column:
    """Every explicit chain of a name but 0:0, in order."""
    return F.filter(F.regexp_extract_all(_empty(name), F.lit(TOKEN), F.lit(0)), lambda t: t != "0:0")


def fragment_chain(name: Column) -> Column:
    """The first chain of a fragment's label with its oxygen suffix spelled one way; null without one."""
    text = _empty(name)
    suffix = F.regexp_extract(text, FRAGMENT, 3)
    oxygens = F.regexp_extract(suffix, r"^(?:\(|,O|;O)(\d*)", 1)
    tail = (
        F.when(suffix == "", "")
        .when(suffix.rlike(r"^;\(?\d+OH\)?$"), F.concat(F.lit(";"), F.regexp_extract(suffix, r"(\d+)OH", 1), F.lit("OH")))
        .otherwise(F.concat(F.lit(";O"), F.when(oxygens == "", "1").otherwise(oxygens)))
    )
    return F.when(text.rlike(FRAGMENT), F.concat(F.regexp_extract(text, FRAGMENT, 1), F.regexp_extract(text, FRAGMENT, 2), tail))


def class_key(compound_class: Column) -> Column:
    return F.regexp_replace(F.upper(_empty(compound_class)), "[^A-Z0-9]+", "")


def canonical_chains(name: Column, compound_class: Column) -> Column:
    """One spelling of a chain name: the sphingoid base first in its classes; elsewhere ethers, chains, then 0:0."""
    text, kind = F.trim(_empty(name)), F.upper(F.trim(_empty(compound_class)))
    lce = r"(?i)^LCE-PE\(([^()/]+)[/_]([^()/]+)\)$"
    a, b = F.regexp_extract(text, lce, 1), F.regexp_extract(text, lce, 2)
    text = F.when((kind == "LCE-PE") & text.rlike(lce) & ((a == "0:0") != (b == "0:0")), F.concat(F.lit("LCE-PE("), F.when(a == "0:0", b).otherwise(a), F.lit(")"))).otherwise(text)
    prefix = F.substring_index(text, "(", 1)
    tokens = F.regexp_extract_all(text, F.lit(r"(?i)[mdth]?\d+:\d+"), F.lit(0))
    is_base = lambda t: t.rlike(r"(?i)^[mdt]\d+:\d+$")
    bases, acyls = F.filter(tokens, is_base), F.filter(tokens, lambda t: ~is_base(t))
    based = kind.isin(BASE_FIRST) & (F.size(tokens) >= 2) & (F.size(bases) > 0) & (F.size(acyls) > 0)
    sphingo = F.concat(prefix, F.lit("("), F.get(bases, F.lit(0)), F.lit("/"), F.get(acyls, F.lit(0)), F.lit(")"), F.when(text.contains("OH"), "(OH)").otherwise(""))
    inner = F.regexp_extract(text, r"^[^(]*\((.*)\)[^)]*$", 1)
    separator = F.when(inner.contains("/"), "/").when(inner.contains("_"), "_")
    rank = lambda t: F.when(t.startswith("O-") | t.startswith("P-"), 0).when(t == "0:0", 2).otherwise(1)
    split = F.when(separator == "/", F.split(inner, "/")).otherwise(F.split(inner, "_"))
    ordered = F.transform(F.array_sort(F.transform(split, lambda t: F.struct(rank(t).alias("r"), t.alias("t")))), lambda s: s["t"])
    joined = F.when(separator == "/", F.array_join(ordered, "/")).otherwise(F.array_join(ordered, "_"))
    open_ = text.contains("(") & text.contains(")")
    return F.when(~open_, text).when(based, sphingo).when(separator.isNull(), text).otherwise(F.concat(prefix, F.lit("("), joined, F.lit(")")))


def reported(lipid_name: Column, chain_name: Column, compound_class: Column, resolution: Column) -> Column:
    """Lyso classes with one chain report its total; resolved chains their canonical name; others the species."""
    source = F.when(_empty(chain_name) != "", chain_name).otherwise(_empty(lipid_name))
    pairs = F.filter(F.regexp_extract_all(source, F.lit(r"\d+:\d+"), F.lit(0)), lambda t: F.substring_index(t, ":", 1).cast("int") > 0)
    lyso = class_key(compound_class).isin(LYSO_SUM) & (F.size(pairs) == 1)
    first = F.get(pairs, F.lit(0))
    number = lambda n: F.substring_index(first, ":", n).cast("int").cast("string")
    return (
        F.when(lyso, F.concat(compound_class, F.lit("("), number(1), F.lit(":"), number(-1), F.lit(")")))
        .when(resolution.isin("chain_level", "tentative_chain_level"), canonical_chains(chain_name, compound_class))
        .otherwise(lipid_name)
    )


def charge(adduct: Column) -> Column:
    """Signed charge from the text after the bracket; null where there is none."""
    form = r"\](\d*)([+-])$"
    text = F.trim(_empty(adduct))
    size = F.regexp_extract(text, form, 1)
    n = F.when(size == "", F.lit(1)).otherwise(size.try_cast("int"))
    return F.when(text.rlike(form), F.when(F.regexp_extract(text, form, 2) == "+", n).otherwise(-n))


def polarity(adduct: Column, recorded: Column | None = None) -> Column:
    """The adduct's sign, else the recorded one, else negative."""
    text = F.trim(_empty(adduct))
    other = F.lit("-") if recorded is None else F.when(F.trim(_empty(recorded)).startswith("+"), "+").otherwise("-")
    return F.when(text.endswith("+"), "+").when(text.endswith("-"), "-").otherwise(other)


def with_oxygen(formula: Column) -> Column:
    """The formula with one more oxygen."""
    text = F.trim(_empty(formula))
    at = F.regexp_instr(text, F.lit(r"O\d*"))
    count = F.regexp_extract(text, r"O(\d*)", 1)
    more = F.when(count == "", F.lit(2)).otherwise(count.try_cast("int") + 1)
    edited = F.concat(F.substring_index(text, "O", 1), F.lit("O"), more, text.substr(at + 1 + F.length(count), F.length(text)))
    return F.when(text == "", text).when(at == 0, F.concat(text, F.lit("O"))).otherwise(edited)
