"""Gates of glycerides, low-confidence fallbacks, oxidised chains; chain labels of fragments; isotope requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.functions.masses import PROTON, fatty_acid
from spectralake.functions.names import CORE, FRAGMENT, chain_tokens, class_key, fragment_chain

# Thresholds of the fallbacks, mass of water, classes whose RCO gate asks for half.
FAH_MATCHES, FAH_SCORE, FAH_SCORE_HG, FAH_QUALITY, HG_LEVEL = 2, 40.0, 20.0, 0.50, 0.10
WATER = 18.01056468
EST = r"(?i)^TG-EST(?:\s+|\()(\d+:\d+)_(\d+:\d+)_(\d+:\d+);O\(FA\s+(\d+:\d+)\)\)?$"


def substituents(compound_class: Column, chain_name: Column) -> Column:
    """The three groups of a TG, TG-O or TG-EST by its name, with repeats; empty for other classes."""
    key = class_key(compound_class)
    tokens = chain_tokens(chain_name)
    ether = lambda t: F.upper(t).startswith("O-") | F.upper(t).startswith("P-")
    name = F.trim(F.coalesce(chain_name, F.lit("")))
    est = F.array(F.concat(F.lit("fa:"), F.regexp_extract(name, EST, 1)), F.concat(F.lit("fa:"), F.regexp_extract(name, EST, 2)), F.lit("fahfa"))
    return (
        F.when(key == "TG", F.transform(tokens, lambda t: F.concat(F.lit("acyl:"), t)))
        .when(key == "TGO", F.transform(tokens, lambda t: F.concat(F.when(ether(t), "ether:").otherwise("acyl:"), t)))
        .when((key == "TGEST") & name.rlike(EST), est)
        .otherwise(F.array().cast("array<string>"))
    )


def substituent(compound_class: Column, kind: Column, name: Column) -> Column:
    """The group that a diagnostic loss stands for; null for other fragments."""
    key, compact, token = class_key(compound_class), F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")), fragment_chain(name)
    acyl = compact.contains("M-NH3-(ROOH)+NH4")
    group = (
        F.when((key == "TGO") & compact.startswith("[M-R1-OH+H]+("), F.concat(F.lit("ether:"), token)).when(key.isin("TG", "TGO") & acyl, F.concat(F.lit("acyl:"), token))
        .when((key == "TGEST") & compact.startswith("[M+H-FAHFA]+("), F.lit("fahfa")).when((key == "TGEST") & compact.startswith("[M+H-FA]+("), F.concat(F.lit("fa:"), token))
    )
    return F.when(kind == "Diagnostic_FA_Loss", group)


def all_substituents(expected: Column, matched: Column) -> Column:
    """Every distinct group is matched, and there is one."""
    return (F.size(expected) > 0) & (F.size(F.array_except(expected, F.coalesce(matched, F.array().cast("array<string>")))) == 0)


def acyl_ions(available: Column, matched: Column, ether: Column) -> Column:
    """At least two acyl ions, or half of them (rounded up) for ether classes, are there and matched."""
    asked = F.when(available <= 0, 0).when(ether, F.greatest(F.lit(1), F.ceil(available / 2).cast("int"))).otherwise(2)
    return (asked > 0) & (available >= asked) & (matched >= asked)


def all_losses(library: Column, matched: Column) -> Column:
    """Every diagnostic loss of the record is matched (numbers of fragments)."""
    return (F.size(library) > 0) & (F.size(F.array_except(library, matched)) == 0)


def chains_only(positive: Column, blocked: Column, missing: Column, total_hg: Column, matched_hg: Column, total_fah: Column, matched_fah: Column, quality: Column, score: Column, support_pool: Column, hg_first: Column) -> Column:
    """A tentative chain result without its head group: enough chains of enough quality, and nothing else missing.

    ``missing`` is an array of groups; ``blocked`` classes never qualify.
    """
    only = (F.size(missing) > 0) & (F.size(F.array_except(missing, F.array(F.lit("hg"), F.lit("sphingo_rule")))) == 0)
    enough = (total_fah > 0) & (total_hg > 0) & (matched_hg == 0) & (matched_fah >= FAH_MATCHES) & (~support_pool | (quality >= FAH_QUALITY))
    return positive & ~blocked & only & enough & (score >= F.when(hg_first, FAH_SCORE_HG).otherwise(FAH_SCORE))


def head_only(hg_first: Column, blocked: Column, missing: Column, total_hg: Column, matched_hg: Column, level: Column) -> Column:
    """A tentative species result by its head group alone: nothing but chains or losses missing, and 10 % intensity."""
    only = F.size(F.array_except(missing, F.array(F.lit("fah"), F.lit("loss")))) == 0
    return hg_first & ~blocked & only & (total_hg > 0) & (matched_hg > 0) & (level >= HG_LEVEL)


def oxygens(token: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(token, r";O(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(token, r";(\d+)OH$", 1), F.lit("")))
    return F.coalesce(found.try_cast("int"), F.lit(0))


def oxidised_chains(rows: DataFrame, compound_class: str, chain_name: str, matches: str) -> DataFrame:
    """Adds oxidised_missing, what two-chain oxidised records lack (null for others): two peaks for a chain with two oxygens, one for
    others; an oxygenated chain needs one that isn't dehydrated; both chains' peaks must be different ones.

    ``matches`` is array<struct<type, name, mz>>.
    """
    tokens = F.transform(F.regexp_extract_all(F.coalesce(F.col(chain_name), F.lit("")), F.lit(FRAGMENT), F.lit(0)), fragment_chain)
    out = rows.withColumn("_t", tokens)
    applies = F.upper(F.coalesce(F.col(compound_class), F.lit(""))).startswith("OX") & (F.size("_t") == 2) & F.exists("_t", lambda t: oxygens(t) > 0)
    loss = lambda m: (m["type"] == "Neutral_Loss") & m["name"].rlike(r"^\[M.*(?:R\d?(?:COOH|=O)|ROOH)")
    usable = F.filter(matches, lambda m: m["type"].isin("Diagnostic_FA", "Diagnostic_FA_Loss", "FA_Frag") | loss(m))
    wet = lambda m: ~F.replace(m["name"], F.lit(" "), F.lit("")).rlike(r"(?i)-(?:\d*)H2O")
    out = out.withColumn("_u", F.transform(usable, lambda m: F.struct(fragment_chain(m["name"]).alias("t"), m["mz"].alias("mz"), wet(m).alias("a"))))
    for i in (0, 1):
        token = F.get("_t", F.lit(i))
        own = F.filter("_u", lambda m: m["t"] == token)  # noqa: B023
        out = out.withColumns({f"_p{i}": F.array_distinct(F.transform(own, lambda m: m["mz"])), f"_a{i}": F.array_distinct(F.transform(F.filter(own, lambda m: m["a"]), lambda m: m["mz"])), f"_o{i}": oxygens(token)})
        out = out.withColumn(f"_n{i}", F.when(F.col(f"_o{i}") >= 2, 2).otherwise(1))
    parts = []
    for i in (0, 1):
        ox = F.col(f"_o{i}") > 0
        parts += [F.when(F.size(f"_p{i}") < F.col(f"_n{i}"), F.when(ox, "oxidized_chain_fragments").otherwise("partner_chain")), F.when(ox & (F.size(f"_a{i}") == 0), "oxidation_localization")]
    missing = F.array_distinct(F.array_compact(F.array(*parts)))

    def choices(i: int) -> Column:
        """Sets of peaks that satisfy a chain: single peaks or pairs, with an anchor where it is oxygenated."""
        p, a, ox = F.col(f"_p{i}"), F.col(f"_a{i}"), F.col(f"_o{i}") > 0
        singles = F.transform(p, lambda x: F.array(x))
        pairs = F.flatten(F.transform(p, lambda x: F.transform(F.filter(p, lambda y: y > x), lambda y: F.array(x, y))))
        every = F.when(F.col(f"_n{i}") == 2, pairs).otherwise(singles)
        return F.filter(every, lambda s: ~ox | F.exists(s, lambda x: F.array_contains(a, x)))

    out = out.withColumns({"_c0": choices(0), "_c1": choices(1)})
    apart = F.exists("_c0", lambda s: F.exists("_c1", lambda t: ~F.arrays_overlap(s, t)))
    full = F.when((F.size(missing) == 0) & ~apart, F.array(F.lit("independent_chain_peaks"))).otherwise(missing)
    out = out.withColumn("oxidised_missing", F.when(applies, full))
    return out.drop("_t", "_u", "_c0", "_c1", *[f"_{c}{i}" for c in "paon" for i in (0, 1)])


def chain_label(lipid_name: Column, label: Column, precursor: Column, mz: Column, adduct: Column) -> Column:
    """The label with the chain that a position or, for simple acyl pathways, the mass tells; as it is where neither does."""
    tokens = chain_tokens(lipid_name)
    plain = (
        label.rlike("(?i)R[1-4]|ROOH|R=O|RCO") & fragment_chain(label).isNull() & (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(r"^(?:O-|P-)?\d+:\d+"))
        & ~lipid_name.rlike(r"(?i)-N-|\(FA\s|NAPE|NAPS|LNAPE|HBMP") & ~lipid_name.rlike(r"(?<!\d)0:0")
    )
    positions = F.array_distinct(F.regexp_extract_all(label, F.lit(r"(?i)R([1-4])(?=COOH|COO|CO|=O|OH|[-+\)])"), F.lit(1)))
    at = F.get(tokens, F.get(positions, F.lit(0)).cast("int") - 1)
    compact = F.regexp_replace(label, r"\s+", "")

    def expected(t: Column) -> Column:
        fa = fatty_acid(F.regexp_extract(t, CORE, 2).cast("int"), F.regexp_extract(t, CORE, 3).cast("int"))
        return (
            F.when(compact.isin("[M-(ROOH)+H]+", "[M-ROOH+H]+") & (adduct == "[M+H]+"), precursor - fa).when(compact.isin("[M-(R=O)+H]+", "[M-R=O+H]+") & (adduct == "[M+H]+"), precursor - fa + WATER)
            .when(compact.isin("[RCOO]-", "RCOO-"), fa - PROTON).when(compact.isin("(R=O)+", "[RCO]+", "RCO+"), fa - WATER + PROTON)
        )

    fits = F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^\d+:\d+$") & F.coalesce(F.abs(expected(t) - mz) <= 0.002, F.lit(False))))
    by_mass = F.when(F.size(fits) == 1, F.concat(label, F.lit("("), F.get(fits, F.lit(0)), F.lit(")"))).otherwise(label)
    by_place = F.when((F.size(positions) == 1) & (F.size(tokens) == 2) & at.isNotNull(), F.concat(label, F.lit("("), at, F.lit(")"))).otherwise(label)
    return F.when(~F.coalesce(plain, F.lit(False)), label).when(F.size(positions) > 0, by_place).otherwise(by_mass)


def isotope_requests(requests: DataFrame, scans: DataFrame, surveys: DataFrame) -> DataFrame:
    """Requests (key, file, scan, mz, rt) with the survey before their scan, or why there is none.

    Scans are (file, scan, scan_mz, scan_rt, ord), surveys (file, survey, ord): the saved mass and time must be the scan's own (40 ppm,
    1e-4 min), and the latest survey before it in order of acquisition counts. Equal requests are one.
    """
    w = Window.partitionBy("file").orderBy("ord", F.col("survey").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = scans.withColumn("survey", F.lit(None).cast(surveys.schema["survey"].dataType)).unionByName(surveys, allowMissingColumns=True)
    placed = both.withColumn("before", F.last("survey", ignorenulls=True).over(w)).where("scan is not null").drop("survey", "ord")
    joined = requests.dropDuplicates(["key", "file", "scan"]).join(placed, ["file", "scan"], "left")
    wrong = F.col("scan_mz").isNull() | (F.abs(F.col("rt") - F.col("scan_rt")) > 1e-4) | (F.abs(F.col("mz") - F.col("scan_mz")) > F.col("scan_mz") * 40e-6)
    status = F.when(F.col("scan_rt").isNull(), "scan_not_found").when(F.coalesce(wrong, F.lit(False)), "scan_metadata_mismatch").when(F.col("before").isNull(), "no_preceding_ms1").otherwise("ok")
    return joined.withColumn("status", status).select("key", "file", "scan", "status", F.when(F.col("status") == "ok", F.col("before")).alias("survey"))
