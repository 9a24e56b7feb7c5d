"""Predicates and suppression rules on candidates, features and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.functions.names import charge, class_key

CONFIRMATION_MISSING, HG_ONLY = "insufficient_independent_chain_evidence", "low_confidence_hg_only"
MISSING_HG_CLASSES = ["PC", "PE", "PG", "PI", "PS", "PA"]
CHAIN_LEVELS = ["chain_level", "tentative_chain_level"]


def allowed(compound_class: Column, adduct: Column, classes: list[str] | None = None, adducts: list[str] | None = None) -> Column:
    """Listed classes and adducts; PS and LPS ammonium forms never."""
    key = class_key(compound_class)
    ok = ~(key.isin("PS", "LPS") & (F.trim(adduct) == "[M+NH4]+"))
    if classes is not None:
        ok = ok & key.isin(classes)
    return ok & adduct.isin(adducts) if adducts is not None else ok


def charge_compatible(observed: Column, polarity: Column, adduct: Column) -> Column:
    """Signs must agree and sizes too; what isn't known passes."""
    own, mode = charge(adduct), F.lower(F.coalesce(polarity, F.lit("")))
    wrong = (mode.isin("+", "positive", "pos") & (own < 0)) | (mode.isin("-", "negative", "neg") & (own > 0))
    size = F.when((F.coalesce(observed, F.lit(0)) == 0) | own.isNull(), True).otherwise(F.abs(observed) == F.abs(own))
    return ~F.coalesce(wrong, F.lit(False)) & size


def overlapping(candidates: DataFrame, spectrum: str, fragments: str, peaks: str, ppm: float, least: int = 8, relevant=None) -> DataFrame:
    """Candidates of which a (``relevant``) fragment has a peak in its window; spectra with up to ``least`` candidates keep all.

    ``fragments`` is array<struct<mz, ...>>, ``peaks`` array<double>; both stay inside the row, so nothing is joined.
    """
    relevant = relevant or (lambda f: F.lit(True))
    hit = F.exists(fragments, lambda f: relevant(f) & F.exists(peaks, lambda p: F.abs(p - f["mz"]) <= F.abs(f["mz"]) * ppm * 1e-6))
    n = F.count("*").over(Window.partitionBy(spectrum))
    return candidates.withColumn("_n", n).where((F.col("_n") <= least) | hit).drop("_n")


def admitted(passed: Column, reason: Column, missing: Column) -> Column:
    """Passed gates, or a chain confirmation as the only thing missing."""
    return passed | ((reason == CONFIRMATION_MISSING) & (missing == "chain_confirmation"))


def without_hg_only(rows: DataFrame, spectrum: str, resolution: str, reason: str) -> DataFrame:
    """Head-group-only results go where the spectrum has a chain result."""
    chain = F.max(F.col(resolution).isin(CHAIN_LEVELS)).over(Window.partitionBy(spectrum))
    weak = (F.col(resolution) == "tentative_species_level") & (F.col(reason) == HG_ONLY)
    return rows.withColumn("_chain", chain).where(~(F.col("_chain") & weak)).drop("_chain")


def without_competing_adducts(rows: DataFrame, spectrum: str, compound_class: str, adduct: str, passed: str, resolution: str, reason: str) -> DataFrame:
    """A resolved PE of one of the H and Na adducts removes candidates of the other that failed their gates."""
    pe = (class_key(F.col(compound_class)) == "PE") & F.col(adduct).isin("[M+H]+", "[M+Na]+")
    sure = pe & F.col(passed) & (F.col(resolution) == "chain_level") & (F.coalesce(reason, F.lit("")) == "")
    w = Window.partitionBy(spectrum)
    marks = rows.withColumn("_any", F.max(sure).over(w)).withColumn("_own", F.max(sure).over(Window.partitionBy(spectrum, adduct)))
    return marks.where(~(pe & F.col("_any") & ~F.col("_own") & ~F.col(passed))).drop("_any", "_own")


def without_isomers(rows: DataFrame, spectrum: str, compound_class: str, lipid_name: str, chain_name: str, adduct: str, mz: str, marker: str) -> DataFrame:
    """Of d/h and t spellings of one ceramide the marker of the t form decides which stays.

    A name with d base and h acid, Xx(dA:B/hC:D), stands against Xx(tA:B-1/C:D+1); both get the latter as the key of one group.
    """
    form = r"(?i)^([^()]+)\(d(\d+):(\d+)/h(\d+):(\d+)\)$"
    name = F.coalesce(F.col(chain_name), F.lit(""))
    part = lambda i: F.regexp_extract(name, form, i).try_cast("int")
    hydroxy = name.rlike(form) & (part(3) >= 1)
    other = F.concat(F.regexp_extract(name, form, 1), F.lit("(t"), part(2), F.lit(":"), part(3) - 1, F.lit("/"), part(4), F.lit(":"), part(5) + 1, F.lit(")"))
    keyed = rows.withColumn("_h", F.coalesce(hydroxy, F.lit(False))).withColumn("_pair", F.when(F.col("_h"), other).otherwise(name))
    w = Window.partitionBy(spectrum, class_key(F.col(compound_class)), lipid_name, "_pair", adduct, F.round(F.col(mz), 4))
    keyed = keyed.withColumn("_hs", F.max("_h").over(w)).withColumn("_ts", F.max(~F.col("_h")).over(w)).withColumn("_seen", F.max(~F.col("_h") & F.col(marker)).over(w))
    gone = F.when(F.col("_h"), F.col("_ts") & F.col("_seen")).otherwise(F.col("_hs") & ~F.col("_seen"))
    return keyed.where(~gone).drop("_h", "_pair", "_hs", "_ts", "_seen")


def tentative_fallback(rows: DataFrame, spectrum: str, order: str) -> DataFrame:
    """Where nothing passed, the best phospholipid that lacks its head group alone, all of whose expected chains are matched.

    Columns: passed, compound_class, missing, expected and matched (arrays of chains), loss_count, final_score, intensity,
    relative_intensity, ppm_error.
    """
    ok = (
        ~F.col("passed") & class_key(F.col("compound_class")).isin(MISSING_HG_CLASSES) & (F.col("missing") == "hg") & (F.size("expected") > 0)
        & (F.size(F.array_except("expected", "matched")) == 0) & (F.col("loss_count") >= 1)
    )
    w = Window.partitionBy(spectrum)
    by = [F.desc("loss_count"), F.desc("final_score"), F.desc("intensity"), F.desc("relative_intensity"), F.abs("ppm_error"), F.col(order)]
    left = rows.withColumn("_any", F.max("passed").over(w)).where(~F.col("_any") & ok)
    best = left.withColumn("_r", F.row_number().over(w.orderBy(*by))).where("_r = 1").drop("_r", "_any")
    return best.withColumn("resolution_level", F.lit("tentative_chain_level")).withColumn("downgrade_reason", F.lit("tentative_missing_hg_fa_full_loss"))


def scored_actions(rows: DataFrame, score: str, action: str, minimum: float = 50.0, use_score: bool = True, use_series: bool = True, retain: bool = True) -> DataFrame:
    """No row is dropped: each gets an action and whether it is consistent in time; ``action`` is what the series model said."""
    ok = F.coalesce(F.col(score) >= minimum, F.lit(False)) if use_score else F.lit(True)
    said = F.coalesce(F.col(action), F.lit("unmodeled")) if use_series else F.lit("not_requested")
    kept = F.when(said == "unmodeled", "retain_unmodeled").otherwise(said) if use_series and retain else said
    out = F.when(~ok, "score_reject").otherwise(kept)
    good = F.lit(["not_requested", "pass", "high_confidence_pass", "low_confidence_rescued", "species_rescued", *(["retain_unmodeled"] if retain else [])])
    return rows.withColumn("RT_filter_action", out).withColumn("RT_consistency_pass", F.array_contains(good, F.col("RT_filter_action")))


def chain_level(level: Column, support: Column) -> Column:
    """Rows annotated at chain level, whatever the spelling, and not MS2-only."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(level, F.lit("")))), r"[\s_-]+", "")
    return plain.isin("链水平", "chainlevel", "chainresolved") & (F.coalesce(support, F.lit("")) != "MS2-only")


def high_enough(height: Column, minimum: float) -> Column:
    """Apex height at or above the minimum; a minimum of 0 keeps all, otherwise a row without a height is an error."""
    if minimum <= 0:
        return F.lit(True)
    return F.when(height.isNull(), F.raise_error(F.lit("a feature has no apex height")).cast("boolean")).otherwise(height >= minimum)


def browse(rows: DataFrame, identified: bool | None = None, confidence: list[str] | None = None, ecn: list[str] | None = None, classes: list[str] | None = None, query: str = "", texts: list[Column] = (), region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows that pass all given choices: a text found in any of ``texts``, a rectangle of time and mass; both confidences mean all."""
    out = rows
    if identified is not None:
        out = out.where(F.col("identified") if identified else ~F.col("identified"))
    if confidence is not None and set(confidence) != {"高", "低"}:
        out = out.where(F.col("confidence").isin(confidence))
    if ecn is not None:
        out = out.where(F.col("ecn").isin(ecn))
    if classes is not None:
        out = out.where(F.coalesce("compound_class", F.lit("")).isin(classes))
    if query.strip():
        found = F.lit(False)
        for c in texts:
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.strip().lower()))
        out = out.where(found)
    return out.where(F.col("rt").between(*region[:2]) & F.col("mz").between(*region[2:])) if region else out


def single_ions(mz: Column, rt: Column, charge_: Column, isotope: Column, feature: Column) -> Column:
    """Finite positive mass and time, charge at most 1, monoisotopic, with an id."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return finite(mz) & (mz > 0) & finite(rt) & (rt >= 0) & (F.abs(F.coalesce(charge_, F.lit(0))) <= 1) & (F.coalesce(isotope, F.lit(0)) <= 0) & (F.coalesce(feature, F.lit("")) != "")


def included(samples: DataFrame, path: str, flag: str, suffix: str = ".mzml") -> DataFrame:
    """Samples that take part; an error if none does, a name has another suffix or two names are alike but for their case."""
    out = samples.where(F.col(flag))
    name = F.lower(F.substring_index(F.col(path), "/", -1))
    seen = out.agg(F.count("*").alias("n"), F.count_distinct(name).alias("d"), F.count_if(~F.endswith(name, F.lit(suffix))).alias("bad")).first()
    if not seen.n:
        raise ValueError("no sample is included")
    if seen.bad or seen.d < seen.n:
        raise ValueError("included samples must be distinct files of the right type")
    return out
