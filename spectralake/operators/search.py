"""Spectrum search: matching and scoring as expressions on arrays, and the whole search as one cogroup per mass bin.

Spectra go to the bin of their precursor, library records to every bin that a window around them touches, so a spectrum meets all its
candidates in one place and nothing is joined pair by pair. A bin with more than CROWD spectra is dealt to several groups, each of
which gets the bin's records. Copies, which differ in their number or name alone, are prepared and searched once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.functions import rulebook
from spectralake.functions import spectra as kernels
from spectralake.operators import programs, routing
from spectralake.session import reliable

BIN, FINE, CROWD = 1.0, 0.01, 4000
#: What decides the result of a spectrum, and of a library record.
SPECTRUM, RECORD = ["precursor_mz", "mz", "intensity"], ["compound_class", "lipid_name", "chain_name", "adduct", "precursor_mz", "chains", "fragments"]
RESULT = """spectrum string, record_id long, compound_class string, matched_name string, library_species_name string, adduct string, precursor_mz double, ppm_error double, result_rank int, result_rank_scope string,
    final_score double, normalized_match_score double, ppm_score double, resolution_level string, downgrade_reason string, matched_fragment_count int, matched_fragments string, matched_intensity_sum double,
    matched_relative_intensity_sum double, fah_score double, hg_score double, other_score double"""


def prepared(peaks: Column, least: float = 0.0) -> Column:
    """Peaks (mz, intensity) by mass with relative intensities of at least ``least``; empty where nothing is above 0."""
    top = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    scaled = F.transform(F.array_sort(F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), (p["intensity"] / top).alias("relative")))
    empty = F.array().cast("array<struct<mz:double,intensity:double,relative:double>>")
    return F.when(F.coalesce(top, F.lit(0.0)) > 0, F.filter(scaled, lambda p: p["relative"] >= least)).otherwise(empty)


def greedy(fragments: Column, peaks: Column, ppm: float) -> Column:
    """For each fragment (mz) in order the index from 1 of its peak (mz, relative), 0 without one: the most intense unused peak in the
    window, the first of equals. Nested folds over short arrays, without leaving the JVM."""
    index = F.sequence(F.lit(1), F.greatest(F.size(peaks), F.lit(1)))

    def take(used: Column, f: Column) -> Column:
        width = F.abs(f["mz"]) * ppm * 1e-6
        fits = F.filter(index, lambda i: (F.size(peaks) > 0) & (F.get(peaks, i - 1)["mz"] >= f["mz"] - width) & (F.get(peaks, i - 1)["mz"] <= f["mz"] + width) & ~F.array_contains(used, i))
        best = F.aggregate(fits, F.lit(0), lambda a, i: F.when((a == 0) | (F.get(peaks, i - 1)["relative"] > F.get(peaks, a - 1)["relative"]), i).otherwise(a))
        return F.concat(used, F.array(best))

    return F.aggregate(fragments, F.array().cast("array<int>"), take)


def beyond_precursor(peaks: Column, precursor: Column) -> Column:
    """Relative intensities over the base peak outside the precursor's cluster, where that is more than the plain one."""
    far = lambda p: F.abs(p["mz"] - precursor) > kernels.CLUSTER
    base = F.array_max(F.transform(F.filter(peaks, far), lambda p: p["intensity"]))
    return F.transform(peaks, lambda p: F.when(far(p) & (F.coalesce(base, F.lit(0.0)) > 0), F.greatest(p["relative"], F.least(p["intensity"] / base, F.lit(1.0)))).otherwise(p["relative"]))


def pool_totals(rows: DataFrame, keys: list[str], weights: dict[str, float] = kernels.WEIGHTS) -> DataFrame:
    """Scores of candidates from their fragments (pool, level: relative intensity of the match or null, peak).

    Pools with fragments share the weights; the only structural one takes the larger structural weight; ``other`` counts up to three
    matches, the others take their best, saturated at half 0.10 in the primary pool and 0.05 elsewhere.
    """
    pools = list(weights)
    have = rows.groupBy(*keys).agg(*[F.count_if(F.col("pool") == p).alias(f"n_{p}") for p in pools], *[F.count_if((F.col("pool") == p) & F.col("level").isNotNull()).alias(f"m_{p}") for p in pools], *[F.max(F.when(F.col("pool") == p, F.col("level"))).alias(f"x_{p}") for p in pools])
    only = {"fah": (F.col("n_fah") > 0) & (F.col("n_hg") == 0), "hg": (F.col("n_hg") > 0) & (F.col("n_fah") == 0)}
    most = max(weights["fah"], weights["hg"])
    w = {p: F.when(only[p], most).otherwise(weights[p]) if p in only else F.lit(weights[p]) for p in pools}
    total = sum((F.when(F.col(f"n_{p}") > 0, w[p]).otherwise(0.0) for p in pools), F.lit(0.0))
    active = sum((F.when(F.col(f"n_{p}") > 0, 1).otherwise(0) for p in pools), F.lit(0))
    first = F.when((F.col("n_fah") > 0) & ((F.col("n_hg") == 0) | (weights["fah"] >= weights["hg"])), "fah").when(F.col("n_hg") > 0, "hg")
    out = have
    for p in pools:
        share = F.when(F.col(f"n_{p}") == 0, 0.0).when(total > 0, w[p] / total * 100).otherwise(100.0 / active)
        half = F.when(first == p, kernels.PRIMARY).otherwise(kernels.SECONDARY)
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f"x_{p}", F.lit(0.0))))
        quality = F.when(F.col(f"n_{p}") > 0, F.least(F.lit(1.0), F.col(f"m_{p}") / F.least(F.col(f"n_{p}"), F.lit(3)))).otherwise(0.0) if p == "other" else F.when(x > 0, F.least(F.lit(1.0), (1 + half) * x / (x + half))).otherwise(0.0)
        out = out.withColumn(f"{p}_score", share * quality)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum((F.col(f"{p}_score") for p in pools), F.lit(0.0))))
    return out.withColumn("total_score", F.round(score, 4)).select(*keys, *[f"{p}_score" for p in pools], "total_score")


def precursor_only(spectra: DataFrame, ppm_precursor: float, ppm_fragment: float) -> DataFrame:
    """Free acids and amides: the precursor ion alone is the evidence. Rows: record_mz, precursor_mz, ion_mz, peaks (mz, relative).

    Out of tolerance or without a peak the score is 0 and the precursor is missing; else the saturated intensity of its peak.
    """
    error = (F.col("precursor_mz") - F.col("record_mz")) / F.col("record_mz") * 1e6
    near = F.filter("peaks", lambda p: F.abs(p["mz"] - F.col("ion_mz")) <= F.abs(F.col("ion_mz")) * ppm_fragment * 1e-6)
    best = F.array_max(F.transform(near, lambda p: p["relative"]))
    out_of = F.abs(error) > ppm_precursor
    reason = F.when(out_of, "precursor_out_of_tolerance").when(F.size(near) == 0, "no_fragment_match").otherwise("")
    quality = F.least(F.lit(1.0), (1 + kernels.PRIMARY) * best / (best + kernels.PRIMARY))
    return spectra.withColumns({"ppm_error": error, "reason": reason}).withColumn("score", F.when(F.col("reason") == "", F.round(100 * quality, 4)).otherwise(0.0)).withColumn("passed", F.col("reason") == "")


def evidence_program(mask: Column, program: list[list[tuple[int, int]]]) -> Column:
    """Whether a bit mask of matched fragments meets a program: any of its branches, all of whose (bits, count) have that many set."""
    out = F.lit(False)
    for branch in program:
        ok = F.lit(True)
        for bits, count in branch:
            ok = ok & (F.bit_count(mask.bitwiseAND(F.lit(bits))) >= count)
        out = out | ok
    return out


def _records(pdf: pd.DataFrame) -> list[kernels.Record]:
    out = []
    for r in pdf.itertuples(index=False):
        f = r.fragments
        key = kernels.class_key(r.compound_class)
        tokens = Counter(r.chains)
        quality = 3 if key in kernels.TRIPLE and r.adduct.endswith("+") else 2 if key.startswith("OX") and len(r.chains) == 2 else 1
        out.append(
            kernels.Record(
                r.record_id, r.lipid_name, r.chain_name, r.compound_class, r.adduct, r.precursor_mz, np.array([x["mz"] for x in f], float), [x["name"] for x in f], [x["type"] for x in f],
                [x["pool"] for x in f], [x["chain"] or "" for x in f], dict(tokens), quality, program=None if r.program is None else [[(n["mask"], n["least"]) for n in b] for b in r.program],
            ).prepare()
        )
    return out


def _row(spectrum: str, precursor: float, mz: np.ndarray, intensity: np.ndarray, hit: kernels.Hit, rank: int, scope: str) -> tuple:
    r = hit.record
    sort = np.argsort(mz, kind="stable")
    mz, intensity = mz[sort], intensity[sort]
    labels = sorted((mz[p], r.names[f], r.types[f]) for f, p in hit.matches)
    text = "; ".join(f"{m:.4f} {n}".rstrip() for m, n, _ in labels)
    total = sum(float(intensity[p]) for _, p in hit.matches)
    near = max(0.0, 1 - min(abs(hit.ppm), 10.0) / 10)
    name = r.chain_name if hit.resolution == "chain_level" else r.name
    return (
        spectrum, r.number, r.kind, name, r.name, r.adduct, precursor, hit.ppm, rank, scope, hit.score, round(min(max(hit.score / 100, 0), 1) * 100, 4), round(near * 100, 4), hit.resolution, hit.reason, len(hit.matches), text,
        total, total / float(intensity.max()), hit.pools.get("fah", 0.0), hit.pools.get("hg", 0.0), hit.pools.get("other", 0.0),
    )


def with_evidence(library: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The library with a pool for each fragment, by routing where it has none, and with the programs of ``rules`` (null without a rule)."""
    fields = library.schema["fragments"].dataType.elementType.names
    if "pool" not in fields:
        also = (lambda f: f) if "also" in fields else lambda f: f.withField("also", F.lit(None).cast("array<string>"))
        library = routing.routed(library.withColumn("fragments", F.transform("fragments", also)))
        library = library.withColumn("fragments", F.zip_with("fragments", "routes", lambda f, r: f.withField("pool", F.get(r["pools"], 0)))).drop("routes")
    if rules is None:
        return library.withColumn("program", F.lit(None).cast(programs.PROGRAM))
    key, adduct = F.upper(F.regexp_replace("compound_class", "[^A-Za-z0-9]", "")), F.trim("adduct")
    halved = ((adduct == "[M-H]-") & key.isin("CER1P", "CERP")) | (adduct.isin("[M+CH3COO]-", "[M+HCOO]-") & (key == "SM"))
    rows = library.withColumns({
        "_rule": rulebook.rule_key(F.col("compound_class"), F.col("adduct"), F.col("chain_name")), "_series": F.lower(F.regexp_extract("chain_name", r"(?i)(?:\(|\s)([mdt])\d", 1)),
        "_lib": F.transform("fragments", lambda f: F.struct(F.trim(f["name"]).alias("name"), F.array(f["type"]).alias("types"))),
    })
    return programs.compiled(rows, rules, "_rule", "_series", "_lib", halved).drop("_rule", "_series", "_lib")


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def _single() -> Column:
    """Free acids and amides, whose rows are not collapsed by species."""
    return F.upper(F.regexp_replace("compound_class", "[^A-Za-z0-9]", "")).isin("FA", "NAE")


def signature() -> Column:
    """What decides the result of a library record (after ``with_evidence``) for a spectrum without a peak near any of its chain fragments.

    Then only the other fragments can match, in their order, so records of one signature match the same peaks, meet the same gates, score
    alike and report the same species: they differ in their error of mass alone. It holds class, adduct and species, how often each chain
    occurs, the pools of all fragments (they share the weights), the fragments without a chain and, under a rule, its program with the
    places that its masks mean and the chain name. Null for free acids and amides, whose rows are not collapsed by species, and for names
    with a chain that is null or empty.
    """
    chains = F.coalesce("chains", F.array().cast("array<string>"))
    ruled = F.col("program").isNotNull()
    often = F.array_sort(F.transform(F.array_distinct(chains), lambda c: F.size(F.filter(chains, lambda x: x == c))))
    placed = F.transform("fragments", lambda f, i: F.struct(F.when(ruled, i).alias("place"), *[f[c].alias(c) for c in ("mz", "name", "type", "pool")], F.coalesce(f["chain"], F.lit("")).alias("chain")))
    parts = (
        F.col("compound_class").alias("a"), F.col("adduct").alias("b"), F.col("lipid_name").alias("c"), often.alias("d"), F.array_sort(F.transform("fragments", lambda f: f["pool"])).alias("e"),
        F.filter(placed, lambda f: f["chain"] == "").alias("f"), F.col("program").alias("g"), F.when(ruled, F.col("chain_name")).alias("h"),
    )
    single = _single() | F.exists(chains, lambda c: c.isNull() | (c == ""))
    return F.when(~single, _digest(*parts))


def equivalence_classes(library: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """record_id, signature, and the first record_id and number of records of its class (the record alone where the signature is null)."""
    rows = library.select("record_id", *RECORD).withColumn("_same", _digest(*RECORD))
    # copies are routed and compiled once
    once = rows.groupBy("_same").agg(F.first(F.struct(*RECORD)).alias("_r"), F.min("record_id").alias("_first"), F.count("*").alias("_n")).select("_same", "_first", "_n", "_r.*")
    reliable(library.sparkSession)
    signed = with_evidence(once, rules).select("_same", "_first", "_n", signature().alias("signature")).checkpoint()
    # null signatures stay out of the grouping, and classes are counted before they are joined back
    sizes = signed.where("signature is not null").groupBy("signature").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
    classes = signed.select("_same", "signature").join(sizes, "signature", "left")
    out = rows.select("record_id", "_same").join(classes, "_same")
    return out.select("record_id", "signature", F.coalesce("_first", "record_id").alias("first_record"), F.coalesce("_n", F.lit(1)).cast("long").alias("n_records"))


def search(spectra: DataFrame, library: DataFrame, precursor_ppm: float = 5.0, fragment_ppm: float = 15.0, top: int = 3, least: float = 50.0, rules: DataFrame | None = None, collapse: bool = True) -> DataFrame:
    """Ranked candidates of every spectrum that has any.

    Spectra: spectrum, precursor_mz, mz and intensity (arrays). Library: record_id, compound_class, lipid_name, chain_name, adduct,
    precursor_mz, chains (array of the name's chains), fragments (mz, name, type, chain, and pool or else also). Records of one spectrum are
    met in order of mass, then record_id. Records under one of ``rules`` must meet it in place of the general gates. ``collapse`` scores
    of records that must score alike (``signature``) the first, which holds their place, and the nearest, which is reported; rows are the same without.
    """
    columns = [c.strip().split()[0] for c in RESULT.split(",")]
    # spectra of equal peaks have equal results: one of them is searched, under their digest
    named = spectra.where("precursor_mz > 0").select("spectrum", *SPECTRUM).withColumn("same", _digest(*SPECTRUM))
    reliable(spectra.sparkSession)
    asked = named.select("same", *SPECTRUM).dropDuplicates(["same"]).withColumn("bin", F.floor(F.col("precursor_mz") / BIN)).checkpoint()
    crowds = asked.groupBy("bin").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("deals"))
    dealt = asked.join(crowds, "bin").withColumn("deal", F.pmod(F.xxhash64("same"), "deals").cast("int")).drop("deals")
    reach = F.col("precursor_mz") * precursor_ppm * 1e-6 * 1.01
    # records that no window touches, told by fine bins, stay out of the shuffle and of Python
    width = F.col("precursor_mz") * precursor_ppm * 1e-6 * 1.01
    touched = asked.select(F.explode(F.sequence(F.floor((F.col("precursor_mz") - width) / FINE), F.floor((F.col("precursor_mz") + width) / FINE))).alias("fine")).distinct()
    near = library.select("record_id", *RECORD).withColumn("fine", F.floor(F.col("precursor_mz") / FINE)).join(touched, "fine", "left_semi").drop("fine")
    # of equal records the first is reported, and of free acids and amides, which are ranked one by one, the first ``top``
    copies = near.withColumn("_n", F.row_number().over(Window.partitionBy(_digest(*RECORD)).orderBy("record_id")))
    near = copies.where(F.col("_n") <= max(1, top)).where((F.col("_n") == 1) | _single()).drop("_n")
    # programs are compiled and fragments routed once for each record that is near, before it is spread over bins
    near = with_evidence(near, rules)
    near = near.withColumn("signature", signature() if collapse else F.lit(None).cast("string"))
    spread = near.withColumn("bin", F.explode(F.sequence(F.floor((F.col("precursor_mz") - reach) / BIN), F.floor((F.col("precursor_mz") + reach) / BIN))))
    spread = spread.join(crowds, "bin").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        out = []
        right = right.sort_values(["precursor_mz", "record_id"], kind="stable")
        records = _records(right)
        masses = right["precursor_mz"].to_numpy(float)
        alike = kernels.Alike.of(records, pd.factorize(right["signature"])[0])
        for s in left.itertuples(index=False):
            width = abs(s.precursor_mz) * precursor_ppm * 1e-6
            lo, hi = np.searchsorted(masses, s.precursor_mz - width, "left"), np.searchsorted(masses, s.precursor_mz + width, "right")
            if hi > lo:
                mz, intensity = np.asarray(s.mz, float), np.asarray(s.intensity, float)
                out += [_row(s.same, s.precursor_mz, mz, intensity, *x) for x in kernels.search(mz, intensity, s.precursor_mz, [records[i] for i in alike.kept(np.sort(mz), s.precursor_mz, masses, lo, hi, fragment_ppm)], fragment_ppm, top, least)]
        return pd.DataFrame(out, columns=columns)

    found = dealt.groupBy("bin", "deal").cogroup(spread.groupBy("bin", "deal")).applyInPandas(work, RESULT)
    return found.withColumnRenamed("spectrum", "same").join(named.select("spectrum", "same"), "same").select(columns)
