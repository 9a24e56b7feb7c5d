"""Queries on links and associations, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import annotate, associate, graphs
from spectralake.plans.bases import CANDIDATES, candidates, first_candidates, placed_candidates
from spectralake.session import table

_MIN = "epoch_us(ts)::DOUBLE / 6e7"


def _place() -> Column:
    """The order of placed candidates."""
    return F.struct((F.col("spectrum") * 10 + F.col("ord")).alias("ord"), "_at").alias("ord")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 6e7).alias("rt"))


def feature_links(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    f = e.where("event_type = 'view' and user_id % 7 <> 0").groupBy("user_id", "day").agg(F.min("event_id").alias("feature_id"), F.max("value").alias("feature_mz"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"))
    f = f.select(F.concat(F.lit("/a/S"), "user_id", F.lit(".mzML")).alias("source_file"), "feature_id", F.col("feature_id").alias("ord"), "feature_mz", ((F.col("rt_min") + F.col("rt_max")) / 2).alias("feature_rt"), F.when(F.col("user_id") % 4 > 0, F.col("rt_min")).alias("rt_min"), "rt_max")
    s = e.where("event_type = 'purchase'").select("event_id", F.concat(F.lit("s"), "user_id", F.lit(".MZML")).alias("source_file"), F.when(F.col("event_id") % 40 > 0, F.col("value")).alias("mz"), "rt", (F.col("event_id") % 3 == 0).alias("confirmed"), (F.col("rt") - 100).alias("ms1_rt"))
    out = associate.link_features(s, f, "event_id", 250_000.0, 60_000.0, 5.0)
    return out.select("event_id", "feature_id", F.round("feature_ppm", 3).alias("feature_ppm"), F.round("rt_delta_sec", 3).alias("rt_delta_sec"), "reason")


def apex_links(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select(F.concat(F.lit("/x/P"), F.col("p_size") % 5, F.lit(".mzML")).alias("source_file"), F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("feature_mz"), (F.col("p_partkey") % 50 / 10).alias("feature_apex"), F.when(F.col("p_size") % 9 == 0, "unresolved_detector_bounds").alias("boundary"))
    s = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("p"), F.col("c_custkey") % 5, F.lit(".mzml")).alias("source_file"), (900 + F.abs("c_acctbal") / 100).alias("mz"), (F.col("c_custkey") % 50 / 10).alias("apex"))
    return associate.link_by_apex(s, f, "c_custkey", 3000.0, 3.0)


def cohort_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 200
    f = table(spark, d, "part").select(F.concat(F.lit("A"), k).alias("aligned_id"), F.concat(F.lit("s"), F.col("p_size") % 4).alias("source_file"), (900 + k * 0.5 + F.col("p_size") * 0.0001).alias("mz"), (k * 0.1 + F.col("p_size") * 0.001).alias("rt"))
    groups = associate.cohort_peaks(f)
    c = F.col("c_custkey") % 200
    rt = c * 0.1 + F.col("c_custkey") % 13 * 0.015
    s = table(spark, d, "customer").select("c_custkey", (900 + c * 0.5 + 0.003).alias("mz"), rt.alias("rt"), F.when(F.col("c_custkey") % 3 == 0, "p1").alias("peak_id"), F.array(rt, rt + 0.06).alias("apices"))
    out = associate.associate(s, groups, "c_custkey", 10.0, 6.0)
    return out.select("c_custkey", "aligned_id", F.round("group_ppm", 4).alias("group_ppm"), F.round("rt_delta_sec", 4).alias("rt_delta_sec"), "reason")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumn("id", (F.col("spectrum") * 10 + F.col("ord")) * 100_000 + F.col("partkey"))
    has = F.col("suppkey") % 3 == 0
    return rows.select("id", "matched_name", "adduct", "compound_class", "source_file", (800 + F.col("partkey") % 40 * 0.002).alias("mz"), "rt", "support", F.when(has, F.col("suppkey")).alias("feature_id"), F.when(has, 800 + F.col("suppkey") % 40 * 0.002).alias("feature_mz"), F.when(has, F.col("suppkey") % 30 * 1.0).alias("feature_rt"), F.when(has & (F.col("suppkey") % 2 == 0), F.col("suppkey") % 30 - 0.5).alias("rt_min"), F.when(has & (F.col("suppkey") % 2 == 0), F.col("suppkey") % 30 + 0.5).alias("rt_max"))


def orphan_rescue(spark: SparkSession, d: str) -> DataFrame:
    out = associate.rescue_orphans(_linked(spark, d), "id", 30.0, 60.0)
    return out.select("id", "feature_id", F.round("feature_ppm", 4).alias("feature_ppm"), F.round("rt_delta_sec", 4).alias("rt_delta_sec"))


def supported_orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = _linked(spark, d).withColumn("source_file", F.when(F.col("id") % 7 > 0, F.col("source_file")))
    return associate.without_supported_orphans(rows.select("id", "feature_id", "compound_class", "matched_name", "adduct", "source_file")).select("id", "compound_class")


def ion_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") + F.col("p_size") * 1e-3).alias("mz"), (F.col("p_partkey") % 40 * 0.02).alias("rt"), F.array(F.col("p_size") % 3, F.col("p_partkey") % 3).alias("samples"))
    out = graphs.ion_relations(rows, "p_partkey", "positive", 400.0, 0.05)
    return out.select("feature_a", "feature_b", "ion_a", "ion_b", F.round("neutral_mass", 5).alias("neutral_mass"), F.round("mass_error_ppm", 3).alias("mass_error_ppm"), "shared_samples")


def best_spectra(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").select("s_suppkey", (900 + F.abs("s_acctbal") / 100).alias("mz"), (F.col("s_suppkey") % 10 * 1.0).alias("rt"))
    s = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("spectrum_mz"), (F.col("p_partkey") % 100 / 10).alias("spectrum_rt"), F.col("p_size").cast("double").alias("final_score"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") % 7).alias("rank_score"), F.col("p_name").alias("name"))
    out = associate.best_spectrum(f, s, "s_suppkey", ["final_score", "rank_score"], "p_partkey", 3000.0, 0.25, 3.0)
    return out.select("s_suppkey", "p_partkey", "final_score", "name")


def legacy_alignment(spark: SparkSession, d: str) -> DataFrame:
    native = table(spark, d, "customer").select("c_custkey", (900 + F.abs("c_acctbal") / 100).alias("mz"), (F.col("c_custkey") % 100 / 10).alias("rt"), F.concat(F.lit("s"), F.col("c_custkey") % 3).alias("source_file"))
    aligned = table(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("aligned_id"), F.col("p_retailprice").alias("aligned_mz"), (F.col("p_partkey") % 100 / 10 - 0.2).alias("rt_min"), (F.col("p_partkey") % 100 / 10 + 0.2).alias("rt_max"), F.create_map(F.lit("s0"), (F.col("p_size") % 3).cast("double"), F.lit("s1"), (F.col("p_size") % 2).cast("double")).alias("areas"))
    return associate.infer_alignment(native, aligned, "c_custkey", 1000.0, 1.0).select("c_custkey", "aligned_id")


def precursor_refinement(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    at = lambda i: F.struct((500 + (F.col("event_id") % (i + 2)) * 0.0012 + i * F.when(F.col("event_id") % 5 == 0, 0.006).otherwise(0.05)).alias("m"))
    surveys = e.where("event_type = 'view'").select(F.col("user_id").alias("file"), F.col("event_id").alias("survey"), (F.col("rt") / 100).alias("rt_seconds"), (F.col("event_id") % 11 > 0).alias("centroided"), F.array(*[at(i)["m"] for i in range(3)]).alias("mz"), F.array(F.lit(1.0), F.lit(2.0), (F.col("event_id") % 3).cast("double")).alias("intensity"))
    spectra = e.where("event_type = 'purchase' and user_id % 9 > 0").select("event_id", F.col("user_id").alias("file"), F.when(F.col("event_id") % 30 > 0, F.lit(500.0)).otherwise(-1.0).alias("raw_mz"), (F.col("rt") / 100).alias("rt_seconds"))
    out = associate.refine_precursors(spectra, surveys.where("file % 8 > 0"), "event_id", 8.0, 3.0, 20.0)
    return out.select("event_id", "status", F.round("precursor_mz", 6).alias("precursor_mz"), "ms1_scan", F.col("confirmations").cast("long").alias("confirmations"))


def eic_traces(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("file", F.col("user_id") % 10).withColumn("scan", F.floor(F.col("rt") / 60))
    scans = e.select("file", "scan", (F.col("scan") * 60.0).alias("rt")).distinct()
    peaks = e.select("file", "scan", F.col("value").alias("peak_mz"), F.col("event_id").cast("double").alias("intensity"))
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"), (F.col("s_suppkey") % 10).alias("file"), (F.col("s_suppkey") * 10.0).alias("mz"))
    start = e.agg(F.min("rt").alias("t0"))
    q = q.crossJoin(F.broadcast(start)).select("query", "file", "mz", (F.col("t0") + F.col("query") * 100).alias("rt_low"), (F.col("t0") + F.col("query") * 100 + 3000).alias("rt_high"))
    return associate.traces(q, scans, peaks, 20_000.0, 3000.0).select("query", "scan", "intensity")


def eic_apex(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "day", F.floor("rt").alias("rt"), F.floor(F.col("value") / 50).alias("intensity"))
    per_scan = e.groupBy("user_id", "day", "rt").agg(F.max("intensity").alias("intensity"))
    return associate.apex(per_scan, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), "apex_rt", "apex_intensity")


def nearest_scans(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("file", F.col("user_id"))
    targets = e.where("event_type = 'purchase'").select("event_id", "file", F.col("rt").alias("t"))
    out = associate.nearest_scan(targets, e.where("event_type = 'view'").select("file", F.col("event_id").alias("scan"), "rt"), "event_id", 300.0)
    return out.select("event_id", "scan", F.round("off", 4).alias("off"))


def mass_fallback(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (900 + F.abs("s_acctbal") / 100).alias("mz"), (F.col("s_suppkey") % 4 == 0).alias("identified"))
    lib = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("candidate_name"), (F.col("p_size") % 2).cast("string").alias("compound_class"), F.lit("C").alias("formula"), F.lit("[M+H]+").alias("adduct"), F.col("p_retailprice").alias("theoretical_mz"), F.when(F.col("p_size") % 5 > 0, "sum_composition").otherwise("class_only").alias("resolution"), F.col("p_size").cast("long").alias("sources"))
    out = associate.mass_fallback(f, lib, 300.0, 0.5)
    return out.select("key", "candidate_name", "compound_class", "theoretical_mz", "source_record_count", "entry", F.round("ppm_error", 4).alias("ppm_error"), "ms1_rank")


def alignment_ids(spark: SparkSession, d: str) -> DataFrame:
    native = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("native"))
    members = table(spark, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("native"), F.col("c_nationkey").alias("consensus"))
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("consensus"), F.col("n_name").alias("aligned_id"))
    out = associate.checked_left(associate.checked_left(native, members, ["native"]), groups, ["consensus"])
    audit = first_candidates(spark, d).select(F.col("spectrum").alias("o_orderkey"), "matched_name")
    return associate.checked_left(out, audit, ["o_orderkey"], True).select("o_orderkey", "native", "aligned_id", "matched_name")


def detector_tables(spark: SparkSession, d: str) -> DataFrame:
    define = table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("row"), "p_retailprice")
    values = table(spark, d, "lineitem").where("l_partkey % 2 > 0").groupBy(F.col("l_partkey").alias("row")).agg(F.max("l_extendedprice").alias("s1"))
    noise = table(spark, d, "part").where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("row"), F.col("p_size").alias("sn"))
    return associate.outer_definitions(define, values, noise, "row")


def annotation_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select((F.col("suppkey") % 50).alias("feature"), "matched_name", "adduct", F.concat(F.lit("n"), F.col("spectrum")).alias("scan_id"), F.when(F.col("suppkey") % 11 > 0, F.col("source_file")).alias("source_file"), "final_score", F.when(F.col("ord") % 2 == 0, F.col("rt")).alias("rt_delta_sec"), "n_fragments", "ppm_error", (F.col("spectrum") * 10 + F.col("ord")).alias("ord"))
    out = annotate.summaries(rows, ["feature", "matched_name", "adduct"], "ord")
    return out.select("feature", "matched_name", "adduct", "final_score", "scan_id", "n_fragments", "n_spectra", "all_scan_ids", "supporting_files")


def orphan_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select((F.col("partkey") % 77).alias("cluster"), F.col("spectrum").cast("string").alias("scan_id"), "source_file", "final_score", "rt", "n_fragments", "ppm_error", (700 + F.col("final_score")).alias("mz"), ((F.col("spectrum") * 10 + F.col("ord")) * 100_000 + F.col("partkey")).alias("ord"))
    return annotate.orphan_summaries(rows, "cluster", "mz", "ord").select("cluster", "feature_id", "feature_mz", "final_score", "scan_id", "n_spectra")


def linked_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = placed_candidates(spark, d).select((F.col("suppkey") % 40).alias("key"), "spectrum", F.concat(F.lit("n"), F.col("spectrum") % 17).alias("scan_id"), "source_file", "rt", "final_score", _place())
    return annotate.linked_counts(rows, "key", "ord").join(annotate.centres(rows, "key", "spectrum", "ord", ["rt", "final_score"]), "key")


def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("%s (%.2f ppm)", F.col("matched_name"), F.col("ppm_error"))
    return annotate.candidate_text(candidates(spark, d), "spectrum", "ord", text)


def vote_selection(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    rows = c.select(
        (F.col("suppkey") % 60).alias("feature"), "spectrum", F.concat(F.lit("s"), F.col("spectrum") % 9).alias("source"), F.lower("matched_name").alias("identity"), F.when(F.col("partkey") % 17 > 0, F.col("matched_name")).alias("name"),
        F.col("compound_class").alias("comparable"), F.when(F.col("partkey") % 5 < 2, 1).otherwise(F.col("ord")).alias("rank"), F.col("final_score").alias("score"), (F.col("passed") & F.col("final_score").between(90, 100)).alias("qualified"), (F.col("spectrum") * 10 + F.col("ord")).alias("ord"),
    )
    return annotate.feature_votes(rows).select("feature", "identity", "ord", "role", F.col("position").cast("long").alias("position"), "support", "voting", "status")


def relation_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("CASE (partkey + ord) % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'shape_disagreement' WHEN 2 THEN 'local_mass_disagreement' WHEN 3 THEN 'raw_eic_not_available' ELSE 'supported' END")
    out = annotate.relation_evidence(candidates(spark, d).select("spectrum", s.alias("status"), F.col("final_score").alias("pearson"), F.col("rt").alias("cosine")), ["spectrum"])
    return out.select("spectrum", "shape_samples", "supported_samples", "rejected_samples", "pearson_median", "cosine_median", "verdict")


def consensus_features(spark: SparkSession, d: str) -> DataFrame:
    rows = placed_candidates(spark, d).select((F.col("partkey") % 500).alias("consensus"), "source_file", F.col("final_score").alias("mz"), "rt", (F.col("rt") - F.col("ord")).alias("rt_min"), (F.col("rt") + F.col("ord")).alias("rt_max"), "intensity", _place())
    out = annotate.consensus_features(rows, "consensus")
    return out.select("consensus", F.round("mz", 6).alias("mz"), F.round("rt", 6).alias("rt"), "rt_min", "rt_max", "n_samples", F.round("intensity", 3).alias("intensity"), "samples")


def qc_members(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select((F.col("partkey") % 700).alias("feature"), F.concat(F.lit("s"), F.col("suppkey") % 12).alias("sample"), F.when(F.col("suppkey") % 12 < 5, "QC").otherwise("Sample").alias("kind"), "intensity")
    return annotate.largest_members(rows, "feature", "sample", "intensity", "kind", 0.8)


def carbon_curves(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select("compound_class", (30 + F.col("partkey") % 9).alias("carbon"), "rt")
    out = annotate.carbon_curve(rows, ["compound_class"], "carbon", "rt")
    return out.select("compound_class", "n_carbons", F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"))


def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END").alias("level"))
    return annotate.scan_counts(rows, "user_id", "level")


_E = f"(SELECT event_id, user_id, event_type, value, ts::DATE AS day, {_MIN} AS rt FROM events)"
_L = f"""(SELECT (spectrum * 10 + ord) * 100000 + partkey AS id, matched_name, adduct, compound_class, source_file, 800 + partkey % 40 * 0.002::DOUBLE AS mz, rt, support, CASE WHEN suppkey % 3 = 0 THEN suppkey END AS feature_id, CASE WHEN suppkey % 3 = 0 THEN 800 + suppkey % 40 * 0.002::DOUBLE END AS feature_mz,
    CASE WHEN suppkey % 3 = 0 THEN (suppkey % 30)::DOUBLE END AS feature_rt, CASE WHEN suppkey % 6 = 0 THEN suppkey % 30 - 0.5::DOUBLE END AS rt_min, CASE WHEN suppkey % 6 = 0 THEN suppkey % 30 + 0.5::DOUBLE END AS rt_max FROM {CANDIDATES})"""
_BEST = "ORDER BY final_score DESC, coalesce({t}, 'inf'::DOUBLE), n_fragments DESC, abs(ppm_error), ord"
SQL = {
    "feature_links": f"""
        WITH e AS {_E}, f AS (SELECT user_id, min(event_id) AS fid, max(value) AS fm, min(rt) AS a, max(rt) AS b FROM e WHERE event_type = 'view' AND user_id % 7 <> 0 GROUP BY user_id, day),
        s AS (SELECT event_id, user_id, CASE WHEN event_id % 40 > 0 THEN value END AS mz, event_id % 3 = 0 AS confirmed, CASE WHEN event_id % 3 = 0 THEN rt - 100 ELSE rt END AS lrt FROM e WHERE event_type = 'purchase'),
        j AS (SELECT s.*, fid, fm, user_id % 4 > 0 AS bounded, abs((mz - fm) / fm) * 1e6 AS err, abs((a + b) / 2 - lrt) * 60 AS delta, CASE WHEN user_id % 4 > 0 THEN lrt BETWEEN a AND b ELSE abs((a + b) / 2 - lrt) <= 1000 END AS inside FROM s JOIN f USING (user_id) WHERE abs((mz - fm) / fm) * 1e6 <= 250000),
        l AS (SELECT * FROM j WHERE inside QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY err / 250000 + delta / 60000, err, delta, fid) = 1)
        SELECT s.event_id, l.fid AS feature_id, round((s.mz - l.fm) / l.fm * 1e6, 3) AS feature_ppm, round(l.delta, 3) AS rt_delta_sec, CASE WHEN s.mz IS NULL THEN 'no_matching_ms1_feature' WHEN s.user_id NOT IN (SELECT user_id FROM f) THEN 'no_ms1_feature_for_sample'
            WHEN s.event_id NOT IN (SELECT event_id FROM j) THEN 'no_ms1_feature_within_mz_tolerance' WHEN l.fid IS NULL THEN CASE WHEN s.user_id % 4 > 0 THEN 'ms2_outside_ms1_peak_bounds' ELSE 'ms2_outside_ms1_rt_window' END
            WHEN s.user_id % 4 > 0 THEN CASE WHEN s.confirmed THEN 'feature_precursor_ms1_bounds_match' ELSE 'feature_bounds_match' END ELSE 'feature_rt_window_match' END AS reason
        FROM s LEFT JOIN l USING (event_id)""",
    "apex_links": """
        WITH j AS (SELECT c_custkey, p_partkey, p_size, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN part ON p_size % 5 = c_custkey % 5 AND abs(p_retailprice - (900 + abs(c_acctbal) / 100)) <= (900 + abs(c_acctbal) / 100) * 3000.0::DOUBLE * 1e-6 AND p_partkey % 50 = c_custkey % 50)
        SELECT c_custkey, p_partkey AS feature_id FROM j WHERE n = 1 AND p_size % 9 <> 0""",
    "cohort_links": """
        WITH g AS (SELECT p_partkey % 200 AS k, median(900 + (p_partkey % 200) * 0.5::DOUBLE + p_size * 0.0001::DOUBLE) AS m, median((p_partkey % 200) * 0.1::DOUBLE + p_size * 0.001::DOUBLE) AS r, min((p_partkey % 200) * 0.1::DOUBLE + p_size * 0.001::DOUBLE) AS a, max((p_partkey % 200) * 0.1::DOUBLE + p_size * 0.001::DOUBLE) AS b FROM part GROUP BY 1),
        s AS (SELECT c_custkey, 900 + (c_custkey % 200) * 0.5::DOUBLE + 0.003::DOUBLE AS mz, (c_custkey % 200) * 0.1::DOUBLE + (c_custkey % 13) * 0.015::DOUBLE AS rt, c_custkey % 3 = 0 AS p FROM customer),
        j AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS n FROM s JOIN g ON m BETWEEN mz / (1 + 1e-5) AND mz / (1 - 1e-5) AND rt BETWEEN a - 0.1 AND b + 0.1 AND (NOT p OR abs(rt - r) <= abs(rt + 0.06 - r)))
        SELECT c_custkey, concat('A', k) AS aligned_id, round((mz / m - 1) * 1e6, 4) AS group_ppm, round(abs(rt - r) * 60, 4) AS rt_delta_sec, CASE WHEN p THEN 'cohort_eic_peak_match' ELSE 'cohort_precursor_rt_match' END AS reason FROM j WHERE n = 1""",
    "orphan_rescue": f"""
        WITH l AS {_L}, k AS (SELECT DISTINCT matched_name, adduct, compound_class, feature_id, feature_mz, feature_rt, rt_min, rt_max FROM l WHERE feature_id IS NOT NULL),
        j AS (SELECT o.id, o.mz, k.feature_id, k.feature_mz, abs((o.mz - k.feature_mz) / k.feature_mz) * 1e6 AS err, abs(k.feature_rt - o.rt) * 60 AS delta FROM l o JOIN k USING (matched_name, adduct, compound_class)
            WHERE o.feature_id IS NULL AND o.support <> 'MS2-only' AND CASE WHEN k.rt_min IS NOT NULL THEN o.rt BETWEEN k.rt_min - 2 AND k.rt_max + 2 ELSE abs(k.feature_rt - o.rt) <= 2 END)
        SELECT id, feature_id, round((mz - feature_mz) / feature_mz * 1e6, 4) AS feature_ppm, round(delta, 4) AS rt_delta_sec FROM j WHERE err <= 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY err / 30 + delta / 120, err, delta, feature_id) = 1""",
    "supported_orphans": f"""
        WITH l AS (SELECT * EXCLUDE (source_file), CASE WHEN id % 7 > 0 THEN source_file ELSE '' END AS f FROM {_L})
        SELECT id, compound_class FROM l o WHERE NOT (feature_id IS NULL AND compound_class = 'FA' AND EXISTS (SELECT 1 FROM l k WHERE k.feature_id IS NOT NULL AND k.compound_class = 'FA' AND k.matched_name = o.matched_name AND k.adduct = o.adduct AND (o.f = '' OR k.f = o.f)))""",
    "ion_relations": """
        WITH i(ion, m) AS (VALUES ('[M+H]+', 1.007276466621::DOUBLE), ('[M+NH4]+', 18.033825553::DOUBLE), ('[M+Na]+', 22.989220702::DOUBLE), ('[M+K]+', 38.963157906::DOUBLE)),
        n AS (SELECT p_partkey AS k, p_retailprice + p_size * 1e-3 AS mz, (p_partkey % 40) * 0.02::DOUBLE AS rt, list_distinct([p_size % 3, (p_partkey % 3)::INTEGER]) AS s FROM part)
        SELECT a.k AS feature_a, b.k AS feature_b, x.ion AS ion_a, y.ion AS ion_b, round((a.mz - x.m + b.mz - y.m) / 2, 5) AS neutral_mass, round((b.mz - (a.mz + y.m - x.m)) / (a.mz - x.m) * 1e6, 3) AS mass_error_ppm, len(list_intersect(a.s, b.s))::BIGINT AS shared_samples
        FROM i x JOIN i y ON x.m < y.m, n a JOIN n b ON a.k <> b.k WHERE abs(b.mz - (a.mz + y.m - x.m)) <= (a.mz - x.m) * 400.0::DOUBLE * 1e-6 AND abs(a.rt - b.rt) <= 0.05 AND len(list_intersect(a.s, b.s)) > 0""",
    "best_spectra": """
        WITH f AS (SELECT s_suppkey, 900 + abs(s_acctbal) / 100 AS mz, (s_suppkey % 10)::DOUBLE AS rt FROM supplier),
        j AS (SELECT s_suppkey, p_partkey, p_size::DOUBLE AS final_score, p_name, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 7 END AS r FROM f JOIN part ON p_retailprice BETWEEN mz - mz * 3000.0::DOUBLE * 1e-6 AND mz + mz * 3000.0::DOUBLE * 1e-6 AND p_partkey % 100 / 10.0::DOUBLE BETWEEN rt - 0.25 AND rt + 0.25
            QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY p_size DESC, r DESC NULLS LAST, p_partkey) = 1)
        SELECT s_suppkey, p_partkey, final_score, p_name AS name FROM f LEFT JOIN j USING (s_suppkey)""",
    "legacy_alignment": """
        WITH n AS (SELECT c_custkey, 900 + abs(c_acctbal) / 100 AS mz, c_custkey % 100 / 10.0::DOUBLE AS rt, c_custkey % 3 AS s FROM customer),
        j AS (SELECT c_custkey, p_partkey, count(*) OVER (PARTITION BY c_custkey) AS c FROM n JOIN part ON p_size < 30 AND abs(p_retailprice - mz) <= mz * 1000.0::DOUBLE * 1e-6 AND rt BETWEEN (p_partkey % 100 / 10.0::DOUBLE - 0.2) - 0.01 AND (p_partkey % 100 / 10.0::DOUBLE + 0.2) + 0.01
            AND CASE s WHEN 0 THEN p_size % 3 > 0 WHEN 1 THEN p_size % 2 > 0 ELSE true END)
        SELECT c_custkey, p_partkey AS aligned_id FROM n LEFT JOIN (SELECT * FROM j WHERE c = 1) USING (c_custkey)""",
    "precursor_refinement": f"""
        WITH e AS {_E},
        v AS (SELECT user_id AS f, event_id AS survey, rt / 100 AS t, event_id % 11 > 0 AS ok, list_filter([{{'m': 500 + (event_id % 2) * 0.0012::DOUBLE, 'i': 1.0}}, {{'m': 500 + (event_id % 3) * 0.0012::DOUBLE + CASE WHEN event_id % 5 = 0 THEN 0.006::DOUBLE ELSE 0.05::DOUBLE END, 'i': 2.0}}, {{'m': 500 + (event_id % 4) * 0.0012::DOUBLE + 2 * CASE WHEN event_id % 5 = 0 THEN 0.006::DOUBLE ELSE 0.05::DOUBLE END, 'i': event_id % 3}}], lambda p: p.i > 0) AS p FROM e WHERE event_type = 'view' AND user_id % 8 > 0),
        w AS (SELECT *, lag(struct_pack(t, ok, p)) OVER o AS b, lead(struct_pack(t, ok, p)) OVER o AS a, min(t) OVER (PARTITION BY f) AS t0 FROM v WINDOW o AS (PARTITION BY f ORDER BY t, survey)),
        s AS (SELECT event_id, user_id AS f, CASE WHEN event_id % 30 > 0 THEN 500.0::DOUBLE ELSE -1 END AS raw, rt / 100 AS t FROM e WHERE event_type = 'purchase' AND user_id % 9 > 0),
        l AS (SELECT f, t, max(survey) AS survey FROM v GROUP BY 1, 2),
        j AS (SELECT s.*, l.survey FROM s ASOF LEFT JOIN l ON s.f = l.f AND s.t > l.t),
        k AS (SELECT j.event_id, j.f, j.raw, j.t, w.survey, w.t AS st, w.ok, list_filter(w.p, lambda x: abs(x.m - j.raw) <= abs(j.raw) * 8.0::DOUBLE * 1e-6) AS h, w.a, w.b FROM j LEFT JOIN w ON w.f = j.f AND w.survey = j.survey),
        c AS (SELECT *, CASE WHEN b.ok AND abs(b.t - t) <= 20 AND len(list_filter(b.p, lambda x: abs(x.m - h[1].m) <= abs(h[1].m) * 3.0::DOUBLE * 1e-6)) = 1 THEN 1 ELSE 0 END + CASE WHEN a.ok AND abs(a.t - t) <= 20 AND len(list_filter(a.p, lambda x: abs(x.m - h[1].m) <= abs(h[1].m) * 3.0::DOUBLE * 1e-6)) = 1 THEN 1 ELSE 0 END AS n FROM k),
        d AS (SELECT *, CASE WHEN raw <= 0 THEN 'invalid_raw_mz' WHEN f NOT IN (SELECT f FROM v) THEN 'no_ms1' WHEN survey IS NULL THEN 'no_preceding_ms1' WHEN t - st > 20 THEN 'ms1_time_gap' WHEN NOT ok THEN 'ms1_not_centroided' WHEN len(h) = 0 THEN 'no_ms1_peak_in_association_window'
            WHEN len(h) > 1 THEN 'ambiguous_ms1_peaks' WHEN n = 0 THEN 'ms1_peak_not_confirmed' ELSE 'confirmed' END AS status FROM c)
        SELECT event_id, status, round(CASE WHEN status = 'confirmed' THEN h[1].m ELSE raw END, 6) AS precursor_mz, CASE WHEN status = 'confirmed' THEN survey END AS ms1_scan, CASE WHEN status = 'confirmed' THEN n END::BIGINT AS confirmations FROM d""",
    "eic_traces": f"""
        WITH e AS (SELECT *, user_id % 10 AS f, floor(rt / 60)::BIGINT AS scan FROM {_E}), sc AS (SELECT DISTINCT f, scan FROM e),
        q AS (SELECT s_suppkey AS query, s_suppkey % 10 AS f, s_suppkey * 10.0::DOUBLE AS mz, (SELECT min(rt) FROM e) + s_suppkey * 100 AS a FROM supplier),
        i AS (SELECT query, q.f, mz, scan FROM q JOIN sc ON sc.f = q.f AND scan * 60.0::DOUBLE BETWEEN a AND a + 3000),
        h AS (SELECT query, i.scan, event_id FROM i JOIN e ON e.f = i.f AND e.scan = i.scan AND e.value BETWEEN mz - mz * 20000.0::DOUBLE * 1e-6 AND mz + mz * 20000.0::DOUBLE * 1e-6 QUALIFY row_number() OVER (PARTITION BY query, i.scan ORDER BY abs(e.value - mz), event_id DESC) = 1)
        SELECT query, scan, coalesce(event_id, 0)::DOUBLE AS intensity FROM i LEFT JOIN h USING (query, scan)""",
    "eic_apex": f"""
        WITH e AS (SELECT user_id, day::VARCHAR AS day, floor(rt)::BIGINT AS rt, max(floor(value / 50))::BIGINT AS v FROM {_E} GROUP BY ALL)
        SELECT user_id, day, CASE WHEN v > 0 THEN rt END AS apex_rt, v AS apex_intensity FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY v DESC, rt) = 1""",
    "nearest_scans": f"""
        WITH e AS {_E}, t AS (SELECT * FROM e WHERE event_type = 'purchase'),
        j AS (SELECT t.event_id, v.event_id AS scan, abs(v.rt - t.rt) AS off FROM t JOIN e v ON v.user_id = t.user_id AND v.event_type = 'view' AND v.rt BETWEEN t.rt - 300 AND t.rt + 300 QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY abs(v.rt - t.rt), v.rt, v.event_id) = 1)
        SELECT event_id, scan, round(off, 4) AS off FROM t LEFT JOIN j USING (event_id)""",
    "mass_fallback": """
        WITH f AS (SELECT s_suppkey AS key, 900 + abs(s_acctbal) / 100 AS mz FROM supplier WHERE s_suppkey % 4 > 0),
        g AS (SELECT key, mz, p_brand AS candidate_name, (p_size % 2)::VARCHAR AS compound_class, p_retailprice AS theoretical_mz, sum(p_size)::BIGINT AS source_record_count, min(p_partkey) AS entry FROM f JOIN part ON p_size % 5 > 0 AND p_retailprice BETWEEN mz / (1 + 3e-4) AND mz / (1 - 3e-4) GROUP BY ALL)
        SELECT key, candidate_name, compound_class, theoretical_mz, source_record_count, entry, round((mz - theoretical_mz) / theoretical_mz * 1e6, 4) AS ppm_error, row_number() OVER (PARTITION BY key ORDER BY abs((mz - theoretical_mz) / theoretical_mz * 1e6), entry) AS ms1_rank FROM g""",
    "alignment_ids": f"""
        SELECT o_orderkey, o_custkey AS native, n_name AS aligned_id, matched_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 > 0 LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT spectrum, any_value(matched_name) AS matched_name FROM {CANDIDATES} WHERE ord = 1 GROUP BY 1) ON spectrum = o_orderkey""",
    "detector_tables": """
        SELECT row, p_retailprice, s1, sn FROM (SELECT p_partkey AS row, p_retailprice FROM part WHERE p_partkey % 3 > 0) FULL JOIN (SELECT l_partkey AS row, max(l_extendedprice) AS s1 FROM lineitem WHERE l_partkey % 2 > 0 GROUP BY 1) USING (row)
        LEFT JOIN (SELECT p_partkey AS row, p_size AS sn FROM part WHERE p_partkey % 4 = 1) USING (row)""",
    "annotation_summaries": f"""
        WITH r AS (SELECT suppkey % 50 AS feature, matched_name, adduct, concat('n', spectrum) AS scan, CASE WHEN suppkey % 11 > 0 THEN source_file END AS src, final_score, CASE WHEN ord % 2 = 0 THEN rt END AS dt, n_fragments, ppm_error, spectrum * 10 + ord AS ord FROM {CANDIDATES}),
        u AS (SELECT *, CASE WHEN src IS NULL THEN scan ELSE concat(src, ':', scan) END AS label FROM r), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY feature, matched_name, adduct {_BEST.format(t="dt")}) = 1),
        l AS (SELECT feature, matched_name, adduct, string_agg(label, ';' ORDER BY o) AS x FROM (SELECT feature, matched_name, adduct, label, min(ord) AS o FROM u GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT feature, matched_name, adduct, string_agg(src, ';' ORDER BY o) AS x FROM (SELECT feature, matched_name, adduct, src, min(ord) AS o FROM u WHERE src IS NOT NULL GROUP BY ALL) GROUP BY ALL), n AS (SELECT feature, matched_name, adduct, count(*) AS n FROM u GROUP BY ALL)
        SELECT feature, matched_name, adduct, final_score, scan AS scan_id, n_fragments, n AS n_spectra, l.x AS all_scan_ids, coalesce(s.x, '') AS supporting_files FROM b JOIN n USING (feature, matched_name, adduct) JOIN l USING (feature, matched_name, adduct) LEFT JOIN s USING (feature, matched_name, adduct)""",
    "orphan_summaries": f"""
        WITH r AS (SELECT partkey % 77 AS cluster, spectrum::VARCHAR AS scan_id, final_score, n_fragments, ppm_error, 700 + final_score AS mz, (spectrum * 10 + ord) * 100000 + partkey AS ord FROM {CANDIDATES}),
        g AS (SELECT cluster, median(mz) AS m, count(*) AS n, row_number() OVER (ORDER BY min(ord)) AS i FROM r GROUP BY 1)
        SELECT cluster, printf('ORPHAN_%03d', i) AS feature_id, m AS feature_mz, final_score, scan_id, n AS n_spectra FROM r JOIN g USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster {_BEST.format(t="0")}) = 1""",
    "linked_lists": f"""
        WITH r AS (SELECT suppkey % 40 AS key, spectrum, concat('n', spectrum % 17) AS scan, source_file AS src, rt, final_score, spectrum * 10 + ord AS ord FROM {CANDIDATES}),
        c AS (SELECT key, median(rt) AS rt, median(final_score) AS final_score FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key, spectrum ORDER BY ord) = 1) GROUP BY 1),
        a AS (SELECT key, string_agg(src, ';' ORDER BY o) AS files FROM (SELECT key, src, min(ord) AS o FROM r GROUP BY ALL) GROUP BY 1), b AS (SELECT key, string_agg(scan, ';' ORDER BY o) AS scans FROM (SELECT key, scan, min(ord) AS o FROM r GROUP BY ALL) GROUP BY 1)
        SELECT key, count(DISTINCT spectrum) AS n_scans, count(DISTINCT src) AS n_files, any_value(files) AS files, any_value(scans) AS scans, any_value(c.rt) AS rt, any_value(c.final_score) AS final_score FROM r JOIN a USING (key) JOIN b USING (key) JOIN c USING (key) GROUP BY key""",
    "candidate_texts": f"SELECT spectrum, string_agg(printf('%s (%.2f ppm)', matched_name, ppm_error), '; ' ORDER BY ord, printf('%s (%.2f ppm)', matched_name, ppm_error)) AS candidates FROM {CANDIDATES} GROUP BY 1",
    "vote_selection": f"""
        WITH r AS (SELECT suppkey % 60 AS feature, spectrum, concat('s', spectrum % 9) AS source, lower(matched_name) AS identity, partkey % 17 > 0 AS named, compound_class AS comparable, CASE WHEN partkey % 5 < 2 THEN 1 ELSE ord END AS rank, final_score AS score, passed AND final_score BETWEEN 90 AND 100 AS q, spectrum * 10 + ord AS ord FROM {CANDIDATES}),
        n AS (SELECT * FROM r WHERE named), t AS (SELECT feature, spectrum, count(DISTINCT identity) > 1 AS tied FROM n WHERE rank = 1 GROUP BY 1, 2), u AS (SELECT * FROM n WHERE rank = 1 AND q),
        v AS (SELECT feature, source, min(identity) AS identity, count(DISTINCT identity) = 1 AND NOT bool_or(tied) AS clear FROM u JOIN t USING (feature, spectrum) GROUP BY 1, 2),
        a AS (SELECT feature, count(*) FILTER (NOT clear) AS amb, count(*) FILTER (clear) AS voting FROM v GROUP BY 1), s AS (SELECT feature, identity, count(*) AS support FROM v WHERE clear GROUP BY 1, 2),
        l AS (SELECT feature, identity, count(*) OVER (PARTITION BY feature) AS leaders FROM s QUALIFY support = max(support) OVER (PARTITION BY feature)), ln AS (SELECT DISTINCT feature, leaders FROM l),
        p AS (SELECT u.*, min(comparable) OVER (PARTITION BY u.feature) <> max(comparable) OVER (PARTITION BY u.feature) AS mixed FROM u JOIN l USING (feature, identity) UNION ALL SELECT *, false FROM n WHERE feature NOT IN (SELECT feature FROM l)),
        k AS (SELECT feature, identity AS winner, spectrum FROM p QUALIFY row_number() OVER (PARTITION BY feature ORDER BY CASE WHEN mixed THEN 0 ELSE -q::INT END, CASE WHEN mixed THEN 0 ELSE rank END, CASE WHEN mixed THEN 0 ELSE -score END, ord, identity, spectrum) = 1),
        e AS (SELECT feature, identity, rank, score, ord, winner FROM n JOIN k USING (feature, spectrum) QUALIFY row_number() OVER (PARTITION BY feature, identity ORDER BY rank, score DESC, ord) = 1),
        e3 AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rank, score DESC, ord) AS i FROM e QUALIFY i <= 3),
        m AS (SELECT feature, identity, row_number() OVER (PARTITION BY feature ORDER BY r) AS position FROM (SELECT feature, winner AS identity, 0 AS r FROM k UNION ALL SELECT feature, identity, i FROM e3 WHERE identity <> winner) QUALIFY position <= 3),
        x AS (SELECT feature, identity, position, 'representative' AS role FROM m UNION ALL SELECT DISTINCT feature, identity, NULL, 'sample_difference' FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.feature = u.feature AND m.identity = u.identity)),
        b AS (SELECT feature, identity, ord FROM n QUALIFY row_number() OVER (PARTITION BY feature, identity ORDER BY -q::INT, score DESC, rank, ord) = 1)
        SELECT feature, identity, ord, role, position::BIGINT AS position, coalesce(support, 0) AS support, coalesce(voting, 0) AS voting, CASE WHEN leaders > 1 THEN 'tied' WHEN amb > 0 THEN 'sample_conflict' WHEN leaders = 1 THEN 'supported' ELSE 'no_qualified_top1' END AS status
        FROM x JOIN b USING (feature, identity) LEFT JOIN s USING (feature, identity) LEFT JOIN a USING (feature) LEFT JOIN ln USING (feature)""",
    "relation_evidence": f"""
        WITH r AS (SELECT spectrum, (partkey + ord) % 5 AS k, final_score AS p, rt AS c FROM {CANDIDATES}), g AS (SELECT spectrum, count(*) FILTER (k IN (0, 1, 4)) AS m, count(*) FILTER (k IN (0, 4)) AS s, count(*) FILTER (k IN (1, 2)) AS x, median(p) FILTER (k IN (0, 1, 4)) AS pm, median(c) FILTER (k IN (0, 1, 4)) AS cm FROM r GROUP BY 1)
        SELECT spectrum, m AS shape_samples, s AS supported_samples, x AS rejected_samples, pm AS pearson_median, cm AS cosine_median, CASE WHEN s > 0 AND x > 0 THEN 'mixed_evidence' WHEN s > 0 THEN 'EIC_supported' WHEN x > 0 THEN 'rejected' ELSE 'mass_RT_only' END AS verdict FROM g""",
    "consensus_features": f"""
        WITH r AS (SELECT partkey % 500 AS consensus, source_file AS s, final_score, rt, rt - ord AS a, rt + ord AS b, intensity, spectrum * 10 + ord AS ord FROM {CANDIDATES}), l AS (SELECT consensus, string_agg(s, ';' ORDER BY o) AS samples FROM (SELECT consensus, s, min(ord) AS o FROM r GROUP BY ALL) GROUP BY 1)
        SELECT consensus, round(avg(final_score), 6) AS mz, round(avg(rt), 6) AS rt, min(a) AS rt_min, max(b) AS rt_max, count(DISTINCT s) AS n_samples, round(sum(intensity), 3) AS intensity, any_value(samples) AS samples FROM r JOIN l USING (consensus) GROUP BY consensus""",
    "qc_members": f"""
        WITH r AS (SELECT partkey % 700 AS feature, concat('s', suppkey % 12) AS sample, CASE WHEN suppkey % 12 < 5 THEN 'QC' ELSE 'Sample' END AS kind, max(intensity) AS intensity FROM {CANDIDATES} GROUP BY ALL)
        SELECT * FROM r QUALIFY count(*) FILTER (kind = 'QC' AND intensity > 0) OVER (PARTITION BY feature) >= 5 * 0.8""",
    "carbon_curves": f"""
        WITH m AS (SELECT compound_class, 30 + partkey % 9 AS carbon, median(rt) AS r FROM {CANDIDATES} GROUP BY ALL)
        SELECT compound_class, count(*) AS n_carbons, round(regr_slope(r, carbon), 8) AS slope, round(regr_intercept(r, carbon), 8) AS intercept FROM m GROUP BY 1""",
    "scan_counts": "SELECT user_id, count(*) FILTER (event_type = 'view') AS ms1_scans, count(*) FILTER (event_type = 'purchase') AS ms2_scans FROM events GROUP BY 1",
}
ALL = (
    feature_links, apex_links, cohort_links, orphan_rescue, supported_orphans, ion_relations, best_spectra, legacy_alignment, precursor_refinement, eic_traces, eic_apex, nearest_scans, mass_fallback, alignment_ids,
    detector_tables, annotation_summaries, orphan_summaries, linked_lists, candidate_texts, vote_selection, relation_evidence, consensus_features, qc_members, carbon_curves, scan_counts,
)
