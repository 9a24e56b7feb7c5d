"""Queries on filters, suppression rules and display decisions, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions import labels
from spectralake.operators import filters
from spectralake.plans.bases import CANDIDATES, candidates
from spectralake.session import table


def admission_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    keep = filters.allowed(F.col("compound_class"), F.col("adduct"), ["PE", "PC", "PS", "TGEST"], ["[M+H]+", "[M+NH4]+", "[M-H]-"])
    charged = filters.charge_compatible(F.when(F.col("partkey") % 4 == 0, F.lit(2)).otherwise(F.col("partkey") % 2), F.when(F.col("suppkey") % 3 == 0, "positive"), F.col("adduct"))
    gate = filters.admitted(F.col("passed"), F.col("downgrade_reason"), F.col("missing"))
    return rows.where(keep & charged & gate & (F.col("final_score") >= 50)).select("spectrum", "ord", "compound_class", "adduct", "final_score")


def overlap_prefilter(spark: SparkSession, d: str) -> DataFrame:
    # parts of a brand are the candidates of a spectrum; fragments and peaks are made from keys
    rows = table(spark, d, "part").select(
        "p_brand", "p_partkey",
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct((100 + (F.col("p_partkey") * i) % 97).cast("double").alias("mz"), F.when(i == 1, "Common").otherwise("FA_Frag").alias("kind"))).alias("fragments"),
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (100 + (F.col("p_size") * i * 7) % 97 + 0.0005 * F.col("p_size")).cast("double")).alias("peaks"),
    )
    kept = filters.overlapping(rows, "p_brand", "fragments", "peaks", 100.0, 8, lambda f: f["kind"] != "Common")
    return kept.select("p_brand", "p_partkey")


def suppressed_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.without_competing_adducts(candidates(spark, d), "spectrum", "compound_class", "adduct", "passed", "resolution_level", "downgrade_reason")
    return filters.without_hg_only(rows, "spectrum", "resolution_level", "downgrade_reason").select("spectrum", "ord")


def isomer_suppression(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("partkey") % 4
    chain = F.when(F.col("suppkey") % 2 == 0, F.concat(F.lit("Cer(d18:1/h"), n + 20, F.lit(":0)"))).otherwise(F.concat(F.lit("Cer(t18:0/"), n + 20, F.lit(":1)")))
    rows = candidates(spark, d).select("spectrum", "ord", F.lit("Cer").alias("compound_class"), F.lit("Cer(38:1;O3)").alias("lipid_name"), chain.alias("chain_name"), F.lit("[M+H]+").alias("adduct"), F.lit(600.5).alias("mz"), (F.col("n_fragments") > 2).alias("marker"))
    return filters.without_isomers(rows, "spectrum", "compound_class", "lipid_name", "chain_name", "adduct", "mz", "marker").select("spectrum", "ord", "chain_name")


def missing_hg_fallback(spark: SparkSession, d: str) -> DataFrame:
    chains = lambda a, b: F.array_distinct(F.array(F.concat(a % 3, F.lit(":0")), F.concat(b % 2, F.lit(":0"))))
    rows = candidates(spark, d).withColumn("passed", F.col("passed") & (F.col("partkey") % 2 == 0)).withColumn("expected", chains(F.col("partkey"), F.col("suppkey")))
    rows = rows.withColumn("matched", F.array(F.lit("0:0"), F.concat(F.col("ord") % 3, F.lit(":0")))).withColumn("loss_count", F.col("n_fragments"))
    return filters.tentative_fallback(rows, "spectrum", "ord").select("spectrum", "ord", "resolution_level", "downgrade_reason")


def action_filter(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("CASE partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'reject' WHEN 2 THEN 'unmodeled' END")
    out = filters.scored_actions(candidates(spark, d).withColumn("said", said), "final_score", "said")
    level = F.expr("CASE ord % 4 WHEN 0 THEN 'Chain-Level' WHEN 1 THEN ' 链水平' WHEN 2 THEN 'chain resolved' ELSE 'species' END")
    return out.select("spectrum", "ord", "RT_filter_action", "RT_consistency_pass", filters.chain_level(level, F.col("support")).alias("chain_level"))


def browsed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumn("mz", 700 + F.col("final_score")).withColumns({"identified": F.col("passed"), "confidence": F.when(F.col("final_score") > 60, "高").when(F.col("final_score") > 20, "低"), "ecn": F.when(F.col("partkey") % 2 == 0, "通过").otherwise("未通过")})
    texts = [F.col("matched_name"), F.col("spectrum").cast("string"), F.format_string("%.4f", F.col("mz"))]
    return filters.browse(rows, True, ["高"], ["通过"], ["PE", "TG", "Cer"], "E(3", texts, (2.0, 25.0, 710.0, 795.0)).select("spectrum", "ord")


def eligible_ions(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumn("height", F.col("intensity"))
    ok = filters.single_ions(F.when(F.col("partkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("final_score")), F.col("rt"), (F.col("suppkey") % 4 - 2), F.col("ord") - 3, F.when(F.col("suppkey") % 7 > 0, F.lit("F")))
    return rows.where(ok & filters.high_enough(F.col("height"), 20000.0)).select("spectrum", "ord")


def included_samples(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/d/s"), "s_suppkey", F.lit(".mzML")).alias("path"), (F.col("s_suppkey") % 3 > 0).alias("included"), (F.col("s_nationkey") % 3).cast("string").alias("grp"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'QC' WHEN 1 THEN 'Blank' ELSE 'Sample' END").alias("kind"))
    return filters.included(s, "path", "included").select("s_suppkey", "path", labels.group_label(F.col("grp"), F.col("kind")).alias("label"))


_PROOF = {
    "status": "CASE WHEN partkey % 4 > 0 THEN 'confirmed' ELSE 'raw' END", "source": "CASE WHEN suppkey % 3 > 0 THEN 'MS1_PRECEDING_CENTROID' ELSE 'MS2' END", "scan": "CASE WHEN partkey % 5 > 0 THEN 'n1' ELSE ' NaN' END",
    "n": "CASE WHEN ord % 4 = 0 THEN 1.5 ELSE 2.0 END", "mz": "800.0 + partkey % 7 * 0.0005", "ms1_mz": "800.0", "ms1_rt": "rt", "ms2_rt": "rt + partkey % 9 * 0.03",
}


def _proved(rows: DataFrame) -> DataFrame:
    for k, v in _PROOF.items():
        rows = rows.withColumn(f"p_{k}", F.expr(v))
    c = lambda k: F.col(f"p_{k}").cast("double") if k in ("n", "mz", "ms1_mz", "ms1_rt", "ms2_rt") else F.col(f"p_{k}")
    return rows.withColumn("proved", labels.confirmed_precursor(c("status"), c("source"), c("scan"), F.lit(None).cast("string"), c("n"), c("mz"), c("ms1_mz"), c("ms1_rt"), c("ms2_rt")))


def identification_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = _proved(candidates(spark, d)).withColumns({"ms1_support_status": F.nullif("support", F.lit("")), "ms1_support_reason": F.lit("no_ms1_feature_for_sample")})
    back = labels.restore_support(rows, F.col("proved"))
    sure = (F.coalesce("ms1_support_status", F.lit("")) == labels.SUPPORTED) | F.col("proved")
    level = F.when(F.col("partkey") % 13 == 0, "暂定链水平").otherwise("链水平")
    c = labels.confidence(F.col("final_score"), sure, F.col("downgrade_reason"), F.col("resolution_level"), level, F.col("passed"))
    return back.select("spectrum", "ord", "proved", "ms1_support_status", "ms1_support_reason", "ms1_feature_link_reason", "ms1_evidence_source", c.alias("confidence"))


def display_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _proved(candidates(spark, d))
    action = F.expr("CASE partkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'suspect' WHEN 2 THEN 'unmodeled' WHEN 3 THEN 'species_rescued' ELSE '' END")
    reason = F.expr("CASE suppkey % 4 WHEN 0 THEN 'no_ms1_feature_for_sample' WHEN 1 THEN 'confirmed_ms1_precursor_without_feature' WHEN 2 THEN 'feature_bounds_match' ELSE 'no_ms1_scans' END")
    link = F.expr("CASE WHEN partkey % 3 = 0 THEN 'no_ms1_feature_within_mz_tolerance' END")
    shown = labels.feature_display(F.col("support"), reason, link, F.col("partkey") % 2, F.col("passed"), [F.when(F.col("ord") % 2 == 0, F.lit("F1"))], [F.when(F.col("ord") % 3 == 0, F.col("rt"))], F.when(F.col("ord") % 4 > 0, F.col("matched_name")), F.lit(None).cast("string"))
    kind = F.expr("CASE partkey % 9 WHEN 0 THEN 'ox-PC' WHEN 1 THEN 'PE-Cer' WHEN 2 THEN 'TG-O' WHEN 3 THEN 'CoQ10' WHEN 4 THEN 'SM' WHEN 5 THEN 'LDGTS' WHEN 6 THEN 'NAE' WHEN 7 THEN 'CE' ELSE 'xyz' END")
    return rows.select(
        "spectrum", "ord", labels.ecn_status(action, F.when(F.col("ord") % 2 == 0, F.lit("True")).when(F.col("ord") % 3 == 0, F.lit("false"))).alias("ecn"), shown.alias("shown"),
        labels.evidence_display(F.col("support"), reason, F.col("proved"), shown).alias("evidence"), labels.family(kind).alias("family"), labels.level_label(F.col("resolution_level"), F.col("passed")).alias("level"),
    )


def exported_results(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    score, rt, mz = F.col("final_score") * 1.013 - 1, F.col("rt") * 1.00037, 700 + F.col("intensity") / 999_983
    name = F.expr("CASE ord % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN matched_name END")
    fragment = F.expr("CASE partkey % 4 WHEN 0 THEN '[M+H-C3H6O2]+' WHEN 1 THEN '[M - C3H7O5P + H]+' WHEN 2 THEN '18:3,O | 18:3;1O' ELSE 'FA 18:1,O2 | x |x' END")
    kind = F.when(F.col("suppkey") % 2 == 0, "LPE-O").otherwise("PC")
    early = labels.precursor_fields(F.col("final_score"), F.col("partkey").cast("double"), F.col("rt") * 60, F.when(F.col("ord") % 2 == 0, F.lit("confirmed")))
    return rows.select(
        "spectrum", "ord", *labels.exported(score, rt, mz, F.col("ppm_error") / 7, F.col("rt") + 0.00049, F.nullif("support", F.lit(""))), F.round(early[0], 4).alias("raw_mz"), F.round(early[2], 6).alias("raw_rt"), F.round(early[3], 4).alias("raw_ppm"),
        labels.annotation_display(name, F.when(F.col("suppkey") % 3 > 0, F.lit("TG 50:1"))).alias("shown"), labels.fragment_name(fragment, kind).alias("fragment"), labels.fragment_label(fragment).alias("label"),
        labels.first_nonempty([F.nullif("downgrade_reason", F.lit("")), F.col("missing"), F.col("support")]).alias("first_text"), labels.first_nonempty([F.when(F.col("ord") > 3, F.lit("x")), F.when(F.col("ord") > 1, F.lit("2.5")), F.lit("7")], True).alias("first_number"),
    )


def feature_numbers(spark: SparkSession, d: str) -> DataFrame:
    ids = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat('F', p_size) WHEN 1 THEN concat('FT', p_size) WHEN 2 THEN concat(p_partkey, '.0') WHEN 3 THEN concat('feat_', p_size) WHEN 4 THEN concat('F', 100000 + p_partkey) ELSE 'none' END")
    rows = table(spark, d, "part").select("p_partkey", ids.alias("feature"), F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("MS2|"), "p_partkey")).otherwise(F.concat(F.lit("A|"), "p_partkey")).alias("key"))
    shown = labels.display_ids(rows, "key", "feature", "p_partkey")
    return shown.select("p_partkey", "display_id", labels.feature_number(F.col("feature")).cast("long").alias("number"))


_SURE = "(coalesce(s, '') = 'MS1-supported' OR proved)"
_P = f"""(SELECT *, CASE WHEN support <> '' THEN support END AS s,
    partkey % 4 > 0 AND suppkey % 3 > 0 AND partkey % 5 > 0 AND ord % 4 <> 0 AND (partkey % 7) * 0.0005 / 800.0 * 1e6 <= 3.0 AND (partkey % 9) * 0.03 * 60 <= 10.0000001 AS proved FROM {CANDIDATES})"""
SQL = {
    "admission_filters": f"""
        SELECT spectrum, ord, compound_class, adduct, final_score FROM {CANDIDATES} WHERE compound_class IN ('PE', 'PC', 'PS', 'TG-EST') AND NOT (compound_class = 'PS' AND adduct = '[M+NH4]+') AND adduct <> '[M+Na]+'
        AND NOT (suppkey % 3 = 0 AND adduct = '[M-H]-') AND partkey % 4 <> 0 AND (passed OR (downgrade_reason = 'insufficient_independent_chain_evidence' AND missing = 'chain_confirmation')) AND final_score >= 50""",
    "overlap_prefilter": """
        WITH r AS (SELECT p_brand, p_partkey, p_size, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT p_brand, p_partkey FROM r WHERE n <= 8 OR EXISTS (SELECT 1 FROM range(2, 5) f(i), range(1, 4) g(j)
            WHERE abs(100 + (p_size * g.j * 7) % 97 + 0.0005 * p_size - (100 + (p_partkey * f.i) % 97))::DOUBLE <= (100 + (p_partkey * f.i) % 97) * 100.0::DOUBLE * 1e-6)""",
    "suppressed_candidates": f"""
        WITH a AS (SELECT *, compound_class = 'PE' AND adduct IN ('[M+H]+', '[M+Na]+') AS pe FROM {CANDIDATES}),
        b AS (SELECT *, bool_or(pe AND passed AND resolution_level = 'chain_level' AND downgrade_reason = '') OVER (PARTITION BY spectrum) AS anyc, bool_or(pe AND passed AND resolution_level = 'chain_level' AND downgrade_reason = '') OVER (PARTITION BY spectrum, adduct) AS own FROM a),
        c AS (SELECT * FROM b WHERE NOT (pe AND anyc AND NOT own AND NOT passed)),
        e AS (SELECT *, bool_or(resolution_level IN ('chain_level', 'tentative_chain_level')) OVER (PARTITION BY spectrum) AS chain FROM c)
        SELECT spectrum, ord FROM e WHERE NOT (chain AND resolution_level = 'tentative_species_level' AND downgrade_reason = 'low_confidence_hg_only')""",
    "isomer_suppression": f"""
        WITH a AS (SELECT spectrum, ord, suppkey % 2 = 0 AS h, partkey % 4 AS k, n_fragments > 2 AS m FROM {CANDIDATES})
        SELECT spectrum, ord, CASE WHEN h THEN concat('Cer(d18:1/h', k + 20, ':0)') ELSE concat('Cer(t18:0/', k + 20, ':1)') END AS chain_name FROM a WHERE NOT CASE
            WHEN h THEN EXISTS (SELECT 1 FROM a b WHERE b.spectrum = a.spectrum AND b.k = a.k AND NOT b.h AND b.m)
            ELSE EXISTS (SELECT 1 FROM a b WHERE b.spectrum = a.spectrum AND b.k = a.k AND b.h) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.spectrum = a.spectrum AND b.k = a.k AND NOT b.h AND b.m) END""",
    "missing_hg_fallback": f"""
        WITH a AS (SELECT *, passed AND partkey % 2 = 0 AS p FROM {CANDIDATES}), b AS (SELECT *, bool_or(p) OVER (PARTITION BY spectrum) AS anyp FROM a)
        SELECT spectrum, ord, 'tentative_chain_level' AS resolution_level, 'tentative_missing_hg_fa_full_loss' AS downgrade_reason FROM b
        WHERE NOT anyp AND compound_class IN ('PC', 'PE', 'PS') AND missing = 'hg' AND partkey % 3 IN (0, ord % 3) AND suppkey % 2 IN (0, ord % 3) AND n_fragments >= 1
        QUALIFY row_number() OVER (PARTITION BY spectrum ORDER BY n_fragments DESC, final_score DESC, intensity DESC, relative_intensity DESC, abs(ppm_error), ord) = 1""",
    "action_filter": f"""
        SELECT spectrum, ord, CASE WHEN final_score < 50 THEN 'score_reject' WHEN partkey % 4 = 0 THEN 'pass' WHEN partkey % 4 = 1 THEN 'reject' ELSE 'retain_unmodeled' END AS RT_filter_action,
        final_score >= 50 AND partkey % 4 <> 1 AS RT_consistency_pass, ord % 4 < 3 AND support <> 'MS2-only' AS chain_level FROM {CANDIDATES}""",
    "browsed_rows": f"""
        SELECT spectrum, ord FROM {CANDIDATES} WHERE passed AND final_score > 60 AND partkey % 2 = 0 AND compound_class IN ('PE', 'TG', 'Cer') AND (lower(matched_name) LIKE '%e(3%') AND rt BETWEEN 2 AND 25 AND 700 + final_score BETWEEN 710 AND 795""",
    "eligible_ions": f"SELECT spectrum, ord FROM {CANDIDATES} WHERE partkey % 11 <> 0 AND suppkey % 4 > 0 AND ord <= 3 AND suppkey % 7 > 0 AND intensity >= 20000",
    "included_samples": "SELECT s_suppkey, concat('/d/s', s_suppkey, '.mzML') AS path, CASE WHEN s_suppkey % 4 < 2 AND s_nationkey % 3 = 1 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'QC' ELSE 'Blank' END ELSE (s_nationkey % 3)::VARCHAR END AS label FROM supplier WHERE s_suppkey % 3 > 0",
    "identification_decisions": f"""
        SELECT spectrum, ord, proved, CASE WHEN proved AND coalesce(s, '') <> 'MS1-supported' THEN 'MS1-supported' ELSE coalesce(s, 'MS2-only') END AS ms1_support_status,
        CASE WHEN proved AND coalesce(s, '') <> 'MS1-supported' THEN 'confirmed_ms1_precursor_without_feature' ELSE 'no_ms1_feature_for_sample' END AS ms1_support_reason,
        CASE WHEN proved AND coalesce(s, '') <> 'MS1-supported' THEN 'no_ms1_feature_for_sample' END AS ms1_feature_link_reason, CASE WHEN proved AND coalesce(s, '') <> 'MS1-supported' THEN 'confirmed_ms1_precursor' END AS ms1_evidence_source,
        CASE WHEN final_score >= 50 AND {_SURE} AND downgrade_reason IN ('', 'low_confidence_hg_only') AND resolution_level NOT LIKE 'tentative%' AND partkey % 13 <> 0 AND passed THEN '高' ELSE '低' END AS confidence FROM {_P}""",
    "display_labels": f"""
        WITH a AS (SELECT *, ord % 2 = 0 AS hasid, ord % 3 = 0 AS timed, ord % 4 > 0 AS named, partkey % 3 = 0 AS nolink, suppkey % 4 AS r FROM {_P}),
        b AS (SELECT *, CASE WHEN partkey % 2 = 1 AND passed THEN 'Linked' WHEN (nolink OR r = 0) AND NOT hasid THEN 'Not detected' WHEN r = 1 AND nolink THEN 'Not detected' WHEN r = 1 THEN 'Unlinked'
            WHEN support = 'MS1-supported' AND NOT named THEN 'Detected' WHEN support = 'MS1-supported' AND NOT hasid AND NOT timed THEN 'Unlinked' WHEN support = 'MS1-supported' THEN 'Linked' WHEN support = 'MS2-only' THEN 'Unlinked' ELSE '—' END AS shown FROM a)
        SELECT spectrum, ord, CASE partkey % 6 WHEN 0 THEN '通过' WHEN 1 THEN '未通过' WHEN 2 THEN '无法判断' WHEN 3 THEN '通过' ELSE CASE WHEN ord % 2 = 0 THEN '通过' WHEN ord % 3 = 0 THEN '未通过' ELSE '无法判断' END END AS ecn, shown,
        CASE WHEN r = 1 OR proved THEN 'Confirmed precursor' WHEN support = 'MS1-supported' THEN CASE WHEN shown = 'Unlinked' THEN 'Supported' ELSE 'Detected feature' END WHEN r = 3 THEN 'Missing' ELSE 'Unconfirmed' END AS evidence,
        (['GP', 'SP', 'GL', 'PR', 'SP', 'GL', 'FA', 'ST', 'Other'])[partkey % 9 + 1] AS family,
        concat(CASE WHEN resolution_level LIKE 'tentative%' OR NOT passed THEN '暂定' ELSE '' END, CASE WHEN resolution_level LIKE '%chain_level' THEN '链水平' ELSE '分子种类水平' END) AS level FROM b""",
    "exported_results": f"""
        SELECT spectrum, ord, round_even(greatest(0, least(100, final_score * 1.013::DOUBLE - 1)), 2) AS final_score, round_even(rt * 1.00037::DOUBLE, 3) AS rt_minutes, round_even(700 + intensity / 999983.0::DOUBLE, 4) AS precursor_mz, round_even(ppm_error / 7, 2) AS ppm_error,
        CASE WHEN support <> 'MS2-only' THEN round_even(rt + 0.00049::DOUBLE, 3) END AS feature_rt, CASE WHEN support = '' THEN '未评估' ELSE support END AS ms1_support_status,
        CASE WHEN ord % 2 = 0 THEN round(final_score, 4) END AS raw_mz, CASE WHEN ord % 2 = 0 THEN round(rt, 6) END AS raw_rt, CASE WHEN ord % 2 = 0 THEN round((final_score - partkey) / nullif(partkey, 0) * 1e6, 4) END AS raw_ppm,
        CASE WHEN ord % 4 = 2 THEN matched_name WHEN suppkey % 3 > 0 THEN 'no MS2: TG 50:1' ELSE 'unknown' END AS shown,
        CASE partkey % 4 WHEN 0 THEN CASE WHEN suppkey % 2 = 0 THEN '[M+H-(甘油-H2O)]+（损失74.0368 Da；C3H6O2）' ELSE '[M+H-C3H6O2]+' END WHEN 1 THEN CASE WHEN suppkey % 2 = 0 THEN '[M+H-(甘油-H2O)-HPO3]+（损失154.0031 Da；C3H7O5P）' ELSE '[M - C3H7O5P + H]+' END
            WHEN 2 THEN '18:3,O | 18:3;1O' ELSE 'FA 18:1,O2 | x |x' END AS fragment,
        CASE partkey % 4 WHEN 0 THEN '[M+H-C3H6O2]+' WHEN 1 THEN '[M - C3H7O5P + H]+' WHEN 2 THEN '18:3(1O)' ELSE 'FA 18:1(2O) | x |x' END AS label,
        CASE WHEN downgrade_reason <> '' THEN downgrade_reason WHEN missing <> '' THEN missing ELSE support END AS first_text, CASE WHEN ord > 1 THEN 2.5 ELSE 7.0 END::DOUBLE AS first_number FROM {CANDIDATES}""",
    "feature_numbers": """
        WITH r AS (SELECT p_partkey, p_size, p_partkey % 50 = 0 AS own, CASE p_partkey % 6 WHEN 0 THEN concat('F', p_size) WHEN 1 THEN concat('FT', p_size) WHEN 2 THEN concat(p_partkey, '.0') WHEN 3 THEN concat('feat_', p_size) WHEN 4 THEN concat('F', 100000 + p_partkey) ELSE 'none' END AS f,
            CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 2 THEN p_partkey WHEN 4 THEN 100000 + p_partkey END AS n FROM part),
        c AS (SELECT *, count(n) OVER (PARTITION BY n) AS c, max(n) OVER () AS top FROM r), o AS (SELECT *, NOT own AND (n IS NULL OR c > 1) AS open FROM c)
        SELECT p_partkey, CASE WHEN own THEN f WHEN NOT open THEN n::VARCHAR ELSE (top + count(*) FILTER (open) OVER (ORDER BY p_partkey))::BIGINT::VARCHAR END AS display_id,
        CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 0 WHEN 3 THEN p_size WHEN 4 THEN 100000 + p_partkey END::BIGINT AS number FROM o""",
}
ALL = (
    admission_filters, overlap_prefilter, suppressed_candidates, isomer_suppression, missing_hg_fallback, action_filter, browsed_rows, eligible_ions, included_samples,
    identification_decisions, display_labels, exported_results, feature_numbers,
)
