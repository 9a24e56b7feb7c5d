"""Queries on table imports and library scans over rows shaped like them, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import annotate
from spectralake.operators.filters import allowed
from spectralake.functions import labels, names
from spectralake.plans.bases import CANDIDATES, candidates, first_candidates
from spectralake.session import table
from spectralake.sources import library, tables


def _text(c):
    return c.cast("string")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("_ord"), _text(F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice"))).alias("M/Z"), _text(F.when(F.col("p_size") % 3 > 0, F.col("p_partkey") % 600)).alias("rtmed"), _text(F.col("p_partkey") % 600 - 3).alias("RT left(min)"),
        _text(F.col("p_partkey") % 600 + 5).alias("rtmax"),
    )
    out = tables.work_table(rows)
    return out.select("_ord", "feature_id", "mz", *[F.round(c, 6).alias(c) for c in ("rt", "rt_min", "rt_max")])


def renumbered_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('F', p_size * 13) WHEN 1 THEN concat('FT', p_partkey) WHEN 2 THEN concat('row_', p_size) ELSE 'none' END")
    return tables.renumbered(table(spark, d, "part").select(F.col("p_partkey").alias("_ord"), ids.alias("Feature_ID"))).select("_ord", "Feature_ID")


def xcms_import(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_ord"), _text(F.col("p_retailprice") + F.col("p_size") * 1.713713e-5).alias("mzmed"), _text(F.col("p_size") * 7 + 0.1137).alias("rtmin"), _text(F.col("p_size") * 7 + 10.1371).alias("rtmed"), _text(F.col("p_size") * 7 + 20.1739).alias("rtmax"), _text(F.col("p_size")).alias("npeaks"), _text(F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("a.mzML"))
    return tables.xcms(rows).select(F.col("_ord").alias("row"), "Feature_ID", "mz", "RTmin", "RT", "RTmax", F.col("`a.mzML`").alias("area"))


def openms_import(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_ord"), _text(F.col("p_retailprice") + F.col("p_size") * 1.713713e-5).alias("mz"), _text(F.col("p_partkey") % 900 + 0.5).alias("RT"), _text(F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") % 900).otherwise(1e301)).alias("RTstart"), _text(F.col("p_partkey") % 900 + F.when(F.col("p_size") % 7 > 0, 3).otherwise(-3)).alias("RTend"))
    out = tables.openms(rows)
    return out.select("Feature_ID", "mz", "mzmin", "mzmax", "RT", "RTmin", "RTmax")


def asari_import(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_ord"), F.concat(F.lit("F"), 1_000_000_000_000 - F.col("p_partkey")).alias("id_number"), F.col("p_partkey").alias("key"), _text(F.col("p_size") * 7 + 10.1371).alias("rtime"), _text(F.col("p_size") * 7 + 1.1371).alias("rtime_left_base"))
    return tables.asari(rows).select("key", "Feature_ID", "RT", "RTmin", "RT_unit")


def library_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.expr("CASE p_size % 5 WHEN 0 THEN 'PS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'PC' WHEN 3 THEN 'TG-O' ELSE 'PE' END").alias("compound_class"), F.expr("CASE p_partkey % 3 WHEN 0 THEN '[M+NH4]+' WHEN 1 THEN '[M+H]+' ELSE '[M-H]-' END").alias("adduct"), F.col("p_retailprice").alias("precursor_mz"))
    kept = rows.where(F.col("precursor_mz").between(920 * (1 - 1e-5), 980 * (1 + 1e-5)) & allowed(F.col("compound_class"), F.col("adduct"), ["PS", "LPS", "PC", "TGO"]) & (names.polarity(F.col("adduct")) == "+"))
    return kept


def library_catalogue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_type").alias("compound_class"), F.col("p_brand").alias("adduct"), "p_name")
    return library.catalogue(rows)


def derived_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where("p_partkey % 3 > 0").select((F.col("p_partkey") % 1500).alias("k"), F.col("p_partkey").alias("v"))
    more = table(spark, d, "part").where("p_partkey % 3 = 0").select((F.col("p_partkey") % 1500).alias("k"), (-F.col("p_partkey")).alias("v"))
    return library.with_derived(rows, more, ["k"])


def series_input(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select("spectrum", "ord", "matched_name", "compound_class", F.when(F.col("ord") % 3 > 0, F.col("ord")).alias("rank"), _text(F.when(F.col("partkey") % 7 > 0, F.col("final_score"))).alias("score"), F.when(F.col("suppkey") % 5 > 0, F.col("source_file")).alias("sample"), (F.col("rt") * 60).alias("rt_sec"))
    out = annotate.series_input(rows, "matched_name", "compound_class", "rt_sec", "rank", "score", "sample")
    return out.select("spectrum", "ord", "lipidname_norm", "total_c", "total_db", "subclass", F.round("rt_minutes", 6).alias("rt_minutes"), "rank", "score", "sample")


def final_features(spark: SparkSession, d: str) -> DataFrame:
    """A table of features with one area column for each sample: the aligned one, else the feature's own of its sample."""
    rows = first_candidates(spark, d).select("spectrum", F.when(F.col("spectrum") % 3 > 0, F.lit("A")).alias("aligned"), F.col("source_file"), F.lit(1.0).alias("x"), F.when(F.col("spectrum") % 2 == 0, F.col("spectrum") * 1.0).alias("s0.mzML"), F.when(F.col("spectrum") % 5 == 0, F.col("spectrum") * 2.0).alias("s1.mzML"))
    return annotate.measured_areas(rows.drop("x").withColumn("own_area", F.col("spectrum") * 3.0), ["s0.mzML", "s1.mzML"]).select("spectrum", F.col("`s0.mzML`").alias("s0"), F.col("`s1.mzML`").alias("s1"))


def mass_attachments(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 3 == 0).alias("identified"), F.lit("x").alias("compound_class"))
    matches = table(spark, d, "part").select((F.col("p_partkey") % 130).alias("key"), F.col("p_partkey").alias("ms1_rank"), F.col("p_name").alias("candidate_name"), F.col("p_type").alias("candidate_class"))
    first = matches.groupBy("key").agg(F.min("ms1_rank").alias("_r"))
    ranked = matches.join(first, "key").withColumn("ms1_rank", F.when(F.col("ms1_rank") == F.col("_r"), 1).otherwise(2)).drop("_r")
    return annotate.attach_masses(features, ranked).select("key", "ms1_candidate_name", "ms1_candidate_count", "compound_class", "confidence")


def grouped_view(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("Feature_ID"), F.col("s_acctbal").alias("mz"), F.lit(1.0).alias("RT"), F.col("s_nationkey").alias("peak_area"))
    out = tables.view(rows, "peak_area")
    return out.select("Feature_ID", "mz", F.col("PeakArea").alias("area"), labels.group_label(F.lit("1"), F.when(F.col("Feature_ID") % 2 == 0, "QC").otherwise("Sample")).alias("label"))


_M = "(p_retailprice + p_size * 1.713713e-5::DOUBLE)"
SQL = {
    "feature_table": """
        WITH r AS (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS mz, CASE WHEN p_size % 3 > 0 THEN p_partkey % 600 END AS rt, p_partkey % 600 - 3 AS a, p_partkey % 600 + 5 AS b, row_number() OVER (ORDER BY p_partkey) AS i FROM part)
        SELECT p_partkey AS _ord, concat('F', i) AS feature_id, mz, round(coalesce(rt / 60.0::DOUBLE, (a / 60.0::DOUBLE + b / 60.0::DOUBLE) / 2), 6) AS rt, round(a / 60.0::DOUBLE, 6) AS rt_min, round(b / 60.0::DOUBLE, 6) AS rt_max FROM r WHERE mz IS NOT NULL""",
    "renumbered_ids": """
        WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 13 WHEN 1 THEN p_partkey WHEN 2 THEN p_size END AS n FROM part)
        SELECT p_partkey AS _ord, concat('F', row_number() OVER (ORDER BY n NULLS LAST, p_partkey)) AS Feature_ID FROM r""",
    "xcms_import": f"""
        SELECT p_partkey AS row, concat('F', row_number() OVER (ORDER BY p_partkey)) AS Feature_ID, round_even({_M}, 4) AS mz, round_even((p_size * 7 + 0.1137::DOUBLE) / 60, 3) AS RTmin, round_even((p_size * 7 + 10.1371::DOUBLE) / 60, 3) AS RT, round_even((p_size * 7 + 20.1739::DOUBLE) / 60, 3) AS RTmax,
        CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::DOUBLE AS area FROM part""",
    "openms_import": f"""
        WITH r AS (SELECT p_partkey, {_M} AS m, p_partkey % 900 + 0.5::DOUBLE AS rt, p_partkey % 900 AS a, p_partkey % 900 + CASE WHEN p_size % 7 > 0 THEN 3 ELSE -3 END AS b, p_size % 5 > 0 AND p_size % 7 > 0 AS ok FROM part)
        SELECT concat('F', row_number() OVER (ORDER BY p_partkey)) AS Feature_ID, round_even(m, 4) AS mz, round_even(m - m * 10.0::DOUBLE * 1e-6, 4) AS mzmin, round_even(m + m * 10.0::DOUBLE * 1e-6, 4) AS mzmax, round_even(rt / 60, 6) AS RT, CASE WHEN ok THEN round_even(a / 60.0::DOUBLE, 6) END AS RTmin, CASE WHEN ok THEN round_even(b / 60.0::DOUBLE, 6) END AS RTmax FROM r""",
    "asari_import": """
        SELECT p_partkey AS key, concat('F', row_number() OVER (ORDER BY 5000 - p_partkey)) AS Feature_ID, round_even((p_size * 7 + 10.1371::DOUBLE) / 60, 3) AS RT, round_even((p_size * 7 + 1.1371::DOUBLE) / 60, 3) AS RTmin, 'minutes' AS RT_unit FROM part""",
    "library_scan": """
        SELECT p_partkey AS record_id, CASE p_size % 5 WHEN 0 THEN 'PS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'PC' ELSE 'TG-O' END AS compound_class, CASE p_partkey % 3 WHEN 0 THEN '[M+NH4]+' ELSE '[M+H]+' END AS adduct, p_retailprice AS precursor_mz
        FROM part WHERE p_retailprice BETWEEN 920 * (1 - 1e-5) AND 980 * (1 + 1e-5) AND p_partkey % 3 < 2 AND p_size % 5 < 4 AND NOT (p_partkey % 3 = 0 AND p_size % 5 < 2)""",
    "library_catalogue": "SELECT p_type AS compound_class, p_brand AS adduct, count(*) AS n FROM part GROUP BY 1, 2",
    "derived_records": """
        WITH a AS (SELECT p_partkey % 1500 AS k, p_partkey AS v FROM part WHERE p_partkey % 3 > 0)
        SELECT * FROM a UNION ALL SELECT p_partkey % 1500, -p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 1500 NOT IN (SELECT k FROM a)""",
    "series_input": f"""
        SELECT spectrum, ord, matched_name AS lipidname_norm, (30 + partkey % 3)::BIGINT AS total_c, (suppkey % 2)::BIGINT AS total_db, compound_class AS subclass, round(rt, 6) AS rt_minutes, coalesce(CASE WHEN ord % 3 > 0 THEN ord END, 1)::INTEGER AS rank, CASE WHEN partkey % 7 > 0 THEN final_score END AS score,
        CASE WHEN suppkey % 5 > 0 THEN source_file ELSE '' END AS sample FROM {CANDIDATES}""",
    "final_features": f"""
        WITH r AS (SELECT DISTINCT ON (spectrum) spectrum, spectrum % 3 > 0 AS aligned, min(source_file) OVER (PARTITION BY spectrum) AS lo, max(source_file) OVER (PARTITION BY spectrum) AS hi, source_file FROM {CANDIDATES} WHERE ord = 1)
        SELECT spectrum, coalesce(CASE WHEN spectrum % 2 = 0 THEN spectrum * 1.0::DOUBLE END, CASE WHEN NOT aligned AND source_file = 's0.mzML' THEN spectrum * 3.0::DOUBLE END) AS s0, coalesce(CASE WHEN spectrum % 5 = 0 THEN spectrum * 2.0::DOUBLE END, CASE WHEN NOT aligned AND source_file = 's1.mzML' THEN spectrum * 3.0::DOUBLE END) AS s1 FROM r""",
    "mass_attachments": """
        WITH b AS (SELECT p_partkey % 130 AS key, p_name, p_type, count(*) OVER (PARTITION BY p_partkey % 130) AS n FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 130 ORDER BY p_partkey) = 1)
        SELECT s_suppkey AS key, p_name AS ms1_candidate_name, coalesce(n, 0)::BIGINT AS ms1_candidate_count, CASE WHEN s_suppkey % 3 > 0 AND n IS NOT NULL THEN p_type ELSE 'x' END AS compound_class, CASE WHEN s_suppkey % 3 > 0 AND n IS NOT NULL THEN 'no MS2' END AS confidence FROM supplier LEFT JOIN b ON b.key = s_suppkey""",
    "grouped_view": "SELECT s_suppkey AS Feature_ID, s_acctbal AS mz, s_nationkey::DOUBLE AS area, CASE WHEN s_suppkey % 2 = 0 THEN 'QC' ELSE '1' END AS label FROM supplier",
}
ALL = (feature_table, renumbered_ids, xcms_import, openms_import, asari_import, library_scan, library_catalogue, derived_records, series_input, final_features, mass_attachments, grouped_view)
