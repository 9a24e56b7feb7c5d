"""Queries on the spectrum search, with DuckDB counterparts for its steps; the whole search is tested against a plain loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions import rulebook
from spectralake.operators import search
from spectralake.plans.bases import CANDIDATES, candidates
from spectralake.session import dealt, table

PROGRAM = [[(0b1011, 2), (0b110000, 1)], [(0b111111, 5)]]


def _struct(**c):
    return F.struct(*[v.alias(k) for k, v in c.items()])


def spectrum_preparation(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).groupBy("spectrum").agg(F.collect_list(_struct(mz=F.col("final_score"), intensity=F.when(F.col("spectrum") % 50 > 0, F.col("intensity")).otherwise(0.0))).alias("p"))
    out = rows.select("spectrum", search.prepared(F.col("p"), 0.3).alias("p"))
    return out.select("spectrum", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a * 0.5 + x["relative"] * x["mz"]), 6).alias("fold"))


def _matching(spark: SparkSession, d: str) -> DataFrame:
    fragments = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: _struct(mz=(200 + (F.col("p_partkey") * i) % 7 * 0.01).cast("double")))
    peaks = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: _struct(mz=(199.995 + j * 0.01 + F.col("p_size") * 0.0001).cast("double"), relative=((F.col("p_partkey") * j) % 4 / 4).cast("double")))
    return table(spark, d, "part").select("p_partkey", fragments.alias("f"), peaks.alias("p"))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d).select("p_partkey", F.array_join(search.greedy(F.col("f"), F.col("p"), 60.0), ",").alias("assigned"))


def quality_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).groupBy("spectrum").agg(F.array_sort(F.collect_list(_struct(mz=F.col("final_score"), intensity=F.col("intensity"), relative=F.col("intensity") / 200_000))).alias("p"))
    levels = search.beyond_precursor(F.col("p"), F.lit(50.0))
    return rows.select("spectrum", F.round(F.aggregate(levels, F.lit(0.0), lambda a, x: a + x), 8).alias("total"), F.round(F.array_max(levels), 8).alias("most"))


def pool_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select("spectrum", F.expr("CASE suppkey % 4 WHEN 0 THEN 'fah' WHEN 1 THEN 'hg' ELSE 'other' END").alias("pool"), F.when(F.col("partkey") % 3 > 0, F.col("relative_intensity") * 5).alias("level"))
    out = search.pool_totals(rows, ["spectrum"])
    return out.select("spectrum", *[F.round(f"{p}_score", 6).alias(f"{p}_score") for p in ("fah", "hg", "other")], "total_score")


def precursor_only_scores(spark: SparkSession, d: str) -> DataFrame:
    mz = F.col("p_retailprice")
    peaks = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: _struct(mz=mz + (j - 2) * 0.004 * F.when(F.col("p_size") % 6 == 0, 9).otherwise(1), relative=((F.col("p_partkey") * j) % 9 / 9).cast("double")))
    rows = table(spark, d, "part").select("p_partkey", mz.alias("record_mz"), (mz * (1 + (F.col("p_partkey") % 13 - 6) * 1e-6)).alias("precursor_mz"), mz.alias("ion_mz"), peaks.alias("peaks"))
    out = search.precursor_only(rows, 5.0, 10.0)
    return out.select("p_partkey", F.round("ppm_error", 4).alias("ppm_error"), "reason", "score", "passed")


def evidence_bits(spark: SparkSession, d: str) -> DataFrame:
    bits = candidates(spark, d).groupBy("spectrum").agg(F.bit_or(F.expr("shiftleft(1L, CAST(suppkey % 6 AS INT))")).alias("mask"))
    return bits.select("spectrum", "mask", search.evidence_program(F.col("mask"), PROGRAM).alias("admitted"))


def spectra_of(spark: SparkSession, d: str) -> DataFrame:
    """Spectra whose peaks are those of a library record, some missing, with noise."""
    k = F.col("c_custkey") % 900
    peak = lambda i: (150 + (k * 7 + i * 13) % 400 + i * 0.05).cast("double")
    real = F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.when((F.col("c_custkey") + i) % 5 > 0, _struct(mz=peak(i), intensity=(100 + (F.col("c_custkey") * i) % 900).cast("double")))), lambda p: p.isNotNull())
    noise = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: _struct(mz=100 + i * 9.7 + F.col("c_custkey") % 3 * 0.2, intensity=(F.col("c_custkey") * i % 40 + 1).cast("double")))
    rows = dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.lit("c"), "c_custkey").alias("spectrum"), (700 + k * 0.1 + 0.0005).alias("precursor_mz"), F.concat(real, noise).alias("p"))
    return rows.select("spectrum", "precursor_mz", F.transform("p", lambda p: p["mz"]).alias("mz"), F.transform("p", lambda p: p["intensity"]).alias("intensity"))


def library_of(spark: SparkSession, d: str) -> DataFrame:
    """Records of one class each; some masses are shared by several records that differ in chains."""
    k = F.col("p_partkey") % 900
    a, b = (14 + F.col("p_partkey") % 5).cast("int"), (16 + F.col("p_partkey") % 3).cast("int")
    left, right = F.concat(a, F.lit(":0")), F.concat(b, F.lit(":1"))
    kind = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'PE' WHEN 1 THEN 'PC' WHEN 2 THEN 'TG' WHEN 3 THEN 'FA' WHEN 4 THEN 'Cer' ELSE 'SM' END")
    def at(i):
        pool = F.when(i <= 2, "hg").when(i <= 6, "fah").otherwise("other")
        chain = F.when((i > 2) & (i <= 6), F.when(i % 2 == 0, left).otherwise(right)).otherwise("")
        return _struct(mz=(150 + (k * 7 + i * 13) % 400 + i * 0.05 + F.when((i == 6) & (F.col("p_partkey") >= 900), 0.5).otherwise(0.0)).cast("double"), name=F.concat(F.lit("f"), i.cast("string")), type=F.when(i == 9, "Precursor Ion").when(pool == "hg", "Diagnostic_HG").when(pool == "fah", "Diagnostic_FA").otherwise("Common"), chain=chain)
    return dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select(
        F.col("p_partkey").alias("record_id"), kind.alias("compound_class"), F.concat(kind, F.lit("("), a + b, F.lit(":1)")).alias("lipid_name"), F.concat(kind, F.lit("("), left, F.lit("/"), right, F.lit(")")).alias("chain_name"),
        F.when(F.col("p_partkey") % 6 == 4, "[M-H]-").otherwise("[M+H]+").alias("adduct"), (700 + k * 0.1).alias("precursor_mz"), F.array(left, right).alias("chains"), F.transform(F.sequence(F.lit(1), F.lit(9)), at).alias("fragments"),
    )


def spectrum_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(spectra_of(spark, d), library_of(spark, d), least=20.0)


def record_classes(spark: SparkSession, d: str) -> DataFrame:
    return search.equivalence_classes(library_of(spark, d)).select("record_id", "first_record", "n_records")


def ruled_library(spark: SparkSession, d: str) -> DataFrame:
    """The library with sphingolipids whose fragments bear the names and types that the rulebook asks for, some of them missing."""
    rows = library_of(spark, d).withColumn("_k", F.col("record_id") % 4)
    kind = F.expr("CASE _k WHEN 0 THEN 'Cer' WHEN 1 THEN 'SM' WHEN 2 THEN 'HexCer' ELSE compound_class END")
    adduct = F.expr("CASE _k WHEN 0 THEN '[M-H]-' WHEN 1 THEN '[M+H]+' WHEN 2 THEN '[M-H]-' ELSE adduct END")
    kinds = {0: ["C类碎片", "Precursor Ion", "LCB碎片", "LCB碎片", "FA类碎片", "NAE碎片"], 1: ["Diagnostic_HG", "C类碎片", "LCB碎片", "LCB碎片", "Common", "Common"], 2: ["Diagnostic_HG", "Diagnostic_HG", "LCB碎片", "LCB碎片", "Diagnostic_FA", "Diagnostic_FA"]}
    names = {0: ["a", "b", "c", "d", "e", "f"], 1: ["[C5H15NO4P]+", "M+H-H2O", "LCB-H2O", "LCB-2H2O", "x", "y"], 2: ["h1", "h2", "l1", "l2", "r1", "r2"]}

    def renamed(f, i):
        out = f
        for k in kinds:
            at = lambda values, k=k: F.get(F.array(*[F.lit(v) for v in values[k]]), i.cast("int"))
            out = F.when((F.col("_k") == k) & (i < 6), f.withField("type", at(kinds)).withField("name", at(names))).otherwise(out)
        return out

    return rows.withColumns({"compound_class": kind, "adduct": adduct, "chain_name": F.concat(kind, F.lit("(d"), F.element_at("chains", 1), F.lit("/"), F.element_at("chains", 2), F.lit(")")), "fragments": F.transform("fragments", renamed)}).drop("_k")


def ruled_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(spectra_of(spark, d), ruled_library(spark, d), least=20.0, rules=rulebook.rulebook(spark))


SQL = {
    "spectrum_preparation": f"""
        WITH r AS (SELECT spectrum, final_score AS mz, CASE WHEN spectrum % 50 > 0 THEN intensity ELSE 0 END AS i FROM {CANDIDATES}), t AS (SELECT *, max(i) OVER (PARTITION BY spectrum) AS top FROM r),
        n AS (SELECT *, count(*) OVER (PARTITION BY spectrum) - row_number() OVER (PARTITION BY spectrum ORDER BY mz, i) AS behind FROM t WHERE top > 0 AND i / top >= 0.3), g AS (SELECT spectrum, count(*) AS n, sum(i / top * mz * 0.5::DOUBLE ** behind) AS f FROM n GROUP BY 1)
        SELECT spectrum, coalesce(n, 0)::BIGINT AS n, round(coalesce(f, 0), 6) AS fold FROM (SELECT DISTINCT spectrum FROM r) LEFT JOIN g USING (spectrum)""",
    "greedy_match": """
        WITH RECURSIVE a AS (SELECT p_partkey, [200 + (p_partkey * i) % 7 * 0.01::DOUBLE for i in range(1, 6)] AS f, [{'m': 199.995::DOUBLE + j * 0.01::DOUBLE + p_size * 0.0001::DOUBLE, 'r': (p_partkey * j) % 4 / 4.0::DOUBLE} for j in range(1, 7)] AS p FROM part),
        r AS (SELECT p_partkey, f, p, 0 AS k, []::BIGINT[] AS used FROM a UNION ALL
            SELECT p_partkey, f, p, k + 1, list_append(used, coalesce((SELECT j FROM range(1, 7) t(j) WHERE abs(p[j].m - f[k + 1]) <= f[k + 1] * 60.0::DOUBLE * 1e-6 AND NOT list_contains(used, j) ORDER BY p[j].r DESC, j LIMIT 1), 0)) FROM r WHERE k < 5)
        SELECT p_partkey, array_to_string(used, ',') AS assigned FROM r WHERE k = 5""",
    "quality_levels": f"""
        WITH r AS (SELECT spectrum, final_score AS mz, intensity AS i, intensity / 200000 AS rel, max(intensity) FILTER (abs(final_score - 50) > 4.1) OVER (PARTITION BY spectrum) AS base FROM {CANDIDATES}),
        l AS (SELECT spectrum, CASE WHEN abs(mz - 50) > 4.1 AND base > 0 THEN greatest(rel, least(i / base, 1)) ELSE rel END AS x FROM r)
        SELECT spectrum, round(sum(x), 8) AS total, round(max(x), 8) AS most FROM l GROUP BY 1""",
    "pool_scores": f"""
        WITH r AS (SELECT spectrum, CASE suppkey % 4 WHEN 0 THEN 'fah' WHEN 1 THEN 'hg' ELSE 'other' END AS pool, CASE WHEN partkey % 3 > 0 THEN relative_intensity * 5 END AS level FROM {CANDIDATES}),
        g AS (SELECT spectrum, pool, count(*) AS n, count(level) AS m, greatest(0, least(1, coalesce(max(level), 0))) AS x FROM r GROUP BY 1, 2), h AS (SELECT *, max(CASE WHEN pool = 'fah' THEN 1 ELSE 0 END) OVER (PARTITION BY spectrum) AS f, max(CASE WHEN pool = 'hg' THEN 1 ELSE 0 END) OVER (PARTITION BY spectrum) AS h FROM g),
        w AS (SELECT *, CASE pool WHEN 'fah' THEN 60 WHEN 'hg' THEN CASE WHEN f = 1 THEN 20 ELSE 60 END ELSE 20 END::DOUBLE AS w, CASE WHEN pool = 'fah' OR (pool = 'hg' AND f = 0) THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END AS half FROM h),
        s AS (SELECT spectrum, pool, w / sum(w) OVER (PARTITION BY spectrum) * 100 * CASE WHEN pool = 'other' THEN least(1, m / least(n, 3)) WHEN x > 0 THEN least(1, (1 + half) * x / (x + half)) ELSE 0 END AS v FROM w)
        SELECT spectrum, round(coalesce(sum(v) FILTER (pool = 'fah'), 0), 6) AS fah_score, round(coalesce(sum(v) FILTER (pool = 'hg'), 0), 6) AS hg_score, round(coalesce(sum(v) FILTER (pool = 'other'), 0), 6) AS other_score, round(greatest(0, least(100, sum(v))), 4) AS total_score FROM s GROUP BY 1""",
    "precursor_only_scores": """
        WITH r AS (SELECT p_partkey, p_retailprice AS m, ((p_retailprice * (1 + (p_partkey % 13 - 6) * 1e-6)) - p_retailprice) / p_retailprice * 1e6 AS ppm, CASE WHEN p_size % 6 = 0 THEN 9 ELSE 1 END AS z FROM part),
        b AS (SELECT *, (SELECT max((p_partkey * j) % 9 / 9.0::DOUBLE) FROM range(1, 5) t(j) WHERE abs(m + (j - 2) * 0.004::DOUBLE * z - m) <= m * 10.0::DOUBLE * 1e-6) AS best FROM r),
        c AS (SELECT *, CASE WHEN abs(ppm) > 5 THEN 'precursor_out_of_tolerance' WHEN best IS NULL THEN 'no_fragment_match' ELSE '' END AS reason FROM b)
        SELECT p_partkey, round(ppm, 4) AS ppm_error, reason, CASE WHEN reason = '' THEN round(100 * least(1, 1.1::DOUBLE * best / (best + 0.1::DOUBLE)), 4) ELSE 0 END::DOUBLE AS score, reason = '' AS passed FROM c""",
    "record_classes": """
        WITH r AS (SELECT p_partkey AS record_id, p_partkey % 6 AS kind, 30 + p_partkey % 5 + p_partkey % 3 AS species, [150 + (p_partkey % 900 * 7 + i * 13) % 400 + i * 0.05::DOUBLE for i in [1, 2, 7, 8, 9]] AS masses FROM part),
        c AS (SELECT kind, species, masses, min(record_id) AS first_record, count(*) AS n FROM r WHERE kind <> 3 GROUP BY 1, 2, 3)
        SELECT record_id, coalesce(first_record, record_id) AS first_record, coalesce(n, 1)::BIGINT AS n_records FROM r LEFT JOIN c USING (kind, species, masses)""",
    "evidence_bits": f"""
        WITH b AS (SELECT spectrum, bit_or((1 << (suppkey % 6)::INT)::BIGINT) AS mask FROM {CANDIDATES} GROUP BY 1)
        SELECT spectrum, mask, (bit_count(mask & 11) >= 2 AND bit_count(mask & 48) >= 1) OR bit_count(mask & 63) >= 5 AS admitted FROM b""",
}
ALL = (spectrum_preparation, greedy_match, quality_levels, pool_scores, precursor_only_scores, evidence_bits, record_classes, spectrum_search, ruled_search)
