"""Queries on equivalent candidates, audited rows and constructed ceramides, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions import ceramides, sphingo_names
from spectralake.operators import lookups
from spectralake.plans.bases import CANDIDATES, candidates
from spectralake.session import table


def equivalent_candidates(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda i: F.struct(F.when((F.col("suppkey") + i) % 3 == 0, -1).otherwise(i).alias("hit"), F.lit(1).alias("role"), (F.col("partkey") % 13 > 0).alias("eligible"))
    rows = candidates(spark, d).withColumns({"hits": F.array(*[hit(i) for i in range(4)]), "o": F.struct("ord", "partkey", "suppkey"), "group": F.when(F.col("partkey") % 8 < 5, F.col("partkey") % 2)})
    return lookups.equivalents(rows, ["spectrum"], "group", "hits", "o", F.col("ppm_error")).select("spectrum", "ord", "partkey")


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumns({"scope": F.when(F.col("compound_class") == "FA", "fa").when(F.col("compound_class") == "NAE", "nae").otherwise("main"), "rank": F.col("ord") % 3})
    marked = lookups.anchored(rows, "partkey", "source_file", "scope", "rank", "final_score", "spectrum")
    wanted = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("partkey"))
    return lookups.audited(marked, wanted, "partkey", True, ["partkey", "source_file", "scope", "rank", "final_score"])


def ceramide_masses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 9 == 0, "HexCer d").when(k % 2 == 0, "Cer d").otherwise("Cerd"), 16 + k % 4, F.lit(":"), k % 3, F.lit("/"), 24 + k % 7, F.lit(":0(O-"), 16 + F.col("p_size") % 5, F.lit(":"), F.col("p_size") % 3, F.lit(")"))
    adduct = F.when(k % 5 == 0, "[M+H]+").when(k % 5 == 1, "[M-H]-").when(k % 5 == 2, "[M+HCOO]-").when(k % 5 == 3, "[M+CH3COO]-").otherwise("[M+Na]+")
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"), adduct.alias("adduct"))
    n, a = F.col("name"), F.col("adduct")
    return rows.select("p_partkey", ceramides.formula(n).alias("formula"), F.round(ceramides.precursor(n, a), 6).alias("mz"), F.round(ceramides.outer_loss(n, a), 6).alias("outer_loss"))


# spelling, class given with it, the name it stands for and whether that tells all chains; @ and # are chains
NAMES = (
    ("AHexCer (O-@)18:1;2O/#;O", "AHexCer", "AHexCer d18:1(O-@)/#(OH)", True), ("AHexCer(@/18:0;3O/#;2O)", "", "AHexCer t18:0(O-@)/#(2OH)", True), ("AHexCer(@/34:1;2O)", "AHexCer", "AHexCer 34:1;2O(O-@)", False),
    ("Cer d18:1/@(O-#)", "Cer", "Cerd18:1/@(O-#)", True), ("HexCer(d18:1/@)(OH)", "HexCer", "HexCer(d18:1/h@)", False), ("PI-Cer+O(@;2O/#;O)", "PI-Cer+O", "PI-Cer+O(m@/#;2O)", False),
    (" SHexCer(@/t18:0)", "", "SHexCer(t18:0/@)", True), ("SHexCer+O(@)(OH/d18:1)", "SHexCer+O", "SHexCer+O(d18:1/h@)", True), ("SL(@/#;O)", "SL", "SL(m#/@)", True), ("SL+O(@;O/#;O)", "SL+O", "SL+O(m@/h#)", True),
    ("ASM d@/#", "ASM", "ASM d@(O-#)", False), ("asm @;2O(FA #)", "ASM", "ASM d@(O-#)", False), ("ASM(d18:1/16:0-O-@)", "ASM", "ASM d34:1(O-@)", False), ("ASM(d18:1/@)", "ASM", "ASM d18:1/@", False),
    ("NAPE(18:1_16:0-N-@)", "NAPE", "NAPE(16:0_18:1-N-@)", False), ("naps(@-N-18:1_16:0)", "NAPS", "NAPS(16:0_18:1-N-@)", False), ("LCE-PE(0:0/@)", "LCE-PE", "LCE-PE(@)", False), ("PC(@/#)", "PC", "PC(@/#)", False),
)


def _filled(field: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n[field]}'" for i, n in enumerate(NAMES))
    return f"replace(replace(CASE p_partkey % {len(NAMES)} {cases} END, '@', concat(20 + p_size % 4, ':', p_size % 3)), '#', concat(14 + p_size % 5, ':0'))"


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_filled(0)} AS name", f"{_filled(1)} AS kind")
    n, k = F.col("name"), F.col("kind")
    return rows.select("p_partkey", sphingo_names.canonical(n, k).alias("name"), sphingo_names.complete(n, k).alias("complete"))


SQL = {
    "canonical_names": f"""
        SELECT p_partkey, {_filled(2)} AS name, p_partkey % {len(NAMES)} IN ({", ".join(str(i) for i, n in enumerate(NAMES) if n[3])}) AS complete FROM part""",
    "equivalent_candidates": f"""
        WITH c AS (SELECT *, CASE WHEN partkey % 8 < 5 AND (partkey % 13 > 0) THEN concat(partkey % 2, ':', suppkey % 3) END AS s FROM {CANDIDATES}),
        r AS (SELECT *, row_number() OVER (PARTITION BY spectrum, s ORDER BY ord, partkey, suppkey) AS f, row_number() OVER (PARTITION BY spectrum, s ORDER BY abs(ppm_error), ord, partkey, suppkey) AS n FROM c)
        SELECT spectrum, ord, partkey FROM r WHERE s IS NULL OR f = 1 OR n = 1""",
    "audit_rows": f"""
        WITH c AS (SELECT *, CASE compound_class WHEN 'FA' THEN 'fa' WHEN 'NAE' THEN 'nae' ELSE 'main' END AS scope, ord % 3 AS rank FROM {CANDIDATES}),
        r AS (SELECT *, row_number() OVER (PARTITION BY partkey, source_file ORDER BY CASE scope WHEN 'main' THEN 0 WHEN 'fa' THEN 1 ELSE 2 END, rank, final_score DESC, spectrum) AS n FROM c)
        SELECT partkey, source_file, scope, rank, final_score FROM r WHERE n = 1 AND partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)""",
    "ceramide_masses": """
        WITH r AS (SELECT p_partkey, p_partkey % 9 > 0 AS "is", p_partkey % 5 AS a, 40 + p_partkey % 4 + p_partkey % 7 + 16 + p_size % 5 AS c, p_partkey % 3 + p_size % 3 AS db, 16 + p_size % 5 AS oc, p_size % 3 AS od FROM part),
        m AS (SELECT *, c * 12 + (2 * c - 1 - 2 * db) * 1.00782503223 + 14.00307400443 + 5 * 15.99491461957 AS mass, oc * 12 + (2 * oc - 2 * od) * 1.00782503223 + 2 * 15.99491461957 AS acid FROM r)
        SELECT p_partkey, CASE WHEN "is" THEN concat('C', c, 'H', 2 * c - 1 - 2 * db, 'NO5') END AS formula,
        CASE WHEN "is" THEN round((mass + CASE a WHEN 0 THEN 1.007276466621 WHEN 1 THEN -1.007276466621 WHEN 2 THEN 12 + 2 * 1.00782503223 + 2 * 15.99491461957 - 1.007276466621 WHEN 3 THEN 24 + 4 * 1.00782503223 + 2 * 15.99491461957 - 1.007276466621 END)::DOUBLE, 6) END AS mz,
        CASE WHEN "is" THEN round(CASE WHEN a = 0 THEN mass + 1.007276466621 - 2 * 1.00782503223 - 15.99491461957 - acid WHEN a < 4 THEN mass - 1.007276466621 - acid END::DOUBLE, 6) END AS outer_loss FROM m""",
}
ALL = (equivalent_candidates, audit_rows, ceramide_masses, canonical_names)
