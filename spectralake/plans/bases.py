"""Scored candidates and features made from the driver tables, written once for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.session import table


def _pick(values: list[str], number: str) -> str:
    return "CASE " + number + "".join(f" WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def _texts(values: list[str], number: str) -> str:
    return _pick([f"'{v}'" for v in values], number)


#: Line items as candidates: an order is a spectrum, its lines are candidates in their order.
CANDIDATE = {
    "spectrum": "l_orderkey",
    "ord": "l_linenumber",
    "final_score": "CAST(l_quantity * 2 AS DOUBLE)",
    "ppm_error": "CAST(l_partkey % 21 - 10 AS DOUBLE)",
    "n_fragments": "CAST(l_suppkey % 6 AS BIGINT)",
    "compound_class": _texts(["PE", "PC", "TG", "FA", "NAE", "Cer", "TG-EST", "PS"], "l_partkey % 8"),
    "adduct": _texts(["[M+H]+", "[M+Na]+", "[M-H]-", "[M+NH4]+"], "l_suppkey % 4"),
    "matched_name": "concat(" + _texts(["PE", "PC", "TG", "FA", "NAE", "Cer", "TG-EST", "PS"], "l_partkey % 8") + ", '(', 30 + l_partkey % 3, ':', l_suppkey % 2, ')')",
    "resolution_level": _texts(["chain_level", "species_level", "tentative_species_level", "tentative_chain_level", "class_level"], "(l_partkey + l_linenumber) % 5"),
    "passed": "((l_partkey + l_linenumber) % 3 <> 0)",
    "downgrade_reason": _texts(["", "low_confidence_hg_only", "missing_required_hg", "insufficient_independent_chain_evidence", "missing_positive_gate", ""], "(l_partkey + l_suppkey) % 6"),
    "missing": _texts(["", "hg", "chain_confirmation"], "l_suppkey % 3"),
    "support": _texts(["MS1-supported", "MS2-only", ""], "(l_partkey + l_suppkey) % 3"),
    "source_file": "concat('s', l_suppkey % 5, '.mzML')",
    "intensity": "CAST(l_extendedprice AS DOUBLE)",
    "relative_intensity": "CAST(l_discount AS DOUBLE)",
    "rt": "CAST(l_partkey % 300 AS DOUBLE) / 10",
    "partkey": "l_partkey",
    "suppkey": "l_suppkey",
}
CANDIDATES = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in CANDIDATE.items()) + " FROM lineitem)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in CANDIDATE.items()])


def placed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with ``_at``, their place in the table by file and position in it: spectrum and ord repeat, and ties go to the first row."""
    return table(spark, d, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in CANDIDATE.items()], "struct(_metadata.file_path, _metadata.row_index) AS _at")


def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first row in the table, by file and position in it, of each spectrum's candidates with ord 1: some spectra have several."""
    rows = placed_candidates(spark, d).where("ord = 1")
    kept = [k for k in CANDIDATE if k != "spectrum"]
    return rows.groupBy("spectrum").agg(F.min_by(F.struct(*kept), "_at").alias("_f")).select("spectrum", "_f.*")
