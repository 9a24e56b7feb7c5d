"""Queries on the rulebook, derived evidence programs and routed fragments, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions import rulebook
from spectralake.operators import programs, routing, rules
from spectralake.session import table

# Records of the query: classes with a rule each, and fragments whose names and types take turns.
KEYS = ("SM_[M+H]+", "Cer_[M-H]-", "HexCer_[M-H]-", "AHexCer_[M+CH3COO]-", "SPB_[M+H]+", "GM1_[M+2NH4]2+", "SM_[M+Na]+", "none")
NAMES = ("M+H-H2O", "LCB-2H2O", "LCB-C2H7NO x", "Reference-HG-366.1400", "M+H-NH3", "LCB-H2O", "[M+H]+", "LCB-3H2O")
TYPES = ("Diagnostic_HG", "LCB碎片", "Diagnostic_FA_Loss", "C类碎片", "FA类碎片", "Precursor Ion", "Diagnostic_FA", "Neutral_Loss")


def _pick(values: tuple[str, ...], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size") % 6 + 3
    fragment = lambda i: F.struct(_pick(NAMES, i + k).alias("name"), F.array(_pick(TYPES, i + F.floor(k / 8))).alias("types"))
    ids = F.sequence(F.lit(0), (n - 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", _pick(KEYS, F.floor(k / 3)).alias("rule"), F.when(k % 3 == 0, "d18:1").when(k % 3 == 1, "t18:0").otherwise("m").alias("series"), F.transform(ids, fragment).alias("lib"), F.filter(ids, lambda i: (k * 7 + i * i * 3 + F.col("p_size")) % 5 > 0).alias("hit"))
    return rows


def derived_programs(spark: SparkSession, d: str) -> DataFrame:
    out = programs.compiled(_records(spark, d), rulebook.rulebook(spark), "rule", "series", "lib", F.lit(False))
    return out.select("p_partkey", F.size("program").alias("branches"), programs.admits(F.col("program"), programs.matched_bits(F.col("hit"))).alias("admitted"))


def rulebook_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).withColumn("hits", F.transform("hit", lambda i: F.get("lib", i)))
    out = rules.passes(rows, rulebook.rulebook(spark), "rule", "series", "lib", "hits", F.lit(False))
    return out.select("p_partkey", "name_gate", "type_gate")


ROUTED = (("PG", "[M-H]-"), ("PE", "[M+H]+"), ("TG-O", "[M+NH4]+"), ("SPB", "[M+H]+"), ("Cer", "[M-H]-"), ("PS", "[M+H]+"), ("LPC", "[M+H]+"), ("OxPE", "[M-H]-"), ("MG", "[M+H]+"), ("SM", "[M+H]+"))
ROUTED_TYPES = ("Diagnostic_HG", "Diagnostic_FA", "Diagnostic_FA_Loss", "FA_Frag", "Common", "Neutral_Loss", "LCB碎片", "FA类碎片", "C类碎片", "Precursor Ion", "Candidate_HG")
ROUTED_NAMES = ("x", "RCO(16:0)", "[M-C3H8NO6P+H]+", "[M-R=O-C3H8O6NP+H]+(16:0)", "M-H2O", "M-C3H6O2", "SPB-Diagnostic-1", "[M-H2O+H]+")


def routed_fragments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    fragment = lambda i: F.struct(F.when((k + i) % 5 == 0, 152.9933).otherwise(100.5).alias("mz"), _pick(ROUTED_NAMES, F.floor(k / 11) + i).alias("name"), _pick(ROUTED_TYPES, k + i).alias("type"), F.array().cast("array<string>").alias("also"))
    pair = F.floor(k / 5)
    records = table(spark, d, "part").select("p_partkey", _pick(tuple(c for c, _ in ROUTED), pair).alias("compound_class"), _pick(tuple(a for _, a in ROUTED), pair).alias("adduct"), F.lit("").alias("chain_name"), F.lit(700.0).alias("precursor_mz"), F.transform(F.sequence(F.lit(0), F.lit(2)), fragment).alias("fragments"))
    out = routing.routed(records).select("p_partkey", F.posexplode(F.arrays_zip("fragments", "routes")).alias("place", "z"))
    return out.select("p_partkey", "place", F.array_join("z.routes.pools", "+").alias("pools"), F.col("z.routes.hg").alias("hg"), F.col("z.routes.loss").alias("loss"), F.col("z.routes.acyl_loss").alias("acyl_loss"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_HIT = f"""
    WITH p AS (SELECT p_partkey AS k, {_list(KEYS)}[(p_partkey // 3) % 8 + 1] AS rule, CASE p_partkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 't' ELSE 'm' END AS s, p_size, p_size % 6 + 3 AS n FROM part),
    f AS (SELECT k, rule, s, {_list(NAMES)}[(i + k) % 8 + 1] AS name, {_list(TYPES)}[(i + k // 8) % 8 + 1] AS type, (k * 7 + i * i * 3 + p_size) % 5 > 0 AS hit FROM p, unnest(range(0, n)) t(i)),
    g AS (SELECT k, any_value(rule) AS rule, any_value(s) AS s, list(DISTINCT name) FILTER (hit) AS names, count(*) FILTER (hit AND type = 'Diagnostic_HG') AS hg, count(*) FILTER (type = 'Diagnostic_HG') AS lib_hg, count(*) FILTER (hit AND type = 'LCB碎片') AS lcb, count(*) FILTER (type = 'LCB碎片') AS lib_lcb,
        count(*) FILTER (hit AND type = 'Diagnostic_FA') AS fa, count(*) FILTER (type = 'Diagnostic_FA') AS lib_fa, count(*) FILTER (hit AND type IN ('Diagnostic_FA', 'Diagnostic_FA_Loss')) AS any_fa, count(*) FILTER (type IN ('Diagnostic_FA', 'Diagnostic_FA_Loss')) AS lib_any_fa, count(*) FILTER (hit AND type = 'C类碎片') AS c, count(*) FILTER (type = 'C类碎片') AS lib_c,
        count(*) FILTER (hit AND type IN ('Precursor Ion', 'C类碎片')) AS pc, count(*) FILTER (hit AND type = 'FA类碎片') AS acyl, count(*) FILTER (hit AND type IN ('Precursor Ion', 'C类碎片', 'Neutral_Loss', 'Diagnostic_HG')) AS sm, count(*) FILTER (hit AND name LIKE '%LCB-C2H7NO%') AS low, count(*) FILTER (name LIKE '%LCB-C2H7NO%') AS lib_low FROM f GROUP BY k),
    h AS (SELECT *, coalesce(names, []) AS ns FROM g),
    r AS (SELECT k, rule, CASE rule WHEN 'SM_[M+H]+' THEN list_has_any(ns, ['[M+H]+', 'M+H-H2O']) AND CASE s WHEN 'd' THEN list_has_any(ns, ['LCB-H2O', 'LCB-2H2O']) WHEN 't' THEN list_has_any(ns, ['LCB-2H2O', 'LCB-3H2O']) ELSE true END
            WHEN 'SPB_[M+H]+' THEN list_has_any(ns, ['M+H-H2O', 'M+H-NH3']) WHEN 'GM1_[M+2NH4]2+' THEN list_contains(ns, 'Reference-HG-366.1400') AND (s <> 'd' OR list_has_any(ns, ['LCB-H2O', 'LCB-2H2O'])) WHEN 'none' THEN NULL ELSE true END AS by_name,
        CASE rule WHEN 'SM_[M+H]+' THEN sm > 0 AND lcb > 0 WHEN 'Cer_[M-H]-' THEN pc >= 2 AND (lcb >= 2 OR acyl >= 2)
            WHEN 'HexCer_[M-H]-' THEN least(lib_hg, lib_fa, lib_lcb) > 0 AND hg >= greatest(1, ceil(lib_hg / 2)) AND fa >= greatest(1, ceil(lib_fa / 2)) AND lcb >= greatest(1, ceil(lib_lcb / 2))
            WHEN 'AHexCer_[M+CH3COO]-' THEN least(lib_any_fa, lib_hg, lib_low) > 0 AND any_fa >= greatest(1, ceil(lib_any_fa / 2)) AND hg >= greatest(1, ceil(lib_hg / 2)) AND low >= greatest(1, ceil(lib_low / 2))
            WHEN 'SPB_[M+H]+' THEN c >= 2 WHEN 'SM_[M+Na]+' THEN hg >= 2 WHEN 'GM1_[M+2NH4]2+' THEN (lib_hg = 0 OR hg > 0) AND (lib_c = 0 OR c > 0) AND (lib_lcb = 0 OR lcb > 0) END AS by_type FROM h)"""
_ROUTED = f"""
    WITH f AS (SELECT p_partkey, i AS place, {_list(tuple(c for c, _ in ROUTED))}[(p_partkey // 5) % 10 + 1] AS c, {_list(tuple(a for _, a in ROUTED))}[(p_partkey // 5) % 10 + 1] LIKE '%+' AS pos,
        (p_partkey + i) % 5 = 0 AS heavy, {_list(ROUTED_NAMES)}[(p_partkey // 11 + i) % 8 + 1] AS n, {_list(ROUTED_TYPES)}[(p_partkey + i) % 11 + 1] AS t FROM part, unnest(range(0, 3)) x(i)),
    r AS (SELECT *, t IN ('Common', 'Candidate_HG') AND c = 'PG' AND heavy AS mass FROM f),
    g AS (SELECT *, bool_or(t = 'Diagnostic_HG' OR mass) OVER w AS has, bool_or(t = 'Candidate_HG') OVER w AS cand FROM r WINDOW w AS (PARTITION BY p_partkey)),
    h AS (SELECT *, CASE WHEN c = 'PS' THEN n = '[M-C3H8NO6P+H]+' WHEN c = 'MG' THEN n = '[M-H2O+H]+' WHEN t = 'Diagnostic_HG' OR mass THEN true WHEN has THEN false WHEN t = 'Candidate_HG' THEN true ELSE t = 'Precursor Ion' AND cand END AS hg, starts_with(n, '[M-R=O-') AND t = 'Diagnostic_FA_Loss' AS ketene FROM g)
    SELECT p_partkey, place::INTEGER AS place, CASE WHEN c = 'LPC' THEN CASE WHEN hg THEN 'hg' ELSE 'other' END WHEN c = 'OxPE' AND n = 'M-H2O' THEN 'other' WHEN c = 'PS' THEN CASE WHEN hg THEN 'hg' WHEN ketene THEN 'fah' ELSE 'other' END
        WHEN c = 'TG-O' AND ((t = 'FA_Frag' AND starts_with(n, 'RCO(')) OR (t = 'Diagnostic_FA_Loss' AND n = 'M-C3H6O2')) THEN 'other' WHEN t = 'Diagnostic_FA_Loss' AND c IN ('PG', 'OxPE') THEN 'other' WHEN t IN ('Diagnostic_FA', 'Diagnostic_FA_Loss') THEN 'fah'
        WHEN t = 'FA_Frag' AND c = 'PE' THEN 'fah' WHEN c = 'SPB' AND t = 'C类碎片' THEN 'fah' WHEN c = 'SPB' AND n = 'SPB-Diagnostic-1' THEN 'other' WHEN c = 'Cer' AND t IN ('LCB碎片', 'FA类碎片', 'NAE碎片') THEN 'fah' WHEN t = 'LCB碎片' THEN 'fah' WHEN hg THEN 'hg' ELSE 'other' END AS pools, hg,
        CASE WHEN c = 'PS' THEN ketene WHEN c = 'TG-O' AND t = 'Diagnostic_FA_Loss' AND n = 'M-C3H6O2' THEN false ELSE t IN ('Neutral_Loss', 'Diagnostic_FA_Loss') OR (t = 'FA_Frag' AND c = 'PE') END AS loss,
        CASE WHEN c = 'PS' THEN ketene WHEN c = 'TG-O' AND t = 'Diagnostic_FA_Loss' AND n = 'M-C3H6O2' THEN false ELSE t = 'Diagnostic_FA_Loss' OR (t = 'FA_Frag' AND c = 'PE') END AS acyl_loss FROM h"""
SQL = {
    "rulebook_gates": f"{_HIT} SELECT k AS p_partkey, by_name AS name_gate, by_type AS type_gate FROM r",
    "routed_fragments": _ROUTED,
}
# Branches: one, or two where a choice has two that the library allows, none where a gate can't be met.
SQL["derived_programs"] = f"""{_HIT},
    can AS (SELECT k, list(DISTINCT name) AS ns, count(*) FILTER (type = 'Diagnostic_HG') AS hg, count(*) FILTER (type = 'LCB碎片') AS lcb, count(*) FILTER (type = 'Diagnostic_FA') AS fa, count(*) FILTER (type IN ('Diagnostic_FA', 'Diagnostic_FA_Loss')) AS any_fa, count(*) FILTER (type = 'C类碎片') AS c,
        count(*) FILTER (type IN ('Precursor Ion', 'C类碎片')) AS pc, count(*) FILTER (type = 'FA类碎片') AS acyl, count(*) FILTER (type IN ('Precursor Ion', 'C类碎片', 'Neutral_Loss', 'Diagnostic_HG')) AS sm, count(*) FILTER (name LIKE '%LCB-C2H7NO%') AS low FROM f GROUP BY k)
    SELECT r.k AS p_partkey, CASE r.rule WHEN 'none' THEN NULL
        WHEN 'SM_[M+H]+' THEN (list_has_any(can.ns, ['[M+H]+', 'M+H-H2O']) AND sm > 0 AND lcb > 0 AND CASE r.k % 3 WHEN 0 THEN list_has_any(can.ns, ['LCB-H2O', 'LCB-2H2O']) WHEN 1 THEN list_has_any(can.ns, ['LCB-2H2O', 'LCB-3H2O']) ELSE true END)::INT
        WHEN 'Cer_[M-H]-' THEN CASE WHEN pc >= 2 THEN (lcb >= 2)::INT + (acyl >= 2)::INT ELSE 0 END WHEN 'HexCer_[M-H]-' THEN (least(hg, fa, lcb) > 0)::INT WHEN 'AHexCer_[M+CH3COO]-' THEN (least(any_fa, hg, low) > 0)::INT
        WHEN 'SPB_[M+H]+' THEN (c >= 2 AND list_has_any(can.ns, ['M+H-H2O', 'M+H-NH3']))::INT WHEN 'SM_[M+Na]+' THEN (hg >= 2)::INT
        ELSE (list_contains(can.ns, 'Reference-HG-366.1400') AND (r.k % 3 <> 0 OR list_has_any(can.ns, ['LCB-H2O', 'LCB-2H2O'])))::INT END AS branches,
    coalesce(by_name AND by_type, true) AS admitted FROM r JOIN can USING (k)"""
ALL = (derived_programs, rulebook_gates, routed_fragments)
