"""Queries on names and masses, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions import masses, names
from spectralake.session import table

# chains a:b and c:d made from part keys
_PARTS = "p_partkey, p_brand, p_size, p_retailprice, p_partkey % 10 AS k, 12 + p_partkey % 11 AS a, p_partkey % 4 AS b, 14 + p_partkey % 9 AS c, p_partkey % 3 AS d"
_FORMS = """CASE k
    WHEN 0 THEN concat('PC(', a, ':', b, '/', c, ':', d, ')')
    WHEN 1 THEN concat('TG  ', a, ':', b, '_', c, ':', d, '_16:0')
    WHEN 2 THEN concat('PE(O-', a, ':', b, '/', c, ':', d, ')')
    WHEN 3 THEN concat('Cer(', 'd18:1/', c, ':', d, ')')
    WHEN 4 THEN concat('LPC(', a, ':', b, ')')
    WHEN 5 THEN concat('SM d18:1/', c, ':', d)
    WHEN 6 THEN concat('LPE(O-', a, ':', b + 1, ')/LPE(P-', a, ':', b, ')')
    WHEN 7 THEN concat('TG-EST 16:0_', a, ':', b, '_', c, ':', d, ';O(FA 18:1)')
    WHEN 8 THEN concat('ASM d34:2(O-', c, ':', d, ')')
    ELSE 'Sterol' END"""
_ROWS = f"(SELECT *, {_FORMS} AS name FROM (SELECT {_PARTS} FROM part))"


def _named(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(*_PARTS.split(", "))
    return rows.withColumn("name", F.expr(_FORMS))


def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    return names.with_parsed(_named(spark, d), F.col("name"), F.col("p_brand"), "p").select("p_partkey", "name", "p.*")


def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d).withColumn("formula", F.when(F.col("b") == 0, F.lit("")).otherwise(F.concat(F.lit("C"), F.col("a"), F.lit("H30O2"))))
    s, t = (f(F.col("name"), F.col("p_brand"), F.col("formula")) for f in (names.sum_candidate, names.total_name))
    return rows.select("p_partkey", s["name"].alias("sum_name"), s["resolution"].alias("sum_resolution"), t["name"].alias("total_name"), t["resolution"].alias("total_resolution"), names.with_oxygen(F.col("formula")).alias("oxidised"))


def chain_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d)
    oxygen = F.expr("CASE k WHEN 0 THEN '(2O)' WHEN 1 THEN ',O' WHEN 2 THEN ';O3' WHEN 3 THEN ';(2OH)' WHEN 4 THEN '(O)' ELSE '' END")
    label = F.when(F.col("k") == 9, "water").otherwise(F.concat(F.lit("loss of P-"), F.col("a"), F.lit(":"), F.col("b"), oxygen))
    level = F.when(F.col("p_partkey") % 7 == 0, "species_level").otherwise("chain_level")
    kind = F.substring_index(F.substring_index("name", " ", 1), "(", 1)
    return rows.select(
        "p_partkey", F.array_join(names.chain_tokens(F.col("name")), ";").alias("tokens"), names.fragment_chain(label).alias("fragment_chain"), names.class_key(kind).alias("class_key"),
        names.canonical_chains(F.col("name"), kind).alias("canonical"), names.reported(F.lit("sum"), F.col("name"), kind, level).alias("reported"),
    )


def adduct_signs(spark: SparkSession, d: str) -> DataFrame:
    forms = "element_at(array('[M+H]+', '[M+2H]2+', '[M-H]-', '[M-2H]2-', '[M+Na]+', 'M'), p_partkey % 6 + 1)"
    rows = _named(spark, d).withColumn("adduct", F.expr(forms.replace("p_partkey % 6", "CAST(p_partkey % 6 AS INT)")))
    recorded = F.when(F.col("p_size") > 25, "+").otherwise("-")
    neutral = F.coalesce(masses.neutral_mass(F.col("p_retailprice"), F.col("adduct"), "positive"), masses.neutral_mass(F.col("p_retailprice"), F.col("adduct"), "negative"))
    return rows.select("p_partkey", names.charge(F.col("adduct")).cast("long").alias("charge"), names.polarity(F.col("adduct"), recorded).alias("polarity"), F.round(neutral, 6).alias("neutral_mass"))


def mass_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d)
    mz, ref = F.col("p_retailprice"), F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.round(F.col("p_retailprice")))
    da = F.when(F.col("k") < 3, F.lit(0.02))
    ppm = F.when(F.col("k") < 7, F.lit(15.0))
    total = F.col("p_size")
    return rows.select(
        "p_partkey", F.round(masses.ppm_error(mz, ref), 6).alias("ppm_error"), F.round(masses.window(mz, da, ppm), 8).alias("window"), F.round(masses.window(mz, None, ppm, 10.0), 8).alias("window_ppm"),
        F.round(masses.fatty_acid(F.col("a"), F.col("b"), F.col("d") + 2), 6).alias("fatty_acid"), F.round(masses.fatty_acid_anion(F.col("a"), F.col("b")), 6).alias("anion"), F.round(masses.acylium(F.col("a"), F.col("b")), 6).alias("acylium"),
        F.round(masses.rt_delta_seconds(mz, F.when(F.col("k") > 1, ref)), 6).alias("rt_delta"), masses.fractional_hits(total, 0.3, 4).cast("long").alias("hits"), masses.half_hits(total - 25).cast("long").alias("half"), masses.half_hits(total, 3).cast("long").alias("fixed"),
    )


_SORTED = "CASE WHEN a < c OR (a = c AND b <= d) THEN concat(a, ':', b, '{s}', c, ':', d) ELSE concat(c, ':', d, '{s}', a, ':', b) END"
SQL = {
    "parsed_names": f"""
        SELECT p_partkey, name, CASE k
            WHEN 0 THEN concat('PC(', {_SORTED.format(s="/")}, ')')
            WHEN 1 THEN concat('TG ', (SELECT string_agg(concat(x.c, ':', x.d), '_' ORDER BY x.c, x.d) FROM (SELECT unnest([{{'c': a, 'd': b}}, {{'c': c, 'd': d}}, {{'c': 16, 'd': 0}}]) AS x)))
            WHEN 2 THEN concat('PE(', CASE WHEN a < c OR (a = c AND b < d) THEN concat('O-', a, ':', b, '/', c, ':', d) ELSE concat(c, ':', d, '/O-', a, ':', b) END, ')')
            ELSE name END AS lipidname_norm,
        (CASE k WHEN 0 THEN a + c WHEN 1 THEN a + c + 16 WHEN 2 THEN a + c WHEN 3 THEN 18 + c WHEN 4 THEN a WHEN 5 THEN 18 + c WHEN 6 THEN a WHEN 7 THEN 34 + a + c WHEN 8 THEN 34 + c END)::BIGINT AS total_c,
        (CASE k WHEN 0 THEN b + d WHEN 1 THEN b + d WHEN 2 THEN b + d WHEN 3 THEN 1 + d WHEN 4 THEN b WHEN 5 THEN 1 + d WHEN 6 THEN b + 1 WHEN 7 THEN 1 + b + d WHEN 8 THEN 2 + d END)::BIGINT AS total_db,
        CASE k WHEN 0 THEN 'PC' WHEN 1 THEN 'TG' WHEN 2 THEN 'PE' WHEN 3 THEN 'Cer' WHEN 4 THEN 'LPC' WHEN 5 THEN 'SM' WHEN 6 THEN 'LPE-O' WHEN 7 THEN 'TG-EST' WHEN 8 THEN 'ASM' ELSE p_brand END AS subclass
        FROM {_ROWS}""",
    "candidate_names": f"""
        WITH r AS (SELECT *, CASE WHEN b = 0 THEN '' ELSE concat('C', a, 'H30O2') END AS formula FROM {_ROWS}),
        s AS (SELECT *, CASE k WHEN 0 THEN concat('PC(', a + c, ':', b + d, ')') WHEN 2 THEN concat('PE(O-', a + c, ':', b + d, ')') WHEN 3 THEN concat('Cer(', 18 + c, ':', 1 + d, ')') WHEN 4 THEN concat('LPC(', a, ':', b, ')') WHEN 8 THEN name END AS summed FROM r),
        t AS (SELECT *, CASE WHEN k = 7 THEN name END AS total FROM s)
        SELECT p_partkey, coalesce(summed, trim(concat(p_brand, ' ', formula))) AS sum_name, CASE WHEN summed IS NOT NULL THEN 'sum_composition' WHEN formula <> '' THEN 'class_formula' ELSE 'class_only' END AS sum_resolution,
        coalesce(total, summed, trim(concat(p_brand, ' ', formula))) AS total_name, CASE WHEN total IS NOT NULL OR summed IS NOT NULL THEN 'sum_composition' WHEN formula <> '' THEN 'class_formula' ELSE 'class_only' END AS total_resolution,
        CASE WHEN formula = '' THEN '' ELSE concat('C', a, 'H30O3') END AS oxidised FROM t""",
    "chain_names": f"""
        SELECT p_partkey, CASE k
            WHEN 0 THEN concat(a, ':', b, ';', c, ':', d) WHEN 1 THEN concat(a, ':', b, ';', c, ':', d, ';16:0') WHEN 2 THEN concat('O-', a, ':', b, ';', c, ':', d) WHEN 3 THEN concat('d18:1;', c, ':', d)
            WHEN 4 THEN concat(a, ':', b) WHEN 5 THEN concat('d18:1;', c, ':', d) WHEN 6 THEN concat('O-', a, ':', b + 1, ';P-', a, ':', b) WHEN 7 THEN concat('16:0;', a, ':', b, ';', c, ':', d, ';O;18:1')
            WHEN 8 THEN concat('d34:2;O-', c, ':', d) ELSE '' END AS tokens,
        CASE WHEN k < 9 THEN concat('P-', a, ':', b, CASE k WHEN 0 THEN ';O2' WHEN 1 THEN ';O1' WHEN 2 THEN ';O3' WHEN 3 THEN ';2OH' WHEN 4 THEN ';O1' ELSE '' END) END AS fragment_chain,
        CASE k WHEN 0 THEN 'PC' WHEN 1 THEN 'TG' WHEN 2 THEN 'PE' WHEN 3 THEN 'CER' WHEN 4 THEN 'LPC' WHEN 5 THEN 'SM' WHEN 6 THEN 'LPE' WHEN 7 THEN 'TGEST' WHEN 8 THEN 'ASM' ELSE 'STEROL' END AS class_key,
        CASE WHEN k = 0 THEN concat('PC(', least(concat(a, ':', b), concat(c, ':', d)), '/', greatest(concat(a, ':', b), concat(c, ':', d)), ')')
             WHEN k = 6 THEN concat('LPE(', concat('O-', a, ':', b + 1, ')'), '/', concat('LPE(P-', a, ':', b), ')') ELSE name END AS canonical,
        CASE WHEN k = 4 THEN concat('LPC(', a, ':', b, ')') WHEN p_partkey % 7 = 0 THEN 'sum'
             WHEN k = 0 THEN concat('PC(', least(concat(a, ':', b), concat(c, ':', d)), '/', greatest(concat(a, ':', b), concat(c, ':', d)), ')') WHEN k = 6 THEN name ELSE name END AS reported FROM {_ROWS}""",
    "adduct_signs": f"""
        SELECT p_partkey, ([1, 2, -1, -2, 1, NULL])[p_partkey % 6 + 1]::BIGINT AS charge, CASE p_partkey % 6 WHEN 0 THEN '+' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '-' WHEN 4 THEN '+' ELSE CASE WHEN p_size > 25 THEN '+' ELSE '-' END END AS polarity,
        CASE p_partkey % 6 WHEN 0 THEN round(p_retailprice - 1.007276466621, 6) WHEN 2 THEN round(p_retailprice + 1.007276466621, 6) WHEN 4 THEN round(p_retailprice - 22.989220702, 6) END AS neutral_mass FROM {_ROWS}""",
    "mass_functions": f"""
        WITH r AS (SELECT *, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE round(p_retailprice) END AS ref FROM {_ROWS})
        SELECT p_partkey, CASE WHEN ref <> 0 THEN round((p_retailprice - ref) / ref * 1e6, 6) END AS ppm_error,
        round(CASE WHEN k < 3 THEN 0.02 WHEN k < 7 THEN p_retailprice * 15.0 * 1e-6 ELSE 0.01 END, 8)::DOUBLE AS "window", round(CASE WHEN k < 7 THEN p_retailprice * 15.0 * 1e-6 ELSE p_retailprice * 10.0 * 1e-6 END, 8) AS window_ppm,
        round(a * 12.0::DOUBLE + (2 * a - 2 * b) * 1.00782503223::DOUBLE + (d + 2) * 15.99491462::DOUBLE, 6) AS fatty_acid, round(a * 12.0::DOUBLE + (2 * a - 2 * b) * 1.00782503223::DOUBLE + 2 * 15.99491462::DOUBLE - 1.007276466621::DOUBLE, 6) AS anion,
        round(a * 12.0::DOUBLE + (2 * a - 2 * b - 1) * 1.00782503223::DOUBLE + 15.99491462::DOUBLE, 6) AS acylium, round(CASE WHEN k > 1 THEN abs(p_retailprice - ref) * 60 ELSE 0 END, 6) AS rt_delta,
        least(p_size, greatest(4, ceil(p_size * 0.3)))::BIGINT AS hits, (CASE WHEN p_size <= 25 THEN 0 ELSE least(p_size - 25, greatest(1, ceil((p_size - 25) / 2.0))) END)::BIGINT AS half, least(p_size, 3)::BIGINT AS fixed FROM r""",
}
ALL = (parsed_names, candidate_names, chain_names, adduct_signs, mass_functions)
