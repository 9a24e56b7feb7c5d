"""Queries on feature detection and time alignment, with their DuckDB counterparts; grown traces are tested against a plain loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import detection, refinement
from spectralake.session import table


def trace_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Masses by part with some ppm of spread by quantity, months as scans, turnover as intensity."""
    rows = table(spark, d, "lineitem")
    return rows.select((F.col("l_suppkey") % 2).alias("file"), F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 60).alias("scan"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("rt"), F.round(300 + F.col("l_partkey") % 400 * 0.05 + F.col("l_quantity") * 5e-5, 6).alias("mz"), F.col("l_extendedprice").alias("intensity"))


def grown_traces(spark: SparkSession, d: str) -> DataFrame:
    out = detection.mass_traces(trace_peaks(spark, d), ppm=10.0, noise=2000.0, snr=5.0)
    return out.groupBy("file", "trace").agg(F.count("*").alias("n_points"), F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity"), 5).alias("mz"), F.round(F.max("intensity"), 2).alias("height"))


def map_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Features, points, scans and the features of a more sensitive pass: the grown traces, on a clock of one scan a minute."""
    points = trace_peaks(spark, d).withColumn("rt", F.col("scan") * 60.0)

    def found(noise: float) -> DataFrame:
        top = F.max_by(F.struct("rt", "mz"), F.struct("intensity", -F.col("rt"), "mz"))
        out = detection.mass_traces(points, ppm=20.0, noise=noise, snr=5.0).groupBy("file", "trace").agg(top.alias("p"), F.min("rt").alias("lower"), F.max("rt").alias("upper"), F.round(F.sum("intensity"), 2).alias("area"))
        return out.select("file", F.col("trace").alias("feature"), "p.mz", "p.rt", "lower", "upper", "area")

    return found(8000.0), points, points.select("file", "rt").distinct(), found(2000.0)


def refined_features(spark: SparkSession, d: str) -> DataFrame:
    features, points, scans, more = map_parts(spark, d)
    out = refinement.refined_map(features, points, scans, 20.0, more)
    return out.withColumns({c: F.round(c, 3) for c in ("area", "area_corrected", "height")})


def isotope_features(spark: SparkSession, d: str) -> DataFrame:
    rt = (F.col("p_partkey") % 50).cast("double")
    rows = table(spark, d, "part").select((F.col("p_size") % 3).alias("file"), "p_partkey", F.col("p_retailprice").alias("mz"), rt.alias("rt"), (rt - F.col("p_size") % 7).alias("rt_min"), (rt + F.col("p_size") % 5).alias("rt_max"), (F.col("p_size") * 100 + F.col("p_partkey") % 97).cast("double").alias("height"))
    return detection.isotopes(rows, "p_partkey", 60.0, 8.0).select("file", F.col("key").alias("p_partkey"), "feature", "charge", "place")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_orderkey") % 5
    true = F.col("l_partkey") * 7 % 700 + F.col("l_linenumber") * 0.1
    return table(spark, d, "lineitem").select(s.alias("sample"), (300 + F.col("l_partkey") % 2000 * 0.25).alias("mz"), F.round((true - s * 6) / (1 + s * 0.02), 6).alias("rt"), (2000 - F.col("l_partkey") % 2000 + F.col("l_orderkey") * 1e-7).alias("intensity"))


def time_maps(spark: SparkSession, d: str) -> DataFrame:
    out = detection.poses(_samples(spark, d), "sample", F.col("sample") == 0, most=800)
    return out.select("sample", F.round("scale", 5).alias("scale"), F.round("shift", 3).alias("shift"), "votes")


SQL = {
    "isotope_features": """
        WITH RECURSIVE r AS (SELECT p_size % 3 AS file, p_partkey AS k, p_retailprice AS m, (p_partkey % 50)::DOUBLE AS t, p_partkey % 50 - p_size % 7 AS a, p_partkey % 50 + p_size % 5 AS b, p_size * 100 + p_partkey % 97 AS h FROM part),
        j AS (SELECT c.k AS child, p.k AS parent, z, p.h AS h, abs(p.t - c.t) AS dt FROM r p, range(1, 3) s(z), r c WHERE c.file = p.file AND c.m BETWEEN (p.m + 1.00335483507::DOUBLE / z) - (p.m + 1.00335483507::DOUBLE / z) * 60.0::DOUBLE * 1e-6 AND (p.m + 1.00335483507::DOUBLE / z) + (p.m + 1.00335483507::DOUBLE / z) * 60.0::DOUBLE * 1e-6
            AND abs(p.t - c.t) <= 8 AND p.a <= c.b AND c.a <= p.b AND c.h <= p.h),
        l AS (SELECT child, parent, z FROM j QUALIFY row_number() OVER (PARTITION BY child ORDER BY z DESC, h DESC, dt, parent) = 1),
        w AS (SELECT k, k AS f, NULL::BIGINT AS z, 0 AS place FROM r UNION ALL SELECT w.k, l.parent, l.z, place + 1 FROM w JOIN l ON l.child = w.f WHERE place < 5 AND (w.z IS NULL OR w.z = l.z))
        SELECT r.file, k AS p_partkey, arg_max(f, place) AS feature, coalesce(max(z), 0)::INT AS charge, max(place)::INT AS place FROM w JOIN r USING (k) GROUP BY r.file, k""",
    "time_maps": """
        WITH f AS (SELECT l_orderkey % 5 AS s, 300 + l_partkey % 2000 * 0.25::DOUBLE AS mz, round((l_partkey * 7 % 700 + l_linenumber * 0.1::DOUBLE - l_orderkey % 5 * 6) / (1 + l_orderkey % 5 * 0.02::DOUBLE), 6) AS rt, 2000 - l_partkey % 2000 + l_orderkey * 1e-7::DOUBLE AS i FROM lineitem),
        a AS (SELECT s, mz, rt FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY i DESC, mz, rt) <= 800),
        mid AS (SELECT avg(rt) AS mid FROM a WHERE s = 0),
        m AS (SELECT o.s, o.mz, o.rt, r.mz AS r_mz, r.rt AS r_rt FROM a o JOIN a r ON r.s = 0 AND r.mz BETWEEN o.mz - o.mz * 10.0::DOUBLE * 1e-6 AND o.mz + o.mz * 10.0::DOUBLE * 1e-6 AND abs(o.rt - r.rt) <= 60 WHERE o.s <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rt, r_rt, mz, r_mz) AS k FROM m),
        p AS (SELECT x.s, x.rt, x.r_rt, (y.r_rt - x.r_rt) / (y.rt - x.rt) AS c FROM n x JOIN n y ON y.s = x.s AND y.k BETWEEN x.k + 1 AND x.k + 10 WHERE y.rt - x.rt > 2 AND y.r_rt > x.r_rt),
        v AS (SELECT s, c, r_rt + c * (mid - rt) - mid AS d, mid FROM p, mid WHERE c BETWEEN 0.5 AND 2.0),
        h AS (SELECT s, round(c / 0.01::DOUBLE)::BIGINT AS a, round(d / 2.0::DOUBLE)::BIGINT AS b, count(*) AS votes, avg(c) AS c, avg(d) AS d, any_value(mid) AS mid FROM v GROUP BY 1, 2, 3)
        SELECT s AS sample, round(c, 5) AS scale, round(d + mid - c * mid, 3) AS shift, votes FROM h QUALIFY row_number() OVER (PARTITION BY s ORDER BY votes DESC, abs(a * 0.01::DOUBLE - 1), abs(b), a, b) = 1""",
}
ALL = (grown_traces, refined_features, isotope_features, time_maps)
