"""All queries outside the llm subpackage, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import joins, ranking, summaries
from spectralake.plans import decisions, detection, features, gates, imports, links, lookups, names, ranks, rules, search, series
from spectralake.session import table

KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'QC' WHEN 'MACHINERY' THEN 'Blank' ELSE 'Sample' END"


def mass_candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "supplier").select("s_suppkey", (900 + F.abs("s_acctbal") / 10).alias("mz"))
    library = table(spark, d, "part").select("p_partkey", "p_retailprice")
    found = joins.mass_candidates(features, library, "mz", "p_retailprice", 10)
    return ranking.topk(found, ["s_suppkey"], [F.abs("ppm_error"), F.col("p_partkey")], 10, "n_candidates").select("s_suppkey", "p_partkey", F.round("ppm_error", 6).alias("ppm_error"), "rank", "n_candidates")


def precursor_range_candidates(spark: SparkSession, d: str) -> DataFrame:
    spectra = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("mz"))
    library = table(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey", "p_retailprice")
    return joins.precursor_candidates(spectra, library, "mz", "p_retailprice", 5).select("l_orderkey", "l_linenumber", "p_partkey")


def orphan_anti_supported(spark: SparkSession, d: str) -> DataFrame:
    support = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unsupported(table(spark, d, "orders").select("o_orderkey", "o_custkey"), support, ["o_orderkey"])


def best_row_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber")
    return ranking.best(rows, ["l_partkey", "l_suppkey"], [F.desc("l_extendedprice"), F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.expr(KIND).alias("kind"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(customers, "c_custkey")


def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.quality_summary(_samples(spark, d), ["c_nationkey"], "kind", "o_totalprice")
    return out.select("c_nationkey", "qc_n", *[F.round(c, 4).alias(c) for c in ("qc_mean", "qc_rsd", "blank_mean", "sample_blank_ratio")])


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.group_summary(_samples(spark, d), ["c_nationkey", "kind"], "o_totalprice")
    return out.select("c_nationkey", "kind", "sample_count", "recorded", "detected", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


def upsert_count(spark: SparkSession, d: str) -> DataFrame:
    return summaries.metadata_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"], "l_orderkey")


def trapezoid_area(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return summaries.trapezoid(rows.withColumn("t", F.col("t") / 6e7), ["user_id"], "t", "value", "event_id").select("user_id", F.round("area", 3).alias("area"))


def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    return summaries.consensus(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), "l_partkey", "l_suppkey", "l_returnflag")


def linear_rt_model(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.linear_fit(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2")])


def peak_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return summaries.normalised_peaks(rows, ["l_orderkey"], "l_extendedprice", 0.5).select("l_orderkey", "l_linenumber", F.round("relative", 9).alias("relative"))


_SAMPLES = f"(SELECT c_nationkey, {KIND} AS kind, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey)"
_SQL = {
    "mass_candidates_topk": """
        WITH f AS (SELECT s_suppkey, 900 + abs(s_acctbal) / 10 AS mz FROM supplier),
        j AS (SELECT s_suppkey, p_partkey, (mz - p_retailprice) / p_retailprice * 1e6 AS e FROM f JOIN part ON p_retailprice BETWEEN mz / (1 + 1e-5) AND mz / (1 - 1e-5))
        SELECT s_suppkey, p_partkey, round(e, 6) AS ppm_error, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(e), p_partkey) AS rank, count(*) OVER (PARTITION BY s_suppkey) AS n_candidates FROM j QUALIFY rank <= 10""",
    "precursor_range_candidates": """
        WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS mz FROM lineitem)
        SELECT l_orderkey, l_linenumber, p_partkey FROM s JOIN part ON p_retailprice BETWEEN mz - mz * 5 * 1e-6 AND mz + mz * 5 * 1e-6 WHERE p_brand IN ('Brand#11', 'Brand#12')""",
    "orphan_anti_supported": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "best_row_per_group": """
        SELECT l_partkey, l_suppkey, l_extendedprice, l_discount, l_orderkey, l_linenumber FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_discount, l_orderkey, l_linenumber) = 1""",
    "qc_summary": f"""
        WITH a AS (SELECT c_nationkey, count(v) FILTER (kind = 'QC') AS n, avg(v) FILTER (kind = 'QC') AS m, stddev_samp(v) FILTER (kind = 'QC') AS s, avg(v) FILTER (kind = 'Blank') AS b, avg(v) FILTER (kind = 'Sample') AS x FROM {_SAMPLES} GROUP BY 1)
        SELECT c_nationkey, n AS qc_n, round(m, 4) AS qc_mean, CASE WHEN n >= 2 AND m > 0 THEN round(s / m * 100, 4) END AS qc_rsd, round(b, 4) AS blank_mean, CASE WHEN b > 0 THEN round(x / b, 4) END AS sample_blank_ratio FROM a""",
    "group_summary": f"SELECT c_nationkey, kind, count(*) AS sample_count, count(v) AS recorded, count(*) FILTER (v > 0) AS detected, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM {_SAMPLES} GROUP BY 1, 2",
    "upsert_count": "SELECT l_returnflag, l_linestatus, l_partkey, count(*) AS n, min(l_orderkey) AS first_id FROM lineitem GROUP BY 1, 2, 3",
    "trapezoid_area": """
        WITH a AS (SELECT user_id, event_id, value, epoch_us(ts)::DOUBLE / 6e7 AS t FROM events),
        b AS (SELECT user_id, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS p FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
        SELECT user_id, round(sum(p), 3) AS area FROM b GROUP BY 1""",
    "consensus_vote": """
        WITH v AS (SELECT l_partkey, l_suppkey, min(l_returnflag) AS i FROM lineitem GROUP BY 1, 2 HAVING min(l_returnflag) = max(l_returnflag)),
        c AS (SELECT l_partkey, i AS identity, count(*) AS support FROM v GROUP BY 1, 2),
        r AS (SELECT *, sum(support) OVER (PARTITION BY l_partkey)::BIGINT AS voting, max(support) OVER (PARTITION BY l_partkey) AS top FROM c),
        t AS (SELECT *, count(*) FILTER (support = top) OVER (PARTITION BY l_partkey) AS tops FROM r)
        SELECT l_partkey, identity, support, voting FROM t WHERE support = top AND tops = 1""",
    "linear_rt_model": "SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY 1, 2",
    "peak_normalise": "SELECT l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 9) AS relative FROM lineitem QUALIFY l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey) >= 0.5",
}
_ALL = (mass_candidates_topk, precursor_range_candidates, orphan_anti_supported, best_row_per_group, qc_summary, group_summary, upsert_count, trapezoid_area, consensus_vote, linear_rt_model, peak_normalise)


_MORE = (features, names, decisions, links, ranks, series, search, imports, gates, lookups, rules, detection)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_ALL, *(f for m in _MORE for f in m.ALL))}


def oracle_sql() -> dict[str, str]:
    out = dict(_SQL)
    for m in _MORE:
        out |= m.SQL
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.spectrum_search(spark, sf_dir)
