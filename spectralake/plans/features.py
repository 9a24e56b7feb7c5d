"""Queries on linking, series, graphs, names, scores and tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions import names, scoring
from spectralake.operators import graphs, joins, linking, ranking, series, tables
from spectralake.session import dealt, table
from spectralake.sources import msp
from spectralake.streaming import live

#: Event types that stand for samples.
SAMPLES = ["click", "error", "purchase", "signup", "view"]
DELTAS = {"Na-H": 21.9, "NH4-H": 17.1}
POOLS = {"A": 0.5, "N": 0.3, "R": 0.2}
_MINUTES = "epoch_us(ts)::DOUBLE / 6e7"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 6e7).alias("rt"))


def feature_link_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    features = e.where("event_type = 'view'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("feature_id"), F.max("value").alias("feature_mz"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max")).drop("day")
    spectra = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("value").alias("mz"), "rt")
    out = linking.link_nearest(spectra, features, ["user_id"], "event_id", 0.25, 60, 5)
    return out.select("event_id", "feature_id", F.round("distance", 5).alias("distance"), "reason")


def unique_match_only(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("mz"))
    library = table(spark, d, "supplier").select("s_suppkey", (900 + F.abs("s_acctbal") / 100).alias("mass"))
    found = joins.mass_candidates(features, library, "mz", "mass", 50)
    return linking.unique_only(found.select("p_partkey", "s_suppkey"), ["p_partkey"])


def asof_previous_survey(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    surveys = e.where("event_type = 'view'").select("user_id", "rt", F.col("event_id").alias("survey_id"))
    out = linking.latest_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "rt"), surveys, ["user_id"], "rt", "survey_id", 600)
    return out.select("event_id", "survey_id", F.round("gap", 4).alias("gap"))


def topk_with_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("score"))
    return ranking.topk_ties(rows, ["o_custkey"], [F.desc("score")], 3)


def area_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = tables.area_matrix(_events(spark, d), ["user_id"], "event_type", "value", SAMPLES)
    return out.select("user_id", *[F.round(f"area_{s}", 4).alias(f"area_{s}") for s in SAMPLES])


def area_long(spark: SparkSession, d: str) -> DataFrame:
    wide = tables.area_matrix(_events(spark, d), ["user_id"], "event_type", "value", SAMPLES)
    return tables.long_areas(wide, ["user_id"], SAMPLES).select("user_id", "sample", F.round("area", 4).alias("area"))


def eic_extract(spark: SparkSession, d: str) -> DataFrame:
    out = series.extracted(_events(spark, d), ["user_id"], "value", "event_id", [20.0, 60.0, 120.0], 5.0)
    return out.select("user_id", "target", F.col("nearest").cast("long").alias("nearest"), "window_sum", "n_points")


def smooth_profile(spark: SparkSession, d: str) -> DataFrame:
    out = series.signal_profile(_events(spark, d), ["user_id"], ["rt", "event_id"], "rt", "value")
    return out.select("user_id", "n_points", *[F.round(c, 5).alias(c) for c in ("background", "apex", "cadence")])


def anchor_clusters(spark: SparkSession, d: str) -> DataFrame:
    return series.anchor_clusters(_events(spark, d), ["user_id"], "value", 0.5)


def rt_residual_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    out = series.residual_actions(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", 0.5, 2.0)
    return out.where(F.col("action").isin("keep", "suspect")).select("l_orderkey", "l_linenumber", "action")


def shape_cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    at = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    center = at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return vectors.join(center, "label").select("vec_id", F.round(scoring.cosine(F.col("v"), F.col("c")), 5).alias("cosine"))


def log_corr(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    return rows.groupBy("c_nationkey").agg(F.round(scoring.guarded_corr(F.col("o_totalprice"), F.col("c_acctbal")), 6).alias("log_corr"))


_NAME = "concat('PC(', p_size + 10, ':', p_partkey % 6, '/', p_partkey % 20 + 2, ':', p_size % 3, ')')"


def name_composition(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", "p_brand", F.expr(_NAME).alias("name"))
    named = names.with_parsed(named, F.col("name"), into="c").withColumn("n_chains", F.regexp_count("name", F.lit(names.CORE)).cast("bigint"))
    return named.select("p_partkey", "name", F.col("c.subclass").alias("compound_class"), "n_chains", "c.total_c", "c.total_db", names.sum_name(F.col("name"), F.col("c")).alias("sum_name"), names.identity(F.col("p_brand"), F.col("name")).alias("identity"))


def saturation_pools(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    top = rows.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("_top"))
    quality = scoring.saturation(F.col("l_extendedprice") / F.col("_top"), 0.25)
    out = scoring.pool_scores(rows.join(top, "l_orderkey"), ["l_orderkey"], "l_returnflag", quality, POOLS)
    return out.select("l_orderkey", F.round("total_score", 6).alias("total_score"))


def ppm_scores(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "supplier").select("s_suppkey", (900 + F.abs("s_acctbal") / 10).alias("mz"))
    found = joins.mass_candidates(features, table(spark, d, "part").select("p_partkey", "p_retailprice"), "mz", "p_retailprice", 20)
    return found.select("s_suppkey", "p_partkey", F.round(scoring.ppm_score(F.col("ppm_error")), 5).alias("ppm_score"))


def adduct_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return graphs.ion_pairs(rows, "p_partkey", "p_retailprice", ["p_brand"], DELTAS, 5).select("form", "id_a", "id_b")


def json_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("user_id").alias("user"))).alias("evidence"))


def unpivot_union(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return tables.union_all(regions, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent")))


def fragment_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"))
    return tables.fragment_text(rows, ["l_orderkey"], "l_extendedprice", "label", 2)


def msp_parse(spark: SparkSession, d: str) -> DataFrame:
    # short rows that ask for long work: merged by their bytes they would be a few long tasks
    lines = dealt(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"), "o_orderkey")
    peaks = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("mz"), F.col("l_quantity").alias("intensity"), F.lit("Common").alias("name")))).alias("p"))
    rows = dealt(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey").join(peaks, "o_orderkey")
    text = rows.select(msp.block(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("double"), F.lit("[M+H]+"), F.col("o_orderpriority"), F.col("p")).alias("value"))
    got = msp.records(text)
    return got.select("name", "precursor_mz", "adduct", "compound_class", F.size("fragments").cast("long").alias("n_fragments"), F.aggregate("fragments", F.lit(0.0), lambda a, p: a + p["mz"] * p["intensity"]).alias("moment"))


def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return live.windowed(rows, "ts", "event_type", "value", "1 day").select((F.unix_micros("start") / 1_000_000).cast("long").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


SQL = {
    "feature_link_nearest": f"""
        WITH e AS (SELECT *, {_MINUTES} AS rt FROM events),
        f AS (SELECT user_id, min(event_id) AS feature_id, max(value) AS fm, min(rt) AS a, max(rt) AS b FROM e WHERE event_type = 'view' GROUP BY user_id, ts::DATE),
        c AS (SELECT s.event_id, feature_id, rt BETWEEN a AND b AS inside, abs(value - fm) / fm / 0.25 + abs(rt - (a + b) / 2) / 60 AS dist FROM e s JOIN f USING (user_id) WHERE event_type = 'purchase' AND abs(value - fm) / fm <= 0.25),
        l AS (SELECT * FROM c WHERE inside QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, feature_id) = 1)
        SELECT event_id, l.feature_id, round(l.dist, 5) AS distance, CASE WHEN l.event_id IS NOT NULL THEN 'linked' WHEN event_id IN (SELECT event_id FROM c) THEN 'outside_rt' ELSE 'no_mass' END AS reason
        FROM e LEFT JOIN l USING (event_id) WHERE event_type = 'purchase'""",
    "unique_match_only": """
        WITH l AS (SELECT s_suppkey, 900 + abs(s_acctbal) / 100 AS mass FROM supplier)
        SELECT p_partkey, s_suppkey FROM part JOIN l ON mass BETWEEN p_retailprice / (1 + 5e-5) AND p_retailprice / (1 - 5e-5) QUALIFY count(*) OVER (PARTITION BY p_partkey) = 1""",
    "asof_previous_survey": f"""
        WITH e AS (SELECT *, {_MINUTES} AS rt FROM events),
        v AS (SELECT user_id, rt, max(event_id) AS survey_id FROM e WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT event_id, CASE WHEN p.rt - v.rt <= 600 THEN survey_id END AS survey_id, CASE WHEN p.rt - v.rt <= 600 THEN round(p.rt - v.rt, 4) END AS gap
        FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.rt >= v.rt""",
    "topk_with_ties": "SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS score, rank() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC) AS rank FROM orders QUALIFY rank <= 3",
    "area_matrix": "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{s}'), 4) AS area_{s}" for s in SAMPLES) + " FROM events GROUP BY 1",
    "area_long": "SELECT user_id, event_type AS sample, round(sum(value), 4) AS area FROM events GROUP BY 1, 2",
    "eic_extract": """
        WITH t AS (SELECT user_id, target, abs(value - target) AS off, event_id FROM events, (VALUES (20.0::DOUBLE), (60.0::DOUBLE), (120.0::DOUBLE)) x(target) WHERE abs(value - target) <= 5)
        SELECT user_id, target, first(event_id ORDER BY off, event_id DESC) AS nearest, sum(event_id)::BIGINT AS window_sum, count(*) AS n_points FROM t GROUP BY 1, 2""",
    "smooth_profile": f"""
        WITH e AS (SELECT user_id, event_id, {_MINUTES} AS rt, greatest(value, 0) AS y FROM events),
        s AS (SELECT user_id, (coalesce(lag(y) OVER w, y) + 2 * y + coalesce(lead(y) OVER w, y)) / 4 AS y, rt - lag(rt) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY rt, event_id))
        SELECT user_id, count(*) AS n_points, round(quantile_cont(y, 0.2), 5) AS background, round(max(y), 5) AS apex, round(median(dt), 5) AS cadence FROM s GROUP BY 1""",
    "anchor_clusters": """
        WITH RECURSIVE a(user_id, anchor) AS (
            SELECT user_id, min(value) FROM events GROUP BY 1
            UNION ALL
            SELECT a.user_id, min(e.value) FROM a JOIN events e ON e.user_id = a.user_id AND e.value - a.anchor > 0.5 GROUP BY 1)
        SELECT e.user_id, anchor, count(*) AS n FROM events e ASOF JOIN a ON e.user_id = a.user_id AND e.value >= a.anchor GROUP BY e.user_id, anchor""",
    "rt_residual_filter": """
        WITH f AS (SELECT l_returnflag, l_linestatus, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b, sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*)) AS s FROM lineitem GROUP BY 1, 2),
        r AS (SELECT l_orderkey, l_linenumber, abs(l_extendedprice - a * l_quantity - b) / s AS x FROM lineitem JOIN f USING (l_returnflag, l_linestatus))
        SELECT l_orderkey, l_linenumber, CASE WHEN x <= 0.5 THEN 'keep' ELSE 'suspect' END AS action FROM r WHERE x <= 2""",
    "shape_cosine": """
        WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        c AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2)
        SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 5) AS cosine FROM p JOIN c USING (label, i) GROUP BY 1""",
    "log_corr": """
        WITH r AS (SELECT c_nationkey, CASE WHEN o_totalprice > 0 AND c_acctbal > 0 THEN ln(o_totalprice) END AS x, CASE WHEN o_totalprice > 0 AND c_acctbal > 0 THEN ln(c_acctbal) END AS y FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT c_nationkey, CASE WHEN count(x) >= 5 AND stddev_pop(x) >= 1e-6 AND stddev_pop(y) >= 1e-6 THEN round(corr(x, y), 6) END AS log_corr FROM r GROUP BY 1""",
    "name_composition": f"""
        WITH n AS (SELECT p_partkey, p_brand, p_size, {_NAME} AS name FROM part)
        SELECT p_partkey, name, 'PC' AS compound_class, 2::BIGINT AS n_chains, (p_size + 10 + p_partkey % 20 + 2)::BIGINT AS total_c, (p_partkey % 6 + p_size % 3)::BIGINT AS total_db,
        concat('PC(', p_size + 12 + p_partkey % 20, ':', p_partkey % 6 + p_size % 3, ')') AS sum_name, concat(lower(p_brand), '|', lower(name)) AS identity FROM n""",
    "saturation_pools": """
        WITH q AS (SELECT l_orderkey, l_returnflag AS p, least(1.25 * x / (x + 0.25), 1.0) AS v FROM (SELECT l_orderkey, l_returnflag, l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS x FROM lineitem)),
        b AS (SELECT l_orderkey, p, max(v) AS v, CASE p WHEN 'A' THEN 0.5::DOUBLE WHEN 'N' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w FROM q GROUP BY 1, 2)
        SELECT l_orderkey, round(greatest(0, least(100, 100 * sum(v * w) / sum(w))), 6) AS total_score FROM b GROUP BY 1""",
    "ppm_scores": """
        WITH f AS (SELECT s_suppkey, 900 + abs(s_acctbal) / 10 AS mz FROM supplier)
        SELECT s_suppkey, p_partkey, round(1 - least(abs((mz - p_retailprice) / p_retailprice * 1e6), 10) / 10, 5) AS ppm_score FROM f JOIN part ON p_retailprice BETWEEN mz / (1 + 2e-5) AND mz / (1 - 2e-5)""",
    "adduct_pairs": """
        SELECT form, a.p_partkey AS id_a, b.p_partkey AS id_b FROM (VALUES ('Na-H', 21.9::DOUBLE), ('NH4-H', 17.1::DOUBLE)) d(form, delta), part a, part b
        WHERE a.p_brand = b.p_brand AND b.p_retailprice BETWEEN a.p_retailprice + delta - a.p_retailprice * 5 * 1e-6 AND a.p_retailprice + delta + a.p_retailprice * 5 * 1e-6""",
    "json_evidence": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, concat('{\"k\":', props::JSON->>'k', ',\"user\":', user_id, '}') AS evidence FROM events",
    "unpivot_union": "SELECT r_regionkey AS key, r_name AS name, NULL::INTEGER AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "fragment_text": "SELECT l_orderkey, string_agg(printf('%.2f %s%d', l_extendedprice, l_returnflag, l_linenumber), '; ' ORDER BY l_extendedprice, l_returnflag || l_linenumber) AS fragments FROM lineitem GROUP BY 1",
    "msp_parse": """
        SELECT o_orderkey::VARCHAR AS name, any_value(o_custkey)::DOUBLE AS precursor_mz, '[M+H]+' AS adduct, any_value(o_orderpriority) AS compound_class, count(*) AS n_fragments, sum(l_linenumber * l_quantity) AS moment
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "windowed_counts": "SELECT epoch(ts::DATE)::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
ALL = (
    feature_link_nearest, unique_match_only, asof_previous_survey, topk_with_ties, area_matrix, area_long, eic_extract, smooth_profile, anchor_clusters, rt_residual_filter,
    shape_cosine, log_corr, name_composition, saturation_pools, ppm_scores, adduct_pairs, json_evidence, unpivot_union, fragment_text, msp_parse, windowed_counts,
)
