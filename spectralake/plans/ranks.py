"""Queries on ranks, tiers, selections, duplicates and relations, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import annotate, graphs, joins, ranking
from spectralake.plans.bases import CANDIDATES, candidates
from spectralake.session import table

_UID = "((spectrum * 10 + ord) * 100000 + partkey) * 1000 + suppkey % 1000"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    # scores that lie within the tolerance of each other, and chains of them
    return candidates(spark, d).withColumn("uid", F.expr(_UID)).withColumn("score", F.floor(F.col("final_score") / 20) * 20 + F.col("partkey") % 3 * 4e-10)


def dense_rank_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.floor(F.col("o_totalprice") / 1000) + F.col("o_orderkey") % 3 * 6e-10).alias("score"))
    return ranking.tolerance_rank(rows, ["o_custkey"], "score", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


def tiered_rank(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.tiers(_rows(spark, d), ["spectrum"], "compound_class", "score", "n_fragments", [F.col("uid")])
    return out.select("uid", "tier", "demoted")


def result_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.tiers(_rows(spark, d), ["spectrum"], "compound_class", "score", "n_fragments", [F.col("uid")])
    out = ranking.result_ranks(rows, ["spectrum"], "compound_class", "score", "n_fragments", [F.col("tier"), F.desc("score"), F.col("uid")])
    metrics = ranking.rank_metrics(F.col("final_score"), F.col("ppm_error"))
    return out.select("uid", "rank", *[F.round(m, 6).alias(n) for m, n in zip(metrics, ("normalized", "ppm_score", "rank_score"), strict=True)])


def output_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("spectrum", F.col("spectrum") % 500)
    ranked = ranking.tolerance_rank(rows, ["spectrum"], "score", [F.col("uid")])
    out = ranking.selected(ranked, ["spectrum"], "rank", [F.desc("score"), F.col("uid")], F.col("suppkey") % 3 == 0, 12, F.col("compound_class") == "TG-EST")
    return out.select("uid", "rank")


def scoped_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("scope", ranking.scope(F.when(F.col("partkey") % 10 == 0, " NAE "), F.col("compound_class")))
    rows = ranking.first_order(rows, ["spectrum", "scope"], "uid")
    ranked = ranking.topk(rows, ["spectrum", "scope"], [F.desc("final_score"), F.col("uid")], 1000)
    three = ranking.distinct_identities(ranked.drop("rank"), ["spectrum", "scope"], "matched_name", [F.desc("final_score"), F.col("uid")])
    return ranked.join(three.select("uid", F.col("place").cast("long").alias("place")), "uid", "left").select("uid", "scope", "group_order", F.col("rank").cast("long").alias("display_rank"), "place")


def library_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return ranking.library_order(rows, "p_retailprice", "p_partkey").select("p_partkey", F.col("position").cast("long").alias("position"))


def rescue_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("residual", F.abs(F.col("rt") - 0.3 * F.col("ord") * 10))
    return ranking.best(rows, ["spectrum", "compound_class"], [F.col("residual"), F.col("ord"), F.col("final_score").desc_nulls_last(), F.col("uid")]).select("uid", F.round("residual", 6).alias("residual"))


def carbon_points(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("uid", "compound_class", (F.col("suppkey") % 2).alias("total_db"), (30 + F.col("partkey") % 9).alias("total_c"), F.when(F.col("partkey") % 3 > 0, F.col("final_score")).alias("score"), (F.col("rt") + F.col("ord") * 0.013).alias("rt"))
    return ranking.per_carbon(rows, ["compound_class", "total_db", "total_c"], "score", "rt", "uid").select("uid")


def carbon_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("uid", "compound_class", (30 + F.col("partkey") % 9).alias("total_c"), (F.col("rt") + F.col("ord") * 0.013).alias("rt"), "final_score")
    return ranking.binned_points(rows, ["compound_class"], "total_c", "rt", [F.desc("final_score"), F.col("uid")]).select("uid")


def acid_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("feature_id", F.when(F.col("partkey") % 3 == 0, F.col("suppkey")).cast("string")).withColumn("intensity", F.when(F.col("partkey") % 5 > 0, F.col("intensity")))
    return ranking.without_repeated_acids(rows, "uid").select("uid")


def report_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("spectrum", F.col("spectrum") % 300)
    out = ranking.collapse_reports(rows, ["spectrum", "compound_class", "adduct", "matched_name"], "resolution_level", "final_score", "n_fragments", "ppm_error", "uid")
    return out.select("uid", "group_order")


def best_first_spectra(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("key", F.col("suppkey") % 200)
    by = [F.desc(F.col("spectrum") % 7 == 0), F.col("compound_class").isin("FA", "NAE"), F.col("ord"), F.desc("final_score"), F.col("uid")]
    return ranking.best(rows, ["key", "spectrum"], by).select("key", "uid")


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("run_"), F.lpad((F.col("user_id") % 37).cast("string"), 3, "0")).alias("run"))
    return ranking.best(rows, ["event_type"], [F.desc("run"), F.col("event_id")])


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit(0).alias("file"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.lit(1).alias("file"), F.lit("r").alias("kind"))
    out = a.unionByName(b, allowMissingColumns=True)
    extra = table(spark, d, "supplier").where("s_suppkey <= 40").select(F.col("s_suppkey").cast("int").alias("key"), F.lit("derived").alias("name"), F.lit(2).alias("file"))
    return out.unionByName(extra.join(out, "key", "left_anti"), allowMissingColumns=True)


def observation_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("mz_cluster", F.floor(F.col("final_score") / 10)).withColumn("rt_cluster", F.floor("rt"))
    keys = ["source_file", "compound_class", "matched_name", "adduct", "mz_cluster", "rt_cluster"]
    return ranking.best(rows, keys, [F.col("ord"), F.col("final_score").desc_nulls_last(), F.col("intensity").desc_nulls_last(), F.col("uid")]).select("uid")


def matched_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).groupBy("spectrum").agg(F.array_sort(F.collect_list(F.struct("uid", "intensity", "relative_intensity", "ord"))).alias("m"))
    tokens = F.transform("m", lambda x: F.concat((x["ord"] % 3).cast("string"), F.lit(":0")))
    matched = F.transform(F.filter("m", lambda x: x["relative_intensity"] > 0.05), lambda x: F.concat((x["ord"] % 3).cast("string"), F.lit(":0")))
    chains = annotate.chain_evidence(tokens, matched, F.size(F.filter("m", lambda x: x["relative_intensity"] < 0.01)))
    sums = annotate.matched_sums("m")
    return rows.select("spectrum", *[F.round(s, 4).alias(n) for s, n in zip(sums, ("intensity", "relative"), strict=True)], chains.cast("long").alias("chains"))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    # paths: each customer is tied to the next of the same nation whose key is at most 90 larger
    ends = [c.select("c_nationkey", F.col("c_custkey").alias(n)) for n in ("x", "y")]
    edges = joins.interval_join(*ends, F.col("x") + 1, F.col("x") + 30, F.col("y"), 30, on=["c_nationkey"])
    return graphs.components(edges, "x", "y")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    ion = lambda n: F.expr(f"CASE {n} % 4 WHEN 0 THEN '[M+H]+' WHEN 1 THEN '[M+Na]+' WHEN 2 THEN '[M+NH4]+' ELSE '[M+K]+' END")
    return table(spark, d, "part").where("p_partkey % 4 < 3").select(
        F.col("p_partkey").alias("feature_a"), (F.col("p_partkey") + F.when(F.col("p_size") % 9 == 0, 2).otherwise(1)).alias("feature_b"), ion("p_partkey").alias("ion_a"),
        ion("(p_partkey + CASE WHEN p_size % 9 = 0 THEN 2 ELSE 1 END)").alias("ion_b"), (F.floor(F.col("p_partkey") / 4) + 500 + F.col("p_size") % 13 * 0.0003).alias("neutral_mass"),
        F.when(F.col("p_size") % 11 > 0, "EIC_supported").otherwise("mixed_evidence").alias("status"), F.lit(2).alias("shared_samples"), F.lit(2).alias("supported_samples"), F.lit(0).alias("rejected_samples"),
    )


def confirmed_relations(spark: SparkSession, d: str) -> DataFrame:
    return graphs.confirmed_relations(_relations(spark, d)).select("feature_a", "feature_b", "ion_a", "ion_b")


def relation_lines(spark: SparkSession, d: str) -> DataFrame:
    return graphs.relation_labels(_relations(spark, d))


_R = f"(SELECT *, {_UID} AS uid, floor(final_score / 20) * 20 + (partkey % 3) * 4e-10::DOUBLE AS score FROM {CANDIDATES})"
_TIERS = f"""
    a AS (SELECT *, abs(score - max(score) OVER (PARTITION BY spectrum)) <= 1e-9 AS top FROM {_R}),
    b AS (SELECT *, top AND n_fragments < max(n_fragments) FILTER (top) OVER (PARTITION BY spectrum, compound_class) AS demoted FROM a),
    c AS (SELECT *, CASE WHEN NOT top THEN 2 WHEN demoted THEN 1 ELSE 0 END AS part FROM b),
    e AS (SELECT *, CASE WHEN lag(part) OVER w IS NULL THEN 1 WHEN part = 1 AND lag(part) OVER w = 0 THEN 1 WHEN part = 2 AND abs(score - lag(score) OVER w) > 1e-9 THEN 1 ELSE 0 END AS opens FROM c WINDOW w AS (PARTITION BY spectrum ORDER BY part, score DESC, uid)),
    t AS (SELECT *, (sum(opens) OVER (PARTITION BY spectrum ORDER BY part, score DESC, uid ROWS UNBOUNDED PRECEDING))::BIGINT AS tier FROM e)"""
_ION = "CASE {n} % 4 WHEN 0 THEN '[M+H]+' WHEN 1 THEN '[M+Na]+' WHEN 2 THEN '[M+NH4]+' ELSE '[M+K]+' END"
_REL = f"""(SELECT a, b, {_ION.format(n="a")} AS ia, {_ION.format(n="b")} AS ib, m, ok FROM (SELECT p_partkey AS a, p_partkey + CASE WHEN p_size % 9 = 0 THEN 2 ELSE 1 END AS b, p_partkey // 4 + 500 + (p_size % 13) * 0.0003::DOUBLE AS m, p_size % 11 > 0 AS ok FROM part WHERE p_partkey % 4 < 3))"""
SQL = {
    "dense_rank_tolerance": """
        WITH r AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000) + (o_orderkey % 3) * 6e-10::DOUBLE AS s FROM orders),
        l AS (SELECT *, CASE WHEN abs(s - lag(s) OVER w) <= 1e-9 THEN 0 ELSE 1 END AS x FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey))
        SELECT o_custkey, o_orderkey, (sum(x) OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS rank FROM l""",
    "tiered_rank": f"WITH {_TIERS} SELECT uid, tier, demoted FROM t",
    "result_ranks": f"""
        WITH RECURSIVE {_TIERS},
        n AS (SELECT uid, spectrum, score, demoted, compound_class AS k, n_fragments AS f, final_score, ppm_error, row_number() OVER (PARTITION BY spectrum ORDER BY tier, score DESC, uid) AS i FROM t),
        r AS (SELECT uid, spectrum, i, score, k, f, 1 AS rank FROM n WHERE i = 1
            UNION ALL SELECT n.uid, n.spectrum, n.i, n.score, n.k, n.f, CASE WHEN r.rank = 1 AND n.demoted THEN 2 WHEN r.rank = 1 AND abs(n.score - r.score) <= 1e-9 AND n.k = r.k AND n.f <> r.f THEN 2 WHEN abs(n.score - r.score) <= 1e-9 THEN r.rank ELSE r.rank + 1 END FROM r JOIN n ON n.spectrum = r.spectrum AND n.i = r.i + 1)
        SELECT uid, rank::BIGINT AS rank, round(least(1, final_score / 100), 6) AS normalized, round(1 - least(abs(ppm_error), 10) / 10, 6) AS ppm_score, round(least(1, final_score / 100), 6) AS rank_score FROM r JOIN n USING (uid)""",
    "output_selection": f"""
        WITH RECURSIVE q AS (SELECT uid, spectrum % 500 AS s, score, suppkey % 3 = 0 AS ok, compound_class = 'TG-EST' AS cap FROM {_R}),
        l AS (SELECT *, CASE WHEN abs(score - lag(score) OVER w) <= 1e-9 THEN 0 ELSE 1 END AS x, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY s ORDER BY score DESC, uid)),
        n AS (SELECT *, (sum(x) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS rank FROM l),
        r AS (SELECT uid, s, i, rank, true AS taken, 1 AS n, cap, CASE WHEN cap THEN 1 ELSE 0 END AS caps FROM n WHERE i = 1
            UNION ALL SELECT n.uid, n.s, n.i, n.rank, n.rank = r.rank OR n.ok, r.n + CASE WHEN n.rank = r.rank OR n.ok THEN 1 ELSE 0 END, n.cap, r.caps + CASE WHEN n.cap AND (n.rank = r.rank OR n.ok) THEN 1 ELSE 0 END FROM r JOIN n ON n.s = r.s AND n.i = r.i + 1 WHERE r.n < 12 OR n.rank = r.rank)
        SELECT uid, rank FROM r WHERE taken AND (NOT cap OR caps <= 3)""",
    "scoped_ranks": f"""
        WITH r AS (SELECT *, CASE WHEN compound_class = 'FA' THEN 'fa' WHEN compound_class = 'NAE' OR partkey % 10 = 0 THEN 'nae' ELSE 'main' END AS scope FROM {_R}),
        f AS (SELECT uid FROM r QUALIFY row_number() OVER (PARTITION BY spectrum, scope, matched_name ORDER BY final_score DESC, uid) = 1),
        p AS (SELECT uid, row_number() OVER (PARTITION BY spectrum, scope ORDER BY final_score DESC, uid) AS place FROM r WHERE uid IN (SELECT uid FROM f) QUALIFY place <= 3)
        SELECT uid, scope, min(uid) OVER (PARTITION BY spectrum, scope) AS group_order, row_number() OVER (PARTITION BY spectrum, scope ORDER BY final_score DESC, uid) AS display_rank, place FROM r LEFT JOIN p USING (uid)""",
    "library_positions": "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS position FROM part",
    "rescue_choice": f"SELECT uid, round(abs(rt - 0.3::DOUBLE * ord * 10), 6) AS residual FROM {_R} QUALIFY row_number() OVER (PARTITION BY spectrum, compound_class ORDER BY abs(rt - 0.3::DOUBLE * ord * 10), ord, final_score DESC, uid) = 1",
    "carbon_points": f"""
        WITH r AS (SELECT uid, compound_class AS k, suppkey % 2 AS b, 30 + partkey % 9 AS c, CASE WHEN partkey % 3 > 0 THEN final_score END AS s, rt + ord * 0.013::DOUBLE AS rt FROM {_R}),
        m AS (SELECT *, max(s) OVER (PARTITION BY k, b, c) AS top FROM r), n AS (SELECT *, median(rt) OVER (PARTITION BY k, b, c) AS mid FROM m WHERE top IS NULL OR s = top)
        SELECT uid FROM n QUALIFY row_number() OVER (PARTITION BY k, b, c ORDER BY abs(rt - mid), uid) = 1""",
    "carbon_bins": f"""
        WITH r AS (SELECT uid, compound_class AS k, 30 + partkey % 9 AS c, round_even((rt + ord * 0.013::DOUBLE) / 0.05::DOUBLE, 0)::BIGINT AS bin, final_score FROM {_R}),
        o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, c, bin ORDER BY final_score DESC, uid) = 1)
        SELECT uid FROM o QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY final_score DESC, uid) <= 20""",
    "acid_dedup": f"""
        SELECT uid FROM {_R} WHERE compound_class <> 'FA' UNION ALL
        SELECT uid FROM (SELECT * FROM {_R} WHERE compound_class = 'FA' QUALIFY row_number() OVER (PARTITION BY source_file, matched_name, adduct ORDER BY partkey % 3 = 0 DESC, CASE WHEN partkey % 5 > 0 THEN intensity ELSE 0 END DESC, relative_intensity DESC, n_fragments DESC, abs(ppm_error), rt, uid) = 1)""",
    "report_collapse": f"""
        WITH r AS (SELECT *, spectrum % 300 AS s, CASE resolution_level WHEN 'chain_level' THEN 3 WHEN 'tentative_chain_level' THEN 2 WHEN 'species_level' THEN 2 WHEN 'tentative_species_level' THEN 1 ELSE 0 END AS p FROM {_R}), g AS (SELECT *, min(uid) OVER (PARTITION BY s, compound_class, adduct, matched_name) AS o FROM r)
        SELECT uid, o AS group_order FROM g QUALIFY row_number() OVER (PARTITION BY s, compound_class, adduct, matched_name ORDER BY p DESC, final_score DESC, n_fragments DESC, abs(ppm_error), uid) = 1""",
    "best_first_spectra": f"SELECT suppkey % 200 AS key, uid FROM {_R} QUALIFY row_number() OVER (PARTITION BY suppkey % 200, spectrum ORDER BY spectrum % 7 = 0 DESC, compound_class IN ('FA', 'NAE'), ord, final_score DESC, uid) = 1",
    "latest_runs": "SELECT event_id, event_type, printf('run_%03d', user_id % 37) AS run FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id % 37 DESC, event_id) = 1",
    "ordered_union": """
        WITH o AS (SELECT n_nationkey AS key, n_name AS name, 0 AS file, NULL AS kind FROM nation UNION ALL SELECT r_regionkey, NULL, 1, 'r' FROM region)
        SELECT key, name, file, kind::VARCHAR AS kind FROM o UNION ALL SELECT s_suppkey::INTEGER, 'derived', 2, NULL FROM supplier WHERE s_suppkey <= 40 AND s_suppkey NOT IN (SELECT key FROM o)""",
    "observation_dedup": f"SELECT uid FROM {_R} QUALIFY row_number() OVER (PARTITION BY source_file, compound_class, matched_name, adduct, floor(final_score / 10), floor(rt) ORDER BY ord, final_score DESC, intensity DESC, uid) = 1",
    "matched_sums": f"""
        WITH r AS (SELECT spectrum, round(sum(intensity), 4) AS intensity, round(sum(relative_intensity), 4) AS relative, count(*) AS n, count(*) FILTER (relative_intensity < 0.01) AS u FROM {_R} GROUP BY 1),
        h AS (SELECT spectrum, count(*) AS c FROM {_R} a WHERE EXISTS (SELECT 1 FROM {_R} b WHERE b.spectrum = a.spectrum AND b.ord % 3 = a.ord % 3 AND b.relative_intensity > 0.05) GROUP BY 1)
        SELECT spectrum, intensity, relative, least(n, coalesce(c, 0) + u)::BIGINT AS chains FROM r LEFT JOIN h USING (spectrum)""",
    "graph_components": """
        WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_mktsegment <> 'BUILDING'), e AS (SELECT a.k AS x, b.k AS y FROM c a JOIN c b USING (n) WHERE b.k > a.k AND b.k - a.k <= 30),
        u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r(node, z) AS (SELECT DISTINCT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.z)
        SELECT node, min(z) AS component FROM r GROUP BY 1""",
    "confirmed_relations": f"""
        WITH RECURSIVE l AS (SELECT * FROM {_REL} WHERE ok), u AS (SELECT a AS x, b AS y, ia AS i, m FROM l UNION ALL SELECT b, a, ib, m FROM l), r(node, z) AS (SELECT DISTINCT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.z),
        k AS (SELECT node, min(z) AS c FROM r GROUP BY 1), n AS (SELECT x AS node, count(DISTINCT i) AS d, min(i) AS i, min(m) AS lo, max(m) AS hi FROM u GROUP BY 1),
        v AS (SELECT c FROM n JOIN k USING (node) GROUP BY c HAVING max(d) = 1 AND count(DISTINCT i) = count(*) AND max(hi) - min(lo) <= min(lo) * 5.0::DOUBLE * 1e-6)
        SELECT a AS feature_a, b AS feature_b, ia AS ion_a, ib AS ion_b FROM l JOIN k ON k.node = a WHERE c IN (SELECT c FROM v)""",
    "relation_lines": f"""
        WITH b AS (SELECT a AS feature, concat(ia, ' - ', b, ' ', ib) AS line FROM {_REL} UNION ALL SELECT b, concat(ib, ' - ', a, ' ', ia) FROM {_REL})
        SELECT feature, count(*) AS n_links, string_agg(DISTINCT line, '; ' ORDER BY line) AS lines FROM b GROUP BY 1""",
}
ALL = (
    dense_rank_tolerance, tiered_rank, result_ranks, output_selection, scoped_ranks, library_positions, rescue_choice, carbon_points, carbon_bins, acid_dedup, report_collapse, best_first_spectra, latest_runs, ordered_union,
    observation_dedup, matched_sums, graph_components, confirmed_relations, relation_lines,
)
