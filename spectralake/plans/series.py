"""Queries on curves, peaks, clusters and retention models, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import clusters, peaks, ranking, retention, series
from spectralake.plans.bases import CANDIDATES, candidates
from spectralake.session import table

_MIN = "epoch_us(ts)::DOUBLE / 6e7"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 6e7).alias("rt"))


def signal_noise(spark: SparkSession, d: str) -> DataFrame:
    out = series.signal_profile(_events(spark, d), ["user_id"], ["rt", "event_id"], "rt", "value")
    return out.select("user_id", F.round("baseline", 6).alias("baseline"), F.round("noise", 6).alias("noise"))


def corrected_area(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("day", F.floor(F.col("rt") / 1440))
    out = series.areas(rows, ["user_id", "day"], "rt", "value", "event_id")
    return out.select("user_id", F.col("day").cast("long").alias("day"), F.round("area", 3).alias("area"), F.round("corrected", 3).alias("corrected"))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("t", F.floor(F.col("rt") / 30).cast("double"))
    return peaks.as_traces(rows, ["user_id"], "t", "value")


def resolved_peaks(spark: SparkSession, d: str) -> DataFrame:
    # a smoothed saw over the trace, so that there are peaks with enough points
    wave = F.transform("times", lambda t: 100 + 400 * F.exp(-F.pow((t - F.floor(t / 40) * 40 - 20) / 5, 2)))
    even = _traces(spark, d).withColumn("times", F.transform(F.sequence(F.lit(0), F.size("times")), lambda i: i.cast("double")))
    return peaks.resolved(even.withColumn("values", wave), ["user_id"])


def repaired_bounds(spark: SparkSession, d: str) -> DataFrame:
    i = F.sequence(F.lit(0), F.lit(79))
    apex = (F.col("user_id") % 7 + 30).cast("double")
    rows = _traces(spark, d).select("user_id", F.transform(i, lambda x: x.cast("double")).alias("times"), F.transform(i, lambda x: 20 + 9000 * F.exp(-F.pow((x - apex) / 4, 2)) + 3000 * F.exp(-F.pow((x - apex - 22) / 3, 2))).alias("values"), apex.alias("rt"), (apex - 9).alias("lower"), (apex + 6 + F.col("user_id") % 5).alias("upper"), F.array(apex, apex + 22).alias("apices"))
    return peaks.repaired(rows, ["user_id"])


def split_regions(spark: SparkSession, d: str) -> DataFrame:
    i = F.sequence(F.lit(0), F.lit(79))
    gap = F.col("user_id") % 20 + 4
    rows = _traces(spark, d).select("user_id", F.transform(i, lambda x: x.cast("double")).alias("times"), F.transform(i, lambda x: 20 + 9000 * F.exp(-F.pow((x - 30) / 3, 2)) + 5000 * F.exp(-F.pow((x - 30 - gap) / 3, 2))).alias("values"), F.lit(15.0).alias("lower"), F.lit(70.0).alias("upper"), F.array(F.lit(30.0)).alias("apices"))
    return peaks.splits(rows, ["user_id"])


def peak_memberships(spark: SparkSession, d: str) -> DataFrame:
    wave = F.transform("times", lambda t: 100 + 400 * F.exp(-F.pow((t - F.floor(t / 40) * 40 - 20) / 5, 2)))
    even = _traces(spark, d).withColumn("times", F.transform(F.sequence(F.lit(0), F.size("times")), lambda i: i.cast("double")))
    seeds = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct((F.col("user_id") * 10 + i).alias("scan"), (i * 13.0).alias("time")))
    return peaks.memberships(even.withColumn("values", wave).withColumn("seeds", seeds), ["user_id"])


def peak_shapes(spark: SparkSession, d: str) -> DataFrame:
    i = F.sequence(F.lit(0), F.lit(30))
    wave = lambda middle, width: F.transform(i, lambda x: 1000 * F.exp(-F.pow((x - middle) / width, 2)))
    time = F.transform(i, lambda x: x * 0.01)
    rows = table(spark, d, "part").select("p_partkey", time.alias("times_a"), wave(15, F.lit(4)).alias("values_a"), time.alias("times_b"), wave(15 + F.col("p_partkey") % 12, 1 + F.col("p_size") % 6).alias("values_b"))
    return peaks.shapes(rows, ["p_partkey"])


def isotope_snapshots(spark: SparkSession, d: str) -> DataFrame:
    charge = F.col("p_partkey") % 3
    step = F.when(charge > 0, 1.00335483507 / charge).otherwise(1.0)
    mz = F.array(F.col("p_retailprice"), F.col("p_retailprice") + step, F.col("p_retailprice") + 2 * step + F.when(F.col("p_size") % 3 == 0, 0.5).otherwise(0.0), F.col("p_retailprice") + 3 * step, F.col("p_retailprice") + 3 * step + F.when(F.col("p_size") % 4 == 0, 0.001).otherwise(0.3), F.col("p_retailprice") + F.when(F.col("p_size") % 11 == 0, 0.002).otherwise(9.0))
    intensity = F.array(F.lit(100.0), F.lit(60.0), F.lit(20.0), F.lit(5.0), F.lit(7.0), (F.col("p_size") % 2).cast("double"))
    rows = table(spark, d, "part").select("p_partkey", mz.alias("mz"), intensity.alias("intensity"), "p_retailprice", charge.alias("charge"), (F.col("p_size") % 13 > 0).alias("centroided"))
    out = peaks.isotopes(rows, "mz", "intensity", "p_retailprice", "charge", "centroided")
    return out.select("p_partkey", "status", F.size("peaks").cast("long").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["relative"] * (p["offset"] + 1)), 6).alias("moment"))


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select(F.when(F.col("suppkey") % 2 == 0, "+").otherwise("-").alias("mode"), F.col("source_file").alias("source"), (F.col("spectrum") * 10 + F.col("ord")).cast("string").alias("scan"), (500 + F.col("partkey") % 400 * 0.004).alias("mz"), F.col("rt"), F.when(F.col("ord") % 3 == 0, F.concat(F.lit("p"), F.col("partkey") % 2)).alias("peak"))


def cohort_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cohorts(_spectra(spark, d), 10.0, 0.3)


def orphan_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select("matched_name", "adduct", (500 + F.col("suppkey") % 50 * 0.002).alias("mz"), "rt", (F.col("spectrum") * 10 + F.col("ord")).alias("ord"))
    return clusters.leaders(rows, ["matched_name", "adduct"], "ord", 10.0, 0.5)


def cohort_consensus(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("sample"), F.col("o_orderkey").alias("feature"), (500 + F.col("o_orderkey") % 600 * 0.02 + F.col("o_custkey") % 7 * 0.0004).alias("mz"), (F.col("o_custkey") % 97 * 9.0).alias("rt"), (F.col("o_orderkey") % 2).alias("charge"))
    return clusters.consensus_groups(rows)


def trace_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = _spectra(spark, d).select("source", "scan", "mz", F.col("rt").alias("seed"))
    out = clusters.queries(rows, ["source"])
    return out.select("source", F.round("mz", 6).alias("mz"), "lower", "upper", F.size("scans").alias("n"))


def query_context(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("file"), F.col("s_suppkey").alias("query"), (900 + F.col("s_suppkey") % 90 * 1.0).alias("mz"), (F.col("s_suppkey") % 20 * 1.0).alias("lower"), (F.col("s_suppkey") % 20 + 0.7).alias("upper"))
    native = table(spark, d, "part").select((F.col("p_size") % 3).alias("file"), F.col("p_retailprice").alias("native_mz"), (F.col("p_partkey") % 200 / 10).alias("apex"), (F.col("p_partkey") % 200 / 10 - 0.3).alias("left"), (F.col("p_partkey") % 200 / 10 + 0.2).alias("right"))
    out = clusters.with_context(asked, native, ["file"], 1500.0, 2.0)
    return out.select("query", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def curve_fits(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("rt", F.col("rt") + F.when(F.col("total_db") % 2 == 0, F.pow(F.col("total_c") - 28, F.lit(2.0)) * 0.01).otherwise(0.0))
    out = retention.curve_fit(rows, ["subclass", "total_db"], "total_c", "rt")
    return out.select("subclass", "total_db", "kind", "n", *[F.round(c, 5).alias(c) for c in ("c0", "c1", "c2", "r2")])


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Rows of series: time rises with carbons and falls with double bonds, but for outliers."""
    c, db = (28 + F.col("partkey") % 12).cast("long"), (F.floor(F.col("suppkey") / 4) % 6).cast("long")
    noise = (F.col("partkey") % 7 - 3) * 0.02 + F.when(F.col("ord") == 5, F.col("suppkey") % 5 * 1.0).otherwise(0.0)
    return candidates(spark, d).select(
        ((F.col("spectrum") * 10 + F.col("ord")) * 100_000 + F.col("partkey")).alias("ord"), F.concat(F.lit("K"), F.col("suppkey") % 4).alias("subclass"), db.alias("total_db"), c.alias("total_c"),
        (c * 0.5 - db * 0.9 + noise + 5).alias("rt"), F.col("final_score").alias("score"), F.col("ord").cast("long").alias("rank"), (F.col("passed") & (F.col("final_score") >= 50)).alias("high"), F.col("support"),
    )


def _points(spark: SparkSession, d: str) -> DataFrame:

    return ranking.per_carbon(_series(spark, d).where("high and rank = 1"), ["subclass", "total_db", "total_c"], "score", "rt", "ord")


def robust_curves(spark: SparkSession, d: str) -> DataFrame:
    return retention.robust_models(_points(spark, d), ["subclass"]).drop("anchors", "removed")


def rescued_curves(spark: SparkSession, d: str) -> DataFrame:
    top = _points(spark, d).withColumn("top", F.lit(True))
    lower = _series(spark, d).where("high and rank in (2, 3)").withColumn("top", F.lit(False))
    return retention.rescued_models(top.unionByName(lower), ["subclass"]).drop("anchors", "removed")


def ordered_curves(spark: SparkSession, d: str) -> DataFrame:
    return retention.ordered_models(_series(spark, d).where("high and rank <= 3"), ["subclass"]).drop("anchors", "removed")


def series_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d)
    models = retention.ordered_models(rows.where("high and rank <= 3"), ["subclass"])
    return retention.evaluate(rows, models, ["subclass"], F.col("high")).select("ord", "model_type", "action", "consistent")


def legacy_actions(spark: SparkSession, d: str) -> DataFrame:
    # the models are the plain lines, so that SQL can follow
    rows = _series(spark, d)
    models = retention.curve_fit(rows.where("high and rank = 1"), ["subclass", "total_db"], "total_c", "rt")
    out = retention.legacy_actions(rows, models, ["subclass"], F.col("rank") % 4 > 0, F.col("support") == "MS2-only")
    return out.select("ord", F.round("residual", 7).alias("residual"), F.round("consistency", 7).alias("consistency"), "action")


_S = f"""(SELECT (spectrum * 10 + ord) * 100000 + partkey AS ord, concat('K', suppkey % 4) AS subclass, suppkey // 4 % 6 AS total_db, 28 + partkey % 12 AS total_c, (28 + partkey % 12) * 0.5::DOUBLE - (suppkey // 4 % 6) * 0.9::DOUBLE + (partkey % 7 - 3) * 0.02::DOUBLE + CASE WHEN ord = 5 THEN suppkey % 5 ELSE 0 END + 5 AS rt,
    final_score AS score, ord AS rank, passed AND final_score >= 50 AS high, support FROM {CANDIDATES})"""


def _fit(source: str) -> str:
    """A curve for each (subclass, total_db) of ``source``, by normal equations on centred sums."""
    return f"""
        m0 AS (SELECT subclass, total_db, avg(total_c) AS mx, avg(rt) AS my FROM {source} GROUP BY 1, 2),
        u0 AS (SELECT s.subclass, s.total_db, mx, my, total_c AS c, total_c - mx AS u, rt - my AS v FROM {source} s JOIN m0 USING (subclass, total_db)),
        g0 AS (SELECT subclass, total_db, mx, my, count(*) AS n, count(DISTINCT c) AS d, min(c) AS lo, max(c) AS hi, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(u * v) AS uv, sum(u * u * v) AS uuv, sum(v * v) AS vv FROM u0 GROUP BY ALL),
        q0 AS (SELECT *, CASE WHEN s2 <> 0 THEN uv / s2 END AS slope, CASE WHEN d >= 3 AND s4 * s2 - s3 * s3 - s2 * s2 * s2 / n <> 0 THEN (uuv * s2 - uv * s3) / (s4 * s2 - s3 * s3 - s2 * s2 * s2 / n) END AS q FROM g0),
        b0 AS (SELECT *, (uv - q * s3) / nullif(s2, 0) AS b, -q * s2 / n AS a FROM q0),
        p0 AS (SELECT *, (SELECT min(a + b * (lo - mx + i * (hi - lo) / 319.0::DOUBLE) + q * (lo - mx + i * (hi - lo) / 319.0::DOUBLE) ** 2) FROM range(0, 320) r(i)) AS least_ FROM b0),
        k0 AS (SELECT *, CASE WHEN d >= 2 AND slope > 0 THEN CASE WHEN q IS NOT NULL AND b + 2 * q * (hi - mx) > 0 AND a + b * (lo - mx) + q * (lo - mx) ** 2 - least_ <= 0.10 THEN 'quadratic' ELSE 'linear' END END AS kind FROM p0),
        f0 AS (SELECT subclass, total_db, kind, n, CASE kind WHEN 'quadratic' THEN my + a - b * mx + q * mx * mx WHEN 'linear' THEN my - slope * mx END AS c0, CASE kind WHEN 'quadratic' THEN b - 2 * q * mx WHEN 'linear' THEN slope END AS c1, CASE kind WHEN 'quadratic' THEN q END AS c2,
            CASE WHEN n >= 2 AND vv > 0 THEN 1 - CASE kind WHEN 'quadratic' THEN vv - b * uv - q * uuv WHEN 'linear' THEN vv - slope * uv END / vv END AS r2 FROM k0)"""


SQL = {
    "signal_noise": f"""
        WITH e AS (SELECT user_id, event_id, {_MIN} AS rt, greatest(value, 0) AS y FROM events), q AS (SELECT user_id, quantile_cont(y, 0.2) AS edge FROM e GROUP BY 1),
        l AS (SELECT user_id, y, y <= edge AS low, lag(y) OVER w AS before, lag(y) OVER w <= edge AS lowb FROM e JOIN q USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY rt, event_id)),
        d AS (SELECT user_id, CASE WHEN low AND lowb THEN y - before END AS step, CASE WHEN low THEN y END AS lo FROM l), m AS (SELECT user_id, median(step) AS ms, median(lo) AS ml, count(step) AS n FROM d GROUP BY 1),
        s AS (SELECT user_id, any_value(n) AS n, any_value(ml) AS ml, median(abs(step - ms)) AS a, median(abs(lo - ml)) AS b FROM d JOIN m USING (user_id) GROUP BY 1)
        SELECT user_id, round(ml, 6) AS baseline, round(greatest(1, 1.4826::DOUBLE * CASE WHEN n >= 3 THEN a / sqrt(2) ELSE b END), 6) AS noise FROM s""",
    "corrected_area": f"""
        WITH e AS (SELECT user_id, event_id, {_MIN} AS t, value AS y FROM events), g AS (SELECT *, floor(t / 1440)::BIGINT AS day FROM e),
        b AS (SELECT *, first_value(t) OVER w AS t0, last_value(t) OVER w AS t1, first_value(y) OVER w AS y0, last_value(y) OVER w AS y1 FROM g WINDOW w AS (PARTITION BY user_id, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        c AS (SELECT *, greatest(y - CASE WHEN t1 > t0 THEN y0 + (y1 - y0) * (t - t0) / (t1 - t0) ELSE y0 END, 0) AS z FROM b),
        p AS (SELECT user_id, day, (y + lag(y) OVER w) / 2 * (t - lag(t) OVER w) AS a, (z + lag(z) OVER w) / 2 * (t - lag(t) OVER w) AS k FROM c WINDOW w AS (PARTITION BY user_id, day ORDER BY t, event_id))
        SELECT user_id, day, round(sum(a), 3) AS area, round(sum(k), 3) AS corrected FROM p GROUP BY 1, 2""",
    "isotope_snapshots": """
        WITH r AS (SELECT p_partkey, p_size, p_retailprice AS m, p_partkey % 3 AS z, CASE WHEN p_partkey % 3 > 0 THEN 1.00335483507::DOUBLE / (p_partkey % 3) ELSE 1 END AS s FROM part),
        l AS (SELECT p_partkey, p_size, m, z, s, unnest([{'x': m, 'i': 100.0}, {'x': m + s, 'i': 60.0}, {'x': m + 2 * s + CASE WHEN p_size % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END, 'i': 20.0}, {'x': m + 3 * s, 'i': 5.0}, {'x': m + 3 * s + CASE WHEN p_size % 4 = 0 THEN 0.001::DOUBLE ELSE 0.3::DOUBLE END, 'i': 7.0},
            {'x': m + CASE WHEN p_size % 11 = 0 THEN 0.002::DOUBLE ELSE 9 END, 'i': p_size % 2}], recursive := true) FROM r),
        p AS (SELECT * FROM l WHERE i > 0), a AS (SELECT p_partkey, count(*) AS n, min(x) AS ax, min(i) AS ai FROM p WHERE abs(x - m) <= m * 15.0::DOUBLE * 1e-6 GROUP BY 1),
        w AS (SELECT p_partkey, k, count(*) AS c, min(x) AS x, min(i) AS i FROM p JOIN a USING (p_partkey), range(1, 4) t(k) WHERE z > 0 AND abs(x - (ax + k * 1.00335483507::DOUBLE / z)) <= (ax + k * 1.00335483507::DOUBLE / z) * 15.0::DOUBLE * 1e-6 GROUP BY 1, 2),
        o AS (SELECT p_partkey, max(c) AS c, count(*) FILTER (c = 1) AS n, max(i) FILTER (c = 1) AS top, sum(i * (k + 1)) FILTER (c = 1) AS m FROM w GROUP BY 1),
        t AS (SELECT r.p_partkey, CASE WHEN p_size % 13 = 0 THEN 'profile_ms1' WHEN z = 0 THEN 'charge_unknown' WHEN coalesce(a.n, 0) = 0 THEN 'precursor_peak_missing' WHEN a.n > 1 THEN 'ambiguous_precursor' WHEN o.c > 1 THEN 'partial' ELSE 'ok' END AS status, o.n, o.m, ai, greatest(ai, coalesce(top, 0)) AS top FROM r LEFT JOIN a USING (p_partkey) LEFT JOIN o USING (p_partkey))
        SELECT p_partkey, status, CASE WHEN status IN ('ok', 'partial') THEN 1 + coalesce(n, 0) END::BIGINT AS n_peaks, CASE WHEN status IN ('ok', 'partial') THEN round((ai + coalesce(m, 0)) / top * 100, 6)::DOUBLE END AS moment FROM t""",
    "query_context": """
        WITH q AS (SELECT s_suppkey % 3 AS f, s_suppkey AS query, 900 + s_suppkey % 90 AS mz, (s_suppkey % 20)::DOUBLE AS lo, s_suppkey % 20 + 0.7::DOUBLE AS hi FROM supplier),
        n AS (SELECT p_size % 3 AS f, p_retailprice AS m, p_partkey % 200 / 10.0::DOUBLE AS apex, p_partkey % 200 / 10.0::DOUBLE - 0.3::DOUBLE AS l, p_partkey % 200 / 10.0::DOUBLE + 0.2::DOUBLE AS r FROM part),
        j AS (SELECT query, lo, hi, l, r, row_number() OVER (PARTITION BY query ORDER BY apex, l, r) AS i, apex BETWEEN lo AND hi OR (l <= hi AND r >= lo) AS meets FROM q JOIN n ON n.f = q.f AND abs(m - mz) <= mz * 1500.0::DOUBLE * 1e-6),
        b AS (SELECT query, min(i) FILTER (meets) AS a, max(i) FILTER (meets) AS z FROM j GROUP BY 1), c AS (SELECT query, min(l) AS l, max(r) AS r FROM j JOIN b USING (query) WHERE i BETWEEN a - 1 AND z + 1 GROUP BY 1)
        SELECT query, round(coalesce(least(lo, greatest(0, l - greatest(0.05, least(0.15, 0.1 * (r - l))))), lo), 6) AS lower, round(coalesce(greatest(hi, r + greatest(0.05, least(0.15, 0.1 * (r - l)))), hi), 6) AS upper FROM q LEFT JOIN c USING (query)""",
    "curve_fits": f"""
        WITH s1 AS (SELECT subclass, total_db, total_c, rt + CASE WHEN total_db % 2 = 0 THEN (total_c - 28) ** 2 * 0.01::DOUBLE ELSE 0 END AS rt FROM {_S}), {_fit("s1")}
        SELECT subclass, total_db, kind, n, round(c0, 5) AS c0, round(c1, 5) AS c1, round(c2, 5) AS c2, round(r2, 5) AS r2 FROM f0""",
    "legacy_actions": f"""
        WITH s1 AS (SELECT * FROM {_S} WHERE high AND rank = 1), {_fit("s1")},
        j AS (SELECT s.*, kind, abs(rt - (c0 + c1 * total_c + coalesce(c2, 0) * total_c * total_c)) AS off, s.rank % 4 > 0 AS chain, support = 'MS2-only' AS orphan FROM {_S} s LEFT JOIN f0 USING (subclass, total_db))
        SELECT ord, CASE WHEN kind IS NOT NULL AND chain AND NOT orphan THEN round(off, 7) END AS residual, CASE WHEN kind IS NOT NULL AND chain AND NOT orphan THEN round(greatest(0, least(1, 1 - off / 2)), 7) END AS consistency,
        CASE WHEN orphan THEN 'ms2_only_not_evaluated' WHEN NOT chain THEN 'species_not_evaluated' WHEN kind IS NULL THEN 'retain_unmodeled' WHEN off <= 0.5 THEN 'pass' WHEN off <= 2 THEN 'suspect' ELSE 'reject' END AS action FROM j""",
}
ALL = (
    signal_noise, corrected_area, resolved_peaks, repaired_bounds, split_regions, peak_memberships, peak_shapes, isotope_snapshots, cohort_clusters, orphan_clusters, cohort_consensus, trace_queries, query_context,
    curve_fits, robust_curves, rescued_curves, ordered_curves, series_actions, legacy_actions,
)
