"""Retention over carbons: plain curves as aggregates, robust and ordered models of each class by kernels, evaluation as a join.

Only rows that may train go to a kernel, one class (or one series of it) to a call, and of these only the one of each carbon and
time (or 0.05 min) that can count; the models, a few numbers each, are joined back, so evaluating all rows is one hash join and expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.functions import series_models as sm

MODEL = "kind string, c0 double, c1 double, c2 double, carbon_min double, carbon_max double, n_points long, n_original long, r2 double, support string"


def curve_fit(rows: DataFrame, keys: list[str], x: str, y: str, grid: int = 320, dip: float = 0.10) -> DataFrame:
    """A rising line per group, or the parabola where it rises at the right end and dips little at the left; closed form on centred sums.

    Gives kind, c0, c1, c2, n, r2; kind is null for fewer than two distinct x or a line that doesn't rise.
    """
    clean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    middle = clean.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    u, v = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = clean.join(middle, keys).groupBy(*keys, "_mx", "_my").agg(
        F.count("*").alias("n"), F.count_distinct(x).alias("_d"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.sum(u * u).alias("_2"), F.sum(u * u * u).alias("_3"), F.sum(u * u * u * u).alias("_4"),
        F.sum(u * v).alias("_uv"), F.sum(u * u * v).alias("_uuv"), F.sum(v * v).alias("_vv"),
    )
    n, s2, s3, s4 = F.col("n"), F.col("_2"), F.col("_3"), F.col("_4")
    line = F.try_divide(F.col("_uv"), s2)
    # with u centred: a*n + q*s2 = 0, b*s2 + q*s3 = uv, a*s2 + b*s3 + q*s4 = uuv
    q = F.try_divide(F.col("_uuv") * s2 - F.col("_uv") * s3, s4 * s2 - s3 * s3 - s2 * s2 * s2 / n)
    fitted = sums.withColumn("_line", line).withColumn("_q", F.when(F.col("_d") >= 3, q)).withColumn("_b", F.try_divide(F.col("_uv") - F.col("_q") * s3, s2)).withColumn("_a", -F.col("_q") * s2 / n)
    at = lambda p: F.col("_a") + F.col("_b") * p + F.col("_q") * p * p
    step = (F.col("_hi") - F.col("_lo")) / (grid - 1)
    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: at(F.col("_lo") - F.col("_mx") + i * step))
    bent = (F.col("_b") + 2 * F.col("_q") * (F.col("_hi") - F.col("_mx")) > 0) & (F.element_at(points, 1) - F.array_min(points) <= dip)
    kind = F.when((F.col("_d") >= 2) & (F.col("_line") > 0), F.when(F.coalesce(bent, F.lit(False)), "quadratic").otherwise("linear"))
    out = fitted.withColumn("kind", kind)
    curved = F.col("kind") == "quadratic"
    mx = F.col("_mx")
    rest = F.when(curved, F.col("_vv") - F.col("_b") * F.col("_uv") - F.col("_q") * F.col("_uuv")).otherwise(F.col("_vv") - F.col("_line") * F.col("_uv"))
    return out.select(
        *keys, "kind", "n",
        F.when(curved, F.col("_my") + F.col("_a") - F.col("_b") * mx + F.col("_q") * mx * mx).when(F.col("kind") == "linear", F.col("_my") - F.col("_line") * mx).alias("c0"),
        F.when(curved, F.col("_b") - 2 * F.col("_q") * mx).when(F.col("kind") == "linear", F.col("_line")).alias("c1"), F.when(curved, F.col("_q")).alias("c2"),
        F.when(F.col("kind").isNotNull() & (F.col("n") >= 2) & (F.col("_vv") > 0), 1 - rest / F.col("_vv")).alias("r2"),
    )


def _row(curve: sm.Curve, points: pd.DataFrame, original: int) -> tuple:
    coef = [*map(float, curve.coef), *[None] * (3 - len(curve.coef))]
    r2 = sm.r_squared(points.rt.to_numpy(float), curve.at(points.total_c)) if len(curve.coef) else float("nan")
    return curve.kind, *coef, curve.low, curve.high, curve.n, original, None if np.isnan(r2) else r2, curve.support


NAMES = [c.strip().split()[0] for c in MODEL.split(",")]


def _schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "total_db long", MODEL, "anchors array<long>", "removed array<long>"])


def _first(rows: DataFrame, at: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Of each group the first row in an order, and the number of its rows as _n."""
    kept = F.struct(*rows.columns)
    return rows.groupBy(*at).agg(F.min_by(kept, F.struct(*order)).alias("_f"), F.count("*").alias("_n")).select("_f.*", "_n")


def _best(score: str = "score") -> list[Column]:
    """Sort keys: the highest score first, rows without one last."""
    none = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    return [none.alias("_s0"), F.when(~none, -F.col(score)).alias("_s1")]


def _run(rows: DataFrame, keys: list[str], kernel) -> DataFrame:

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(*(pdf[k].iloc[0] for k in keys), db, *_row(curve, points, original), list(map(int, anchors)), list(map(int, removed))) for db, curve, points, original, anchors, removed in kernel(pdf)]
        return pd.DataFrame(out, columns=[*keys, "total_db", *NAMES, "anchors", "removed"])

    return rows.groupBy(*keys, "total_db").applyInPandas(work, _schema(rows, keys))


def robust_models(points: DataFrame, keys: list[str]) -> DataFrame:
    """One robust curve for each (keys, total_db) from points (ord, total_db, total_c, rt), one of each carbon."""

    def kernel(pdf: pd.DataFrame):
        for db, g in pdf.groupby("total_db"):
            g = g.sort_values("total_c", kind="stable").set_index("ord", drop=False).rename_axis(None)
            curve = sm.robust(g)
            active = g.drop(index=curve.removed)
            curve.support = "independent"
            yield int(db), curve, active, len(g), active.index, curve.removed

    return _run(points, keys, kernel)


def rescued_models(points: DataFrame, keys: list[str]) -> DataFrame:
    """Robust curves with rescue: points also hold rank, score and ``top`` (whether the row is its carbon's first choice)."""

    def kernel(pdf: pd.DataFrame):
        for db, g in pdf.groupby("total_db"):
            g = g.sort_values("ord", kind="stable").set_index("ord", drop=False).rename_axis(None)
            first = g[g.top].sort_values("total_c", kind="stable")
            curve, anchors, replaced, added = sm.rescued(first, g)
            active = anchors.drop(index=[r for r in curve.removed if r in anchors.index])
            curve.support = f"rescued {replaced}+{added}"
            yield int(db), curve, active, len(first), active.index, curve.removed

    # of lower rows at one carbon and time only the best can replace or extend
    lower = _first(points.where("not top and rank between 2 and 3"), [*keys, "total_db", "total_c", "rt"], ["rank", *_best(), "ord"])
    return _run(points.where("top").unionByName(lower.drop("_n")), keys, kernel)


def ordered_models(rows: DataFrame, keys: list[str], threshold: float = sm.PASS) -> DataFrame:
    """Curves of a family that don't cross, for each number of double bonds that has one; rows: ord, total_db, total_c, rt, score, rank.

    A class meets in one call with the best row of each carbon and 0.05 min. Borrowed curves go through the rows nearest to them; these
    are found among all rows by a join, so no call holds more than the time axis has room for.
    """
    series = [*keys, "total_db"]
    clean = rows.select(*series, "ord", "total_c", "rt", "score", "rank").where("total_db is not null")
    bins = F.when(~F.isnan(F.col("rt").cast("double")), F.rint(F.col("rt") / sm.BIN)).alias("_bin")
    binned = _first(clean, [*series, "total_c", bins], [*_best(), F.col("rank").isNull().alias("_r"), "rank", "ord"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable").set_index("ord", drop=False).rename_axis(None)
        groups = {int(db): g for db, g in pdf.groupby("total_db")}
        accepted = sm.observed_family(groups, threshold)
        out = []
        for db, group in groups.items():
            key, n = [pdf[k].iloc[0] for k in keys], int(group["_n"].sum())
            if db in accepted:
                curve, points = accepted[db]
                out.append((*key, db, *_row(curve, points, n), list(map(int, points.index)), [], None, None, None, None))
            elif len(accepted) >= 2 and (plan := sm.between(db, accepted)) is not None:
                coef, low, high, pair = plan
                out.append((*key, db, *[None] * 7, n, None, None, None, None, list(map(float, coef)), low, high, list(pair)))
        return pd.DataFrame(out, columns=[*keys, "total_db", *NAMES, "anchors", "removed", "_coef", "_low", "_high", "_pair"])

    schema = _schema(rows, keys)
    settled = binned.groupBy(*keys).applyInPandas(settle, f"{schema}, _coef array<double>, _low double, _high double, _pair array<long>")
    plans = settled.where("_coef is not null").select(*series, "_coef", "_low", "_high")
    # of rows at one carbon and time only the best can be the nearest
    distinct = _first(clean, [*series, "total_c", "rt"], [*_best(), "ord"]).drop("_n")
    c = F.col("total_c").cast("double")
    off = F.abs(F.col("rt") - (F.col("_coef")[0] + (F.col("_coef")[1] + F.col("_coef")[2] * c) * c))
    close = distinct.join(plans, series).where(F.col("total_c").between(F.col("_low"), F.col("_high")) & (off <= threshold)).withColumn("_off", off)
    near = _first(close, [*series, "total_c"], ["_off", *_best(), "ord"]).select(*series, "ord", "total_c", "rt", "score", "_off")

    def finish(done: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        own = done[done["_coef"].isna()].astype({"n_points": "int64", "n_original": "int64"})
        accepted = {int(r.total_db): (sm.Curve(r.kind, tuple(x for x in (r.c0, r.c1, r.c2) if not pd.isna(x)), r.carbon_min, r.carbon_max), None) for r in own.itertuples()}
        points = points.sort_values("ord", kind="stable").set_index("ord", drop=False).rename_axis(None)
        points = points.sort_values(["_off", "score"], ascending=[True, False], kind="stable")
        asked = done[~done["_coef"].isna()]
        plans = {int(db): (np.asarray(coef, float), tuple(map(int, pair)), int(n)) for db, coef, pair, n in zip(asked["total_db"], asked["_coef"], asked["_pair"], asked["n_original"], strict=True)}
        new = sm.lend(accepted, {db: (points[points.total_db == db], coef, pair) for db, (coef, pair, _) in plans.items()})
        lent = [(*(done[k].iloc[0] for k in keys), db, *_row(curve, p, plans[db][2]), list(map(int, p.index)), []) for db, (curve, p) in new.items()]
        columns = [*keys, "total_db", *NAMES, "anchors", "removed"]
        return pd.concat([own[columns].astype(object), pd.DataFrame(lent, columns=columns, dtype=object)], ignore_index=True)

    return settled.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(finish, schema)


def predicted(c: Column) -> Column:
    return F.col("c0") + F.col("c1") * c + F.coalesce("c2", F.lit(0.0)) * c * c


def evaluate(rows: DataFrame, models: DataFrame, keys: list[str], high: Column, threshold: float = sm.PASS) -> DataFrame:
    """Every row against the frozen model of its series: inside its carbons within the threshold passes (or is rescued if not high),
    else rejects; outside, or without a time, is not judged; without a model, unmodeled."""
    m = models.where(F.col("kind").isin(*sm.FITTED)).select(*keys, "total_db", "kind", "c0", "c1", "c2", "carbon_min", "carbon_max")
    joined = rows.join(m, [*keys, "total_db"], "left").withColumn("_p", predicted(F.col("total_c")))
    off = F.abs(F.col("rt") - F.col("_p"))
    valid = F.coalesce(F.col("total_c").between(F.col("carbon_min"), F.col("carbon_max")) & off.isNotNull() & ~F.isnan(off), F.lit(False))
    ok = valid & (off <= threshold + 1e-10)
    action = F.when(F.col("kind").isNull(), "unmodeled").when(~valid, "outside_domain_or_missing_rt").when(ok & high, "high_confidence_pass").when(ok, "low_confidence_rescued").otherwise("reject")
    return joined.select(*rows.columns, F.when(valid, F.col("_p")).alias("predicted_rt"), F.when(valid, off).alias("residual"), F.coalesce("kind", F.lit("insufficient_points")).alias("model_type"), action.alias("action"), F.coalesce(ok, F.lit(False)).alias("consistent"))


def legacy_actions(rows: DataFrame, models: DataFrame, keys: list[str], chain: Column, ms2_only: Column) -> DataFrame:
    """The older rule: pass within 0.5 min, suspect within 2, else reject; species and MS2-only rows aren't judged; others stay."""
    m = models.select(*keys, "total_db", "kind", "c0", "c1", "c2")
    joined = rows.join(m, [*keys, "total_db"], "left")
    fitted = F.col("kind").isin(*sm.FITTED)
    off = F.abs(F.col("rt") - predicted(F.col("total_c")))
    action = (
        F.when(ms2_only, "ms2_only_not_evaluated").when(~chain, "species_not_evaluated").when(~F.coalesce(fitted, F.lit(False)) | off.isNull(), "retain_unmodeled")
        .when(off <= sm.PASS, "pass").when(off <= sm.SUSPECT, "suspect").otherwise("reject")
    )
    judged = F.coalesce(fitted, F.lit(False)) & chain & ~ms2_only
    return joined.select(*rows.columns, F.when(judged, off).alias("residual"), F.when(judged, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - off / sm.SUSPECT))).alias("consistency"), action.alias("action"))
