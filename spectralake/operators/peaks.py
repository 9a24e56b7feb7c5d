"""Chromatographic peaks as grouped operators: a trace is a row of arrays, so every kernel sees one trace and nothing is sorted apart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralake.functions import chroma


def as_traces(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """One row for each group: arrays ``times`` and ``values`` by rising time; of points at one time the largest value counts."""
    once = rows.groupBy(*keys, time).agg(F.max(value).alias("_v"))
    listed = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col("_v").cast("double").alias("v")))).alias("_p"))
    return listed.select(*keys, F.transform("_p", lambda p: p["t"]).alias("times"), F.transform("_p", lambda p: p["v"]).alias("values"))


def _schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def resolved(traces: DataFrame, keys: list[str], sn: float = 5.0, least_height: float = 0.0, ratio: float = 0.65, points: int = 3) -> DataFrame:
    """Peaks of each trace: apex, left and right time, height, snr, area, corrected area, kinds of edges. ``anchors`` is used if there."""
    anchored = "anchors" in traces.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                t = np.asarray(row.times)
                for p in chroma.resolve(t, row.values, sn, least_height, ratio, points, (row.anchors if row.anchors is not None else ()) if anchored else ()):
                    out.append((*(getattr(row, k) for k in keys), t[p.apex], t[p.left], t[p.right], p.height, p.snr, p.area, p.corrected, p.left_kind, p.right_kind))
            yield pd.DataFrame(out, columns=[*keys, "apex_rt", "left_rt", "right_rt", "height", "snr", "area", "area_corrected", "left_kind", "right_kind"])

    chosen = traces.select(*keys, "times", "values", *(["anchors"] if anchored else []))
    return chosen.mapInPandas(work, _schema(traces, keys) + "apex_rt double, left_rt double, right_rt double, height double, snr double, area double, area_corrected double, left_kind string, right_kind string")


def repaired(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Detector intervals (rt, lower, upper, apices) on their traces, repaired; ``reason`` says how or why not."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                t = np.asarray(row.times)
                p, reason = chroma.repair_bounds(t, row.values, row.rt, row.lower, row.upper, row.apices)
                found = (t[p.left], t[p.right], p.height, p.area, p.corrected) if p else (None,) * 5
                out.append((*(getattr(row, k) for k in keys), *found, reason))
            yield pd.DataFrame(out, columns=[*keys, "left_rt", "right_rt", "height", "area", "area_corrected", "reason"])

    return traces.select(*keys, "times", "values", "rt", "lower", "upper", "apices").mapInPandas(work, _schema(traces, keys) + "left_rt double, right_rt double, height double, area double, area_corrected double, reason string")


def splits(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Regions within (lower, upper) that hold a separate top which no apex in ``apices`` stands for."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*(getattr(r, k) for k in keys), *region) for r in pdf.itertuples(index=False) for region in chroma.split_regions(r.times, r.values, r.lower, r.upper, r.apices)]
            yield pd.DataFrame(out, columns=[*keys, "left_rt", "right_rt", "apex_rt"])

    return traces.select(*keys, "times", "values", "lower", "upper", "apices").mapInPandas(work, _schema(traces, keys) + "left_rt double, right_rt double, apex_rt double")


def memberships(traces: DataFrame, keys: list[str], sn: float = 3.0) -> DataFrame:
    """For each seed of a trace (``seeds``: array of scan and time) the resolved peak that contains it, nearest apex first."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                t = np.asarray(row.times)
                found = chroma.resolve(t * 60, row.values, sn)
                encoded = json.dumps([float(t[p.apex]) for p in found], separators=(",", ":"))
                for s in row.seeds:
                    inside = [p for p in found if t[p.left] <= s["time"] <= t[p.right]]
                    best = min(inside, key=lambda p: abs(t[p.apex] - s["time"]), default=None)
                    apex = None if best is None else float(t[best.apex])
                    out.append((*(getattr(row, k) for k in keys), s["scan"], apex, "" if apex is None else f"{apex:.8f}", encoded, "no_resolved_eic_peak" if apex is None else "raw_eic_valley_bounded_peak"))
            yield pd.DataFrame(out, columns=[*keys, "scan", "apex_rt", "peak_id", "apices_json", "status"])

    kind = traces.schema["seeds"].dataType.elementType["scan"].dataType.simpleString()
    return traces.select(*keys, "times", "values", "seeds").mapInPandas(work, _schema(traces, keys) + f"scan {kind}, apex_rt double, peak_id string, apices_json string, status string")


def shapes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Shape comparison of two traces in one row (times_a, values_a, times_b, values_b)."""
    fields = ("status", "pearson", "cosine", "apex_difference", "active_points")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                got = chroma.compare_shapes(r.times_a, r.values_a, r.times_b, r.values_b)
                out.append((*(getattr(r, k) for k in keys), *(got.get(f) for f in fields)))
            yield pd.DataFrame(out, columns=[*keys, *fields])

    return pairs.select(*keys, "times_a", "values_a", "times_b", "values_b").mapInPandas(work, _schema(pairs, keys) + "status string, pearson double, cosine double, apex_difference double, active_points double")


def isotopes(rows: DataFrame, mz: str, intensity: str, target: str, charge: str, centroided: str) -> DataFrame:
    """Adds status and peaks (offset, mz, intensity, relative) of a precursor: the only peak within 15 ppm, then up to three isotopes.

    An isotope is taken where just one peak is near; several make the snapshot partial. Arrays need not be sorted. Done in steps, so
    that each window is looked through once.
    """
    pairs = F.filter(F.arrays_zip(F.col(mz).alias("m"), F.col(intensity).alias("i")), lambda p: ~F.isnan(p["m"]) & ~F.isnan(p["i"]) & (p["i"] > 0))
    near = lambda mass: F.filter("_pairs", lambda p: (p["m"] >= mass - mass * chroma.ISOTOPE_PPM * 1e-6) & (p["m"] <= mass + mass * chroma.ISOTOPE_PPM * 1e-6))
    out = rows.withColumn("_pairs", pairs).withColumn("_anchor", near(F.col(target))).withColumn("_a", F.get("_anchor", F.lit(0)))
    step = F.try_divide(F.lit(chroma.ISOTOPE_SPACING), F.abs(charge))
    out = out.withColumns({f"_w{k}": near(F.col("_a.m") + k * step) for k in (1, 2, 3)})
    one = lambda k: F.when(F.size(f"_w{k}") == 1, F.struct(F.lit(k).alias("offset"), F.get(f"_w{k}", F.lit(0))["m"].alias("mz"), F.get(f"_w{k}", F.lit(0))["i"].alias("intensity")))
    found = F.filter(F.array(F.struct(F.lit(0).alias("offset"), F.col("_a.m").alias("mz"), F.col("_a.i").alias("intensity")), *map(one, (1, 2, 3))), lambda p: p.isNotNull())
    several = (F.size("_w1") > 1) | (F.size("_w2") > 1) | (F.size("_w3") > 1)
    status = (
        F.when(~F.col(centroided), "profile_ms1").when(F.coalesce(charge, F.lit(0)) == 0, "charge_unknown").when(F.coalesce(target, F.lit(0.0)) <= 0, "precursor_peak_missing")
        .when(F.size("_anchor") == 0, "precursor_peak_missing").when(F.size("_anchor") > 1, "ambiguous_precursor").when(several, "partial").otherwise("ok")
    )
    out = out.withColumns({"_found": found, "status": status}).withColumn("_top", F.array_max(F.transform("_found", lambda p: p["intensity"])))
    listed = F.transform("_found", lambda p: F.struct(p["offset"].alias("offset"), p["mz"].alias("mz"), p["intensity"].alias("intensity"), (p["intensity"] / F.col("_top") * 100).alias("relative")))
    out = out.withColumn("peaks", F.when(F.col("status").isin("ok", "partial"), listed))
    return out.drop("_pairs", "_anchor", "_a", "_w1", "_w2", "_w3", "_found", "_top")
