"""Refinement of feature maps: planted peaks over bin borders, edge cases, and a plain loop over a whole table."""

import math
from collections import defaultdict

import numpy as np
import pytest

from spectralake.functions import chroma
from spectralake.operators import refinement

FEATURES = "file string, feature long, mz double, rt double, lower double, upper double, area double, extra string, times double"
POINTS = "file string, rt double, mz double, intensity double, apices string"


def plain_map(features, points, scans, ppm, redetected=()):
    """(origin, feature) -> (left, right, area or None, reason), every feature looked up in whole lists."""
    times, peaks = defaultdict(set), defaultdict(list)
    for file, t in scans:
        times[file].add(t)
    for file, t, m, i in points:
        peaks[file, t].append((m, i))

    def drawn(f, everything):
        file, _, mz, _, lower, upper = f[1:7]
        every = sorted(times[file])
        cadence = float(np.median(np.diff(every))) if len(every) > 1 else 1.0
        pad = max(6 * cadence, min(15.0, 0.25 * (upper - lower)))
        apices = {o[4] for o in everything if o[1] == file and abs(o[3] - mz) <= mz * ppm * 1e-6 and lower - (upper - lower) - pad <= o[4] <= upper + (upper - lower) + pad}
        begin, end = max(0.0, min([lower - pad, *apices])), max([upper + pad, *apices])
        own = [t for t in every if begin <= t <= end]
        values = []
        for t in own:
            near = min(((abs(m - mz), m, i) for m, i in peaks[file, t] if abs(m - mz) <= mz * ppm * 1e-6), default=(0, 0, 0.0))
            values.append(near[2] if near[2] is not None and 0 <= near[2] < math.inf else 0.0)
        return np.array(own), np.array(values), [a for a in apices if own and own[0] <= a <= own[-1]]

    everything = [("detector", *f) for f in features]
    whole = lambda f: f[5] is not None and f[6] is not None and f[5] < f[6]
    chosen = {}
    for f in filter(whole, everything):
        t, v, apices = drawn(f, everything)
        for left, right, _ in chroma.split_regions(t, v, f[5], f[6], apices):
            inside = [c for c in redetected if c[0] == f[1] and abs(c[2] - f[3]) <= f[3] * ppm * 1e-6 and left < c[3] < right]
            if len(inside) == 1:
                chosen.setdefault(inside[0], set()).add(f[2])
    everything += [("split", *c) for c in chosen]
    out = {}
    for f in everything:
        peak, reason, t = None, "missing_detector_bounds", None
        if whole(f):
            t, v, apices = drawn(f, everything)
            peak, reason = chroma.repair_bounds(t, v, f[4], f[5], f[6], apices)
        parent = min(chosen[f[1:]]) if f[0] == "split" else None
        out[f[0], f[1], f[2]] = (parent, reason, *((t[peak.left], t[peak.right], round(peak.area, 2)) if peak else (None, None, f[7])))
    return out


def got_map(rows):
    return {(x.origin, x.file, x.feature): (x.parent, x.reason, x.left_rt, x.right_rt, round(x.area, 2) if x.area is not None and x.status == "confirmed" else x.area) for x in rows}


def test_planted_peaks_over_borders_of_bins_are_measured_whole(spark):
    scans = [(f, float(t)) for f in ("a", "b") for t in range(0, 300, 2)]
    points, features = [], []
    for n, (file, mz, tops) in enumerate([("a", 500.0, (118.0, 160.0)), ("a", 499.9999, ()), ("b", 500.0, (120.0,)), ("a", 600.1, (240.0, 261.0))]):
        for f, t in scans:
            high = sum(9000 * math.exp(-(((t - x) / 5) ** 2)) for x in tops)
            if f == file and high > 1:
                points.append((f, t, mz * (1 + (t % 7 - 3) * 1e-6), 20 + high, "clash"))
        if n != 3:
            features += [(file, 10 * n + i, mz, x, x - 8, x + 8, 1.0, "x", 0.0) for i, x in enumerate(tops)]
    # one feature over two tops: the second comes from the other pass; then features without bounds, scans or keys, and a repeated one
    features += [("a", 30, 600.1, 240.0, 225.0, 275.0, 5.0, None, None), ("a", 40, 600.1, 20.0, None, 3.0, 7.0, None, None), ("a", 41, 500.0, 50.0, 60.0, 40.0, 8.0, None, None), ("c", 42, 500.0, 50.0, 40.0, 60.0, 9.0, None, None)]
    nulls = [(None, 1, 5.0, 5.0, 1.0, 9.0, 1.0, None, None), ("a", None, 5.0, 5.0, 1.0, 9.0, 1.0, None, None), ("a", 50, None, 5.0, 1.0, 9.0, 1.0, None, None), ("a", 51, 5.0, float("nan"), 1.0, 9.0, 1.0, None, None), features[0]]
    again = [("a", 7, 600.1, 261.0, 252.0, 270.0, 3.0, "y", None), ("a", 8, 600.2, 261.0, 252.0, 270.0, 3.0, "y", None)]
    points += [("a", 118.0, 500.0, None, None), ("a", None, 500.0, 1.0, None), ("b", 200.0, 500.0, float("nan"), None), ("b", 202.0, 500.0, -5.0, None)]
    table = lambda rows: spark.createDataFrame(rows, FEATURES)
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame([*scans, scans[0], (None, 1.0), ("a", None)], "file string, rt double")
    out = refinement.refined_map(table(features + nulls), p, s, 10.0, table(again)).collect()
    got = got_map(out)
    clean = [x[:4] for x in points if x[1] is not None]
    assert got == plain_map([f[:7] for f in features], clean, scans, 10.0, [x[:7] for x in again]) and len(out) == len(got)
    assert got["split", "a", 7][0] == 30 and got["split", "a", 7][2] is not None and ("split", "a", 8) not in got
    assert [got["detector", *x][1] for x in (("a", 40), ("a", 41), ("c", 42))] == ["missing_detector_bounds"] * 2 + ["insufficient_ms1_scans_for_boundary"]
    assert got["detector", "c", 42][4] == 9.0 and got["detector", "a", 0][2] < 118 < got["detector", "a", 0][3] < 160
    near = {(x.origin, x.feature): x.neighbour for x in out}
    assert near["split", 7] == pytest.approx(21.0)


def test_empty_tables(spark):
    none = refinement.refined_map(spark.createDataFrame([], FEATURES), spark.createDataFrame([], POINTS), spark.createDataFrame([], "file string, rt double"), 10.0, spark.createDataFrame([], FEATURES))
    assert none.count() == 0 and {"status", "reason", "left_rt", "area"} <= set(none.columns)


def test_refined_features_equal_a_plain_loop(spark):
    from spectralake.plans import detection as plans

    d = "/root/testdata/sf0.001"
    features, points, scans, more = plans.map_parts(spark, d)
    columns = ["file", "feature", "mz", "rt", "lower", "upper", "area"]
    f, p, s, m = ([tuple(x) for x in df.collect()] for df in (features.select(columns), points.select("file", "rt", "mz", "intensity"), scans.select("file", "rt"), more.select(columns)))
    got = got_map(plans.refined_features(spark, d).collect())
    assert got == plain_map(f, p, s, 20.0, m) and len(got) >= len(f) > 10
