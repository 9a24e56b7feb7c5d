"""Chromatogram kernels: planted peaks, valleys, gaps and bounds; operators over traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.functions import chroma
from spectralake.operators import clusters, peaks


def bell(t, middle, width, height=1.0):
    return height * np.exp(-0.5 * ((t - middle) / width) ** 2)


def test_two_peaks_share_the_valley():
    t = np.arange(0, 80, 1.36)
    y = bell(t, 30, 1, 8500) + bell(t, 38, 1, 18500)
    a, b = chroma.resolve(t, y, least_height=3000)
    assert t[a.apex] < 32 and t[b.apex] > 36 and a.right == b.left and 32 < t[b.left] < 36
    for p in (a, b):
        assert p.area == pytest.approx(np.trapezoid(y[p.left : p.right + 1], t[p.left : p.right + 1]))


def test_a_weak_neighbour_bounds_a_tall_peak_and_a_notch_does_not_split_one():
    t = np.arange(80.0)
    (one,) = chroma.resolve(t, bell(t, 30, 2, 1800) + bell(t, 40, 2, 18000), least_height=3000)
    assert 32 < t[one.left] < 38
    y = bell(t, 40, 8, 10000)
    y[40] *= 0.8
    (one,) = chroma.resolve(t, y, least_height=3000)
    assert t[one.left] < 30 and t[one.right] > 50


def test_what_is_no_peak():
    t = np.arange(80.0)
    spike, two = np.zeros(80), np.zeros(80)
    spike[40], two[40:42] = 1e4, 1e4
    for y in (np.full(80, 1e4), spike, two, bell(np.arange(80.0), 0, 15, 1e4)):
        assert chroma.resolve(t, y, least_height=3000) == []
    gap = np.delete(np.arange(80.0), slice(38, 46))
    assert chroma.resolve(gap, bell(gap, 40, 5, 1e4), least_height=3000) == []
    assert chroma.resolve(t[:4], t[:4]) == []


def test_tops_have_the_asked_prominence():
    y = np.array([0, 3, 1, 5, 5, 2, 4, 0.0, 1, 0.5])
    assert chroma.tops(y, 0.1) == [1, 3, 6, 8]
    assert chroma.tops(y, 2.0) == [1, 3, 6] and chroma.tops(y, 3.0) == [3]
    assert chroma.tops(np.zeros(9), 0.0) == []


def test_a_neighbouring_apex_must_be_separated():
    t = np.arange(80.0)
    apart = bell(t, 30, 3, 9000) + bell(t, 52, 3, 4000) + 20
    peak, reason = chroma.repair_bounds(t, apart, 30.0, 20.0, 60.0, [30.0, 52.0])
    assert reason == "detector_interval_locally_repaired" and 38 <= t[peak.right] < 52
    merged = bell(t, 30, 6, 9000) + bell(t, 34, 6, 8000) + 20
    assert chroma.repair_bounds(t, merged, 30.0, 20.0, 50.0, [30.0, 34.0]) == (None, "neighboring_detector_apex_not_separated")
    assert chroma.repair_bounds(t[:3], merged[:3], 1.0, 0.0, 2.0, [1.0])[1] == "insufficient_ms1_scans_for_boundary"


def test_split_regions_leave_known_apices_out():
    t = np.arange(80.0)
    y = bell(t, 25, 3, 9000) + bell(t, 50, 3, 5000) + 20
    regions = chroma.split_regions(t, y, 10.0, 70.0, [25.0])
    assert [r[2] for r in regions] == [50.0] and chroma.split_regions(t, y, 10.0, 70.0, [25.0, 50.0]) == []


def test_shapes():
    t = np.arange(31) * 0.01
    x = np.arange(31.0)
    same = chroma.compare_shapes(t, bell(x, 15, 4), t, 3 * bell(x, 15, 4))
    assert same["status"] == "supported" and same["pearson"] == pytest.approx(1) and same["cosine"] == pytest.approx(1)
    assert chroma.compare_shapes(t, bell(x, 15, 4), t, bell(x, 25, 2))["status"] in ("shape_disagreement", "insufficient_peak_edges")
    assert chroma.compare_shapes(t, x * 0, t, x)["status"] == "no_signal" and chroma.compare_shapes(t, x * 0 + 1, t, x)["status"] == "flat_signal"
    assert chroma.compare_shapes(t, x, t + 1, x)["status"] == "different_scan_times" and chroma.compare_shapes(None, x, t, x)["status"] == "insufficient_points"


def test_traces_in_spark(spark):
    t = np.arange(80.0)
    rows = [(k, float(a), float(v)) for k in (1, 2) for a, v in zip(t, bell(t, 30 + k, 3, 9000) + 20, strict=True)]
    traces = peaks.as_traces(spark.createDataFrame(rows, "k long, t double, v double"), ["k"], "t", "v")
    found = {r.k: r.apex_rt for r in peaks.resolved(traces, ["k"]).collect()}
    assert found == {1: 31.0, 2: 32.0}
    seeds = traces.withColumn("seeds", F.array(F.struct(F.lit("a").alias("scan"), F.lit(33.0).alias("time")), F.struct(F.lit("b").alias("scan"), F.lit(70.0).alias("time"))))
    got = {(r.k, r.scan): (r.apex_rt, r.status) for r in peaks.memberships(seeds, ["k"]).collect()}
    assert got[1, "a"] == (31.0, "raw_eic_valley_bounded_peak") and got[2, "b"] == (None, "no_resolved_eic_peak")


def test_cohorts_keep_mass_time_and_peak_identity(spark):
    rows = [("+", "a", "1", 500.0, 1.00, "p1"), ("+", "b", "1", 500.002, 1.05, "q1"), ("+", "b", "2", 500.002, 1.06, "q2"), ("+", "c", "1", 500.02, 1.0, ""), ("-", "a", "2", 500.0, 1.0, ""), ("+", "d", "1", 500.001, 1.5, None), ("+", "a", "9", None, 1.0, "")]
    got = {(r.source, r.scan): r.cohort for r in clusters.cohorts(spark.createDataFrame(rows, "mode string, source string, scan string, mz double, rt double, peak string")).collect()}
    assert got["a", "1"] == got["b", "1"] != got["b", "2"] and len(set(got.values())) == 5 and ("a", "9") not in got


def test_leaders_follow_running_medians(spark):
    rows = [("x", 500.0, 1.0, 1), ("x", 500.003, 1.2, 2), ("x", 500.02, 1.3, 3), ("x", 500.001, 1.9, 4), ("x", 500.001, 2.6, 5), ("y", 500.0, 1.0, 6)]
    got = {r.o: (r.n, r.cluster) for r in clusters.leaders(spark.createDataFrame(rows, "n string, mz double, rt double, o long"), ["n"], "o").collect()}
    assert got[1] == got[2] and got[1] != got[3] and got[4] != got[1] and got[5] != got[4] and got[6][0] == "y"


def test_consensus_groups_have_one_peak_of_each_sample(spark):
    rows = [(0, 1, 500.0, 100.0, 1), (1, 2, 500.002, 104.0, 1), (1, 3, 500.002, 108.0, 1), (2, 4, 500.001, 101.0, 0), (2, 5, 500.001, 101.0, 2), (0, 6, 500.0, 300.0, 1), (1, 7, 510.0, 100.0, 1)]
    got = {r.feature: r.group for r in clusters.consensus_groups(spark.createDataFrame(rows, "sample long, feature long, mz double, rt double, charge long")).collect()}
    # the two peaks of sample 1 are 4 s apart, so their limit is 1.8 s
    assert got[1] == got[4] and got[2] != got[1] and got[6] != got[1] and len({got[k] for k in (1, 2, 3, 5, 6, 7)}) == 6


def test_stretches_separate_what_cannot_touch(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 1.05, 1.2, 3.0, 3.3, 9.0)] + [("b", 1.0), ("a", None), (None, 2.0)], "k string, v double")
    got = clusters.with_stretch(rows, ["k"], F.col("v"), 0.5).collect()
    by = {(r.k, r.v): r.stretch for r in got}
    assert len(got) == 9 and by["a", 1.0] == by["a", 1.2] != by["a", 3.0] == by["a", 3.3] != by["a", 9.0] and by["a", None] is None and by[None, 2.0] == 1
