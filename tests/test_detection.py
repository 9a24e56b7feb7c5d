"""Mass traces, isotopes and time alignment: planted data, plain loops, borders of stretches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.operators import detection

PEAKS = "file string, scan int, rt double, mz double, intensity double"


def plain_traces(rows, ppm, noise, snr, points):
    """Seeds by falling intensity, grown over all peaks of a file at once."""
    out = set()
    for file in {r[0] for r in rows}:
        peaks = sorted((s, m, i, t) for f, s, t, m, i in rows if f == file and None not in (s, t, m, i) and i >= noise and m > 0)
        used, scans = set(), sorted({p[0] for p in peaks})
        for seed in sorted(range(len(peaks)), key=lambda k: (-peaks[k][2], peaks[k][0], peaks[k][1])):
            if seed in used or peaks[seed][2] < noise * snr:
                continue
            used.add(seed)
            own, weight, centre = [seed], peaks[seed][2], peaks[seed][1]
            for way in (1, -1):
                last = peaks[seed][0]
                for s in [x for x in scans if (x - peaks[seed][0]) * way > 0][::way]:
                    if abs(s - last) > detection.MISSED + 1:
                        break
                    near = [k for k in range(len(peaks)) if k not in used and peaks[k][0] == s and abs(peaks[k][1] - centre) <= centre * ppm * 1e-6]
                    if near:
                        k = min(near, key=lambda k: (abs(peaks[k][1] - centre), k))
                        used.add(k)
                        own.append(k)
                        centre = (centre * weight + peaks[k][1] * peaks[k][2]) / (weight + peaks[k][2])
                        weight, last = weight + peaks[k][2], s
            if len(own) >= points:
                out.add((file, frozenset(peaks[k][:3] for k in own)))
    return out


def run_of(r, file, mz, first, count, top):
    """A planted elution of one mass, with a drift below the tolerance."""
    return [(file, first + k, (first + k) * 1.0, mz * (1 + r.uniform(-2e-6, 2e-6)), top * float(np.exp(-0.5 * ((k - count / 2) / (count / 6)) ** 2)) + 1500) for k in range(count)]


def test_traces_equal_a_plain_loop(spark):
    r = random.Random(4)
    rows = []
    for file in ("a", "b"):
        for j in range(25):
            rows += run_of(r, file, 400 + j * 0.004 * r.choice((0.3, 1, 5)), r.randrange(60), r.randrange(3, 20), r.uniform(2e4, 2e5))
        rows += [(file, r.randrange(80), 0.0, r.uniform(399.9, 400.4), r.uniform(500, 9000)) for _ in range(300)]
    rows = [(f, s, s * 1.0, round(m, 7), round(i, 3)) for f, s, _, m, i in rows] + [("a", 3, None, 400.0, 1e5), ("a", 3, 3.0, None, 1e5), ("c", 1, 1.0, 500.0, 1e6)]
    got = {}
    for x in detection.mass_traces(spark.createDataFrame(rows, PEAKS).repartition(5), ppm=10.0, noise=1000.0, snr=5.0).collect():
        got.setdefault((x.file, x.trace), []).append((x.scan, x.mz, x.intensity))
    assert {(f, frozenset(v)) for (f, _), v in got.items()} == plain_traces(rows, 10.0, 1000.0, 5.0, 3)
    assert len(got) > 30 and detection.mass_traces(spark.createDataFrame([], PEAKS)).count() == 0


def test_planted_features(spark):
    """Two elutions of one mass and the isotopes of a doubly charged ion, found whole wherever the axis is cut."""
    r = random.Random(2)
    rows = run_of(r, "a", 500.0, 10, 30, 2e5) + run_of(r, "a", 500.0, 60, 30, 1e5)
    for k, share in enumerate((1.0, 0.6, 0.3)):
        rows += run_of(r, "a", 700.2 + k * detection.ISOTOPE / 2, 30, 30, 2e5 * share)
    traces = detection.mass_traces(spark.createDataFrame(rows, PEAKS))
    found = detection.segments(traces).withColumn("key", F.concat_ws("@", "trace", F.col("rt").cast("string")))
    out = found.join(detection.isotopes(found, "key"), ["file", "key"]).collect()
    assert sorted((round(x.mz, 1), x.charge, x.place) for x in out) == [(500.0, 0, 0), (500.0, 0, 0), (700.2, 0, 0), (700.7, 2, 1), (701.2, 2, 2)]
    assert len({x.feature for x in out if x.mz > 600}) == 1
    first, second = sorted((x for x in out if x.mz < 600), key=lambda x: x.rt)
    assert abs(first.rt - 25) <= 1.5 and abs(second.rt - 75) <= 1.5 and first.rt_max <= second.rt_min


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1.03, -12.0), (0.96, 25.0)])
def test_planted_maps_are_recovered(spark, scale, shift):
    r = random.Random(9)
    base = [(400 + r.uniform(0, 400), r.uniform(30, 900), r.uniform(1e3, 1e6)) for _ in range(400)]
    rows = [("ref", m, t, i) for m, t, i in base]
    rows += [("x", m * (1 + r.uniform(-3e-6, 3e-6)), (t - shift) / scale + r.gauss(0, 0.5), i) for m, t, i in base if r.random() < 0.8] + [("x", 400 + r.uniform(0, 400), r.uniform(30, 900), 5e5) for _ in range(150)]
    rows += [("alone", 99.0, 10.0, 1.0), ("x", 99.5, 100.0, 0.1)]
    df = spark.createDataFrame(rows, "sample string, mz double, rt double, intensity double")
    maps = detection.poses(df, "sample", F.col("sample") == "ref", most=300)
    (m,) = maps.collect()
    assert m["sample"] == "x" and m.votes > 50
    assert all(abs(m["scale"] * t + m["shift"] - (scale * t + shift)) < 3.0 for t in (50, 400, 850))
    out = {(x["sample"], x.mz): x for x in detection.aligned(df, "sample", maps).collect()}
    assert out["alone", 99.0].aligned_rt == 10.0 and abs(out["x", 99.5].aligned_rt - (m["scale"] * 100 + m["shift"])) < 1e-9 and len(out) == len(rows)


def test_traces_of_a_whole_table_equal_a_plain_loop(spark):
    from spectralake.plans.detection import trace_peaks

    peaks = trace_peaks(spark, "/root/testdata/sf0.001")
    got = {}
    for x in detection.mass_traces(peaks, ppm=10.0, noise=2000.0, snr=5.0).collect():
        got.setdefault((x.file, x.trace), []).append((x.scan, x.mz, x.intensity))
    want = plain_traces([tuple(x) for x in peaks.collect()], 10.0, 2000.0, 5.0, 3)
    assert {(f, frozenset(v)) for (f, _), v in got.items()} == want
