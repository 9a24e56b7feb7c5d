"""Feature detection: mass traces grown from intense peaks, elution segments, isotope traces assembled to features; time alignment by votes.

Traces are grown scan by scan, so a file's peaks are dealt by stretches of the mass axis: what lies further apart than the tolerance can't
meet in a trace, so stretches between gaps are independent and nothing at a border comes out twice. Isotopes are relations between
segments, found by an interval join, and each segment's lightest ancestor is its feature. Alignment is a histogram of maps that pairs
of matched anchors speak for.

Peaks with null masses, times or intensities are left out; repeated peaks of a scan may each be in a trace. Of equal
intensities the peak of the earlier scan, then of the smaller mass, comes first. Empty tables give empty tables.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.functions import chroma
from spectralake.operators.clusters import with_stretch
from spectralake.operators.joins import interval_join
from spectralake.session import reliable

#: Mass of a 13C isotope over 12C; consecutive scans without a peak that end a trace.
ISOTOPE, MISSED = 1.00335483507, 5


def grow(scan: np.ndarray, mz: np.ndarray, intensity: np.ndarray, ppm: float, least: float, missed: int = MISSED) -> np.ndarray:
    """The trace of each peak (-1: none), numbered by falling intensity of their seeds.

    The most intense free peak of at least ``least`` starts a trace; in either direction each scan gives the free peak that is nearest
    to the running intensity-weighted mass, within its tolerance; ``missed`` scans without one end it. Rows are in order of scan and mass.
    """
    n = len(mz)
    scans, starts = np.unique(scan, return_index=True)
    ends = np.append(starts[1:], n).tolist()
    order, at = np.lexsort((mz, scan, -intensity)).tolist(), np.searchsorted(scans, scan).tolist()
    scans, starts, mz, intensity = scans.tolist(), starts.tolist(), mz.tolist(), intensity.tolist()
    # from each place the next free one, itself included, to the right and (shifted by one) to the left: equal masses are never passed through one by one
    right, left = list(range(n + 1)), list(range(n + 1))
    trace = [-1] * n

    def free(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = i = links[links[i]]
        return i

    number = 0
    for seed in order:
        if trace[seed] >= 0 or intensity[seed] < least:
            continue
        trace[seed], right[seed], left[seed + 1] = number, seed + 1, seed
        weight, centre = intensity[seed], mz[seed]
        for way in (1, -1):
            k, last = at[seed] + way, scans[at[seed]]
            while 0 <= k < len(scans) and abs(scans[k] - last) <= missed + 1:
                width = centre * ppm * 1e-6
                middle = bisect_left(mz, centre, starts[k], ends[k])
                above, below = free(right, middle), free(left, middle) - 1
                near = above if above < ends[k] and mz[above] <= centre + width else -1
                if below >= starts[k] and mz[below] >= centre - width and (near < 0 or centre - mz[below] <= mz[near] - centre):
                    # the first of equal masses
                    near = free(right, bisect_left(mz, mz[below], starts[k], middle))
                if near >= 0:
                    trace[near], right[near], left[near + 1] = number, near + 1, near
                    centre = (centre * weight + mz[near] * intensity[near]) / (weight + intensity[near])
                    weight, last = weight + intensity[near], scans[k]
                k += way
        number += 1
    return np.array(trace, np.int64)


def mass_traces(peaks: DataFrame, ppm: float = 10.0, noise: float = 1000.0, snr: float = 5.0, points: int = 3) -> DataFrame:
    """One row for each peak in a trace: file, trace (unique in its file), scan, rt, mz, intensity.

    Peaks: file, scan (number in order of acquisition), rt, mz, intensity. Peaks below ``noise`` are no signal; a trace starts at
    ``noise`` * ``snr`` and has at least ``points`` peaks.
    """
    known = F.lit(True)
    for c in ("mz", "rt", "intensity", "scan"):
        known = known & F.col(c).isNotNull()
    used = peaks.where(known & (F.col("intensity") >= noise) & (F.col("mz") > 0)).select("file", "scan", "rt", "mz", "intensity")
    # a running mass can drift by its tolerance, and masses within it are one stretch
    axis = F.log(F.col("mz"))
    placed = with_stretch(used, ["file"], axis, -float(np.log1p(-ppm * 1e-6)) * 1.001)
    kinds = {f.name: f.dataType.simpleString() for f in used.schema}

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(pdf["_g"].to_numpy(), prepend=pdf["_g"].iloc[0] + 1, append=pdf["_g"].iloc[-1] + 1))
        scan, mz, intensity = pdf["scan"].to_numpy(), pdf["mz"].to_numpy(float), pdf["intensity"].to_numpy(float)
        number = np.full(len(pdf), -1, np.int64)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo >= points and intensity[lo:hi].max() >= noise * snr:
                own = grow(scan[lo:hi], mz[lo:hi], intensity[lo:hi], ppm, noise * snr)
                many = np.bincount(own[own >= 0], minlength=1)
                number[lo:hi] = np.where((own >= 0) & (many[own] >= points), own, -1)
        kept = pdf[number >= 0]
        return kept.assign(trace=kept["stretch"].astype(str) + ":" + number[number >= 0].astype(str))[["file", "trace", "scan", "rt", "mz", "intensity"]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # stretches come whole and sorted; the last one of a batch may go on in the next
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["_g"].to_numpy() == pdf["_g"].iloc[-1]
            if rest and (not last.all() or rest[-1]["_g"].iloc[-1] != pdf["_g"].iloc[-1]):
                yield grown(pd.concat([*rest, pdf[~last]]))
                rest = []
            elif not rest and not last.all():
                yield grown(pdf[~last])
            rest.append(pdf[last])
        if rest:
            yield grown(pd.concat(rest))

    shape = f"file {kinds['file']}, trace string, scan {kinds['scan']}, rt {kinds['rt']}, mz {kinds['mz']}, intensity {kinds['intensity']}"
    dealt = placed.withColumn("_g", F.xxhash64("file", "stretch")).repartition("_g").sortWithinPartitions("_g", "scan", "mz", "intensity")
    return dealt.select("_g", "file", "stretch", "scan", "rt", "mz", "intensity").mapInPandas(work, shape)


def segments(traces: DataFrame, snr: float = 5.0, least_height: float = 0.0) -> DataFrame:
    """Elution segments of the traces: file, trace, mz (intensity-weighted within the segment), rt (apex), rt_min, rt_max, height, area."""
    kinds = {f.name: f.dataType.simpleString() for f in traces.schema}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.groupby("rt", as_index=False).agg(intensity=("intensity", "max")).sort_values("rt")
        rt, y = t["rt"].to_numpy(float), t["intensity"].to_numpy(float)
        out = []
        for p in chroma.resolve(rt, y, sn=snr, least_height=least_height):
            own = pdf[(pdf["rt"] >= rt[p.left]) & (pdf["rt"] <= rt[p.right])]
            out.append((pdf["file"].iloc[0], pdf["trace"].iloc[0], float(np.average(own["mz"], weights=own["intensity"])), rt[p.apex], rt[p.left], rt[p.right], p.height, p.area))
        return pd.DataFrame(out, columns=["file", "trace", "mz", "rt", "rt_min", "rt_max", "height", "area"])

    return traces.groupBy("file", "trace").applyInPandas(work, f"file {kinds['file']}, trace string, mz double, rt double, rt_min double, rt_max double, height double, area double")


def isotopes(rows: DataFrame, key: str, ppm: float = 10.0, seconds: float = 8.0, charges: int = 2, steps: int = 5) -> DataFrame:
    """Segments with their feature: file, key, feature (key of the lightest ancestor), charge (0 without isotopes), place (0: monoisotopic).

    Rows: file, key, mz, rt, rt_min, rt_max, height. A segment's parent is one isotope step lighter for a charge, elutes within
    ``seconds`` and overlaps it, and is no weaker; of several the one at the shorter step, the strongest, the nearest in time, the least
    key. A chain goes on only with the charge that it began with and has at most ``steps`` steps.
    """
    step = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(ISOTOPE / z).alias("d")) for z in range(1, charges + 1)]))
    light = rows.select("file", F.col(key).alias("parent"), F.col("mz").alias("m0"), F.col("rt").alias("t0"), F.col("rt_min").alias("a0"), F.col("rt_max").alias("b0"), F.col("height").alias("h0"), step.alias("s")).select("*", "s.z", (F.col("m0") + F.col("s.d")).alias("at")).drop("s")
    heavy = rows.select("file", F.col(key).alias("child"), F.col("mz").alias("m1"), F.col("rt").alias("t1"), F.col("rt_min").alias("a1"), F.col("rt_max").alias("b1"), F.col("height").alias("h1"))
    width = F.col("at") * ppm * 1e-6
    # tables that compress well look small enough to broadcast, and pass through the driver then: segments are shuffled on both sides
    near = interval_join(light, heavy.hint("merge"), F.col("at") - width, F.col("at") + width, F.col("m1"), 0.05, on=["file"])
    fits = (F.abs(F.col("t0") - F.col("t1")) <= seconds) & (F.col("a0") <= F.col("b1")) & (F.col("a1") <= F.col("b0")) & (F.col("h1") <= F.col("h0"))
    best = F.min_by(F.struct("parent", "z"), F.struct((-F.col("z")).alias("z"), (-F.col("h0")).alias("h"), F.abs(F.col("t0") - F.col("t1")).alias("t"), F.col("parent").alias("p")))
    link = near.where(fits).groupBy("file", "child").agg(best.alias("b")).select("file", "child", F.col("b.parent").alias("parent"), F.col("b.z").alias("z"))
    reliable(rows.sparkSession)
    link = link.checkpoint()
    # a chain goes on only with the charge that it began with
    at = rows.select("file", F.col(key).alias("key")).join(link.withColumnRenamed("child", "key").hint("merge"), ["file", "key"], "left")
    at = at.select("file", "key", F.coalesce("parent", "key").alias("feature"), F.coalesce("z", F.lit(0)).alias("charge"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("place"))
    up = link.select("file", F.col("child").alias("feature"), F.col("parent").alias("_up"), F.col("z").alias("_z")).hint("merge")
    for _ in range(steps - 1):
        moved = at.join(up, ["file", "feature"], "left")
        goes = F.col("_up").isNotNull() & (F.col("_z") == F.col("charge")) & (F.col("place") > 0)
        at = moved.select("file", "key", F.when(goes, F.col("_up")).otherwise(F.col("feature")).alias("feature"), "charge", (F.col("place") + F.when(goes, 1).otherwise(0)).alias("place"))
    return at


def anchors(features: DataFrame, sample: str, most: int = 1000) -> DataFrame:
    """The ``most`` strongest features of each sample: they bound the estimate of a map, never what it is applied to."""
    w = Window.partitionBy(sample).orderBy(F.desc("intensity"), "mz", "rt")
    return features.select(sample, "mz", "rt", "intensity").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r", "intensity")


def poses(features: DataFrame, sample: str, reference: Column, ppm: float = 10.0, seconds: float = 60.0, most: int = 1000, ahead: int = 10, scale_bin: float = 0.01, shift_bin: float = 2.0) -> DataFrame:
    """(sample, scale, shift, votes): the map of times to the reference's (``reference`` says which rows are) that most pairs of anchors vote for.

    Anchors of a sample meet those of the reference by mass, and by time before alignment. Each match is paired with the next ``ahead``
    ones in order of time; a pair speaks for one map, in a histogram of scale and shift at the middle of the reference's times. The best
    bin is the one of most votes (then of the scale nearest to 1, of the least shift); its votes are averaged. Samples without a vote are missing.
    """
    chosen = anchors(features, sample, most)
    ref = anchors(features.where(reference), sample, most).select(F.col("mz").alias("r_mz"), F.col("rt").alias("r_rt"))
    own = chosen.join(features.where(reference).select(sample).distinct(), sample, "left_anti")
    middle = ref.agg(F.avg("r_rt").alias("_mid"))
    width = F.col("mz") * ppm * 1e-6
    met = interval_join(own, ref, F.col("mz") - width, F.col("mz") + width, F.col("r_mz"), 0.02).where(F.abs(F.col("rt") - F.col("r_rt")) <= seconds)
    w = Window.partitionBy(sample).orderBy("rt", "r_rt", "mz", "r_mz")
    next_ = F.filter(F.array(*[F.struct(F.lead("rt", k).over(w).alias("t"), F.lead("r_rt", k).over(w).alias("r")) for k in range(1, ahead + 1)]), lambda x: x["t"].isNotNull())
    pairs = met.withColumn("_n", next_).select(sample, "rt", "r_rt", F.explode("_n").alias("n")).where((F.col("n.t") - F.col("rt") > shift_bin) & (F.col("n.r") > F.col("r_rt")))
    scale = (F.col("n.r") - F.col("r_rt")) / (F.col("n.t") - F.col("rt"))
    votes = pairs.withColumn("scale", scale).where(F.col("scale").between(0.5, 2.0)).crossJoin(F.broadcast(middle))
    votes = votes.withColumn("shift", F.col("r_rt") + F.col("scale") * (F.col("_mid") - F.col("rt")) - F.col("_mid"))
    bins = votes.groupBy(sample, F.round(F.col("scale") / scale_bin).cast("long").alias("a"), F.round(F.col("shift") / shift_bin).cast("long").alias("b")).agg(F.count("*").alias("votes"), F.avg("scale").alias("scale"), F.avg("shift").alias("shift"), F.first("_mid").alias("_mid"))
    best = bins.withColumn("_r", F.row_number().over(Window.partitionBy(sample).orderBy(F.desc("votes"), F.abs(F.col("a") * scale_bin - 1), F.abs("b"), "a", "b"))).where("_r = 1")
    # the shift at time 0
    return best.select(sample, "scale", (F.col("shift") + F.col("_mid") - F.col("scale") * F.col("_mid")).alias("shift"), "votes")


def aligned(features: DataFrame, sample: str, maps: DataFrame) -> DataFrame:
    """All features with aligned_rt; samples without a map keep their times. One row of maps for each sample, so it is small beside features."""
    out = features.join(maps.select(sample, "scale", "shift"), sample, "left")
    return out.withColumn("aligned_rt", F.coalesce(F.col("rt") * F.col("scale") + F.col("shift"), F.col("rt"))).drop("scale", "shift")
