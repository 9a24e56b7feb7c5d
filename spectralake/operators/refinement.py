"""Refinement of a feature map: each feature's interval repaired and measured again on the chromatogram of its own mass.

A feature meets the peaks and scans of its context by equal bins of file, mass and time, so the work follows the number of peaks inside
contexts and no file, mass or feature passes whole through one task. Features of equal mass whose contexts overlap are looked up as one,
so copies meet the peaks once. Bounds are judged beside the apices of the neighbours of equal mass.
Where the interval hides a second top, a feature of a more sensitive pass may be taken up there; then all are measured with it as a neighbour.

Features: file, feature (unique in a file), mz, rt, lower, upper, area. Points: file, rt, mz, intensity. Scans: file, rt. Times in seconds.
Rows with a null file, mass or time take no part, and of rows that repeat one counts; a feature without bounds (null, or not lower < upper)
and one without scans come back unresolved with their detector's area. A scan without a peak in tolerance counts as 0, and so does a nearest
peak whose intensity is null, negative or not finite. Extra columns are dropped. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.operators import peaks
from spectralake.session import reliable

#: Widths of bins: seconds, and mass.
SECONDS, MASS = 120.0, 0.1
#: Beyond it a time or mass is no measurement (infinite, not a number).
LARGE = 1e12
KEYS = ["file", "origin", "feature"]


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def _bounded() -> Column:
    return F.coalesce((F.col("lower") < F.col("upper")) & F.col("lower").between(-LARGE, LARGE) & F.col("upper").between(-LARGE, LARGE), F.lit(False))


def _spans(rows: DataFrame, low: str, high: str) -> DataFrame:
    """(file, mz, low, high) of the rows, each once, with the span (_begin, _end) of those of its mass that overlap it, one after the other."""
    w = Window.partitionBy("file", "mz").orderBy(low, high)
    asked = rows.select("file", "mz", low, high).distinct().withColumn("_far", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    asked = asked.withColumn("_span", F.sum(F.when(F.col(low) <= F.col("_far"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy("file", "mz", "_span")
    return asked.select("file", "mz", low, high, F.min(low).over(one).alias("_begin"), F.max(high).over(one).alias("_end"))


def contexts(features: DataFrame, scans: DataFrame, ppm: float) -> DataFrame:
    """Features with bounds, with ``apices`` (of all features within ``ppm`` of the own mass, the own included, near the interval) and context (begin, end).

    The interval is padded by a quarter of its width, at least six scans and at most 15 s beyond them; neighbouring apices up to a width
    further away are context too.
    """
    w = Window.partitionBy("file").orderBy("rt")
    steps = scans.select("file", "rt").distinct().withColumn("_step", F.col("rt") - F.lag("rt").over(w))
    cadence = steps.groupBy("file").agg(F.coalesce(F.percentile("_step", F.lit(0.5)), F.lit(1.0)).alias("_cadence"))
    span = F.col("upper") - F.col("lower")
    rows = features.where(_bounded()).join(cadence, "file", "left").withColumn("_pad", F.greatest(6 * F.coalesce("_cadence", F.lit(1.0)), F.least(F.lit(15.0), 0.25 * span)))
    rows = rows.withColumns({"_from": F.col("lower") - span - F.col("_pad"), "_to": F.col("upper") + span + F.col("_pad")})
    spans = _spans(rows, "_from", "_to")
    tol = F.col("mz") * ppm * 1e-6
    asked = spans.select("file", "mz", "_begin", "_end").distinct()
    asked = asked.select("*", _bins(F.col("mz") - tol, F.col("mz") + tol, MASS).alias("_m")).select("*", _bins(F.col("_begin"), F.col("_end"), SECONDS).alias("_t"))
    others = features.select("file", F.col("mz").alias("_mz"), F.col("rt").alias("_rt"), F.floor(F.col("mz") / MASS).alias("_m"), F.floor(F.col("rt") / SECONDS).alias("_t")).distinct()
    held = others.groupBy("file", "_m", "_t").agg(F.collect_list(F.struct("_mz", "_rt")).alias("_o"))
    fits = lambda o: o["_rt"].between(F.col("_begin"), F.col("_end")) & o["_mz"].between(F.col("mz") - tol, F.col("mz") + tol)
    met = asked.join(held, ["file", "_m", "_t"]).select("file", "mz", "_begin", "_end", F.array_distinct(F.transform(F.filter("_o", fits), lambda o: o["_rt"])).alias("_o"))
    near = met.groupBy("file", "mz", "_begin", "_end").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_o")))).alias("_o"))
    out = rows.join(spans, ["file", "mz", "_from", "_to"]).join(near, ["file", "mz", "_begin", "_end"], "left")
    inside = F.filter("_o", lambda a: a.between(F.col("_from"), F.col("_to")))
    out = out.withColumn("apices", F.coalesce(inside, F.array().cast("array<double>"))).drop("_o", "_begin", "_end")
    begin = F.least(F.col("lower") - F.col("_pad"), F.array_min("apices"))
    return out.withColumns({"begin": F.greatest(F.lit(0.0), begin), "end": F.greatest(F.col("upper") + F.col("_pad"), F.array_max("apices"))}).drop("_cadence", "_pad", "_from", "_to")


def traces(rows: DataFrame, points: DataFrame, scans: DataFrame, ppm: float) -> DataFrame:
    """Adds ``times`` and ``values`` to features with a context: in each of its scans the peak nearest in mass (the lighter of ties), or 0."""
    tol = F.col("mz") * ppm * 1e-6
    spans = _spans(rows, "begin", "end")
    unit = ["file", "mz", "_begin", "_end"]
    timed = spans.select(*unit).distinct().select("*", _bins(F.col("_begin"), F.col("_end"), SECONDS).alias("_t"))
    massed = timed.select("*", _bins(F.col("mz") - tol, F.col("mz") + tol, MASS).alias("_m"))
    every = scans.select("file", F.col("rt").alias("_rt"), F.floor(F.col("rt") / SECONDS).alias("_t")).distinct()
    # of peaks at one place the least intensity counts, and null before all
    least = F.when(~F.max(F.col("intensity").isNull()), F.min("intensity"))
    own = points.groupBy("file", F.col("rt").alias("_rt"), F.col("mz").alias("_mz")).agg(least.alias("_i"))
    held = own.groupBy("file", "_rt", F.floor(F.col("_rt") / SECONDS).alias("_t"), F.floor(F.col("_mz") / MASS).alias("_m")).agg(F.collect_list(F.struct("_mz", "_i")).alias("_o"))
    near = F.filter("_o", lambda o: o["_mz"].between(F.col("mz") - tol, F.col("mz") + tol))
    hit = F.array_min(F.transform(near, lambda o: F.struct(F.abs(o["_mz"] - F.col("mz")).alias("d"), o["_mz"].alias("m"), o["_i"].alias("i"))))
    seen = massed.join(held, ["file", "_m", "_t"]).where((F.col("_rt") >= F.col("_begin")) & (F.col("_rt") <= F.col("_end"))).select(*unit, "_rt", hit.alias("_hit")).where("_hit is not null")
    blank = timed.join(every, ["file", "_t"]).where("_rt >= _begin and _rt <= _end").select(*unit, "_rt", F.lit(None).cast(seen.schema["_hit"].dataType).alias("_hit"))
    # scans and peaks in one grouping: the minimum passes over the nulls that only tell of a scan
    once = seen.unionByName(blank).groupBy(*unit, "_rt").agg(F.min("_hit").alias("_hit"))
    value = F.when((F.col("_hit.i") >= 0) & (F.col("_hit.i") < float("inf")), F.col("_hit.i")).otherwise(0.0)
    listed = once.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(F.col("_rt").alias("t"), value.alias("v")))).alias("_p"))
    nothing = F.array().cast("array<double>")
    out = rows.join(spans, ["file", "mz", "begin", "end"]).join(listed, unit, "left").withColumn("_p", F.filter("_p", lambda p: (p["t"] >= F.col("begin")) & (p["t"] <= F.col("end"))))
    out = out.withColumns({"times": F.coalesce(F.transform("_p", lambda p: p["t"]), nothing), "values": F.coalesce(F.transform("_p", lambda p: p["v"]), nothing)}).drop("_p", "_begin", "_end")
    # apices beyond the first and last scan can't be looked at
    return out.withColumn("apices", F.filter("apices", lambda a: (a >= F.array_min("times")) & (a <= F.array_max("times"))))


def taken_up(regions: DataFrame, redetected: DataFrame, ppm: float) -> DataFrame:
    """Features of another pass that are the only one of their mass strictly inside a region; where several regions ask, the first parent's."""
    tol = F.col("_mz") * ppm * 1e-6
    # equal regions are asked for once, for their first parent, and features at one place are met once with their number
    asked = regions.groupBy("file", F.col("mz").alias("_mz"), F.col("left_rt").alias("_l"), F.col("right_rt").alias("_r")).agg(F.min(F.struct(F.col("feature").alias("parent"), F.col("apex_rt").alias("seed_rt"))).alias("_p"))
    spread = asked.select("*", _bins(F.col("_mz") - tol, F.col("_mz") + tol, MASS).alias("_m")).select("*", _bins(F.col("_l"), F.col("_r"), SECONDS).alias("_t"))
    found = redetected.groupBy("file", "mz", "rt").agg(F.count("*").alias("_k"), F.min(F.struct("feature", "mz", "rt", "lower", "upper", "detector_area")).alias("_c"))
    found = found.withColumns({"_m": F.floor(F.col("mz") / MASS), "_t": F.floor(F.col("rt") / SECONDS)})
    met = spread.join(found, ["file", "_m", "_t"]).where((F.abs(F.col("mz") - F.col("_mz")) <= tol) & (F.col("rt") > F.col("_l")) & (F.col("rt") < F.col("_r")))
    one = met.groupBy("file", "_mz", "_l", "_r").agg(F.sum("_k").alias("_n"), F.min("_c").alias("_c"), F.min("_p").alias("_p")).where("_n = 1")
    return one.groupBy("file", "_c").agg(F.min("_p").alias("_p")).select("file", "_c.*", "_p.*")


def _clean(features: DataFrame) -> DataFrame:
    numbers = [F.col(c).cast("double").alias(c) for c in ("mz", "rt", "lower", "upper")]
    whole = features.select("file", "feature", *numbers, F.col("area").cast("double").alias("detector_area"))
    finite = F.col("rt").between(-LARGE, LARGE) & (F.col("mz") > 0) & (F.col("mz") < LARGE)
    return whole.where(F.col("file").isNotNull() & F.col("feature").isNotNull() & finite).dropDuplicates(["file", "feature"])


def refined_map(features: DataFrame, points: DataFrame, scans: DataFrame, ppm: float = 10.0, redetected: DataFrame | None = None) -> DataFrame:
    """All features, and those taken up from ``redetected`` (origin ``split``, with parent and seed_rt), with status, reason, repaired bounds,
    height, area (raw trapezoid; the detector's where unresolved), area above the baseline, and the distance of the nearest neighbouring apex."""
    finite = F.col("rt").between(-LARGE, LARGE)
    points = points.select("file", *[F.col(c).cast("double").alias(c) for c in ("rt", "mz", "intensity")]).where(F.col("file").isNotNull() & finite & (F.col("mz") > 0) & (F.col("mz") < LARGE))
    scans = scans.select("file", F.col("rt").cast("double").alias("rt")).where(F.col("file").isNotNull() & finite)
    reliable(features.sparkSession)
    first = _clean(features).checkpoint().withColumns({"origin": F.lit("detector"), "seed_rt": F.lit(None).cast("double")})
    everything = first.withColumn("parent", F.lit(None).cast(first.schema["feature"].dataType))
    if redetected is not None:
        drawn = traces(contexts(everything, scans, ppm).checkpoint(), points, scans, ppm)
        more = taken_up(peaks.splits(drawn, ["file", "feature", "mz"]), _clean(redetected), ppm)
        everything = everything.unionByName(more.withColumn("origin", F.lit("split"))).checkpoint()
    drawn = traces(contexts(everything, scans, ppm).checkpoint(), points, scans, ppm).checkpoint()
    fixed = drawn.join(peaks.repaired(drawn, KEYS), KEYS)
    other = F.transform(F.filter("apices", lambda a: F.abs(a - F.col("rt")) > 1e-6), lambda a: F.abs(a - F.col("rt")))
    measured = ["left_rt", "right_rt", "height", "area", "area_corrected", "neighbour"]
    done = fixed.withColumn("neighbour", F.when(F.col("left_rt").isNotNull(), F.array_min(other)))
    open_ = everything.where(~_bounded()).withColumns({c: F.lit(None).cast("double") for c in measured} | {"reason": F.lit("missing_detector_bounds")})
    out = [*KEYS, "parent", "seed_rt", "mz", "rt", "detector_area", "reason", *measured]
    rows = done.select(*out).unionByName(open_.select(*out))
    return rows.withColumns({"status": F.when(F.col("left_rt").isNull(), "unresolved").otherwise("confirmed"), "area": F.coalesce("area", "detector_area")})
