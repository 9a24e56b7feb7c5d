"""Feature tables of several detectors: columns found by their aliases, times in minutes, ids numbered in order.

Readers take any path that Spark can read; the projections take a DataFrame, so they work on tables that are there already.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectralake.functions.labels import feature_number, numbered

SECONDS, MINUTES = ["seconds", "second", "s"], ["minutes", "minute", "min"]
# Names that columns may have.
ALIASES = {
    "feature_id": ["Feature_ID", "feature_id", "id"], "mz": ["mz", "m/z", "mzmed", "mz_mean", "Precursor m/z"], "rt": ["RT", "rt", "rt_minutes", "rtmed", "rtime", "RT (min)", "rt_seconds", "RT (s)"],
    "rt_min": ["RTmin", "rtmin", "rt_min", "RT left(min)", "rt_start"], "rt_max": ["RTmax", "rtmax", "rt_max", "RT right (min)", "rt_end"], "unit": ["RT_unit", "rt_units"],
}
GROUP_HEADER = "样本分组"


def find_column(columns: list[str], names: list[str]) -> str | None:
    """The column with the first of the names, whatever its case, else with its letters and digits alone."""
    plain = lambda s: "".join(c for c in s.strip().lower() if c.isalnum())
    for fold in (lambda s: s.strip().lower(), plain):
        known = {fold(c): c for c in columns}
        for n in names:
            if fold(n) in known:
                return known[fold(n)]
    return None


def _number(column: str) -> Column:
    return F.col(f"`{column}`").cast("string").try_cast("double")


def read(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited table as texts, with the place of each row in ``_ord``."""
    return spark.read.option("header", True).option("sep", separator).option("multiLine", False).csv(path).withColumn("_ord", F.monotonically_increasing_id())


def work_table(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """feature_id, mz, rt, rt_min, rt_max in minutes from whatever the columns are called; rows without a mass go.

    The unit is that of a unit column (an error if it holds another word), else of the time column's name, else seconds if any time
    of the table is above 200: it is decided once for the table. A missing time is the middle of the bounds; missing ids count rows.
    """
    found = {k: find_column(rows.columns, names) for k, names in ALIASES.items()}
    if found["mz"] is None:
        raise ValueError("the feature table has no mass column")
    times = [k for k in ("rt", "rt_min", "rt_max") if found[k]]
    out = rows
    if found["unit"]:
        unit = F.lower(F.trim(F.col(f"`{found['unit']}`").cast("string")))
        wrong = ~F.coalesce(unit.isin(*SECONDS, *MINUTES), F.lit(False))
        divisor = F.when(wrong, F.raise_error(F.lit("the time unit must be seconds or minutes")).cast("double")).when(unit.isin(SECONDS), 60.0).otherwise(1.0)
    else:
        label = (found["rt"] or "").replace(" ", "").lower()
        if label in ("rt_seconds", "rt(s)"):
            divisor = F.lit(60.0)
        elif label in ("rt_minutes", "rt(min)") or not times:
            divisor = F.lit(1.0)
        else:
            most = rows.agg(F.max(F.greatest(*[_number(found[k]) for k in times], F.lit(None).cast("double"))).alias("_most"))
            out = rows.crossJoin(F.broadcast(most))  # one row
            divisor = F.when(F.col("_most") > 200, 60.0).otherwise(1.0)
    numbers = {k: (_number(found[k]) / divisor if found[k] else F.lit(None).cast("double")) for k in ("rt", "rt_min", "rt_max")}
    if found["feature_id"] is None:
        out = numbered(out, order, F.lit(True), "_i")
        ident = F.concat(F.lit("F"), F.col("_i"))
    else:
        ident = F.col(f"`{found['feature_id']}`").cast("string")
    middle = (numbers["rt_min"] + numbers["rt_max"]) / 2
    table = out.select(order, ident.alias("feature_id"), _number(found["mz"]).alias("mz"), F.coalesce(numbers["rt"], middle).alias("rt"), numbers["rt_min"].alias("rt_min"), numbers["rt_max"].alias("rt_max"))
    return table.where("mz is not null")


def renumbered(rows: DataFrame, column: str = "Feature_ID", order: str = "_ord") -> DataFrame:
    """Ids F1, F2 ... in the order of the numbers in the old ids (rows without one last), then of the rows.

    The number of each old id is its place among counts of blocks, so no sort of all rows meets in one task.
    """
    if column not in rows.columns:
        return numbered(rows, order, F.lit(True), "_i").withColumn(column, F.concat(F.lit("F"), F.col("_i"))).drop("_i")
    number = F.coalesce(feature_number(F.col(f"`{column}`")), F.lit(float("inf")))
    keyed = rows.withColumn("_key", number)
    block = F.when(F.col("_key") == float("inf"), F.lit(2**62)).otherwise(F.floor(F.col("_key") / 4096)).cast("long")
    keyed = keyed.withColumn("_block", block)
    sizes = keyed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).select("_block", "_before")
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_key", order))
    out = keyed.withColumn("_i", place).join(before, "_block")
    return out.withColumn(column, F.concat(F.lit("F"), F.col("_before") + F.col("_i"))).drop("_key", "_block", "_before", "_i")


def samples_of(columns: list[str]) -> list[str]:
    return [c for c in columns if c.lower().endswith(".mzml")]


def asari(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """Seconds to minutes (3 digits), renumbered ids; raw names of times and ids are replaced."""
    names = {"id_number": "Feature_ID", "[peak]id_number": "Feature_ID"}
    times = {"rtime": "RT", "rt": "RT", "rtime_apex": "RT", "rt_apex": "RT", "rtime_left_base": "RTmin", "rt_left_base": "RTmin", "rtime_right_base": "RTmax", "rt_right_base": "RTmax"}
    columns, gone = {}, set()
    for c in rows.columns:
        if c in names and names[c] not in rows.columns:
            columns.setdefault(names[c], F.col(f"`{c}`"))
            gone.add(c)
        if c in times:
            gone.add(c)
            if times[c] not in rows.columns:
                columns.setdefault(times[c], F.col(f"`{c}`"))
    if "Feature_ID" not in (*rows.columns, *columns):
        raise ValueError("the table has no id column")
    out = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in gone], *[v.alias(k) for k, v in columns.items()])
    unit = F.lower(F.trim(F.col("RT_unit"))) if "RT_unit" in rows.columns else F.lit("s")
    for c in ("RT", "RTmin", "RTmax"):
        if c in out.columns:
            n = _number(c)
            out = out.withColumn(c, F.bround(F.when(unit.isin(SECONDS), n / 60).otherwise(n), 3))
    return renumbered(out.withColumn("RT_unit", F.lit("minutes")), "Feature_ID", order)


def xcms(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """Medians to mz (4 digits) and minutes (3 digits), missing areas to 0."""
    n = lambda c: _number(c)
    kept = [c for c in ("sn", "maxo", "into") if c in rows.columns]
    out = rows.select(
        order, F.bround(n("mzmed"), 4).alias("mz"), F.bround(n("rtmin") / 60, 3).alias("RTmin"), F.bround(n("rtmed") / 60, 3).alias("RT"), F.bround(n("rtmax") / 60, 3).alias("RTmax"), n("npeaks").alias("npeaks"),
        *[n(c).alias(c) for c in kept], *[F.coalesce(n(c), F.lit(0.0)).alias(c) for c in samples_of(rows.columns)],
    )
    return renumbered(out, "Feature_ID", order)


MSDIAL = {"Precursor m/z": "mz", "RT left(min)": "RTmin", "RT (min)": "RT", "RT right (min)": "RTmax"}
MSDIAL_KEPT = ["Height", "Area", "Estimated noise", "S/N", "Sharpness", "Gaussian similarity", "Ideal slope", "Symmetry"]


def msdial(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """Renamed and kept columns, missing areas to 0; a table exported as text."""
    out = rows.select(order, *[_number(a).alias(b) for a, b in MSDIAL.items()], *[_number(c).alias(c) for c in MSDIAL_KEPT], *[F.coalesce(_number(c), F.lit(0.0)).alias(c) for c in samples_of(rows.columns)])
    return renumbered(out, "Feature_ID", order)


def openms(rows: DataFrame, ppm: float = 10.0, order: str = "_ord") -> DataFrame:
    """One unit for the table, bounds from start and end columns (huge values are missing), mass bounds by ppm where there are none,
    rounded numbers, renumbered ids; missing time bounds are marked, never made up."""
    has = set(rows.columns)
    if "RT_unit" in has:
        unit = F.lower(F.trim(F.col("RT_unit")))
        kinds = rows.agg(F.count_if(unit.isin(SECONDS)).alias("s"), F.count_if(unit.isin(MINUTES)).alias("m"), F.count("*").alias("n")).first()
        if kinds.n not in (kinds.s, kinds.m):
            raise ValueError("the table must use one time unit")
        factor = 1.0 if kinds.s == kinds.n else 60.0
    else:
        factor = 1.0 if (rows.agg(F.max(_number("RT"))).first()[0] or 0) > 200 else 60.0
    sane = lambda c: F.when(F.abs(c) <= 1e300, c)
    time = lambda c: _number(c) * factor if c in has else F.lit(None).cast("double")
    mass = lambda c: _number(c) if c in has else F.lit(None).cast("double")
    start, end = sane(time("RTstart")), sane(time("RTend"))
    low, high = sane(mass("MZstart")), sane(mass("MZend"))
    own_rt, own_mz = {"RTmin", "RTmax"} <= has, {"mzmin", "mzmax"} <= has
    pairs = {"RTstart", "RTend"} <= has
    valid, near = start <= end, low <= high
    rt = time("RT") if "RT" in has else (start + end) / 2
    mz = mass("mz") if "mz" in has else (low + high) / 2
    rt_min = time("RTmin") if own_rt else F.when(valid, start).otherwise(time("RTmin")) if pairs else time("RTmin")
    rt_max = time("RTmax") if own_rt else F.when(valid, end).otherwise(time("RTmax")) if pairs else time("RTmax")
    if own_mz:
        mz_min, mz_max = mass("mzmin"), mass("mzmax")
    elif {"MZstart", "MZend"} <= has:
        mz_min, mz_max = F.when(near, low).otherwise(mass("mzmin")), F.when(near, high).otherwise(mass("mzmax"))
    else:
        mz_min, mz_max = mz - F.abs(mz) * ppm * 1e-6, mz + F.abs(mz) * ppm * 1e-6
    dropped = {"RTstart", "RTend", "MZstart", "MZend", "peptide_sequence", "peptide_score", "ID_filename", "ID_native_id", "charge", "quality", "sequence", "mz", "mzmin", "mzmax", "RT", "RTmin", "RTmax", "RT_unit"}
    out = rows.select(
        F.bround(mz, 4).alias("mz"), F.bround(mz_min, 4).alias("mzmin"), F.bround(mz_max, 4).alias("mzmax"), F.bround(rt / 60, 6).alias("RT"), F.bround(rt_min / 60, 6).alias("RTmin"), F.bround(rt_max / 60, 6).alias("RTmax"),
        *[F.col(f"`{c}`") for c in rows.columns if c not in dropped], F.lit("minutes").alias("RT_unit"),
    )
    if not own_rt and not pairs:
        gone = F.col("RTmin").isNull() | F.col("RTmax").isNull()
        out = out.withColumns({"peak_boundary_method": F.when(gone, "unresolved_detector_bounds"), "peak_boundary_status": F.when(gone, "unresolved"), "peak_boundary_reason": F.when(gone, "missing_detector_bounds")})
    return renumbered(out, "Feature_ID", order)


def view(rows: DataFrame, peak_column: str | None = None) -> DataFrame:
    """The columns to look at: with two or more samples their areas, else bounds and the one area."""
    samples = samples_of(rows.columns)
    base = [c for c in ("Feature_ID", "mz", "RT") if c in rows.columns]
    if len(samples) >= 2:
        return rows.select(*base, *[F.col(f"`{c}`") for c in samples])
    area = _number(peak_column) if peak_column else _number(samples[0]) if samples else F.lit(None).cast("double")
    bounds = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("RTmin", "RTmax")]
    return rows.select(*base, *bounds, area.alias("PeakArea"))


def feature_matrix(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Validated features with one area column for each included sample, found by its file name or stem; areas mustn't be negative.

    Samples are a small table (source_file, included) that names columns. Ids must be there and unique, masses positive, numbers finite.
    """
    names = [r.source_file for r in samples.where("included").select("source_file").collect()]
    lower = {c.lower(): c for c in rows.columns}
    reserved = {"feature_id", "mz", "rt", "rtmin", "rtmax", "intensity", "area", "into", "peak_area", "maxo", "source_file"}
    areas = []
    for s in names:
        stem = s.rsplit(".", 1)[0].lower()
        source = lower.get(s.lower()) or (lower.get(stem) if stem not in reserved else None)
        if source is None and len(names) == 1:
            source = next((c for c in ("intensity", "Area", "peak_area", "into", "PeakArea") if c in rows.columns), None)
        value = _number(source) if source else F.lit(None).cast("double")
        areas.append(F.when(value < 0, F.raise_error(F.lit("areas must not be negative")).cast("double")).otherwise(value).alias(s))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    mz, rt = _number("mz"), _number("RT")
    bad = rows.agg(F.count_if(F.col("Feature_ID").isNull()).alias("none"), F.count("*").alias("n"), F.count_distinct("Feature_ID").alias("d"), F.count_if(~(finite(mz) & finite(rt) & (mz > 0))).alias("wrong")).first()
    if bad.none or bad.n != bad.d:
        raise ValueError("feature ids must be there and unique")
    if bad.wrong:
        raise ValueError("masses and times must be finite and masses positive")
    return rows.select("Feature_ID", mz.alias("mz"), rt.alias("RT"), *areas)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A result table and its samples' groups: a first line with group labels over the header is not data."""
    lines = [r.value.lstrip("﻿") for r in spark.read.text(path).limit(2).collect()]
    first, second = ([next(csv.reader([x]), []) for x in lines] + [[], []])[:2]
    grouped = bool(first) and first[0] == GROUP_HEADER and bool(second) and second[0] == "Feature ID"
    header = second if grouped else first
    schema = ", ".join(f"`{c}` string" for c in header)
    # the header (and the line over it) are told apart by their first cell
    body = spark.read.schema(schema).option("header", False).option("escape", "\"").csv(path)
    key = F.ltrim(F.translate(F.col(f"`{header[0]}`"), "﻿", ""))
    rows = body.where(~F.coalesce(key.isin(GROUP_HEADER, header[0]), F.lit(False)))
    groups = {c: g for c, g in zip(header[1:], first[1:], strict=False) if g} if grouped else {}
    return rows, groups
