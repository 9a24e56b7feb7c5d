"""Saved detector tables of a run folder, whichever detector wrote them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.sources import tables

# Where each detector's table is, best first.
PLACES = {
    "pyopenms": ("pyopenms/pyopenms_features.csv",),
    "xcms": ("xcms/xcms_features.csv",),
    "asari": ("asari/preferred_Feature_table.csv", "asari/full_Feature_table.csv"),
    "msdial": ("msdial/*_processed.csv",),
}


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, latest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [s.getPath().toString() for s in sorted(found, key=lambda s: -s.getModificationTime())]


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value) if _files(spark, path) else {}


def _ready(spark: SparkSession, path: str, detector: str) -> DataFrame:
    rows = tables.read(spark, path)
    unit = tables.find_column(rows.columns, ["RT_unit", "rt_units"])
    time = tables.find_column(rows.columns, ["RT", "rt", "rtime", "rtmed"])
    if time is None or detector not in ("asari", "xcms"):
        return rows
    # these detectors write seconds unless a column says otherwise
    plain = F.col(f"`{time}`").try_cast("double")
    minutes = F.lower(F.col(f"`{unit}`")).startswith("min") if unit else F.lit(False)
    return rows.withColumn(time, F.when(minutes, plain).otherwise(F.round(plain / 60, 3)))


def saved_tables(spark: SparkSession, run: str) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """Native rows (one for each file's feature), aligned rows (one column for each sample), and the detector's name.

    ``ms1/feature_table.json`` names detector, table, native table and samples' columns, else ``run_settings.json`` the detector, else
    each is looked for in order. Sample columns take the file names of the manifest or of ``provenance.json``. A table with a filled
    ``source_file`` is native itself.
    """
    ms1 = f"{run.rstrip('/')}/ms1"
    about, settings = _json(spark, f"{ms1}/feature_table.json"), _json(spark, f"{run}/run_settings.json")
    named = about.get("algorithm") or settings.get("ms1", {}).get("algo")
    detectors = [named.replace("ms-dial", "msdial")] if named else list(PLACES)
    spots = [(detectors[0], about["table"])] if about.get("table") else [(d, p) for d in detectors for p in PLACES.get(d, ())]
    detector, path = next(((d, f) for d, p in spots for f in _files(spark, f"{ms1}/{p}")[:1]), (detectors[-1], None))
    if path is None:
        native = sorted(_files(spark, f"{ms1}/pyopenms/*_native.csv"))[:1] if "pyopenms" in detectors and not about else []
        if not native:
            return None, None, detector
        aligned = _files(spark, native[0].replace("_native.csv", ".csv"))
        return tables.read(spark, native[0]), tables.read(spark, aligned[0]) if aligned else None, "pyopenms"
    rows = _ready(spark, path, detector)
    columns = about.get("sample_columns") or {}
    if not columns:
        names = [r["path"].replace("\\", "/").rsplit("/", 1)[-1] for r in _json(spark, f"{run}/provenance.json").get("inputs", [])]
        known = {k.casefold(): n for n in names for k in (n, n.rsplit(".", 1)[0])}
        columns = {c: known[c.casefold()] for c in rows.columns if c.casefold() in known}
    rows = rows.withColumnsRenamed({c: n for c, n in columns.items() if c in rows.columns and n not in rows.columns})
    beside = f"{ms1}/{about['native_table']}" if about.get("native_table") else f"{path.rsplit('.', 1)[0]}_native.csv"
    if detector == "pyopenms" and _files(spark, beside):
        return tables.read(spark, beside), rows, detector
    if "source_file" in rows.columns and not rows.where("source_file is not null").isEmpty():
        return rows, None, detector
    return None, rows, detector
