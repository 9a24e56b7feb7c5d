"""Spectral libraries as Parquet: written sorted by mass in ranges and apart by polarity, so a scan skips what it can't need."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.functions.names import polarity
from spectralake.operators.filters import allowed
from spectralake.sources import msp

#: Changes with the layout; part of every fingerprint.
VERSION = 1


def fingerprint(spark: SparkSession, path: str, **settings) -> str:
    """Digest of the files' names, sizes and contents (summed up by Spark), the layout and the settings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("hash")).orderBy("name").collect()
    return hashlib.sha256(json.dumps([VERSION, settings, [list(r) for r in rows]], sort_keys=True).encode()).hexdigest()


def write_index(records: DataFrame, path: str, order: str = "record_id", files: int | None = None) -> None:
    """Ranges of mass, sorted within; ties keep the input's order."""
    ready = records.withColumn("polarity", polarity(F.col("adduct"), F.col("polarity") if "polarity" in records.columns else None))
    parts = ready.repartitionByRange(files, "precursor_mz", order) if files else ready.repartitionByRange("precursor_mz", order)
    parts.sortWithinPartitions("precursor_mz", order).write.partitionBy("polarity").parquet(path)


def scan(spark: SparkSession, path: str, mode: str | None = None, classes: list[str] | None = None, adducts: list[str] | None = None, low: float | None = None, high: float | None = None, tolerance_ppm: float = 0.0) -> DataFrame:
    """Records of a polarity, of listed classes (keys) and adducts, within mass bounds padded by the tolerance; all reach the files."""
    if low is not None and high is not None and not 0 < low <= high:
        raise ValueError("mass bounds must be positive and in order")
    rows = spark.read.parquet(path)
    if mode is not None:
        rows = rows.where(F.col("polarity") == mode)
    if low is not None:
        rows = rows.where(F.col("precursor_mz") >= low * (1 - tolerance_ppm * 1e-6))
    if high is not None:
        rows = rows.where(F.col("precursor_mz") <= high * (1 + tolerance_ppm * 1e-6))
    return rows.where(allowed(F.col("compound_class"), F.col("adduct"), classes, adducts))


def catalogue(records: DataFrame) -> DataFrame:
    """Classes and adducts with their numbers of records; only these two columns are read."""
    return records.groupBy("compound_class", "adduct").agg(F.count("*").alias("n"))


def load(spark: SparkSession, path: str, cache: str | None = None, **settings) -> DataFrame:
    """A text library as records; with a cache folder, an index of this very source is written once and read from then on."""
    if cache is None:
        return msp.read(spark, path)
    target = f"{cache.rstrip('/')}/library-{fingerprint(spark, path, **settings)[:24]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        write_index(msp.read(spark, path), target)
    return spark.read.parquet(target)


def from_long_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Records from one row for each fragment (mz, name, type, intensity, weight, required_group): fragments by rising mass, as they came."""
    fields = ["mz", "name", "type", "intensity", "weight", "required_group"]
    listed = F.array_sort(F.collect_list(F.struct("mz", order, *fields[1:])))
    grouped = rows.groupBy(*keys).agg(F.min(order).alias("_first"), listed.alias("_f"))
    return grouped.withColumn("fragments", F.transform("_f", lambda f: F.struct(*[f[c].alias(c) for c in fields]))).drop("_f")


def with_derived(records: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Records and those derived ones whose key isn't there yet."""
    return records.unionByName(derived.join(records.select(*keys).distinct(), keys, "left_anti").select(*records.columns))
