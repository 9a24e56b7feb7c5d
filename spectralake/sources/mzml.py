"""mzML by Spark's XML reader: an element is a row, so large files are split; parameters of referenced groups are looked up.

Binary arrays are base64 text, maybe zlib, of 32 or 64-bit numbers; an Arrow function decodes whole batches.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Terms of the controlled vocabulary.
LEVEL, POSITIVE, NEGATIVE, CENTROID = "MS:1000511", "MS:1000130", "MS:1000129", "MS:1000127"
START, MINUTE, SELECTED, CHARGE = "MS:1000016", "UO:0000031", "MS:1000744", "MS:1000041"
MZ, INTENSITY, DOUBLE, ZLIB = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574"

_CV = "array<struct<_accession: string, _value: string, _unitAccession: string>>"
_REF = "array<struct<_ref: string>>"
_PRECURSOR = f"array<struct<_spectrumRef: string, selectedIonList: struct<selectedIon: array<struct<cvParam: {_CV}>>>>>"
_ARRAYS = f"array<struct<cvParam: {_CV}, binary: string>>"
SPECTRUM = f"_id string, _index long, cvParam {_CV}, referenceableParamGroupRef {_REF}, scanList struct<scan: array<struct<cvParam: {_CV}>>>, precursorList struct<precursor: {_PRECURSOR}>, binaryDataArrayList struct<binaryDataArray: {_ARRAYS}>"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("source_file", F.col("_metadata.file_path"))


def value(params: Column, accession: str) -> Column:
    """The value of a term; null where it isn't."""
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))["_value"]


def has(params: Column, accession: str) -> Column:
    return F.exists(F.coalesce(params, F.array().cast(_CV)), lambda p: p["_accession"] == accession)


def raw_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectrum elements with ``params``: their own and those of the groups they refer to; a missing group is an error."""
    spectra = _elements(spark, path, "spectrum", SPECTRUM)
    groups = _elements(spark, path, "referenceableParamGroup", f"_id string, cvParam {_CV}").select("source_file", F.col("_id").alias("_ref"), F.col("cvParam").alias("_own"))
    groups = groups.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("_ref", F.coalesce("_own", F.array().cast(_CV))))).alias("_groups"))
    joined = spectra.join(F.broadcast(groups), "source_file", "left")  # one row for each file
    none = F.create_map().cast(f"map<string, {_CV}>")
    known = F.coalesce("_groups", none)
    refs = F.coalesce(F.transform("referenceableParamGroupRef", lambda r: r["_ref"]), F.array().cast("array<string>"))
    missing = F.exists(refs, lambda r: ~F.map_contains_key(known, r))
    looked = F.flatten(F.transform(refs, lambda r: F.try_element_at(known, r)))
    checked = F.when(missing, F.raise_error(F.lit("an mzML file refers to a parameter group that it doesn't have")).cast(_CV)).otherwise(F.concat(F.coalesce("cvParam", F.array().cast(_CV)), looked))
    return joined.withColumn("params", checked).drop("_groups", "cvParam", "referenceableParamGroupRef")


def inventory(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Numbers of MS1 and MS2 scans of each file; a scan of the other polarity is an error."""
    if mode not in ("positive", "negative"):
        raise ValueError("mode must be positive or negative")
    other = NEGATIVE if mode == "positive" else POSITIVE
    rows = raw_spectra(spark, path)
    level = F.when(has(F.col("params"), other), F.raise_error(F.lit("a file's polarity differs from the project's"))).otherwise(value(F.col("params"), LEVEL))
    return rows.select("source_file", level.alias("level")).groupBy("source_file").agg(F.count_if(F.col("level") == "1").alias("ms1_scans"), F.count_if(F.col("level") == "2").alias("ms2_scans"))


def decoded(text: str | None, double: bool, packed: bool) -> np.ndarray:
    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if packed and raw else raw, "<f8" if double else "<f4").astype(float)


@F.pandas_udf(ArrayType(DoubleType()))
def _numbers(text: pd.Series, double: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([decoded(t, d, z) for t, d, z in zip(text, double, packed, strict=True)])


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """source_file, scan_id, ord, level, polarity, rt_seconds, centroided, precursor_mz, charge, parent, mz, intensity."""
    rows = raw_spectra(spark, path)
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    one = lambda accession: F.get(F.filter(arrays, lambda a: has(a["cvParam"], accession)), F.lit(0))
    numbers = lambda accession: _numbers(one(accession)["binary"], has(one(accession)["cvParam"], DOUBLE), has(one(accession)["cvParam"], ZLIB))
    scan = F.get(F.col("scanList.scan"), F.lit(0))["cvParam"]
    start = F.get(F.filter(scan, lambda p: p["_accession"] == START), F.lit(0))
    seconds = start["_value"].cast("double") * F.when(start["_unitAccession"] == MINUTE, 60.0).otherwise(1.0)
    precursor = F.get(F.col("precursorList.precursor"), F.lit(0))
    ion = F.get(precursor["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    p = F.col("params")
    return rows.select(
        "source_file", F.col("_id").alias("scan_id"), F.col("_index").alias("ord"), value(p, LEVEL).cast("int").alias("level"), F.when(has(p, POSITIVE), "+").when(has(p, NEGATIVE), "-").alias("polarity"),
        seconds.alias("rt_seconds"), has(p, CENTROID).alias("centroided"), value(ion, SELECTED).cast("double").alias("precursor_mz"), value(ion, CHARGE).cast("int").alias("charge"), precursor["_spectrumRef"].alias("parent"),
        numbers(MZ).alias("mz"), numbers(INTENSITY).alias("intensity"),
    )


def peaks(rows: DataFrame) -> DataFrame:
    """One row for each peak of a scan: source_file, scan_id, rt_seconds, mz, intensity."""
    zipped = F.explode(F.arrays_zip(F.col("mz").alias("m"), F.col("intensity").alias("i")))
    return rows.select("source_file", "scan_id", "rt_seconds", zipped.alias("p")).select("source_file", "scan_id", "rt_seconds", F.col("p.m").alias("mz"), F.col("p.i").alias("intensity"))
