"""Sinks: a folder of Parquet tables with a manifest, selections, and CSV for people, with a group line over the header."""

from __future__ import annotations

import csv
import hashlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.sources.tables import GROUP_HEADER


def _put(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_tables(spark: SparkSession, folder: str, frames: dict[str, DataFrame], parameters: dict | None = None) -> dict:
    """Each table below the folder, and a manifest of parameters, row counts and a digest of the columns; returns the manifest."""
    counts, columns = {}, {}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{name}").count()
        columns[name] = df.dtypes
    digest = hashlib.sha256(json.dumps(columns, sort_keys=True).encode()).hexdigest()
    out = {"parameters": parameters or {}, "tables": counts, "columns_sha256": digest}
    _put(spark, f"{folder}/manifest.json", json.dumps(out, ensure_ascii=False, sort_keys=True))
    return out


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(_get(spark, f"{folder}/manifest.json"))


def write_selected(spark: SparkSession, folder: str, frames: dict[str, DataFrame], chosen: DataFrame, key: str) -> dict:
    """The rows of each table whose key was chosen."""
    keys = chosen.select(key).distinct()
    return write_tables(spark, folder, {n: df.join(keys, key, "left_semi") for n, df in frames.items()})


def _cells(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def write_csv(rows: DataFrame, path: str, groups: dict[str, str] | None = None) -> str:
    """One CSV file with a byte-order mark, the header and, if samples have groups, their labels on a line above it.

    For result tables that people open: the file is written by one task, from sorted partitions it streams.
    """
    header = _cells(rows.columns)
    top = [_cells([GROUP_HEADER, *[groups.get(c, "") for c in rows.columns[1:]]])] if groups and any(c in groups for c in rows.columns[1:]) else []
    head = rows.sparkSession.createDataFrame([(0, "﻿" + "\n".join([*top, header]))], "o int, line string")
    quoted = lambda c: F.when(c.isNull(), "").when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    body = rows.select(F.lit(1).alias("o"), F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in rows.columns]).alias("line"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("line").write.mode("overwrite").text(path)
    return path


def run_identity(spark: SparkSession, inputs: str, code: str, parameters: dict) -> str:
    """Digest of the input files' names and sizes, the code's version and the parameters: equal runs have equal identities."""
    files = spark.read.format("binaryFile").load(inputs).select(F.element_at(F.split("path", "/"), -1).alias("n"), "length").orderBy("n").collect()
    return hashlib.sha256(json.dumps([code, parameters, [list(r) for r in files]], sort_keys=True).encode()).hexdigest()
