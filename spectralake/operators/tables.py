"""Wide and long tables, unions of unlike tables, fragment texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def area_matrix(rows: DataFrame, keys: list[str], sample: str, value: str, samples: list[str]) -> DataFrame:
    """One column with the summed value for each sample; the samples are named, so no extra pass looks for them."""
    return rows.groupBy(*keys).agg(*[F.sum(F.when(F.col(sample) == s, F.col(value))).alias(f"area_{s}") for s in samples])


def long_areas(matrix: DataFrame, keys: list[str], samples: list[str]) -> DataFrame:
    """Back to one row for each measured sample."""
    return matrix.unpivot(keys, [f"area_{s}" for s in samples], "sample", "area").where("area is not null").withColumn("sample", F.substring("sample", 6, 1000))


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def fragment_text(rows: DataFrame, keys: list[str], mz: str, label: str, digits: int = 4, kind: str | None = None) -> DataFrame:
    """The group's peaks in order of mass, label and kind as ``mz label; mz label``; a peak without a label is its mass alone."""
    peaks = F.array_sort(F.collect_list(F.struct(F.col(mz).alias("m"), F.coalesce(F.col(label), F.lit("")).alias("l"), *([F.col(kind).alias("k")] if kind else []))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(peaks, lambda p: F.rtrim(F.format_string(f"%.{digits}f %s", p["m"], p["l"]))), "; ").alias("fragments"))
