"""Candidates that must score alike, and point reads of audited rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equivalents(rows: DataFrame, spectrum: list[str], group: str, hits: str, order: str, ppm: Column) -> DataFrame:
    """Of candidates of a spectrum that must score alike, the first and the one nearest in mass (the earlier of ties).

    ``group`` names what candidates share outside the spectrum, null for those that never collapse. ``hits`` is array<struct<hit, role,
    eligible>> by library fragment, hit -1 for none: equal matched peaks in equal roles score alike; an ineligible match keeps its row.
    """
    matched = F.filter(hits, lambda h: h["hit"] >= 0)
    whole = F.forall(matched, lambda h: h["eligible"])
    out = rows.withColumns({"_s": F.when(F.col(group).isNotNull() & whole, F.transform(matched, lambda h: F.struct(h["hit"], h["role"]))), "_p": F.abs(ppm)})
    # rows that stay anyway take no part in the windows, so that their number makes no large group
    stay, compared = out.where("_s is null"), out.where("_s is not null")
    part = [*spectrum, group, "_s"]
    first = F.row_number().over(Window.partitionBy(*part).orderBy(order))
    near = F.row_number().over(Window.partitionBy(*part).orderBy("_p", order))
    kept = compared.withColumns({"_f": first, "_n": near}).where("_f = 1 or _n = 1").drop("_f", "_n")
    return stay.unionByName(kept).drop("_s", "_p")


def anchored(rows: DataFrame, key: str, spectrum: str, scope: str, rank: str, score: str, order: str) -> DataFrame:
    """Adds ``anchor``: the row that stands for a feature's spectrum, by scope (main, fa, nae), rank, score, order."""
    place = F.when(F.col(scope) == "main", 0).when(F.col(scope) == "fa", 1).when(F.col(scope) == "nae", 2)
    w = Window.partitionBy(key, spectrum).orderBy(place.asc_nulls_last(), F.col(rank).asc_nulls_last(), F.col(score).desc_nulls_last(), order)
    return rows.withColumn("anchor", F.row_number().over(w) == 1)


def audited(rows: DataFrame, wanted: DataFrame | None = None, on: str = "row_id", anchors_only: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows of an audit table by a list of keys or row numbers (a semi join), all columns or a light projection (a pruned scan)."""
    out = rows.where("anchor") if anchors_only else rows
    out = out if wanted is None else out.join(wanted.select(on), on, "left_semi")
    return out if columns is None else out.select(*columns)
