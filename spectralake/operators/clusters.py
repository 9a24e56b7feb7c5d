"""Order-dependent clustering in stretches of the mass axis that can't touch each other, so every stretch is a group of its own."""

from __future__ import annotations


from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_stretch(rows: DataFrame, keys: list[str], value: Column, width: float, name: str = "stretch") -> DataFrame:
    """Adds a number that differs for values with an empty bin of ``width`` between them.

    Only the occupied bins are sorted, one row each, so the sort is as large as the axis, not as the data; rows without a value
    have no stretch.
    """
    binned = rows.withColumn("_bin", F.floor(value / width))
    bins = binned.where("_bin is not null").select(*keys, "_bin").distinct()
    w = Window.partitionBy(*keys).orderBy("_bin") if keys else Window.orderBy("_bin")
    opens = F.when(F.col("_bin") - F.lag("_bin").over(w) <= 1, 0).otherwise(1)
    numbered = bins.withColumn("_o", opens).withColumn(name, F.sum("_o").over(w)).drop("_o")
    keyed = [F.col(k) for k in keys]
    renamed = numbered.select(*[c.alias(f"_k{i}") for i, c in enumerate(keyed)], F.col("_bin").alias("_b"), name)
    on = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return binned.join(renamed, on, "left").drop("_bin", "_b", *[f"_k{i}" for i in range(len(keys))])


def _ppm_axis(mass: Column, ppm: float) -> tuple[Column, float]:
    """Masses within ppm of each other are within ``width`` on a logarithmic axis."""
    return F.when(mass > 0, F.ln(mass)), ppm * 1e-6 * 1.01


def _grouped(rows: DataFrame, keys: list[str], columns: list[str], kernel, output: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), output])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf)[[*columns, output.split()[0]]]

    return rows.groupBy(*keys).applyInPandas(work, schema)


def cohorts(rows: DataFrame, ppm: float = 10.0, minutes: float = 0.1) -> DataFrame:
    """Complete-link groups of spectra across samples: (mode, source, scan) -> cohort, a text that is unique to the group.

    Rows: mode, source, scan, mz, rt, peak. In order of mass a spectrum joins, of the open groups whose masses and times stay within
    bounds and whose recorded peak of its sample is its own, the one with the nearest middle; else it opens one.

    Spectra of one source, mass, time and recorded peak go the same way: whatever a group that one of them could join has taken in
    between lies at the same place, so the chosen group stays the nearest. Without a recorded peak that holds until the next peak of the
    place comes first. Only one spectrum of each such unit goes through the kernel.
    """
    axis, width = _ppm_axis(F.col("mz"), ppm)
    once = rows.where("mz > 0 and rt is not null and not isnan(rt)").groupBy("mode", "source", "scan").agg(F.min(F.struct("mz", "rt", "peak")).alias("_f")).select("mode", "source", "scan", "_f.*")
    spot = ["mode", "mz", "rt", "source"]
    named = once.withColumn("peak", F.coalesce("peak", F.lit("")))
    first = (F.row_number().over(Window.partitionBy(*spot, "peak").orderBy(F.asc_nulls_last("scan"))) == 1) & (F.col("peak") != "")
    turn = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(*spot).orderBy(F.asc_nulls_last("scan")).rowsBetween(Window.unboundedPreceding, 0))
    marked = named.withColumn("_first", first).withColumn("turn", F.when(F.col("peak") == "", turn).otherwise(0)).drop("_first")
    unit = [*spot, "peak", "turn"]
    placed = with_stretch(marked.groupBy(*unit).agg(F.min("scan").alias("scan")), ["mode"], axis, width)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mz", "rt", "source", "scan"], kind="stable").reset_index(drop=True)
        mz, rt = pdf["mz"].to_numpy(float), pdf["rt"].to_numpy(float)
        sample = pdf["source"].astype(str).str.rsplit("/", n=1).str[-1].str.casefold().to_numpy()
        peak = pdf["peak"].to_numpy()
        # groups in the order of their first masses: first mass, least and largest time; recorded peaks by group and sample
        heads, times, held = np.empty(len(pdf)), np.empty((2, len(pdf))), {}
        group, made, still = np.empty(len(pdf), np.int64), 0, 0
        for i in range(len(pdf)):
            # masses rise faster than the tolerance, so a group that is too light stays so
            still += int(np.searchsorted(-(mz[i] - heads[still:made]), -mz[i] * ppm * 1e-6, "left"))
            early, late = np.minimum(times[0, still:made], rt[i]), np.maximum(times[1, still:made], rt[i])
            fits = late - early <= minutes + 1e-10
            if peak[i]:
                fits &= np.fromiter((held.get((g, sample[i]), peak[i]) == peak[i] for g in range(still, made)), bool, made - still)
            off = np.where(fits, np.abs(times[:, still:made].mean(axis=0) - rt[i]), np.inf)[::-1]  # of equals the last group
            at = made - 1 - int(off.argmin()) if len(off) and np.isfinite(off.min()) else made
            if at == made:
                heads[at], times[:, at], made = mz[i], rt[i], made + 1
            else:
                times[:, at] = early[at - still], late[at - still]
            if peak[i]:
                held[at, sample[i]] = peak[i]
            group[i] = at
        return pdf.assign(cohort=[f"{pdf['mode'].iloc[0]}|{pdf['stretch'].iloc[0]}|{g}" for g in group])

    found = _grouped(placed, ["mode", "stretch"], unit, kernel, "cohort string")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in unit]
    return marked.alias("a").join(found.alias("b"), same).select("a.mode", "a.source", "a.scan", "b.cohort")


def leaders(rows: DataFrame, keys: list[str], order: str, ppm: float = 10.0, minutes: float = 0.5) -> DataFrame:
    """Clusters of orphans with one annotation (``keys``): in order of time and mass a row joins the first cluster whose running
    median mass and time are near, else it opens one. Rows: keys, mz, rt, order. Gives keys, order, cluster.
    """
    axis, width = F.col("rt"), minutes * 1.0001
    placed = with_stretch(rows.where("mz is not null and rt is not null"), keys, axis, width)
    middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2  # noqa: E731  of a sorted list

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rt", "mz", order], kind="stable").reset_index(drop=True)
        groups: list[tuple[list, list]] = []
        names = []
        for row in pdf.itertuples():
            for number, (masses, times) in enumerate(groups):
                if abs(row.rt - middle(times)) <= minutes and abs(row.mz - (mid := middle(masses))) / mid * 1e6 <= ppm:
                    break
            else:
                number = len(groups)
                groups.append(([], []))
            insort(groups[number][0], row.mz)
            insort(groups[number][1], row.rt)
            names.append(number)
        stretch = pdf["stretch"].iloc[0]
        return pdf.assign(cluster=[f"{stretch}|{i}" for i in names])

    return _grouped(placed, [*keys, "stretch"], [*keys, order], kernel, "cluster string")


def consensus_groups(rows: DataFrame, ppm: float = 10.0, seconds: float = 15.0) -> DataFrame:
    """Groups of aligned peaks with at most one of each sample, all pairs of which agree: (sample, feature) -> group.

    Rows: sample, feature, mz, rt (seconds), charge. A peak's time limit is 15 s or 0.45 times the distance to the nearest other peak of
    its sample and mass; seeds go by the sample with most peaks first, then sample, mass and time; of each other sample the nearest
    agreeing peak joins.
    """
    counts = rows.groupBy("sample").agg(F.count("*").alias("n"))
    reference = counts.agg(F.max_by("sample", F.struct("n", F.xxhash64("sample"))).alias("_s"), F.max("n").alias("_n"))
    first = counts.crossJoin(F.broadcast(reference)).where("n = _n").agg(F.min("sample").alias("reference"))  # one row
    axis, width = _ppm_axis(F.col("mz"), ppm)
    placed = with_stretch(rows.crossJoin(F.broadcast(first)), [], axis, width)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mz", "rt", "sample"], kind="stable").reset_index(drop=True)
        mz, rt, sample, charge = (pdf[c].to_numpy() for c in ("mz", "rt", "sample", "charge"))
        factor = 1 + ppm * 1e-6
        lo, hi = np.searchsorted(mz, mz / factor, "left"), np.searchsorted(mz, mz * factor, "right")
        others, code = np.unique(sample, return_inverse=True)
        own = [rows[np.argsort(rt[rows], kind="stable")] for rows in (np.flatnonzero(code == k) for k in range(len(others)))]
        times = [rt[rows] for rows in own]

        def around(i: int, k: int, within: float) -> np.ndarray:
            """Peaks of sample ``k`` near peak ``i`` in mass and time, in order."""
            rows = own[k][np.searchsorted(times[k], rt[i] - within, "left") : np.searchsorted(times[k], rt[i] + within, "right")]
            return np.sort(rows[(rows >= lo[i]) & (rows < hi[i])])

        limit = np.full(len(pdf), seconds)
        for i in range(len(pdf)):
            off = np.abs(rt[around(i, code[i], seconds / 0.45 * 1.001)] - rt[i])
            off = off[off > 1e-6]
            if len(off):
                limit[i] = min(seconds, 0.45 * off.min())
        free, names = np.ones(len(pdf), bool), np.full(len(pdf), -1)
        for seed in np.lexsort((rt, mz, code, sample != pdf["reference"].iloc[0])):
            if not free[seed]:
                continue
            members = [seed]
            free[seed], names[seed] = False, seed
            for other in range(len(others)):
                if other == code[seed]:
                    continue
                c = around(seed, other, seconds * 1.001)
                c = c[free[c]]
                for m in members:
                    c = c[(np.abs(rt[c] - rt[m]) <= np.minimum(limit[c], limit[m])) & (np.abs(mz[c] - mz[m]) / np.minimum(mz[c], mz[m]) * 1e6 <= ppm) & ((charge[c] == charge[m]) | (charge[c] == 0) | (charge[m] == 0))]
                if len(c):
                    one = c[np.lexsort((np.abs(mz[c] - mz[seed]), np.abs(rt[c] - rt[seed])))[0]]
                    members.append(one)
                    free[one], names[one] = False, seed
        stretch = pdf["stretch"].iloc[0]
        return pdf.assign(group=[f"{stretch}|{i}" for i in names])

    return _grouped(placed, ["stretch"], ["sample", "feature"], kernel, "group string")


def queries(rows: DataFrame, keys: list[str], ppm: float = 10.0, gap: float = 0.5, pad: float = 0.35) -> DataFrame:
    """Extraction queries that near spectra of one file share: masses within ppm of the first of their group, blocks of seeds within
    ``gap`` of the first; median mass, padded bounds and the spectra. Rows: keys, scan, mz, seed.

    Both steps are anchor clusters; the mass step runs on the occupied stretches of each file.
    """
    axis, width = _ppm_axis(F.col("mz"), ppm)
    used = rows.where("mz > 0 and seed >= 0")
    spot = [*keys, "mz", "seed"]
    # spectra at one place are in one block: the kernel gets the places, Spark gathers the spectra
    placed = with_stretch(used.select(*spot).distinct(), keys, axis, width)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mz", "seed"], kind="stable")
        starts, first = [], None
        for m in pdf["mz"]:
            if first is None or m - first > m * ppm * 1e-6:
                first = m
            starts.append(first)
        pdf = pdf.assign(_g=starts).sort_values(["_g", "seed"], kind="stable")
        blocks, first, group = [], None, None
        for g, s in zip(pdf["_g"], pdf["seed"], strict=True):
            if g != group or s - first > gap:
                group, first = g, s
            blocks.append(f"{g!r}|{first!r}")
        return pdf.assign(block=blocks)

    found = _grouped(placed, [*keys, "stretch"], spot, kernel, "block string")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in spot]
    members = used.alias("a").join(found.alias("b"), same).select("a.*", "b.block")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seed", "scan"))), lambda x: x["scan"])
    out = members.groupBy(*keys, "block").agg(F.median("mz").alias("mz"), F.greatest(F.lit(0.0), F.min("seed") - pad).alias("lower"), (F.max("seed") + pad).alias("upper"), listed.alias("scans"))
    return out.drop("block")


def with_context(asked: DataFrame, native: DataFrame, keys: list[str], ppm: float = 10.0, width: float = 0.1) -> DataFrame:
    """Queries (keys, query, mz, lower, upper) widened to the native intervals they meet and one neighbour on each side.

    Native: keys, native_mz, apex, left, right. Intervals of near mass are ordered by apex; the first and last that the query meets,
    with the one before and after, give the bounds, padded by a tenth of their span within 0.05 and 0.15.
    """
    from spectralake.operators.joins import interval_join

    # equal queries have equal bounds, and intervals of equal place count as one: all meet a query or none, and neighbours are equal
    places = ["mz", "lower", "upper"]
    tol = F.col("mz") * ppm * 1e-6
    every = native.select(*keys, "native_mz", "apex", "left", "right").distinct()
    near = interval_join(asked.select(*keys, *places).distinct(), every, F.col("mz") - tol, F.col("mz") + tol, F.col("native_mz"), width, on=keys)
    near = near.select(*keys, *places, "apex", "left", "right").distinct()
    w = Window.partitionBy(*keys, *places)
    meets = F.col("apex").between(F.col("lower"), F.col("upper")) | ((F.col("left") <= F.col("upper")) & (F.col("right") >= F.col("lower")))
    placed = near.withColumn("_i", F.row_number().over(w.orderBy("apex", "left", "right"))).withColumn("_m", F.when(meets, F.col("_i")))
    kept = placed.withColumns({"_a": F.min("_m").over(w), "_z": F.max("_m").over(w)}).where(F.col("_i").between(F.col("_a") - 1, F.col("_z") + 1))
    context = kept.groupBy(*keys, *places).agg(F.min("left").alias("_l"), F.max("right").alias("_r"))
    pad = F.greatest(F.lit(0.05), F.least(F.lit(0.15), 0.1 * (F.col("_r") - F.col("_l"))))
    out = asked.join(context, [*keys, *places], "left")
    lower = F.least("lower", F.greatest(F.lit(0.0), F.col("_l") - pad))
    return out.withColumn("_lo", F.coalesce(lower, "lower")).withColumn("_hi", F.coalesce(F.greatest("upper", F.col("_r") + pad), "upper")).select(*[c for c in asked.columns if c not in ("lower", "upper")], F.col("_lo").alias("lower"), F.col("_hi").alias("upper"))
