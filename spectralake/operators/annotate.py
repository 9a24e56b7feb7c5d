"""Summaries and votes over annotation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.functions import labels
from spectralake.functions.names import with_parsed
from spectralake.operators.ranking import distinct_identities, topk


def ordered_unique(order: Column | str, text: Column) -> Column:
    """Aggregate: distinct texts that aren't empty, in order, joined by semicolons."""
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", F.struct(o.alias("o"), text.alias("t")))))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda p: p["t"])), ";")


def ordered_lists(rows: DataFrame, key: str, order: str, texts: dict[str, str]) -> DataFrame:
    """ordered_unique() of several columns (name of the list: column) for each key. Each text is first reduced to its least order, so that
    a key with many rows and few texts is never collected whole; equal orders go by text."""
    pairs = rows.select(F.col(key), F.col(order).alias("_o"), F.posexplode(F.array(*texts.values())).alias("_i", "_t"))
    firsts = pairs.groupBy(key, "_i", "_t").agg(F.min("_o").alias("_o"))
    return firsts.groupBy(key).agg(*[ordered_unique("_o", F.when(F.col("_i") == i, F.col("_t"))).alias(name) for i, name in enumerate(texts)])


def _with_lists(grouped: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """The two joined by key; a null key is a group too."""
    return grouped.join(lists.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def scan_label(source: Column, scan: Column) -> Column:
    return F.when(F.coalesce(scan, F.lit("")) == "", "").when(F.coalesce(source, F.lit("")) == "", scan).otherwise(F.concat(source, F.lit(":"), scan))


def _best_first(prefer_time: bool, order: str) -> list[Column]:
    time = F.coalesce("rt_delta_sec", F.lit(float("inf"))) if prefer_time else F.lit(0.0)
    return [-F.coalesce("final_score", F.lit(0.0)), time, -F.coalesce("n_fragments", F.lit(0)), F.abs(F.coalesce("ppm_error", F.lit(float("inf")))), F.col(order)]


def summaries(rows: DataFrame, keys: list[str], order: str, prefer_time: bool = True) -> DataFrame:
    """One row for each group: its best row's columns, the number of rows, ordered distinct scans and files.

    The best row has the highest score, then the least time difference, most fragments, least error; a struct minimum finds it.
    """
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(_best_first(prefer_time, order))], *[c for c in rows.columns if c not in keys and c != order])
    grouped = rows.groupBy(*keys).agg(
        F.min(rank).alias("_b"), F.count("*").alias("n_spectra"), ordered_unique(order, scan_label(F.col("source_file"), F.col("scan_id"))).alias("all_scan_ids"),
        ordered_unique(order, F.col("source_file")).alias("supporting_files"),
    )
    kept = [c for c in rows.columns if c not in keys and c != order]
    return grouped.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in kept], "n_spectra", "all_scan_ids", "supporting_files")


def orphan_summaries(rows: DataFrame, cluster: str, mass: str, order: str) -> DataFrame:
    """summaries() of clusters without a feature, numbered ORPHAN_001 on by their first row (``order``: unique whole numbers), with the median mass."""
    groups = rows.groupBy(cluster).agg(F.median(mass).alias("feature_mz"), F.min(order).alias("_first"))
    numbers = labels.numbered(groups, "_first", F.lit(1), "_i")
    named = numbers.select(cluster, "feature_mz", F.concat(F.lit("ORPHAN_"), F.when(F.col("_i") < 1000, F.lpad(F.col("_i").cast("string"), 3, "0")).otherwise(F.col("_i").cast("string"))).alias("feature_id"))
    return summaries(rows, [cluster], order, False).join(named, cluster)


def linked_counts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct spectra and files of each key, and their ordered distinct lists. Rows: spectrum, source_file, scan_id."""
    counts = rows.groupBy(key).agg(F.count_distinct("spectrum").alias("n_scans"), F.count_distinct("source_file").alias("n_files"))
    return _with_lists(counts, ordered_lists(rows, key, order, {"files": "source_file", "scans": "scan_id"}), key)


def centres(rows: DataFrame, key: str, spectrum: str, order: str, values: list[str]) -> DataFrame:
    """Medians over the unique spectra of each key; a spectrum counts by its first row."""
    return topk(rows, [key, spectrum], [F.col(order)], 1).groupBy(key).agg(*[F.median(v).alias(v) for v in values])


def candidate_text(rows: DataFrame, key: str, rank: str, text: Column) -> DataFrame:
    """One text for each key: its candidates in rank order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), text.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("candidates"))


def feature_votes(rows: DataFrame) -> DataFrame:
    """The displayed annotations of each feature, by votes of samples.

    Rows: feature, spectrum, source, identity, name, comparable (class, adduct, mode as one text), rank, score, qualified, ord.
    Qualified rank-1 rows vote: a sample for the one identity it has, unless one of its spectra has several rank-1 identities; other
    samples are ambiguous. The anchor is the best qualified row of the identities with most votes (the first in order where they
    aren't comparable), without votes the best named row. Its identity wins; up to two more come from its spectrum; further
    qualified identities are sample differences. Gives feature, identity, ord (of its best row), role, position, support, voting, status.
    """
    named = rows.where(F.coalesce("name", F.lit("")) != "")
    top = named.where("rank = 1")
    tied = top.groupBy("feature", "spectrum").agg((F.min("identity") != F.max("identity")).alias("tied"))
    sure = top.where("qualified")
    samples = sure.where(F.coalesce("source", F.lit("")) != "").join(tied, ["feature", "spectrum"])
    samples = samples.groupBy("feature", "source").agg(F.min("identity").alias("identity"), F.max("identity").alias("_other"), F.max("tied").alias("_tied"))
    votes = samples.withColumn("clear", (F.col("identity") == F.col("_other")) & ~F.col("_tied"))
    ambiguous = votes.groupBy("feature").agg(F.count_if(~F.col("clear")).alias("ambiguous"), F.count_if("clear").alias("voting"))
    support = votes.where("clear").groupBy("feature", "identity").agg(F.count("*").alias("support"))
    most = support.groupBy("feature").agg(F.max("support").alias("support"))
    leaders = support.join(most, ["feature", "support"]).select("feature", "identity")
    n_leaders = leaders.groupBy("feature").agg(F.count("*").alias("leaders"))
    led = sure.join(leaders, ["feature", "identity"], "left_semi")
    mixed = led.groupBy("feature").agg((F.min("comparable") != F.max("comparable")).alias("_mixed"))
    pool = led.join(mixed, "feature").unionByName(named.join(n_leaders, "feature", "left_anti").withColumn("_mixed", F.lit(False)))
    plain = lambda c: F.when(F.col("_mixed"), F.lit(0.0)).otherwise(c)
    order = F.struct(plain(-F.col("qualified").cast("double")).alias("q"), plain(F.col("rank").cast("double")).alias("r"), plain(-F.col("score")).alias("s"), "ord", "identity", "spectrum")
    anchor = pool.groupBy("feature").agg(F.min(order).alias("_a")).select("feature", F.col("_a.identity").alias("winner"), F.col("_a.spectrum").alias("spectrum"))
    seeded = named.join(anchor, ["feature", "spectrum"])
    seeds = distinct_identities(seeded, ["feature"], "identity", [F.col("rank"), F.desc("score"), F.col("ord")])
    others = seeds.where("identity <> winner").select("feature", "identity", F.col("place").alias("_r"))
    main = anchor.select("feature", F.col("winner").alias("identity"), F.lit(0).alias("_r")).unionByName(others)
    main = topk(main, ["feature"], [F.col("_r")], 3).select("feature", "identity", F.col("rank").alias("position"), F.lit("representative").alias("role"))
    extra = sure.select("feature", "identity").distinct().join(main, ["feature", "identity"], "left_anti")
    every = main.unionByName(extra.withColumns({"position": F.lit(None).cast("int"), "role": F.lit("sample_difference")}))
    pick = F.min(F.struct((-F.col("qualified").cast("int")).alias("q"), (-F.col("score")).alias("s"), "rank", "ord"))
    best = named.groupBy("feature", "identity").agg(pick.alias("_b")).select("feature", "identity", F.col("_b.ord").alias("ord"))
    out = every.join(best, ["feature", "identity"]).join(support, ["feature", "identity"], "left").join(ambiguous, "feature", "left").join(n_leaders, "feature", "left")
    status = F.when(F.col("leaders") > 1, "tied").when(F.col("ambiguous") > 0, "sample_conflict").when(F.col("leaders") == 1, "supported").otherwise("no_qualified_top1")
    return out.select("feature", "identity", "ord", "role", "position", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("voting", F.lit(0)).alias("voting"), status.alias("status"))


def relation_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up of the checks of a pair (status, pearson, cosine for each sample): counts, medians and the verdict."""
    against = F.col("status").isin("shape_disagreement", "local_peak_disagreement", "local_mass_disagreement")
    measured = F.col("status").isin("supported", "shape_disagreement")
    out = rows.groupBy(*keys).agg(
        F.count_if(measured).alias("shape_samples"), F.count_if(F.col("status") == "supported").alias("supported_samples"), F.count_if(against).alias("rejected_samples"),
        F.median(F.when(measured, F.col("pearson"))).alias("pearson_median"), F.median(F.when(measured, F.col("cosine"))).alias("cosine_median"),
    )
    verdict = F.when((F.col("supported_samples") > 0) & (F.col("rejected_samples") > 0), "mixed_evidence").when(F.col("supported_samples") > 0, "EIC_supported").when(F.col("rejected_samples") > 0, "rejected").otherwise("mass_RT_only")
    return out.withColumn("verdict", verdict)


def matched_sums(matches: str) -> list[Column]:
    """Sums over an array of matches in their order: intensity and relative intensity."""
    total = lambda f: F.aggregate(matches, F.lit(0.0), lambda a, m: a + m[f])
    return [total("intensity").alias("matched_intensity_sum"), total("relative_intensity").alias("matched_relative_intensity_sum")]


def chain_evidence(tokens: Column, matched: Column, unlabelled: Column) -> Column:
    """Chains of a name that are matched, each as often as the name has it, and unlabelled matches, at most all chains.

    ``tokens`` are the name's chains with repeats, ``matched`` the chains of qualifying fragments, ``unlabelled`` the number of those
    without a chain of the name.
    """
    found = F.size(F.filter(tokens, lambda t: F.array_contains(matched, t))) + unlabelled
    return F.when(F.size(tokens) == 0, unlabelled).otherwise(F.least(found, F.size(tokens)))


def consensus_features(members: DataFrame, key: str) -> DataFrame:
    """Peak members of a consensus (source_file, mz, rt, rt_min, rt_max, intensity, ord): mean mass and time, union of bounds, sample count."""
    out = members.groupBy(key).agg(
        F.avg("mz").alias("mz"), F.avg("rt").alias("rt"), F.min("rt_min").alias("rt_min"), F.max("rt_max").alias("rt_max"), F.count_distinct("source_file").alias("n_samples"), F.sum("intensity").alias("intensity")
    )
    return _with_lists(out, ordered_lists(members, key, "ord", {"samples": "source_file"}), key)


def largest_members(members: DataFrame, key: str, sample: str, value: str, kind: str, least_qc: float) -> DataFrame:
    """The largest member of each sample, for features found in at least ``least_qc`` of the QC samples."""
    top = members.groupBy(key, sample, kind).agg(F.max(value).alias(value))
    n_qc = members.where(F.col(kind) == "QC").agg(F.count_distinct(sample).alias("_all"))
    seen = top.groupBy(key).agg(F.count_if((F.col(kind) == "QC") & (F.col(value) > 0)).alias("_seen"))
    kept = seen.crossJoin(F.broadcast(n_qc)).where(F.col("_seen") >= F.col("_all") * least_qc).select(key)  # one row
    return top.join(kept, key, "left_semi")


def carbon_curve(points: DataFrame, keys: list[str], carbon: str, rt: str) -> DataFrame:
    """A line through the median time of each carbon: slope and intercept, null for fewer than two carbons."""
    middle = points.groupBy(*keys, carbon).agg(F.median(rt).alias("_rt"))
    return middle.groupBy(*keys).agg(F.count("*").alias("n_carbons"), F.regr_slope("_rt", carbon).alias("slope"), F.regr_intercept("_rt", carbon).alias("intercept"))


def scan_counts(scans: DataFrame, file: str, level: str) -> DataFrame:
    return scans.groupBy(file).agg(F.count_if(F.col(level) == 1).alias("ms1_scans"), F.count_if(F.col(level) == 2).alias("ms2_scans"))


def series_input(rows: DataFrame, lipid: str, subclass: str, rt: str, rank: str | None = None, score: str | None = None, sample: str | None = None) -> DataFrame:
    """Rows as the retention models take them: parsed name, given or parsed subclass, minutes, rank 1 and an empty sample by default.

    A time column whose name has ``sec`` or ends with ``_s`` holds seconds.
    """
    minutes = F.col(rt).cast("string").try_cast("double") / (60 if "sec" in rt.lower() or rt.lower().endswith("_s") else 1)
    number = lambda c, kind: F.col(c).cast("string").try_cast(kind) if c else F.lit(None).cast(kind)
    out = with_parsed(rows, F.col(lipid), F.col(subclass), "_p").withColumns({"rt_minutes": minutes, "_rank": F.coalesce(number(rank, "double").cast("int"), F.lit(1)), "_score": number(score, "double"), "_sample": F.coalesce(F.col(sample).cast("string"), F.lit("")) if sample else F.lit("single_sample")})
    named = F.coalesce(F.col(subclass), F.col("_p.subclass"))
    kept = [c for c in rows.columns if c not in (rank, score, sample, "rank", "score", "sample")]
    return out.select(*kept, "rt_minutes", F.col("_p.lipidname_norm").alias("lipidname_norm"), F.col("_p.total_c").alias("total_c"), F.col("_p.total_db").alias("total_db"), named.alias("subclass"), F.col("_rank").alias("rank"), F.col("_score").alias("score"), F.col("_sample").alias("sample"))


def measured_areas(rows: DataFrame, samples: list[str]) -> DataFrame:
    """Area columns of samples: an aligned area stands; a feature without an alignment gives its own area to its own sample alone.

    Rows: aligned, source_file, own_area and the sample columns.
    """
    local = F.coalesce(F.trim("aligned"), F.lit("")) == ""
    return rows.withColumns({s: F.coalesce(F.col(f"`{s}`"), F.when(local & (F.col("source_file") == s), F.col("own_area"))) for s in samples})


def attach_masses(features: DataFrame, matches: DataFrame) -> DataFrame:
    """Features (key, identified, compound_class) with their best mass match (ms1_rank 1) and the number of matches; features without a
    result take over the match's class and are marked."""
    best = matches.where("ms1_rank = 1").groupBy("key").agg(F.min(F.struct("candidate_name", "candidate_class")).alias("_b"))
    counts = matches.groupBy("key").agg(F.count("*").alias("_n"))
    out = features.join(best, "key", "left").join(counts, "key", "left")
    open_ = ~F.col("identified") & F.col("_b").isNotNull()
    return out.withColumns({"compound_class": F.when(open_, F.col("_b.candidate_class")).otherwise(F.col("compound_class")), "confidence": F.when(open_, "no MS2"), "ms1_candidate_name": F.col("_b.candidate_name"), "ms1_candidate_count": F.coalesce("_n", F.lit(0)).cast("long")}).drop("_b", "_n")
