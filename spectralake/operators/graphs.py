"""Ion pairs and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectralake.functions.masses import ION_MASSES
from spectralake.operators.joins import interval_join
from spectralake.session import reliable


def ion_pairs(rows: DataFrame, key: str, mz: str, on: list[str], deltas: dict[str, float], ppm: float, width: float = 0.05) -> DataFrame:
    """Pairs whose masses differ by one of ``deltas`` within ppm of the lighter mass; self-join on bins, per value of ``on``."""
    table = F.array(*[F.struct(F.lit(k).alias("form"), F.lit(v).alias("delta")) for k, v in deltas.items()])
    left = rows.select(*on, F.col(key).alias("id_a"), F.col(mz).alias("mz_a"), F.explode(table).alias("_f")).select("*", F.col("_f.form").alias("form"), (F.col("mz_a") + F.col("_f.delta")).alias("_at")).drop("_f")
    right = rows.select(*on, F.col(key).alias("id_b"), F.col(mz).alias("mz_b"))
    tol = F.col("mz_a") * ppm * 1e-6
    return interval_join(left, right, F.col("_at") - tol, F.col("_at") + tol, F.col("mz_b"), width, on=on, deal=True).drop("_at")


#: Keys of one place that a row of ion_relations' join carries.
KEYS = 512


def ion_relations(rows: DataFrame, key: str, mode: str, ppm: float = 5.0, rt_minutes: float = 0.05, width: float = 0.5) -> DataFrame:
    """Pairs of features that may be two ions of one molecule: rows have ``key``, mz, rt and samples (array of those they are found in).

    For each pair of ion forms the heavier must lie within ppm of the neutral mass of where the lighter one puts it, the times
    must agree and a sample must have both. Self-join on bins of mass and time, shuffled on both sides: the driver holds no side.
    Features of one mass, time and set of samples meet the same ones: only such places are joined, with up to KEYS features a row,
    and a pair of places becomes its pairs of features once everything else about it is known.
    """
    forms = sorted(ION_MASSES[mode].items(), key=lambda x: x[1])
    pairs = F.array(*[F.struct(F.lit(a).alias("ion_a"), F.lit(b).alias("ion_b"), F.lit(m).alias("m_a"), F.lit(n).alias("m_b")) for i, (a, m) in enumerate(forms) for b, n in forms[i + 1 :]])
    step = max(2 * rt_minutes, 1e-6)
    times = F.sequence(F.floor((F.col("rt") - rt_minutes) / step - 1e-6), F.floor((F.col("rt") + rt_minutes) / step + 1e-6))
    one = rows.select(F.col(key).alias("_key"), "mz", "rt", F.array_sort(F.array_distinct("samples")).alias("s"))
    part = F.floor((F.row_number().over(Window.partitionBy("mz", "rt", "s").orderBy("_key")) - 1) / KEYS)
    places = one.withColumn("_part", part).groupBy("mz", "rt", "s", "_part").agg(F.collect_list("_key").alias("keys"))
    left = places.select(F.col("keys").alias("keys_a"), F.explode(times).alias("_t"), F.col("mz").alias("mz_a"), F.col("rt").alias("rt_a"), F.col("s").alias("s_a"))
    left = left.select("*", F.explode(pairs).alias("f")).select("*", "f.*").drop("f")
    right = places.select(F.col("keys").alias("keys_b"), F.floor(F.col("rt") / step).alias("_t"), F.col("mz").alias("mz_b"), F.col("rt").alias("rt_b"), F.col("s").alias("s_b"))
    neutral = F.col("mz_a") - F.col("m_a")
    target, tol = F.col("mz_a") + (F.col("m_b") - F.col("m_a")), neutral * ppm * 1e-6
    near = interval_join(left.where(neutral > 0), right, target - tol, target + tol, F.col("mz_b"), width, on=["_t"], deal=True)
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    near = near.where((F.abs(F.col("rt_a") - F.col("rt_b")) <= rt_minutes) & (shared > 0))
    met = near.select(
        "keys_a", "keys_b", "ion_a", "ion_b", ((neutral + F.col("mz_b") - F.col("m_b")) / 2).alias("neutral_mass"), ((F.col("mz_b") - target) / neutral * 1e6).alias("mass_error_ppm"),
        F.abs(F.col("rt_a") - F.col("rt_b")).alias("rt_difference_min"), shared.alias("shared_samples"),
    )
    known = ["ion_a", "ion_b", "neutral_mass", "mass_error_ppm", "rt_difference_min", "shared_samples"]
    out = met.select(F.explode("keys_a").alias("feature_a"), "keys_b", *known).select("feature_a", F.explode("keys_b").alias("feature_b"), *known)
    return out.where(F.col("feature_a") != F.col("feature_b"))


def confirmed_relations(relations: DataFrame, ppm: float = 5.0) -> DataFrame:
    """Links of components in which every feature is one ion, no ion comes twice and the neutral masses agree.

    Relations: feature_a, feature_b, ion_a, ion_b, neutral_mass, status, shared_samples, supported_samples, rejected_samples; only those
    that every shared sample supports and none rejects take part. A component that fails loses all its links.
    """
    ok = (F.col("status") == "EIC_supported") & (F.col("shared_samples") > 0) & (F.col("supported_samples") == F.col("shared_samples")) & (F.col("rejected_samples") == 0)
    links = relations.where(ok)
    members = components(links, "feature_a", "feature_b")
    ends = links.select(F.col("feature_a").alias("node"), F.col("ion_a").alias("ion"), "neutral_mass").unionByName(links.select(F.col("feature_b").alias("node"), F.col("ion_b").alias("ion"), "neutral_mass"))
    nodes = ends.groupBy("node").agg(F.min("ion").alias("ion"), F.max("ion").alias("_other"), F.min("neutral_mass").alias("low"), F.max("neutral_mass").alias("high"), F.count_if(F.col("neutral_mass").isNull() | F.isnan("neutral_mass")).alias("_bad"))
    judged = nodes.join(members, "node").groupBy("component").agg(
        F.count("*").alias("n"), F.count_distinct("ion").alias("ions"), F.max((F.col("ion") != F.col("_other")).cast("int")).alias("several"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("_bad").alias("bad")
    )
    valid = judged.where("several = 0 and n = ions and bad = 0 and low > 0").where(F.col("high") - F.col("low") <= F.col("low") * ppm * 1e-6).select("component")
    kept = members.join(valid, "component", "left_semi").select(F.col("node").alias("feature_a"))
    return links.join(kept, "feature_a", "left_semi").select("feature_a", "feature_b", "ion_a", "ion_b", "neutral_mass")


def relation_labels(links: DataFrame) -> DataFrame:
    """For each feature its partners as lines, in order: both directions of every link."""
    both = links.select(F.col("feature_a").alias("feature"), F.col("ion_a").alias("ion"), F.col("feature_b").alias("partner"), F.col("ion_b").alias("partner_ion"))
    both = both.unionByName(links.select(F.col("feature_b").alias("feature"), F.col("ion_b").alias("ion"), F.col("feature_a").alias("partner"), F.col("ion_a").alias("partner_ion")))
    line = F.concat(F.col("ion"), F.lit(" - "), F.col("partner").cast("string"), F.lit(" "), F.col("partner_ion"))
    return both.groupBy("feature").agg(F.count("*").alias("n_links"), F.array_join(F.array_sort(F.collect_set(line)), "; ").alias("lines"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable. Labels spread with pointer jumping; each round is checkpointed."""
    reliable(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("component")).select(F.col("x").alias("node"), "component").checkpoint()
    while True:
        low = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("low"))
        step = labels.join(low, labels.node == low.x).select("node", F.col("component").alias("old"), F.least("component", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = step.join(jump, "next", "left").select("node", "old", F.least("next", "far").alias("component")).checkpoint()
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
