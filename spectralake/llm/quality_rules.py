"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

Four transformed statistics of every text (log mean word length; square roots of the shares of symbols per word, of
repeated lines per line and of words in repeated 3-word windows) form a vector. For each (language, source) the minimum
covariance determinant is found by concentration steps from two deterministic starts, and a text whose squared robust
Mahalanobis distance exceeds the chi-square quantile is rejected. A step is one grouped aggregation: rows are binned by
distance and each bin keeps its count, sums and products, so the half of least distance is read off the bins (a bin is
taken whole) and no row is collected anywhere. Sources with fewer than ``MIN_GROUP`` texts are pooled by language, and
those pools by one pool of all; covariances get the variances ``FLOOR``\\ ² added, so no group is singular.

Null and empty texts have no words and fail the limits. Null languages and sources are groups of their own; without such a
column all rows share one. Repeated rows are judged one by one and count as often as they stand there; texts at one distance
stand in one bin, which the core takes whole, so ties don't depend on any order. An empty table gives an empty table. A very
long text costs memory in proportion to its words. Other columns are carried along whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from spectralake.llm.common import encoded, enter, grams, saved, word_hashes

P = 4
#: Standard deviations that every estimate gets at least: differences below them say nothing about quality.
FLOOR = (0.08, 0.06, 0.2, 0.15)
#: Share of a group's texts that the estimate rests on, the chi-square probability of rejection, concentration steps.
CORE, LEVEL, STEPS = 0.5, 0.9999, 8
MIN_GROUP, MIN_WORDS, MAX_REPEATED = 50, 50, 50
#: Groups whose estimates (under 400 bytes each) may be broadcast; beyond it they are joined by salted shuffles.
BROADCAST_GROUPS, SALTS = 20_000, 32
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOLS = b"#*$%&|<>"


def statistics_of(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    data = encoded(text)
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        _, inverse, counts = np.unique(grams(word_hashes(words), 3), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return n, chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def with_statistics(documents: DataFrame, columns: list[str], text: bool = False) -> DataFrame:
    """A struct ``row`` of the columns, a struct ``stats`` of STATS, and the text itself if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_rules")
        for b in batches:
            rows = np.array([statistics_of(x.as_py()) for x in b.column("text")], np.int64).reshape(-1, len(STATS))
            stats = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], names=list(STATS))
            yield pa.RecordBatch.from_arrays([b.column("row"), stats, *([b.column("text")] if text else [])], names=["row", "stats", *(["text"] if text else [])])

    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    base = documents.select(row.alias("row"), "text")
    stats = StructType.fromDDL("stats struct<" + ",".join(f"{c}:bigint" for c in STATS) + ">").fields
    return base.mapInArrow(work, StructType([StructField("row", base.schema["row"].dataType), *stats, *([base.schema["text"]] if text else [])]))


def vector() -> list[Column]:
    s = {c: F.col(f"stats.{c}").cast("double") for c in STATS}
    n = F.greatest(s["n_words"], F.lit(1.0))
    return [F.log(F.greatest(s["word_chars"], F.lit(1.0)) / n), F.sqrt(s["n_symbols"] / n), F.sqrt(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1.0))), F.sqrt(s["n_repeat_words"] / n)]


def base_failed() -> Column:
    return (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > MAX_REPEATED * F.col("stats.n_words"))


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


CUTOFF = chi2_quantile(LEVEL, P)
#: Makes the covariance of the core consistent for normal data.
_FACTOR = CORE / chi2_cdf(chi2_quantile(CORE, P), P + 2)


def _named(rows: DataFrame, column: str) -> Column:
    """The group's name; a missing column is one group, like nulls."""
    if column not in rows.schema["row"].dataType.names:
        return F.lit("-")
    return F.when(F.col(f"row.{column}").isNull(), "-").otherwise(F.concat(F.lit("="), F.col(f"row.{column}").cast("string")))


def _attach(rows: DataFrame, groups: DataFrame, count: int, on: list[str]) -> DataFrame:
    if count <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on)
    salted = groups.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*[f"_x{i}" for i in range(P)]), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def _distance() -> Column:
    d = [F.col(f"_x{i}") - F.col("_mean")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col("_inverse")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def _estimates(sums: DataFrame, keys: list[str]) -> DataFrame:
    """From counts, sums and products: mean, inverse covariance and its log determinant."""
    first, second = [f"_s{i}" for i in range(P)], [f"_p{i}_{j}" for i in range(P) for j in range(i, P)]

    def work(batches: Iterator) -> Iterator:
        enter("quality_rules")
        for pdf in batches:
            out = {k: pdf[k] for k in keys}
            n = pdf["_n"].to_numpy(float)[:, None]
            mean = pdf[first].to_numpy(float) / n
            cov = np.zeros((len(pdf), P, P))
            for (i, j), c in zip([(i, j) for i in range(P) for j in range(i, P)], second, strict=True):
                cov[:, i, j] = cov[:, j, i] = pdf[c].to_numpy(float) / n[:, 0] - mean[:, i] * mean[:, j]
            cov = cov * _FACTOR + np.diag(np.square(FLOOR))
            out |= {"_mean": list(mean), "_inverse": list(np.linalg.inv(cov).reshape(len(pdf), -1)), "_logdet": np.linalg.slogdet(cov)[1]}
            yield type(pdf)(out)

    shape = ", ".join([*(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys), "_mean array<double>", "_inverse array<double>", "_logdet double"])
    return sums.select(*keys, "_n", *first, *second).mapInPandas(work, shape)


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: medians and interquartile ranges; start 1: medians and FLOOR. Both from histograms of 1/1024 steps."""
    long = rows.select("_g", F.posexplode(F.array(*[F.round(F.col(f"_x{i}") * 1024).cast("long") for i in range(P)])).alias("_i", "_b"))
    bins = long.groupBy("_g", "_i", "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_g", "_i")
    upto = bins.withColumn("_cum", F.sum("_c").over(w.orderBy("_b"))).withColumn("_all", F.sum("_c").over(w))
    at = lambda p: F.min(F.when(F.col("_cum") >= F.col("_all") * p, F.col("_b"))) / 1024.0
    q = upto.groupBy("_g", "_i").agg(at(0.25).alias("_lo"), at(0.5).alias("_mid"), at(0.75).alias("_hi"))
    q = q.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_i", "_lo", "_mid", "_hi"))).alias("_q"))
    zero = F.lit(0.0)

    def inverse(start: int) -> Column:
        spread = [F.greatest((F.col("_q")[i]["_hi"] - F.col("_q")[i]["_lo"]) / 1.349, F.lit(f)) if start == 0 else F.lit(f) for i, f in enumerate(FLOOR)]
        return F.array(*[1 / (spread[i] * spread[i]) if i == j else zero for i in range(P) for j in range(P)])

    starts = F.array(*[F.struct(F.lit(s).alias("_start"), inverse(s).alias("_inverse")) for s in (0, 1)])
    return q.select("_g", F.array(*[F.col("_q")[i]["_mid"] for i in range(P)]).alias("_mean"), F.explode(starts).alias("_e")).select("_g", "_e._start", "_mean", "_e._inverse", F.lit(None).cast("double").alias("_logdet"))


def _step(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    products = [(i, j) for i in range(P) for j in range(i, P)]
    d = F.least(F.greatest(F.round(F.log(_distance() + 1e-6) * 64), F.lit(-900)), F.lit(1800)).cast("int")
    bins = (
        _attach(rows, groups.select("_g", "_start", "_mean", "_inverse"), count, ["_g"])
        .groupBy("_g", "_start", d.alias("_b"))
        .agg(F.count("*").alias("_n"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(P)], *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}_{j}") for i, j in products])
    )
    w = Window.partitionBy("_g", "_start")
    core = bins.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(w)).where(F.col("_before") < F.ceil(F.col("_all") * CORE))
    names = ["_n", *[f"_s{i}" for i in range(P)], *[f"_p{i}_{j}" for i, j in products]]
    return _estimates(core.groupBy("_g", "_start").agg(*[F.sum(c).alias(c) for c in names]), ["_g", "_start"])


def _pooled(rows: DataFrame) -> DataFrame:
    """(_lang, _source) -> _g, the group whose estimate they share."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    own = F.col("_n") >= MIN_GROUP
    pool = sizes.groupBy("_lang").agg(F.sum(F.when(~own, F.col("_n")).otherwise(0)).alias("_pool"))
    group = F.when(own, F.concat_ws("\u0001", "_lang", "_source")).when(F.col("_pool") >= MIN_GROUP, F.col("_lang")).otherwise("*")
    return sizes.join(pool, "_lang").select("_lang", "_source", group.alias("_g"))


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(estimate for each _lang and _source, their number) from rows with ``row`` and ``stats``."""
    x = rows.where(~base_failed()).select(_named(rows, "lang").alias("_lang"), _named(rows, "source").alias("_source"), *[v.alias(f"_x{i}") for i, v in enumerate(vector())])
    names = saved(_pooled(x))
    count = names.count()
    x = saved(_attach(x, names, count, ["_lang", "_source"]).select("_g", *[f"_x{i}" for i in range(P)]))
    groups = saved(_starts(x))
    before = None
    for _ in range(STEPS):
        groups = saved(_step(x, groups, count))
        now = groups.agg(F.sum("_logdet")).first()[0] or 0.0
        if before is not None and abs(now - before) <= 1e-9 * max(1.0, abs(now)):
            break
        before = now
    best = groups.groupBy("_g").agg(F.min_by(F.struct("_mean", "_inverse"), F.struct("_logdet", "_start")).alias("_e")).select("_g", "_e.*")
    return saved(names.join(best, "_g").drop("_g")), count


def judged(rows: DataFrame) -> DataFrame:
    """Adds _failed, _distance (squared; null where the limits failed already) and _kept to rows with ``row`` and ``stats``."""
    model, count = estimates(rows)
    named = rows.select("*", _named(rows, "lang").alias("_lang"), _named(rows, "source").alias("_source"), *[v.alias(f"_x{i}") for i, v in enumerate(vector())])
    failed = named.where(base_failed()).select("*", F.lit(None).cast("array<double>").alias("_mean"), F.lit(None).cast("array<double>").alias("_inverse"))
    passed = _attach(named.where(~base_failed()), model, count, ["_lang", "_source"])
    both = passed.select(*failed.columns).unionByName(failed)
    return both.withColumn("_failed", base_failed()).withColumn("_distance", _distance()).withColumn("_kept", ~F.col("_failed") & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= CUTOFF))


def judge(documents: DataFrame) -> DataFrame:
    """One row for each document: its statistics, base_failed, kept and the squared distance."""
    rows = saved(with_statistics(documents, [c for c in ("doc_id", "lang", "source") if c in documents.columns]))
    return judged(rows).select("row.doc_id", *[F.col(f"stats.{c}").alias(c) for c in STATS[:5]], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))


def keep(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, unchanged; texts are read once and wait with their statistics for the verdict."""
    rows = saved(with_statistics(documents, [c for c in documents.columns if c != "text"], text=True))
    return judged(rows).where("_kept").select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
