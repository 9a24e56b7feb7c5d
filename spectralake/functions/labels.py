"""Decisions and display texts of annotation rows, as expressions over their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectralake.functions.names import class_key

# Texts that saved tables hold.
HIGH, LOW = "高", "低"
PASSED, FAILED, UNKNOWN = "通过", "未通过", "无法判断"
SUPPORTED, CONFIRMED = "MS1-supported", "confirmed_ms1_precursor_without_feature"
MISSING_CHAIN = [
    "missing_chain_level_information", "insufficient_independent_chain_evidence", "multiple_fragments_single_chain_coverage", "missing_chain_annotation",
    "insufficient_oxidized_chain_evidence", "missing_lcb_chain_evidence", "missing_fah_chain_evidence",
]
UNJUDGED = ["not_requested", "unmodeled", "outside_domain_or_missing_rt", "retain_unmodeled", "species_not_evaluated", "score_reject"]
KEPT = ["pass", "high_confidence_pass", "low_confidence_rescued", "species_rescued"]
NO_FEATURE = ["no_ms1_feature_for_sample", "no_ms1_feature_within_mz_tolerance"]
CONFIRMATION_PPM, GAP_SECONDS = 3.0, 10.0


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def present(c: Column) -> Column:
    return ~F.lower(F.trim(text(c))).isin("", "nan", "none", "<na>")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def confirmed_precursor(status: Column, source: Column, scan: Column, native: Column, count: Column, mz: Column, ms1_mz: Column, ms1_rt: Column, ms2_rt: Column) -> Column:
    """Whether a survey scan proves the precursor: one centroid, confirmed nearby, close in mass and at most 10 s earlier."""
    numbers = [c.try_cast("double") for c in (count, mz, ms1_mz, ms1_rt, ms2_rt)]
    n, a, b, t1, t2 = numbers
    known = F.lit(True)
    for c in numbers:
        known = known & _finite(c)
    sane = (n >= 1) & (n == F.floor(n)) & (a > 0) & (b > 0) & (t1 >= 0)
    gap = (t2 - t1) * 60
    near = (F.try_divide(F.abs(a - b), b) * 1e6 <= CONFIRMATION_PPM) & (gap >= -1e-7) & (gap <= GAP_SECONDS + 1e-7)
    ok = (text(status) == "confirmed") & text(source).isin("MS1_REFERENCE_CENTROID", "MS1_PRECEDING_CENTROID") & (present(scan) | present(native)) & known & sane & near
    return F.coalesce(ok, F.lit(False))


def restore_support(rows: DataFrame, confirmed: Column) -> DataFrame:
    """Rows that a survey scan proves count as supported; the reason that the link gave moves to its own column."""
    back = confirmed & (text(F.col("ms1_support_status")) != SUPPORTED)
    reason = F.col("ms1_support_reason")
    link = F.col("ms1_feature_link_reason") if "ms1_feature_link_reason" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns(
        {
            "ms1_feature_link_reason": F.when(back, reason).otherwise(link),
            "ms1_support_status": F.when(back, SUPPORTED).otherwise(F.coalesce("ms1_support_status", F.lit("MS2-only"))),
            "ms1_support_reason": F.when(back, CONFIRMED).otherwise(reason),
            "ms1_evidence_source": F.when(back, "confirmed_ms1_precursor"),
        }
    )


def confidence(score: Column, evidence: Column, reason: Column, resolution: Column, level: Column, gates: Column) -> Column:
    """High or low: score, precursor evidence, reason of a downgrade, resolution, gates, in this order."""
    s = score.try_cast("double")
    weak = ~_finite(s) | (s < 50)
    why = text(reason)
    return (
        F.when(weak, LOW)
        .when(~evidence, LOW)
        .when(why.startswith("missing_positive_gate") | why.startswith("missing_required_"), LOW)
        .when(why.isin(MISSING_CHAIN), LOW)
        .when(text(resolution).startswith("tentative_"), LOW)
        .when(text(level).startswith("暂定"), LOW)
        .otherwise(F.when(F.lower(text(gates)) == "true", HIGH).otherwise(LOW))
    )


def level_label(resolution: Column, gates: Column | None = None) -> Column:
    """Chain or species level; tentative for tentative resolutions and failed gates."""
    r = F.lower(F.trim(text(resolution)))
    label = F.when(r.isin("double_bond_level", "tentative_double_bond_level", "chain_level", "tentative_chain_level"), "链水平").otherwise("分子种类水平")
    tentative = text(resolution).startswith("tentative_")
    if gates is not None:
        tentative = tentative | (gates == F.lit(False))
    return F.when(F.coalesce(tentative, F.lit(False)), F.concat(F.lit("暂定"), label)).otherwise(label)


def exported(score: Column, rt: Column, mz: Column, ppm: Column, feature_rt: Column, support: Column) -> list[Column]:
    """Rounded columns of a result row; a row without a feature has no feature time."""
    clip = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return [
        F.bround(clip, 2).alias("final_score"), F.bround(rt, 3).alias("rt_minutes"), F.bround(mz, 4).alias("precursor_mz"), F.bround(ppm, 2).alias("ppm_error"),
        F.when(F.coalesce(support, F.lit("未评估")) != "MS2-only", F.bround(feature_rt, 3)).alias("feature_rt"), F.coalesce(support, F.lit("未评估")).alias("ms1_support_status"),
    ]


def precursor_fields(raw_mz: Column, theoretical: Column, ms1_rt_seconds: Column, status: Column) -> list[Column]:
    """Provenance of the precursor mass; all null where no refinement was made."""
    known = status.isNotNull()
    return [
        F.when(known, raw_mz).alias("precursor_mz_raw"), F.when(known, status).alias("precursor_refinement_status"),
        F.when(known, ms1_rt_seconds / 60).alias("precursor_ms1_rt_raw_min"), F.when(known, F.try_divide(raw_mz - theoretical, theoretical) * 1e6).alias("raw_precursor_ppm_error"),
    ]


def ecn_status(action: Column, passed: Column) -> Column:
    a, p = text(action), F.lower(text(passed))
    return F.when(a.isin(UNJUDGED), UNKNOWN).when(a.isin(KEPT), PASSED).when(a.isin("reject", "suspect"), FAILED).when(p == "true", PASSED).when(p == "false", FAILED).otherwise(UNKNOWN)


def feature_display(status: Column, reason: Column, link_reason: Column, detected: Column, identified: Column, ids: list[Column], times: list[Column], name: Column, scan: Column) -> Column:
    """Linked, Not detected, Unlinked or Detected; ``ids`` are those of the feature, ``times`` its measured times."""
    s, why = text(status), F.when(text(link_reason) != "", text(link_reason)).otherwise(text(reason))
    own = F.lit(False)
    for c in ids:
        own = own | (text(c) != "")
    timed = F.lit(False)
    for c in times:
        timed = timed | F.coalesce(_finite(c.try_cast("double")), F.lit(False))
    proved = text(reason) == CONFIRMED
    return (
        F.when((F.coalesce(detected.try_cast("double"), F.lit(0.0)) > 0) & F.coalesce(identified, F.lit(False)), "Linked")
        .when(why.isin(NO_FEATURE) & ~own, "Not detected")
        .when(proved & text(link_reason).isin(NO_FEATURE), "Not detected")
        .when(proved, "Unlinked")
        .when((s == SUPPORTED) & (text(name) == "") & (text(scan) == ""), "Detected")
        .when((s == SUPPORTED) & ~own & ~timed, "Unlinked")
        .when(s == SUPPORTED, "Linked")
        .when(s == "MS1-only", "Detected")
        .when(s == "MS2-only", "Unlinked")
        .when(s == "", "—")
        .otherwise(s)
    )


def evidence_display(status: Column, reason: Column, confirmed: Column, display: Column) -> Column:
    return (
        F.when((text(reason) == CONFIRMED) | confirmed, "Confirmed precursor")
        .when(text(status) == SUPPORTED, F.when(display == "Unlinked", "Supported").otherwise("Detected feature"))
        .when(text(reason) == "no_ms1_scans", "Missing")
        .otherwise("Unconfirmed")
    )


# Families of classes that their first letters don't tell.
FAMILIES = {
    "GP": "CDPDG CEPE LCEPE GPNAE PMEOH LPMEOH LDMPE HBMP LPHEG ASPL NAGPS AC2PIM1 AC2PIM2 AC3PIM2 AC4PIM2 GLCGP 6ACGLCGP ALANYLPG ASPPG LEUPG LYSPG CPA PNE LPNE PNEP PLASMENYLPNE PHEG PPA PTHR LNAPS AMLPE AMPE AMPEO AMLPS AMPS",
    "GL": "LDGCC LDGTS LDGTA SMGDG SMGDGO SQMG MANGLCADAG", "SP": "IPC HEXIPC MIPC", "FA": "APCS NAASP NAT WE",
    "ST": "VD VITAMIND CASE SISE STSE BA BILEACID BASULFATE SSULFATE", "PR": "VE VITAMINE VAE",
}
PREFIXES = [
    ("GP", "PC PE PG PS PA PI LPC LPE LPG LPS LPA LPI CL MLCL DLCL BMP PDPT NAPE LNAPE NAPS DMPE MMPE"), ("GL", "TG DG MG DGDG MGDG SQDG ADGGA"),
    ("SP", "SM LSM ASM SL SPH DHSPH PHYTOSPH SPB GM GD GT GQ GB"), ("FA", "FA CAR NAE NAGLY NASER NAORN NATAU"),
]


def family(compound_class: Column) -> Column:
    key = F.regexp_replace(class_key(compound_class), "^(?:OX|ETHER)+", "")
    out = None
    for name, members in FAMILIES.items():
        out = F.when(key.isin(members.split()), name) if out is None else out.when(key.isin(members.split()), name)
    out = out.when(key.rlike(r"^COQ\d*$"), "PR").when(key.contains("CER"), "SP")
    for name, starts in PREFIXES:
        out = out.when(key.rlike("^(?:" + "|".join(starts.split()) + ")"), name)
    return out.when(key.isin("CE", "BRSE", "CHOL", "CHOLESTEROL", "ST", "STEROID"), "ST").otherwise("Other")


def group_label(group: Column, kind: Column) -> Column:
    """QC and blank samples of the first group are named by their role."""
    return F.when(kind.isin("QC", "Blank") & (group == "1"), kind).otherwise(group)


# Losses of positive lysophosphatidylethanolamines and what they are made of.
LOSSES = {"C3H9O6P": ("(甘油-H2O)-H3PO4", "172.0137"), "C3H7O5P": ("(甘油-H2O)-HPO3", "154.0031"), "C3H6O2": ("(甘油-H2O)", "74.0368")}


def fragment_name(name: Column, compound_class: Column) -> Column:
    """Known losses of the class spelled out; other labels stay."""
    compact = F.replace(F.replace(name, F.lit(" "), F.lit("")), F.lit("−"), F.lit("-"))
    out = name
    for formula, (parts, mass) in LOSSES.items():
        out = F.when(compact.isin(f"[M+H-{formula}]+", f"[M-{formula}+H]+"), f"[M+H-{parts}]+（损失{mass} Da；{formula}）").otherwise(out)
    return F.when(class_key(compound_class).isin("LPE", "LPEO", "LPEP"), out).otherwise(name)


def fragment_label(name: Column) -> Column:
    """Oxygen suffixes spelled one way, repeated alternatives once."""
    spelled = F.regexp_replace(name, r"(\d+:\d+)[,;](\d+)O(\d*)(?![A-Za-z0-9])", "$1($2O)")
    spelled = F.regexp_replace(spelled, r"(\d+:\d+)[,;]O(\d+)(?![A-Za-z0-9])", "$1($2O)")
    spelled = F.regexp_replace(spelled, r"(\d+:\d+)[,;]O(?![A-Za-z0-9])", "$1(1O)")
    parts = F.filter(F.transform(F.split(spelled, r" \| "), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.array_distinct(parts), " | ")


def annotation_display(name: Column, mass_name: Column) -> Column:
    """The spectrum's name, else the mass match's marked as such, else unknown."""
    named = ~F.lower(F.trim(text(name))).isin("", "unknown", "nan")
    return F.when(named, name).when(text(mass_name) != "", F.concat(F.lit("no MS2: "), mass_name)).otherwise("unknown")


def first_nonempty(columns: list[Column], numeric: bool = False) -> Column:
    """The first value there is: a number, or a text that isn't empty."""
    if numeric:
        return F.coalesce(*[c.try_cast("double") for c in columns])
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def display_ids(rows: DataFrame, key: str, feature: str, order: str) -> DataFrame:
    """Adds display_id: a number that only one feature has stays, others get numbers above the largest; MS2-only keys keep theirs.

    The running number is dealt out per block of the order, so only counts of blocks meet in one task.
    """
    number = F.regexp_extract(text(F.col(feature)), r"^F?(\d+)(?:\.0)?$", 1)
    named = rows.withColumn("_n", F.when(number != "", number.cast("long"))).withColumn("_own", F.col(key).startswith("MS2|"))
    once = named.where("_n is not null").groupBy("_n").agg(F.count("*").alias("_c"))
    top = named.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_top"))
    marked = named.join(once, "_n", "left").withColumn("_open", ~F.col("_own") & ~F.coalesce(F.col("_c") == 1, F.lit(False)))
    marked = numbered(marked, order, F.col("_open"), "_i").crossJoin(F.broadcast(top))  # one row
    shown = F.when(F.col("_own"), F.col(feature)).when(~F.col("_open"), F.col("_n").cast("string")).otherwise((F.col("_top") + F.col("_i")).cast("string"))
    return marked.withColumn("display_id", shown).drop("_n", "_own", "_c", "_open", "_i", "_top")


def numbered(rows: DataFrame, order: str, counted: Column, name: str, block: int = 4096) -> DataFrame:
    """Running count of ``counted`` rows by a whole number ``order``: counts of blocks are summed apart, then rows within their block."""
    dealt = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_one", counted.cast("long"))
    blocks = dealt.groupBy("_block").agg(F.sum("_one").alias("_sum"))
    before = blocks.withColumn("_before", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).select("_block", "_before")
    inside = F.sum("_one").over(Window.partitionBy("_block").orderBy(order))
    return dealt.withColumn(name, inside).join(before, "_block").withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_one", "_before")


def feature_number(feature_id: Column) -> Column:
    """The number in a feature id: F12, FT12, 12 or the last digits; null without one."""
    s = F.trim(feature_id.cast("string"))
    tries = [F.regexp_extract(s, p, 1) for p in (r"^[Ff][Tt]?(\d+)$", r"^(\d+)$", r"(\d+)$")]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries]).cast("double")
