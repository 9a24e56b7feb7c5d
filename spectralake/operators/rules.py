"""Rules on matched fragments, kept as rows of a table: names, series, types by any, number and share, patterns by share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = "array<struct<types: array<string>, minimum: double>>"
RULE = (
    "rule string, required_all array<string>, any_groups array<array<string>>, by_series map<string, array<string>>, type_any array<array<string>>, "
    f"type_counts {TYPES}, type_counts_any array<{TYPES}>, type_shares {TYPES}, name_shares array<struct<pattern: string, minimum: double>>"
)
# Types that a rule without type gates of its own asks for where the library has them.
DEFAULT_TYPES = ("Diagnostic_HG", "C类碎片", "LCB碎片")


def series_key(series: Column) -> Column:
    first = F.lower(F.substring(F.trim(F.coalesce(series, F.lit(""))), 1, 1))
    return F.when(first.isin("d", "t", "m"), first).otherwise("other")


def passes(rows: DataFrame, rules: DataFrame, rule: str, series: str, fragments: str, matches: str, tiered: Column) -> DataFrame:
    """Adds ``name_gate`` and ``type_gate``; both are null where a row names no rule of the table.

    ``fragments`` (of the record) and ``matches`` are array<struct<name, types array<string>>>. ``tiered`` rows also need half of the
    head-group fragments, and at least one. Rules are configuration: one row each, unique by ``rule``; null lists ask for nothing.
    """
    fields = [f for f in rules.columns if f != "rule"]
    out = rows.join(rules.select(F.col("rule").alias(rule), F.struct(*fields).alias("_r")), rule, "left")
    r, m, lib = (lambda f: F.col("_r")[f]), F.col(matches), F.col(fragments)
    # lists that a rule lacks hold for all
    each = lambda a, f: F.coalesce(F.forall(a, f), F.lit(True))
    out = out.withColumns({"_n": F.transform(m, lambda x: x["name"]), "_t": F.array_distinct(F.flatten(F.transform(m, lambda x: x["types"]))), "_l": F.array_distinct(F.flatten(F.transform(lib, lambda x: x["types"])))})
    typed = lambda a, types: F.size(F.filter(a, lambda x: F.arrays_overlap(x["types"], types)))
    named = lambda a, pattern: F.size(F.filter(a, lambda x: F.regexp_like(x["name"], F.concat(F.lit("(?i)"), pattern))))
    share = lambda there, got, least: (there > 0) & (got >= F.greatest(F.lit(1), F.ceil(there * least)))
    own = F.try_element_at(r("by_series"), series_key(F.col(series)))
    names = (
        F.coalesce(F.size(F.array_except(r("required_all"), F.col("_n"))) <= 0, F.lit(True)) & each(r("any_groups"), lambda g: F.arrays_overlap(g, F.col("_n")))
        & F.coalesce(F.arrays_overlap(own, F.col("_n")), F.lit(True))
    )
    types = (
        each(r("type_any"), lambda g: F.arrays_overlap(g, F.col("_t"))) & each(r("type_counts"), lambda g: typed(m, g["types"]) >= g["minimum"])
        & each(r("type_counts_any"), lambda o: F.exists(o, lambda g: typed(m, g["types"]) >= g["minimum"]))
        & each(r("type_shares"), lambda g: share(typed(lib, g["types"]), typed(m, g["types"]), g["minimum"]))
        & each(r("name_shares"), lambda g: share(named(lib, g["pattern"]), named(m, g["pattern"]), g["minimum"]))
    )
    explicit = F.lit(False)
    for f in ("type_any", "type_counts", "type_counts_any", "type_shares", "name_shares"):
        explicit = explicit | F.coalesce(F.size(r(f)) > 0, F.lit(False))
    default = F.lit(True)
    for t in DEFAULT_TYPES:
        default = default & (~F.array_contains("_l", t) | F.array_contains("_t", t))
    heads = lambda a: F.size(F.filter(a, lambda x: F.array_contains(x["types"], "Diagnostic_HG")))
    half = ~tiered | ((heads(lib) > 0) & (heads(m) * 2 >= heads(lib)))
    known = F.col("_r").isNotNull()
    return out.withColumns({"name_gate": F.when(known, names), "type_gate": F.when(known, types & half & (explicit | default))}).drop("_r", "_n", "_t", "_l")
