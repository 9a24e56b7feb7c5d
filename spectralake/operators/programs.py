"""Evidence programs: the rules of a record compiled to what its matched fragments must have, as an OR of ANDs over bits.

A program is an array of branches, a branch an array of (mask, least): of the fragments whose bits are in the mask at least so many
must be matched. A record's fragments are its bits from 0 on. Programs are made once for each record, in the JVM, and a spectrum
is tested by counting bits, before anything is scored. Programs hold exactly the rule's gates on names, series, types,
numbers and shares, and of a fallback only what it can't do without, so they never drop what the full gate keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.operators.rules import DEFAULT_TYPES, series_key

PROGRAM = "array<array<struct<mask:bigint,least:int>>>"
#: Records with more fragments than bits have no program: all they match is scored.
BITS = 63


def bits(fragments: Column, holds) -> Column:
    """The mask of the fragments of which ``holds``."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    own = F.transform(fragments, lambda f, i: F.when(F.coalesce(holds(f), F.lit(False)), one(i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def matched_bits(places: Column) -> Column:
    """The mask of matched fragments by their places from 0 on."""
    return F.aggregate(F.array_distinct(places), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def _need(mask: Column, least: Column) -> Column:
    return F.struct(mask.alias("mask"), least.cast("int").alias("least"))


def _share(mask: Column, fraction: Column) -> Column:
    return _need(mask, F.greatest(F.lit(1), F.ceil(F.bit_count(mask) * fraction)))


def compiled(rows: DataFrame, rules: DataFrame, rule: str, series: str, fragments: str, tiered: Column, positive: Column | None = None, head_classes: Column | None = None) -> DataFrame:
    """Adds ``program``; null where a row names no rule of the table or has more fragments than bits.

    ``fragments`` are array<struct<name, types array<string>, pools array<string>>> (pools only where ``positive`` is given). ``tiered`` rows also
    need half of their head-group fragments. With ``positive`` and ``head_classes`` the rules' fallbacks are branches too: head
    group with any second match, for classes that may; two chain matches, for positive records with a head-group or structural fragment.
    Branches that can't be met are left out, so an empty program is a record that no spectrum can match.
    """
    fields = [f for f in rules.columns if f != "rule"]
    out = rows.join(rules.select(F.col("rule").alias(rule), F.struct(*fields).alias("_r")), rule, "left")
    r, lib = (lambda f: F.col("_r")[f]), F.col(fragments)
    none = F.array().cast("array<struct<mask:bigint,least:int>>")
    named = lambda names: bits(lib, lambda f: F.array_contains(names, f["name"]))
    typed = lambda types: bits(lib, lambda f: F.arrays_overlap(f["types"], types))
    each = lambda a, f: F.coalesce(F.transform(a, f), none)
    one = F.lit(1)
    own = F.try_element_at(r("by_series"), series_key(F.col(series)))
    explicit = F.lit(False)
    for f in ("type_any", "type_counts", "type_counts_any", "type_shares", "name_shares"):
        explicit = explicit | F.coalesce(F.size(r(f)) > 0, F.lit(False))
    heads = typed(F.array(F.lit("Diagnostic_HG")))
    default = F.array_compact(F.array(*[F.when((mask := typed(F.array(F.lit(t)))) != 0, _need(mask, one)) for t in DEFAULT_TYPES]))
    all_of = F.concat(
        each(r("required_all"), lambda n: _need(bits(lib, lambda f: f["name"] == n), one)), each(r("any_groups"), lambda g: _need(named(g), one)),
        F.when(own.isNotNull(), F.array(_need(named(own), one))).otherwise(none),
        each(r("type_any"), lambda g: _need(typed(g), one)), each(r("type_counts"), lambda g: _need(typed(g["types"]), F.ceil(g["minimum"]))),
        each(r("type_shares"), lambda g: _share(typed(g["types"]), g["minimum"])),
        each(r("name_shares"), lambda g: _share(bits(lib, lambda f: F.regexp_like(f["name"], F.concat(F.lit("(?i)"), g["pattern"]))), g["minimum"])),
        F.when(explicit, none).otherwise(default), F.when(tiered, F.array(_share(heads, F.lit(0.5)))).otherwise(none),
    )
    # every choice among alternatives multiplies the branches
    choices = F.coalesce(r("type_counts_any"), F.array().cast("array<array<struct<types:array<string>,minimum:double>>>"))
    grown = F.aggregate(choices, F.array(all_of).cast(PROGRAM), lambda a, options: F.flatten(F.transform(a, lambda b: F.transform(options, lambda g: F.concat(b, F.array(_need(typed(g["types"]), F.ceil(g["minimum"]))))))))
    if positive is not None:
        every = bits(lib, lambda f: F.lit(True))
        chains = bits(lib, lambda f: F.array_contains(f["pools"], "fah"))
        base = ~tiered
        by_head = base & r("hg_fallback") & head_classes & (heads != 0)
        by_chain = base & r("chain_fallback") & positive & (typed(F.array(F.lit("Diagnostic_HG"), F.lit("C类碎片"))) != 0)
        nothing = F.array().cast(PROGRAM)
        grown = F.concat(grown, F.when(by_head, F.array(F.array(_need(heads, one), _need(every, F.lit(2))))).otherwise(nothing), F.when(by_chain, F.array(F.array(_need(chains, F.lit(2))))).otherwise(nothing))
    able = F.array_distinct(F.filter(grown, lambda b: F.forall(b, lambda n: F.bit_count(n["mask"]) >= n["least"])))
    known = F.col("_r").isNotNull() & (F.size(lib) <= BITS)
    return out.withColumn("program", F.when(known, able)).drop("_r")


def admits(program: Column, mask: Column) -> Column:
    """Whether matched fragments meet a program; without one, always."""
    return F.coalesce(F.exists(program, lambda b: F.forall(b, lambda n: F.bit_count(n["mask"].bitwiseAND(mask)) >= n["least"])), F.lit(True))
