"""Rulebook, evidence programs against the gates, routed fragments."""

import random

import pytest
from pyspark.sql import functions as F

from spectralake.functions import rulebook
from spectralake.operators import programs, routing, rules

LIB = "array<struct<name:string,types:array<string>,pools:array<string>>>"


def test_rulebook_is_whole(spark):
    book = rulebook.rulebook(spark)
    assert book.count() == book.select("rule").distinct().count() == 43
    kinds = {r.compound_class: r for r in rulebook.class_rules(spark).collect()}
    assert len(kinds) >= 55 and kinds["DEFAULT"].fah == 60.0 and kinds["LPS"].hg == 60.0 and kinds["LPS"].hg_min_fraction == 0.5
    assert kinds["LPE-P"].complete_hg_resolves and kinds["LPA-O"].hg_min_fraction == 0.5 and not kinds["LPA-O"].hg_only_if_no_fah
    keys = spark.createDataFrame([("Cer", "[M-H]-", "Cer d18:1/26:0(O-18:2)"), ("Cer", "[M-H]-", "Cer d18:1/16:0"), ("SM", "[M+H]+", None)], "c string, a string, n string")
    assert [r[0] for r in keys.select(rulebook.rule_key(F.col("c"), F.col("a"), F.col("n"))).collect()] == ["Cer-esterified_[M-H]-", "Cer_[M-H]-", "SM_[M+H]+"]


def test_programs_hold_what_the_gates_ask(spark):
    r = random.Random(11)
    names = sorted({n for x in rulebook.RULES.values() for g in (x.get("all", []), *x.get("any", []), *x.get("series", {}).values()) for n in g}) + ["LCB-C2H7NO+1", "T ion (omega-hydroxy x)", "[RCOO]-(16:0)"]
    types = ["Diagnostic_HG", "LCB碎片", "Diagnostic_FA", "Diagnostic_FA_Loss", "C类碎片", "Precursor Ion", "Neutral_Loss", "FA类碎片", "NAE碎片"]
    rows = []
    for key, rule in rulebook.RULES.items():
        wanted = [n for g in (rule.get("all", []), *rule.get("any", []), *rule.get("series", {}).values()) for n in g]
        for _ in range(60):
            lib = [(r.choice(wanted if wanted and r.random() < 0.6 else names), r.sample(types, r.choice((1, 1, 2))), [r.choice(("fah", "hg", "other"))]) for _ in range(r.randrange(1, 14))]
            rows.append((key, r.choice(("d18:1", "t18:0", "m17:0", "", None)), lib, [i for i in range(len(lib)) if r.random() < r.choice((0.3, 0.9))], r.random() < 0.2))
    rows += [("unknown", "d", [("x", ["Common"], ["other"])], [], False), ("SM_[M+Na]+", "d", [("x", ["Diagnostic_HG"], ["hg"])] * 70, [0, 1], False), ("SM_[M+Na]+", "d", [], [], False), ("SM_[M+Na]+", "d", [("x", ["Diagnostic_HG"], ["hg"])] * 63, [61, 62], False)]
    df = spark.createDataFrame(rows, f"rule string, series string, lib {LIB}, hit array<int>, tiered boolean").withColumn("hits", F.transform("hit", lambda i: F.get("lib", i)))
    book = rulebook.rulebook(spark)
    gates = rules.passes(df, book, "rule", "series", "lib", "hits", F.col("tiered"))
    both = programs.compiled(gates, book, "rule", "series", "lib", F.col("tiered"))
    both = both.withColumn("admitted", programs.admits(F.col("program"), programs.matched_bits(F.col("hit"))))
    got = both.select("rule", "admitted", (F.col("name_gate") & F.col("type_gate")).alias("passes"), F.size("program").alias("n"), F.size("lib").alias("m")).collect()
    assert all(x.admitted == x.passes for x in got if x.m <= 63 and x.rule != "unknown")
    assert all(x.admitted for x in got if x.m > 63 or x.rule == "unknown")
    passed = [x for x in got if x.passes]
    assert len(passed) > 300 and len({x.rule for x in passed}) > 35 and sum(x.n == 0 for x in got) > 100
    # with the fallbacks a program admits more, and all that the gates do
    wide = programs.compiled(both.withColumnRenamed("program", "strict"), book, "rule", "series", "lib", F.col("tiered"), F.col("rule").endswith("+"), F.lit(True))
    wide = wide.select("admitted", programs.admits(F.col("program"), programs.matched_bits(F.col("hit"))).alias("more")).collect()
    assert all(x.more for x in wide if x.admitted) and sum(x.more and not x.admitted for x in wide) > 50


CASES = [
    ("PE", "[M-H]-", "", "Diagnostic_FA_Loss", "x", ["other"]), ("PC", "[M+H]+", "", "Diagnostic_FA_Loss", "x", ["fah"]), ("OxPE", "[M-H]-", "", "Diagnostic_FA", "M-H2O", ["other"]),
    ("LPC-O", "[M+H]+", "LPC-O 16:0/0:0", "Diagnostic_HG", "[C5H15NO4P]+", ["hg"]), ("LPC-O", "[M+H]+", "LPC-O 16:0/0:0", "Diagnostic_HG", "y", ["other"]), ("LPC-O", "[M+HCOO]-", "LPC(O-16:0/0:0)", "Diagnostic_FA", "y", ["other"]),
    ("LPC-O", "[M+HCOO]-", "LPC(O-3:3)", "Diagnostic_FA", "y", ["fah"]), ("LPE-O", "[M-H]-", "PE(O-16:0)", "Precursor Ion", "y", ["fah"]), ("LPE", "[M+H]+", "", "Diagnostic_FA", "y", ["other"]),
    ("HexCer", "[M-H]-", "", "LCB碎片", "x", ["lcb"]), ("AHexCer", "[M+HCOO]-", "", "Diagnostic_FA_Loss", "a LCB-C2H7NO", ["fah", "other"]), ("Cer", "[M-H]-", "", "NAE碎片", "x", ["fah"]), ("Cer", "[M+H]+", "", "NAE碎片", "x", ["other"]),
    ("Cer", "[M+H]+", "Cer d18:1/26:0(O-18:2)", "LCB碎片", "x", ["lcb"]), ("FA", "[M-H]-", "", "Precursor Ion", "[RCOO]-", ["fah"]), ("DG", "[M+NH4]+", "", "FA_Frag", "RCO(16:0)", ["other"]), ("PI", "[M+H]+", "", "FA_Frag", "x", ["fah"]), (None, None, None, "Common", None, ["other"]),
]


@pytest.mark.parametrize("also", [None, ["LCB碎片"]])
def test_routes(spark, also):
    rows = [(i, c, a, n, 500.0, [(500.0, name, kind, also)]) for i, (c, a, n, kind, name, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, compound_class string, adduct string, chain_name string, precursor_mz double, fragments array<struct<mz:double,name:string,type:string,also:array<string>>>")
    got = {x.i: x.routes[0].pools for x in routing.routed(df).collect()}
    assert got == {i: c[-1] for i, c in enumerate(CASES)}
    hex_ = df.limit(1).select(F.lit("HexCer").alias("compound_class"), F.lit("[M-H]-").alias("adduct"), "chain_name", "precursor_mz", F.transform("fragments", lambda f: f.withField("type", F.lit("Diagnostic_FA"))).alias("fragments"))
    assert routing.routed(hex_).first().routes[0].pools == (["fah", "lcb"] if also else ["fah"])


def test_repeated_heads_of_one_mass(spark):
    rows = [("BMP", "[M+H]+", [(313.0, "a", "Diagnostic_HG", None), (313.0, "b", "Diagnostic_HG", None), (339.0, "c", "Diagnostic_HG", None)], [0])]
    df = spark.createDataFrame(rows, "compound_class string, adduct string, fragments array<struct<mz:double,name:string,type:string,also:array<string>>>, places array<int>").withColumns({"chain_name": F.lit(""), "precursor_mz": F.lit(700.0)})
    got = routing.routed(df).select(*[routing.matched_heads(F.lit(b), F.col("fragments"), F.col("routes"), F.col("places")) for b in (True, False)]).first()
    assert tuple(got) == (2, 1)
