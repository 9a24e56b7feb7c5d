"""Queries on gates, chain labels and isotope requests, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import gates, rules
from spectralake.plans.bases import CANDIDATES, candidates
from spectralake.session import table


def glyceride_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "TG").when(k == 1, "TG-O").otherwise("TG-EST")
    a, b = 12 + F.col("p_partkey") % 4, 14 + F.col("p_size") % 3
    name = F.when(k == 0, F.concat(F.lit("TG("), a, F.lit(":0_"), b, F.lit(":1_16:0)"))).when(k == 1, F.concat(F.lit("TG(O-"), a, F.lit(":0/"), b, F.lit(":1/16:0)"))).otherwise(F.concat(F.lit("TG-EST "), a, F.lit(":0_"), b, F.lit(":1_18:0;O(FA 20:0)")))
    label = lambda i: F.when(k == 0, F.concat(F.lit("[M-NH3-(ROOH)+NH4]+("), F.when(i == 0, F.concat(a, F.lit(":0"))).when(i == 1, F.concat(b, F.lit(":1"))).otherwise("16:0"), F.lit(")"))).when(k == 1, F.when(i == 0, F.concat(F.lit("[M-R1-OH+H]+(O-"), a, F.lit(":0)"))).otherwise(F.concat(F.lit("[M - NH3 - (ROOH) + NH4]+("), F.when(i == 1, F.concat(b, F.lit(":1"))).otherwise("16:0"), F.lit(")")))).otherwise(F.when(i == 2, "[M+H-FAHFA]+(x)").otherwise(F.concat(F.lit("[M+H-FA]+("), F.when(i == 0, F.concat(a, F.lit(":0"))).otherwise(F.concat(b, F.lit(":1"))), F.lit(")"))))
    seen = F.array_compact(F.array(*[F.when((F.col("p_partkey") + i) % 4 > 0, gates.substituent(kind, F.lit("Diagnostic_FA_Loss"), label(F.lit(i)))) for i in range(3)]))
    rows = table(spark, d, "part").select("p_partkey", gates.substituents(kind, name).alias("expected"), seen.alias("matched"), (F.col("p_size") % 5).alias("n"), (F.col("p_partkey") % 4).alias("m"), (k == 1).alias("ether"), "p_size")
    losses = F.sequence(F.lit(1), F.col("p_size") % 3 + 1)
    hit = F.filter(losses, lambda i: (F.col("p_partkey") + i) % 3 > 0)
    return rows.select("p_partkey", F.array_join("expected", ";").alias("expected"), gates.all_substituents(F.col("expected"), F.col("matched")).alias("full"), gates.acyl_ions(F.col("n"), F.col("m"), F.col("ether")).alias("ions"), gates.all_losses(losses, hit).alias("losses"))


def fallback_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumn("miss", F.array_compact(F.array(F.when(F.col("suppkey") % 3 == 0, "hg"), F.when(F.col("partkey") % 5 == 0, "fah"), F.when(F.col("partkey") % 11 == 0, "sphingo_rule"))))
    positive, first = F.col("adduct").endswith("+"), F.col("compound_class") == "PE"
    chains = gates.chains_only(positive, F.col("compound_class") == "TG", F.col("miss"), F.col("ord") % 3, F.col("ord") % 2, F.col("n_fragments"), F.col("n_fragments") - 1, F.col("relative_intensity") * 10, F.col("final_score"), F.col("suppkey") % 2 == 0, first)
    head = gates.head_only(first, F.col("adduct") == "[M+Na]+", F.array_except("miss", F.array(F.lit("sphingo_rule"))), F.col("ord") % 3, F.col("ord") % 2, F.col("relative_intensity"))
    return rows.select("spectrum", "ord", "partkey", "suppkey", chains.alias("chains"), head.alias("head"))


def oxidised_gates(spark: SparkSession, d: str) -> DataFrame:
    # chain A has two oxygens, chain B none; peaks 1 and 2 may be A's, 2 and 3 B's
    s = lambda kind, name, mz: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), mz.cast("double").alias("mz"))
    k = F.col("p_partkey")
    every = F.array(s("Diagnostic_FA", "18:1;O2", F.lit(1)), s("FA_Frag", "18:1;O2 - H2O", F.when(k % 5 == 0, 1).otherwise(2)), s("Diagnostic_FA", "16:0", F.when(k % 7 == 0, 2).otherwise(3)), s("Common", "18:1;O2", F.lit(9)))
    used = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when((F.col("p_size") + i * 3) % 8 > 0, F.element_at(every, i.cast("int")))), lambda m: m.isNotNull())
    rows = table(spark, d, "part").select("p_partkey", F.when(k % 9 == 0, "PC").otherwise("OxPC").alias("kind"), F.lit("OxPC(16:0/18:1;O2)").alias("name"), used.alias("m"))
    out = gates.oxidised_chains(rows, "kind", "name", "m")
    return out.select("p_partkey", F.array_join(F.array_sort("oxidised_missing"), ";").alias("missing"))


def chain_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    a, b = 14 + F.col("p_partkey") % 4, 18 + F.col("p_size") % 3
    name = F.when(k == 5, F.concat(F.lit("LPC("), a, F.lit(":0/0:0)"))).otherwise(F.concat(F.lit("PC("), a, F.lit(":0/"), b, F.lit(":1)")))
    label = F.expr("CASE k WHEN 0 THEN '[M-R1COOH+H]+' WHEN 1 THEN '[M-R2=O+H]+' WHEN 2 THEN '[RCOO]-' WHEN 3 THEN 'RCO+' WHEN 4 THEN '[M-R1COOH-R2COOH]+' ELSE '[M-ROOH+H]+' END")
    acid = b * 12.0 + (2 * b - 2) * 1.00782503223 + 2 * 15.99491462
    mz = F.when(k == 2, acid - 1.007276466621).otherwise(acid - 18.01056468 + 1.007276466621) + F.when(F.col("p_size") % 2 == 0, 0.001).otherwise(0.01)
    rows = table(spark, d, "part").withColumn("k", k)
    return rows.select("p_partkey", gates.chain_label(name, label, F.lit(800.0), mz, F.lit("[M+H]+")).alias("label"))


def isotope_requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"))
    scans = e.where("event_type = 'purchase'").select(F.col("user_id").alias("file"), F.col("event_id").alias("scan"), F.col("value").alias("scan_mz"), (F.col("event_id") * 0.1).alias("scan_rt"), "ord")
    surveys = e.where("event_type = 'view'").select(F.col("user_id").alias("file"), F.col("event_id").alias("survey"), "ord")
    asked = e.where("event_type in ('purchase', 'click')").select(F.col("event_id").alias("key"), F.col("user_id").alias("file"), F.col("event_id").alias("scan"), (F.col("value") + F.when(F.col("event_id") % 7 == 0, F.col("value") * 0.01 + 1).otherwise(0.0)).alias("mz"), (F.col("event_id") * 0.1 + F.when(F.col("event_id") % 11 == 0, 1.0).otherwise(0.0)).alias("rt"))
    return gates.isotope_requests(asked.unionByName(asked), scans, surveys).select("key", "status", "survey")


def rule_gates(spark: SparkSession, d: str) -> DataFrame:
    hg, lcb, loss = ["Diagnostic_HG"], ["LCB碎片"], ["Neutral_Loss"]
    table_of = spark.createDataFrame(
        [
            ("r0", ["n1", "n4"], None, None, None, None, None, [(hg, 0.5), (lcb, 0.5)], None),
            ("r1", None, [["n0", "n2"]], {"d": ["n3", "n4"], "t": ["n5"]}, [[*hg, *loss], lcb], None, None, None, None),
            ("r2", None, None, None, None, [(hg, 2.0)], [[(lcb, 2.0), (loss, 1.0)]], None, [("^N[3-5]$", 0.6)]),
            ("r3", None, None, None, None, None, None, None, None),
        ],
        rules.RULE,
    )
    fragment = lambda i: F.struct(F.concat(F.lit("n"), i).alias("name"), F.when(i == 0, F.array(F.lit(hg[0]), F.lit(loss[0]))).when(i < 3, F.array(F.lit(hg[0]))).when(i < 5, F.array(F.lit(lcb[0]))).otherwise(F.array(F.lit(loss[0]))).alias("types"))
    ids = F.sequence(F.lit(0), F.lit(5))
    hit = F.filter(ids, lambda i: (F.col("p_partkey") * 7 + i * i * 3 + F.col("p_size")) % 5 > 1)
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("r"), F.col("p_partkey") % 5).alias("rule"), F.when(F.col("p_size") % 3 == 0, "d18:1").when(F.col("p_size") % 3 == 1, " T18:0").alias("series"), F.transform(ids, fragment).alias("lib"), F.transform(hit, fragment).alias("hit"), (F.col("p_size") % 4 == 0).alias("tiered"))
    return rules.passes(rows, table_of, "rule", "series", "lib", "hit", F.col("tiered")).select("p_partkey", "name_gate", "type_gate")


SQL = {
    "rule_gates": """
        WITH r AS (SELECT p_partkey, p_partkey % 5 AS rule, p_size % 3 AS s, p_size % 4 = 0 AS tiered, list_filter(range(0, 6), lambda i: (p_partkey * 7 + i * i * 3 + p_size) % 5 > 1) AS h FROM part),
        c AS (SELECT *, list_contains(h, 0) AS h0, list_contains(h, 1) AS h1, list_contains(h, 2) AS h2, list_contains(h, 3) AS h3, list_contains(h, 4) AS h4, list_contains(h, 5) AS h5 FROM r),
        n AS (SELECT *, h0::INT + h1::INT + h2::INT AS hg, h3::INT + h4::INT AS lcb, h0::INT + h5::INT AS loss FROM c)
        SELECT p_partkey, CASE rule WHEN 0 THEN h1 AND h4 WHEN 1 THEN (h0 OR h2) AND CASE s WHEN 0 THEN h3 OR h4 WHEN 1 THEN h5 ELSE true END WHEN 2 THEN true WHEN 3 THEN true END AS name_gate,
        CASE WHEN rule = 4 THEN NULL ELSE (NOT tiered OR hg * 2 >= 3) AND CASE rule WHEN 0 THEN hg >= 2 AND lcb >= 1 WHEN 1 THEN (hg > 0 OR loss > 0) AND lcb > 0 WHEN 2 THEN hg >= 2 AND (lcb >= 2 OR loss >= 1) AND h3::INT + h4::INT + h5::INT >= 2 ELSE hg > 0 AND lcb > 0 END END AS type_gate FROM n""",
    "glyceride_gates": """
        WITH r AS (SELECT p_partkey, p_size, p_partkey % 3 AS k, 12 + p_partkey % 4 AS a, 14 + p_size % 3 AS b FROM part),
        g AS (SELECT *, CASE k WHEN 0 THEN [concat('acyl:', a, ':0'), concat('acyl:', b, ':1'), 'acyl:16:0'] WHEN 1 THEN [concat('ether:O-', a, ':0'), concat('acyl:', b, ':1'), 'acyl:16:0'] ELSE [concat('fa:', a, ':0'), concat('fa:', b, ':1'), 'fahfa'] END AS e FROM r),
        m AS (SELECT *, list_filter(range(0, 3), lambda i: (p_partkey + i) % 4 > 0) AS hit FROM g)
        SELECT p_partkey, array_to_string(e, ';') AS expected, len(list_filter(range(0, 3), lambda i: NOT list_contains([e[j + 1] for j in hit], e[i + 1]))) = 0 AS "full",
        CASE WHEN p_size % 5 <= 0 THEN false ELSE p_size % 5 >= CASE WHEN k = 1 THEN greatest(1, ceil(p_size % 5 / 2.0)) ELSE 2 END AND p_partkey % 4 >= CASE WHEN k = 1 THEN greatest(1, ceil(p_size % 5 / 2.0)) ELSE 2 END END AS ions,
        len(list_filter(range(1, p_size % 3 + 2), lambda i: (p_partkey + i) % 3 = 0)) = 0 AS losses FROM m""",
    "fallback_gates": f"""
        SELECT spectrum, ord, partkey, suppkey, adduct LIKE '%+' AND compound_class <> 'TG' AND (suppkey % 3 = 0 OR partkey % 11 = 0) AND partkey % 5 <> 0 AND n_fragments > 0 AND ord % 3 > 0 AND ord % 2 = 0 AND n_fragments - 1 >= 2 AND (suppkey % 2 = 1 OR relative_intensity * 10 >= 0.5)
            AND final_score >= CASE WHEN compound_class = 'PE' THEN 20 ELSE 40 END AS chains,
        compound_class = 'PE' AND adduct <> '[M+Na]+' AND suppkey % 3 <> 0 AND ord % 3 > 0 AND ord % 2 > 0 AND relative_intensity >= 0.10 AS head FROM {CANDIDATES}""",
    "oxidised_gates": """
        WITH r AS (SELECT p_partkey AS k, (p_size + 3) % 8 > 0 AS h1, (p_size + 6) % 8 > 0 AS h2, (p_size + 9) % 8 > 0 AS h3, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS m2, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 3 END AS m3 FROM part),
        p AS (SELECT *, CASE WHEN h1 AND h2 AND m2 = 2 THEN 2 WHEN h1 OR h2 THEN 1 ELSE 0 END AS n FROM r),
        s AS (SELECT *, list_filter([CASE WHEN n < 2 THEN 'oxidized_chain_fragments' END, CASE WHEN NOT h1 THEN 'oxidation_localization' END, CASE WHEN NOT h3 THEN 'partner_chain' END], lambda x: x IS NOT NULL) AS l FROM p)
        SELECT k AS p_partkey, CASE WHEN k % 9 = 0 THEN NULL WHEN len(l) = 0 AND m3 = 2 THEN 'independent_chain_peaks' ELSE array_to_string(list_sort(l), ';') END AS missing FROM s""",
    "chain_labels": """
        WITH r AS (SELECT p_partkey, p_size % 2 = 0 AS near, p_partkey % 6 AS k, concat(14 + p_partkey % 4, ':0') AS a, concat(18 + p_size % 3, ':1') AS b FROM part)
        SELECT p_partkey, CASE k WHEN 0 THEN concat('[M-R1COOH+H]+(', a, ')') WHEN 1 THEN concat('[M-R2=O+H]+(', b, ')') WHEN 2 THEN concat('[RCOO]-', CASE WHEN near THEN concat('(', b, ')') ELSE '' END) WHEN 3 THEN concat('RCO+', CASE WHEN near THEN concat('(', b, ')') ELSE '' END)
        WHEN 4 THEN '[M-R1COOH-R2COOH]+' ELSE '[M-ROOH+H]+' END AS label FROM r""",
    "isotope_requests": """
        WITH p AS (SELECT e.event_id, e.user_id, e.event_type, e.ts FROM events e WHERE event_type IN ('purchase', 'click')),
        b AS (SELECT p.event_id, arg_max(v.event_id, v.ts) AS survey FROM p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts GROUP BY 1),
        s AS (SELECT p.event_id AS key, survey, CASE WHEN event_type = 'click' THEN 'scan_not_found' WHEN p.event_id % 7 = 0 OR p.event_id % 11 = 0 THEN 'scan_metadata_mismatch' WHEN survey IS NULL THEN 'no_preceding_ms1' ELSE 'ok' END AS status FROM p LEFT JOIN b USING (event_id))
        SELECT key, status, CASE WHEN status = 'ok' THEN survey END AS survey FROM s""",
}
ALL = (glyceride_gates, fallback_gates, oxidised_gates, chain_labels, isotope_requests, rule_gates)
