"""The spectrum search: the kernel against the JVM form, planted spectra, penalties, ranks and whole searches against a plain loop."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.functions import spectra as k
from spectralake.operators import search


def record(number=1, kind="PE", masses=(100.0, 200.0, 300.0, 400.0), pools=("hg", "fah", "fah", "other"), chains=("", "16:0", "18:1", ""), adduct="[M+H]+", mz=700.0, tokens=None, quality=1):
    types = ["Diagnostic_HG" if p == "hg" else "Diagnostic_FA" if p == "fah" else "Common" for p in pools]
    tokens = tokens or {c: 1 for c in chains if c}
    return k.Record(number, f"{kind}(34:1)", f"{kind}(16:0/18:1)", kind, adduct, mz, np.array(masses), [f"f{i}" for i in range(len(masses))], types, list(pools), list(chains), tokens, quality).prepare()


def test_greedy_takes_the_most_intense_unused_peak():
    peaks, rel = np.array([99.999, 100.0, 100.001, 200.0]), np.array([0.5, 1.0, 1.0, 0.1])
    masses = np.array([100.0, 100.0, 100.0, 100.0, 200.001, 250.0])
    assert k.greedy(peaks, rel, masses, np.full(6, 0.002)) == [(0, 1), (1, 2), (2, 0), (4, 3)]


def test_the_jvm_form_matches_the_kernel(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        peaks = sorted(round(r.uniform(99, 101), 3) for _ in range(r.randrange(0, 12)))
        rows.append((i, [(r.choice([99.5, 100.0, 100.3, 100.5]) + r.randrange(3) * 0.01,) for _ in range(6)], [(m, r.randrange(4) / 4) for m in peaks]))
    df = spark.createDataFrame(rows, "i long, f array<struct<mz: double>>, p array<struct<mz: double, relative: double>>")
    got = {x.i: x.a for x in df.select("i", search.greedy(F.col("f"), F.col("p"), 3000.0).alias("a")).collect()}
    for i, f, p in rows:
        masses = np.array([x[0] for x in f])
        want = [0] * 6
        for a, b in k.greedy(np.array([x[0] for x in p]), np.array([x[1] for x in p]), masses, masses * 3000e-6):
            want[a] = b + 1
        assert got[i] == want


def hit(rec, spectrum, precursor=700.0):
    mz, inten = (np.array(x, float) for x in zip(*spectrum, strict=True))
    return k.evaluate(mz, inten, inten / inten.max(), precursor, rec, 15.0)


def test_pools_share_weights_and_saturate():
    full = hit(record(), [(100, 50), (200, 100), (300, 100), (400, 1)])
    assert full.score == pytest.approx(60 + 20 * k.saturation(0.5, 0.05) + 20, abs=1e-4) and full.resolution == "chain_level" and not full.missing
    only = record(pools=("fah", "fah", "fah", "other"), chains=("14:0", "16:0", "18:1", ""))
    assert {p: w for p, _, w, *_ in only.plan} == {"fah": 75.0, "hg": 0.0, "other": 25.0}
    assert hit(record(), [(200, 100), (300, 5)]).missing == ["hg"] and hit(record(), [(500, 1)]) is None


def test_three_chains_count_their_best_half():
    rec = record(kind="TG", pools=("fah", "fah", "fah", "other"), chains=("14:0", "16:0", "18:1", ""), quality=3)
    three = hit(rec, [(100, 100), (200, 100), (300, 100)])
    two = hit(rec, [(100, 100), (200, 100)])
    one = hit(rec, [(100, 100)])
    assert three.pools["fah"] == two.pools["fah"] == pytest.approx(75) and one.pools["fah"] == pytest.approx(37.5)
    same = record(kind="TG", pools=("fah", "other"), masses=(100.0, 400.0), chains=("16:0", ""), tokens={"16:0": 3}, quality=3)
    assert hit(same, [(100, 100)]).pools["fah"] == pytest.approx(75 * 0.75) and hit(same, [(100, 100)]).count() == 1


def test_intensities_beyond_the_precursor_cluster_are_renormalised():
    strong = hit(record(), [(100, 50), (200, 100), (300, 100), (700, 10_000)])
    assert strong.levels[1] == 1.0 and strong.levels[0] == 0.5
    acid = record(kind="FA", pools=("fah", "other", "other", "other"))
    acid.types[0] = "Precursor Ion"
    assert hit(acid, [(100, 50), (200, 100), (700, 10_000)]).levels == [0.005]


def test_negative_ceramides_with_ten_matches_get_ten_points():
    masses = tuple(100.0 + 10 * i for i in range(12))
    rec = record(kind="Cer", adduct="[M-H]-", masses=masses, pools=("hg",) * 2 + ("fah",) * 8 + ("other",) * 2, chains=("",) * 2 + ("16:0", "18:1") * 4 + ("",) * 2)
    weak = [(m, 1.0) for m in masses[:10]] + [(500.0, 1000.0)]
    plain = sum(k.Hit(rec, [], [], 0.0).pools.values())
    got = hit(rec, weak)
    assert got.score == pytest.approx(min(100, sum(got.pools.values()) + 10), abs=1e-3) and plain == 0


def test_shared_chain_peaks_are_halved_cumulatively():
    a, b, c = record(1), record(2, masses=(100.0, 200.0, 310.0, 400.0), chains=("", "16:0", "18:2", "")), record(3, kind="PC", masses=(100.0, 200.0, 320.0, 410.0))
    spectrum = [(100, 100), (200, 100), (300, 100), (400, 9), (410, 9)]
    hits = [hit(x, spectrum) for x in (a, b, c)]
    for h in hits:
        h.missing = []
    before = {h.record.number: h.score for h in hits}
    out = k.reranked(hits, 0.0)
    assert [h.record.number for h in out][0] == 1 and out[0].score == before[1]
    last = out[-1]
    # the first of its class lacks no peak, so the second is demoted; both selected candidates use its strongest chain peak
    assert last.record.number == 2 and last.demoted and list(last.uses.values()) == [2]
    assert last.score == pytest.approx(60 * k.saturation(0.25, 0.10) + 20 + 20, abs=1e-4) and before[2] == 100


def test_demotion_and_ranks():
    x, y, z = (k.Hit(record(i), [(1, 1)] * n, [1.0] * n, 0.0, score=s) for i, n, s in ((1, 3, 90.0), (2, 1, 90.0), (3, 1, 80.0)))
    y.demoted = True
    ranks, rank, before = [], 0, None
    for h in (x, y, z):
        rank = k.next_rank(h, rank, before)
        before = h
        ranks.append(rank)
    assert ranks == [1, 2, 3]


def test_search_equals_a_plain_loop(spark):
    r = random.Random(7)
    library = []
    for i in range(120):
        kind = r.choice(["PE", "PC", "TG", "FA", "Cer"])
        chains = ["16:0", "18:1"]
        frags = [(round(100 + r.randrange(400) * 0.5, 3), f"f{j}", "Precursor Ion" if j == 8 else "x", "hg" if j < 2 else "fah" if j < 6 else "other", chains[j % 2] if 2 <= j < 6 else "") for j in range(9)]
        library.append((i, kind, f"{kind}(34:1)", f"{kind}(16:0/18:{i})", "[M-H]-" if kind == "Cer" else "[M+H]+", 700.0 + r.randrange(40) * 0.05, chains, frags))
    spectra = []
    for i in range(150):
        rec = r.choice(library)
        peaks = [(f[0], float(r.randrange(1, 100))) for f in rec[7] if r.random() < 0.8] + [(r.uniform(100, 300), float(r.randrange(1, 20))) for _ in range(10)]
        spectra.append((f"s{i}", rec[5] * (1 + r.uniform(-4e-6, 4e-6)), [p[0] for p in peaks], [p[1] for p in peaks]))
    lib = spark.createDataFrame(library, "record_id long, compound_class string, lipid_name string, chain_name string, adduct string, precursor_mz double, chains array<string>, fragments array<struct<mz: double, name: string, type: string, pool: string, chain: string>>")
    sp = spark.createDataFrame([*spectra, ("empty", 700.0, [], []), ("none", None, [1.0], [1.0])], "spectrum string, precursor_mz double, mz array<double>, intensity array<double>")
    search_crowd = search.CROWD
    try:
        search.CROWD = 20
        got = {(x.spectrum, x.record_id): (x.result_rank, x.result_rank_scope, x.final_score, x.resolution_level) for x in search.search(sp, lib, least=10.0).collect()}
    finally:
        search.CROWD = search_crowd
    from collections import Counter

    records = [k.Record(a, c, d, b, e, m, np.array([f[0] for f in fr]), [f[1] for f in fr], [f[2] for f in fr], [f[3] for f in fr], [f[4] for f in fr], dict(Counter(ch)), 3 if b == "TG" else 1).prepare() for a, b, c, d, e, m, ch, fr in sorted(library, key=lambda x: (x[5], x[0]))]
    want = {}
    for s, mz, peaks, inten in spectra:
        near = [x for x in records if abs(x.mz - mz) <= mz * 5e-6]
        for h, rank, scope in k.search(np.array(peaks), np.array(inten), mz, near, 15.0, 3, 10.0):
            want[s, h.record.number] = (rank, scope, h.score, h.resolution)
    assert got == want and len({s for s, _ in want}) > 50


def test_ruled_search_equals_a_plain_loop(spark):
    """Whole tables of the smallest scale; the plain loop asks the rules of every pair of a spectrum and a near record."""
    from spectralake.functions.rulebook import rulebook
    from spectralake.operators.search import with_evidence
    from spectralake.plans.search import ruled_library, ruled_search, spectra_of

    d = "/root/testdata/sf0.001"
    got = {(x.spectrum, x.record_id): (x.result_rank, x.result_rank_scope, x.final_score, x.resolution_level, x.compound_class) for x in ruled_search(spark, d).collect()}
    routed = with_evidence(ruled_library(spark, d), rulebook(spark)).collect()
    records = []
    for x in sorted(routed, key=lambda x: (x.precursor_mz, x.record_id)):
        f = x.fragments
        quality = 3 if x.compound_class == "TG" else 1
        own = k.Record(x.record_id, x.lipid_name, x.chain_name, x.compound_class, x.adduct, x.precursor_mz, np.array([y.mz for y in f]), [y.name for y in f], [y.type for y in f], [y.pool for y in f], [y.chain or "" for y in f], dict(collections.Counter(x.chains)), quality)
        # a program that asks for nothing: the loop below has asked already
        own.program = [[]] if x.compound_class in ("Cer", "SM", "HexCer") else None
        records.append(own.prepare())

    def passes(rec, matches):
        types, names = [rec.types[f] for f, _ in matches], {rec.names[f] for f, _ in matches}
        n = lambda *kinds: sum(t in kinds for t in types)
        if rec.kind == "Cer":
            return n("Precursor Ion", "C类碎片") >= 2 and (n("LCB碎片") >= 2 or n("FA类碎片", "NAE碎片") >= 2)
        if rec.kind == "SM":
            series = {"LCB", "LCB-H2O", "LCB-2H2O"} if "(d" in rec.chain_name else set()
            return bool(names & {"[M+H]+", "M+H-H2O", "M+H-2H2O", "[C5H15NO4P]+"}) and bool(names & series or not series) and n("Precursor Ion", "C类碎片", "Neutral_Loss", "Diagnostic_HG") > 0 and n("LCB碎片") > 0
        return all(n(t) * 2 >= rec.types.count(t) > 0 for t in ("Diagnostic_HG", "Diagnostic_FA", "LCB碎片"))

    want, asked, refused = {}, 0, 0
    for s in spectra_of(spark, d).collect():
        mz, intensity = np.array(s.mz), np.array(s.intensity)
        sort = np.argsort(mz, kind="stable")
        near = []
        for rec in records:
            if abs(rec.mz - s.precursor_mz) <= s.precursor_mz * 5e-6:
                if rec.program is not None:
                    asked += 1
                    if not passes(rec, k.greedy(mz[sort], (intensity / intensity.max())[sort], rec.masses, np.abs(rec.masses) * 15e-6)):
                        refused += 1
                        continue
                near.append(rec)
        for h, rank, scope in k.search(mz, intensity, s.precursor_mz, near, 15.0, 3, 20.0):
            want[s.spectrum, h.record.number] = (rank, scope, h.score, h.resolution, h.record.kind)
    assert got == want
    assert 0 < refused < asked and {"Cer", "SM", "HexCer"} <= {x[-1] for x in got.values()}


def _species_library(r):
    """Records of few species that differ in chains, error, order and support, as candidates of one window."""
    library = []
    for i in range(160):
        kind, adduct = r.choice([("PC", "[M+H]+"), ("PE", "[M-H]-"), ("TG", "[M+Na]+"), ("FA", "[M-H]-"), ("Cer", "[M-H]-")])
        a = r.choice([14, 16, 18])
        chains = r.choice([[f"{a}:0", f"{34 - a}:1"], [f"{a}:0", f"{34 - a}:1"], [f"{a}:0"] * 2, [], ["", "16:0"]])
        frags = [(184.0, "HG", "Diagnostic_HG", "hg", None), (100.0, "support", "Common", "other", ""), (500.0, "M", "Precursor Ion", "other", "")]
        frags += [(300.0 + a + j * 20, f"loss{j}", "Diagnostic_FA", "fah", c) for j, c in enumerate(chains)]
        if r.random() < 0.3:
            frags.append((110.0, "more", "Common", "other", ""))
        if r.random() < 0.2:
            frags.append((184.0, "HG twice", "Diagnostic_HG", "hg", ""))
        if r.random() < 0.2:
            frags.reverse()
        library.append((i, kind, f"{kind}(34:1)", f"{kind}({'/'.join(chains)})", adduct, 700.0 + r.choice([0.0, 0.0003, 0.0006, 0.0006]), chains, frags))
    return library


def test_collapsed_search_equals_the_full_one_row_for_row(spark):
    r = random.Random(40)
    spectra = []
    for i in range(400):
        masses = [m for m in (100.0, 110.0, 184.0, 314.0, 316.0, 318.0, 334.0, 336.0, 338.0, 500.0) if r.random() < (0.25 if i % 2 and m > 300 else 0.6)]
        spectra.append((f"s{i}", 700.0003 + r.choice([0.0, 0.00015, -0.0002]), masses, [r.choice([0.01, 1.0, 9.99, 10.0, 100.0]) for _ in masses]))
    lib = spark.createDataFrame(_species_library(r), "record_id long, compound_class string, lipid_name string, chain_name string, adduct string, precursor_mz double, chains array<string>, fragments array<struct<mz: double, name: string, type: string, pool: string, chain: string>>").cache()
    sp = spark.createDataFrame(spectra, "spectrum string, precursor_mz double, mz array<double>, intensity array<double>").cache()
    for least in (0.0, 50.0):
        got, want = (sorted(map(tuple, search.search(sp, lib, top=20, least=least, collapse=c).collect()), key=repr) for c in (True, False))
        assert got == want and len(want) > 300
    classes = {x.record_id: x for x in search.equivalence_classes(lib).collect()}
    plain = collections.defaultdict(list)
    for i, kind, name, _, adduct, _, chains, frags in map(tuple, lib.collect()):
        if kind != "FA" and "" not in chains:
            plain[kind, name, adduct, tuple(sorted(collections.Counter(chains).values())), tuple(sorted(f.pool for f in frags)), tuple((f.mz, f.name, f.type, f.pool) for f in frags if not f.chain)].append(i)
    assert all(classes[i].first_record == min(own) and classes[i].n_records == len(own) for own in plain.values() for i in own)
    assert {i for i, x in classes.items() if x.signature is None} == set(classes) - {i for own in plain.values() for i in own}


def test_few_records_are_scored_where_no_chain_is_seen():
    records = [record(i, masses=(100.0, 200.0 + i, 300.0 + i, 400.0), mz=700.0 + i * 1e-4) for i in range(9)]
    alike = k.Alike.of(records, np.zeros(9, int))
    masses = np.array([x.mz for x in records])
    assert alike.kept(np.array([100.0, 400.0]), 700.00052, masses, 0, 9, 15.0) == [0, 5]
    assert alike.kept(np.array([100.0, 203.0, 400.0]), 700.00052, masses, 0, 9, 15.0) == [0, 3, 5]
    assert alike.kept(np.array([100.0]), 700.00052, masses, 2, 9, 15.0) == [2, 5] and alike.kept(np.array([]), 700.0, masses, 4, 5, 15.0) == [4]
    assert k.Alike.of(records, np.full(9, -1)).kept(np.array([100.0]), 700.0, masses, 0, 9, 15.0) == list(range(9))


def test_ruled_search_is_the_same_without_collapsing(spark):
    from spectralake.functions.rulebook import rulebook
    from spectralake.plans.search import ruled_library, ruled_search, spectra_of

    d = "/root/testdata/sf0.001"
    full = search.search(spectra_of(spark, d), ruled_library(spark, d), least=20.0, rules=rulebook(spark), collapse=False)
    assert sorted(map(tuple, ruled_search(spark, d).collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
