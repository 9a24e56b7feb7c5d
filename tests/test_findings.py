"""Queries against their SQL on small tables with what the given tables lack at small sizes: repeated lines, large keys, masses of 0."""

import datetime
import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(at / f"{name}.parquet", coerce_timestamps="us")

    lines = [(o, p, (p * 7 + r) % 10, 1) for r, p in enumerate((19, 3, 11, 8)) for o in range(200)]
    write("lineitem", [(o, p + o % 5, s, n, 1.0, 2.0, 0.0) for o, p, s, n in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    write("orders", [(o, o % 20) for o in range(200)], "o_orderkey long, o_custkey long")
    write("customer", [(c, c % 5) for c in range(20)], "c_custkey long, c_nationkey int")
    write("nation", [(n, f"N{n}") for n in range(5)], "n_nationkey int, n_name string")
    write("part", [(p, p % 50) for p in range(4900, 5300)], "p_partkey long, p_size int")
    kinds = ("view", "purchase", "click")
    write("events", [(e, DAY + datetime.timedelta(minutes=e), e % 2, kinds[e % 3], 0.0 if e % 5 else 3.0) for e in range(200)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    return str(at)


@pytest.mark.parametrize("name", ["alignment_ids", "final_features", "asari_import", "isotope_requests"])
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")  # any_value and DISTINCT ON take the first row read
    for t in ("lineitem", "orders", "customer", "nation", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.fixture
def joined(monkeypatch):
    """Numbers of rows that interval joins in associate give."""
    from spectralake.operators import associate

    counts = []
    for name in ("interval_join", "near_masses"):
        plain = getattr(associate, name)

        def counted(*a, _plain=plain, **k):
            out = _plain(*a, **k)
            counts.append(out.count())
            return out

        monkeypatch.setattr(associate, name, counted)
    return counts


def test_traces_of_heavy_masses(spark):
    from spectralake.operators import associate

    q = spark.createDataFrame([(1, 0, 1e9, 0.0, 10.0), (2, 0, 0.0, 0.0, 10.0), (3, 0, -500.0, 0.0, 10.0)], "query int, file int, mz double, rt_low double, rt_high double")
    peaks = spark.createDataFrame([(0, 7, 1.02e9, 5.0), (0, 7, 1.03e9, 9.0), (0, 7, 0.0, 6.0), (0, 7, -505.0, 3.0)], "file int, scan int, peak_mz double, intensity double")
    scans = spark.createDataFrame([(0, 7, 1.0)], "file int, scan int, rt double")
    assert sorted((r.query, r.intensity) for r in associate.traces(q, scans, peaks, 20_000.0).collect()) == [(1, 5.0), (2, 6.0), (3, 3.0)]


def test_copies_are_joined_once(spark, joined):
    from spectralake.operators import associate

    named = [(i, None, None, None, None, None, "PC", "+", "c", 500.0, 1.0, None) for i in range(40)] + [(100 + i, 200 - i, 500.001, 1.2, None, None, "PC", "+", "c", 500.0, 1.0, None) for i in range(40)]
    rows = spark.createDataFrame(named, "id long, feature_id long, feature_mz double, feature_rt double, rt_min double, rt_max double, matched_name string, adduct string, compound_class string, mz double, rt double, support string")
    assert {(r.id, r.feature_id) for r in associate.rescue_orphans(rows, "id").collect()} == {(i, 161) for i in range(40)}
    native = spark.createDataFrame([(i, 500.0, 1.0, "a") for i in range(40)] + [(50, 600.0, 1.0, "a"), (51, None, 1.0, "a")], "key int, mz double, rt double, source_file string")
    aligned = spark.createDataFrame([(i, 500.0, 0.9, 1.1, {"a": 1.0}) for i in range(40)] + [(60, 600.0, 0.9, 1.1, {"b": 0.0}), (61, 600.0, 0.9, 1.1, {"a": 0.0})], "aligned_id int, aligned_mz double, rt_min double, rt_max double, areas map<string,double>")
    got = {r.key: r.aligned_id for r in associate.infer_alignment(native, aligned, "key").collect()}
    assert got == {**dict.fromkeys(range(40)), 50: 60, 51: None}
    spectra = spark.createDataFrame([(500.0, 1.0, i % 7 * 1.0, i) for i in range(40)], "spectrum_mz double, spectrum_rt double, score double, scan int")
    best = associate.best_spectrum(native.select("key", "mz", "rt"), spectra, "key", ["score"], "scan")
    assert {r.key: r.scan for r in best.collect()} == {**dict.fromkeys(range(40), 6), 50: None, 51: None}
    library = spark.createDataFrame([(i, "x", "c", "f", "+", 500.0, "species", 2) for i in range(40)], "entry int, candidate_name string, compound_class string, formula string, adduct string, theoretical_mz double, resolution string, sources int")
    asked = spark.createDataFrame([(1, 500.0, False), (2, 500.001, False), (3, 500.0, True)], "key int, mz double, identified boolean")
    assert {(r.key, r.source_record_count, r.entry) for r in associate.mass_fallback(asked, library).collect()} == {(1, 80, 0), (2, 80, 0)}
    assert joined == [1, 3, 1, 2]


def test_cohorts_go_by_units(spark, monkeypatch):
    """Copies go once through the kernel, with the groups of a plain loop over all rows."""
    from spectralake.operators import clusters

    rows = [("+", f"s{i % 3}", f"{i:05d}", 500 + i * 7 % 4 * 0.003, i * 11 % 5 * 0.1, ("p0", "p1", None, None)[i * 5 % 9 % 4]) for i in range(2000)]
    seen, plain = [], clusters._grouped
    monkeypatch.setattr(clusters, "_grouped", lambda placed, *a: (seen.append(placed.count()), plain(placed, *a))[1])
    df = spark.createDataFrame(rows, "mode string, source string, scan string, mz double, rt double, peak string")
    got = {(r.source, r.scan): r.cohort.split("|")[2] for r in clusters.cohorts(df, 10.0, 0.15).collect()}
    groups, want = [], {}
    for _, source, scan, mz, rt, peak in sorted(rows, key=lambda r: (r[3], r[4], r[1], r[2])):
        best = None
        for g, (head, low, high, held) in enumerate(groups):
            if mz - head <= mz * 1e-5 and max(high, rt) - min(low, rt) <= 0.15 + 1e-10 and (not peak or held.get(source, peak) == peak):
                off = abs((low + high) / 2 - rt)
                best = (off, g) if best is None or off <= best[0] else best
        if best is None:
            groups.append([mz, rt, rt, {}])
            best = (0.0, len(groups) - 1)
        g = groups[best[1]]
        g[1], g[2] = min(g[1], rt), max(g[2], rt)
        if peak:
            g[3][source] = peak
        want[source, scan] = str(best[1])
    assert got == want
    assert seen[0] <= 4 * 5 * 3 * 5


def test_consensus_of_a_crowded_mass(spark):
    import time

    from spectralake.operators import clusters

    n = 8000
    df = spark.range(2 * n).selectExpr("id % 2 AS sample", "id AS feature", "500.0D AS mz", "floor(id / 2) * 40 + id % 2 * 2.0D AS rt", "1 AS charge")
    start = time.monotonic()
    out = clusters.consensus_groups(df).groupBy("group").count().collect()
    assert len(out) == n and {r["count"] for r in out} == {2}
    assert time.monotonic() - start < 30  # every peak against every other takes minutes


def test_trace_queries_go_by_places(spark, monkeypatch):
    from spectralake.operators import clusters

    seen, plain = [], clusters._grouped
    monkeypatch.setattr(clusters, "_grouped", lambda placed, *a: (seen.append(placed.count()), plain(placed, *a))[1])
    df = spark.range(1000).selectExpr("'a' AS source", "lpad(id, 4, '0') AS scan", "500 + id % 2 * 0.001D AS mz", "id % 4 * 0.3D AS seed")
    got = sorted((r.lower, r.upper, len(r.scans), r.scans[0]) for r in clusters.queries(df, ["source"]).collect())
    assert [(round(a, 6), round(b, 6), n, s) for a, b, n, s in got] == [(0.0, 0.65, 500, "0000"), (0.25, 1.25, 500, "0002")]
    assert seen == [4]


def test_self_joins_pass_no_side_through_the_driver(spark):
    from spectralake.operators import detection, graphs

    rows = spark.range(10).selectExpr("id", "id % 2 AS file", "500 + id * 0.5D AS mz", "1D AS rt", "0D AS rt_min", "2D AS rt_max", "100D - id AS height", "array(1) AS samples")
    for out in (detection.isotopes(rows, "id"), graphs.ion_relations(rows, "id", "positive")):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_copies_are_searched_once(spark, monkeypatch):
    from spectralake.operators import search

    seen, plain = [], search.with_evidence
    monkeypatch.setattr(search, "with_evidence", lambda library, rules=None: (seen.append(library.count()), plain(library, rules))[1])
    fragments = "array(named_struct('mz', 200D, 'name', 'f', 'type', 'Precursor Ion', 'pool', 'fah', 'chain', ''))"
    library = spark.range(40).selectExpr("id AS record_id", "if(id % 2 = 0, 'FA', 'PE') AS compound_class", "'x' AS lipid_name", "'x' AS chain_name", "'[M-H]-' AS adduct", "500D AS precursor_mz", "array('16:0') AS chains", f"{fragments} AS fragments")
    spectra = spark.range(30).selectExpr("concat('s', id) AS spectrum", "500.0001D AS precursor_mz", "array(200D, 300D) AS mz", "array(9D, 1D) AS intensity")
    rows = search.search(spectra, library, least=0.0).collect()
    # of free acids the first three are ranked one by one; a lipid without its chain is not reported
    assert {(r.spectrum, r.record_id) for r in rows if r.result_rank_scope == "fa"} == {(f"s{i}", n) for i in range(30) for n in (0, 2, 4)}
    classes = {r.record_id: (r.first_record, r.n_records) for r in search.equivalence_classes(library).collect()}
    assert classes == {i: (i, 1) if i % 2 == 0 else (1, 20) for i in range(40)}
    assert seen == [3 + 1, 2]


def test_equal_places_have_one_context(spark, monkeypatch):
    from spectralake.operators import clusters, joins

    seen, plain = [], joins.interval_join
    monkeypatch.setattr(joins, "interval_join", lambda *a, **k: (lambda out: (seen.append(out.count()), out)[1])(plain(*a, **k)))
    asked = spark.range(40).selectExpr("0 AS file", "id AS query", "500D AS mz", "5D AS lower", "5.5D AS upper")
    native = spark.range(200).selectExpr("0 AS file", "500D AS native_mz", "id % 4 * 2D AS apex", "id % 4 * 2D - 0.5D AS left", "id % 4 * 2D + 0.5D AS right")
    got = {(round(r.lower, 6), round(r.upper, 6)) for r in clusters.with_context(asked, native, ["file"]).collect()}
    # [5.5, 6.5] alone is met, and its neighbour begins at 3.5
    assert got == {(3.35, 6.65)}
    assert seen == [4]


def test_traces_of_a_crowded_place():
    """Equal masses of one scan are not passed through one by one, and traces are those of a plain loop."""
    import time

    import numpy as np

    from spectralake.operators import detection

    def plain(scan, mz, intensity, ppm, least):
        trace, number = np.full(len(mz), -1), 0
        for seed in np.lexsort((mz, scan, -intensity)):
            if trace[seed] >= 0 or intensity[seed] < least:
                continue
            trace[seed], weight, centre = number, intensity[seed], mz[seed]
            for way in (1, -1):
                k, last = scan[seed] + way, scan[seed]
                while 0 <= k <= scan.max() and abs(k - last) <= 6:
                    free = np.flatnonzero((scan == k) & (trace < 0) & (mz >= centre - centre * ppm * 1e-6) & (mz <= centre + centre * ppm * 1e-6))
                    if len(free):
                        near = free[np.abs(mz[free] - centre).argmin()]
                        trace[near], centre, weight, last = number, (centre * weight + mz[near] * intensity[near]) / (weight + intensity[near]), weight + intensity[near], k
                    k += way
            number += 1
        return trace

    rng = np.random.default_rng(0)
    for n, spread in ((400, 12), (400, 400)):
        scan = np.sort(rng.integers(0, 9, n))
        mz, intensity = 500 + rng.integers(0, spread, n) * 2e-3, rng.integers(1, 60, n).astype(float)
        by = np.lexsort((intensity, mz, scan))
        scan, mz, intensity = scan[by], mz[by], intensity[by]
        assert (detection.grow(scan, mz, intensity, 10.0, 5.0) == plain(scan, mz, intensity, 10.0, 5.0)).all()
    n = 60_000
    start = time.monotonic()
    detection.grow(np.repeat(np.arange(3), n), np.full(3 * n, 500.0), np.full(3 * n, 9.0), 10.0, 5.0)
    assert time.monotonic() - start < 10  # looking through all peaks of a place for each takes minutes


def test_encoder_keeps_to_its_memory():
    import public_tokenizers

    from spectralake.llm import bpe

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    small, plain = bpe.Codec.of(*args, 5000), bpe.Codec.of(*args)
    text = " ".join(f"word{i * 7 % 401}x" for i in range(3000))
    assert small.encode(text) == plain.encode(text)
    assert max(map(len, (small.spaced, small.spaced.old))) < 30 < len(plain.spaced)


def test_parts_of_repetitive_rows_are_not_merged(spark):
    from spectralake.operators import graphs, ranking

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(2000).selectExpr("id", "id % 50 AS key", "'a' AS kind", "id % 3 * 1D AS score", "1 AS fragments", "500D + id % 9 AS mz")
    assert ranking.tiers(rows, ["key"], "kind", "score", "fragments", ["id"]).rdd.getNumPartitions() == n
    assert graphs.ion_pairs(rows, "id", "mz", ["key"], {"x": 1.0}, 5.0).rdd.getNumPartitions() == n


def test_a_spectrum_counts_by_its_first_row(spark, tmp_path):
    """Of rows with the same spectrum and ord, linked_lists takes the first by file and position; the order of its files is not that of their sizes."""
    import pandas as pd

    (tmp_path / "lineitem.parquet").mkdir()
    first = [(o, 10, 40, 1, 1.0, 2.0, 0.0) for o in range(100)]
    second = [(o, 299 - i, 40, 1, 9.0, 2.0, 0.0) for i in range(200) for o in range(100)]
    for i, lines in enumerate((first, second)):
        pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]).to_parquet(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["linked_lists"]).fetchall()
    got = [tuple(r) for r in entry.queries()["linked_lists"](spark, str(tmp_path)).collect()]
    assert got == want
    assert got[0][-2:] == (1.0, 2.0)


def test_lists_of_few_texts_are_reduced_first(spark):
    """A key's rows are reduced to its texts before they are collected; a null key is a group too."""
    from spectralake.operators import annotate

    df = spark.range(3000).selectExpr("nullif(id % 3, 0) AS key", "id AS spectrum", "concat('f', (id * 7) % 5) AS source_file", "nullif(concat('', id % 2), '0') AS scan_id", "3000 - id AS ord")
    out = annotate.linked_counts(df, "key", "ord")
    assert sorted((r.key or 0, r.n_scans, r.n_files, r.files, r.scans) for r in out.collect()) == [(0, 1000, 5, "f4;f3;f2;f1;f0", "1"), (1, 1000, 5, "f1;f0;f4;f3;f2", "1"), (2, 1000, 5, "f3;f2;f1;f0;f4", "1")]
    spread = annotate.ordered_lists(df, "key", "ord", {"files": "source_file"})
    collected = [n for n in spread._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in n]
    assert len(collected) == 2 and "collect_list" in collected[0] and "collect_list" not in collected[1]


def test_a_key_that_rows_share_is_rescued_once(spark, tmp_path):
    """The keys of orphan_rescue collide from part 100,000 on, and lines repeat: SQL gives the nearest feature for each key."""
    import pandas as pd

    lines = [(o, p + high, (o * 7 + p * 3 + n) % 30, n - high // 100_000, 1.0, 2.0, 0.0) for o in range(40) for p in range(0, 60, 3) for n in (2, 3) for high in (0, 100_000)]
    pd.DataFrame(lines + lines[::7], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(entry.oracle_sql()["orphan_rescue"]).fetchall()
    got = [tuple(r) for r in entry.queries()["orphan_rescue"](spark, str(tmp_path)).collect()]
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_spectra_and_features_meet_by_apex_and_place(spark, joined):
    """Features of other times aren't met at all, and copies once; of equal keys the matches are counted together."""
    from spectralake.operators import associate

    features = spark.range(2000).selectExpr("'/x/P.mzML' AS source_file", "id AS feature_id", "500D AS feature_mz", "if(id < 1000, 7D, id * 0.01D) AS feature_apex", "if(id = 1203, 'unresolved_detector_bounds', null) AS boundary")
    rows = [(i, "p.mzml", 500.0, 7.0) for i in range(300)] + [(1000 + i, "p.mzml", 500.001, 12.0 + i * 0.01) for i in range(5)] + [(2000, "p.mzml", 500.0, 13.0000009), (2001, "p.mzml", 500.0, 13.000002), (2002, "q.mzml", 500.0, 13.0), (2003, "p.mzml", 500.0, None), (2004, "p.mzml", 500.0, 14.0), (2004, "p.mzml", 500.0, 15.0)]
    spectra = spark.createDataFrame(rows, "key int, source_file string, mz double, apex double")
    got = {(r.key, r.feature_id) for r in associate.link_by_apex(spectra, features, "key").collect()}
    assert got == {(1000, 1200), (1001, 1201), (1002, 1202), (1004, 1204), (2000, 1300)}
    assert joined[0] <= 10


def test_ion_relations_join_places(spark, monkeypatch):
    """Features of one place go through the join together, in rows of bounded length, and give the pairs of a plain loop."""
    from spectralake.operators import graphs

    seen, plain = [], graphs.interval_join
    monkeypatch.setattr(graphs, "interval_join", lambda *a, **k: (lambda out: (seen.append(out.count()), out)[1])(plain(*a, **k)))
    monkeypatch.setattr(graphs, "KEYS", 16)
    ions = {"[M+H]+": 1.007276466621, "[M+Na]+": 22.989220702}
    mass = [500 + ions["[M+H]+"], 500 + ions["[M+Na]+"], 500 + ions["[M+Na]+"]]
    rows = [(i, mass[i % 3], i % 3 // 2 * 0.04, [i % 2, i % 2, 7 + i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, mz double, rt double, samples array<int>")
    got = sorted((r.feature_a, r.feature_b, r.ion_a, r.ion_b, r.shared_samples) for r in graphs.ion_relations(df, "id", "positive").collect())
    want = sorted((a[0], b[0], "[M+H]+", "[M+Na]+", 2) for a in rows for b in rows if a[0] % 3 == 0 and b[0] % 3 > 0 and a[0] % 2 == b[0] % 2)
    assert got == want
    assert seen[0] <= 2 * 4 * 2 * 4 * 2


def test_prefix_trees_broadcast_little(spark, monkeypatch):
    """What op12 may send to the driver doesn't follow the session's bound on compressed bytes, which it finds again as it was."""
    from spectralake.llm import ngram_join

    name, seen = "spark.sql.autoBroadcastJoinThreshold", []

    def stopped(*_):
        seen.append(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
        raise InterruptedError

    monkeypatch.setattr(ngram_join, "_profiles", stopped)
    before = spark.conf.get(name)
    try:
        for most in ("10MB", "-1"):
            spark.conf.set(name, most)
            with pytest.raises(InterruptedError):
                ngram_join.group(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"))
            assert spark.conf.get(name) == most
    finally:
        spark.conf.set(name, before)
    assert seen == [256 << 10, -1]
