"""Readers and writers on small files: MSP dialects, mzML, feature tables, indexed libraries, exports."""

import base64
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.sources import exports, library, msp, mzml, project, runs, tables, workbook

MSP = """Name: PC(16:0/18:1)
PrecursorMZ: 760.5851
PrecursorType: [M+H]+
CompoundClass: PC
Formula: C42H82NO8P
Comment: MS1_name=PC(34:1);polarity=+
Num Peaks: 4
184.0733 1e2 "head" "Diagnostic_HG"
504.5 7.25 "{"name":"loss","type":"Diagnostic_FA_Loss","required_group":"","weight":2.0}"
1.5E2\t3
not a peak

Name: broken
PrecursorType: [M+H]+

NAME: PE(34:1)
precursormz: 718.5
PrecursorType: [M-H]-
CompoundClass: PE
Num Peaks: 1
140.01 100 "x"
"""


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_msp_dialect(spark, tmp_path, ending):
    path = tmp_path / "a.msp"
    path.write_bytes(MSP.replace("\n", ending).encode())
    got = {r.name: r for r in msp.read(spark, str(path)).collect()}
    assert set(got) == {"PC(16:0/18:1)", "PE(34:1)"}
    a = got["PC(16:0/18:1)"]
    assert (a.precursor_mz, a.adduct, a.formula, a.ms1_name, a.polarity, a.n_peaks, a.lipid_name) == (760.5851, "[M+H]+", "C42H82NO8P", "PC(34:1)", "+", 4, "PC(34:1)")
    assert [(p.mz, p.intensity, p.name, p.type, p.weight) for p in a.fragments] == [(184.0733, 100.0, "head", "Diagnostic_HG", 1.0), (504.5, 7.25, "loss", "Diagnostic_FA_Loss", 2.0), (150.0, 3.0, "", "Common", 1.0)]
    b = got["PE(34:1)"]
    assert b.precursor_mz == 718.5 and [(p.mz, p.name, p.type) for p in b.fragments] == [(140.01, "x", "Common")]


def test_msp_writing_and_faults(spark, tmp_path):
    path = tmp_path / "a.msp"
    path.write_text(MSP)
    rows = msp.read(spark, str(path))
    msp.write(rows.select(msp.full_block().alias("value")), str(tmp_path / "out"))
    back = {r.name: r for r in msp.read(spark, str(tmp_path / "out")).collect()}
    assert [(round(p.mz, 4), p.name, p.type) for p in back["PC(16:0/18:1)"].fragments][:2] == [(184.0733, "head", "Diagnostic_HG"), (504.5, "loss", "Diagnostic_FA_Loss")]
    assert back["PC(16:0/18:1)"].ms1_name == "PC(34:1)"
    blocks = spark.read.option("lineSep", "\n\n").text(str(path))
    wrong = {r.value.split("\n")[0].split(": ")[1]: r.wrong for r in msp.faults(blocks).collect()}
    assert wrong["broken"] == ["precursormz", "compoundclass", "num peaks", "peaks"] and "peaks" in wrong["PC(16:0/18:1)"] and "PE(34:1)" not in wrong


def _spectrum(i, level, rt, mz, intensity, precursor=None, double=True, packed=True, minute=True, ref="common"):
    def array(values, kind):
        raw = np.asarray(values, "<f8" if double else "<f4").tobytes()
        text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        terms = [kind, "MS:1000523" if double else "MS:1000521", "MS:1000574" if packed else "MS:1000576"]
        return "<binaryDataArray>" + "".join(f'<cvParam accession="{t}" value=""/>' for t in terms) + f"<binary>{text}</binary></binaryDataArray>"

    ion = f'<precursorList count="1"><precursor spectrumRef="scan=1"><selectedIonList count="1"><selectedIon><cvParam accession="MS:1000744" value="{precursor}"/><cvParam accession="MS:1000041" value="1"/></selectedIon></selectedIonList></precursor></precursorList>' if precursor else ""
    unit = "UO:0000031" if minute else "UO:0000010"
    return f'<spectrum index="{i}" id="scan={i + 1}"><referenceableParamGroupRef ref="{ref}"/><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000127" value=""/><scanList count="1"><scan><cvParam accession="MS:1000016" value="{rt}" unitAccession="{unit}"/></scan></scanList>{ion}<binaryDataArrayList count="2">{array(mz, "MS:1000514")}{array(intensity, "MS:1000515")}</binaryDataArrayList></spectrum>'


def _mzml(path, spectra, polarity="MS:1000130"):
    path.write_text(f'<?xml version="1.0"?><mzML><referenceableParamGroupList count="1"><referenceableParamGroup id="common"><cvParam accession="{polarity}" value=""/></referenceableParamGroup></referenceableParamGroupList><run><spectrumList>{"".join(spectra)}</spectrumList></run></mzML>')
    return str(path)


def test_mzml(spark, tmp_path):
    spectra = [_spectrum(0, 1, 0.5, [100.5, 200.25], [1.0, 2.0]), _spectrum(1, 2, 31.5, [50.0], [7.0], precursor=200.25, double=False, packed=False, minute=False), _spectrum(2, 1, 0.6, [], [])]
    path = _mzml(tmp_path / "a.mzML", spectra)
    rows = {r.scan_id: r for r in mzml.spectra(spark, path).collect()}
    assert (rows["scan=1"].level, rows["scan=1"].rt_seconds, rows["scan=1"].polarity, rows["scan=1"].centroided, rows["scan=1"].mz) == (1, 30.0, "+", True, [100.5, 200.25])
    assert (rows["scan=2"].precursor_mz, rows["scan=2"].charge, rows["scan=2"].parent, rows["scan=2"].rt_seconds, rows["scan=2"].intensity) == (200.25, 1, "scan=1", 31.5, [7.0]) and rows["scan=3"].mz == []
    counts = mzml.inventory(spark, path, "positive").first()
    assert (counts.ms1_scans, counts.ms2_scans) == (2, 1) and mzml.peaks(mzml.spectra(spark, path)).count() == 3
    with pytest.raises(Exception, match="polarity"):
        mzml.inventory(spark, path, "negative").collect()
    with pytest.raises(Exception, match="parameter group"):
        mzml.spectra(spark, _mzml(tmp_path / "b.mzML", [_spectrum(0, 1, 1, [1.0], [1.0], ref="other")])).collect()


def test_columns_are_found_by_alias():
    assert tables.find_column(["x", " MZ "], ["mz"]) == " MZ " and tables.find_column(["RT_(min)"], ["RT (min)"]) == "RT_(min)" and tables.find_column(["a"], ["b"]) is None


def test_work_table_units_and_ids(spark):
    rows = [(0, "100.5", "300", "290", "310"), (1, None, "1", "1", "2"), (2, "101", None, "30", "90")]
    got = {r._ord: r for r in tables.work_table(spark.createDataFrame(rows, "_ord long, mzmed string, rtmed string, rtmin string, rtmax string")).collect()}
    assert set(got) == {0, 2} and got[0].rt == 5.0 and got[2].rt == 1.0 and got[0].feature_id == "F1" and got[2].feature_id == "F3"
    named = spark.createDataFrame([(0, "7", "500", "250", "minutes"), (1, "8", "500", "60", "s")], "_ord long, id string, mz string, RT string, RT_unit string")
    assert {r.feature_id: r.rt for r in tables.work_table(named).collect()} == {"7": 250.0, "8": 1.0}
    with pytest.raises(Exception, match="time unit"):
        tables.work_table(named.withColumn("RT_unit", F.lit("hours"))).collect()
    with pytest.raises(ValueError):
        tables.work_table(named.drop("mz"))


def test_ids_are_renumbered_by_their_numbers(spark):
    rows = spark.createDataFrame([(0, "F10"), (1, "x"), (2, "FT2"), (3, "9000"), (4, "row_3"), (5, "F10")], "_ord long, Feature_ID string")
    assert {r._ord: r.Feature_ID for r in tables.renumbered(rows).collect()} == {2: "F1", 4: "F2", 0: "F3", 5: "F4", 3: "F5", 1: "F6"}


def test_detector_tables(spark):
    x = spark.createDataFrame([(0, "1.23456", "60", "90", "120", "5", None, "7.5")], "_ord long, mzmed string, rtmin string, rtmed string, rtmax string, npeaks string, `a.mzML` string, into string")
    r = tables.xcms(x).first()
    assert (r.mz, r.RTmin, r.RT, r.RTmax, r["a.mzML"], r.into, r.Feature_ID) == (1.2346, 1.0, 1.5, 2.0, 0.0, 7.5, "F1")
    a = spark.createDataFrame([(0, "F5", "100.1", "90.04", "80"), (1, "F2", "100.2", "30", "20")], "_ord long, id_number string, mz string, rtime string, rtime_left_base string")
    got = {q._ord: q for q in tables.asari(a).collect()}
    assert (got[0].Feature_ID, got[0].RT, got[0].RTmin, got[1].Feature_ID) == ("F2", 1.501, 1.333, "F1") and "rtime" not in got[0].asDict()
    o = spark.createDataFrame([(0, "500.12345", "300", "290", "1e301", "q")], "_ord long, mz string, RT string, RTstart string, RTend string, charge string")
    r = tables.openms(o).first()
    assert (r.mz, r.RT, r.RTmin, r.RTmax, r.RT_unit) == (500.1234, 5.0, None, None, "minutes") and r.mzmin < 500.1234 < r.mzmax and "charge" not in r.asDict()
    bare = tables.openms(o.drop("RTstart", "RTend")).first()
    assert bare.peak_boundary_status == "unresolved" and bare.RTmin is None


def test_matrix_validation(spark):
    samples = spark.createDataFrame([("A.mzML", True), ("b.mzML", True), ("c.mzML", False)], "source_file string, included boolean")
    rows = spark.createDataFrame([("F1", "100", "1", "5", "6")], "Feature_ID string, mz string, RT string, a string, `B.mzml` string")
    r = tables.feature_matrix(rows, samples).first()
    assert r["A.mzML"] == 5.0 and r["b.mzML"] == 6.0
    for bad in (rows.union(rows), rows.withColumn("mz", F.lit("-1")), rows.withColumn("Feature_ID", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            tables.feature_matrix(bad, samples)
    with pytest.raises(Exception, match="negative"):
        tables.feature_matrix(rows.withColumn("a", F.lit("-1")), samples).collect()
    assert tables.view(rows).columns == ["Feature_ID", "mz", "RT", "RTmin", "RTmax", "PeakArea"]


def test_result_tables_with_group_lines(spark, tmp_path):
    rows = spark.createDataFrame([("F1", 1.5, "x,y"), ("F2", None, 'q"')], "`Feature ID` string, `a.mzML` double, note string")
    for groups in ({"a.mzML": "QC"}, {}):
        path = exports.write_csv(rows, f"{tmp_path}/{len(groups)}", groups)
        got, found = tables.read_results(spark, path)
        assert found == groups and {r["Feature ID"]: (r["a.mzML"], r.note) for r in got.collect()} == {"F1": ("1.5", "x,y"), "F2": (None, 'q"')}


def test_indexed_library(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.msp").write_text(MSP + "\nName: PS(36:1)\nPrecursorMZ: 700.1\nPrecursorType: [M+NH4]+\nCompoundClass: PS\nNum Peaks: 1\n100 1\n")
    cache = f"{tmp_path}/cache"
    first = library.load(spark, str(tmp_path / "lib"), cache)
    assert first.count() == 3 and library.load(spark, str(tmp_path / "lib"), cache).inputFiles() == first.inputFiles()
    path = first.inputFiles()[0].rsplit("/polarity=", 1)[0]
    assert {r.name for r in library.scan(spark, path).collect()} == {"PC(16:0/18:1)", "PE(34:1)"}
    assert [r.name for r in library.scan(spark, path, "-").collect()] == ["PE(34:1)"] and library.scan(spark, path, classes=["PC"], adducts=["[M+H]+"], low=700.0, high=770.0).count() == 1
    plan = library.scan(spark, path, "+", low=700.0, high=770.0).select("name")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(polarity" in plan and "GreaterThanOrEqual(precursor_mz,700.0)" in plan
    assert {(r.compound_class, r.n) for r in library.catalogue(first).collect()} == {("PC", 1), ("PE", 1), ("PS", 1)}
    with pytest.raises(ValueError):
        library.scan(spark, path, low=5.0, high=1.0)


def test_long_rows_and_derived_records(spark):
    rows = spark.createDataFrame([("a", 1, 300.0, "y", "Common", 1.0, 1.0, None), ("a", 0, 200.0, "x", "Common", 2.0, 1.0, "hg"), ("b", 2, 1.0, "z", "Common", 1.0, 1.0, None)], "name string, ord long, mz double, fname string, type string, intensity double, weight double, required_group string")
    got = {r.name: r for r in library.from_long_rows(rows.withColumnRenamed("name", "n").withColumnRenamed("fname", "name"), ["n"], "ord").withColumnRenamed("n", "name").collect()}
    assert [f.name for f in got["a"].fragments] == ["x", "y"] and got["a"]._first == 0
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert {(r.k, r.v) for r in library.with_derived(base, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v long"), ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_project_and_exports(spark, tmp_path):
    folder = f"{tmp_path}/p"
    p = project.Project("demo", "positive", {"/x/s1.mzML": {"sample_type": "QC", "group": "1"}, "/x/s2.mzML": {"included": False}})
    p.save(spark, folder)
    again = project.Project.load(spark, folder)
    assert again == p and {(r.source_file, r.sample_type, r.included) for r in again.samples(spark).collect()} == {("s1.mzML", "QC", True), ("s2.mzML", "Sample", False)}
    with pytest.raises(ValueError):
        project.Project("demo", "both", {})
    rows = spark.range(3).withColumn("x", F.lit("a"))
    exports.write_tables(spark, f"{tmp_path}/out", {"one": rows, "two": rows.limit(1)}, {"ppm": 5})
    manifest = exports.manifest(spark, f"{tmp_path}/out")
    assert manifest["parameters"] == {"ppm": 5} and manifest["tables"] == {"one": 3, "two": 1} and spark.read.parquet(f"{tmp_path}/out/one").count() == 3
    exports.write_selected(spark, f"{tmp_path}/sel", {"rows": rows.withColumnRenamed("id", "key")}, spark.createDataFrame([(1,)], "key long"), "key")
    assert spark.read.parquet(f"{tmp_path}/sel/rows").count() == 1
    assert json.loads(json.dumps(manifest)) == manifest
    (tmp_path / "in").mkdir()
    for n in ("B.mzML", "a.MZML", "c.txt"):
        (tmp_path / "in" / n).write_text("x")
    assert [x.rsplit("/", 1)[1] for x in project.discover(spark, [str(tmp_path / "in")])] == ["a.MZML", "B.mzML"]
    with pytest.raises(FileNotFoundError):
        project.discover(spark, [str(tmp_path / "p")])


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([("F1", 1.5, "=1+1", True, 7), ("F2", None, 'a <b> & "c"\x01\nd', None, 8)], "`Feature ID` string, `m/z` double, note string, `a.mzML` boolean, n int")
    empty = rows.limit(0).select("n")
    path = workbook.write_workbook(f"{tmp_path}/b/x.xlsx", {"one": rows, "two & more": empty}, {"a.mzML": "QC"})
    got = {r["Feature ID"]: tuple(r)[1:] for r in workbook.read_sheet(spark, str(path)).collect()}
    assert got == {"F1": ("1.5", "=1+1", "1", "7"), "F2": (None, 'a <b> & "c"\nd', None, "8")}
    second = workbook.read_sheet(spark, str(path), "two & more")
    assert second.columns == ["n"] and second.count() == 0
    text = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert 'ySplit="2"' in text and 'autoFilter ref="A2:E4"' in text and "样本分组" in text
    with pytest.raises(ValueError, match="no sheet"):
        workbook.read_sheet(spark, str(path), "three")


def test_saved_runs(spark, tmp_path):
    for name, files in {
        "a": {"ms1/xcms/xcms_features.csv": "mz,RT,s1\n100.5,90,5\n", "run_settings.json": '{"ms1": {"algo": "xcms"}}', "provenance.json": '{"inputs": [{"path": "C:\\\\x\\\\S1.mzML"}]}'},
        "b": {"ms1/pyopenms/pyopenms_features.csv": "mz,RT,s1\n100.5,1.5,5\n", "ms1/pyopenms/pyopenms_features_native.csv": "mz,source_file\n1,s1.mzML\n"},
        "c": {"ms1/t.csv": "mz,source_file\n7,s1.mzML\n", "ms1/feature_table.json": '{"algorithm": "ms-dial", "table": "t.csv"}'},
        "d": {"ms1/pyopenms/old_native.csv": "mz\n1\n"},
        "e": {"ms1/none.txt": ""},
    }.items():
        for f, text in files.items():
            (tmp_path / name / f).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / f).write_text(text)
    get = lambda n: runs.saved_tables(spark, f"{tmp_path}/{n}")
    native, aligned, detector = get("a")
    assert native is None and detector == "xcms" and (aligned.first().RT, aligned.first()["S1.mzML"]) == (1.5, "5")
    native, aligned, detector = get("b")
    assert detector == "pyopenms" and native.first().source_file == "s1.mzML" and aligned.first().RT == "1.5"
    native, aligned, detector = get("c")
    assert detector == "msdial" and aligned is None and native.first().mz == "7"
    native, aligned, detector = get("d")
    assert detector == "pyopenms" and aligned is None and native.count() == 1
    assert get("e")[:2] == (None, None)


def test_a_block_of_a_library_is_taken_apart_once(spark):
    odd = ["Name: a\r\nPRECURSORMZ : 5\nName: b\n num PEAKS : 2\n1 2 \"x\" \"T\"\n\t.5\t1e3  {\"name\": \"j\", \"type\": \"K\", \"weight\": 2}\nno peak\n3 4 \"u\"v\"w\"", "Name: c\nPrecursorMZ: x\nNum Peaks: 1\n1 2", "PrecursorMZ: 7\nComment: polarity=-; ms1_name=B", None, ""]
    blocks = spark.createDataFrame([(x,) for x in odd], "value string")
    got = msp.records(blocks)
    a, b = got.collect()
    assert (a.name, a.precursor_mz, a.adduct, a.n_peaks) == ("a", 5.0, None, 2) and (b.name, b.ms1_name, b.polarity, b.fragments) == (None, "B", "-", [])
    assert [tuple(f) for f in a.fragments] == [(1.0, 2.0, "x", "T", None, 1.0), (0.5, 1000.0, "j", "K", None, 2.0), (3.0, 4.0, "u", "w", None, 1.0)]
    # a filter or field that repeats the split would read every block again
    assert got._jdf.queryExecution().optimizedPlan().toString().count("num peaks") == 1
