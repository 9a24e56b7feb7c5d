"""MSP files and a file stream."""

import datetime

from pyspark.sql import functions as F

from spectralake.sources import msp
from spectralake.streaming import live


def test_msp_round_trip(spark, tmp_path):
    fragments = "array<struct<mz: double, intensity: double, name: string>>"
    rows = [("PC(16:0/18:1)", 760.5851, "[M+H]+", "PC", [(184.0733, 100.0, "head"), (504.5, 7.25, "")]), ("PE(34:1)", 718.5, "[M+H]+", "PE", [])]
    df = spark.createDataFrame(rows, f"n string, mz double, a string, c string, f {fragments}")
    path = str(tmp_path / "library")
    msp.write(df.select(msp.block(*[F.col(c) for c in df.columns]).alias("value")), path)
    got = {r.name: r for r in msp.read(spark, path).collect()}
    assert set(got) == {r[0] for r in rows}
    for name, mz, adduct, kind, peaks in rows:
        r = got[name]
        assert (r.precursor_mz, r.adduct, r.compound_class, r.n_peaks) == (mz, adduct, kind, len(peaks))
        assert [(p.mz, p.intensity, p.name) for p in r.fragments] == peaks


def test_windowed_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=10 * i), "a" if i % 2 else "b", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = live.windowed(spark.readStream.schema(df.schema).parquet(source), "ts", "kind", "value")
    stream.writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, live.windowed(df, "ts", "kind", "value").collect()))
