"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``spectrum_search_1000`` searches 1,000 spectra in a library of at least 1.2 million records, made by repeating that of the query;
the library is loaded before the clock starts.
"""

import json
import os
import time

from pyspark.sql import functions as F

from spectralake import registry
from spectralake.operators import search
from spectralake.plans import search as searches
from spectralake.session import build


def timed_search(spark, sf_dir: str) -> float:
    library = searches.library_of(spark, sf_dir)
    n = library.count()
    copies = -(-1_200_000 // n)
    shifted = library.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("record_id", F.col("record_id") + F.col("i") * n).withColumn("precursor_mz", F.col("precursor_mz") + F.col("i") * 0.0137).drop("i").persist()
    shifted.count()
    spectra = searches.spectra_of(spark, sf_dir)
    times = -(-1000 // spectra.count())
    asked = spectra.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("spectrum", F.concat_ws("-", "spectrum", "i")).drop("i").orderBy("spectrum").limit(1000).persist()
    asked.count()
    took = []
    for _ in range(2):
        start = time.perf_counter()
        search.search(asked, shifted).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    shifted.unpersist()
    return round(took[-1], 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in registry.queries().items():
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    took["spectrum_search_1000"] = timed_search(spark, sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
