"""Every registered query against its SQL on small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from spectralake import registry

DATA = "/root/testdata/sf0.01"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(x is None, str(x)) for x in r]
    return sorted(([r[i] for i in order] for r in values), key=key)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-3))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.execute(registry.oracle_sql()[name])
    want = rows([c[0] for c in rel.description], rel.fetchall())
    df = registry.queries()[name](spark, DATA)
    got = rows(df.columns, [list(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(c[0] for c in rel.description)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
