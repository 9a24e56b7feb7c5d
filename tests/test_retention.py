"""Retention models: planted lines with outliers, rescue, crossings, borrowed series, evaluation."""

import numpy as np
import pandas as pd
import pytest

from spectralake.functions import series_models as sm
from spectralake.operators import retention


def points(carbons, times):
    return pd.DataFrame({"total_c": carbons, "rt": times})


def test_fit_bends_only_where_it_rises():
    c = np.arange(30.0, 40.0)
    kind, coef = sm.fit(c, 0.25 * c + 0.01 * (c - 30) ** 2)
    assert kind == "quadratic" and np.allclose(np.polyval(coef[::-1], c), 0.25 * c + 0.01 * (c - 30) ** 2)
    assert sm.fit(c, -c) is None and sm.fit(c[:1], c[:1]) is None
    assert sm.fit(c[:2], 0.5 * c[:2])[0] == "linear"
    falls = 5 - 0.2 * (c - 35) ** 2 + 0.3 * c
    assert sm.fit(c, falls)[0] == "linear"


def test_robust_fit_removes_gross_outliers_then_the_worst():
    c = np.arange(30, 40)
    t = 0.25 * c
    t = t.astype(float)
    t[4] += 5
    t[7] += 0.9
    curve = sm.robust(points(c, t))
    assert sorted(curve.removed) == [4, 7] and curve.n == 8 and np.allclose(curve.at(c[[0, 9]]), 0.25 * c[[0, 9]], atol=0.05)
    assert sm.robust(points(c[:3], t[:3])).kind == "insufficient_points"
    assert sm.robust(points(c[:5], -t[:5])).kind == "non_monotonic"


def test_rescue_replaces_and_extends():
    c = list(range(30, 38))
    top = pd.DataFrame({"ord": range(8), "total_c": c, "rt": [x / 4 for x in c], "rank": 1, "score": 90.0})
    top.loc[3, "rt"] += 6
    more = pd.DataFrame({"ord": [20, 21, 22, 23], "total_c": [33, 33, 40, 45], "rt": [33 / 4 + 0.1, 33 / 4 + 0.4, 10.2, 11.25], "rank": [2, 3, 2, 2], "score": [50.0] * 4})
    every = pd.concat([top, more]).set_index("ord", drop=False).rename_axis(None)
    curve, anchors, replaced, added = sm.rescued(every.iloc[:8], every)
    assert (replaced, added) == (1, 1) and set(anchors.index) == {0, 1, 2, 4, 5, 6, 7, 20, 22} and curve.n == 9


def family(offsets, carbons=range(30, 40), extra=()):
    rows = [(db, c, c / 4 - o) for db, o in offsets.items() for c in carbons] + list(extra)
    return pd.DataFrame(rows, columns=["total_db", "total_c", "rt"]).assign(score=80.0, rank=1)


def test_ordered_family_keeps_order_and_borrows_once():
    rows = family({0: 0.0, 1: 0.8, 3: 2.4}, extra=[(2, 34, 34 / 4 - 1.6), (2, 36, 36 / 4 - 1.6), (4, 35, 35 / 4 - 3.2), (6, 35, 1.0)])
    models = sm.ordered_family(rows)
    assert set(models) == {0, 1, 2, 3, 4} or set(models) == {0, 1, 2, 3}
    assert models[2][0].support == "observed_two_point_DB1_DB3" and models[0][0].support == "independent_consensus"
    assert all(not sm.crosses(models[a][0], models[b][0]) for a in models for b in models if a < b)


def test_a_crossing_series_with_less_support_is_left_out():
    rows = family({0: 0.0}, extra=[(1, c, 0.6 * c - 11.5) for c in range(30, 36)])
    models = sm.ordered_family(rows)
    assert 0 in models and 1 not in models


def test_r_squared():
    assert sm.r_squared(np.array([1.0, 2, 3]), np.array([1.0, 2, 3])) == 1 and np.isnan(sm.r_squared(np.array([2.0, 2]), np.array([2.0, 2])))


def test_evaluation_and_ties_to_models(spark):
    rows = [(i, "PC", 1, c, c / 4 + off, 90.0, 1, high) for i, (c, off, high) in enumerate([(30, 0.0, True), (32, 0.0, True), (34, 0.0, True), (36, 0.0, True), (38, 0.0, True), (33, 0.3, False), (35, 0.9, True), (44, 0.0, True), (31, None, True)] ) if off is not None]
    df = spark.createDataFrame([*rows, (50, "PC", 1, 31, None, 90.0, 1, True), (51, "PE", 1, 31, 7.0, 90.0, 1, True)], "ord long, subclass string, total_db long, total_c long, rt double, score double, rank long, high boolean")
    train = df.where("high and ord < 5")
    for models in (retention.ordered_models(train, ["subclass"]), retention.robust_models(train, ["subclass"])):
        got = {r.ord: (r.action, r.consistent) for r in retention.evaluate(df, models, ["subclass"], df.high).collect()}
        assert got[0] == ("high_confidence_pass", True) and got[5] == ("low_confidence_rescued", True) and got[6] == ("reject", False)
        assert got[7][0] == got[50][0] == "outside_domain_or_missing_rt" and got[51] == ("unmodeled", False)


def test_closed_form_equals_the_kernel(spark):
    r = np.random.default_rng(3)
    data = []
    for k in range(12):
        for c in range(28, 28 + 2 + k):
            data.append((k, float(c), float(0.3 * c + (k % 3) * 0.01 * (c - 28) ** 2 + r.normal(0, 0.05))))
    got = {x.k: x for x in retention.curve_fit(spark.createDataFrame(data, "k long, c double, t double"), ["k"], "c", "t").collect()}
    for k in range(12):
        own = np.array([(c, t) for q, c, t in data if q == k])
        kind, coef = sm.fit(own[:, 0], own[:, 1])
        assert got[k].kind == kind and np.allclose([got[k].c0, got[k].c1, got[k].c2 or 0][: len(coef)], coef, atol=1e-5)
        assert got[k].r2 == pytest.approx(sm.r_squared(own[:, 1], np.polyval(coef[::-1], own[:, 0])), abs=1e-9)


def test_ordered_models_send_few_rows_to_a_call_and_equal_the_family(spark):
    r = np.random.default_rng(8)
    rows = []
    for k in range(6):
        # own, observed and borrowed series; copies at the same carbon and time, and many times within one bin
        spread = {0: range(30, 40), 1: range(30, 40), 2: (34, 36), 3: range(30, 40), 4: (35,), 5: (33, 34, 35, 37) if k % 2 else (35,)}
        for db, carbons in spread.items():
            for c in carbons:
                for _ in range(30):
                    rows.append((f"K{k}", db, int(c), float(c / 4 - 0.8 * db + r.choice([0, 0.004, 0.01, 0.2, -0.3, 2.0]) + (0.11 * (c - 33) if db == 5 else 0) * r.integers(0, 2)), float(r.integers(50, 54)) if r.integers(0, 9) else None, int(r.integers(1, 4))))
    order = r.permutation(len(rows)).tolist()
    data = [(i, *rows[j]) for i, j in enumerate(order)]
    names = ["ord", "subclass", "total_db", "total_c", "rt", "score", "rank"]
    want, supports = {}, set()
    for k, g in pd.DataFrame(data, columns=names).groupby("subclass"):
        for db, (curve, points) in sm.ordered_family(g.set_index("ord", drop=False).rename_axis(None)).items():
            supports.add(curve.support.split("_DB")[0])
            want[k, db] = (curve.kind, tuple(curve.coef), curve.low, curve.high, curve.support, list(points.index), int((g.total_db == db).sum()))
    assert supports == {"independent_consensus", "observed_two_point", "neighbor_supported"}
    df = spark.createDataFrame(data, "ord long, subclass string, total_db long, total_c long, rt double, score double, rank long")
    got = retention.ordered_models(df, ["subclass"]).collect()
    assert {(x.subclass, x.total_db): (x.kind, tuple(v for v in (x.c0, x.c1, x.c2) if v is not None), x.carbon_min, x.carbon_max, x.support, x.anchors, x.n_original) for x in got} == want
    plan = retention.ordered_models(df, ["subclass"])._jdf.queryExecution().optimizedPlan().toString()
    # rows meet in a class only after an aggregate by carbon and time
    assert plan.index("FlatMapGroupsInPandas") < plan.index("Aggregate") and plan.count("rint") > 0
