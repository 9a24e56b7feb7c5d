"""Series operators against plain versions."""

import random

import numpy as np

from spectralake.operators import series


def test_noise_of_signal_profiles(spark):
    r = random.Random(4)
    groups = {"long": [r.uniform(-5, 400) for _ in range(60)], "short": [300.0, 5.0, 310.0, 90.0, 320.0, 330.0, 1.0], "flat": [7.0] * 8}
    groups["steps"] = [float(r.randint(0, 60)) for _ in range(40)] + [500.0] * 160
    want = {}
    for g, x in groups.items():
        v = np.maximum(x, 0)
        low = v <= np.quantile(v, 0.2)
        d = np.diff(v)[low[:-1] & low[1:]]
        spread = np.median(np.abs(d - np.median(d))) / 2**0.5 if len(d) >= 3 else np.median(np.abs(v[low] - np.median(v[low])))
        want[g] = max(1.0, 1.4826 * spread)
    df = spark.createDataFrame([(g, i, float(i), v) for g, x in groups.items() for i, v in enumerate(x)], "g string, i long, t double, v double")
    got = {x.g: x.noise for x in series.signal_profile(df, ["g"], ["t", "i"], "t", "v").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[g], want[g]) for g in want) and want["steps"] > 1
