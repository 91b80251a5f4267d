from __future__ import annotations

import numpy as np

from sonarlake.operators.percentiles import exact_percentiles


def test_hot_group_over_partitions(spark):
    r = np.random.default_rng(1)
    rows = [("hot" if r.random() < 0.7 else f"k{int(r.integers(5))}", float(v), 3, 1) for v in np.r_[r.normal(size=4000), r.integers(0, 3, 2000)]]
    odd = [("hot", None, 3, 1), ("hot", float("nan"), 3, 1), ("hot", float("inf"), 3, 1), (None, 1.0, 3, 1), ("one", 7.0, 3, 1)]
    df = spark.createDataFrame(rows + odd, "k string, x double, pid int, n int")
    got = {g.k: g for g in exact_percentiles(df, ["k"], "x", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == {k for k, *_ in rows} | {"one"}
    for k, g in got.items():
        v = [x for a, x, *_ in rows if a == k] or [7.0]
        assert g.n == len(v) and np.allclose([g.p00, g.p50, g.p95, g.p100], np.quantile(v, [0, 0.5, 0.95, 1]))
    assert exact_percentiles(df.limit(0), ["k"], "x", (0.5,)).count() == 0
