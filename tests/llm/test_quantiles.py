from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.llm.quantiles import Sketch, combine, percentiles, read_quantiles, sketches

PS = (0.01, 0.25, 0.5, 0.75, 0.99)


def rank_error(values, found, p):
    s = np.sort(values)
    lo, hi = np.searchsorted(s, found), np.searchsorted(s, found, side="right")
    return max(0.0, lo / len(s) - p, p - hi / len(s))


@pytest.mark.parametrize("kind", ["normal", "sorted", "ties", "tail"])
def test_error_stays_within_the_bound(kind):
    r = np.random.default_rng(3)
    x = {"normal": r.normal(size=40_000), "sorted": np.arange(40_000.0), "ties": r.integers(0, 4, 40_000).astype(float), "tail": r.pareto(1, 40_000)}[kind]
    parts = []
    for part in np.array_split(x, 7):
        s = Sketch(64)
        for piece in np.array_split(part, 5):
            s.add(piece)
        parts.append(s)
    whole = Sketch(64)
    for s in parts:
        whole.merge(*s.row())
    n, err, raw, levels, kept = whole.row()
    assert n == len(x)
    assert len(raw) + sum(64 * 2 ** int(v) for v in levels) == n
    bound = err / n + 2.0 ** max(levels) / n
    assert bound < 0.12
    for p, q in zip(PS, read_quantiles(raw, levels, kept, PS, 64)):
        assert rank_error(x, q, p) <= bound


def test_small_groups_are_exact():
    x = np.array([5.0, 1, 4, 2, 3])
    s = Sketch(16)
    s.add(x)
    n, err, raw, levels, kept = s.row()
    assert err == 0 and np.allclose(read_quantiles(raw, levels, kept, PS, 16), np.quantile(x, PS))
    assert np.isnan(read_quantiles(np.empty(0), [], np.empty(0), PS)).all()


def test_days_combine(spark):
    r = np.random.default_rng(5)
    rows = [("hot" if r.random() < 0.6 else "cold", int(i % 9), float(v), 1, "x") for i, v in enumerate(r.gamma(2, 3, 6000))]
    rows += [("hot", 1, None, 1, "x"), ("hot", 1, float("nan"), 1, "x"), (None, 1, 3.0, 1, "x"), ("hot", 1, float("inf"), 1, "x"), ("lonely", 0, 7.0, 1, "x")]
    df = spark.createDataFrame(rows, "m string, day int, v double, n int, raw string").repartition(6)
    days = sketches(df, ["m", "day"], "v", k=128)
    assert days.count() == 19
    for made in (combine(days, ["m"], k=128), sketches(df, ["m"], "v", k=128)):
        got = {x.m: x for x in percentiles(made, ["m"], PS, k=128).collect()}
        assert set(got) == {"hot", "cold", "lonely"}
        for m in ("hot", "cold"):
            v = np.array([x[2] for x in rows[:6000] if x[0] == m])
            assert got[m].n == len(v) and got[m].rank_error < 0.1
            for p, q in zip(PS, got[m].q):
                assert rank_error(v, q, p) <= got[m].rank_error + 1 / len(v)
        assert got["lonely"].q == [7.0] * 5 and got["lonely"].rank_error == 0
    assert sketches(df.limit(0), ["m"], "v").count() == 0


def test_many_partitions_merge_in_rounds(spark):
    df = spark.range(0, 8000, 1, 130).select(F.lit("a").alias("m"), F.col("id").cast("double").alias("v"))
    x = percentiles(sketches(df, ["m"], "v", k=32), ["m"], (0.5,), k=32).first()
    assert x.n == 8000 and abs(x.q[0] - 4000) <= x.rank_error * 8000
