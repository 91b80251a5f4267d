from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sonarlake.operators.intervals import label_intervals, merge_intervals, moment_periods


def sequential(rows):
    """Periods and gaps by one walk over sorted intervals."""
    out, by = [], {}
    for k, s, e, g in rows:
        if None not in (k, s, e) and e >= s:
            by.setdefault(k, []).append((s, e, g or 0))
    for k, v in by.items():
        v.sort()
        start, end = v[0][:2]
        for s, e, g in v[1:]:
            if s <= end + g:
                end = max(end, e)
            else:
                out += [(k, "period", start, end), (k, "gap", end, s)]
                start, end = s, e
        out.append((k, "period", start, end))
    return sorted(out)


SCHEMA = "k string, s long, e long, g long, entity string, pid int"


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, True)])
def test_random_against_walk(spark, seed, hot):
    r = random.Random(seed)
    rows = []
    for _ in range(1500):
        k = "hot" if hot and r.random() < 0.7 else r.choice("abc")
        s = r.randrange(40_000)
        rows.append((k, s, s + r.choice([0, 1, 5, 30, 4000 if r.random() < 0.02 else 9]), 3, "x", 7))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, merge_intervals(df, "k", "s", "e", "g").collect()))
    want = sequential([x[:4] for x in rows])
    assert got == want
    periods = {(k, s): e for k, kind, s, e in want if kind == "period"}
    labelled = label_intervals(df.withColumnRenamed("s", "a").withColumnRenamed("e", "b"), "k", "a", "b", "g", []).collect()
    assert len(labelled) == len(rows)
    assert all(x.island_start <= x.a <= x.b <= periods[(x.k, x.island_start)] for x in labelled)


def test_one_period_over_all_partitions(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") * 2).alias("s"), F.when(F.col("id") == 0, 10_000).otherwise(F.col("id") * 2).alias("e"), F.lit(0).alias("g"))
    assert [tuple(r) for r in merge_intervals(df, "k", "s", "e", "g").collect() if r.s == 0] == [("k", "period", 0, 10_000)]


def test_odd_rows_and_empty(spark):
    rows = [(None, 1, 2, 0, None, None), ("a", None, 2, 0, "", 1), ("a", 5, 4, 0, "", 1), ("a", 7, 7, None, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in merge_intervals(df, "k", "s", "e", "g").collect()] == [("a", "period", 7, 7)]
    assert merge_intervals(df.limit(0), "k", "s", "e", "g").count() == 0
    assert label_intervals(df.limit(0).withColumnRenamed("s", "t"), "k", "t", "e", "g", []).count() == 0


def test_moments_take_missing_times_from_elsewhere(spark):
    cols = "recording_id string, project string, start_s double, end_s double, start_hms string, end_hms string, duration_s double, gap_ms long"
    rows = [
        ("r", "p", None, 5.0, "00:00:01.500", None, None, 1), ("r", "p", 7.0, None, None, "00:00:08.000", 99.0, 1), ("r", "p", 20.0, None, None, "bad", 2.5, 1),
        ("r", "p", 30.0, None, None, None, None, 1), ("r", None, float("nan"), 41.0, "00:00:40.000", None, None, 1),
    ]
    config = spark.createDataFrame([("p", 2.0), (None, 9.0)], "project string, merge_gap_s double")
    got = sorted(map(tuple, moment_periods(spark.createDataFrame(rows, cols), config).collect()))
    assert [g[2:] for g in got if g[1] == "period"] == [(1500, 8000), (20000, 22500), (40000, 41000)]
    assert [g[2:] for g in got if g[1] == "gap"] == [(8000, 20000), (22500, 40000)]
