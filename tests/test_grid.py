from __future__ import annotations

import numpy as np

from sonarlake.operators.grid import complete_low_rank, regular_grid

FRAMES = "recording_id string, timestamp_s double, a double, b double, slot long, step string"
RECS = "recording_id string, grid_step_s double"


def test_low_rank_matrix_is_recovered():
    r = np.random.default_rng(1)
    t = np.linspace(0, 3, 64)
    full = np.outer(r.uniform(1, 3, 40), np.sin(t)) + np.outer(r.uniform(-2, 2, 40), np.cos(2 * t)) + r.uniform(10, 90, 40)[:, None]
    m = full.copy()
    m[r.random(m.shape) < 0.25] = np.nan
    got, support = complete_low_rank(m, ridge=0.01, rounds=30)
    gone = np.isnan(m)
    assert support.sum() == gone.sum()
    assert np.abs(got - full)[gone].mean() < 0.1 * full.std(1).mean()
    assert np.array_equal(got[~gone], m[~gone])


def test_cells_without_support_stay_marked():
    m = np.full((3, 5), np.nan)
    m[0, :3] = 1, 2, 3
    m[1, 0] = 5
    got, support = complete_low_rank(m)
    assert not support[1].any() and not support[2].any() and not support[:, 3:].any()
    assert np.isnan(got[~support & np.isnan(m)]).all()


def test_slots_between_first_and_last(spark):
    n = float("nan")
    rows = [
        ("r", 0.2, 1.0, None, 1, "x"), ("r", 0.2, 1.0, None, 1, "x"), ("r", 0.9, 3.0, n, 1, "x"), ("r", 3.0, 5.0, 1.0, 1, "x"), ("r", None, 9.0, 9.0, 1, "x"), ("r", n, 9.0, 9.0, 1, "x"),
        ("r", 5.1, n, None, 1, "x"), ("r", -1.5, None, 2.0, 1, "x"), ("q", 1.0, 1.0, 1.0, 1, "x"), (None, 1.0, 1.0, 1.0, 1, "x"),
    ]
    recs = spark.createDataFrame([("r", 1.0), ("r", 1.0), ("q", None)], RECS)
    got = regular_grid(spark.createDataFrame(rows, FRAMES), recs, ["a", "b"]).collect()
    a = {r.slot: r for r in got if r.metric == "a"}
    assert sorted(a) == [0, 1, 2, 3] and a[0].value == 2.0 and a[0].readings == 2
    assert a[1].state in ("filled", "unsupported") and a[1].readings == 0
    assert sorted(r.slot for r in got if r.metric == "b") == [-2, -1, 0, 1, 2, 3]
    assert {r.recording_id for r in got} == {"r"}


def test_empty(spark):
    empty = spark.createDataFrame([], FRAMES)
    assert regular_grid(empty, spark.createDataFrame([], RECS), ["a"]).count() == 0


def test_long_gap_crosses_blocks(spark):
    rows = [("r", 0.5, 1.0, 1.0, 0, ""), ("r", 500.5, 2.0, 1.0, 0, "")]
    got = regular_grid(spark.createDataFrame(rows, FRAMES), spark.createDataFrame([("r", 1.0)], RECS), ["a"]).collect()
    assert sorted(r.slot for r in got) == list(range(501))
    assert sum(r.readings for r in got) == 2
