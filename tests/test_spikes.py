from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.operators import spikes
from sonarlake.operators.spikes import implausible, implausible_readings, segments

COLS = "reading_id long, recording_id string, metric string, timestamp_s double, value double, seg int, kind string"
CAT = "metric string, valid_min double, valid_max double, monitored boolean"


def test_kinds_of_one_series():
    r = np.random.default_rng(4)
    y = r.normal(10, 1, 400)
    y[50] += 25
    y[51] -= 30
    y[100:112] = 11.0
    y[200] = 500
    y[250:] += 40  # a lasting change
    y[395:] -= 40  # another one near the end
    kind = implausible(y, -100, 200)
    assert set(np.flatnonzero(kind == "spike")) == {50, 51}
    assert set(np.flatnonzero(kind == "stuck")) == set(range(100, 112))
    assert set(np.flatnonzero(kind == "impossible")) == {200}


def test_drift_and_short_series_have_no_spikes():
    r = np.random.default_rng(5)
    assert not (implausible(np.cumsum(r.normal(0, 1, 500)) + r.normal(0, 1, 500), -1e9, 1e9) != "").any()
    assert not (implausible(np.array([1.0, 99.0, 1.0]), -1e9, 1e9) != "").any()
    assert len(implausible(np.array([]), 0, 1)) == 0


def test_ten_equal_values_are_stuck_nine_are_not():
    y = np.r_[np.arange(8), [3.0] * 9, np.arange(8), [4.5] * 10]
    assert (implausible(y, -9, 99) == "stuck").sum() == 10


def rows(n, rec="r", seed=0):
    r = np.random.default_rng(seed)
    return [(i + seed * 100_000, rec, "m", float(i), float(v), 0, "") for i, v in enumerate(r.normal(0, 1, n))]


def test_readings(spark):
    data = rows(200)
    data[30] = (30, "r", "m", 30.0, 60.0, 0, "")
    data += [data[30], (9001, "r", "m", 31.5, None, 0, ""), (9002, "r", "m", 32.5, float("nan"), 0, ""), (9003, "r", "m", None, 70.0, 0, ""), (9004, "r", "other", 1.0, 1e9, 0, ""), (9005, "r", None, 1.0, 1e9, 0, "")]
    cat = spark.createDataFrame([("m", -100.0, None, True), ("other", 0.0, 1.0, False)], CAT)
    got = implausible_readings(spark.createDataFrame(data, COLS), cat).collect()
    assert [(r.reading_id, r.kind) for r in got] == [(30, "spike")]
    assert implausible_readings(spark.createDataFrame([], COLS), cat).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_long_series_in_segments_gives_the_same(spark, monkeypatch, n):
    data = rows(n, seed=3)
    for i in (5, 499, 500, 501, 1234, 2999):
        data[i] = (*data[i][:4], 80.0 if i % 2 else -70.0, 0, "")
    data[700:712] = [(*x[:4], 0.25, 0, "") for x in data[700:712]]
    df = spark.createDataFrame(data, COLS)
    cat = spark.createDataFrame([("m", None, None, True)], CAT)
    whole = {(r.reading_id, r.kind) for r in implausible_readings(df, cat).collect()}
    monkeypatch.setattr(spikes, "SEGMENT_ROWS", 800)
    parts = segments(df.select("reading_id", "recording_id", "metric", F.col("timestamp_s").alias("ts"), "value"))
    assert parts.select("seg").distinct().count() > 3
    assert parts.where("not margin").count() == n
    cut = {(r.reading_id, r.kind) for r in implausible_readings(df, cat).collect()}
    assert cut == whole and len(whole) >= 17


def test_one_early_reading_still_cuts(spark, monkeypatch):
    monkeypatch.setattr(spikes, "SEGMENT_ROWS", 800)
    data = [(x[0] + 1, x[1], x[2], 1e9 + x[3], *x[4:]) for x in rows(5000, seed=4)] + [(0, "r", "m", 0.0, 0.0, 0, "")]
    parts = segments(spark.createDataFrame(data, COLS).select("reading_id", "recording_id", "metric", F.col("timestamp_s").alias("ts"), "value"))
    sizes = parts.groupBy("seg").count().toPandas()["count"]
    assert len(sizes) >= 6 and sizes.max() <= 1000 and parts.where("not margin").count() == 5001


def test_scatter_is_that_of_the_whole_series(spark, monkeypatch):
    r = np.random.default_rng(8)
    y = np.r_[r.normal(0, 0.2, 2000), r.normal(0, 3, 4000)]
    for i in range(50, 6000, 100):
        y[i] += 20 * r.choice([-1, 1])
    data = [(i, "r", "m", float(i), float(v), 0, "") for i, v in enumerate(y)] + [(i + 7000, "s", "m", float(i), float(v), 0, "") for i, v in enumerate(y[:700])]
    df, cat = spark.createDataFrame(data, COLS), spark.createDataFrame([("m", None, None, True)], CAT)
    whole = {(x.reading_id, x.kind) for x in implausible_readings(df, cat).collect()}
    monkeypatch.setattr(spikes, "SEGMENT_ROWS", 800)
    assert {(x.reading_id, x.kind) for x in implausible_readings(df, cat).collect()} == whole and whole


def test_counts_of_parts_add_up():
    r = np.random.default_rng(3)
    y = np.cumsum(r.normal(0, 0.3, 900)) + r.normal(0, 2, 900)
    whole = spikes.kalman_scatter(y)
    parts: list[list] = [[], []]
    for a in (0, 300, 600):
        low = max(0, a - 10)
        own = np.arange(low, a + 300) >= a
        for lag, cells in enumerate(spikes.differences(y[low : a + 300], own)):
            parts[lag].append(cells)
    assert spikes.counted_scatter(*(np.unique(np.concatenate(p), return_counts=True) for p in parts)) == whole
    assert abs(whole[0] - 2) < 0.4
