from __future__ import annotations

import math

import numpy as np
import pytest

from sonarlake.functions import dsp
from sonarlake.operators.frames import framed, peaks_in_blocks, running_total, with_previous
from sonarlake.operators.metrics import METRICS, Metric, Source, analyze, metric_names, register, summary
from sonarlake.sources.signals import Settings

COLS = "recording_id string, channel int, n long, x double"


def source(spark, channels, rate, **settings):
    rows = [("r", c, n, float(v)) for c, x in enumerate(channels) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, COLS).repartition(4).cache()
    return Source(lambda k: df if k == len(channels) or k > 1 else df.where("channel = 0"), lambda: df, Settings(rate=rate, **settings))


def value(src, name):
    return summary(src, name).first()


def test_catalog():
    assert len(METRICS) == 74 and metric_names() == sorted(METRICS)
    with pytest.raises(KeyError):
        metric_names(["none"])
    with pytest.raises(ValueError):
        register(Metric("rms_dbfs", "Basic", "dB", lambda s: s.mono))


def test_tone(spark):
    t = np.arange(16000) / 8000
    s = source(spark, [0.5 * np.sin(2 * np.pi * 1000 * t)], 8000, frame=800, hop=800, spl_offset=0.0)
    assert abs(value(s, "rms_dbfs").mean - -9.030899869919436) < 0.01
    assert abs(value(s, "peak_dbfs").mean - -6.020599913279624) < 0.01
    assert abs(value(s, "crest_factor_db").mean - 3.010299956639812) < 0.01
    assert abs(value(s, "dc_offset").mean) < 1e-6
    assert abs(value(s, "spectral_centroid_hz").mean - 1000) < 30
    assert value(s, "clipping_ratio").mean == 0 and value(s, "uptime_ratio").mean == 1
    assert value(s, "ndsi").mean < -0.9


def test_loudness_of_a_tone(spark):
    t = np.arange(48000) / 48000
    s = source(spark, [0.1 * np.sin(2 * np.pi * 1000 * t)], 48000)
    assert abs(value(s, "integrated_lufs").mean - -23.00374543450133) < 0.05
    assert value(s, "loudness_range_lu").mean <= 0.5
    assert abs(value(s, "true_peak_dbfs").mean - -20) < 0.1


def test_decay_of_a_room(spark):
    rate = 8000
    t = np.arange(3 * rate) / rate
    s = source(spark, [0.99 * np.exp(-t / 0.3) * np.cos(2 * np.pi * 400 * t)], rate)
    for name in ("rt60_s", "edt_s", "t20_s", "t30_s"):
        assert abs(value(s, name).mean - 2.072326583694641) < 0.05
    e = np.exp(-2 * 0.05 / 0.3)
    assert abs(value(s, "d50").mean - (1 - e)) < 0.02
    assert 0 <= value(s, "sti_proxy").mean <= 1
    assert math.isfinite(value(s, "bass_ratio").mean) or value(s, "bass_ratio").n == 0


def test_stereo(spark):
    rate = 8000
    t = np.arange(4000) / rate
    x = 0.2 * np.sin(2 * np.pi * 400 * t) + 0.05 * np.random.default_rng(1).normal(size=4000)
    s = source(spark, [x, 2 * np.roll(x, 2)], rate)
    assert abs(value(s, "ild_db").mean - -20 * math.log10(2)) < 0.1
    assert value(s, "iacc").mean > 0.95
    assert abs(value(s, "itd_s").p50 - -2 / rate) < 1e-9
    assert 0 <= value(s, "lf_ratio").mean <= 1 and 0 <= value(s, "lfc_ratio").mean <= 1


def test_every_metric_runs(spark):
    r = np.random.default_rng(0)
    x = [r.normal(0, 0.1, 2000) for _ in range(4)]
    rows = analyze(source(spark, x, 8000)).collect()
    assert len(rows) == 74 and len({r.metric for r in rows}) == 74


@pytest.mark.parametrize("n,size,hop", [(10, 4, 3), (11, 4, 3), (4, 4, 2), (100, 16, 16), (103, 16, 5)])
def test_frames(spark, n, size, hop):
    df = spark.createDataFrame([("r", 0, i, 1.0) for i in range(n)], COLS)
    got = {r.frame: (r.lo, r.hi) for r in framed(df, size, hop).groupBy("frame").agg({"n": "min"}).withColumnRenamed("min(n)", "lo").join(framed(df, size, hop).groupBy("frame").agg({"n": "max"}).withColumnRenamed("max(n)", "hi"), "frame").collect()}
    starts = list(range(0, n - size + 1, hop)) + ([n - size] if (n - size) % hop else [])
    assert got == {i: (s, s + size - 1) for i, s in enumerate(starts)}


def test_blocks_hide_no_neighbours(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(100)], "k string, n long, x double")
    prev = {r.n: r.b for r in with_previous(df, ["k"], "n", {"x": "b"}, block=7).collect()}
    assert prev[0] is None and all(prev[i] == i - 1 for i in range(1, 100)) and len(prev) == 100
    back = {r.n: r.s for r in running_total(df, ["k"], "n", "x", "s", backward=True, block=9).collect()}
    assert all(back[i] == sum(range(i, 100)) for i in range(100))


def test_filters_and_peaks():
    x = np.zeros(200)
    x[0] = 1
    direct = dsp.recurrence(*dsp.K_HIGHPASS, dsp.recurrence(*dsp.K_SHELF, np.sin(np.arange(2000) / 9)))
    assert np.abs(dsp.fir(np.sin(np.arange(2000) / 9), dsp.k_taps()) - direct).max() < 1e-6
    at, height = dsp.peaks(np.array([0, 3, 0, 1, 1, 0, 5, 4, 6, 0.0]), 1, 0.5)
    assert at.tolist() == [1, 3, 6, 8] and height.tolist() == [3, 1, 1, 6]
    b, a = dsp.butter_bandpass(0.1, 0.3)
    x = np.sin(np.pi * 0.2 * np.arange(400))
    assert np.abs(dsp.zero_phase(b, a, x) - x)[100:300].max() < 0.02
    z = dsp.zero_phase(b, a, np.sin(np.pi * 0.6 * np.arange(400)))
    assert np.abs(z[100:300]).max() < 0.01
    up = dsp.resample(np.sin(np.arange(300) / 7), 8000, 12000)
    assert len(up) == 450 and np.abs(up[60:380] - np.sin(np.arange(450) / 7 / 1.5)[60:380]).max() < 0.01
    w = dsp.mel_weights(8000, 64, 16)
    assert w.shape == (16, 33) and (w.sum(1) > 0).all()


def test_peaks_in_blocks(spark):
    x = np.random.default_rng(6).normal(size=900).cumsum()
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "k string, n long, x double")
    at, height = dsp.peaks(x, 3, 2.0)
    whole = {r.n: r.prominence for r in peaks_in_blocks(df, ["k"], "n", "x", 3, 2.0).collect()}
    assert whole == dict(zip(at.tolist(), height.tolist()))
    cut = {r.n: r.prominence for r in peaks_in_blocks(df, ["k"], "n", "x", 3, 2.0, block=300, margin=290).collect()}
    assert len(set(at) - set(cut)) <= 0.1 * len(at) and len(set(cut) - set(at)) <= 1
