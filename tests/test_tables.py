from __future__ import annotations

import datetime as dt
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.functions.provenance import canonical, config_hash, documents, pipeline_hash
from sonarlake.operators import reports, rules
from sonarlake.operators.similarity import band_similarity, novelty
from sonarlake.sources.signals import Settings
from sonarlake.sources.recordings import audio_files as wav_files
from sonarlake.sources.recordings import recordings as wav_recordings
from sonarlake.sources.recordings import samples as wav_signal
from sonarlake.sources.wav import clip_files, decode, encode
from sonarlake.streaming.chunks import alert_rows, moments, run_available, windowed_means


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_round_trip(bits):
    x = np.random.default_rng(bits).uniform(-1, 0.99, (101, 3))
    y, rate = decode(encode(x, 8000, bits))
    assert rate == 8000 and np.abs(y - x).max() < 2.0 ** (1 - bits)


def test_wav_folder(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (500, 2))
    (tmp_path / "a.wav").write_bytes(encode(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"RIFF broken")
    (tmp_path / "empty.wav").write_bytes(encode(np.zeros((0, 1)).reshape(0, 1), 8000))
    files = wav_files(spark, str(tmp_path))
    meta = {r.recording_id.rsplit("/", 1)[1]: r for r in wav_recordings(files).collect()}
    assert meta["a.wav"].num_samples == 500 and meta["a.wav"].layout == "stereo" and meta["b.wav"].error and meta["empty.wav"].num_samples == 0
    s = wav_signal(files)
    assert s.count() == 1000 and s.where("channel = 1").agg(F.max("n")).first()[0] == 499
    assert wav_signal(files, 16000).count() == 2000
    clip = clip_files(s.where("n < 50").withColumn("clip_id", F.lit(7)), 8000).first()
    assert np.abs(decode(clip.wav)[0] - x[:50]).max() < 1e-6


def test_alerts_ignore_nan(spark):
    m = spark.createDataFrame([("r", 0, "m", math.nan), ("r", 1, "m", 5.0), ("r", 2, "m", 0.0), ("r", 3, "k", 9.0)], "recording_id string, chunk_index long, metric string, mean double")
    lim = spark.createDataFrame([("m", 1.0, 4.0)], "metric string, min double, max double")
    assert sorted((r.chunk_index, r.condition) for r in rules.alerts(m, lim).collect()) == [(1, "max"), (2, "min")]


def test_validation(spark):
    files = spark.createDataFrame([("a",), ("b",), ("a",)], "recording_id string")
    vals = spark.createDataFrame([("a", "m", 5.0), ("b", "m", math.nan)], "recording_id string, name string, value double")
    got = {(r.recording_id, r.name): (r.status, r.message) for r in rules.validation(files, vals, [("m", 6.0, None), ("n", None, 1.0)]).collect()}
    assert got == {("a", "m"): ("fail", "below min"), ("b", "m"): ("pass", ""), ("a", "n"): ("fail", "metric missing"), ("b", "n"): ("fail", "metric missing")}
    strict = rules.validation(files, vals, [("m", None, None)], nan_fails=True)
    assert {r.recording_id: r.status for r in rules.file_status(strict).collect()} == {"a": "pass", "b": "fail"}


def test_moments_of_chunks(spark):
    w = spark.createDataFrame([("r", 0, 0, 1000, 1, 0.2, 0.5), ("r", 1, 900, 2000, 2, 0.9, 1.5), ("r", 2, 9000, 9500, 1, 0.4, 9.2)], "recording_id string, chunk_index long, start_ms long, end_ms long, alerts long, rank_score double, center_s double")
    m = rules.merged(w, 0)
    got = sorted((r.start_ms, r.end_ms, r.alerts, r.chunks, r.rank_score, r.event_center_s) for r in m.collect())
    assert got == [(0, 2000, 3, 2, 0.9, 1.5), (9000, 9500, 1, 1, 0.4, 9.2)]
    assert [r.start_ms for r in rules.best(m, 1).collect()] == [0]


def test_clips(spark):
    s = spark.range(20_000).select(F.lit("r").alias("recording_id"), F.col("id").alias("n"), F.lit(1.0).alias("x"))
    c = spark.createDataFrame([(1, "r", 4000, 4200), (2, "r", 0, 9999), (3, "q", 0, 5)], "clip_id long, recording_id string, first long, last long")
    assert {r.clip_id: r["count"] for r in rules.cut_clips(s, c).groupBy("clip_id").count().collect()} == {1: 201, 2: 10_000}


def test_variants(spark):
    runs = spark.createDataFrame([("p", "A", "rms", -20.0), ("p", "B", "rms", -16.0), ("p", "B", "snr", 1.0), ("p", "A", "zero", 0.0), ("p", "B", "zero", 2.0)], "project string, variant string, metric string, value double")
    got = {(r.variant, r.metric): (r.delta, r.delta_pct) for r in reports.compare_variants(runs).collect()}
    assert got[("B", "rms")] == (4.0, 20.0) and got[("B", "snr")] == (None, None) and got[("B", "zero")] == (2.0, None)


def test_novelty_between_two_sections(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=8), r.normal(size=8)
    v = spark.createDataFrame([(i, [float(x) for x in (a if i < 30 else b) + r.normal(0, 0.05, 8)]) for i in range(60)], "i long, v array<double>")
    rows = {x.frame: x.novelty for x in novelty(v, 16).collect()}
    assert len(rows) == 60 and max(rows, key=rows.get) in (29, 30) and rows[0] == 0
    assert band_similarity(v, 3).count() == 60 * 7 - 12


def test_hashes(spark):
    assert canonical({"b": 1, "a": [1, None]}) == '{"a":[1,null],"b":1}'
    assert config_hash(Settings()) == config_hash(Settings()) != config_hash(Settings(rate=1))
    assert pipeline_hash(Settings(), ["b", "a"]) == pipeline_hash(Settings(), ["a", "b"])
    row = spark.createDataFrame([("r", "m", "dB", 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "recording_id string, metric string, units string, confidence double, mean double, std double, min double, max double, p50 double, p95 double")
    doc = json.loads(documents(row, Settings()).first().document)
    assert doc["metrics"]["m"]["summary"]["mean"] == 1.0 and len(doc["config_hash"]) == 64


def _stream(spark, tmp_path, rows):
    schema = "source string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=i), float(i % 50)) for i in range(300)] + [("a", t0, math.nan), ("b", t0, None)]
    s = _stream(spark, tmp_path, rows)
    want = sorted(map(tuple, alert_rows(windowed_means(spark.createDataFrame(rows, "source string, ts timestamp, value double"), 20), 12.0, 35.0).collect()))
    got = sorted(map(tuple, alert_rows(run_available(windowed_means(s, 20), ["source", "start"]), 12.0, 35.0).collect()))
    assert got == want and want


def test_stream_of_moments(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    schema = "source string, ts timestamp, value double"
    for part in ([8, 0, 100], [103, 5], [5000]):  # files are read in the order of their times; the last one moves the watermark on
        rows = [("a", t0 + dt.timedelta(seconds=i), 1.0) for i in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.end_s - r.start_s, r.events) for r in run_available(moments(s, 10.0, "1 hour")).collect())
    assert got == [(3.0, 2), (8.0, 3)]


def test_state_goes_from_chunk_to_chunk(spark, tmp_path):
    from sonarlake.streaming.chunks import chunk_levels

    x = np.random.default_rng(5).normal(size=1000)
    for i in range(0, 1000, 250):
        spark.createDataFrame([("r", i, x[i : i + 250].tolist()), ("s", i, [1.0, -1.0])], "source string, first long, x array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("source string, first long, x array<double>").parquet(str(tmp_path / "in"))
    rows = run_available(chunk_levels(s)).where("source = 'r'").collect()
    assert sum(r.n for r in rows) == 1000 and abs(sum(r.energy for r in rows) - (x * x).sum()) < 1e-9
    assert sum(r.crossings for r in rows) == int(((x[1:] < 0) != (x[:-1] < 0)).sum())
