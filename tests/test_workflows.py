"""Workflows over files, with signals of known answers."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.__main__ import main
from sonarlake.operators.metrics import analyze, series
from sonarlake.operators.quality import validity_flags
from sonarlake.operators.vectors import feature_vectors
from sonarlake.plans import workflows as w
from sonarlake.plans.pipeline import folder_source
from sonarlake.sources import audio
from sonarlake.sources.recordings import audio_files, layout_hint, recordings
from sonarlake.sources.signals import Settings
from sonarlake.sources.storage import exists, read_json
from sonarlake.sources.wav import encode


def put(folder, name, *channels, rate=48000):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(encode(np.stack(channels, 1), rate, 32))
    return str(folder)


def tone(f, amplitude, rate=48000, seconds=1.0):
    return amplitude * np.sin(2 * np.pi * f * np.arange(int(rate * seconds)) / rate)


def means(spark, folder, settings, *metrics):
    rows = analyze(folder_source(audio_files(spark, folder), settings), list(metrics)).collect()
    return {(r.recording_id.rsplit("/", 1)[1], r.metric): r for r in rows}


def test_levels_of_all_channels(spark, tmp_path):
    a, b = tone(440, 0.1), tone(440, 0.4)
    put(tmp_path / "x", "two.wav", a, b)
    put(tmp_path / "x", "opposite.wav", tone(1000, 0.5), -tone(1000, 0.5))
    put(tmp_path / "x", "one.wav", tone(1000, 0.5))
    got = means(spark, str(tmp_path / "x"), Settings.framed(48000, 4800, 4800, spl_offset=0.0), "rms_dbfs", "peak_dbfs", "spl_z_db", "integrated_lufs", "interchannel_coherence", "iacc", "ild_db", "ambisonic_diffuseness", "lf_ratio", "lpeak_dbfs")
    joint = 20 * np.log10(np.sqrt((np.mean(a**2) + np.mean(b**2)) / 2))
    assert abs(got["two.wav", "rms_dbfs"].mean - joint) < 1e-6
    assert abs(got["two.wav", "spl_z_db"].mean - 20 * np.log10((np.sqrt(np.mean(a**2)) + np.sqrt(np.mean(b**2))) / 2)) < 1e-6
    assert abs(got["opposite.wav", "rms_dbfs"].mean - -9.0309) < 1e-3 and abs(got["opposite.wav", "peak_dbfs"].mean - -6.0206) < 1e-3
    # 0.5 in both of two channels: 3 dB above one of them
    assert abs(got["opposite.wav", "integrated_lufs"].mean - got["one.wav", "integrated_lufs"].mean - 3.0103) < 1e-3
    assert got["one.wav", "interchannel_coherence"].mean == 1.0 and abs(got["opposite.wav", "interchannel_coherence"].mean + 1) < 1e-6
    assert abs(got["one.wav", "iacc"].mean - 1) < 1e-6 and abs(got["one.wav", "ild_db"].mean) < 1e-9
    none = got["one.wav", "ambisonic_diffuseness"]
    assert none.n == 0 and none.mean is None and none.confidence == 0.2 and got["one.wav", "lf_ratio"].confidence == 0.2


@pytest.mark.parametrize("rate", [16000, 44100, 48000])
def test_loudness_follows_the_rate(spark, tmp_path, rate):
    put(tmp_path / "x", "a.wav", tone(1000, 0.1, rate), rate=rate)
    got = means(spark, str(tmp_path / "x"), Settings.framed(rate, 2048, 512), "integrated_lufs", "true_peak_dbfs")
    assert abs(got["a.wav", "integrated_lufs"].mean - -23.0037) < 0.1 and abs(got["a.wav", "true_peak_dbfs"].mean - -20) < 0.1


def test_transforms_follow_the_frames(spark, tmp_path):
    put(tmp_path / "x", "a.wav", tone(500, 0.3))
    s = Settings.framed(48000, 2048, 512)
    got = means(spark, str(tmp_path / "x"), s, "spectral_centroid_hz", "octave_band_level_db")
    assert abs(got["a.wav", "spectral_centroid_hz"].mean - 500) < 15
    put(tmp_path / "y", "short.wav", tone(500, 0.3, seconds=0.02))
    short = means(spark, str(tmp_path / "y"), s, "spectral_centroid_hz", "rms_dbfs")
    assert short["short.wav", "spectral_centroid_hz"].n == 1 and short["short.wav", "rms_dbfs"].n == 1


@pytest.mark.parametrize("a, b, sign", [(0.05, 0.25, 1), (0.25, 0.05, -1), (0.15, 0.15, 0)])
def test_band_pairs(spark, tmp_path, a, b, sign):
    put(tmp_path / "x", "a.wav", tone(1500, a) + tone(4000, b))
    v = means(spark, str(tmp_path / "x"), Settings.framed(48000, 2048, 512), "ndsi")["a.wav", "ndsi"].mean
    assert v > 0.2 if sign > 0 else v < -0.2 if sign < 0 else abs(v) < 0.2


def test_flags(spark, tmp_path):
    put(tmp_path / "x", "clipped.wav", np.clip(tone(440, 1.2), -1, 1))
    t = np.arange(3 * 48000) / 48000
    put(tmp_path / "x", "decay.wav", 0.99 * np.exp(-t / 0.3) * np.cos(2 * np.pi * 400 * t))
    noisy = 0.03 * np.random.default_rng(123).normal(size=96000)
    noisy[0] = 0.95
    put(tmp_path / "x", "noisy.wav", noisy)
    got = {r.recording_id.rsplit("/", 1)[1]: r for r in validity_flags(folder_source(audio_files(spark, str(tmp_path / "x")), Settings.framed(48000, 2048, 512))).collect()}
    assert got["clipped.wav"].clipping and not got["decay.wav"].clipping
    assert got["decay.wav"].ir_detected and not got["decay.wav"].ir_tail_low_snr
    assert got["noisy.wav"].ir_tail_low_snr


def test_analysis_and_project(spark, tmp_path):
    put(tmp_path / "x", "site_20240301_213000.wav", tone(440, 0.2, 16000), rate=16000)
    (tmp_path / "x" / "bad.wav").write_bytes(b"RIFF")
    args = ["--rate", "16000", "--frame-size", "1600", "--hop-size", "800", "--metrics", "rms_dbfs,spectral_centroid_hz,diurnal_coverage_ratio"]
    assert main(["analyze", str(tmp_path / "x"), str(tmp_path / "a"), *args, "--project", "p", "--variant", "A", "--project-root", str(tmp_path / "p")]) == 0
    doc = json.loads(spark.read.text(str(tmp_path / "a" / "documents")).first().value)
    m = doc["metrics"]["rms_dbfs"]
    assert doc["metadata"]["sample_rate"] == 16000 and doc["metadata"]["frame_size"] == 1600 and not doc["metadata"]["validity_flags"]["clipping"]
    assert len(m["series"]) == len(m["timestamps_s"]) == 19 and m["timestamps_s"][1] == 0.05 and m["spec"]["category"] == "Basic"
    assert abs(doc["metrics"]["diurnal_coverage_ratio"]["summary"]["mean"] - 1 / 24) < 1e-9
    put(tmp_path / "y", "b.wav", tone(440, 0.4, 16000), rate=16000)
    assert main(["analyze", str(tmp_path / "y"), str(tmp_path / "b"), *args, "--no-series", "--project", "p", "--variant", "B", "--project-root", str(tmp_path / "p")]) == 0
    rows = {(r.variant, r.metric): r for r in w.compare_project(spark, str(tmp_path / "p"), "p").collect()}
    assert abs(rows["B", "rms_dbfs"].delta - 20 * np.log10(2)) < 1e-6 and rows["A", "rms_dbfs"].delta == 0 and rows["B", "rms_dbfs"].baseline_variant == "A"
    assert w.compare_project(spark, str(tmp_path / "p"), "p", "B", ["rms_dbfs"]).count() == 2
    assert main(["project", str(tmp_path / "p"), "p", "--baseline", "none"]) == 1 and main(["project", str(tmp_path / "q"), "p"]) == 1
    assert main(["batch", str(tmp_path / "x"), str(tmp_path / "c"), *args]) == 0 and spark.read.option("header", True).csv(str(tmp_path / "c" / "index")).count() == 1


def test_validation_of_a_folder(spark, tmp_path):
    put(tmp_path / "x", "clean.wav", tone(440, 0.1, 16000), rate=16000)
    put(tmp_path / "x", "clipped.wav", np.clip(tone(440, 1.3, 16000), -1, 1), rate=16000)
    (tmp_path / "rules.json").write_text(json.dumps({"metric_thresholds": {"rms_dbfs": {"max": -10}, "unknown": {"min": 0}}, "validity_flags": {"clipping": False}}))
    assert main(["validate", str(tmp_path / "x"), str(tmp_path / "rules.json"), "--out", str(tmp_path / "v"), "--rate", "16000"]) == 2
    rows = {(r.file.rsplit("/", 1)[1], r.name): r.status for r in spark.read.option("header", True).csv(str(tmp_path / "v" / "checks")).collect()}
    assert rows == {("clean.wav", "rms_dbfs"): "pass", ("clean.wav", "unknown"): "fail", ("clean.wav", "clipping"): "pass", ("clipped.wav", "rms_dbfs"): "fail", ("clipped.wav", "unknown"): "fail", ("clipped.wav", "clipping"): "fail"}
    assert read_json(spark, str(tmp_path / "v" / "report.json"))["files_failed"] == 2 and exists(spark, str(tmp_path / "v" / "checks"))
    (tmp_path / "ok.json").write_text(json.dumps({"metric_thresholds": {"rms_dbfs": {"max": 0}}}))
    assert main(["validate", str(tmp_path / "x"), str(tmp_path / "ok.json"), "--out", str(tmp_path / "w"), "--rate", "16000"]) == 0


def chunk_rows(spark, scores):
    chunks = spark.createDataFrame([("r", i, float(i), i + 1.0, {"novelty_curve": v}) for i, v in enumerate(scores)], "recording_id string, chunk_index long, start_s double, end_s double, metric_means map<string,double>")
    found = spark.createDataFrame([("r", i, "rms_dbfs", -9.0) for i in range(len(scores))], "recording_id string, chunk_index long, metric string, value double")
    return chunks, found, spark.createDataFrame([("r", float(len(scores)))], "recording_id string, duration_s double")


def test_ranked_moments(spark):
    one = w.moments(*chunk_rows(spark, [0.2, 0.9, 0.4]), w.Moments(merge_gap_s=0, selection_mode="single", window_before_s=0.2, window_after_s=0.3)).collect()
    assert [(r.start_s, r.end_s, r.rank_score, r.chunk_indices, r.metrics) for r in one] == [(1.3, 1.8, 0.9, [1], ["rms_dbfs"])]
    assert one[0].start_hms == "00:00:01.300"
    many = chunk_rows(spark, [0.1, 0.7, 0.4])
    apart = w.Moments(merge_gap_s=0, window_before_s=0.1, window_after_s=0.1)
    assert w.moments(*many, apart).count() == 3
    import dataclasses

    assert sorted(r.rank_score for r in w.moments(*many, dataclasses.replace(apart, selection_mode="top_k", top_k=2)).collect()) == [0.4, 0.7]
    assert [r.rank_score for r in w.moments(*many, dataclasses.replace(apart, max_clips=1)).collect()] == [0.7]
    whole = w.moments(*many, w.Moments(event_window_s=2.0)).collect()
    assert [(r.start_s, r.end_s, r.alerts, r.chunk_indices) for r in whole] == [(0.0, 3.0, 3, [0, 1, 2])]
    assert w.moments(*many, w.Moments(min_alerts_per_chunk=2)).count() == 0


def test_moments_of_a_folder(spark, tmp_path):
    put(tmp_path / "x", "a.wav", np.r_[tone(220, 0.05, 16000), tone(220, 0.8, 16000)], rate=16000)
    (tmp_path / "rules.json").write_text(json.dumps({"metric_thresholds": {"rms_dbfs": {"max": -14}}}))
    args = ["--rate", "16000", "--chunk-size", "8000", "--frame-size", "1600", "--hop-size", "800"]
    assert main(["moments", str(tmp_path / "x"), str(tmp_path / "rules.json"), str(tmp_path / "m"), *args, "--pre-roll", "0.25", "--post-roll", "0.25", "--merge-gap", "0.1", "--rank-metric", "rms_dbfs"]) == 0
    row = spark.read.option("header", True).csv(str(tmp_path / "m" / "moments")).first()
    assert (row.start_s, row.end_s, row.alerts, row.chunk_indices) == ("0.75", "2.0", "2", "2;3")
    clip = spark.read.parquet(str(tmp_path / "m" / "clips")).first()
    x, rate = audio.decode_wav(bytes(clip.wav))
    assert rate == 16000 and len(x) == 20000 and np.abs(x).max() > 0.7
    assert main(["stream", str(tmp_path / "x"), str(tmp_path / "rules.json"), str(tmp_path / "s"), *args, "--max-chunks", "3"]) == 0
    assert spark.read.parquet(str(tmp_path / "s" / "chunks")).count() == 3 and spark.read.parquet(str(tmp_path / "s" / "alerts")).count() == 1


def test_space_calibration_and_vectors(spark, tmp_path):
    x = tone(400, 0.2, 16000)
    put(tmp_path / "x", "a.wav", x, np.roll(x, 2), rate=16000)
    (tmp_path / "array.json").write_text('{"mic_spacing_m": 0.18}')
    assert main(["spatial", str(tmp_path / "x"), str(tmp_path / "s"), "--rate", "16000", "--array", str(tmp_path / "array.json"), "--metrics", ""]) == 0
    beam = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "s" / "beam"))
    assert beam.agg(F.max("score")).first()[0] == 1.0 and beam.count() == 37
    put(tmp_path / "t", "tone.wav", tone(1000, 0.1 * 2**0.5))
    assert main(["calibrate", str(tmp_path / "t")]) == 0
    put(tmp_path / "t2", "tone.wav", tone(1000, 0.2 * 2**0.5))
    assert main(["calibrate", str(tmp_path / "t2")]) == 2
    v = feature_vectors(folder_source(audio_files(spark, str(tmp_path / "x")), Settings.framed(16000, 1024, 256)))
    assert v.count() == (16000 - 1024) // 256 + 1 and len(v.first().matrix) == 71 == len(v.first().feature_names)
    assert main(["ingest", str(tmp_path / "x"), str(tmp_path / "i")]) == 0 and spark.read.parquet(str(tmp_path / "i")).first().channels == 2


def test_series_times(spark, tmp_path):
    put(tmp_path / "x", "a.wav", tone(440, 0.2, 16000, 1.03), rate=16000)
    rows = series(folder_source(audio_files(spark, str(tmp_path / "x")), Settings.framed(16000, 1600, 1600)), ["rms_dbfs", "momentary_lufs", "snr_db", "novelty_curve"])
    at = {m: [r.timestamp_s for r in rows.where(F.col("metric") == m).orderBy("timestamp_s").collect()] for m in ("rms_dbfs", "momentary_lufs", "snr_db", "novelty_curve")}
    assert at["rms_dbfs"][:2] == [0.0, 0.1] and abs(at["rms_dbfs"][-1] - 0.93) < 1e-9 and len(at["rms_dbfs"]) == 11
    assert abs(at["momentary_lufs"][0] - 0.2) < 1e-9 and at["snr_db"] == [0.0] and at["novelty_curve"][0] == 0.05


def test_kinds_of_files(spark, tmp_path):
    import struct

    x = np.round(np.stack([tone(440, 0.5, 8000, 0.1), tone(660, 0.25, 8000, 0.1)], 1) * 32767).astype(int)
    body = x.astype(">i2").tobytes()
    mantissa = 8000 << (63 - 12)
    comm = struct.pack(">hIh", 2, len(x), 16) + struct.pack(">HQ", 16383 + 12, mantissa)
    inner = b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(body) + 8) + b"\0" * 8 + body
    got, rate = audio.decode("a.aiff", b"FORM" + struct.pack(">I", len(inner)) + inner)
    assert rate == 8000 and np.array_equal(np.round(got * 32768), x)
    desc = struct.pack(">d4sIIIII", 8000.0, b"lpcm", 2, 4, 1, 2, 16)
    caf = b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", 32) + desc + b"data" + struct.pack(">q", -1) + b"\0" * 4 + x.astype("<i2").tobytes()
    got, rate = audio.decode("a.caf", caf)
    assert rate == 8000 and np.array_equal(np.round(got * 32768), x)
    for name in ("a.aiff", "a.caf", "a.wav", "a.flac", "a.sofa"):
        with pytest.raises(ValueError):
            audio.decode(name, b"nothing")
    (tmp_path / "a.caf").write_bytes(caf)
    (tmp_path / "b.flac").write_bytes(b"fLaC")
    rows = {r.recording_id.rsplit("/", 1)[1]: r for r in recordings(audio_files(spark, str(tmp_path))).collect()}
    assert rows["a.caf"].channels == 2 and rows["b.flac"].error
    hints = spark.createDataFrame([(1, "a"), (2, "a"), (4, "x_AmbiX"), (4, "a"), (4, "1204$"), (6, "ambisonic")], "c int, n string").select(layout_hint(F.col("c"), F.col("n"))).collect()
    assert [r[0] for r in hints] == ["mono", "stereo", "ambisonic_b_format", "multichannel", "multichannel", "multichannel"]


def test_addresses(spark, tmp_path):
    folder = put(tmp_path / "x", "a.wav", tone(440, 0.2, 8000), rate=8000)
    got = {r.path.rsplit("/", 1)[1]: r for r in w.ingest_urls(spark, [f"file://{folder}/a.wav", f"file://{folder}/a.wav", f"file://{folder}/none.wav"], str(tmp_path / "o")).collect()}
    assert got["a.wav"].channels == 1 and len(got["a.wav"].sha256) == 64 and got["none.wav"].error and len(got) == 2


def test_profiles(spark, tmp_path):
    folder = put(tmp_path / "x", "a.wav", tone(440, 0.2, 8000), rate=8000)
    index = w.profiles_folder(spark, folder, str(tmp_path / "o"), Settings(rate=8000), {"profiles": [{"name": "fast", "frame_size": 256, "hop_size": 128, "metrics": ["rms_dbfs", "dc_offset"]}, {"name": "slow", "frame_size": 2048, "hop_size": 1024, "metrics": ["rms_dbfs", "dc_offset"]}]})
    n = {r.profile: spark.read.parquet(r.results).where("metric = 'rms_dbfs'").first().n for r in index.collect()}
    assert n == {"fast": 62, "slow": 7}


def test_a_file_is_read_a_few_times(spark, tmp_path, monkeypatch):
    from sonarlake.operators import metrics as m

    source = m.shared(folder_source(audio_files(spark, put(tmp_path / "x", "a.wav", tone(440, 0.2, 8000), tone(440, 0.2, 8000), rate=8000)), Settings.framed(8000, 512, 256)))
    reads = []
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [path")
    keep = m.keep
    monkeypatch.setattr(m, "keep", lambda df: reads.append(count(df)) or keep(df))
    own = [count(metric.compute(source)) for name, metric in m.METRICS.items() if name not in ("sti_proxy", "bass_ratio")]
    assert sum(own) + sum(reads) <= 60  # of 72 metrics; with nothing shared it is several hundred
