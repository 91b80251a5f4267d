from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.__main__ import main
from sonarlake.plans.pipeline import Job, run
from sonarlake.sources.exports import append_history, frame_arrays, read_documents, write_small_csv, write_table
from sonarlake.sources.settings import calibrated, profiles, read_object, threshold_rules
from sonarlake.sources.signals import Settings
from sonarlake.sources.wav import encode


def test_stages_and_resume(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    t = np.arange(8000) / 8000
    (folder / "a.wav").write_bytes(encode((0.5 * np.sin(2 * np.pi * 440 * t))[:, None], 8000))
    (folder / "bad.wav").write_bytes(b"RIFF")
    job = Job(str(folder), str(out), ("rms_dbfs", "dc_offset"), Settings(frame=800, hop=800))
    first = run(spark, job)
    assert first["status"] == "completed" and first["stages"]["analyze"]["analyzed"] == 1 and first["stages"]["analyze"]["unreadable"] == 1
    assert first["stages"]["frames"]["frames"] == 10
    (folder / "b.wav").write_bytes(encode(np.zeros((4000, 2)), 8000))
    again = run(spark, job, ("analyze", "none", "digest"))
    assert again["status"] == "failed" and again["stages"]["analyze"]["analyzed"] == 1 and again["stages"]["digest"]["recordings"] == 2
    rows = spark.read.parquet(f"{out}/results").where("metric = 'rms_dbfs'").select("mean").collect()
    assert any(abs(r.mean - -9.0309) < 0.01 for r in rows)
    assert read_documents(spark, f"{out}/documents").count() == 2
    assert json.loads((out / "manifest.json").read_text())["stages"]["none"]["error"] == "unknown stage"
    (tmp_path / "rules.json").write_text('{"metric_thresholds": {"rms_dbfs": {"max": -20}}}')
    assert main(["validate", f"{out}/results", str(tmp_path / "rules.json")]) == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 1.0, None), (1.0, None, 4.0)], "timestamp_s double, a double, b double")
    for kind in ("parquet", "csv", "json"):
        write_table(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert write_small_csv(df, tmp_path / "x" / "y.csv") == 2
    with pytest.raises(ValueError):
        write_small_csv(df, tmp_path / "z.csv", most=1)
    append_history(df, str(tmp_path / "h"))
    append_history(df, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    meta = frame_arrays(df, ["a", "b"], tmp_path / "n", 2, True)
    assert meta["channel_labels"] == ["ch1", "ch2"] and np.load(tmp_path / "n" / "tensor.npy").shape == (2, 2, 2)


def test_settings(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("dbfs_reference: -20\nspl_reference_db: 74\n")
    s = calibrated(Settings(), read_object(tmp_path / "c.yaml"))
    assert s.spl_offset == 94 and -12 + s.spl_offset == 82 and not calibrated(s, None).calibrated
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        read_object(tmp_path / "l.json")
    got = threshold_rules(spark, {"metric_thresholds": {"m": {"min": 1, "max": "x"}, "n": 3}}).collect()
    assert [tuple(r) for r in got] == [("m", 1.0, None)]
    assert profiles(Settings(), {"profiles": [{"name": "fast", "frame_size": 256, "metrics": ["rms_dbfs"]}]})[0][1].frame == 256


def test_command_line(capsys, spark, data, tmp_path):
    assert main(["metrics"]) == 0 and len(capsys.readouterr().out.splitlines()) == 74
    assert main(["query", "validation_file_status", data, "--out", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).where(F.col("checks") > 0).count() > 0


def test_vectors_and_schema(spark, tmp_path):
    from sonarlake.functions.schema import DOCUMENT, json_schema, schema_text
    from sonarlake.operators.metrics import discover
    from sonarlake.sources.features import load_vectors, save_vectors

    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    v = load_vectors(spark, str(tmp_path / "v.npy"))
    assert v.count() == 3 and v.first().feature_names == ["f000", "f001"]
    save_vectors(v, str(tmp_path / "w.npz"))
    assert [r.matrix for r in load_vectors(spark, str(tmp_path / "w.npz")).orderBy("frame_idx").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    (tmp_path / "c.csv").write_text("t,a\n0.0,1\n0.5,2\n")
    assert load_vectors(spark, str(tmp_path / "c.csv")).agg(F.max("time_s")).first()[0] == 0.5
    with pytest.raises(ValueError):
        load_vectors(spark, "x.bin")
    assert set(json_schema()["required"]) == {f.name for f in DOCUMENT} and json.loads(schema_text()) == json_schema()
    assert discover("no.such.group") == []
