"""Results written to files."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEMS = {"head": "HEAD Acoustics", "apx": "Audio Precision APx", "soundcheck": "Listen SoundCheck"}


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """A table as parquet, CSV with a header, or lines of JSON, by all executors."""
    w = df.write.mode(mode)
    {"parquet": lambda: w.parquet(path), "csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path)}[kind]()


def write_documents(documents: DataFrame, path: str) -> None:
    """recording_id, document: one line of JSON per recording."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """Documents that hold metrics and a hash; other lines are left out."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.recording_id").alias("recording_id"), F.get_json_object("value", "$.config_hash").alias("config_hash"), F.get_json_object("value", "$.metrics").alias("metrics"))
    return rows.where("recording_id is not null and config_hash is not null and metrics is not null")


def write_small_csv(df: DataFrame, path: str | Path, most: int = 1_000_000) -> int:
    """One CSV file by the driver, for reports of at most ``most`` rows; more are refused."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows; use write_table")
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return n


def append_history(df: DataFrame, path: str) -> None:
    """Rows added to a table of checks."""
    df.write.mode("append").parquet(path)


def frame_arrays(wide: DataFrame, metrics: list[str], folder: str | Path, channels: int = 1, replicate: bool = False, most: int = 1_000_000) -> dict:
    """The frame table of one recording, at most ``most`` frames, as NumPy files: frames x features, and channels x frames x features, with a description."""
    rows = wide.orderBy("timestamp_s").select("timestamp_s", *metrics).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} frames; write the table")
    values = rows[metrics].to_numpy(float)
    tensor = np.repeat(values[None], channels, 0) if replicate and channels > 1 else values[None]
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    np.save(out / "frames.npy", values)
    np.save(out / "tensor.npy", tensor)
    meta = {
        "feature_names": metrics, "frames": len(rows), "timestamps_s": rows.timestamp_s.tolist(), "tensor_layout": "[channels, frames, features]",
        "channel_feature_mode": "replicated_aggregate" if len(tensor) > 1 else "aggregate_mixdown", "channel_labels": [f"ch{i + 1}" for i in range(len(tensor))] if len(tensor) > 1 else ["mix"],
    }
    (out / "metadata.json").write_text(json.dumps(meta))
    return meta
