"""Stages over a folder of recordings: analyze, frame tables, digest; finished work is not done again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions.provenance import documents, pipeline_hash
from sonarlake.operators.metrics import REC, Source, analyze, metric_names, series
from sonarlake.operators.reports import frame_wide, pending
from sonarlake.sources.exports import write_documents, write_table
from sonarlake.sources.recordings import audio_files, recordings, sample_blocks, samples
from sonarlake.sources.signals import Settings
from sonarlake.sources.storage import exists, write_text

STAGES = ("analyze", "frames", "digest")
FRAME_METRICS = ("rms_dbfs", "peak_dbfs", "crest_factor_db")


@dataclass(frozen=True)
class Job:
    """What to run over which folder."""

    folder: str
    out: str
    metrics: tuple[str, ...] = ("rms_dbfs", "peak_dbfs", "crest_factor_db", "snr_db", "clipping_ratio", "dc_offset")
    settings: Settings = Settings()


def folder_source(files: DataFrame, settings: Settings) -> Source:
    """A source over files, at the rate of the settings: blocks come from the decoder, rows of samples only for metrics that need them."""
    every = samples(files, settings.rate)
    mono = samples(files, settings.rate, True)
    signal = lambda c: mono if c == 1 else every.where(F.col("channel") < c) if c else every
    return Source(signal, lambda: mono, settings, packer=lambda which, before, after: sample_blocks(files, which, before, after, settings.rate), lateral_channels=0)


def _analyze(spark: SparkSession, job: Job) -> dict:
    files = audio_files(spark, job.folder)
    write_table(recordings(files), f"{job.out}/recordings")
    good = spark.read.parquet(f"{job.out}/recordings").where("error is null and num_samples > 0")
    done = f"{job.out}/results"
    digest = pipeline_hash(job.settings, list(job.metrics))
    known = spark.read.parquet(done).where(F.col("pipeline_hash") == digest) if exists(spark, done) else None
    left = good.select(REC).distinct() if known is None else pending(good, known, REC)
    n = left.count()
    if n:
        todo = files.join(left.withColumnRenamed(REC, "path"), "path", "left_semi")
        rows = analyze(folder_source(todo, job.settings), list(job.metrics)).withColumn("pipeline_hash", F.lit(digest))
        write_table(rows, done, mode="append")
        found = spark.read.parquet(done).where(F.col("pipeline_hash") == digest).drop("pipeline_hash")
        write_documents(documents(found, job.settings, good), f"{job.out}/documents")
    return {"analyzed": n, "unreadable": spark.read.parquet(f"{job.out}/recordings").where("error is not null").count()}


def _frames(spark: SparkSession, job: Job) -> dict:
    wanted = [m for m in FRAME_METRICS if m in metric_names(list(job.metrics))]
    if not wanted:
        return {"frames": 0}
    long = series(folder_source(audio_files(spark, job.folder), job.settings), wanted)
    write_table(frame_wide(long, wanted), f"{job.out}/frames")
    return {"frames": spark.read.parquet(f"{job.out}/frames").count()}


def _digest(spark: SparkSession, job: Job) -> dict:
    rows = spark.read.parquet(f"{job.out}/results").groupBy(REC).pivot("metric", list(job.metrics)).agg(F.max("mean"))
    write_table(rows, f"{job.out}/digest", "csv")
    return {"recordings": rows.count()}


RUNNERS: dict[str, Callable[[SparkSession, Job], dict]] = {"analyze": _analyze, "frames": _frames, "digest": _digest}


def run(spark: SparkSession, job: Job, stages: tuple[str, ...] = STAGES) -> dict:
    """Runs stages in order and keeps a manifest; an unknown stage fails and is passed over, a stage that raises ends the run."""
    manifest: dict = {"status": "completed", "stages": {}}
    for name in stages:
        began = time.time()
        entry: dict = {"status": "completed"}
        manifest["stages"][name] = entry
        if name not in RUNNERS:
            entry.update(status="failed", error="unknown stage")
            manifest["status"] = "failed"
            continue
        try:
            entry.update(RUNNERS[name](spark, job))
        except Exception as e:  # the manifest names it
            entry.update(status="failed", error=str(e)[:500])
            manifest["status"] = "failed"
        entry["duration_s"] = round(time.time() - began, 3)
        write_text(spark, f"{job.out}/manifest.json", json.dumps(manifest, indent=1))
        if entry["status"] == "failed":
            break
    return manifest
