"""Folders of recordings as tables: what they are, their samples, and blocks of samples straight from the decoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions.dsp import resample
from sonarlake.operators.frames import BLOCK
from sonarlake.sources.audio import FOREIGN, IMPULSES, NATIVE, decode

PATTERN = "*.{" + ",".join(s[1:] + "," + s[1:].upper() for s in (*NATIVE, *FOREIGN, *IMPULSES)) + "}"
BETWEEN = "\x1f"  # a recording and its channel, as the metrics read it


def audio_files(spark: SparkSession, folder: str, pattern: str = PATTERN, recursive: bool = True) -> DataFrame:
    """path, length, content of the files of a folder, each once."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "content").dropDuplicates(["path"])


def layout_hint(channels, name):
    """mono, stereo, ambisonic_b_format (four channels and a name that says so) or multichannel."""
    said = F.lower(name).rlike("ambi|bformat|ambisonic")
    return F.when(channels == 1, "mono").when(channels == 2, "stereo").when((channels == 4) & said, "ambisonic_b_format").when(channels > 2, "multichannel")


def recordings(files: DataFrame) -> DataFrame:
    """recording_id, sample_rate, channels, num_samples, duration_s, layout, error: one row per file; unreadable files have only an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                try:
                    x, rate = decode(path, content)
                    rows.append((path, rate, x.shape[1], x.shape[0], x.shape[0] / rate, None))
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["recording_id", "sample_rate", "channels", "num_samples", "duration_s", "error"]).astype({"sample_rate": "Int64", "channels": "Int64", "num_samples": "Int64"})

    out = files.mapInPandas(read, "recording_id string, sample_rate long, channels long, num_samples long, duration_s double, error string")
    return out.withColumn("layout", layout_hint(F.col("channels"), F.col("recording_id")))


def _decoded(batch: pa.RecordBatch, rate: int | None, mean: bool) -> Iterator[tuple[str, int, np.ndarray]]:
    """(path, channel, samples) of the readable files of a batch, at ``rate``; with ``mean`` one channel that is the mean of all."""
    for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
        try:
            x, own = decode(path, content)
        except ValueError:
            continue
        x = x.mean(1, keepdims=True) if mean else x
        for c in range(x.shape[1]):
            yield path, c, resample(x[:, c], own, rate) if rate else x[:, c].astype(float)


def samples(files: DataFrame, rate: int | None = None, mean: bool = False, step: int = 65_536) -> DataFrame:
    """recording_id, channel, n, x of all readable files. Rows leave the worker in pieces of ``step`` samples."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, c, y in _decoded(b, rate, mean):
                for i in range(0, len(y), step):
                    part = y[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.full(len(part), c, np.int32)), pa.array(np.arange(i, i + len(part))), pa.array(part)], ["recording_id", "channel", "n", "x"])

    return files.mapInArrow(read, "recording_id string, channel int, n long, x double")


def sample_blocks(files: DataFrame, which: str, before: int, after: int, rate: int | None = None, block: int = BLOCK) -> DataFrame:
    """recording_id, block, length, first, x: blocks of samples, shown some of both neighbours, cut by the decoder: no sample is shuffled.

    ``which``: 'mono' for the mean of the channels, 'every' for all of them (recording_id then ends with the channel).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, c, y in _decoded(b, rate, which == "mono"):
                name = path if which == "mono" else f"{path}{BETWEEN}{c}"
                for i in range(0, len(y), block):
                    first = max(0, i - before)
                    x = y[first : i + block + after]
                    values = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // block]), pa.array([len(y)]), pa.array([first]), values], ["recording_id", "block", "length", "first", "x"])

    return files.mapInArrow(read, "recording_id string, block long, length long, first long, x array<double>")
