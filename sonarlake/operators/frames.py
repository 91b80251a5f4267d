"""Frames, blocks and neighbours of samples: what all metrics are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions import dsp

BLOCK = 16_384


def lengths(signal: DataFrame) -> DataFrame:
    """recording_id, length in samples."""
    return signal.groupBy("recording_id").agg((F.max("n") + 1).alias("length"))


def framed(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """``signal`` once per frame that holds the sample: adds length, frame and start.

    Frames start at 0, hop, ... as long as they fit; if the last of them ends before the signal, one more frame ends with it. A signal
    shorter than a frame is one frame (what is missing counts as zeros in sums over ``size``).
    """
    last = F.floor((F.col("length") - size) / hop)
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / hop))
    high = F.least(F.floor(F.col("n") / hop), F.greatest(last, F.lit(0)))
    regular = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    tail = (F.col("length") > size) & (F.pmod(F.col("length") - size, F.lit(hop)) != 0) & (F.col("n") >= F.col("length") - size)
    frames = F.concat(regular, F.when(tail, F.array(last + 1)).otherwise(F.array().cast("array<bigint>")))
    out = signal.join(lengths(signal), "recording_id").withColumn("frame", F.explode(frames))
    return out.withColumn("start", F.when(F.col("frame") > last, F.greatest(F.lit(0), F.col("length") - size)).otherwise(F.col("frame") * hop))


def with_previous(df: DataFrame, keys: list[str], order: str, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds, under the names that ``values`` maps to, the values of the row before (``order`` consecutive whole numbers; null at the first).

    Works in blocks: the last row of each block is shown to the next one too, so that no task gets a whole recording.
    """
    own = F.floor(F.col(order) / block)
    at_edge = F.pmod(F.col(order), F.lit(block)) == block - 1
    shown = df.withColumn("__b", F.explode(F.when(at_edge, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "__b").orderBy(order)
    for v, name in values.items():
        shown = shown.withColumn(name, F.lag(v).over(w))
    return shown.where(F.col("__b") == own).drop("__b")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, backward: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds the running sum of ``value``, from the end if ``backward``: sums of blocks first, then within each block."""
    numbered = df.withColumn("__b", F.floor(F.col(order) / block))
    sums = numbered.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*keys).orderBy(F.desc("__b") if backward else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0.0))).drop("__s")  # a row per block
    inside = Window.partitionBy(*keys, "__b").orderBy(F.desc(order) if backward else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn(name, F.sum(value).over(inside)).join(offsets, [*keys, "__b"]).withColumn(name, F.col(name) + F.col("__o")).drop("__b", "__o")


def blocks(signal: DataFrame, columns: list[str], before: int, after: int, block: int = BLOCK) -> DataFrame:
    """recording_id, block, length, first (sample number), and per column the samples of the block as an array, with some of both neighbours.

    Samples of the ``before`` places ahead of a block and the ``after`` places behind it are shown to it as well (both below ``block``).
    """
    own = F.floor(F.col("n") / block)
    at = F.pmod(F.col("n"), F.lit(block))
    places = F.filter(F.array(own, F.when(at < after, own - 1), F.when(at >= block - before, own + 1)), lambda b: b.isNotNull() & (b >= 0))
    shown = signal.withColumn("block", F.explode(places))
    packed = shown.groupBy("recording_id", "block").agg(F.sort_array(F.collect_list(F.struct("n", *columns))).alias("s"))
    out = packed.join(lengths(signal), "recording_id").where(F.col("block") * block < F.col("length"))
    return out.select("recording_id", "block", "length", F.col("s")[0]["n"].alias("first"), *[F.col("s")[c].alias(c) for c in columns])


def rows_of(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, max(m, 1), dtype=np.int32)[: n + 1] if m else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(matrix, np.float64).ravel()))


def frames_of_blocks(packed: DataFrame, columns: list[str], size: int, hop: int, compute: Callable[[int, list[np.ndarray]], dict[str, np.ndarray]], schema: str, tail: bool, back: int = 0, block: int = BLOCK, short: bool = False) -> DataFrame:
    """Runs ``compute(rows of frames per column)`` over the frames that start in each block: recording_id, frame and what it returns.

    ``packed`` must show each block ``size`` places after it. With ``back`` the rows of the frames that start so much earlier are passed too
    (a frame that has none gets itself), for which ``packed`` must show as many places before the block. With ``tail`` a last frame that ends with the signal is added, and a signal shorter than a
    frame is padded with zeros; without it only frames that fit are taken, with ``short`` also of a signal shorter than a frame the padded one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                length, first, number = (b[c][i].as_py() for c in ("length", "first", "block"))
                xs = [b[c][i].values.to_numpy(zero_copy_only=False) for c in columns]
                lo, hi = number * block, min((number + 1) * block, length)
                starts = np.arange(-(-lo // hop) * hop, min(hi, length - size + 1), hop)
                frame = starts // hop
                if (tail or short) and length < size and number == 0:
                    xs = [np.r_[x, np.zeros(size - length)] for x in xs]
                    starts, frame = np.array([0]), np.array([0])
                elif tail and length > size and (length - size) % hop and lo <= length - size < hi:
                    starts, frame = np.r_[starts, length - size], np.r_[frame, (length - size) // hop + 1]
                if not len(starts):
                    continue
                rows = [np.lib.stride_tricks.sliding_window_view(x, size)[starts - first] for x in xs]
                if back:
                    earlier = np.where(starts >= back, starts - back, starts) - first
                    rows += [np.lib.stride_tricks.sliding_window_view(x, size)[earlier] for x in xs]
                made = compute(rows)
                arrays = [pa.array([b["recording_id"][i].as_py()] * len(frame)), pa.array(frame.astype(np.int64))]
                arrays += [rows_of(v) if v.ndim > 1 else pa.array(v.astype(np.float64)) for v in made.values()]
                yield pa.RecordBatch.from_arrays(arrays, ["recording_id", "frame", *made])

    return packed.mapInArrow(run, f"recording_id string, frame long, {schema}")


def peaks_in_blocks(df: DataFrame, keys: list[str], order: str, value: str, distance: int, prominence: float, block: int = 65_536, margin: int = 8_192) -> DataFrame:
    """keys, order, prominence: peaks at least ``distance`` apart that stand out by ``prominence`` among the ``margin`` values on both sides at least.

    ``order`` are consecutive whole numbers. Series are cut into blocks that are shown ``margin`` values of their neighbours, so that no task gets a
    whole long series; for series shorter than a block the prominence is that among all values.
    """
    own = F.floor(F.col(order) / block)
    at = F.pmod(F.col(order), F.lit(block))
    places = F.filter(F.array(own, F.when(at < margin, own - 1), F.when(at >= block - margin, own + 1)), lambda b: b.isNotNull() & (b >= 0))
    base = df.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias("__v"), places.alias("__p"))
    shown = base.select(*keys, order, "__v", F.explode("__p").alias("__b"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in shown.select(*keys).dtypes)

    def find(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        n = g[order].to_numpy()
        i, height = dsp.peaks(g["__v"].to_numpy(), distance, prominence)
        mine = n[i] // block == int(g["__b"].iloc[0])
        return g.iloc[i[mine]][[*keys, order]].assign(prominence=height[mine])

    return shown.groupBy(*keys, "__b").applyInPandas(find, f"{kinds}{', ' if keys else ''}`{order}` long, prominence double")
