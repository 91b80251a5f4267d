"""Irregular readings onto a regular grid, with missing slots filled by a low-rank factorisation or marked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.lineage import group_bounds, whole_groups

BLOCK_SLOTS = 64
BLOCK_SOURCES = 256
RUN_BLOCKS = 4096  # blocks that a row is unfolded to at once


def slot_of(ts: str, step: str):
    """k with k*step <= ts < (k+1)*step, also where the quotient rounds over an edge."""
    k = F.floor(F.col(ts) / F.col(step))
    return F.when(k * F.col(step) > F.col(ts), k - 1).when((k + 1) * F.col(step) <= F.col(ts), k + 1).otherwise(k)


def complete_low_rank(m: np.ndarray, rank: int = 3, ridge: float = 0.3, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Alternating least squares on the observed (non-NaN) cells of sources x slots.

    Returns the completed matrix (observed cells as given) and which missing cells have support: at least two readings in
    their row, and one in their column. The others stay NaN.
    """
    seen = ~np.isnan(m)
    n_row, n_col = seen.sum(1), seen.sum(0)
    mean = np.where(n_row > 0, np.nansum(m, 1) / np.maximum(n_row, 1), 0.0)
    dev = np.where(seen, m - mean[:, None], 0.0)
    scale = np.sqrt((dev**2).sum(1) / np.maximum(n_row, 1))
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = dev / scale[:, None]
    r = max(1, min(rank, *m.shape))
    t = np.arange(m.shape[1])
    v = np.cos(np.pi * np.outer((t + 0.5) / max(1, m.shape[1]), np.arange(r)))  # smooth start, the same on every run
    w, eye = seen.astype(float), ridge * np.eye(r)
    for _ in range(rounds):
        u = np.linalg.solve(np.einsum("st,tk,tl->skl", w, v, v, optimize=True) + eye, (z @ v)[..., None])[..., 0]
        v = np.linalg.solve(np.einsum("st,sk,sl->tkl", w, u, u, optimize=True) + eye, (z.T @ u)[..., None])[..., 0]
    support = (~seen) & (n_row >= 2)[:, None] & (n_col >= 1)[None, :]
    full = np.where(seen, m, np.where(support, (u @ v.T) * scale[:, None] + mean[:, None], np.nan))
    return full, support


def regular_grid(frames: DataFrame, recordings: DataFrame, metrics: Sequence[str], rank: int = 3) -> DataFrame:
    """One row per recording, metric and slot between its first and last reading.

    Result: recording_id, metric, slot, grid_s (left edge), value, readings, state: 'observed' (mean of the slot's readings,
    repeated rows once), 'filled' (from the factorisation) or 'unsupported' (value null). Null, NaN and infinite values, rows
    without time and recordings without a positive grid_step_s are no readings. Empty tables give an empty result; other
    columns are ignored.

    Sources are hashed into groups of about 256 and time is cut into blocks of 64 slots, so that a matrix has a bounded size
    however many sources there are and however long one of them is.
    """
    steps = recordings.where("grid_step_s > 0 and not isnan(grid_step_s)").groupBy("recording_id").agg(F.min("grid_step_s").alias("step"))
    wide = frames.select("recording_id", F.col("timestamp_s").alias("ts"), *metrics).where("ts is not null and not isnan(ts) and abs(ts) < 1e15 and recording_id is not null")
    long = wide.unpivot(["recording_id", "ts"], list(metrics), "metric", "x").where("x is not null and not isnan(x) and abs(x) < double('Infinity')")
    placed = long.join(steps, "recording_id").withColumn("slot", slot_of("ts", "step"))
    # one exchange serves both aggregations: the second groups by the first's partitioning keys
    once = placed.repartition("recording_id", "metric", "slot").groupBy("recording_id", "metric", "slot", "step", "ts", "x").agg(F.lit(1).alias("one"))
    cells = once.groupBy("recording_id", "metric", "slot", "step").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    spans = cells.groupBy("recording_id", "metric", "step").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    block = lambda c: F.floor(F.col(c) / BLOCK_SLOTS)
    # in two steps, so that no row holds the blocks of a whole long span
    run = lambda c: F.floor(block(c) / RUN_BLOCKS)
    runs = spans.withColumn("run", F.explode(F.sequence(run("lo"), run("hi"))))
    spread = runs.withColumn("block", F.explode(F.sequence(F.greatest(block("lo"), F.col("run") * RUN_BLOCKS), F.least(block("hi"), F.col("run") * RUN_BLOCKS + RUN_BLOCKS - 1)))).select(
        "recording_id", "metric", "step", "block", F.lit(None).cast("long").alias("slot"), "lo", "hi", F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("n")
    )
    held = cells.select("recording_id", "metric", "step", block("slot").alias("block"), "slot", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), "x", "n")
    groups = max(1, ceil(recordings.select(F.approx_count_distinct("recording_id")).first()[0] / BLOCK_SOURCES))
    keys = ["metric", "step", "part", "block"]
    rows = held.unionByName(spread).withColumn("part", F.pmod(F.xxhash64("recording_id"), F.lit(groups)))
    ready = rows.repartition(*keys).sortWithinPartitions(*keys, "recording_id")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            edge = group_bounds(b, keys)
            for i, j in zip(edge[:-1], edge[1:]):
                g = b.iloc[i:j]
                marks = g[g.slot.isna()]
                names = marks.recording_id.to_numpy()
                at = {k: p for p, k in enumerate(names)}
                base = int(g.block.iloc[0]) * BLOCK_SLOTS
                m, n = np.full((len(names), BLOCK_SLOTS), np.nan), np.zeros((len(names), BLOCK_SLOTS), int)
                cells = g[g.slot.notna()]
                row = np.array([at[x] for x in cells.recording_id], int)
                col = cells.slot.to_numpy().astype(int) - base
                m[row, col], n[row, col] = cells.x.to_numpy(), cells.n.to_numpy()
                full, support = complete_low_rank(m, rank)
                slots = base + np.arange(BLOCK_SLOTS)
                inside = (slots >= marks.lo.to_numpy()[:, None]) & (slots <= marks.hi.to_numpy()[:, None])
                r, c = np.nonzero(inside)
                step = float(g.step.iloc[0])
                yield pd.DataFrame(
                    {
                        "recording_id": names[r], "metric": g.metric.iloc[0], "slot": slots[c], "grid_s": slots[c] * step, "value": full[r, c], "readings": n[r, c],
                        "state": np.where(n[r, c] > 0, "observed", np.where(support[r, c], "filled", "unsupported")),
                    }
                )

    out = ready.mapInPandas(fill, "recording_id string, metric string, slot long, grid_s double, value double, readings long, state string")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
