"""Alerts and moments on streams of readings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonarlake.functions.levels import above, below
from sonarlake.plans.lineage import ensure_checkpoint_dir


def windowed_means(readings: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """source, start, mean, n over tumbling windows of event time. ``readings``: source, ts (timestamp), value; null and NaN values are left out."""
    good = readings.where("value is not null and not isnan(value)").withWatermark("ts", late)
    means = good.groupBy("source", F.window("ts", f"{seconds} seconds")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return means.select("source", F.col("window.start").alias("start"), "mean", "n")


def alert_rows(means: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """source, start, value, condition, threshold where a mean breaks a limit."""
    v = F.col("mean")
    hits = F.array(
        F.when(below(v, F.lit(low).cast("double")), F.struct(F.lit("min").alias("condition"), F.lit(low).cast("double").alias("threshold"))),
        F.when(above(v, F.lit(high).cast("double")), F.struct(F.lit("max").alias("condition"), F.lit(high).cast("double").alias("threshold"))),
    )
    return means.withColumn("a", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select("source", "start", F.col("mean").alias("value"), "a.condition", "a.threshold")


def metric_means(readings: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """source, metric, start, mean, n over tumbling windows of event time. ``readings``: source, metric, ts, value."""
    good = readings.where("value is not null and not isnan(value)").withWatermark("ts", late)
    means = good.groupBy("source", "metric", F.window("ts", f"{seconds} seconds")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return means.select("source", "metric", F.col("window.start").alias("start"), "mean", "n")


def rule_alerts(means: DataFrame, rules: DataFrame) -> DataFrame:
    """source, metric, start, value, condition, threshold: every rule (metric, min, max) that a mean breaks; works on streams too, the rules being a table at rest."""
    v = F.col("mean")
    hits = F.array(
        F.when(below(v, F.col("min")), F.struct(F.lit("min").alias("condition"), F.col("min").alias("threshold"))),
        F.when(above(v, F.col("max")), F.struct(F.lit("max").alias("condition"), F.col("max").alias("threshold"))),
    )
    hit = means.join(rules, "metric").withColumn("a", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    return hit.select("source", "metric", "start", F.col("mean").alias("value"), "a.condition", "a.threshold")


LEVELS = "source string, first long, n long, energy double, peak double, crossings long"


def chunk_levels(chunks: DataFrame) -> DataFrame:
    """source, first, n, energy, peak, crossings of every chunk of samples of a stream, with what must be carried from chunk to chunk.

    ``chunks``: source, first (number of the first sample), x (array). The state of a source is its last sample, so that a change of sign between two chunks is counted
    once; chunks of one source must arrive in order, one that does not begin where the last ended starts anew. Chunks of one batch are put in order first; a null sample counts as 0.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, last = state.get if state.exists else (None, 0.0)
        out = []
        for first, x in sorted(((int(f), v) for b in batches for f, v in zip(b["first"], b.x)), key=lambda r: r[0]):
            y = np.nan_to_num(np.asarray(x, float))
            if not len(y):
                continue
            joined = np.r_[last, y] if place == first else y
            sign = joined < 0
            out.append((key[0], first, len(y), float((y * y).sum()), float(np.abs(y).max()), int((sign[1:] != sign[:-1]).sum())))
            place, last = first + len(y), float(y[-1])
        if place is not None:
            state.update((place, last))
        yield pd.DataFrame(out, columns=["source", "first", "n", "energy", "peak", "crossings"])

    held = chunks.select(F.col("source").cast("string").alias("source"), F.col("first").cast("long").alias("first"), F.col("x").cast("array<double>").alias("x"))
    return held.groupBy("source").applyInPandasWithState(step, LEVELS, "place long, last double", "append", GroupStateTimeout.NoTimeout)


def moments(events: DataFrame, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """source, start_s, end_s, events: runs of events whose pauses are at most ``gap_s``, each given out once the watermark has passed it.

    ``events``: source, ts. The state of a source is its open runs; an event that is late but within the watermark joins, or joins two of them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, counts = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for b in batches:
                for t in b.ts.astype("int64") / 1e9:
                    starts.append(float(t))
                    ends.append(float(t))
                    counts.append(1)
        runs: list[list] = []
        for s, e, c in sorted(zip(starts, ends, counts)):
            if runs and s <= runs[-1][1] + gap_s:
                runs[-1][1], runs[-1][2] = max(runs[-1][1], e), runs[-1][2] + c
            else:
                runs.append([s, e, c])
        mark = state.getCurrentWatermarkMs() / 1000
        done = [r for r in runs if r[1] + gap_s < mark]
        left = [r for r in runs if r[1] + gap_s >= mark]
        if left:
            state.update(tuple([r[i] for r in left] for i in range(3)))
            state.setTimeoutTimestamp(max(int((min(r[1] for r in left) + gap_s) * 1000) + 1, int(mark * 1000) + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"source": [key[0]] * len(done), "start_s": [r[0] for r in done], "end_s": [r[1] for r in done], "events": [r[2] for r in done]})

    seen = events.select(F.col("source").cast("string").alias("source"), "ts").withWatermark("ts", late)
    return seen.groupBy("source").applyInPandasWithState(
        step, "source string, start_s double, end_s double, events long", "starts array<double>, ends array<double>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_available(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder, and reads that table.

    Without ``keys`` rows are appended once they are final. With ``keys`` every batch appends the rows that it changed, numbered, and the last of each key is
    read: the state of windows that the watermark has passed is freed, and what a batch writes does not grow with what came before.
    """
    spark: SparkSession = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if not keys:
        sink.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    # a batch that is run again after a failure writes its own folder anew
    sink.foreachBatch(lambda df, n: df.withColumn("__batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/batch={n}")).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("__batch", "long")).option("basePath", f"{base}/rows").parquet(f"{base}/rows/batch=*")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("r")).select(*keys, "r.*").select(*stream.columns)
