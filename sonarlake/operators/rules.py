"""Threshold rules: alerts per chunk, validation per recording, moments around alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions.levels import above, below
from sonarlake.operators.intervals import label_intervals


def once(readings: DataFrame) -> DataFrame:
    """Readings with a value, repeated rows once."""
    return readings.select("reading_id", "recording_id", "metric", "timestamp_s", "value", "units").where("value is not null and not isnan(value) and timestamp_s is not null").dropDuplicates(["reading_id"])


def chunk_means(readings: DataFrame, seconds: float) -> DataFrame:
    """recording_id, chunk_index, metric, mean, n: readings averaged over tumbling windows."""
    return once(readings).groupBy("recording_id", F.floor(F.col("timestamp_s") / seconds).cast("long").alias("chunk_index"), "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def alerts(means: DataFrame, rules: DataFrame) -> DataFrame:
    """recording_id, chunk_index, metric, value, condition, threshold: both limits of a rule may be broken; a NaN breaks none.

    ``rules``: metric, min, max (a null limit is none). Metrics without a rule give nothing.
    """
    v = F.col("mean")
    broken = F.array(
        F.when(below(v, F.col("min")), F.struct(F.lit("min").alias("condition"), F.col("min").alias("threshold"))),
        F.when(above(v, F.col("max")), F.struct(F.lit("max").alias("condition"), F.col("max").alias("threshold"))),
    )
    hit = means.join(rules, "metric").withColumn("a", F.explode(F.filter(broken, lambda x: x.isNotNull())))
    return hit.select("recording_id", "chunk_index", "metric", F.col("mean").alias("value"), "a.condition", "a.threshold")


def validation(files: DataFrame, values: DataFrame, rules: list[tuple[str, float | None, float | None]], nan_fails: bool = False) -> DataFrame:
    """A row per file and rule: recording_id, name, value, expected_min, expected_max, status, message.

    ``values``: recording_id, name, value. A missing or null value fails; a NaN passes unless ``nan_fails``; of two broken limits the lower is named.
    """
    table = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(lo).cast("double").alias("expected_min"), F.lit(hi).cast("double").alias("expected_max")) for m, lo, hi in rules])
    asked = files.select("recording_id").distinct().withColumn("r", F.explode(table)).select("recording_id", "r.*")
    v = F.col("value")
    message = (
        F.when(v.isNull(), "metric missing").when(F.isnan(v) & F.lit(nan_fails), "not a number").when(below(v, F.col("expected_min")), "below min").when(above(v, F.col("expected_max")), "above max").otherwise("")
    )
    out = asked.join(values, ["recording_id", "name"], "left").withColumn("message", message)
    return out.select("recording_id", "name", "value", "expected_min", "expected_max", F.when(F.col("message") == "", "pass").otherwise("fail").alias("status"), "message")


def file_status(rows: DataFrame) -> DataFrame:
    """recording_id, checks, failures, status."""
    failed = F.sum((F.col("status") == "fail").cast("long"))
    return rows.groupBy("recording_id").agg(F.count("*").alias("checks"), failed.alias("failures"), F.when(failed > 0, "fail").otherwise("pass").alias("status"))


def windows(found: DataFrame, seconds: float, before: Column, after: Column, least: Column, duration: Column, rank_metric: str) -> DataFrame:
    """A window for every chunk with enough alerts: recording_id, chunk_index, start_ms, end_ms, alerts, rank_score, center_s.

    ``found`` are alerts with the columns that the other arguments name. The score is the largest value of the metric ranked by among the chunk's
    alerts, or the number of alerts.
    """
    keys = ["recording_id", "chunk_index"]
    per = found.groupBy(*keys).agg(
        F.count("*").alias("alerts"), F.max(F.when(F.col("metric") == rank_metric, F.col("value"))).alias("best"),
        F.max(before).alias("b"), F.max(after).alias("a"), F.max(least).alias("least"), F.max(duration).alias("dur"),
    ).where(F.col("alerts") >= F.coalesce("least", F.lit(1)))
    start, end = F.col("chunk_index") * seconds, (F.col("chunk_index") + 1) * seconds
    ms = lambda c: F.round(c * 1000).cast("long")
    # no duration known: no upper bound
    return per.select(*keys, ms(F.greatest(F.lit(0.0), start - F.coalesce("b", F.lit(0.0)))).alias("start_ms"), ms(F.least(end + F.coalesce("a", F.lit(0.0)), F.coalesce("dur", F.lit(1e12)))).alias("end_ms"), "alerts", F.coalesce("best", F.col("alerts").cast("double")).alias("rank_score"), ((start + end) / 2).alias("center_s"))


def merged(wins: DataFrame, gap_ms: int) -> DataFrame:
    """Windows joined to moments: recording_id, start_ms, end_ms, alerts, chunks, rank_score, event_center_s (of the best window, earliest if tied)."""
    labelled = label_intervals(wins.withColumn("gap_ms", F.lit(gap_ms)), "recording_id", "start_ms", "end_ms", "gap_ms", ["alerts", "rank_score", "center_s"])
    return labelled.groupBy("recording_id", F.col("island_start").alias("start_ms")).agg(
        F.max("end_ms").alias("end_ms"), F.sum("alerts").alias("alerts"), F.count("*").alias("chunks"), F.max("rank_score").alias("rank_score"),
        F.max_by("center_s", F.struct("rank_score", -F.col("start_ms"))).alias("event_center_s"),
    )


def best(moments: DataFrame, k: int) -> DataFrame:
    """The k moments of the highest score of each recording, earlier ones first if tied; Spark drops the rest before the exchange."""
    w = Window.partitionBy("recording_id").orderBy(F.desc("rank_score"), "start_ms")
    return moments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cut_clips(signal: DataFrame, clips: DataFrame, block: int = 4096) -> DataFrame:
    """Samples of each clip: clip_id, recording_id, n, x, and channel if the signal has it. ``clips``: clip_id, recording_id, first, last (inclusive sample numbers).

    A range join by blocks of samples, so that it is an equi-join that a long recording is spread over.
    """
    spread = clips.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    held = signal.withColumn("b", F.floor(F.col("n") / block))
    return held.join(spread, ["recording_id", "b"]).where("n between first and last").select("clip_id", "recording_id", *[c for c in ("channel",) if c in signal.columns], "n", "x")
