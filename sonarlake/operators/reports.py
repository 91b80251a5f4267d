"""Results reshaped: long and wide tables, exports, comparisons of variants, digests, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ("mean", "std", "min", "max", "p50", "p95")


def summary_long(results: DataFrame) -> DataFrame:
    """recording_id, metric, stat, value, units, confidence: one row per statistic that is given."""
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"summary.{s}").alias("value")) for s in STATS])
    rows = results.where("summary is not null").select("recording_id", F.col("name").alias("metric"), F.explode(stats).alias("s"), "units", "confidence")
    return rows.select("recording_id", "metric", "s.stat", "s.value", "units", "confidence").where("value is not null and not isnan(value)")


def industrial(results: DataFrame, system: str, windowing: str) -> DataFrame:
    """system, recording_id, metric, value_mean, value_p95, units, confidence, weighting, windowing."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return results.select(
        F.lit(system).alias("system"), "recording_id", F.col("name").alias("metric"), clean("summary.mean").alias("value_mean"), clean("summary.p95").alias("value_p95"), "units", "confidence",
        F.lit("A/C/Z or unweighted per metric definition").alias("weighting"), F.lit(windowing).alias("windowing"),
    )


def frame_long(frames: DataFrame, metrics: list[str]) -> DataFrame:
    """recording_id, timestamp_s, metric, value: the holes of the wide table left out, repeated rows once."""
    rows = frames.where("timestamp_s is not null and not isnan(timestamp_s)").select("recording_id", "timestamp_s", *metrics)
    return rows.unpivot(["recording_id", "timestamp_s"], metrics, "metric", "value").where("value is not null and not isnan(value)").distinct()


def frame_wide(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per recording and time with a column per metric: one grouping in place of as many outer joins."""
    return long.groupBy("recording_id", "timestamp_s").pivot("metric", metrics).agg(F.max("value"))


def impute_means(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Null and NaN replaced by the mean of the recording's column, by 0 where it has none."""
    clean = wide.select("recording_id", "timestamp_s", *[F.when(~F.isnan(m), F.col(m)).alias(m) for m in metrics])
    means = clean.groupBy("recording_id").agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return clean.join(means, "recording_id").select("recording_id", "timestamp_s", *[F.coalesce(m, f"mean_{m}", F.lit(0.0)).alias(m) for m in metrics])


def clip_vector(results: DataFrame) -> DataFrame:
    """recording_id, position, name, value: means in the order of names."""
    rows = results.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("summary.mean").alias("value")))).alias("v"))  # as many as metrics
    return rows.select("recording_id", F.posexplode("v").alias("position", "e")).select("recording_id", "position", "e.name", "e.value")


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("r")).select(*keys, "r.*")


def compare_variants(runs: DataFrame) -> DataFrame:
    """project, baseline, variant, metric, baseline_value, value, delta, delta_pct; the baseline is a project's first variant by name.

    ``runs``: project, variant, metric, value, one row each. The percentage is null where the baseline is 0.
    """
    base = runs.groupBy("project").agg(F.min("variant").alias("baseline"))
    every = runs.join(base, "project")
    of = every.where("variant = baseline").select("project", "metric", F.col("value").alias("baseline_value"))
    delta = F.col("value") - F.col("baseline_value")
    pct = F.when(F.abs("baseline_value") > 1e-12, 100 * delta / F.abs("baseline_value"))
    return every.join(of, ["project", "metric"], "left").select("project", "baseline", "variant", "metric", "baseline_value", "value", delta.alias("delta"), pct.alias("delta_pct"))


def digest(recordings: DataFrame, results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per recording: duration, channels, rate and the means of some metrics."""
    meta = recordings.groupBy("recording_id").agg(F.max("duration_s").alias("duration_s"), F.max("channels").alias("channels"), F.max("sample_rate").alias("sample_rate"))
    means = results.groupBy("recording_id").pivot("name", metrics).agg(F.max(F.when(~F.isnan("summary.mean"), F.col("summary.mean"))))
    named = means.select("recording_id", *[F.col(f"`{m}`").alias(f"{m}_mean") for m in metrics])
    return meta.join(named, "recording_id", "left")


#: What a unit of each error costs of 100 points.
PENALTIES = {"duration_error_ms": 1 / 20, "clipping_ratio": 1200.0, "centroid_delta_pct": 0.25, "flatness_delta_pct": 0.20, "transient_count_ratio": 18.0}


def kpi_scores(errors: DataFrame) -> DataFrame:
    """``errors`` with a score of 100 less penalties, at least 0. An error that is null or NaN costs nothing; of the ratio of transients the distance from 1 counts."""
    cost = F.lit(0.0)
    for name, weight in PENALTIES.items():
        e = F.col(name).cast("double")
        e = 1.0 - e if name == "transient_count_ratio" else e
        cost = cost + F.when(e.isNotNull() & ~F.isnan(e), F.abs(e)).otherwise(0.0) * weight
    return errors.withColumn("score", F.greatest(F.lit(0.0), 100 - cost))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that have no result yet."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")
