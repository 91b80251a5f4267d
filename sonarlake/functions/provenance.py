"""Hashes of what a result was made from, and result documents."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import sonarlake
from sonarlake.functions.schema import CATALOG_VERSION, VERSION


def canonical(value) -> str:
    """JSON with sorted keys and nothing superfluous."""
    return json.dumps(asdict(value) if is_dataclass(value) else value, sort_keys=True, separators=(",", ":"), default=str)


def config_hash(value) -> str:
    """SHA-256 of the canonical form."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def pipeline_hash(config, metrics: list[str]) -> str:
    """As ``config_hash``, with the metrics and the versions that computed them."""
    return config_hash({"config": json.loads(canonical(config)), "metrics": sorted(metrics), "versions": {"sonarlake": sonarlake.__version__, "pyspark": pyspark.__version__}})


def documents(summaries: DataFrame, config, recordings: DataFrame | None = None, series: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """recording_id, document (JSON): versions, hashes, metadata, and each metric with units, summary, confidence, spec and, if ``series`` is given, its values and their times.

    ``recordings``: recording_id, sample_rate, channels, num_samples, duration_s, layout. ``flags``: recording_id and one boolean column per flag. A document holds
    the series of one recording; for long ones keep them in a table and leave ``series`` out.
    """
    from sonarlake.operators.metrics import METRICS

    names = sorted(r.metric for r in summaries.select("metric").distinct().collect())
    stats = F.struct("mean", "std", "min", "max", "p50", "p95")
    specs = {n: METRICS[n] for n in names if n in METRICS}
    known = F.create_map(*[x for n, m in specs.items() for x in (F.lit(n), F.struct(F.lit(m.category).alias("category"), F.lit(m.streaming).alias("streaming_capable"), F.lit(m.calibrated).alias("calibration_dependency")))]) if specs else F.lit(None)
    fields = [F.col("units"), stats.alias("summary"), F.col("confidence"), known[F.col("metric")].alias("spec") if specs else F.lit(None).cast("string").alias("spec")]
    rows = summaries
    if series is not None:
        packed = series.groupBy("recording_id", "metric").agg(F.sort_array(F.collect_list(F.struct("timestamp_s", "value"))).alias("s"))
        rows = rows.join(packed, ["recording_id", "metric"], "left")
        fields += [F.col("s.value").alias("series"), F.col("s.timestamp_s").alias("timestamps_s")]
    per = rows.groupBy("recording_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct(*fields).alias("result"))))).alias("metrics"))  # as many as metrics
    meta = [F.col("recording_id").alias("input_path"), F.array(*map(F.lit, names)).alias("resolved_metric_list"), F.lit(CATALOG_VERSION).alias("metric_catalog_version")]
    meta += [F.lit(getattr(config, a)).alias(n) for a, n in (("frame", "frame_size"), ("hop", "hop_size"), ("rate", "analysis_rate")) if hasattr(config, a)]
    if recordings is not None:
        columns = ["sample_rate", "channels", "num_samples", "duration_s", "layout"]
        per = per.join(recordings.groupBy("recording_id").agg(*[F.first(c).alias(c) for c in columns]), "recording_id", "left")
        meta += [F.col(c) for c in columns]
    if flags is not None:
        held = [c for c in flags.columns if c != "recording_id"]
        per = per.join(flags.select("recording_id", F.struct(*held).alias("validity_flags")), "recording_id", "left")
        meta.append(F.col("validity_flags"))
    head = [F.lit(config_hash(config)).alias("config_hash"), F.lit(pipeline_hash(config, names)).alias("pipeline_hash"), F.lit(VERSION).alias("schema_version"), F.lit(sonarlake.__version__).alias("library_version"), F.lit("full").alias("analysis_mode")]
    return per.select("recording_id", F.to_json(F.struct(*head, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("analysis_time_utc"), "recording_id", F.struct(*meta).alias("metadata"), "metrics")).alias("document"))
