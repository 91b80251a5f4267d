"""The shape of result documents, as Spark types and as JSON Schema."""

from __future__ import annotations

import json

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType

VERSION = "0.2.0"
CATALOG_VERSION = "1.1.0"
_STATS = ("mean", "std", "min", "max", "p50", "p95")

RESULT = StructType(
    [
        StructField("units", StringType()),
        StructField("summary", StructType([StructField(s, DoubleType()) for s in _STATS])),
        StructField("confidence", DoubleType()),
        StructField("spec", StructType([StructField("category", StringType()), StructField("streaming_capable", BooleanType()), StructField("calibration_dependency", BooleanType())])),
        StructField("series", ArrayType(DoubleType())),
        StructField("timestamps_s", ArrayType(DoubleType())),
    ]
)
METADATA = StructType(
    [
        StructField("input_path", StringType()),
        StructField("resolved_metric_list", ArrayType(StringType())),
        StructField("metric_catalog_version", StringType()),
        *[StructField(n, LongType()) for n in ("frame_size", "hop_size", "analysis_rate", "sample_rate", "channels", "num_samples")],
        StructField("duration_s", DoubleType()),
        StructField("layout", StringType()),
        StructField("validity_flags", MapType(StringType(), BooleanType())),
    ]
)
DOCUMENT = StructType(
    [
        StructField("config_hash", StringType(), False),
        StructField("pipeline_hash", StringType(), False),
        StructField("schema_version", StringType(), False),
        StructField("library_version", StringType(), False),
        StructField("analysis_mode", StringType(), False),
        StructField("analysis_time_utc", StringType(), False),
        StructField("recording_id", StringType(), False),
        StructField("metadata", METADATA, False),
        StructField("metrics", MapType(StringType(), RESULT), False),
    ]
)


def json_schema() -> dict:
    """JSON Schema (2020-12) of a result document; the map of metrics is open."""
    number = {"type": ["number", "null"]}
    values = {"type": "array", "items": number}
    metric = {
        "type": "object", "required": ["summary"],
        "properties": {"units": {"type": "string"}, "summary": {"type": "object", "properties": {s: number for s in _STATS}}, "confidence": number, "spec": {"type": "object"}, "series": values, "timestamps_s": values},
    }
    text = {"type": "string"}
    meta = {"type": "object", "required": ["input_path", "resolved_metric_list", "metric_catalog_version"], "properties": {f.name: {} for f in METADATA}}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "title": "result document", "type": "object",
        "properties": {f.name: text for f in DOCUMENT if f.name not in ("metrics", "metadata")} | {"metadata": meta, "metrics": {"type": "object", "additionalProperties": metric}},
        "required": [f.name for f in DOCUMENT],
    }


def schema_text() -> str:
    """The schema as it is published."""
    return json.dumps(json_schema(), indent=2, sort_keys=True)
