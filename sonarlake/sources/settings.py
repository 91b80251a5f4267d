"""Rules, calibration, profiles and array geometry from YAML or JSON files."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sonarlake.sources.signals import Settings


def read_object(path: str | Path) -> dict:
    """The object in a YAML (by suffix) or JSON file."""
    p = Path(path)
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() in (".yaml", ".yml"):
        import yaml

        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{p} does not hold an object")
    return value


def threshold_rules(spark: SparkSession, rules: dict) -> DataFrame:
    """metric, min, max from ``metric_thresholds``; entries that are no object, and limits that are no number, are left out."""
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    rows = [(str(m), number(t.get("min")), number(t.get("max"))) for m, t in rules.get("metric_thresholds", {}).items() if isinstance(t, dict)]
    return spark.createDataFrame(rows, "metric string, min double, max double")


def calibrated(settings: Settings, profile: dict | None) -> Settings:
    """Settings under a calibration: the offset between full scale and sound pressure; without one there is no offset."""
    if profile is None:
        return replace(settings, spl_offset=0.0, calibrated=False)
    ref = float(profile.get("spl_reference_db", profile.get("spl_ref_db", 94.0)))
    full = float(profile.get("dbfs_reference", profile.get("dbfs_ref", 0.0)))
    return replace(settings, spl_offset=ref - full, calibrated=True)


def profiles(settings: Settings, config: dict) -> list[tuple[str, Settings, list[str]]]:
    """(name, settings, metrics) of every resolution in ``profiles``."""
    out = []
    for i, p in enumerate(config.get("profiles", [])):
        if not isinstance(p, dict):
            raise ValueError("a profile must be an object")
        s = replace(settings, frame=int(p.get("frame_size", settings.frame)), hop=int(p.get("hop_size", settings.hop)), rate=int(p.get("sample_rate") or settings.rate))
        out.append((str(p.get("name", f"profile_{i}")), s, [str(m) for m in p.get("metrics", [])]))
    return out
