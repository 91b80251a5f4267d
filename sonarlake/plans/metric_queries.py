"""One named query per metric of the catalog: m_<metric>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions.levels import rounded
from sonarlake.operators.metrics import METRICS, Source, summary
from sonarlake.plans.metric_sql import SERIES_TWO, metric_sql, two_channel_sql
from sonarlake.sources.signals import Settings, event_signal, impulse_signal


def event_source(spark: SparkSession, folder: str, channels: int = 1, settings: Settings | None = None) -> Source:
    """The events as a recording of so many channels, and under a decay as an impulse response. Their second channel also serves as a calibration tone."""

    def signal(k: int) -> DataFrame:
        if k == 1 and channels > 1:
            return event_signal(spark, folder, channels).groupBy("recording_id", "n").agg(F.avg("x").alias("x")).select("recording_id", F.lit(0).alias("channel"), "n", "x")
        return event_signal(spark, folder, k or channels)

    tone = lambda: event_signal(spark, folder, 2).where("channel = 1")
    return Source(signal, lambda: impulse_signal(spark, folder), settings or Settings(), "site_20240301_213000.wav", tone)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    channels = 2 if name == "interchannel_coherence" else 1
    return lambda spark, d: rounded(summary(event_source(spark, d, channels), name))


def _two_channels(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rounded(summary(event_source(spark, d, 2, Settings(rate=16000)), name))


QUERIES = {f"m_{name}": _query(name) for name in METRICS} | {f"m2_{name}": _two_channels(name) for name in SERIES_TWO}
SQL = {f"m_{name}": sql for name in METRICS if (sql := metric_sql(name))} | {f"m2_{name}": two_channel_sql(name) for name in SERIES_TWO}
