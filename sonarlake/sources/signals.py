"""Tables read as sampled signals: one row per recording, channel and sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.sources.tables import table


@dataclass(frozen=True)
class Settings:
    """What metrics depend on besides the samples."""

    rate: int = 8000
    frame: int = 1024
    hop: int = 256
    fft: int = 64
    fft_hop: int = 32
    spl_offset: float = 94.0  # decibels between full scale and sound pressure level; 0 without calibration
    calibrated: bool = True
    mic_spacing_m: float = 0.2
    tone_dbfs: float = -20.0  # nominal level of a calibration tone

    @classmethod
    def framed(cls, rate: int, frame: int, hop: int, **more) -> Settings:
        """Settings whose transforms have the size and the hop of the frames."""
        return cls(rate=rate, frame=frame, hop=hop, fft=frame, fft_hop=hop, **more)


def scaled(value: Column) -> Column:
    """Values of ``events`` as amplitudes between -1 and 1, with saturation."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (value - 50) / 250))


def event_signal(spark: SparkSession, folder: str, channels: int = 1) -> DataFrame:
    """recording_id, channel, n, x: the events as one recording, dealt to ``channels`` in turn like interleaved samples."""
    e = table(spark, folder, "events")
    return e.select(
        F.lit("events").alias("recording_id"), F.pmod("event_id", F.lit(channels)).cast("int").alias("channel"),
        F.floor(F.col("event_id") / channels).cast("long").alias("n"), scaled(F.col("value")).alias("x"),
    )


def impulse_signal(spark: SparkSession, folder: str, decay: float = 2000.0) -> DataFrame:
    """The events under an exponential decay: a stand-in for the impulse response of a room."""
    return event_signal(spark, folder).withColumn("x", F.col("x") * F.exp(-F.col("n") / decay))


def wide(signal: DataFrame, channels: int) -> DataFrame:
    """recording_id, n, x0, x1, ...: one row per sample with all channels; samples that lack a channel are left out."""
    cols = [F.max(F.when(F.col("channel") == c, F.col("x"))).alias(f"x{c}") for c in range(channels)]
    return signal.groupBy("recording_id", "n").agg(*cols).dropna(subset=[f"x{c}" for c in range(channels)])
