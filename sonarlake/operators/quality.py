"""Flags of what makes a recording's results doubtful."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.operators.metrics import METRICS, REC, Source

FLAGS = ("clipping", "dc_offset_excessive", "snr_confidence_low", "ir_detected", "ir_tail_low_snr")


def validity_flags(s: Source) -> DataFrame:
    """recording_id and a boolean for each of FLAGS: clipped samples, an offset above a thousandth, less than 10 dB between loud and quiet frames, whether
    the impulse signal looks like an impulse response, and whether its tail is then too weak for a decay."""
    q = s.quality.select(REC, (F.col("clipping_ratio") > 0).alias("clipping"), (F.abs("dc_offset") > 1e-3).alias("dc_offset_excessive"))
    snr = METRICS["snr_db"].compute(s).select(REC, F.coalesce(F.col("v") < 10, F.lit(True)).alias("snr_confidence_low"))
    imp = s.impulse()
    top = imp.groupBy(REC).agg(F.min_by("n", F.struct(-F.abs("x"), F.col("n"))).alias("at"), (F.max("n") + 1).alias("length"))
    size = F.col("length") - F.col("at")
    head = F.greatest(F.lit(4), F.least(F.lit(64), F.floor(size / 8)))
    t = imp.join(top, REC).where(F.col("n") >= F.col("at"))
    ends = t.groupBy(REC).agg(
        F.avg(F.when(F.col("n") - F.col("at") < head, F.abs("x"))).alias("first"), F.avg(F.when(F.col("n") >= F.col("length") - head, F.abs("x"))).alias("last"), F.max("at").alias("at"), F.max("length").alias("length")
    )
    seen = ends.select(REC, ((F.col("at") <= F.greatest(F.lit(1), F.floor(F.col("length") / 8))) & (F.col("first") > 0) & (F.col("last") < F.col("first"))).alias("ir_detected"))
    fit = s.fit(-5, -35).select(REC, "r2")
    low = s.energies.select(REC, (F.col("top") - F.col("low")).alias("range"))
    out = q.join(snr, REC).join(seen, REC).join(fit, REC).join(low, REC)
    weak = F.col("ir_detected") & ((F.col("range") < 35) | F.coalesce(F.col("r2") < 0.85, F.lit(False)))
    return out.select(REC, "clipping", "dc_offset_excessive", "snr_confidence_low", "ir_detected", weak.alias("ir_tail_low_snr"))
