"""Self-similarity along time and novelty by a checkerboard kernel, in a band around the diagonal."""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.functions.levels import dot, total


def centred(vectors: DataFrame) -> DataFrame:
    """i, u: vectors less their mean, of length 1 (zeros if they have none)."""
    mean = total(F.col("v")) / F.size("v")
    shifted = vectors.select("i", F.transform(F.col("v").cast("array<double>"), lambda x: x - mean).alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) + 1e-12
    return shifted.select("i", F.transform("v", lambda x: x / norm).alias("u"))


def band_similarity(vectors: DataFrame, width: int) -> DataFrame:
    """i, j, sim for abs(i - j) <= width: cosine of centred vectors, cut to [0, 1]. ``vectors``: i (consecutive numbers), v.

    An equi-join: the right side is shown at every place that it is within reach of.
    """
    u = centred(vectors)
    right = u.select(F.col("i").alias("j"), F.col("u").alias("w")).withColumn("i", F.explode(F.sequence(F.col("j") - width, F.col("j") + width)))
    return u.join(right, "i").select("i", "j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("u"), F.col("w")))).alias("sim"))


def kernel(half: int, scale: float = 0.5) -> list[tuple[int, int, float]]:
    """Places and weights of a Gaussian checkerboard of (2 half + 1) squared; its middle row and column are 0."""
    sigma = max(1e-6, half * scale)
    sign = lambda u, v: (u * v > 0) - (u * v < 0)
    return [(u, v, sign(u, v) * exp(-(u * u + v * v) / (2 * sigma * sigma))) for u in range(-half, half + 1) for v in range(-half, half + 1)]


def novelty_by(vectors: DataFrame, keys: list[str], size: int = 32, block: int = 4096) -> DataFrame:
    """keys, frame, novelty: per recording the kernel along the diagonal, negative values and the borders 0, divided by the recording's largest.

    ``vectors``: keys, i (consecutive numbers from 0 within a recording), v. Vectors are cut into blocks that are shown as many of their neighbours as the kernel
    reaches, so that each vector leaves its place about once and no task gets a whole long recording. ``size`` is that of the kernel; a recording too short for it gets a smaller one.
    """
    reach = max(2, size // 2)
    counts = vectors.groupBy(*keys).agg((F.max("i") + 1).alias("__n"))
    own, at = F.floor(F.col("i") / block), F.pmod("i", F.lit(block))
    places = F.filter(F.array(own, F.when(at < reach, own - 1), F.when(at >= block - reach, own + 1)), lambda b: b.isNotNull() & (b >= 0))
    shown = vectors.select(*keys, F.col("i").cast("long").alias("i"), F.col("v").cast("array<double>").alias("v")).withColumn("__b", F.explode(places)).join(counts, keys)
    kinds = ", ".join(f"`{n}` {t}" for n, t in shown.select(*keys).dtypes)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        number, n, i = int(g["__b"].iloc[0]), int(g["__n"].iloc[0]), g.i.to_numpy()
        half = min(reach, max(1, (n - 1) // 2))
        x = np.stack(g.v.to_numpy())
        x = x - x.mean(1, keepdims=True)
        u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        w = np.zeros((2 * half + 1, 2 * half + 1))
        for a, b, value in kernel(half):
            w[a + half, b + half] = value
        mine = np.flatnonzero((i // block == number))
        out = np.zeros(len(mine))
        inside = np.flatnonzero((i[mine] >= half) & (i[mine] < n - half))
        for part in np.array_split(inside, max(1, len(inside) // 256)):
            around = u[mine[part][:, None] + np.arange(-half, half + 1)]
            out[part] = np.maximum((np.clip(around @ around.transpose(0, 2, 1), 0, 1) * w).sum((1, 2)), 0)
        return g.iloc[mine][keys].assign(frame=i[mine], raw=out)

    raw = shown.groupBy(*keys, "__b").applyInPandas(score, f"{kinds}{', ' if keys else ''}frame long, raw double")
    top = raw.groupBy(*keys).agg(F.max("raw").alias("top"))
    return raw.join(top, keys).select(*keys, "frame", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0).alias("novelty"))


def novelty(vectors: DataFrame, size: int = 32) -> DataFrame:
    """frame, novelty of the vectors of one recording."""
    return novelty_by(vectors.select(F.lit(0).alias("of"), "i", "v"), ["of"], size).drop("of")
