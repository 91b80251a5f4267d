"""Feature vectors of recordings: a log-mel spectrum and the shape of every frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.functions import dsp
from sonarlake.operators.metrics import REC, Source

SHAPE = ("spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_flatness", "spectral_rolloff_hz", "spectral_flux", "rms_linear", "zcr_ratio")


def feature_names(mels: int) -> list[str]:
    """Names of the positions of a vector."""
    return [f"log_mel_{i:03d}" for i in range(mels)] + list(SHAPE)


def concatenated(sets: list[DataFrame]) -> DataFrame:
    """Vectors of several sets under each other; columns that a set lacks are null. Names of positions stay with every vector."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def feature_vectors(s: Source, mels: int = 64) -> DataFrame:
    """recording_id, frame_idx, time_s (middle of the frame), matrix, feature_names: ``mels`` log-mel energies and seven values of shape per frame of the mean channel.

    Frames have the size and hop of the transforms; a recording shorter than a frame is padded to one. Frames are made in blocks, so that a long recording is
    spread over many tasks.
    """
    c = s.settings
    bank, freqs, window = dsp.mel_weights(c.rate, c.fft, mels), np.arange(c.fft // 2 + 1) * c.rate / c.fft, dsp.hann(c.fft)

    def compute(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, old = rows
        mag, before = (np.abs(np.fft.rfft(r * window, axis=1)) / window.sum() for r in (x, old))
        power, den = mag * mag, mag.sum(1) + 1e-12
        centroid = mag @ freqs / den
        bandwidth = np.sqrt((mag * (freqs - centroid[:, None]) ** 2).sum(1) / den)
        flatness = np.exp(np.log(np.maximum(mag, 1e-12)).mean(1)) / (mag.mean(1) + 1e-12)
        upto = np.cumsum(power, 1)
        rolloff = freqs[np.argmax(upto >= 0.85 * upto[:, -1:], 1)]
        flux = np.sqrt(((mag - before) ** 2).sum(1))
        turns = ((x[:, 1:] < 0) != (x[:, :-1] < 0)).mean(1)
        shape = np.stack([centroid, bandwidth, flatness, rolloff, flux, np.sqrt((x * x).mean(1)), turns], 1)
        return {"matrix": np.hstack([np.log1p(np.maximum(power @ bank.T, 1e-12)), shape])}

    rows = s.of_blocks("mono", c.fft, c.fft_hop, compute, "matrix array<double>", False, c.fft_hop, True)
    time = (F.col("frame") * c.fft_hop + c.fft / 2) / c.rate
    return rows.select(REC, F.col("frame").alias("frame_idx"), time.alias("time_s"), "matrix", F.array(*map(F.lit, feature_names(mels))).alias("feature_names"))
