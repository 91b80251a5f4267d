"""The WAV format: decoding, encoding, and clips as WAV files."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples x channels between -1 and 1, and the rate. PCM of 8, 16, 24 or 32 bits, or floats of 32 or 64."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if form[0] == 0xFFFE:
                form = (struct.unpack("<H", data[at + 32 : at + 34])[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size] if size != 0xFFFFFFFF else data[at + 8 :]
            break
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("no format chunk")
    kind, channels, rate, _, _, bits = form
    if channels < 1:
        raise ValueError("no channels")
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(body, f"<f{width}").astype(float)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif kind == 1 and bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / 2.0**23
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(body, f"<i{width}") / 2.0 ** (bits - 1)
    else:
        raise ValueError(f"format {kind} of {bits} bits is not supported")
    return x.reshape(-1, channels), rate


def encode(x: np.ndarray, rate: int, bits: int = 24) -> bytes:
    """A PCM WAV file of samples x channels."""
    x = np.atleast_2d(np.asarray(x, float))
    top = 2 ** (bits - 1)
    v = np.clip(np.rint(x * top), -top, top - 1).astype("<i4")
    body = {16: lambda: v.astype("<i2").tobytes(), 24: lambda: v.reshape(-1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 32: v.tobytes}[bits]()
    channels, width = x.shape[1], bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * width, channels * width, bits, b"data", len(body))
    return head + body + b"\0" * (len(body) % 2)


def clip_files(samples: DataFrame, rate: int, bits: int = 24) -> DataFrame:
    """clip_id, wav: the samples of each clip (clip_id, channel, n, x) as a file. A clip is bounded by the window it was cut by."""

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.pivot_table(index="n", columns="channel", values="x").sort_index().to_numpy()
        return pd.DataFrame({"clip_id": [key[0]], "wav": [encode(np.nan_to_num(x), rate, bits)]})

    kind = dict(samples.dtypes)["clip_id"]
    return samples.groupBy("clip_id").applyInPandas(pack, f"clip_id {kind}, wav binary")
