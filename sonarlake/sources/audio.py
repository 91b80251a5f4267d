"""Decoding of audio by the kind of file: PCM in WAV, AIFF and CAF here, other kinds by a program where it is installed."""

from __future__ import annotations

import os
import shutil
import struct
import subprocess

import numpy as np

from sonarlake.sources.wav import decode as decode_wav

NATIVE = (".wav", ".wave", ".rf64", ".aif", ".aiff", ".aifc", ".caf")
FOREIGN = (".flac", ".mp3", ".m4a", ".aac", ".ogg", ".opus", ".wma", ".mp4", ".mov", ".mkv")
IMPULSES = (".sofa", ".h5", ".hdf5")


def pcm(body: bytes, bits: int, channels: int, order: str, floating: bool) -> np.ndarray:
    """Samples x channels between -1 and 1 of whole-number or floating samples; ``order`` is '<' or '>'."""
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    if floating and bits in (32, 64):
        x = np.frombuffer(body, f"{order}f{width}").astype(float)
    elif bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        a, b, c = (raw[:, i] for i in ((0, 1, 2) if order == "<" else (2, 1, 0)))
        x = ((a | b << 8 | c << 16) << 8 >> 8) / 2.0**23
    elif bits in (8, 16, 32):
        x = np.frombuffer(body, f"{order}i{width}") / 2.0 ** (bits - 1)
    else:
        raise ValueError(f"samples of {bits} bits are not supported")
    return x.reshape(-1, channels)


def _chunks(data: bytes, at: int, size: str):
    """(name, start, length) of the chunks of a file."""
    head = 4 + struct.calcsize(size)
    while at + head <= len(data):
        n = struct.unpack(size, data[at + 4 : at + head])[0]
        n = len(data) - at - head if n < 0 else n
        yield data[at : at + 4], at + head, n
        at += head + n + (n % 2 if size == ">I" else 0)


def decode_aiff(data: bytes) -> tuple[np.ndarray, int]:
    """Samples x channels and the rate of AIFF and uncompressed AIFF-C."""
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("no AIFF file")
    form, body = None, b""
    for name, at, n in _chunks(data, 12, ">I"):
        if name == b"COMM":
            channels, _, bits = struct.unpack(">hIh", data[at : at + 8])
            exponent, mantissa = struct.unpack(">HQ", data[at + 8 : at + 18])  # an 80-bit float
            form = channels, bits, int(round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446))), data[at + 18 : at + 22] if data[8:12] == b"AIFC" else b"NONE"
        elif name == b"SSND":
            body = data[at + 8 : at + n]
    if form is None or form[0] < 1:
        raise ValueError("no format chunk")
    channels, bits, rate, kind = form
    if kind not in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64"):
        raise ValueError(f"compression {kind!r} is not supported")
    return pcm(body, bits, channels, "<" if kind == b"sowt" else ">", kind.lower() in (b"fl32", b"fl64")), rate


def decode_caf(data: bytes) -> tuple[np.ndarray, int]:
    """Samples x channels and the rate of linear PCM in CAF."""
    if data[:4] != b"caff":
        raise ValueError("no CAF file")
    form, body = None, b""
    for name, at, n in _chunks(data, 8, ">q"):
        if name == b"desc":
            rate, kind, flags, _, _, channels, bits = struct.unpack(">d4sIIIII", data[at : at + 32])
            form = rate, kind, flags, channels, bits
        elif name == b"data":
            body = data[at + 4 : at + n]
    if form is None or form[1] != b"lpcm" or form[3] < 1:
        raise ValueError("no linear PCM")
    return pcm(body, form[4], form[3], "<" if form[2] & 2 else ">", bool(form[2] & 1)), int(form[0])


def decode_impulses(data: bytes) -> tuple[np.ndarray, int]:
    """Samples x receivers and the rate of an HDF5 file of impulse responses; needs h5py."""
    import io

    import h5py

    with h5py.File(io.BytesIO(data), "r") as f:
        ir = np.asarray(f["Data.IR"], float)
        rate = float(np.ravel(f["Data.SamplingRate"])[0]) if "Data.SamplingRate" in f else 48000.0
    if ir.ndim not in (2, 3):
        raise ValueError(f"impulse responses of rank {ir.ndim}")
    return (ir[0] if ir.ndim == 3 else ir).T, int(rate)


def _program(command: list[str], data: bytes) -> bytes:
    """What a program on the worker says to the bytes of a file; a ValueError where it is not installed or fails."""
    if shutil.which(command[0]) is None:
        raise ValueError(f"{command[0]} is not installed")
    done = subprocess.run(command, input=data, capture_output=True, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace")[-200:] or f"{command[0]} failed")
    return done.stdout


def probe(data: bytes) -> tuple[int, int]:
    """Channels and rate of the first audio stream of a file, as the probing program tells them."""
    said = _program(["ffprobe", "-v", "error", "-select_streams", "a:0", "-show_entries", "stream=sample_rate,channels", "-of", "default=noprint_wrappers=1", "-i", "pipe:0"], data).decode()
    told = dict(line.split("=", 1) for line in said.split() if "=" in line)
    return int(told["channels"]), int(told["sample_rate"])


def decode_foreign(data: bytes) -> tuple[np.ndarray, int]:
    """Samples x channels and the rate of a compressed file, which a program turns to WAV; nothing is written to disk, so files that must be sought in are refused."""
    return decode_wav(_program(["ffmpeg", "-v", "error", "-i", "pipe:0", "-map", "0:a:0", "-c:a", "pcm_f32le", "-f", "wav", "pipe:1"], data))


def decode(path: str, data: bytes) -> tuple[np.ndarray, int]:
    """Samples x channels and the rate, by the suffix of the path; a file that cannot be read is a ValueError."""
    suffix = os.path.splitext(path)[1].lower()
    try:
        if suffix in (".aif", ".aiff", ".aifc"):
            return decode_aiff(data)
        if suffix == ".caf":
            return decode_caf(data)
        if suffix in FOREIGN:
            return decode_foreign(data)
        if suffix in IMPULSES:
            return decode_impulses(data)
        return decode_wav(data)
    except (struct.error, KeyError, ImportError, OSError) as e:
        raise ValueError(str(e) or type(e).__name__) from e
