"""Signal routines on NumPy arrays, for the steps that SQL expressions cannot say: transforms, filters, peaks."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

#: The two biquads of K-weighting at 48 kHz (ITU-R BS.1770).
K_SHELF = ((1.53512485958697, -2.69169618940638, 1.19839281085285), (1.0, -1.69065929318241, 0.73248077421585))
K_HIGHPASS = ((1.0, -2.0, 1.0), (1.0, -1.99004745483398, 0.99007225036621))
K_RATE = 48000
K_TAPS = 4096


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft_magnitude(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """frames x bins: magnitudes of the windowed frames that fit whole, scaled by the window's sum, plus 1e-12."""
    if len(x) < size:
        return np.empty((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    w = hann(size)
    return np.abs(np.fft.rfft(frames * w, axis=1)) / w.sum() + 1e-12


def recurrence(b: tuple, a: tuple, x: np.ndarray) -> np.ndarray:
    """The output of a recursive filter for one input row."""
    order = max(len(a), len(b)) - 1
    b, a = np.r_[b, np.zeros(order + 1 - len(b))] / a[0], np.r_[a, np.zeros(order + 1 - len(a))] / a[0]
    state = [0.0] * order
    out = []
    bl, al = b.tolist(), a.tolist()
    for v in x.tolist():
        y = bl[0] * v + state[0]
        for i in range(order - 1):
            state[i] = bl[i + 1] * v + state[i + 1] - al[i + 1] * y
        state[-1] = bl[order] * v - al[order] * y
        out.append(y)
    return np.array(out)


@lru_cache(maxsize=2)
def k_taps(n: int = K_TAPS) -> np.ndarray:
    """Impulse response of K-weighting, cut where it has decayed."""
    unit = np.zeros(n)
    unit[0] = 1
    return recurrence(*K_HIGHPASS, recurrence(*K_SHELF, unit))


def fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Causal convolution of the same length, by FFT."""
    if not len(x):
        return x
    n = 1 << (len(x) + len(taps) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(taps, n), n)[: len(x)]


@lru_cache(maxsize=8)
def polyphase_taps(up: int, down: int) -> np.ndarray:
    """Windowed sinc of half length 10 max(up, down) under a Kaiser window of 5, of unit gain, times ``up``."""
    most = max(up, down)
    half = 10 * most
    m = np.arange(-half, half + 1)
    h = np.sinc(m / most) / most * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Rational resampling to ceil(n target / source) samples: each is a sum over the few taps that fall on samples."""
    g = gcd(source, target)
    up, down = target // g, source // g
    if up == down:
        return x.astype(float)
    h = polyphase_taps(up, down)
    half = (len(h) - 1) // 2
    at = np.arange(-(-len(x) * up // down)) * down  # places on the fine grid
    first = -((half - at) // up)  # the first sample that a tap falls on
    reach = 2 * half // up + 1
    padded = np.concatenate([np.zeros(reach + 1), np.asarray(x, float), np.zeros(reach + 1)])
    taps = np.concatenate([h, np.zeros(up * (reach + 1))])
    out = np.zeros(len(at))
    for k in range(reach):
        i = first + k
        tap = at - i * up + half
        out += padded[np.clip(i + reach + 1, 0, len(padded) - 1)] * np.where(tap >= 0, taps[np.maximum(tap, 0)], 0.0)
    return out


def butter_bandpass(low: float, high: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth band-pass; edges as fractions of the Nyquist frequency."""
    w1, w2 = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    band, centre = w2 - w1, np.sqrt(w1 * w2)
    p = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * band / 2
    root = np.sqrt(p**2 - centre**2)
    poles = np.concatenate([p + root, p - root])
    gain = band**order * np.real(np.prod(np.full(order, 4.0)) / np.prod(4 - poles))
    z = np.concatenate([np.ones(order), -np.ones(order)])
    return np.real(gain * np.poly(z)), np.real(np.poly((4 + poles) / (4 - poles)))


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension and steady-state starts."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError("signal shorter than the padding")
    order = len(a) - 1
    m = np.eye(order) - np.vstack([-a[1:] / a[0], np.eye(order)[:-1]]).T
    zi = np.linalg.solve(m, b[1:] - a[1:] * b[0])

    def run(v: np.ndarray) -> np.ndarray:
        state = (zi * v[0]).tolist()
        bl, al, out = b.tolist(), a.tolist(), []
        for u in v.tolist():
            y = bl[0] * u + state[0]
            for i in range(order - 1):
                state[i] = bl[i + 1] * u + state[i + 1] - al[i + 1] * y
            state[-1] = bl[order] * u - al[order] * y
            out.append(y)
        return np.array(out)

    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return run(run(wide)[::-1])[::-1][pad:-pad]


def decay_db(ir: np.ndarray) -> np.ndarray:
    """Backward-integrated energy decay in decibels."""
    x = np.nan_to_num(ir, nan=0.0, posinf=0.0, neginf=0.0)
    top = np.abs(x).max() if len(x) else 0.0
    e = np.cumsum((x / top if top > 0 else x)[::-1] ** 2)[::-1]
    return 10 * np.log10(np.maximum(e / max(e[0], 1e-20), 1e-12)) if len(e) else e


def decay_time(decay: np.ndarray, rate: float, start: float, stop: float) -> float:
    """Seconds for 60 dB by a line through the decay between two levels; NaN for fewer than 8 points or a rising line."""
    at = np.flatnonzero((decay <= start) & (decay >= stop))
    if len(at) < 8:
        return float("nan")
    t = at / rate
    d = t - t.mean()
    slope = float((d * decay[at]).sum() / (d * d).sum())
    return -60 / slope if slope < 0 else float("nan")


def peaks(x: np.ndarray, distance: int, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (middles of plateaus) at least ``distance`` apart, higher ones first, of at least ``prominence``; and their prominences."""
    n = len(x)
    tops = []
    i = 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    at = np.array(tops, int)
    kept = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1] if len(at) else ():
        if kept[k]:
            near = (np.abs(at - at[k]) < distance) & (np.arange(len(at)) != k)
            kept[near] = False
    at = at[kept]
    height = np.empty(len(at))
    for k, p in enumerate(at):
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        lo = x[left[-1] + 1 if len(left) else 0 : p + 1].min()
        hi = x[p : p + 1 + right[0] if len(right) else n].min()
        height[k] = x[p] - max(lo, hi)
    ok = height >= prominence
    return at[ok], height[ok]


def delay_by_phase(a: np.ndarray, b: np.ndarray, rate: float, most_s: float = 0.001) -> np.ndarray:
    """Delay in seconds between rows of two arrays of frames, from the whitened cross-spectrum."""
    n = 1
    while n < 2 * a.shape[1]:
        n *= 2
    r = np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
    c = np.fft.irfft(r / np.maximum(np.abs(r), 1e-12), n)
    most = int(most_s * rate)
    lags = np.arange(-most, most + 1)
    return lags[np.argmax(np.round(c[:, lags % n], 12), axis=1)] / rate


def strongest_correlation(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Largest absolute normalised cross-correlation of rows within ``most`` samples of lag."""
    a = a - a.mean(1, keepdims=True)
    b = b - b.mean(1, keepdims=True)
    n = a.shape[1]
    den = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-12
    best = np.zeros(len(a))
    for lag in range(-min(most, n - 1), min(most, n - 1) + 1):
        c = (a[:, max(0, lag) : n + min(0, lag)] * b[:, max(0, -lag) : n - max(0, lag)]).sum(1)
        best = np.maximum(best, np.abs(c) / den)
    return best


def mel_weights(rate: float, size: int, bands: int, low: float = 20.0) -> np.ndarray:
    """bands x bins triangles on the mel scale between whole bins; a triangle of no width is widened by a bin."""
    mel = np.linspace(2595 * np.log10(1 + low / 700), 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edge = np.floor((size + 1) * 700 * (10 ** (mel / 2595) - 1) / rate).astype(int)
    out = np.zeros((bands, size // 2 + 1))
    k = np.arange(size // 2 + 1)
    for i in range(bands):
        a = edge[i]
        b = max(edge[i + 1], a + 1)
        c = max(edge[i + 2], b + 1)
        out[i] = np.where((k >= a) & (k < b), (k - a) / (b - a), np.where((k >= b) & (k < c), (c - k) / (c - b), 0.0))
    return out
