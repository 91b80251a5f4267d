"""The catalog of metrics: each is a function from a source of signals to a table of values, recording_id and v (and frame where it has one)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from math import ceil, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.functions import dsp
from sonarlake.functions.levels import FLOOR, db, dot, leq, power_db, summary_columns, weighting_db
from sonarlake.operators.frames import BLOCK, blocks, framed, frames_of_blocks, peaks_in_blocks, running_total, with_previous
from sonarlake.operators.percentiles import exact_percentiles
from sonarlake.plans.lineage import keep
from sonarlake.sources.signals import Settings, wide

REC = "recording_id"
_BY = "\x1f"  # between a recording and a channel


@dataclass
class Source:
    """Signals and settings that metrics are computed from.

    ``signal(k)`` gives recording_id, channel, n, x: of the first k channels, for 1 of their mean as one channel, for 0 of all channels. ``tone`` is the recorded
    calibration tone, if there is one; ``file_name`` stands for the recording_id where times are read from names. ``packer(which, before, after)`` gives blocks
    of samples as ``packed`` does, where a decoder makes them itself.
    """

    signal: Callable[[int], DataFrame]
    impulse: Callable[[], DataFrame]
    settings: Settings = field(default_factory=Settings)
    file_name: str | None = None
    tone: Callable[[], DataFrame] | None = None
    packer: Callable[[str, int, int], DataFrame] | None = None
    lateral_channels: int = 2  # channels that lateral energy is told from; 0 for all

    @cached_property
    def mono(self) -> DataFrame:
        return self.signal(1)

    @cached_property
    def every(self) -> DataFrame:
        return self.signal(0)

    @cached_property
    def two(self) -> DataFrame:
        """recording_id, n, x0, x1: the first two channels; of a recording with one channel that channel twice."""
        s = self.signal(2)
        w = s.groupBy(REC, "n").agg(*[F.max(F.when(F.col("channel") == c, F.col("x"))).alias(f"x{c}") for c in (0, 1)])
        top = s.groupBy(REC).agg(F.max("channel").alias("top"))  # a row per recording
        return w.join(top, REC).select(REC, "n", "x0", F.when(F.col("top") == 0, F.col("x0")).otherwise(F.col("x1")).alias("x1")).dropna(subset=["x0", "x1"])

    def packed(self, which: str, before: int, after: int) -> DataFrame:
        """Blocks of the 'mono' signal, or of 'every' channel (recording_id then ends with the channel), shown some samples of their neighbours."""
        if self.packer:
            return self.packer(which, before, after)
        return blocks(self.mono if which == "mono" else self.every.withColumn(REC, F.concat_ws(_BY, REC, "channel")), ["x"], before, after)

    def of_blocks(self, which: str, size: int, hop: int, compute: Callable, schema: str, tail: bool, back: int = 0, short: bool = False) -> DataFrame:
        """Frames of the blocks; of 'every' channel with the channel's recording as recording_id, a row per channel."""
        found = frames_of_blocks(self.packed(which, back, size), ["x"], size, hop, compute, schema, tail, back, short=short)
        return found.withColumn(REC, _recording()) if which == "every" else found

    @cached_property
    def lengths(self) -> DataFrame:
        """recording_id, length in samples, channels."""
        per = self.packed("every", 0, 0).groupBy(REC).agg(F.max("length").alias("length"))
        return per.groupBy(_recording().alias(REC)).agg(F.max("length").alias("length"), F.count("*").alias("channels"))

    @cached_property
    def levels(self) -> DataFrame:
        """Per frame: power, peak and mean magnitude over all channels, and the mean of the channels' effective values."""
        s = self.settings

        def compute(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
            x = rows[0]
            return {"p": np.einsum("ij,ij->i", x, x) / s.frame, "peak": np.abs(x).max(1), "a": np.abs(x).sum(1) / s.frame}

        per = self.of_blocks("every", s.frame, s.hop, compute, "p double, peak double, a double", True)
        return per.groupBy(REC, "frame").agg(F.avg("p").alias("power"), F.max("peak").alias("peak"), F.avg("a").alias("mean_abs"), F.avg(F.sqrt("p")).alias("rms_mean"))

    @cached_property
    def level_ranks(self) -> DataFrame:
        """Per recording: percentiles of the level of its frames."""
        return _ranks(_level(self), (0.1, 0.9))

    @cached_property
    def spl_ranks(self) -> DataFrame:
        """Per recording: percentiles of the sound pressure level of its frames."""
        return _ranks(_spl(self), (0.05, 0.1, 0.5, 0.9))

    def _of_spectra(self, compute: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """What ``compute`` tells from the magnitudes of frames and of the frames before them (the first frame has itself before it)."""
        w = dsp.hann(self.settings.fft)

        def run(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
            return compute(*(np.abs(np.fft.rfft(r * w, axis=1)) / w.sum() + 1e-12 for r in rows))

        return self.of_blocks("mono", self.settings.fft, self.settings.fft_hop, run, schema, False, self.settings.fft_hop, True)

    @cached_property
    def spectra(self) -> DataFrame:
        """Per frame: mag (array over bins)."""
        return self._of_spectra(lambda mag, _: {"mag": mag}, "mag array<double>")

    @cached_property
    def shapes(self) -> DataFrame:
        """Per frame: centroid, bandwidth, flatness, rolloff, novelty (rises), flux2 (length of the difference), change (sum of absolute differences), whole (sum of magnitudes) and
        bio (of those from 2 to 8 kHz)."""
        step = self.settings.rate / self.settings.fft
        freqs = np.arange(self.settings.fft // 2 + 1) * step
        middle = (freqs >= 2000.0) & (freqs <= 8000.0)

        def compute(mag: np.ndarray, old: np.ndarray) -> dict[str, np.ndarray]:
            d, whole = mag - old, mag.sum(1)
            den = whole + FLOOR
            centroid = mag @ freqs / den
            upto = np.cumsum(mag * mag, axis=1)
            # rounded, since sums in another order differ in their last places
            reached = np.round(upto, 12) >= np.round(0.85 * upto[:, -1:], 12)
            return {
                "centroid": centroid, "bandwidth": np.sqrt((mag * (freqs - centroid[:, None]) ** 2).sum(1) / den), "flatness": np.exp(np.log(mag).mean(1)) / (mag.mean(1) + FLOOR), "rolloff": np.argmax(reached, axis=1) * step,
                "novelty": np.maximum(d, 0).sum(1), "flux2": np.sqrt((d * d).sum(1)), "change": np.abs(d).sum(1), "whole": whole, "bio": mag[:, middle].sum(1),
            }

        return self._of_spectra(compute, "centroid double, bandwidth double, flatness double, rolloff double, novelty double, flux2 double, change double, whole double, bio double")

    @cached_property
    def bins(self) -> DataFrame:
        """Long spectra: frame, bin, f, p (squared magnitude)."""
        s = self.settings
        return self.spectra.select(REC, "frame", F.posexplode("mag").alias("bin", "m")).select(REC, "frame", "bin", (F.col("bin") * s.rate / s.fft).alias("f"), (F.col("m") * F.col("m")).alias("p"))

    @cached_property
    def mean_bins(self) -> DataFrame:
        """Mean power over time per bin."""
        return self.bins.groupBy(REC, "bin", "f").agg(F.avg("p").alias("p"))

    def bands(self, fraction: int) -> DataFrame:
        """recording_id, frame, band, centre, level: fractional octave bands by a range join with the (generated, small) table of bands."""
        s = self.settings
        spark = self.mono.sparkSession
        centres = []
        f = 31.5 if fraction == 1 else 25.0
        while f <= s.rate / 2 * 0.98:
            centres.append(f)
            f *= 2 ** (1 / fraction)
        half = 2 ** (1 / (2 * fraction))
        table = spark.createDataFrame([(i, c, c / half, c * half) for i, c in enumerate(centres)], "band int, centre double, lo double, hi double")
        # as many rows as an octave scale has bands below the Nyquist frequency
        mine = self.bins.join(F.broadcast(table), (F.col("f") >= F.col("lo")) & (F.col("f") < F.col("hi")))
        held = mine.groupBy(REC, "frame", "band").agg(F.avg("p").alias("bp"))
        every = self.spectra.select(REC, "frame", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(c).alias("centre")) for i, c in enumerate(centres)])).alias("b")).select(REC, "frame", "b.band", "b.centre")
        return every.join(held, [REC, "frame", "band"], "left").withColumn("level", F.when(F.col("bp").isNull(), F.lit(-120.0)).otherwise(power_db(F.col("bp"))))

    @cached_property
    def stereo(self) -> DataFrame:
        """Per short frame of the first two channels: iacc, ipd, itd."""
        s = self.settings

        def compute(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
            a, b = rows
            cross = (np.fft.rfft(a, axis=1) * np.conj(np.fft.rfft(b, axis=1))).sum(1)
            return {"iacc": dsp.strongest_correlation(a, b, int(0.001 * s.rate)), "ipd": np.angle(cross), "itd": dsp.delay_by_phase(a, b, s.rate)}

        packed = blocks(self.two, ["x0", "x1"], 0, s.fft)
        return frames_of_blocks(packed, ["x0", "x1"], s.fft, s.fft_hop, compute, "iacc double, ipd double, itd double", True)

    @cached_property
    def pairs(self) -> DataFrame:
        """Per frame of the first two channels: means of values, squares and products."""
        s = self.settings

        def compute(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
            return products(rows, s.frame)

        return frames_of_blocks(blocks(self.two, ["x0", "x1"], 0, s.frame), ["x0", "x1"], s.frame, s.hop, compute, "a double, b double, aa double, bb double, ab double", True)

    @cached_property
    def neighbours(self) -> DataFrame:
        """Per frame and pair of adjacent channels: means of values, squares and products."""
        s = self.settings
        left = self.every.select(F.concat_ws(_BY, REC, "channel").alias(REC), "n", F.col("x").alias("x0"))
        right = self.every.where("channel > 0").select(F.concat_ws(_BY, REC, F.col("channel") - 1).alias(REC), "n", F.col("x").alias("x1"))

        def compute(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
            return products(rows, s.frame)

        both = blocks(left.join(right, [REC, "n"]), ["x0", "x1"], 0, s.frame)
        return frames_of_blocks(both, ["x0", "x1"], s.frame, s.hop, compute, "a double, b double, aa double, bb double, ab double", True).withColumn(REC, _recording())

    def weighted(self, curve: str) -> DataFrame:
        """Per short frame: level of the mean of the channels' effective values under a frequency weighting, by Parseval's identity over the unwindowed spectrum."""
        s = self.settings
        n = s.fft

        def compute(rows: list[np.ndarray]) -> dict[str, np.ndarray]:
            return {"e": np.abs(np.fft.rfft(rows[0], axis=1)) ** 2}

        spec = self.of_blocks("every", n, s.fft_hop, compute, "e array<double>", True)
        gains = F.array(*[(1.0 if k in (0, n // 2) else 2.0) * F.pow(F.lit(10.0), weighting_db(F.lit(k * s.rate / n), curve) / 10) for k in range(n // 2 + 1)])
        return spec.groupBy(REC, "frame").agg(F.avg(F.sqrt(dot(F.col("e"), gains)) / n).alias("r")).select(REC, "frame", (db(F.col("r")) + s.spl_offset).alias("v"))

    @cached_property
    def tail(self) -> DataFrame:
        """The impulse response from its strongest sample on: recording_id, n (from 0), x, e, decay (dB)."""
        s = self.settings
        signal = self.impulse()
        top = signal.groupBy(REC).agg(F.min_by("n", F.struct(-F.abs("x"), F.col("n"))).alias("at"), (F.max("n") + 1).alias("length"), F.max(F.abs("x")).alias("top"))
        first = F.when(F.col("length") - F.col("at") < max(16, int(0.1 * s.rate)), F.lit(0)).otherwise(F.col("at"))
        ir = signal.join(top.withColumn("first", first), REC).where(F.col("n") >= F.col("first"))
        ir = ir.select(REC, (F.col("n") - F.col("first")).alias("n"), "x", (F.col("x") * F.col("x")).alias("e"))
        rest = running_total(ir, [REC], "n", "e", "rest", backward=True)
        whole = ir.groupBy(REC).agg(F.greatest(F.sum("e"), F.lit(1e-20)).alias("whole"))
        return rest.join(whole, REC).withColumn("decay", power_db(F.col("rest") / F.col("whole")))

    def fit(self, start: float, stop: float) -> DataFrame:
        """Line through a stretch of the decay: points, slope, intercept, r2, v (seconds for 60 dB, null for fewer than 8 points or a rising line)."""
        s = self.settings
        inside = self.tail.where((F.round("decay", 9) <= start) & (F.round("decay", 9) >= stop)).withColumn("t", F.col("n") / s.rate)
        sums = inside.groupBy(REC).agg(F.count("*").alias("points"), F.regr_slope("decay", "t").alias("slope"), F.regr_intercept("decay", "t").alias("intercept"), F.regr_r2("decay", "t").alias("r2"))
        every = self.tail.groupBy(REC).agg(F.lit(1).alias("one")).drop("one")
        return every.join(sums, REC, "left").withColumn("v", F.when((F.col("points") >= 8) & (F.col("slope") < 0), -60 / F.col("slope")))

    @cached_property
    def energies(self) -> DataFrame:
        """Energy of the impulse response: all, within 50 and 80 ms, and weighted by time."""
        s = self.settings
        within = lambda sec: F.sum(F.when(F.col("n") < max(1, round(sec * s.rate)), F.col("e")).otherwise(0.0))
        return self.tail.groupBy(REC).agg(F.sum("e").alias("e"), within(0.05).alias("e50"), within(0.08).alias("e80"), F.sum(F.col("e") * F.col("n") / s.rate).alias("te"), F.max("decay").alias("top"), F.min("decay").alias("low"))

    @cached_property
    def slots(self) -> DataFrame:
        """K-weighted energy of every tenth of a second, summed over the channels: recording_id, slot, s, length (samples at 48 kHz)."""
        rate, native = dsp.K_RATE, self.settings.rate
        g = gcd(rate, native)
        up, down = rate // g, native // g
        hop = round(0.1 * rate)
        around = 10 * max(up, down) // up + 2  # what resampling sees on both sides
        before, after = ceil(dsp.K_TAPS * native / rate) + 2 * around, around

        def filtered(batches):
            for b in batches:
                for i in range(b.num_rows):
                    length, first, number = (b[c][i].as_py() for c in ("length", "first", "block"))
                    x = b["x"][i].values.to_numpy(zero_copy_only=False)
                    lead = -(-first // down) * down - first  # whole samples stay whole after resampling
                    y = dsp.resample(x[lead:], native, rate) if up != down else x
                    at = (first + lead) // down * up if up != down else first
                    # resampling of a cut is off near the cut, and the filter long after it; neither is kept
                    own, stop, end = (-(-n * up // down) for n in (number * BLOCK, (number + 1) * BLOCK, length))
                    y = dsp.fir(y, dsp.k_taps())[own - at : min(stop, end) - at]
                    slot = (np.arange(len(y)) + own) // hop
                    if len(y):
                        s = np.bincount(slot - slot[0], y * y)
                        n = len(s)
                        yield pa.RecordBatch.from_arrays([pa.array([b["recording_id"][i].as_py()] * n), pa.array(np.full(n, end)), pa.array(np.arange(n) + slot[0]), pa.array(s)], [REC, "length", "slot", "s"])

        found = self.packed("every", before, after).mapInArrow(filtered, f"{REC} string, length long, slot long, s double")
        return found.groupBy(_recording().alias(REC), "slot").agg(F.sum("s").alias("s"), F.max("length").alias("length"))

    def loudness(self, win_s: float) -> DataFrame:
        """Blocks of K-weighted energy every 0.1 s: recording_id, frame, e (sum over the channels of their mean squares), v (LUFS)."""
        size, hop = round(win_s * dsp.K_RATE), round(0.1 * dsp.K_RATE)
        k = size // hop
        last = F.greatest(F.lit(0), F.floor((F.col("length") - size) / hop))
        lo = F.greatest(F.lit(0), F.col("slot") - k + 1)
        hi = F.least(F.col("slot"), last)
        spread = self.slots.withColumn("frame", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
        e = spread.groupBy(REC, "frame").agg((F.sum("s") / size).alias("e"))
        return e.withColumn("v", -0.691 + power_db(F.col("e")))

    @cached_property
    def quality(self) -> DataFrame:
        """Per recording, over all channels: clipping ratio, offset, share of finite samples, peak."""

        def count(batches):
            for b in batches:
                offsets, x = b["x"].offsets.to_numpy(), b["x"].values.to_numpy(zero_copy_only=False)
                rows = [x[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
                sums = [(len(r), int((np.abs(r) >= 0.999).sum()), float(r[np.isfinite(r)].sum()), int(np.isfinite(r).sum()), float(np.abs(r).max(initial=0.0))) for r in rows]
                yield pa.RecordBatch.from_arrays([b[REC], *(pa.array(c) for c in zip(*sums))] if sums else [b[REC], *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()))], [REC, "n", "c", "s", "f", "p"])

        sums = self.packed("every", 0, 0).select(REC, "x").mapInArrow(count, f"{REC} string, n long, c long, s double, f long, p double").groupBy(_recording().alias(REC))
        return sums.agg((F.sum("c") / F.sum("n")).alias("clipping_ratio"), (F.sum("s") / F.sum("f")).alias("dc_offset"), (F.sum("f") / F.sum("n")).alias("finite"), F.max("p").alias("peak"))

    @cached_property
    def octaves(self) -> DataFrame:
        return self.bands(1)

    @cached_property
    def thirds(self) -> DataFrame:
        return self.bands(3)

    @cached_property
    def level_a(self) -> DataFrame:
        return self.weighted("A")

    @cached_property
    def level_c(self) -> DataFrame:
        return self.weighted("C")

    @cached_property
    def b_format(self) -> DataFrame:
        """Per recording with four channels: products of the first with the others, and energy."""
        found = wide(self.signal(4), 4).groupBy(REC).agg(*[F.avg(F.col("x0") * F.col(f"x{i}")).alias(f"i{i}") for i in (1, 2, 3)], F.avg(sum((F.col(f"x{i}") ** 2 for i in range(4)), F.lit(0.0))).alias("e"))
        return self.lengths.select(REC).join(found, REC, "left")

    @cached_property
    def lateral(self) -> DataFrame:
        """Per recording: energy between 5 and 80 ms, that of all channels but the first (null without any), and their mean correlation with the first."""
        n0, n1 = round(0.005 * self.settings.rate), round(0.08 * self.settings.rate)
        early = self.signal(self.lateral_channels).where((F.col("n") >= n0) & (F.col("n") < n1))
        first = early.where("channel = 0").select(REC, "n", F.col("x").alias("x0"))
        # rows are the samples of 75 ms
        m = early.join(first, [REC, "n"]).groupBy(REC, "channel").agg(*[F.avg(e).alias(k) for k, e in {"a": F.col("x0"), "b": F.col("x"), "aa": F.col("x0") ** 2, "bb": F.col("x") ** 2, "ab": F.col("x0") * F.col("x")}.items()], F.sum(F.col("x") ** 2).alias("e"))
        side = F.col("channel") > 0
        return m.withColumn("r", F.abs(_correlation())).groupBy(REC).agg(F.sum("e").alias("e"), F.sum(F.when(side, F.col("e"))).alias("side"), F.avg(F.when(side, F.col("r"))).alias("r"))

    @cached_property
    def silence(self) -> DataFrame:
        """Per recording: shares of frames that are dropped out or silent."""
        quiet = F.col("mean_abs") < 1e-4
        return self.levels.groupBy(REC).agg(F.avg((quiet & (F.sqrt("power") < 1e-4)).cast("double")).alias("dropout"), F.avg(quiet.cast("double")).alias("silence"))


def products(rows: list[np.ndarray], size: int) -> dict[str, np.ndarray]:
    """Means of two rows of frames, of their squares and of their product."""
    x, y = rows
    return {"a": x.sum(1) / size, "b": y.sum(1) / size, "aa": (x * x).sum(1) / size, "bb": (y * y).sum(1) / size, "ab": (x * y).sum(1) / size}


def _recording() -> Column:
    """The recording of a channel's blocks."""
    return F.regexp_replace(F.col(REC), _BY + "[0-9]+$", "")


def _ranks(values: DataFrame, ps: tuple[float, ...]) -> DataFrame:
    """Exact percentiles of v for every recording of ``values``, null where it has no finite one; a long recording is spread over many tasks."""
    every = values.groupBy(REC).agg(F.lit(1).alias("one")).drop("one")
    return every.join(exact_percentiles(values, [REC], "v", ps), REC, "left")


def _level(s: Source) -> DataFrame:
    return s.levels.select(REC, "frame", db(F.sqrt("power")).alias("v"))


def _spl(s: Source) -> DataFrame:
    return s.levels.select(REC, "frame", (db(F.col("rms_mean")) + s.settings.spl_offset).alias("v"))


def _exceeded(percent: int) -> Callable[[Source], DataFrame]:
    return lambda s: s.spl_ranks.select(REC, F.col(f"p{100 - percent:02d}").alias("v"))


def _exposure(levels: DataFrame, s: Source) -> DataFrame:
    seconds = s.lengths.select(REC, (F.col("length") / s.settings.rate).alias("sec"))
    return levels.groupBy(REC).agg(leq(F.col("v")).alias("q")).join(seconds, REC).select(REC, (F.col("q") + 10 * F.log10(F.greatest(F.col("sec"), F.lit(FLOOR)))).alias("v"))


def _snr(s: Source) -> DataFrame:
    return s.level_ranks.select(REC, (F.col("p90") - F.col("p10")).alias("v"))


def _shape(column: str) -> Callable[[Source], DataFrame]:
    return lambda s: s.shapes.select(REC, "frame", F.col(column).alias("v"))


def _zero_crossings(s: Source) -> DataFrame:
    c = s.settings
    mono = s.mono.groupBy(REC, "n").agg(F.avg("x").alias("x"))
    turned = with_previous(mono, [REC], "n", {"x": "before"}).withColumn("turn", F.coalesce((F.signum("x") != F.signum("before")).cast("int"), F.lit(0)))
    return framed(turned, c.frame, c.hop).groupBy(REC, "frame").agg((F.sum(F.when(F.col("n") > F.col("start"), F.col("turn")).otherwise(0)) / c.frame).alias("v"))


def _z(values: DataFrame) -> DataFrame:
    stats = values.groupBy(REC).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    return values.join(stats, REC).select(REC, "frame", ((F.col("v") - F.col("mu")) / (F.col("sd") + FLOOR)).alias("v"))


def _anomaly(s: Source) -> DataFrame:
    cols = ["centroid", "bandwidth", "flatness", "rolloff", "novelty"]
    stats = s.shapes.groupBy(REC).agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    parts = [F.pow((F.col(c) - F.col(f"mu_{c}")) / (F.col(f"sd_{c}") + FLOOR), F.lit(2)) for c in cols]
    return s.shapes.join(stats, REC).select(REC, "frame", F.sqrt(sum(parts[1:], parts[0])).alias("v"))


def _reconstruction(s: Source) -> DataFrame:
    """Residual of the three strongest directions of the standardised features; the 5 x 5 second moments are one aggregate."""
    cols = ["centroid", "bandwidth", "flatness", "rolloff", "novelty"]
    stats = s.shapes.groupBy(REC).agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    z = s.shapes.join(stats, REC).select(REC, "frame", *[((F.col(c) - F.col(f"mu_{c}")) / (F.col(f"sd_{c}") + FLOOR)).alias(c) for c in cols])
    moments = z.groupBy(REC).agg(F.array(*[F.avg(F.col(a) * F.col(b)) for a in cols for b in cols]).alias("m"))

    @F.pandas_udf("array<double>")
    def rest(m: pd.Series) -> pd.Series:
        out = []
        for x in m:
            _, v = np.linalg.eigh(np.asarray(x).reshape(5, 5))
            out.append((v[:, :2] @ v[:, :2].T).ravel())
        return pd.Series(out)

    away = moments.select(REC, rest("m").alias("r"))
    picked = [sum((F.col("r")[i * 5 + j] * F.col(b) for j, b in enumerate(cols)), F.lit(0.0)) for i in range(5)]
    return z.join(away, REC).select(REC, "frame", (sum((p * p for p in picked), F.lit(0.0)) / 5).alias("v"))


def _change_point(s: Source) -> DataFrame:
    z = _z(_shape("novelty")(s))
    top = peaks_in_blocks(z, [REC], "frame", "v", max(1, s.settings.fft_hop // 256), 1.0).groupBy(REC).agg(F.max("prominence").alias("p"))
    every = z.groupBy(REC).agg(F.lit(1).alias("one"))
    return every.join(top, REC, "left").select(REC, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") / 8)), F.lit(0.0)).alias("v"))


def _ndsi(s: Source) -> DataFrame:
    top = min(11000.0, s.settings.rate / 2)
    within = lambda lo, hi: F.sum(F.when((F.col("f") >= lo) & (F.col("f") < hi), F.col("p")).otherwise(0.0))
    return s.bins.groupBy(REC).agg(within(2000.0, top).alias("b"), within(1000.0, 2000.0).alias("a")).select(REC, ((F.col("b") - F.col("a")) / (F.col("b") + F.col("a") + FLOOR)).alias("v"))


def _occupancy(diversity: bool) -> Callable[[Source], DataFrame]:
    def make(s: Source) -> DataFrame:
        edges = np.arange(1000.0, min(10000.0, s.settings.rate / 2) + 1000.0, 1000.0)
        k = len(edges) - 1
        slot = F.floor((F.col("f") - 1000) / 1000)
        sums = s.mean_bins.where((F.col("f") >= 1000) & (F.col("f") < edges[-1])).groupBy(REC, slot.alias("slot")).agg(F.sum("p").alias("p"))
        whole = sums.groupBy(REC).agg(F.sum("p").alias("w"), F.count("*").alias("held"))
        q = sums.join(whole, REC).withColumn("q", F.col("p") / F.col("w"))
        if diversity:
            return q.groupBy(REC).agg((-F.sum(F.col("q") * F.ln(F.col("q") + FLOOR)) / float(np.log(k))).alias("v"))
        return q.groupBy(REC).agg((1 / (F.sum(F.col("q") * F.col("q") + FLOOR) + (k - F.max("held")) * FLOOR) / k).alias("v"))

    return make


def _entropy(s: Source) -> DataFrame:
    n = s.settings.fft // 2 + 1
    whole = s.mean_bins.groupBy(REC).agg(F.sum("p").alias("w"))
    share = s.mean_bins.join(whole, REC).withColumn("q", F.col("p") / (F.col("w") + FLOOR))
    hf = share.groupBy(REC).agg((-F.sum(F.col("q") * F.ln(F.col("q") + FLOOR)) / float(np.log(n + FLOOR))).alias("hf"))
    env = s.mono.groupBy(REC, "n").agg(F.abs(F.avg("x")).alias("a"))
    top = env.groupBy(REC).agg(F.greatest(F.max("a"), F.lit(FLOOR)).alias("top"), F.count("*").alias("all"))
    slot = F.least(F.lit(63), F.floor(F.round(F.col("a") / F.col("top") * 64, 9)))
    hist = env.join(top, REC).groupBy(REC, slot.alias("slot")).agg((F.count("*") / (F.max("all") + FLOOR)).alias("q"))
    ht = hist.groupBy(REC).agg((-F.sum(F.col("q") * F.ln(F.col("q") + FLOOR)) / float(np.log(64 + FLOOR))).alias("ht"))
    return hf.join(ht, REC).select(REC, (F.col("hf") * F.col("ht")).alias("v"))


def _trends(s: Source) -> DataFrame:
    t = (F.col("frame") * s.settings.fft_hop + s.settings.fft / 2) / s.settings.rate
    fits = s.octaves.withColumn("t", t).groupBy(REC, "band").agg(F.regr_slope("level", "t").alias("slope"), F.stddev_pop("level").alias("sd"))
    return fits.select(REC, F.col("band").alias("frame"), F.when(F.col("sd") > FLOOR, F.col("slope")).otherwise(0.0).alias("v"))


def _band_levels(fraction: int) -> Callable[[Source], DataFrame]:
    return lambda s: (s.octaves if fraction == 1 else s.thirds).groupBy(REC, F.col("band").alias("frame")).agg(leq(F.col("level")).alias("v"))


def _correlation() -> Column:
    """Correlation of two rows from their means; 0 where one of them does not vary."""
    va, vb = F.col("aa") - F.col("a") * F.col("a"), F.col("bb") - F.col("b") * F.col("b")
    r = (F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(F.greatest(va * vb, F.lit(1e-300)))
    return F.when((va < 1e-24) | (vb < 1e-24), 0.0).otherwise(r)


def _coherence(s: Source) -> DataFrame:
    """Mean over the pairs of adjacent channels; 1 for a single channel."""
    held = s.neighbours.groupBy(REC, "frame").agg(F.avg(_correlation()).alias("v"))
    return s.levels.select(REC, "frame").join(held, [REC, "frame"], "left").select(REC, "frame", F.coalesce("v", F.lit(1.0)).alias("v"))


def _level_difference(s: Source) -> DataFrame:
    return s.pairs.select(REC, "frame", (20 * F.log10(F.greatest(F.sqrt("aa"), F.lit(FLOOR)) / F.greatest(F.sqrt("bb"), F.lit(FLOOR)))).alias("v"))


def _stereo(column: str) -> Callable[[Source], DataFrame]:
    return lambda s: s.stereo.select(REC, "frame", F.col(column).alias("v"))


def bearing(delay: Column, spacing: float) -> Column:
    """Angle in degrees of a plane wave that reaches two microphones with a delay."""
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), delay * 343.0 / max(spacing, FLOOR)))))


def _doa(s: Source) -> DataFrame:
    return s.stereo.groupBy(REC).agg(F.avg("itd").alias("d")).select(REC, bearing(F.col("d"), s.settings.mic_spacing_m).alias("v"))


def _ambisonic(part: str) -> Callable[[Source], DataFrame]:
    def make(s: Source) -> DataFrame:
        flat = F.sqrt(F.col("i1") ** 2 + F.col("i2") ** 2)
        v = {
            "diffuseness": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(F.col("i1") ** 2 + F.col("i2") ** 2 + F.col("i3") ** 2) / (F.col("e") + FLOOR))),
            "azimuth": F.degrees(F.atan2("i2", "i1")), "elevation": F.degrees(F.atan2(F.col("i3"), flat + FLOOR)),
        }[part]
        return s.b_format.select(REC, F.when(F.col("e").isNotNull(), v).alias("v"))

    return make


def _lateral(correlated: bool) -> Callable[[Source], DataFrame]:
    """Energy of all channels but the first between 5 and 80 ms, as a share; null for a single channel."""

    def make(s: Source) -> DataFrame:
        lf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("side") / (F.col("e") + FLOOR)))
        return s.lateral.select(REC, F.when(F.col("side").isNotNull(), lf * F.col("r") if correlated else lf).alias("v"))

    return make


def _energy(make: Callable[[], Column]) -> Callable[[Source], DataFrame]:
    return lambda s: s.energies.select(REC, make().alias("v"))


def _ratio_db(early: str, floor: float = 1e-20) -> Column:
    return 10 * F.log10(F.col(early) / F.greatest(F.col("e") - F.col(early), F.lit(floor)))


def _sti(s: Source) -> DataFrame:
    c50 = s.energies.select(REC, _ratio_db("e50", FLOOR).alias("c50"))
    snr = _snr(Source(lambda _: s.impulse(), s.impulse, s.settings)).withColumnRenamed("v", "snr")
    rt = s.fit(-5, -35).select(REC, F.coalesce("v", F.lit(1.0)).alias("rt"))
    v = 1 / (1 + F.exp(-(F.col("c50") - 2) / 2)) / (1 + F.exp(-(F.col("snr") - 6) / 4)) * F.exp(-F.greatest(F.col("rt") - 0.6, F.lit(0.0)) / 1.8)
    return c50.join(snr, REC).join(rt, REC).select(REC, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("v"))


def _bass(s: Source) -> DataFrame:
    """Sequential filters need a recording's whole impulse response, which is bounded by the length of a decay."""
    c = s.settings

    def ratio(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("n").x.to_numpy()
        rt = []
        for f in (125.0, 250.0, 500.0, 1000.0):
            lo, hi = max(20.0, f / 2**0.5), min(c.rate * 0.49, f * 2**0.5)
            try:
                rt.append(dsp.decay_time(dsp.decay_db(dsp.zero_phase(*dsp.butter_bandpass(2 * lo / c.rate, 2 * hi / c.rate), x)), c.rate, -5, -35))
            except ValueError:
                rt.append(float("nan"))
        low, high = np.nansum(rt[:2]), np.nansum(rt[2:])
        return pd.DataFrame({REC: [key[0]], "v": [low / high if high > FLOOR else float("nan")]})

    return s.tail.select(REC, "n", "x").groupBy(REC).applyInPandas(ratio, f"{REC} string, v double")


def _gated(blocks_: DataFrame) -> DataFrame:
    loud = blocks_.where(F.col("v") > -70)
    gate = loud.groupBy(REC).agg((-0.691 + power_db(F.avg("e"))).alias("ungated"))
    kept = loud.join(gate, REC).groupBy(REC, "ungated").agg(F.avg(F.when(F.col("v") >= F.col("ungated") - 10, F.col("e"))).alias("e"))
    every = blocks_.groupBy(REC).agg(F.lit(1).alias("one"))
    v = F.when(F.col("e").isNotNull(), -0.691 + power_db(F.col("e"))).otherwise(F.coalesce("ungated", F.lit(-120.0)))
    return every.join(kept, REC, "left").select(REC, v.alias("v"))


def _loudness_range(s: Source) -> DataFrame:
    b = s.loudness(3.0)
    return _ranks(b.withColumn("v", F.when(F.col("v") > -70, F.col("v"))), (0.1, 0.95)).select(REC, F.coalesce(F.col("p95") - F.col("p10"), F.lit(0.0)).alias("v"))


def _true_peak(s: Source) -> DataFrame:
    """The highest value of any channel at four times the rate."""
    reach = 12

    def over(batches):
        for b in batches:
            top = []
            for i in range(b.num_rows):
                first, number = b["first"][i].as_py(), b["block"][i].as_py()
                x = b["x"][i].values.to_numpy(zero_copy_only=False)
                top.append(float(np.abs(dsp.resample(x, 1, 4)[4 * (number * BLOCK - first) : 4 * ((number + 1) * BLOCK - first)]).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([b[REC], pa.array(top, pa.float64())], [REC, "p"])

    found = s.packed("every", reach, reach).mapInArrow(over, f"{REC} string, p double")
    return found.groupBy(_recording().alias(REC)).agg(F.max("p").alias("p")).select(REC, db(F.col("p")).alias("v"))


def _clip_events(s: Source) -> DataFrame:
    clipped = s.every.groupBy(REC, "n").agg(F.max((F.abs("x") >= 0.999).cast("int")).alias("c"))
    return with_previous(clipped, [REC], "n", {"c": "before"}).groupBy(REC).agg(F.sum(((F.col("c") == 1) & (F.col("before") == 0)).cast("double")).alias("v"))


def _drift(s: Source) -> DataFrame:
    """Level of the recorded calibration tone against its nominal level; null without a tone."""
    if s.tone is None:
        return s.lengths.select(REC, F.lit(None).cast("double").alias("v"))
    return s.tone().groupBy(REC).agg(F.avg(F.col("x") * F.col("x")).alias("p")).select(REC, (db(F.sqrt("p")) - s.settings.tone_dbfs).alias("v"))


def name_time(name: Column) -> Column:
    """Time from a file name: yyyymmdd_hhmmss, or with separators; null where there is none that is valid."""
    plain = F.regexp_extract(name, r"(\d{8})[_-]?(\d{6})", 0)
    digits = F.regexp_replace(plain, r"\D", "")
    spaced = F.regexp_extract(name, r"\d{4}[-_]?\d{2}[-_]?\d{2}[T_ -]?\d{2}[:_-]?\d{2}[:_-]?\d{2}", 0)
    read = lambda d: F.try_to_timestamp(F.when(F.length(d) == 14, d), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(read(digits), read(F.regexp_replace(spaced, r"\D", "")))


def _diurnal(s: Source) -> DataFrame:
    sec = s.lengths.select(REC, (F.col("length") / s.settings.rate).alias("sec")).withColumn("t", name_time(F.col(REC) if s.file_name is None else F.lit(s.file_name)))
    stop = F.timestamp_micros((F.unix_micros(F.col("t").cast("timestamp_ltz")) + F.floor(F.col("sec") * 1e6)).cast("long"))
    hours = F.size(F.array_distinct(F.transform(F.sequence(F.col("t").cast("timestamp_ltz"), stop, F.expr("interval 30 minutes")), F.hour)))
    return sec.select(REC, F.when(F.col("t").isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sec") / 86400))).otherwise(hours / 24.0).alias("v"))


def _comparable(s: Source) -> DataFrame:
    c = s.settings
    rate = 1.0 if c.rate in (16000, 22050, 32000, 44100, 48000) else 0.7
    return s.quality.select(REC, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * float(c.calibrated) + 0.2 * rate + 0.2 + 0.2 * (1 - F.col("clipping_ratio")))).alias("v"))


def _uptime(s: Source) -> DataFrame:
    return s.silence.select(REC, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dropout"))).alias("v"))


def _completeness(s: Source) -> DataFrame:
    return _uptime(s).join(s.quality, REC).select(REC, (F.col("v") * F.col("finite")).alias("v"))


@dataclass(frozen=True)
class Metric:
    """An entry of the catalog."""

    name: str
    category: str
    units: str
    compute: Callable[[Source], DataFrame]
    confidence: float = 1.0
    streaming: bool = True
    calibrated: bool = False
    weak: float | None = None  # confidence where no value could be told


_ROOM, _LEVEL, _SPEC, _ECO, _ANOM, _SPACE = "Architectural Acoustics", "Level & Loudness", "Spectral", "Ecoacoustics", "Anomaly / Novelty", "Spatial"

METRICS: dict[str, Metric] = {
    m.name: m
    for m in [
        Metric("rms_dbfs", "Basic", "dBFS", _level),
        Metric("peak_dbfs", "Basic", "dBFS", lambda s: s.levels.select(REC, "frame", db(F.col("peak")).alias("v"))),
        Metric("crest_factor_db", _LEVEL, "dB", lambda s: s.levels.select(REC, "frame", db(F.greatest("peak", F.lit(FLOOR)) / F.greatest(F.sqrt("power"), F.lit(FLOOR))).alias("v"))),
        Metric("spl_z_db", _LEVEL, "dB", _spl, calibrated=True),
        Metric("spl_a_db", _LEVEL, "dBA", lambda s: s.level_a, streaming=False, calibrated=True),
        Metric("spl_c_db", _LEVEL, "dBC", lambda s: s.level_c, streaming=False, calibrated=True),
        Metric("snr_db", "Noise & SNR", "dB", _snr, 0.8),
        Metric("spectral_centroid_hz", _SPEC, "Hz", _shape("centroid")),
        Metric("spectral_bandwidth_hz", _SPEC, "Hz", _shape("bandwidth")),
        Metric("spectral_flatness", _SPEC, "ratio", _shape("flatness")),
        Metric("spectral_rolloff_hz", _SPEC, "Hz", _shape("rolloff")),
        Metric("zero_crossing_rate", "Temporal", "ratio", _zero_crossings, 0.9),
        Metric("bioacoustic_index", _ECO, "a.u.", _shape("bio"), streaming=False),
        Metric("acoustic_complexity_index", _ECO, "ratio", lambda s: s.shapes.select(REC, "frame", (F.col("change") / F.greatest(F.col("whole"), F.lit(FLOOR))).alias("v")), 0.9, False),
        Metric("interchannel_coherence", _SPACE, "ratio", _coherence, 0.9),
        Metric("novelty_curve", _ANOM, "a.u.", _shape("novelty"), 0.95),
        Metric("spectral_change_detection", _ANOM, "zscore", lambda s: _z(_shape("novelty")(s)), 0.9),
        Metric("rt60_s", _ROOM, "s", lambda s: s.fit(-5, -35), streaming=False),
        Metric("edt_s", _ROOM, "s", lambda s: s.fit(0, -10), streaming=False),
        Metric("c50_db", _ROOM, "dB", _energy(lambda: _ratio_db("e50")), streaming=False),
        Metric("c80_db", _ROOM, "dB", _energy(lambda: _ratio_db("e80")), streaming=False),
        Metric("d50", _ROOM, "ratio", _energy(lambda: F.col("e50") / (F.col("e") + 1e-20)), streaming=False),
        Metric("leq_db", _LEVEL, "dB", lambda s: _spl(s).groupBy(REC).agg(leq(F.col("v")).alias("v")), calibrated=True),
        Metric("lmax_db", _LEVEL, "dB", lambda s: _spl(s).groupBy(REC).agg(F.max("v").alias("v")), calibrated=True),
        Metric("lmin_db", _LEVEL, "dB", lambda s: _spl(s).groupBy(REC).agg(F.min("v").alias("v")), calibrated=True),
        Metric("lpeak_dbfs", _LEVEL, "dBFS", lambda s: s.quality.select(REC, db(F.col("peak")).alias("v"))),
        *[Metric(f"l{p}_db", _LEVEL, "dB", _exceeded(p), calibrated=True) for p in (10, 50, 90, 95)],
        Metric("sel_db", _LEVEL, "dB", lambda s: _exposure(_spl(s), s), calibrated=True),
        Metric("lae_db", _LEVEL, "dBA", lambda s: _exposure(s.level_a, s), calibrated=True),
        Metric("integrated_lufs", _LEVEL, "LUFS", lambda s: _gated(s.loudness(0.4)), 0.85, False),
        Metric("short_term_lufs", _LEVEL, "LUFS", lambda s: s.loudness(3.0), 0.85, False),
        Metric("momentary_lufs", _LEVEL, "LUFS", lambda s: s.loudness(0.4), 0.85, False),
        Metric("loudness_range_lu", _LEVEL, "LU", _loudness_range, 0.85, False),
        Metric("true_peak_dbfs", _LEVEL, "dBFS", _true_peak, 0.9, False),
        Metric("sti_proxy", _ROOM, "ratio", _sti, 0.6, False),
        Metric("t20_s", _ROOM, "s", lambda s: s.fit(-5, -25), 0.8, False),
        Metric("t30_s", _ROOM, "s", lambda s: s.fit(-5, -35), 0.85, False),
        Metric("ts_ms", _ROOM, "ms", _energy(lambda: F.col("te") / (F.col("e") + FLOOR) * 1000), 0.9, False),
        Metric("g_strength_db", _ROOM, "dB", _energy(lambda: 10 * F.log10((F.col("e") + FLOOR) / FLOOR)), 0.5, False),
        Metric("lf_ratio", _ROOM, "ratio", _lateral(False), 0.6, False, weak=0.2),
        Metric("lfc_ratio", _ROOM, "ratio", _lateral(True), 0.6, False, weak=0.2),
        Metric("bass_ratio", _ROOM, "ratio", _bass, 0.7, False),
        Metric("ndsi", _ECO, "ratio", _ndsi, 0.9, False),
        Metric("adi", _ECO, "ratio", _occupancy(True), 0.85, False),
        Metric("aei", _ECO, "ratio", _occupancy(False), 0.85, False),
        Metric("acoustic_entropy", _ECO, "ratio", _entropy, 0.85, False),
        Metric("eco_octave_trends", _ECO, "dB/s", _trends, 0.8, False),
        Metric("iacc", _SPACE, "ratio", _stereo("iacc")),
        Metric("ild_db", _SPACE, "dB", _level_difference),
        Metric("ipd_rad", _SPACE, "rad", _stereo("ipd")),
        Metric("itd_s", _SPACE, "s", _stereo("itd")),
        Metric("ambisonic_diffuseness", _SPACE, "ratio", _ambisonic("diffuseness"), 0.8, False, weak=0.2),
        Metric("ambisonic_energy_vector_azimuth_deg", _SPACE, "deg", _ambisonic("azimuth"), 0.8, False, weak=0.2),
        Metric("ambisonic_energy_vector_elevation_deg", _SPACE, "deg", _ambisonic("elevation"), 0.8, False, weak=0.2),
        Metric("doa_azimuth_proxy_deg", _SPACE, "deg", _doa, 0.7),
        Metric("clipping_ratio", "Basic", "ratio", lambda s: s.quality.select(REC, F.col("clipping_ratio").alias("v"))),
        Metric("clipping_event_count", "Basic", "count", _clip_events),
        Metric("dc_offset", "Basic", "linear", lambda s: s.quality.select(REC, F.col("dc_offset").alias("v"))),
        Metric("dropout_ratio", "Basic", "ratio", lambda s: s.silence.select(REC, F.col("dropout").alias("v")), 0.9),
        Metric("silence_ratio", "Basic", "ratio", lambda s: s.silence.select(REC, F.col("silence").alias("v")), 0.9),
        Metric("calibration_drift_db", _LEVEL, "dB", _drift, 1.0, False, True, 0.2),
        Metric("isolation_forest_score", _ANOM, "score", _anomaly, 0.6, False),
        Metric("ocsvm_score", _ANOM, "score", _anomaly, 0.55, False),
        Metric("autoencoder_recon_error", _ANOM, "mse", _reconstruction, 0.8, False),
        Metric("change_point_confidence", _ANOM, "ratio", _change_point, 0.9),
        Metric("octave_band_level_db", _SPEC, "dB", _band_levels(1), 0.9, False),
        Metric("third_octave_band_level_db", _SPEC, "dB", _band_levels(3), 0.9, False),
        Metric("uptime_ratio", "Basic", "ratio", _uptime, 0.8),
        Metric("completeness_ratio", "Basic", "ratio", _completeness, 0.75),
        Metric("diurnal_coverage_ratio", "Basic", "ratio", _diurnal, 1.0, False),
        Metric("site_comparability_score", "Basic", "ratio", _comparable, 0.7, False, True),
    ]
}

_EXTRA: dict[str, Metric] = {}


def register(metric: Metric) -> None:
    """Add a metric of one's own; a name that is taken is refused."""
    if metric.name in METRICS or metric.name in _EXTRA:
        raise ValueError(f"metric {metric.name} exists")
    _EXTRA[metric.name] = metric


def discover(group: str = "sonarlake.metrics") -> list[str]:
    """Registers what installed packages offer under an entry point group: a metric, or a function that makes one. What fails is passed over."""
    from importlib.metadata import entry_points

    added = []
    for point in entry_points(group=group):
        try:
            found = point.load()
            metric = found if isinstance(found, Metric) else found()
            register(metric)
            added.append(metric.name)
        except Exception:
            continue
    return added


def chunked(source: Source, size: int) -> Source:
    """The same signals with every ``size`` samples as a recording of its own (recording_id#chunk): metrics per chunk, as a stream gives them."""
    cut = lambda df: df.select(F.concat_ws("#", REC, F.floor(F.col("n") / size)).alias(REC), "channel", F.pmod("n", F.lit(size)).alias("n"), "x")
    return Source(lambda c: cut(source.signal(c)), lambda: cut(source.impulse()), source.settings, source.file_name, source.tone)


def metric_names(wanted: list[str] | None = None) -> list[str]:
    """All names in order, or those wanted; an unknown one is refused."""
    known = METRICS | _EXTRA
    for name in wanted or ():
        if name not in known:
            raise KeyError(name)
    return list(wanted) if wanted else sorted(known)


def summary(source: Source, name: str) -> DataFrame:
    """One row per recording: metric, units, confidence, and the summary of its values."""
    m = (METRICS | _EXTRA)[name]
    found = m.compute(source).groupBy(REC).agg(*summary_columns())
    confidence = F.lit(m.confidence) if m.weak is None else F.when(F.col("n") == 0, m.weak).otherwise(m.confidence)
    return found.select(REC, F.lit(m.name).alias("metric"), F.lit(m.units).alias("units"), confidence.alias("confidence"), "n", "mean", "std", "min", "max", "p50", "p95")


#: Tables of a source that several metrics are made of, each a row per frame or less.
_SHARED = ("two", "tail", "octaves", "thirds", "level_a", "level_c", "b_format", "lateral", "levels", "level_ranks", "spl_ranks", "shapes", "mean_bins", "slots", "quality", "pairs", "neighbours", "stereo", "lengths", "energies")


def shared(source: Source, tables: tuple[str, ...] = _SHARED) -> Source:
    """The source with the tables that metrics share written once and read again, instead of computed for every metric.

    Recordings are then decoded once for each of these tables, however many metrics are asked for.
    """

    class Kept(Source):
        def __getattribute__(self, name: str):
            held = object.__getattribute__(self, "__dict__")
            if name in tables and name not in held:
                held[name] = keep(getattr(Source, name).func(self))  # from other tables that are kept, where it is made of them
            return object.__getattribute__(self, name)

    return Kept(source.signal, source.impulse, source.settings, source.file_name, source.tone, source.packer, source.lateral_channels)


def analyze(source: Source, wanted: list[str] | None = None) -> DataFrame:
    """The summaries of several metrics in one table.

    What metrics share is computed once, the values of all metrics are one long table, and their percentiles come from one range sort of it, so that a long
    recording is spread over many tasks.
    """
    names, known = metric_names(wanted), METRICS | _EXTRA
    if len(names) == 1:
        return summary(source, names[0])
    source = shared(source)
    values = None
    for name in names:
        part = known[name].compute(source).select(REC, F.lit(name).alias("metric"), F.col("v").cast("double").alias("v"))
        values = part if values is None else values.unionByName(part)
    held, keys = keep(values), [REC, "metric"]
    ranks = exact_percentiles(held, keys, "v", (0.5, 0.95)).drop("n")
    found = held.groupBy(*keys).agg(*summary_columns()[:5]).join(ranks, keys, "left")
    of = lambda value: F.create_map(*[x for n in names for x in (F.lit(n), F.lit(value(known[n])))])[F.col("metric")]
    confidence = F.when(F.col("n") == 0, of(lambda m: m.confidence if m.weak is None else m.weak)).otherwise(of(lambda m: m.confidence))
    return found.select(REC, "metric", of(lambda m: m.units).alias("units"), confidence.alias("confidence"), "n", "mean", "std", "min", "max", "p50", "p95")


_STFT = {n for n, m in METRICS.items() if m.category in ("Spectral", "Ecoacoustics", "Anomaly / Novelty")} | {"spl_a_db", "spl_c_db", "iacc", "ipd_rad", "itd_s"}
_BLOCKS_S = {"momentary_lufs": 0.4, "short_term_lufs": 3.0}


def series(source: Source, wanted: list[str] | None = None) -> DataFrame:
    """recording_id, metric, timestamp_s, value, units: the values of metrics that have one for every frame, and the time of each.

    Times are starts of frames, middles of frames for what comes from transforms and of blocks for loudness. Metrics of one value for a recording give it at 0.
    """
    names, c = metric_names(wanted), source.settings
    source = shared(source) if len(names) > 1 else source
    out = None
    for name in names:
        m = (METRICS | _EXTRA)[name]
        v = m.compute(source)
        if "frame" not in v.columns or name in ("octave_band_level_db", "third_octave_band_level_db", "eco_octave_trends"):
            v = v.withColumn("t", F.lit(0.0))
        elif name in _BLOCKS_S:
            v = v.withColumn("t", F.col("frame") * 0.1 + _BLOCKS_S[name] / 2)
        elif name in _STFT:
            v = v.withColumn("t", (F.col("frame") * c.fft_hop + c.fft / 2) / c.rate)
        else:  # the last frame ends with the signal
            v = v.join(source.lengths, REC).withColumn("t", F.least(F.col("frame") * c.hop, F.greatest(F.col("length") - c.frame, F.lit(0))) / c.rate)
        part = v.select(REC, F.lit(name).alias("metric"), F.col("t").cast("double").alias("timestamp_s"), F.col("v").alias("value"), F.lit(m.units).alias("units"))
        out = part if out is None else out.unionByName(part)
    return out
