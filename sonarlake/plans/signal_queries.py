"""Named queries of the building blocks: frames, transforms, decay, similarity, maps, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions import dsp
from sonarlake.functions.levels import db, rounded, settled, settled_sql, summary_columns, total
from sonarlake.operators import quality, reports, rules, vectors
from sonarlake.operators.frames import framed, peaks_in_blocks
from sonarlake.operators.metrics import METRICS, REC, Source, chunked, name_time
from sonarlake.operators.percentiles import exact_percentiles
from sonarlake.operators.similarity import band_similarity, kernel, novelty
from sonarlake.plans import metric_sql as m
from sonarlake.plans.metric_queries import event_source
from sonarlake.plans.workflows import beam_scores
from sonarlake.sources.signals import Settings, event_signal, wide
from sonarlake.sources.tables import table

MELS = 16
BAND = 16
CLIP_CHUNK, CLIP_MARGIN = 1000, 100


def frame_signal(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their starts, samples and sums."""
    f = framed(event_signal(spark, d), 1024, 256)
    return rounded(f.groupBy("frame", "start").agg(F.count("*").alias("samples"), F.sum("x").alias("total")))


def frame_tail_rule(spark: SparkSession, d: str) -> DataFrame:
    """The last frames: one more, aligned to the end, where the hops don't reach it."""
    f = framed(event_signal(spark, d), 1000, 300).groupBy("frame").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.max("length").alias("length"))
    return f.where(F.col("last") >= F.col("length") - 700)


def stft_dft(spark: SparkSession, d: str) -> DataFrame:
    """Magnitudes of all frames and bins."""
    s = event_source(spark, d).spectra
    return rounded(s.select("frame", F.posexplode("mag").alias("bin", "mag")))


def summarize(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each metric's readings, as stored with results."""
    keys = ["recording_id", "metric"]
    rows = rules.once(table(spark, d, "metric_series"))
    moments = rows.groupBy(*keys).agg(*summary_columns("value")[:5])
    found = moments.join(exact_percentiles(rows, keys, "value", (0.5, 0.95)).drop("n"), keys)
    return settled(found, "mean", "std", "min", "max", "p50", "p95")


def channel_summary(spark: SparkSession, d: str) -> DataFrame:
    """Level, peak, offset and clipping per channel and over all."""
    s = event_signal(spark, d, 2)
    per = s.groupBy("channel").agg(F.avg(F.col("x") ** 2).alias("p"), F.max(F.abs("x")).alias("k"), F.avg("x").alias("dc_offset"), F.avg((F.abs("x") >= 0.999).cast("double")).alias("clipping_ratio"))
    row = lambda t, name: t.select(name, db(F.sqrt("p")).alias("rms_dbfs"), db(F.col("k")).alias("peak_dbfs"), "dc_offset", "clipping_ratio")
    every = per.agg(F.avg("p").alias("p"), F.max("k").alias("k"), F.avg("dc_offset").alias("dc_offset"), F.avg("clipping_ratio").alias("clipping_ratio"))
    return rounded(row(per, F.concat(F.lit("ch"), F.col("channel") + 1).alias("id")).unionByName(row(every, F.lit("all").alias("id"))))


def validity_flags(spark: SparkSession, d: str) -> DataFrame:
    """Clipping, offset, and whether the decayed signal looks like an impulse response with a usable tail."""
    return quality.validity_flags(event_source(spark, d)).drop("snr_confidence_low")


def fractional_octave_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Levels of third-octave bands in every frame."""
    return rounded(event_source(spark, d).bands(3).select("frame", "band", "level"))


def schroeder_decay(spark: SparkSession, d: str) -> DataFrame:
    """Backward-integrated decay of the impulse response."""
    return rounded(event_source(spark, d).tail.select("n", "decay"))


def decay_fit(spark: SparkSession, d: str) -> DataFrame:
    """Lines through three stretches of the decay."""
    s = event_source(spark, d)
    parts = [s.fit(lo, hi).select(F.lit(float(lo)).alias("lo_db"), F.lit(float(hi)).alias("hi_db"), "points", "slope", "intercept", "r2", F.col("v").alias("rt60_s")) for lo, hi in ((0, -10), (-5, -25), (-5, -35))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def loudness_gating(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 0.4 s with the gates that they pass."""
    b = event_source(spark, d).loudness(0.4)
    gate = b.where("v > -70").groupBy(REC).agg((-0.691 + 10 * F.log10(F.greatest(F.avg("e"), F.lit(1e-12))) - 10).alias("gate"))
    return rounded(b.join(gate, REC, "left").select("frame", F.col("v").alias("lufs"), (F.col("v") > -70).alias("absolute"), F.coalesce((F.col("v") > -70) & (F.col("v") >= F.col("gate")), F.lit(False)).alias("relative")))


def _mel(s: Source) -> DataFrame:
    spark, c = s.mono.sparkSession, s.settings
    w = dsp.mel_weights(c.rate, c.fft, MELS)
    rows = [(i, k, float(w[i, k])) for i in range(MELS) for k in range(w.shape[1]) if w[i, k] > 0]
    # as many rows as a filter bank has weights, a parameter
    bank = F.broadcast(spark.createDataFrame(rows, "mel int, bin int, w double"))
    return s.bins.join(bank, "bin").groupBy("frame", "mel").agg(F.sum(F.col("p") * F.col("w")).alias("energy"))


def mel_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Energy of mel bands in every frame."""
    return rounded(_mel(event_source(spark, d)).withColumn("log_energy", F.log1p("energy")), 9)


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 16 log-mel energies and the shape of every short frame, one row per position."""
    v = vectors.feature_vectors(event_source(spark, d), MELS)
    named = v.select("frame_idx", F.explode(F.arrays_zip("feature_names", "matrix")).alias("f"))
    return rounded(named.select("frame_idx", F.col("f.feature_names").alias("feature"), F.col("f.matrix").alias("value")), 5)


def core_features(spark: SparkSession, d: str) -> DataFrame:
    """Shape of the spectrum, its change, level and sign changes of every short frame."""
    s = event_source(spark, d)
    c = s.settings

    def time_domain(rows):
        x = rows[0]
        return {"rms_linear": (x * x).mean(1) ** 0.5, "zcr_ratio": ((x[:, 1:] < 0) != (x[:, :-1] < 0)).mean(1)}

    t = s.of_blocks("mono", c.fft, c.fft_hop, time_domain, "rms_linear double, zcr_ratio double", False)
    return rounded(s.shapes.select(REC, "frame", "centroid", "bandwidth", "flatness", "rolloff", F.col("flux2").alias("flux")).join(t, [REC, "frame"]).drop(REC))


def ltsa(spark: SparkSession, d: str) -> DataFrame:
    """Mean level of every bin over stretches of 50 frames."""
    b = event_source(spark, d).bins
    return rounded(b.groupBy(F.floor(F.col("frame") / 50).alias("stretch"), "bin").agg(F.avg(10 * F.log10(F.greatest("p", F.lit(1e-24)))).alias("level")))


def log_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Level of every frame in bands of equal width on a logarithmic scale, eight to the octave, from 62.5 Hz."""
    b = event_source(spark, d).bins.where("f > 0").withColumn("band", F.floor(8 * F.log2(F.col("f") / 62.5) + 1e-9))
    return rounded(b.groupBy("frame", "band").agg((10 * F.log10(F.greatest(F.avg("p"), F.lit(1e-24)))).alias("level")))


def waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth spectrum in decibels below the strongest bin of all."""
    b = event_source(spark, d).bins
    top = b.agg(F.max("p").alias("top"))  # one row
    kept = b.where(F.col("frame") % 10 == 0).crossJoin(F.broadcast(top))
    return rounded(kept.select("frame", "bin", (10 * F.log10(F.greatest(F.col("p") / F.col("top"), F.lit(1e-12)))).alias("level")))


def beam_map(spark: SparkSession, d: str) -> DataFrame:
    """Delay-and-sum score of a stereo signal per azimuth, divided by the largest."""
    return rounded(beam_scores(wide(event_signal(spark, d, 2), 2), Settings()).select("azimuth_deg", "score"))


def calibration_check(spark: SparkSession, d: str) -> DataFrame:
    """Level of a tone against its reference, and whether it is within one decibel."""
    drift = METRICS["calibration_drift_db"].compute(event_source(spark, d))
    return rounded(drift.select(REC, F.col("v").alias("drift_db"), (F.col("v") - 20 + 94).alias("spl_db"), (F.abs("v") <= 1.0).alias("within")))


def profile_multires(spark: SparkSession, d: str) -> DataFrame:
    """Mean level under three sizes of frames."""
    parts = []
    for name, size, hop in (("short", 256, 128), ("middle", 1024, 256), ("long", 4096, 2048)):
        s = Source(lambda c: event_signal(spark, d, c or 1), lambda: event_signal(spark, d), Settings(frame=size, hop=hop))
        parts.append(METRICS["rms_dbfs"].compute(s).groupBy(F.lit(name).alias("profile"), F.lit(size).alias("frame_size")).agg(F.count("*").alias("frames"), F.avg("v").alias("rms_dbfs")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def parse_filename_ts(spark: SparkSession, d: str) -> DataFrame:
    """Times read from file names; the names are made of recordings and their dates."""
    r = table(spark, d, "recordings").select("recording_id", F.concat("recording_id", F.lit("_"), F.date_format(F.col("recorded_at").cast("timestamp_ltz"), "yyyyMMdd_HHmmss"), F.lit(".wav")).alias("name")).distinct()
    return r.select("recording_id", "name", F.unix_micros(name_time(F.col("name")).cast("timestamp_ltz")).alias("start_us"))


def kpi_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of every recording against the first of its project, by differences of length and of what is stored of clipping, centroid, and novelty as transients."""
    r = table(spark, d, "recordings").where("project is not null and duration_s is not null").groupBy("recording_id", "project").agg(F.max("duration_s").alias("duration"))
    stored = table(spark, d, "metric_results").select("recording_id", "name", F.col("summary.mean").alias("m")).where("m is not null and not isnan(m)")
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("m")))
    means = stored.groupBy("recording_id").agg(part("clipping_event_count").alias("clips"), part("spectral_centroid_hz").alias("centroid"), part("zero_crossing_rate").alias("crossings"), part("novelty_curve").alias("novelty"))
    every = r.join(means, "recording_id", "left")
    base = every.groupBy("project").agg(F.min_by(F.struct("duration", "centroid", "crossings", "novelty"), "recording_id").alias("b"))
    change = lambda c: F.when(F.col(f"b.{c}") != 0, 100 * (F.col(c) - F.col(f"b.{c}")) / F.col(f"b.{c}"))
    errors = every.join(base, "project").select(
        "recording_id", "project", (1000 * (F.col("duration") - F.col("b.duration"))).alias("duration_error_ms"), (F.col("clips") / (F.col("duration") * 48000)).alias("clipping_ratio"), change("centroid").alias("centroid_delta_pct"),
        change("crossings").alias("flatness_delta_pct"), F.when(F.col("b.novelty") != 0, F.col("novelty") / F.col("b.novelty")).alias("transient_count_ratio"),
    )
    return rounded(reports.kpi_scores(errors).select("recording_id", "project", "score"), 6)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.col("embedding").alias("v"))


def ssm_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of vectors at most 16 places apart."""
    return rounded(band_similarity(_vectors(spark, d), BAND))


def checkerboard_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The kernel of half width 8."""
    return rounded(spark.createDataFrame(kernel(8), "u int, v int, w double"))


def foote_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Novelty along the vectors under a kernel of half width 8."""
    return rounded(novelty(_vectors(spark, d), 16))


def novelty_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the novelty that stand out by 0.08 and are half a kernel apart."""
    return rounded(peaks_in_blocks(foote_novelty(spark, d), [], "frame", "novelty", 4, 0.08))


def chunked_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of every chunk of 4096 samples, framed on its own."""
    s = chunked(event_source(spark, d), 4096)
    return rounded(METRICS["rms_dbfs"].compute(s).groupBy(REC).agg(F.count("*").alias("frames"), F.avg("v").alias("mean"), F.max("v").alias("max")))


def clip_cut(spark: SparkSession, d: str) -> DataFrame:
    """Clips around chunks of samples that reach full scale: samples and energy of each."""
    s = event_signal(spark, d)
    n = s.agg(F.max("n")).first()[0]
    loud = s.groupBy(REC, F.floor(F.col("n") / CLIP_CHUNK).alias("c")).agg(F.max(F.abs("x")).alias("k")).where("k >= 0.999")
    clips = loud.select(F.col("c").alias("clip_id"), REC, F.greatest(F.lit(0), F.col("c") * CLIP_CHUNK - CLIP_MARGIN).alias("first"), F.least(F.lit(n), (F.col("c") + 1) * CLIP_CHUNK + CLIP_MARGIN - 1).alias("last"))
    return rounded(rules.cut_clips(s, clips).groupBy("clip_id").agg(F.count("*").alias("samples"), F.sum(F.col("x") ** 2).alias("energy"), F.sum(total(F.array("x"))).alias("sum")))


_FUNCTIONS = (
    frame_signal, frame_tail_rule, stft_dft, summarize, channel_summary, validity_flags, fractional_octave_range_join, schroeder_decay, decay_fit, loudness_gating, mel_spectrum, core_features, feature_vectors, ltsa, log_frequency, waterfall,
    beam_map, calibration_check, profile_multires, parse_filename_ts, kpi_score, ssm_cosine, checkerboard_kernel, foote_novelty, novelty_peaks, chunked_levels, clip_cut,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0e0 AS {n}" for n in names)


def _profile(name: str, size: int, hop: int) -> str:
    return f"""SELECT '{name}' AS profile, {size} AS frame_size, count(*) AS frames, round(avg(v), 6) AS rms_dbfs FROM (
WITH {m.MONO}, {m.starts("fs", "len", size, hop, True)} SELECT {m._DB.format(f"sqrt(sum(x * x) / {size})")} AS v FROM fs JOIN mono ON n >= start AND n < start + {size} GROUP BY frame)"""


def _fit_sql(lo: int, hi: int) -> str:
    return f"""SELECT {lo}::DOUBLE AS lo_db, {hi}::DOUBLE AS hi_db, count(*) AS points, round(regr_slope(decay, n / 8e3), 6) AS slope, round(regr_intercept(decay, n / 8e3), 6) AS intercept, round(regr_r2(decay, n / 8e3), 6) AS r2,
CASE WHEN count(*) >= 8 AND regr_slope(decay, n / 8e3) < 0 THEN round(-60 / regr_slope(decay, n / 8e3), 6) END AS rt60_s FROM dec WHERE round(decay, 9) <= {lo} AND round(decay, 9) >= {hi}"""


def _mel_sql() -> str:
    w = dsp.mel_weights(8000, 64, MELS)
    return "bank(mel, k, w) AS (VALUES " + ", ".join(f"({i}, {k}, {float(w[i, k])!r}::DOUBLE)" for i in range(MELS) for k in range(w.shape[1]) if w[i, k] > 0) + ")"


_UNIT = "em AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), cn AS (SELECT i, k, x - avg(x) OVER (PARTITION BY i) AS x FROM em), un AS (SELECT i, k, x / (sqrt(sum(x * x) OVER (PARTITION BY i)) + 1e-12) AS x FROM cn)"


def _sim(width: int) -> str:
    return f"{_UNIT}, sm AS (SELECT a.i, b.i AS j, greatest(0, least(1, sum(a.x * b.x))) AS sim FROM un a JOIN un b ON b.i BETWEEN a.i - {width} AND a.i + {width} AND a.k = b.k GROUP BY 1, 2)"


_KERNEL = "kn AS (SELECT u, v, (CASE WHEN u * v > 0 THEN 1 WHEN u * v < 0 THEN -1 ELSE 0 END) * exp(-(u * u + v * v) / 32e0) AS w FROM (SELECT unnest(range(-8, 9)) AS u), (SELECT unnest(range(-8, 9)) AS v))"
_IMP_ENDS = """hd AS (SELECT pk, length, greatest(4, least(64, (length - pk) // 8)) AS h FROM top),
ie AS (SELECT avg(CASE WHEN n - pk < h THEN abs(x) END) AS first, avg(CASE WHEN n >= length - h THEN abs(x) END) AS last, max(pk) AS pk, max(length) AS length FROM imp, hd WHERE n >= pk),
dt AS (SELECT pk <= greatest(1, length // 8) AND first > 0 AND last < first AS seen FROM ie)"""

SQL = {
    "frame_signal": f"WITH {m.MONO}, {m.starts('fs', 'len', 1024, 256, True)} SELECT frame, start, count(*) AS samples, round(sum(x), 6) + 0e0 AS total FROM fs JOIN mono ON n >= start AND n < start + 1024 GROUP BY frame, start",
    "frame_tail_rule": f"WITH {m.MONO}, {m.starts('fs', 'len', 1000, 300, True)} SELECT frame, start AS first, start + 999 AS last, length FROM fs, len WHERE start + 999 >= length - 700",
    "stft_dft": f"WITH {m.SPECTRUM} SELECT frame, k AS bin, round(m, 6) AS mag FROM mag",
    "summarize": "WITH rd AS (SELECT DISTINCT ON (reading_id) reading_id, recording_id, metric, value FROM metric_series WHERE value IS NOT NULL AND NOT isnan(value) AND timestamp_s IS NOT NULL) SELECT recording_id, metric, count(*) AS n, " + ", ".join(f"{settled_sql(e)} AS {n}" for n, e in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)"), ("p50", "quantile_cont(value, 5e-1)"), ("p95", "quantile_cont(value, 95e-2)"))) + " FROM rd GROUP BY 1, 2",
    "channel_summary": f"""WITH s AS (SELECT event_id % 2 AS c, {m._X} AS x FROM events), p AS (SELECT c, avg(x * x) AS p, max(abs(x)) AS k, avg(x) AS d, avg(CASE WHEN abs(x) >= 999e-3 THEN 1e0 ELSE 0 END) AS r FROM s GROUP BY c),
a AS (SELECT 'ch' || (c + 1) AS id, p, k, d, r FROM p UNION ALL SELECT 'all', avg(p), max(k), avg(d), avg(r) FROM p)
SELECT id, round({m._DB.format("sqrt(p)")}, 6) + 0e0 AS rms_dbfs, round({m._DB.format("k")}, 6) + 0e0 AS peak_dbfs, round(d, 6) + 0e0 AS dc_offset, round(r, 6) AS clipping_ratio FROM a""",
    "validity_flags": f"""WITH {m.MONO}, {m.TAIL}, {_IMP_ENDS}, ft AS (SELECT regr_r2(decay, n / 8e3) AS r2 FROM dec WHERE round(decay, 9) <= -5 AND round(decay, 9) >= -35), rg AS (SELECT max(decay) - min(decay) AS rg FROM dec),
q AS (SELECT avg(CASE WHEN abs(x) >= 999e-3 THEN 1e0 ELSE 0 END) > 0 AS c, abs(avg(x)) > 1e-3 AS o FROM mono)
SELECT 'events' AS recording_id, c AS clipping, o AS dc_offset_excessive, seen AS ir_detected, seen AND (rg < 35 OR coalesce(r2 < 85e-2, false)) AS ir_tail_low_snr FROM q, dt, ft, rg""",
    "fractional_octave_range_join": f"WITH {m.bands(3)} SELECT frame, band, round(level, 6) + 0e0 AS level FROM bl",
    "schroeder_decay": f"WITH {m.TAIL} SELECT n, round(decay, 6) + 0e0 AS decay FROM dec",
    "decay_fit": f"WITH {m.TAIL} {_fit_sql(0, -10)} UNION ALL {_fit_sql(-5, -25)} UNION ALL {_fit_sql(-5, -35)}",
    "loudness_gating": f"WITH {m._GATE} SELECT frame, round(v, 6) + 0e0 AS lufs, v > -70 AS absolute, coalesce(v > -70 AND v >= u - 10, false) AS relative FROM lk LEFT JOIN ug ON true",
    "mel_spectrum": f"WITH {m.SPECTRUM}, {_mel_sql()} SELECT frame, mel, round(sum(m * m * w), 9) AS energy, round(ln(1 + sum(m * m * w)), 9) AS log_energy FROM mag JOIN bank USING (k) GROUP BY frame, mel",
    "core_features": f"""WITH {m.SHAPES}, w AS (SELECT frame, n, x, lag(x) OVER (PARTITION BY frame ORDER BY n) AS b FROM ss JOIN mono ON n >= start AND n < start + 64),
td AS (SELECT frame, sqrt(avg(x * x)) AS rms_linear, avg(CASE WHEN b IS NULL THEN NULL WHEN (x < 0) <> (b < 0) THEN 1e0 ELSE 0 END) AS zcr_ratio FROM w GROUP BY frame)
SELECT frame, {_r("centroid", "bandwidth", "flatness", "rolloff", "rms_linear", "zcr_ratio")}, round(flux2, 6) + 0e0 AS flux FROM shapes JOIN td USING (frame)""",
    "feature_vectors": f"""WITH {m.SPECTRUM}, {_mel_sql()}, raw AS (SELECT frame, k, f, m - 1e-12 AS m FROM mag),
ml AS (SELECT frame, mel, ln(1 + greatest(sum(m * m * w), 1e-12)) AS value FROM raw JOIN bank USING (k) GROUP BY 1, 2),
c0 AS (SELECT frame, sum(f * m) / (sum(m) + 1e-12) AS c, avg(m) AS am FROM raw GROUP BY 1),
sh AS (SELECT frame, any_value(c) AS spectral_centroid_hz, sqrt(sum(m * (f - c) * (f - c)) / (sum(m) + 1e-12)) AS spectral_bandwidth_hz, exp(avg(ln(greatest(m, 1e-12)))) / (any_value(am) + 1e-12) AS spectral_flatness FROM raw JOIN c0 USING (frame) GROUP BY 1),
cu AS (SELECT frame, f, sum(m * m) OVER (PARTITION BY frame ORDER BY k) AS c, sum(m * m) OVER (PARTITION BY frame) AS t FROM raw), ro AS (SELECT frame, min(f) AS spectral_rolloff_hz FROM cu WHERE c >= 0.85e0 * t GROUP BY 1),
fx AS (SELECT frame, sqrt(sum(d * d)) AS spectral_flux FROM step GROUP BY 1),
w AS (SELECT frame, n, x, lag(x) OVER (PARTITION BY frame ORDER BY n) AS b FROM ss JOIN mono ON n >= start AND n < start + 64),
td AS (SELECT frame, sqrt(avg(x * x)) AS rms_linear, avg(CASE WHEN b IS NULL THEN NULL WHEN (x < 0) <> (b < 0) THEN 1e0 ELSE 0 END) AS zcr_ratio FROM w GROUP BY 1),
al AS (SELECT * FROM sh JOIN ro USING (frame) JOIN fx USING (frame) JOIN td USING (frame))
SELECT frame AS frame_idx, 'log_mel_' || lpad(mel::VARCHAR, 3, '0') AS feature, round(value, 5) + 0e0 AS value FROM ml
UNION ALL SELECT frame, feature, round(value, 5) + 0e0 FROM (UNPIVOT al ON spectral_centroid_hz, spectral_bandwidth_hz, spectral_flatness, spectral_rolloff_hz, spectral_flux, rms_linear, zcr_ratio INTO NAME feature VALUE value)""",
    "ltsa": f"WITH {m.SPECTRUM} SELECT frame // 50 AS stretch, k AS bin, round(avg(10 * log10(greatest(m * m, 1e-24))), 6) + 0e0 AS level FROM mag GROUP BY 1, 2",
    "log_frequency": f"WITH {m.SPECTRUM} SELECT frame, CAST(floor(8 * log2(f / 62.5e0) + 1e-9) AS BIGINT) AS band, round(10 * log10(greatest(avg(m * m), 1e-24)), 6) + 0e0 AS level FROM mag WHERE f > 0 GROUP BY 1, 2",
    "waterfall": f"WITH {m.SPECTRUM} SELECT frame, k AS bin, round(10 * log10(greatest(m * m / (SELECT max(m * m) FROM mag), 1e-12)), 6) + 0e0 AS level FROM mag WHERE frame % 10 = 0",
    "beam_map": f"""WITH {m.STEREO}, z AS (SELECT n, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM st), dn AS (SELECT sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12 AS den FROM z),
az AS (SELECT az::DOUBLE AS azimuth_deg, CAST(round(2e-1 / 343 * sin(radians(az)) * 8e3) AS BIGINT) AS shift FROM (SELECT unnest(range(-90, 91, 5)) AS az)),
dt AS (SELECT shift, sum(p.a * q.b) AS d FROM (SELECT DISTINCT shift FROM az), z p, z q WHERE p.n = q.n + shift GROUP BY shift), sc AS (SELECT azimuth_deg, d / den AS s FROM az JOIN dt USING (shift), dn)
SELECT azimuth_deg, round(CASE WHEN max(abs(s)) OVER () > 0 THEN s / max(abs(s)) OVER () ELSE s END, 6) + 0e0 AS score FROM sc""",
    "calibration_check": f"WITH one AS (SELECT {m._X} AS x FROM events WHERE event_id % 2 = 1), v AS (SELECT {m._DB.format('sqrt(avg(x * x))')} + 20 AS v FROM one) SELECT 'events' AS recording_id, round(v, 6) + 0e0 AS drift_db, round(v - 20 + 94, 6) AS spl_db, abs(v) <= 1 AS within FROM v",
    "profile_multires": " UNION ALL ".join(_profile(*p) for p in (("short", 256, 128), ("middle", 1024, 256), ("long", 4096, 2048))),
    "parse_filename_ts": "SELECT DISTINCT recording_id, recording_id || '_' || strftime(recorded_at, '%Y%m%d_%H%M%S') || '.wav' AS name, epoch_us(date_trunc('second', recorded_at)) AS start_us FROM recordings",
    "kpi_score": """WITH r AS (SELECT recording_id, project, max(duration_s) AS duration FROM recordings WHERE project IS NOT NULL AND duration_s IS NOT NULL GROUP BY 1, 2),
st AS (SELECT recording_id, name, summary.mean AS m FROM metric_results WHERE summary.mean IS NOT NULL AND NOT isnan(summary.mean)),
mn AS (SELECT recording_id, max(m) FILTER (name = 'clipping_event_count') AS clips, max(m) FILTER (name = 'spectral_centroid_hz') AS centroid, max(m) FILTER (name = 'zero_crossing_rate') AS crossings, max(m) FILTER (name = 'novelty_curve') AS novelty FROM st GROUP BY 1),
ev AS (SELECT * FROM r LEFT JOIN mn USING (recording_id)), fb AS (SELECT project, min(recording_id) AS recording_id FROM ev GROUP BY 1),
bs AS (SELECT e.project, e.duration AS d, e.centroid AS c, e.crossings AS x, e.novelty AS v FROM ev e JOIN fb USING (project, recording_id))
SELECT recording_id, project, round(greatest(0, 100 - (coalesce(abs(1000 * (duration - d)), 0) / 20 + coalesce(abs(clips / (duration * 48000)), 0) * 1200 + CASE WHEN c <> 0 THEN coalesce(abs(100 * (centroid - c) / c), 0) ELSE 0 END * 0.25e0
  + CASE WHEN x <> 0 THEN coalesce(abs(100 * (crossings - x) / x), 0) ELSE 0 END * 0.2e0 + CASE WHEN v <> 0 THEN coalesce(abs(1 - novelty / v), 0) ELSE 0 END * 18)), 6) + 0e0 AS score FROM ev JOIN bs USING (project)""",
    "ssm_cosine": f"WITH {_sim(BAND)} SELECT i, j, round(sim, 6) + 0e0 AS sim FROM sm",
    "checkerboard_kernel": f"WITH {_KERNEL} SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v, round(w, 6) + 0e0 AS w FROM kn",
    "foote_novelty": f"""WITH {_sim(16)}, {_KERNEL}, nf AS (SELECT count(*) AS c FROM embeddings),
nv AS (SELECT f.vec_id AS frame, greatest(0, sum(sim * w)) AS r FROM embeddings f, nf, sm, kn WHERE f.vec_id >= 8 AND f.vec_id < c - 8 AND sm.i = f.vec_id + u AND sm.j = f.vec_id + v GROUP BY 1)
SELECT e.vec_id AS frame, round(coalesce(r / (SELECT max(r) FROM nv), 0), 6) + 0e0 AS novelty FROM embeddings e LEFT JOIN nv ON nv.frame = e.vec_id""",
    "chunked_levels": f"""WITH {m.MONO}, ck AS (SELECT n // 4096 AS c, n % 4096 AS k, x FROM mono), cl AS (SELECT c, max(k) + 1 AS l FROM ck GROUP BY c),
rg AS (SELECT c, unnest(range(0, greatest(l - 1024, 0) // 256 + 1)) AS f, l FROM cl), st AS (SELECT c, f, f * 256 AS s FROM rg UNION ALL SELECT c, (l - 1024) // 256 + 1, l - 1024 FROM cl WHERE l > 1024 AND (l - 1024) % 256 <> 0),
lv AS (SELECT c, f, {m._DB.format("sqrt(sum(x * x) / 1024)")} AS v FROM st JOIN ck USING (c) WHERE k >= s AND k < s + 1024 GROUP BY c, f)
SELECT 'events#' || c AS recording_id, count(*) AS frames, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM lv GROUP BY c""",
    "clip_cut": f"""WITH {m.MONO}, ld AS (SELECT n // {CLIP_CHUNK} AS c FROM mono GROUP BY 1 HAVING max(abs(x)) >= 999e-3)
SELECT c AS clip_id, count(*) AS samples, round(sum(x * x), 6) AS energy, round(sum(x), 6) + 0e0 AS sum FROM ld JOIN mono ON n >= c * {CLIP_CHUNK} - {CLIP_MARGIN} AND n < (c + 1) * {CLIP_CHUNK} + {CLIP_MARGIN} GROUP BY c""",
}
