"""The metrics in SQL for DuckDB, written from their definitions: the transform is a sum over sines, filters are tables of taps."""

from __future__ import annotations

import numpy as np

from sonarlake.functions import dsp
from sonarlake.operators.metrics import METRICS

_X = "greatest(-1e0, least(1e0, (value - 50) / 250e0))"
MONO = f"mono AS (SELECT event_id AS n, {_X} AS x FROM events), len AS (SELECT max(n) + 1 AS length FROM mono)"
STEREO = f"""st AS (SELECT event_id // 2 AS n, max(CASE WHEN event_id % 2 = 0 THEN {_X} END) AS a, max(CASE WHEN event_id % 2 = 1 THEN {_X} END) AS b
  FROM events GROUP BY 1 HAVING count(*) = 2), slen AS (SELECT max(n) + 1 AS length FROM st)"""
FOUR = f"""q AS (SELECT event_id // 4 AS n, {", ".join(f"max(CASE WHEN event_id % 4 = {i} THEN {_X} END) AS x{i}" for i in range(4))} FROM events GROUP BY 1 HAVING count(*) = 4)"""
IMPULSE = f"imp AS (SELECT event_id AS n, {_X} * exp(-event_id / 2e3) AS x FROM events)"


def starts(name: str, length: str, size: int, hop: int, tail: bool) -> str:
    """Frames and where they start."""
    regular = f"SELECT unnest(range(0, (length - {size}) // {hop} + 1)) AS frame, unnest(range(0, (length - {size}) // {hop} + 1)) * {hop} AS start FROM {length}"
    last = f" UNION ALL SELECT (length - {size}) // {hop} + 1, length - {size} FROM {length} WHERE (length - {size}) % {hop} <> 0" if tail else ""
    return f"{name} AS ({regular}{last})"


LEVELS = f"""{MONO}, {starts("fs", "len", 1024, 256, True)},
lev AS (SELECT frame, sqrt(sum(x * x) / 1024) AS r, max(abs(x)) AS pk, sum(abs(x)) / 1024 AS a FROM fs JOIN mono ON n >= start AND n < start + 1024 GROUP BY frame)"""
_DB = "20 * log10(greatest(abs({0}), 1e-12))"
_PDB = "10 * log10(greatest(abs({0}), 1e-12))"


def dft(table: str, starts_: str, column: str, window: bool, name: str) -> str:
    """Real and imaginary parts per frame and bin."""
    w = "(0.5e0 - 0.5e0 * cos(2 * pi() * (n - start) / 64))" if window else "1e0"
    arg = "2 * pi() * ((k * (n - start)) % 64) / 64"
    return f"""{name} AS (SELECT frame, k, sum({column} * {w} * cos({arg})) AS re, -sum({column} * {w} * sin({arg})) AS im
  FROM {starts_} JOIN {table} ON n >= start AND n < start + 64, (SELECT unnest(range(33)) AS k) GROUP BY frame, k)"""


SPECTRUM = f"""{MONO}, {starts("ss", "len", 64, 32, False)}, {dft("mono", "ss", "x", True, "ft")},
mag AS (SELECT frame, k, k * 125e0 AS f, sqrt(re * re + im * im) / 32 + 1e-12 AS m FROM ft),
step AS (SELECT frame, k, f, m, m - coalesce(lag(m) OVER (PARTITION BY k ORDER BY frame), m) AS d FROM mag)"""
SHAPES = f"""{SPECTRUM},
c0 AS (SELECT frame, sum(f * m) / (sum(m) + 1e-12) AS centroid FROM mag GROUP BY frame),
cum AS (SELECT frame, f, sum(m * m) OVER (PARTITION BY frame ORDER BY k) AS c, sum(m * m) OVER (PARTITION BY frame) AS t FROM mag),
roll AS (SELECT frame, min(f) AS rolloff FROM cum WHERE round(c, 12) >= round(0.85e0 * t, 12) GROUP BY frame),
flux AS (SELECT frame, sum(greatest(d, 0)) AS novelty, sqrt(sum(d * d)) AS flux2, sum(abs(d)) AS change FROM step GROUP BY frame),
shp AS (SELECT frame, any_value(centroid) AS centroid, sqrt(sum(m * (f - centroid) * (f - centroid)) / (sum(m) + 1e-12)) AS bandwidth,
  exp(avg(ln(m))) / (avg(m) + 1e-12) AS flatness FROM mag JOIN c0 USING (frame) GROUP BY frame),
shapes AS (SELECT * FROM shp JOIN roll USING (frame) JOIN flux USING (frame))"""
STEREO_FT = f"""{STEREO}, {starts("sf", "slen", 64, 32, True)}, {dft("st", "sf", "a", False, "fa")}, {dft("st", "sf", "b", False, "fb")}"""
PAIRS = f"""{STEREO}, {starts("pf", "slen", 1024, 256, True)}, pr AS (SELECT frame, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab
  FROM pf JOIN st ON n >= start AND n < start + 1024 GROUP BY frame)"""
TAIL = f"""{IMPULSE}, top AS (SELECT arg_min(n, (-abs(x), n)) AS pk, max(n) + 1 AS length FROM imp),
ir AS (SELECT n - first AS n, x, x * x AS e FROM imp, (SELECT CASE WHEN length - pk < 800 THEN 0 ELSE pk END AS first FROM top) WHERE n >= first),
dec AS (SELECT n, e, 10 * log10(greatest(sum(e) OVER (ORDER BY n DESC) / (SELECT greatest(sum(e), 1e-20) FROM ir), 1e-12)) AS decay FROM ir),
en AS (SELECT sum(e) AS e, sum(CASE WHEN n < 400 THEN e ELSE 0 END) AS e50, sum(CASE WHEN n < 640 THEN e ELSE 0 END) AS e80, sum(e * n / 8e3) AS te FROM ir)"""
EARLY = f"{STEREO}, el AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab, count(*) AS c FROM st WHERE n >= 40 AND n < 640)"


def weighted(curve: str) -> str:
    """Levels of short frames under a frequency weighting."""
    f2 = "(greatest(k * 125e0, 1e-6) * greatest(k * 125e0, 1e-6))"
    gain = {
        "A": f"20 * log10(greatest(12200e0 ** 2 * {f2} * {f2} / (({f2} + 20.6e0 ** 2) * sqrt(({f2} + 107.7e0 ** 2) * ({f2} + 737.9e0 ** 2)) * ({f2} + 12200e0 ** 2)), 1e-20)) + 2",
        "C": f"20 * log10(greatest(12200e0 ** 2 * {f2} / (({f2} + 20.6e0 ** 2) * ({f2} + 12200e0 ** 2)), 1e-20)) + 0.06e0",
    }[curve]
    return f"""{MONO}, {starts("ws", "len", 64, 32, True)}, {dft("mono", "ws", "x", False, "wf")},
wl AS (SELECT frame, {_DB.format("sqrt(sum((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (re * re + im * im) * 10 ** ((" + gain + ") / 10))) / 64")} + 94 AS v FROM wf GROUP BY frame)"""


def bands(fraction: int) -> str:
    """Fractional octave bands by a range join."""
    rows, f, i = [], 31.5 if fraction == 1 else 25.0, 0
    while f <= 3920:
        rows.append(f"({i}, {f!r}::DOUBLE)")
        f, i = f * 2 ** (1 / fraction), i + 1
    half = 2 ** (1 / (2 * fraction))
    return f"""{SPECTRUM}, bd(band, c) AS (VALUES {", ".join(rows)}),
held AS (SELECT frame, band, {_PDB.format("avg(m * m)")} AS level FROM mag JOIN bd ON f >= c / {half!r}::DOUBLE AND f < c * {half!r}::DOUBLE GROUP BY frame, band),
bl AS (SELECT s.frame, bd.band, coalesce(level, -120) AS level FROM ss s CROSS JOIN bd LEFT JOIN held USING (frame, band))"""


def loudness(seconds: float, signal: str = f"{MONO}, ch AS (SELECT 0 AS c, n, x FROM mono)", up: int = 6) -> str:
    """Blocks of K-weighted energy summed over the channels ``ch``: resampled to 48 kHz and filtered, both by tables of taps."""
    taps, half = ", ".join(repr(float(t)) for t in dsp.k_taps()), 10 * up
    fine = ", ".join(repr(float(t)) for t in dsp.polyphase_taps(up, 1))
    size = round(seconds * 48000)
    return f"""{signal}, cl AS (SELECT (max(n) + 1) * {up} AS length FROM ch), rt AS (SELECT unnest(range({2 * half + 1})) AS k, unnest([{fine}]::DOUBLE[]) AS h),
rs AS (SELECT c, {up} * n + k - {half} AS n, sum(x * h) AS x FROM ch, rt WHERE {up} * n + k - {half} BETWEEN 0 AND (SELECT length - 1 FROM cl) GROUP BY ALL),
taps AS (SELECT unnest(range({dsp.K_TAPS})) AS k, unnest([{taps}]::DOUBLE[]) AS h),
kw AS (SELECT c, m.n + k AS n, sum(x * h) AS y FROM rs m, taps WHERE m.n + k < (SELECT length FROM cl) GROUP BY ALL),
lb AS (SELECT unnest(range(0, greatest(length - {size}, 0) // 4800 + 1)) AS frame FROM cl),
lo AS (SELECT frame, sum(y * y) / {size} AS e FROM lb JOIN kw ON n >= frame * 4800 AND n < frame * 4800 + {size} GROUP BY frame),
lk AS (SELECT frame, e, -0.691e0 + {_PDB.format("e")} AS v FROM lo)"""


def _true_peak() -> str:
    taps = ", ".join(repr(float(t)) for t in dsp.polyphase_taps(4, 1))
    return f"""{MONO}, taps AS (SELECT unnest(range(81)) AS k, unnest([{taps}]::DOUBLE[]) AS h),
up AS (SELECT 4 * n + k - 40 AS m, sum(x * h) AS y FROM mono, taps WHERE 4 * n + k - 40 BETWEEN 0 AND 4 * (SELECT length FROM len) - 1 GROUP BY 1)"""


_Z = "(v - avg(v) OVER ()) / (stddev_pop(v) OVER () + 1e-12)"
_ANOMALY = "sqrt(" + " + ".join(f"(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-12)) ** 2" for c in ("centroid", "bandwidth", "flatness", "rolloff", "novelty")) + ")"
_LEQ = "10 * log10(avg(10 ** ({0} / 10)) + 1e-12)"
_SPL = f"SELECT {_DB.format('r')} + 94 AS v FROM lev"
_FIT = "SELECT CASE WHEN count(*) >= 8 AND regr_slope(decay, n / 8e3) < 0 THEN -60 / regr_slope(decay, n / 8e3) END AS v FROM dec WHERE round(decay, 9) <= {0} AND round(decay, 9) >= {1}"
_R = "CASE WHEN aa - ma * ma < 1e-24 OR bb - mb * mb < 1e-24 THEN 0 ELSE {0}((ab - ma * mb) / sqrt((aa - ma * ma) * (bb - mb * mb))) END"
_LF = "greatest(0, least(1, bb * c / ((aa + bb) * c + 1e-12)))"
_QUIET = "avg(CASE WHEN a < 1e-4 {0} THEN 1e0 ELSE 0 END)"
_ADI = f"{SPECTRUM}, oc AS (SELECT floor((f - 1000) / 1000) AS s, sum(p) AS p FROM (SELECT f, avg(m * m) AS p FROM mag GROUP BY f) WHERE f >= 1000 AND f < 4000 GROUP BY 1), sh AS (SELECT p / sum(p) OVER () AS q FROM oc)"
_PHAT = f"""{STEREO}, {starts("sf", "slen", 64, 32, True)},
p1 AS (SELECT frame, k, sum(a * cos(2 * pi() * ((k * (n - start)) % 128) / 128)) AS ar, -sum(a * sin(2 * pi() * ((k * (n - start)) % 128) / 128)) AS ai,
  sum(b * cos(2 * pi() * ((k * (n - start)) % 128) / 128)) AS br, -sum(b * sin(2 * pi() * ((k * (n - start)) % 128) / 128)) AS bi
  FROM sf JOIN st ON n >= start AND n < start + 64, (SELECT unnest(range(65)) AS k) GROUP BY frame, k),
p2 AS (SELECT frame, k, ar * br + ai * bi AS re, ai * br - ar * bi AS im FROM p1),
p3 AS (SELECT frame, k, re / greatest(sqrt(re * re + im * im), 1e-12) AS re, im / greatest(sqrt(re * re + im * im), 1e-12) AS im FROM p2),
p4 AS (SELECT frame, lag, sum((CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * k * lag / 128) - im * sin(2 * pi() * k * lag / 128))) / 128 AS c
  FROM p3, (SELECT unnest(range(-8, 9)) AS lag) GROUP BY frame, lag),
dl AS (SELECT frame, arg_min(lag, (-round(c, 12), lag)) / 8e3 AS v FROM p4 GROUP BY frame)"""
_IACC = f"""{STEREO}, {starts("sf", "slen", 64, 32, True)},
fr AS (SELECT frame, n - start AS j, a - avg(a) OVER (PARTITION BY frame) AS a, b - avg(b) OVER (PARTITION BY frame) AS b FROM sf JOIN st ON n >= start AND n < start + 64),
nm AS (SELECT frame, sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12 AS den FROM fr GROUP BY frame),
xc AS (SELECT p.frame, l.lag, sum(p.a * q.b) AS c FROM fr p, (SELECT unnest(range(-8, 9)) AS lag) l, fr q WHERE q.frame = p.frame AND q.j = p.j - l.lag GROUP BY 1, 2),
ia AS (SELECT frame, max(abs(c) / den) AS v FROM xc JOIN nm USING (frame) GROUP BY frame)"""
_GATE = f"""{loudness(0.4)}, ug AS (SELECT -0.691e0 + {_PDB.format("avg(e)")} AS u FROM lk WHERE v > -70)"""

SERIES: dict[str, tuple[str, str]] = {
    "rms_dbfs": (LEVELS, f"SELECT {_DB.format('r')} AS v FROM lev"),
    "peak_dbfs": (LEVELS, f"SELECT {_DB.format('pk')} AS v FROM lev"),
    "crest_factor_db": (LEVELS, f"SELECT {_DB.format('greatest(pk, 1e-12) / greatest(r, 1e-12)')} AS v FROM lev"),
    "spl_z_db": (LEVELS, _SPL),
    "spl_a_db": (weighted("A"), "SELECT v FROM wl"),
    "spl_c_db": (weighted("C"), "SELECT v FROM wl"),
    "snr_db": (LEVELS, f"SELECT quantile_cont(v, 0.9e0) - quantile_cont(v, 0.1e0) AS v FROM ({_SPL})"),
    "spectral_centroid_hz": (SHAPES, "SELECT centroid AS v FROM shapes"),
    "spectral_bandwidth_hz": (SHAPES, "SELECT bandwidth AS v FROM shapes"),
    "spectral_flatness": (SHAPES, "SELECT flatness AS v FROM shapes"),
    "spectral_rolloff_hz": (SHAPES, "SELECT rolloff AS v FROM shapes"),
    "zero_crossing_rate": (
        f"{MONO}, {starts('fs', 'len', 1024, 256, True)}, tn AS (SELECT n, CASE WHEN sign(x) <> lag(sign(x)) OVER (ORDER BY n) THEN 1 ELSE 0 END AS t FROM mono)",
        "SELECT sum(CASE WHEN n > start THEN t ELSE 0 END)::DOUBLE / 1024 AS v FROM fs JOIN tn ON n >= start AND n < start + 1024 GROUP BY frame",
    ),
    "bioacoustic_index": (SPECTRUM, "SELECT sum(CASE WHEN f BETWEEN 2000 AND 8000 THEN m ELSE 0 END) AS v FROM mag GROUP BY frame"),
    "acoustic_complexity_index": (SPECTRUM, "SELECT sum(abs(d)) / greatest(sum(m), 1e-12) AS v FROM step GROUP BY frame"),
    "interchannel_coherence": (PAIRS, f"SELECT {_R.format('')} AS v FROM pr"),
    "novelty_curve": (SHAPES, "SELECT novelty AS v FROM shapes"),
    "spectral_change_detection": (SHAPES, f"SELECT {_Z} AS v FROM (SELECT novelty AS v FROM shapes)"),
    "rt60_s": (TAIL, _FIT.format(-5, -35)),
    "edt_s": (TAIL, _FIT.format(0, -10)),
    "c50_db": (TAIL, "SELECT 10 * log10(e50 / greatest(e - e50, 1e-20)) AS v FROM en"),
    "c80_db": (TAIL, "SELECT 10 * log10(e80 / greatest(e - e80, 1e-20)) AS v FROM en"),
    "d50": (TAIL, "SELECT e50 / (e + 1e-20) AS v FROM en"),
    "leq_db": (LEVELS, f"SELECT {_LEQ.format('v')} AS v FROM ({_SPL})"),
    "lmax_db": (LEVELS, f"SELECT max(v) AS v FROM ({_SPL})"),
    "lmin_db": (LEVELS, f"SELECT min(v) AS v FROM ({_SPL})"),
    "lpeak_dbfs": (MONO, f"SELECT {_DB.format('max(abs(x))')} AS v FROM mono"),
    **{f"l{p}_db": (LEVELS, f"SELECT quantile_cont(v, {100 - p}e-2) AS v FROM ({_SPL})") for p in (10, 50, 90, 95)},
    "sel_db": (LEVELS, f"SELECT {_LEQ.format('v')} + 10 * log10(greatest((SELECT length FROM len) / 8e3, 1e-12)) AS v FROM ({_SPL})"),
    "lae_db": (weighted("A"), f"SELECT {_LEQ.format('v')} + 10 * log10(greatest((SELECT length FROM len) / 8e3, 1e-12)) AS v FROM wl"),
    "integrated_lufs": (
        _GATE, f"SELECT coalesce((SELECT -0.691e0 + {_PDB.format('avg(e)')} FROM lk, ug WHERE v > -70 AND v >= u - 10), (SELECT u FROM ug), -120) AS v",
    ),
    "short_term_lufs": (loudness(3.0), "SELECT v FROM lk"),
    "momentary_lufs": (loudness(0.4), "SELECT v FROM lk"),
    "loudness_range_lu": (loudness(3.0), "SELECT coalesce(quantile_cont(v, 0.95e0) - quantile_cont(v, 0.1e0), 0) AS v FROM lk WHERE v > -70"),
    "true_peak_dbfs": (_true_peak(), f"SELECT {_DB.format('max(abs(y))')} AS v FROM up"),
    "sti_proxy": (
        f"{TAIL}, il AS (SELECT max(n) + 1 AS length FROM imp), {starts('xs', 'il', 1024, 256, True)}, xl AS (SELECT {_DB.format('sqrt(sum(x * x) / 1024)')} AS v FROM xs JOIN imp ON n >= start AND n < start + 1024 GROUP BY frame)",
        f"""SELECT greatest(0, least(1, 1 / (1 + exp(-(10 * log10(e50 / greatest(e - e50, 1e-12)) - 2) / 2)) / (1 + exp(-(snr - 6) / 4)) * exp(-greatest(coalesce(rt, 1) - 0.6e0, 0) / 1.8e0))) AS v
FROM en, (SELECT quantile_cont(v, 0.9e0) - quantile_cont(v, 0.1e0) AS snr FROM xl), (SELECT v AS rt FROM ({_FIT.format(-5, -35)}))""",
    ),
    "t20_s": (TAIL, _FIT.format(-5, -25)),
    "t30_s": (TAIL, _FIT.format(-5, -35)),
    "ts_ms": (TAIL, "SELECT te / (e + 1e-12) * 1000 AS v FROM en"),
    "g_strength_db": (TAIL, "SELECT 10 * log10((e + 1e-12) / 1e-12) AS v FROM en"),
    "lf_ratio": (EARLY, f"SELECT {_LF} AS v FROM el"),
    "lfc_ratio": (EARLY, f"SELECT {_LF} * {_R.format('abs')} AS v FROM el"),
    "ndsi": (SPECTRUM, "SELECT (b - a) / (b + a + 1e-12) AS v FROM (SELECT sum(CASE WHEN f >= 2000 AND f < 4000 THEN m * m ELSE 0 END) AS b, sum(CASE WHEN f >= 1000 AND f < 2000 THEN m * m ELSE 0 END) AS a FROM mag)"),
    "adi": (_ADI, "SELECT -sum(q * ln(q + 1e-12)) / ln(3) AS v FROM sh"),
    "aei": (_ADI, "SELECT 1 / sum(q * q + 1e-12) / 3 AS v FROM sh"),
    "acoustic_entropy": (
        f"""{SPECTRUM}, pf AS (SELECT k, avg(m * m) AS p FROM mag GROUP BY k), pq AS (SELECT p / (sum(p) OVER () + 1e-12) AS q FROM pf),
tp AS (SELECT greatest(max(abs(x)), 1e-12) AS t, count(*) AS c FROM mono),
hg AS (SELECT least(63, floor(round(abs(x) / t * 64, 9))) AS s, count(*) / (max(c) + 1e-12) AS q FROM mono, tp GROUP BY 1)""",
        "SELECT (SELECT -sum(q * ln(q + 1e-12)) / ln(33 + 1e-12) FROM pq) * (SELECT -sum(q * ln(q + 1e-12)) / ln(64 + 1e-12) FROM hg) AS v",
    ),
    "eco_octave_trends": (bands(1), "SELECT CASE WHEN stddev_pop(level) > 1e-12 THEN regr_slope(level, (frame * 32 + 32) / 8e3) ELSE 0 END AS v FROM bl GROUP BY band"),
    "iacc": (_IACC, "SELECT v FROM ia"),
    "ild_db": (PAIRS, "SELECT 20 * log10(greatest(sqrt(aa), 1e-12) / greatest(sqrt(bb), 1e-12)) AS v FROM pr"),
    "ipd_rad": (STEREO_FT, "SELECT atan2(sum(a.im * b.re - a.re * b.im), sum(a.re * b.re + a.im * b.im)) AS v FROM fa a JOIN fb b USING (frame, k) GROUP BY frame"),
    "itd_s": (_PHAT, "SELECT v FROM dl"),
    "ambisonic_diffuseness": (FOUR, "SELECT greatest(0, least(1, 1 - sqrt(avg(x0 * x1) ** 2 + avg(x0 * x2) ** 2 + avg(x0 * x3) ** 2) / (avg(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) + 1e-12))) AS v FROM q"),
    "ambisonic_energy_vector_azimuth_deg": (FOUR, "SELECT degrees(atan2(avg(x0 * x2), avg(x0 * x1))) AS v FROM q"),
    "ambisonic_energy_vector_elevation_deg": (FOUR, "SELECT degrees(atan2(avg(x0 * x3), sqrt(avg(x0 * x1) ** 2 + avg(x0 * x2) ** 2) + 1e-12)) AS v FROM q"),
    "doa_azimuth_proxy_deg": (_PHAT, "SELECT degrees(asin(greatest(-1, least(1, avg(v) * 343 / 0.2e0)))) AS v FROM dl"),
    "clipping_ratio": (MONO, "SELECT avg(CASE WHEN abs(x) >= 0.999e0 THEN 1e0 ELSE 0 END) AS v FROM mono"),
    "clipping_event_count": (MONO, "SELECT sum(CASE WHEN c AND NOT b THEN 1e0 ELSE 0 END) AS v FROM (SELECT abs(x) >= 0.999e0 AS c, lag(abs(x) >= 0.999e0) OVER (ORDER BY n) AS b FROM mono)"),
    "dc_offset": (MONO, "SELECT avg(x) AS v FROM mono"),
    "dropout_ratio": (LEVELS, f"SELECT {_QUIET.format('AND r < 1e-4')} AS v FROM lev"),
    "silence_ratio": (LEVELS, f"SELECT {_QUIET.format('')} AS v FROM lev"),
    "calibration_drift_db": (f"one AS (SELECT {_X} AS x FROM events WHERE event_id % 2 = 1)", f"SELECT {_DB.format('sqrt(avg(x * x))')} + 20 AS v FROM one"),
    "isolation_forest_score": (SHAPES, f"SELECT {_ANOMALY} AS v FROM shapes"),
    "ocsvm_score": (SHAPES, f"SELECT {_ANOMALY} AS v FROM shapes"),
    "octave_band_level_db": (bands(1), f"SELECT {_LEQ.format('level')} AS v FROM bl GROUP BY band"),
    "third_octave_band_level_db": (bands(3), f"SELECT {_LEQ.format('level')} AS v FROM bl GROUP BY band"),
    "uptime_ratio": (LEVELS, f"SELECT 1 - {_QUIET.format('AND r < 1e-4')} AS v FROM lev"),
    "completeness_ratio": (LEVELS, f"SELECT (1 - {_QUIET.format('AND r < 1e-4')}) * (SELECT avg(CASE WHEN x IS NOT NULL AND NOT isnan(x) THEN 1e0 ELSE 0 END) FROM mono) AS v FROM lev"),
    "diurnal_coverage_ratio": (MONO, "SELECT count(DISTINCT hour(TIMESTAMP '2024-03-01 21:30:00' + INTERVAL 30 MINUTE * i)) / 24e0 AS v FROM (SELECT unnest(range(0, CAST(floor(length / 8e3 / 1800) AS BIGINT) + 1)) AS i FROM len)"),
    "site_comparability_score": (MONO, "SELECT 0.4e0 + 0.2e0 * 0.7e0 + 0.2e0 + 0.2e0 * (1 - avg(CASE WHEN abs(x) >= 0.999e0 THEN 1e0 ELSE 0 END)) AS v FROM mono"),
}


TWO = f"""ch AS (SELECT event_id % 2 AS c, event_id // 2 AS n, {_X} AS x FROM events), len AS (SELECT max(n) + 1 AS length FROM ch)"""
LEVELS_TWO = f"""{TWO}, {starts("fs", "len", 1024, 256, True)},
pc AS (SELECT frame, c, sum(x * x) / 1024 AS p, max(abs(x)) AS pk, sum(abs(x)) / 1024 AS a FROM fs JOIN ch ON n >= start AND n < start + 1024 GROUP BY frame, c),
lev AS (SELECT frame, sqrt(avg(p)) AS r, max(pk) AS pk, avg(a) AS a, avg(sqrt(p)) AS rm FROM pc GROUP BY frame)"""
_SPL_TWO = f"SELECT {_DB.format('rm')} + 94 AS v FROM lev"
_GATE_TWO = f"""{loudness(0.4, TWO, 3)}, ug AS (SELECT -0.691e0 + {_PDB.format("avg(e)")} AS u FROM lk WHERE v > -70)"""

#: The same over the events as two channels at 16 kHz.
SERIES_TWO: dict[str, tuple[str, str]] = {
    **{n: (LEVELS_TWO, SERIES[n][1]) for n in ("rms_dbfs", "peak_dbfs", "crest_factor_db", "dropout_ratio", "silence_ratio", "uptime_ratio")},
    "spl_z_db": (LEVELS_TWO, _SPL_TWO),
    "snr_db": (LEVELS_TWO, f"SELECT quantile_cont(v, 0.9e0) - quantile_cont(v, 0.1e0) AS v FROM (SELECT {_DB.format('r')} AS v FROM lev)"),
    "leq_db": (LEVELS_TWO, f"SELECT {_LEQ.format('v')} AS v FROM ({_SPL_TWO})"),
    "lmax_db": (LEVELS_TWO, f"SELECT max(v) AS v FROM ({_SPL_TWO})"),
    "lmin_db": (LEVELS_TWO, f"SELECT min(v) AS v FROM ({_SPL_TWO})"),
    **{f"l{p}_db": (LEVELS_TWO, f"SELECT quantile_cont(v, {(100 - p) / 100}e0) AS v FROM ({_SPL_TWO})") for p in (10, 50, 90, 95)},
    "sel_db": (LEVELS_TWO, f"SELECT {_LEQ.format('v')} + 10 * log10(greatest((SELECT length FROM len) / 16e3, 1e-12)) AS v FROM ({_SPL_TWO})"),
    "lpeak_dbfs": (TWO, f"SELECT {_DB.format('max(abs(x))')} AS v FROM ch"),
    "clipping_ratio": (TWO, "SELECT avg(CASE WHEN abs(x) >= 0.999e0 THEN 1e0 ELSE 0 END) AS v FROM ch"),
    "clipping_event_count": (TWO, "SELECT sum(CASE WHEN k AND NOT b THEN 1e0 ELSE 0 END) AS v FROM (SELECT k, lag(k) OVER (ORDER BY n) AS b FROM (SELECT n, max(abs(x)) >= 0.999e0 AS k FROM ch GROUP BY n))"),
    "dc_offset": (TWO, "SELECT avg(x) AS v FROM ch"),
    "integrated_lufs": (_GATE_TWO, f"SELECT coalesce((SELECT -0.691e0 + {_PDB.format('avg(e)')} FROM lk, ug WHERE v > -70 AND v >= u - 10), (SELECT u FROM ug), -120) AS v"),
    "momentary_lufs": (loudness(0.4, TWO, 3), "SELECT v FROM lk"),
    "interchannel_coherence": SERIES["interchannel_coherence"],
}


def two_channel_sql(name: str) -> str:
    """The summary row of a metric of two channels at 16 kHz."""
    return _summary_sql(name, *SERIES_TWO[name])


def metric_sql(name: str) -> str | None:
    """The summary row of a metric."""
    if name not in SERIES:
        return None
    return _summary_sql(name, *SERIES[name])


def _summary_sql(name: str, ctes: str, series: str) -> str:
    m = METRICS[name]
    r = lambda e: f"round({e}, 6) + 0e0"
    return f"""WITH {ctes}, series AS ({series}), good AS (SELECT v FROM series WHERE v IS NOT NULL AND isfinite(v))
SELECT 'events' AS recording_id, '{name}' AS metric, '{m.units}' AS units, {float(np.float64(m.confidence))!r}::DOUBLE AS confidence, count(v) AS n, {r("avg(v)")} AS mean, {r("stddev_pop(v)")} AS std,
{r("min(v)")} AS min, {r("max(v)")} AS max, {r("quantile_cont(v, 0.5e0)")} AS p50, {r("quantile_cont(v, 0.95e0)")} AS p95 FROM good"""
