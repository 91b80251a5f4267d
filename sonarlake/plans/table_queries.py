"""Named queries over the project's tables: chunks, alerts, moments, validation, comparison, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions.levels import rounded, settled, settled_sql
from sonarlake.operators import reports, rules
from sonarlake.sources import recordings
from sonarlake.sources.tables import table

CHUNK_S = 10.0
#: Limits of the mean of a chunk that the example rules watch.
LIMITS = [("rms_dbfs", -60.0, -35.0), ("spl_a_db", 40.0, 80.0), ("snr_db", 5.0, None), ("spectral_centroid_hz", None, 7000.0), ("novelty_curve", None, 0.6)]
CHECKS = [("rms_dbfs", -60.0, -30.0), ("spl_a_db", 45.0, 75.0), ("snr_db", 10.0, 40.0), ("rt60_s", None, 3.0)]
FRAME_METRICS = ["rms_dbfs", "spectral_centroid_hz", "zero_crossing_rate"]
DIGEST = ["spl_a_db", "snr_db", "rt60_s"]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "metric string, min double, max double")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return rules.chunk_means(table(spark, d, "metric_series"), CHUNK_S)


def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means of every metric over tumbling windows of ten seconds."""
    return settled(_chunks(spark, d), "mean")


def stream_aggregate_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the chunks' means."""
    return settled(_chunks(spark, d).groupBy("recording_id", "metric").agg(F.avg("mean").alias("mean"), F.count("*").alias("chunks")), "mean")


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose mean breaks a limit."""
    return rounded(rules.alerts(_chunks(spark, d), _rules(spark)))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_results")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("recording_id", "name", F.col("summary.mean").alias("value"))


def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every check of every recording."""
    return rounded(rules.validation(table(spark, d, "recordings"), _values(spark, d), CHECKS).withColumn("value", F.when(~F.isnan("value"), F.col("value"))))


def validation_file_status(spark: SparkSession, d: str) -> DataFrame:
    """Checks and failures per recording."""
    return rules.file_status(rules.validation(table(spark, d, "recordings"), _values(spark, d), CHECKS))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    found = rules.alerts(_chunks(spark, d), _rules(spark))
    meta = table(spark, d, "recordings").groupBy("recording_id").agg(F.max("project").alias("project"), F.max("duration_s").alias("duration_s"))
    config = table(spark, d, "moments_config").select("project", "pre_roll_s", "post_roll_s", "min_alerts_per_chunk")
    named = found.join(meta, "recording_id", "left").join(config, "project", "left")
    c = F.col
    return rules.windows(named, CHUNK_S, c("pre_roll_s"), c("post_roll_s"), c("min_alerts_per_chunk"), c("duration_s"), "spl_a_db")


def moments_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows around chunks with enough alerts."""
    return rounded(_windows(spark, d))


def moments_merge(spark: SparkSession, d: str) -> DataFrame:
    """Windows no more than two seconds apart, joined."""
    return rounded(rules.merged(_windows(spark, d), 2000))


def moments_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best moments of each recording."""
    return rounded(rules.best(rules.merged(_windows(spark, d), 2000), 3))


def moments_single(spark: SparkSession, d: str) -> DataFrame:
    """The best moment of each recording."""
    return rounded(rules.best(rules.merged(_windows(spark, d), 2000), 1)).drop("rank")


def project_latest(spark: SparkSession, d: str) -> DataFrame:
    """The recording made last in each project and format."""
    rows = table(spark, d, "recordings").where("project is not null").withColumn("variant", F.upper("format"))
    return reports.latest(rows, ["project", "variant"], ["recorded_at", "recording_id"], ["recording_id", "sample_rate", "channels"])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    values = _values(spark, d).where("value is not null and not isnan(value)").withColumnRenamed("name", "metric")
    return project_latest(spark, d).join(values, "recording_id").select("project", "variant", "metric", "value")


def project_compare(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each project's variants against its first."""
    return rounded(reports.compare_variants(_runs(spark, d)))


def pipeline_digest(spark: SparkSession, d: str) -> DataFrame:
    """One row per recording with the means of a few metrics."""
    return rounded(reports.digest(table(spark, d, "recordings"), _results(spark, d), DIGEST))


def pipeline_resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Recordings with moments but without a stored result of rt60_s."""
    return reports.pending(table(spark, d, "moments"), _results(spark, d).where("name = 'rt60_s'"), "recording_id")


def export_summary_long(spark: SparkSession, d: str) -> DataFrame:
    """Summaries, one row per statistic."""
    return reports.summary_long(_results(spark, d))


def export_series_long(spark: SparkSession, d: str) -> DataFrame:
    """Series, one row per reading."""
    return rules.once(table(spark, d, "metric_series")).select("recording_id", "metric", "timestamp_s", "value", "units")


def export_industrial(spark: SparkSession, d: str) -> DataFrame:
    """Results as laboratory systems import them."""
    return reports.industrial(_results(spark, d), "HEAD Acoustics", "2048@hop512")


def frame_table_long(spark: SparkSession, d: str) -> DataFrame:
    """The frame table, one row per value."""
    return reports.frame_long(table(spark, d, "frame_table"), FRAME_METRICS)


def frame_table_wide(spark: SparkSession, d: str) -> DataFrame:
    """The frame table put together again from its long form."""
    return reports.frame_wide(frame_table_long(spark, d), FRAME_METRICS)


def impute_col_mean(spark: SparkSession, d: str) -> DataFrame:
    """The frame table with holes filled by column means."""
    return settled(reports.impute_means(frame_table_wide(spark, d), FRAME_METRICS), *FRAME_METRICS)


def clip_vector(spark: SparkSession, d: str) -> DataFrame:
    """Means of each recording as a vector in the order of names."""
    return rounded(reports.clip_vector(_results(spark, d)).withColumn("value", F.when(~F.isnan("value"), F.col("value"))))


def layout_hint(spark: SparkSession, d: str) -> DataFrame:
    """The layout of channels that a recording's number of channels and path suggest."""
    rows = table(spark, d, "recordings").select("recording_id", "channels", "format").distinct()
    return rows.select("recording_id", "channels", recordings.layout_hint(F.col("channels"), F.col("recording_id")).alias("layout")).distinct()


def session_moments(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events of each user with pauses of at most an hour."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp_ltz").alias("ts"), "value")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("events"), F.max("value").alias("top"), F.max("ts").alias("last"))
    return rounded(s.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events", "top"))


_FUNCTIONS = (
    chunk_metrics, stream_aggregate_means, stream_alerts, validation_rows, validation_file_status, moments_windows, moments_merge, moments_topk, moments_single, project_latest, project_compare,
    pipeline_digest, pipeline_resume_anti_join, export_summary_long, export_series_long, export_industrial, frame_table_long, frame_table_wide, impute_col_mean, clip_vector, layout_hint, session_moments,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _values_sql(rows: list[tuple[str, float | None, float | None]], name: str, cols: str) -> str:
    cell = lambda x: "NULL::DOUBLE" if x is None else f"{x!r}::DOUBLE"
    return f"{name}({cols}) AS (VALUES " + ", ".join(f"('{m}', {cell(lo)}, {cell(hi)})" for m, lo, hi in rows) + ")"


_ONCE = "rd AS (SELECT DISTINCT ON (reading_id) reading_id, recording_id, metric, timestamp_s, value, units FROM metric_series WHERE value IS NOT NULL AND NOT isnan(value) AND timestamp_s IS NOT NULL)"
_CHUNKS = f"{_ONCE}, ch AS (SELECT recording_id, CAST(floor(timestamp_s / 10) AS BIGINT) AS chunk_index, metric, avg(value) AS mean, count(*) AS n FROM rd GROUP BY 1, 2, 3)"
_ALERTS = f"""{_CHUNKS}, {_values_sql(LIMITS, "ru", "metric, lo, hi")}, al AS (
SELECT recording_id, chunk_index, metric, mean AS value, 'min' AS condition, lo AS threshold FROM ch JOIN ru USING (metric) WHERE mean < lo
UNION ALL SELECT recording_id, chunk_index, metric, mean, 'max', hi FROM ch JOIN ru USING (metric) WHERE mean > hi)"""
_WINDOWS = f"""{_ALERTS}, meta AS (SELECT recording_id, max(project) AS project, max(duration_s) AS dur FROM recordings GROUP BY 1),
nw AS (SELECT recording_id, chunk_index, count(*) AS alerts, max(CASE WHEN metric = 'spl_a_db' THEN value END) AS best, max(pre_roll_s) AS b, max(post_roll_s) AS a, max(min_alerts_per_chunk) AS least, max(dur) AS dur
  FROM al LEFT JOIN meta USING (recording_id) LEFT JOIN moments_config USING (project) GROUP BY 1, 2),
win AS (SELECT recording_id, chunk_index, CAST(round(greatest(0, chunk_index * 10e0 - coalesce(b, 0)) * 1000) AS BIGINT) AS start_ms,
  CAST(round(least((chunk_index + 1) * 10e0 + coalesce(a, 0), coalesce(dur, 1e12)) * 1000) AS BIGINT) AS end_ms, alerts, coalesce(best, alerts::DOUBLE) AS rank_score, (chunk_index * 10e0 + (chunk_index + 1) * 10e0) / 2 AS center_s
  FROM nw WHERE alerts >= coalesce(least, 1))"""
_MERGED = f"""{_WINDOWS}, ok AS (SELECT * FROM win WHERE end_ms >= start_ms),
pv AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ok),
il AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms > pe + 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM pv),
mg AS (SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(alerts) AS BIGINT) AS alerts, count(*) AS chunks, max(rank_score) AS rank_score, arg_max(center_s, (rank_score, -start_ms)) AS event_center_s FROM il GROUP BY recording_id, k)"""
_MG = "recording_id, start_ms, end_ms, alerts, chunks, round(rank_score, 6) AS rank_score, round(event_center_s, 6) AS event_center_s"
_RANKED = f"{_MERGED}, rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY rank_score DESC, start_ms) AS rank FROM mg)"
_CHECKS = f"""{_values_sql(CHECKS, "ck", "name, expected_min, expected_max")}, f AS (SELECT DISTINCT recording_id FROM recordings), vv AS (SELECT recording_id, name, summary.mean AS value FROM metric_results),
vr AS (SELECT f.recording_id, ck.name, value, expected_min, expected_max, CASE WHEN value IS NULL THEN 'metric missing' WHEN NOT isnan(value) AND value < expected_min THEN 'below min' WHEN NOT isnan(value) AND value > expected_max THEN 'above max' ELSE '' END AS message
  FROM f CROSS JOIN ck LEFT JOIN vv ON vv.recording_id = f.recording_id AND vv.name = ck.name)"""
_LATEST = "lt AS (SELECT project, upper(format) AS variant, arg_max({'r': recording_id, 's': sample_rate, 'c': channels}, (recorded_at, recording_id)) AS x FROM recordings WHERE project IS NOT NULL GROUP BY 1, 2)"
_LONG = "fl AS (" + " UNION ".join(f"SELECT recording_id, timestamp_s, '{m}' AS metric, {m} AS value FROM frame_table WHERE timestamp_s IS NOT NULL AND NOT isnan(timestamp_s) AND {m} IS NOT NULL AND NOT isnan({m})" for m in FRAME_METRICS) + ")"
_WIDE = f"{_LONG}, fw AS (SELECT recording_id, timestamp_s, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in FRAME_METRICS) + " FROM fl GROUP BY 1, 2)"
_R = "round({0}, 6) AS {0}"

SQL = {
    "chunk_metrics": f"WITH {_CHUNKS} SELECT recording_id, chunk_index, metric, {settled_sql('mean')} AS mean, n FROM ch",
    "stream_aggregate_means": f"WITH {_CHUNKS} SELECT recording_id, metric, {settled_sql('avg(mean)')} AS mean, count(*) AS chunks FROM ch GROUP BY 1, 2",
    "stream_alerts": f"WITH {_ALERTS} SELECT recording_id, chunk_index, metric, {_R.format('value')}, condition, threshold FROM al",
    "validation_rows": f"WITH {_CHECKS} SELECT recording_id, name, CASE WHEN NOT isnan(value) THEN round(value, 6) END AS value, expected_min, expected_max, CASE WHEN message = '' THEN 'pass' ELSE 'fail' END AS status, message FROM vr",
    "validation_file_status": f"WITH {_CHECKS} SELECT recording_id, count(*) AS checks, CAST(sum(CASE WHEN message <> '' THEN 1 ELSE 0 END) AS BIGINT) AS failures, CASE WHEN bool_or(message <> '') THEN 'fail' ELSE 'pass' END AS status FROM vr GROUP BY 1",
    "moments_windows": f"WITH {_WINDOWS} SELECT recording_id, chunk_index, start_ms, end_ms, alerts, {_R.format('rank_score')}, {_R.format('center_s')} FROM win",
    "moments_merge": f"WITH {_MERGED} SELECT {_MG} FROM mg",
    "moments_topk": f"WITH {_RANKED} SELECT {_MG}, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 3",
    "moments_single": f"WITH {_RANKED} SELECT {_MG} FROM rk WHERE rank = 1",
    "project_latest": f"WITH {_LATEST} SELECT project, variant, x.r AS recording_id, x.s AS sample_rate, x.c AS channels FROM lt",
    "project_compare": f"""WITH {_LATEST}, runs AS (SELECT project, variant, name AS metric, summary.mean AS value FROM lt JOIN metric_results m ON m.recording_id = lt.x.r WHERE summary.mean IS NOT NULL AND NOT isnan(summary.mean)),
bs AS (SELECT project, min(variant) AS baseline FROM runs GROUP BY 1), bv AS (SELECT project, metric, value AS baseline_value FROM runs JOIN bs USING (project) WHERE variant = baseline)
SELECT project, baseline, variant, metric, round(baseline_value, 6) AS baseline_value, round(value, 6) AS value, round(value - baseline_value, 6) + 0e0 AS delta,
CASE WHEN abs(baseline_value) > 1e-12 THEN round(100 * (value - baseline_value) / abs(baseline_value), 6) + 0e0 END AS delta_pct FROM runs JOIN bs USING (project) LEFT JOIN bv USING (project, metric)""",
    "pipeline_digest": "WITH md AS (SELECT recording_id, max(duration_s) AS duration_s, max(channels) AS channels, max(sample_rate) AS sample_rate FROM recordings GROUP BY 1), mm AS (SELECT recording_id, "
    + ", ".join(f"max(CASE WHEN name = '{m}' AND NOT isnan(summary.mean) THEN summary.mean END) AS {m}_mean" for m in DIGEST)
    + " FROM metric_results GROUP BY 1) SELECT recording_id, round(duration_s, 6) AS duration_s, channels, sample_rate, " + ", ".join(f"round({m}_mean, 6) AS {m}_mean" for m in DIGEST) + " FROM md LEFT JOIN mm USING (recording_id)",
    "pipeline_resume_anti_join": "SELECT DISTINCT recording_id FROM moments WHERE recording_id NOT IN (SELECT recording_id FROM metric_results WHERE name = 'rt60_s')",
    "export_summary_long": " UNION ALL ".join(f"SELECT recording_id, name AS metric, '{s}' AS stat, summary.{s} AS value, units, confidence FROM metric_results WHERE summary.{s} IS NOT NULL AND NOT isnan(summary.{s})" for s in reports.STATS),
    "export_series_long": f"WITH {_ONCE} SELECT recording_id, metric, timestamp_s, value, units FROM rd",
    "export_industrial": "SELECT 'HEAD Acoustics' AS system, recording_id, name AS metric, CASE WHEN NOT isnan(summary.mean) THEN summary.mean END AS value_mean, CASE WHEN NOT isnan(summary.p95) THEN summary.p95 END AS value_p95, units, confidence, 'A/C/Z or unweighted per metric definition' AS weighting, '2048@hop512' AS windowing FROM metric_results",
    "frame_table_long": f"WITH {_LONG} SELECT * FROM fl",
    "frame_table_wide": f"WITH {_WIDE} SELECT * FROM fw",
    "impute_col_mean": f"WITH {_WIDE} SELECT recording_id, timestamp_s, " + ", ".join(f"{settled_sql(f'coalesce({m}, avg({m}) OVER (PARTITION BY recording_id), 0)')} AS {m}" for m in FRAME_METRICS) + " FROM fw",
    "clip_vector": "SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY name) - 1 AS INT) AS position, name, CASE WHEN NOT isnan(summary.mean) THEN round(summary.mean, 6) + 0e0 END AS value FROM metric_results",
    "layout_hint": "SELECT DISTINCT recording_id, channels, CASE WHEN channels = 1 THEN 'mono' WHEN channels = 4 AND regexp_matches(lower(recording_id), 'ambi|bformat|ambisonic') THEN 'ambisonic_b_format' WHEN channels > 2 THEN 'multichannel' WHEN channels = 2 THEN 'stereo' END AS layout FROM recordings",
    "session_moments": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events, round(max(value), 6) AS top FROM k GROUP BY user_id, s""",
}
