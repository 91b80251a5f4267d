"""Named queries that run as streams over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions.levels import rounded
from sonarlake.sources.tables import table
from sonarlake.streaming.chunks import alert_rows, metric_means, rule_alerts, run_available, windowed_means

LOW, HIGH = 30.0, 90.0


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ltz").alias("ts"), "value")


def streamed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of each type of event that break a limit, by a stream with a watermark."""
    rows = alert_rows(run_available(windowed_means(_events(spark, d), 3600), ["source", "start"]), LOW, HIGH)
    return rounded(rows.select("source", F.unix_micros("start").alias("start_us"), "value", "condition", "threshold"))


#: Limits of the hourly means that the example rules watch.
RULES = [("click", 40.0, 60.0), ("purchase", None, 55.0), ("view", 45.0, None)]


def streamed_rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of each user and type of event that break the rule of that type, by a stream with a watermark."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    readings = s.select(F.pmod("user_id", F.lit(10)).cast("string").alias("source"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp_ltz").alias("ts"), "value")
    means = run_available(metric_means(readings, 3600), ["source", "metric", "start"])
    rules = spark.createDataFrame(RULES, "metric string, min double, max double")
    return rounded(rule_alerts(means, rules).select("source", "metric", F.unix_micros("start").alias("start_us"), "value", "condition", "threshold"))


QUERIES = {"streamed_alerts": streamed_alerts, "streamed_rule_alerts": streamed_rule_alerts}
SQL = {
    "streamed_rule_alerts": f"""WITH ru(metric, lo, hi) AS (VALUES {", ".join(f"('{m}', {'NULL' if a is None else a}::DOUBLE, {'NULL' if b is None else b}::DOUBLE)" for m, a, b in RULES)}),
w AS (SELECT CAST(user_id % 10 AS VARCHAR) AS source, event_type AS metric, epoch_us(date_trunc('hour', ts)) AS start_us, avg(value) AS mean FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3)
SELECT source, metric, start_us, round(mean, 6) AS value, 'min' AS condition, lo AS threshold FROM w JOIN ru USING (metric) WHERE mean < lo
UNION ALL SELECT source, metric, start_us, round(mean, 6), 'max', hi FROM w JOIN ru USING (metric) WHERE mean > hi""",
    "streamed_alerts": f"""WITH w AS (SELECT event_type AS source, epoch_us(date_trunc('hour', ts)) AS start_us, avg(value) AS mean FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2)
SELECT source, start_us, round(mean, 6) AS value, 'min' AS condition, {LOW!r}::DOUBLE AS threshold FROM w WHERE mean < {LOW!r}::DOUBLE
UNION ALL SELECT source, start_us, round(mean, 6), 'max', {HIGH!r}::DOUBLE FROM w WHERE mean > {HIGH!r}::DOUBLE""",
}
