"""Named queries of the general data-preparation operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions.levels import rounded
from sonarlake.operators.drift import changes, field, unify, version_changes
from sonarlake.operators.grid import regular_grid
from sonarlake.operators.intervals import moment_periods
from sonarlake.operators.spikes import implausible_readings
from sonarlake.sources.tables import table

GRID_METRICS = ("rms_dbfs", "spectral_centroid_hz")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots between the first and last reading that hold none."""
    grid = regular_grid(table(spark, d, "frame_table"), table(spark, d, "recordings"), GRID_METRICS)
    return grid.where("state <> 'observed'").select("recording_id", "metric", "slot")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular series themselves."""
    return regular_grid(table(spark, d, "frame_table"), table(spark, d, "recordings"), (*GRID_METRICS, "zero_crossing_rate"))


def p3_observed(spark: SparkSession, d: str) -> DataFrame:
    """Slots that hold readings: their mean, which filling does not touch."""
    grid = regular_grid(table(spark, d, "frame_table"), table(spark, d, "recordings"), GRID_METRICS).where("state = 'observed'")
    return rounded(grid.select("recording_id", "metric", "slot", "value", "readings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and the gaps between them."""
    return moment_periods(table(spark, d, "moments"), table(spark, d, "moments_config")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Impossible, stuck and spiking readings."""
    return implausible_readings(table(spark, d, "metric_series"), table(spark, d, "metric_catalog")).select("reading_id").distinct()


def p5_certain(spark: SparkSession, d: str) -> DataFrame:
    """Impossible and stuck readings, which need no estimate."""
    found = implausible_readings(table(spark, d, "metric_series"), table(spark, d, "metric_catalog"))
    return found.where("kind <> 'spike'").select("reading_id", "kind").distinct()


def p5_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """How many readings of each metric are implausible, and why."""
    found = implausible_readings(table(spark, d, "metric_series"), table(spark, d, "metric_catalog"))
    return found.groupBy("metric", "kind").agg(F.countDistinct("reading_id").alias("readings"), F.countDistinct("recording_id").alias("recordings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of structure from document to document."""
    return changes(table(spark, d, "result_docs")).select("result_id", "change_kind", "old_path", "new_path").distinct()


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All documents as one table, with the fields that the problem names wherever they stand."""
    rows, _ = unify(table(spark, d, "result_docs"))
    pick = lambda *paths: F.coalesce(*[field(p) for p in paths])
    return rows.select(
        "result_id", "producer", "written_at", "readable",
        pick("schema_version", "metadata.schema_version").alias("schema_version"),
        pick("metadata.metric_catalog_version", "metric_catalog_version", "metric_catalog.version").alias("metric_catalog_version"),
        pick("metadata.resolved_metric_list", "resolved_metric_list", "metric_catalog.selected_metrics").alias("resolved_metric_list"),
        F.to_json("fields").alias("fields"),
    )


#: Fields that the problem names, by the paths that they have where nobody renamed them.
NAMED = {"schema_version": "schema_version", "metric_catalog_version": "metadata.metric_catalog_version"}


def p6_named(spark: SparkSession, d: str) -> DataFrame:
    """Two of the named fields of every document, under whatever name its producer gave them."""
    rows, _ = unify(table(spark, d, "result_docs"))
    return rows.where("readable").select("result_id", *[field(path).alias(name) for name, path in NAMED.items()])


def p6_readable(spark: SparkSession, d: str) -> DataFrame:
    """Of every document, whether it is readable and how many fields of it are in the unified table: none is lost."""
    rows, _ = unify(table(spark, d, "result_docs"))
    return rows.select("result_id", "producer", "readable", F.when(F.col("readable"), F.size("fields")).otherwise(0).cast("long").alias("n_fields"))


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    """Changes from version to version, with renamings matched by the profiles of all values."""
    return version_changes(table(spark, d, "result_docs"))


QUERIES = {f.__name__: f for f in (p3_found, p3_grid, p3_observed, p4_found, p5_found, p5_certain, p5_by_kind, p6_found, p6_table, p6_named, p6_readable, p6_versions)}

SQL = {
    "p3_observed": """
WITH steps AS (SELECT recording_id, min(grid_step_s) AS step FROM recordings WHERE grid_step_s > 0 GROUP BY recording_id),
long AS (
  SELECT recording_id, 'rms_dbfs' AS metric, timestamp_s AS ts, rms_dbfs AS x FROM frame_table
  UNION SELECT recording_id, 'spectral_centroid_hz', timestamp_s, spectral_centroid_hz FROM frame_table)
SELECT recording_id, metric, CAST(floor(ts / step) AS BIGINT) AS slot, round(avg(x), 6) + 0e0 AS value, count(*) AS readings FROM long JOIN steps USING (recording_id)
WHERE ts IS NOT NULL AND NOT isnan(ts) AND x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2, 3""",
    "p6_readable": """
WITH docs AS (SELECT DISTINCT ON (result_id) result_id, producer, payload, CASE WHEN payload IS NOT NULL AND json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS readable FROM result_docs),
leaves AS (SELECT d.result_id, count(*) AS n FROM (SELECT result_id, CASE WHEN readable THEN payload ELSE '{}' END AS payload FROM docs) d, json_tree(d.payload) t
  WHERE t.fullkey <> '$' AND t.fullkey NOT LIKE '%[%' AND t.path <> '$.metrics' AND t.path NOT LIKE '$.metrics.%' AND (t.type <> 'OBJECT' OR t.fullkey = '$.metrics') GROUP BY d.result_id)
SELECT result_id, producer, coalesce(readable, false) AS readable, CASE WHEN readable THEN coalesce(n, 0) ELSE 0 END AS n_fields FROM docs LEFT JOIN leaves USING (result_id)""",
    "p5_certain": """
WITH limits AS (SELECT metric, min(valid_min) AS low, max(valid_max) AS high FROM metric_catalog WHERE monitored GROUP BY metric),
r AS (SELECT DISTINCT ON (reading_id) reading_id, recording_id, metric, timestamp_s AS ts, value, low, high FROM metric_series JOIN limits USING (metric)
  WHERE value IS NOT NULL AND NOT isnan(value) AND timestamp_s IS NOT NULL AND reading_id IS NOT NULL AND recording_id IS NOT NULL),
d AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS moved FROM r WINDOW w AS (PARTITION BY recording_id, metric ORDER BY ts, reading_id)),
u AS (SELECT *, sum(moved) OVER (PARTITION BY recording_id, metric ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS run FROM d),
c AS (SELECT *, count(*) OVER (PARTITION BY recording_id, metric, run) AS n FROM u)
SELECT reading_id, CASE WHEN coalesce(value < low, false) OR coalesce(value > high, false) THEN 'impossible' ELSE 'stuck' END AS kind FROM c
WHERE n >= 10 OR coalesce(value < low, false) OR coalesce(value > high, false)""",
    "p3_found": """
WITH steps AS (SELECT recording_id, min(grid_step_s) AS step FROM recordings WHERE grid_step_s > 0 GROUP BY recording_id),
long AS (
  SELECT recording_id, 'rms_dbfs' AS metric, timestamp_s AS ts, rms_dbfs AS x FROM frame_table
  UNION ALL SELECT recording_id, 'spectral_centroid_hz', timestamp_s, spectral_centroid_hz FROM frame_table),
held AS (
  SELECT DISTINCT recording_id, metric, CAST(floor(ts / step) AS BIGINT) AS slot FROM long JOIN steps USING (recording_id)
  WHERE ts IS NOT NULL AND NOT isnan(ts) AND x IS NOT NULL AND NOT isnan(x)),
spans AS (SELECT recording_id, metric, unnest(range(min(slot), max(slot) + 1)) AS slot FROM held GROUP BY recording_id, metric)
SELECT recording_id, metric, slot FROM spans ANTI JOIN held USING (recording_id, metric, slot)""",
    "p4_found": """
WITH gaps AS (SELECT project, CAST(round(max(merge_gap_s) * 1000) AS BIGINT) AS gap FROM moments_config GROUP BY project),
parsed AS (
  SELECT recording_id, project, duration_s, start_s, end_s,
    split_part(start_hms, ':', 1)::DOUBLE * 3600 + split_part(start_hms, ':', 2)::DOUBLE * 60 + split_part(start_hms, ':', 3)::DOUBLE AS hs,
    split_part(end_hms, ':', 1)::DOUBLE * 3600 + split_part(end_hms, ':', 2)::DOUBLE * 60 + split_part(end_hms, ':', 3)::DOUBLE AS he
  FROM moments),
timed AS (
  SELECT recording_id, project, CAST(round(coalesce(start_s, hs) * 1000) AS BIGINT) AS s,
    CAST(round(coalesce(end_s, he, coalesce(start_s, hs) + duration_s) * 1000) AS BIGINT) AS e FROM parsed),
rows_ AS (SELECT recording_id, s, e, coalesce(gap, 0) AS gap FROM timed LEFT JOIN gaps USING (project) WHERE s IS NOT NULL AND e >= s),
seen AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rows_),
marked AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top + gap THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
periods AS (SELECT recording_id, island, min(s) AS s, max(e) AS e FROM marked GROUP BY recording_id, island)
SELECT recording_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
UNION ALL SELECT recording_id, 'gap', e, n FROM (SELECT *, lead(s) OVER (PARTITION BY recording_id ORDER BY island) AS n FROM periods) WHERE n IS NOT NULL""",
    "p6_found": """
WITH docs AS (SELECT DISTINCT ON (result_id) result_id, producer, written_at, payload FROM result_docs WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
pairs AS (SELECT result_id, lag(result_id) OVER (PARTITION BY producer ORDER BY written_at, result_id) AS before FROM docs),
members AS (
  SELECT d.result_id, t.path AS obj, t.key, t.fullkey, CASE WHEN t.type IN ('VARCHAR', 'BOOLEAN', 'NULL', 'ARRAY', 'OBJECT') THEN t.type ELSE 'NUMBER' END AS kind
  FROM docs d, json_tree(d.payload) t WHERE t.fullkey <> '$' AND t.fullkey NOT LIKE '%[%' AND t.path <> '$.metrics' AND t.path NOT LIKE '$.metrics.%'),
objects AS (SELECT result_id, '$' AS obj FROM docs UNION ALL SELECT result_id, fullkey FROM members WHERE kind = 'OBJECT' AND fullkey <> '$.metrics'),
kept AS (SELECT p.result_id, p.before, n.obj FROM pairs p JOIN objects n ON n.result_id = p.result_id JOIN objects o ON o.result_id = p.before AND o.obj = n.obj),
new AS (SELECT k.result_id, k.obj, m.key, m.fullkey, m.kind FROM kept k JOIN members m ON m.result_id = k.result_id AND m.obj = k.obj),
old AS (SELECT k.result_id, k.obj, m.key, m.fullkey, m.kind FROM kept k JOIN members m ON m.result_id = k.before AND m.obj = k.obj),
come AS (SELECT *, count(*) OVER (PARTITION BY result_id, obj) AS c FROM new ANTI JOIN old USING (result_id, obj, key)),
gone AS (SELECT *, count(*) OVER (PARTITION BY result_id, obj) AS c FROM old ANTI JOIN new USING (result_id, obj, key)),
renamed AS (SELECT g.result_id, g.obj, g.fullkey AS f, c.fullkey AS t FROM gone g JOIN come c USING (result_id, obj) WHERE g.c = 1 AND c.c = 1 AND g.kind = c.kind)
SELECT result_id, 'renamed' AS change_kind, substr(f, 3) AS old_path, substr(t, 3) AS new_path FROM renamed
UNION ALL SELECT result_id, 'added', '', substr(fullkey, 3) FROM come ANTI JOIN renamed USING (result_id, obj)
UNION ALL SELECT result_id, 'removed', substr(fullkey, 3), '' FROM gone ANTI JOIN renamed USING (result_id, obj)
UNION ALL SELECT result_id, 'type_changed', substr(n.fullkey, 3), substr(n.fullkey, 3) FROM new n JOIN old o USING (result_id, obj, key) WHERE n.kind <> o.kind AND n.kind <> 'NULL' AND o.kind <> 'NULL'""",
}

SQL["p6_named"] = f"""
WITH RECURSIVE ch AS ({SQL["p6_found"]}),
rn AS (SELECT DISTINCT producer, old_path AS a, new_path AS b FROM ch JOIN (SELECT DISTINCT result_id, producer FROM result_docs) USING (result_id) WHERE change_kind = 'renamed'),
ed AS (SELECT producer, a, b FROM rn UNION SELECT producer, b, a FROM rn),
reach(producer, want, path) AS (SELECT DISTINCT producer, w, w FROM result_docs, (VALUES {", ".join(f"('{p}')" for p in NAMED.values())}) t(w)
  UNION SELECT r.producer, r.want, e.b FROM reach r JOIN ed e ON e.producer = r.producer AND e.a = r.path),
names AS (SELECT *, min(path) OVER (PARTITION BY producer, want) AS name FROM reach),
docs AS (SELECT DISTINCT ON (result_id) result_id, producer, CASE WHEN json_valid(payload) THEN payload END AS payload FROM result_docs WHERE payload IS NOT NULL),
whole AS (SELECT * FROM docs WHERE payload IS NOT NULL AND json_type(payload) = 'OBJECT'),
held AS (SELECT result_id, want, path, name, json_extract_string(payload, '$.' || path) AS v FROM whole JOIN names USING (producer) WHERE coalesce(json_type(payload, '$.' || path), 'OBJECT') <> 'OBJECT'),
picked AS (SELECT result_id, want, coalesce(arg_min(coalesce(v, chr(0)), (path <> name, path)), chr(0)) AS v, max(CASE WHEN path = want THEN v END) AS own FROM held GROUP BY result_id, want),
told AS (SELECT result_id, want, coalesce(nullif(v, chr(0)), own) AS v FROM picked)
SELECT result_id, {", ".join(f"max(CASE WHEN want = '{p}' THEN v END) AS {n}" for n, p in NAMED.items())} FROM whole LEFT JOIN told USING (result_id) GROUP BY result_id"""
