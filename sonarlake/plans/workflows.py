"""Workflows over folders of recordings: analysis, streams of chunks, moments, validation, projects, calibration, space, vectors, manifests."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarlake.functions.provenance import documents
from sonarlake.operators.intervals import label_intervals
from sonarlake.operators.metrics import METRICS, REC, analyze, bearing, chunked, metric_names, series, summary
from sonarlake.operators.quality import validity_flags
from sonarlake.operators.reports import latest
from sonarlake.operators.rules import alerts, cut_clips
from sonarlake.operators.vectors import feature_vectors
from sonarlake.plans.lineage import keep
from sonarlake.plans.pipeline import folder_source
from sonarlake.sources.exports import write_documents, write_table
from sonarlake.sources.fetch import fetch
from sonarlake.sources.recordings import audio_files, recordings, samples
from sonarlake.sources.settings import profiles, threshold_rules
from sonarlake.sources.signals import Settings
from sonarlake.sources.storage import exists, read_json, write_text
from sonarlake.sources.wav import clip_files


def analyze_folder(spark: SparkSession, folder: str, out: str, settings: Settings, metrics: list[str] | None = None, with_series: bool = True) -> dict:
    """Summaries, series, flags and documents of all recordings of a folder (or one file), written under ``out``; how many of each."""
    files = audio_files(spark, folder)
    write_table(recordings(files), f"{out}/recordings")
    meta = spark.read.parquet(f"{out}/recordings")
    source = folder_source(files, settings)
    write_table(analyze(source, metrics), f"{out}/results")
    flags = keep(validity_flags(source))
    write_table(flags, f"{out}/flags")
    made = None
    if with_series:
        write_table(series(source, metrics), f"{out}/series")
        made = spark.read.parquet(f"{out}/series")
    results = spark.read.parquet(f"{out}/results")
    write_documents(documents(results, settings, meta.where("error is null"), made, flags), f"{out}/documents")
    return {"recordings": meta.where("error is null").count(), "unreadable": meta.where("error is not null").count(), "results": results.count()}


def batch_index(meta: DataFrame, results: DataFrame) -> DataFrame:
    """input, duration_s, channels, sample_rate, snr_mean, spl_a_mean, rt60: one row per recording."""
    wanted = {"snr_db": "snr_mean", "spl_a_db": "spl_a_mean", "rt60_s": "rt60"}
    means = results.groupBy(REC).agg(*[F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(n) for m, n in wanted.items()])
    return meta.where("error is null").join(means, REC, "left").select(F.col(REC).alias("input"), "duration_s", "channels", "sample_rate", *wanted.values())


def chunk_report(spark: SparkSession, folder: str, settings: Settings, metrics: list[str], rules: dict, chunk: int = 131_072, most_chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, alerts) of a folder's recordings analysed chunk by chunk, as a stream gives them.

    chunks: recording_id, chunk_index, start_s, end_s, metric_means (map). alerts: recording_id, chunk_index, metric, value, condition, threshold. With ``most_chunks``
    only so many chunks of each recording are read; metrics named in the rules are computed as well.
    """
    names = list(dict.fromkeys([*metrics, *[m for m in rules.get("metric_thresholds", {}) if m in METRICS]]))
    source = folder_source(audio_files(spark, folder), settings)
    held = chunked(source, chunk)
    rows = None
    for name in metric_names(names):
        part = summary(held, name).select(REC, "metric", "mean")
        rows = part if rows is None else rows.unionByName(part)
    index = F.substring_index(REC, "#", -1).cast("long")
    means = rows.select(F.expr(f"substring({REC}, 1, length({REC}) - length(substring_index({REC}, '#', -1)) - 1)").alias(REC), index.alias("chunk_index"), "metric", "mean")
    means = keep(means if most_chunks is None else means.where(F.col("chunk_index") < most_chunks))
    lengths = source.lengths.select(REC, "length")
    made = means.groupBy(REC, "chunk_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "mean")))).alias("metric_means")).join(lengths, REC)  # as many as metrics
    span = lambda c: F.least(c * chunk, F.col("length")) / settings.rate
    chunks = made.select(REC, "chunk_index", span(F.col("chunk_index")).alias("start_s"), span(F.col("chunk_index") + 1).alias("end_s"), "metric_means")
    return chunks, alerts(means, threshold_rules(spark, rules))


@dataclass(frozen=True)
class Moments:
    """How moments are cut out around alerts."""

    pre_roll_s: float = 3.0
    post_roll_s: float = 3.0
    merge_gap_s: float = 2.0
    min_alerts_per_chunk: int = 1
    selection_mode: str = "all"  # all, single or top_k, for each recording
    top_k: int = 1
    rank_metric: str = "novelty_curve"
    event_window_s: float | None = None
    window_before_s: float | None = None
    window_after_s: float | None = None
    max_clips: int | None = None  # single, if 1; else the best so many, where selection is 'all'


def moments(chunks: DataFrame, found: DataFrame, durations: DataFrame, m: Moments) -> DataFrame:
    """recording_id, clip_id, start_s, end_s, duration_s, alerts, metrics, chunk_indices, rank_metric, rank_score, event_center_s; clip_id counts from 1 in a recording.

    A window lies around the middle of its chunk if a width is given (``window_before_s``, ``window_after_s``, or ``event_window_s`` halved), else around the chunk with
    its rolls; windows that touch within the gap are one moment. The score is the chunk's mean of the metric ranked by, else its largest alert of that metric, else the
    number of alerts (also for 'alerts'). Chunks without start or recordings without duration have no upper bound.
    """
    mode, k = m.selection_mode, m.top_k
    if m.max_clips is not None and mode == "all":
        mode, k = ("single", 1) if m.max_clips == 1 else ("top_k", m.max_clips)
    per = found.groupBy(REC, "chunk_index").agg(F.count("*").alias("alerts"), F.array_sort(F.collect_set("metric")).alias("metrics"), F.max(F.when(F.col("metric") == m.rank_metric, F.col("value"))).alias("best"))
    per = per.where(F.col("alerts") >= m.min_alerts_per_chunk).join(chunks, [REC, "chunk_index"]).join(durations.select(REC, "duration_s"), REC, "left")
    center = (F.col("start_s") + F.col("end_s")) / 2
    before, after = m.window_before_s, m.window_after_s
    if before is None and after is None and m.event_window_s is not None:
        before = after = max(0.0, m.event_window_s / 2)
    if before is not None or after is not None:
        low, high = center - max(0.0, before or 0.0), center + max(0.0, after or 0.0)
    else:
        low, high = F.col("start_s") - m.pre_roll_s, F.col("end_s") + m.post_roll_s
    ms = lambda c: F.round(c * 1000).cast("long")
    count = F.col("alerts").cast("double")
    score = count if m.rank_metric in ("alerts", "alert_count") else F.coalesce(F.nanvl(F.col("metric_means").getItem(m.rank_metric), F.lit(None)), "best", count)
    wins = per.select(
        REC, ms(F.greatest(F.lit(0.0), low)).alias("start_ms"), ms(F.least(high, F.coalesce("duration_s", F.lit(1e12)))).alias("end_ms"), "alerts", "metrics", "chunk_index", score.alias("score"), center.alias("center"),
        ms(F.lit(m.merge_gap_s)).alias("gap_ms"),
    )
    labelled = label_intervals(wins, REC, "start_ms", "end_ms", "gap_ms", ["alerts", "metrics", "chunk_index", "score", "center"])
    joined = labelled.groupBy(REC, F.col("island_start").alias("start_ms")).agg(
        F.max("end_ms").alias("end_ms"), F.sum("alerts").alias("alerts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("metrics")))).alias("metrics"),
        F.array_sort(F.collect_list("chunk_index")).alias("chunk_indices"), F.max("score").alias("rank_score"), F.max_by("center", F.struct("score", -F.col("start_ms"))).alias("event_center_s"),
    )
    if mode != "all":
        rank = F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("rank_score"), "start_ms"))
        joined = joined.withColumn("r", rank).where(F.col("r") <= (1 if mode == "single" else max(0, k))).drop("r")
    number = F.row_number().over(Window.partitionBy(REC).orderBy("start_ms"))
    return joined.select(
        REC, number.alias("clip_id"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), hms(F.col("start_ms")).alias("start_hms"), hms(F.col("end_ms")).alias("end_hms"),
        ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"), "alerts", "metrics", "chunk_indices", F.lit(m.rank_metric).alias("rank_metric"), "rank_score", "event_center_s",
    )


def hms(ms):
    """Milliseconds as hh:mm:ss.mmm."""
    whole = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms % 1000)


def moments_folder(spark: SparkSession, folder: str, out: str, settings: Settings, rules: dict, how: Moments = Moments(), metrics: tuple[str, ...] = (), chunk: int = 131_072, most_chunks: int | None = None, clips: bool = True) -> dict:
    """Moments of a folder's recordings, with a table, a report and clips (WAV in a table) under ``out``."""
    wanted = [*metrics, *([how.rank_metric] if how.rank_metric in METRICS else [])]
    chunks, found = chunk_report(spark, folder, settings, wanted, rules, chunk, most_chunks)
    chunks, found = keep(chunks), keep(found)
    files = audio_files(spark, folder)
    durations = recordings(files).where("error is null").select(REC, "duration_s")
    rows = keep(moments(chunks, found, durations, how))
    write_table(rows.withColumns({"metrics": F.array_join("metrics", ";"), "chunk_indices": F.array_join(F.col("chunk_indices").cast("array<string>"), ";")}), f"{out}/moments", "csv")
    n = rows.count()
    if clips and n:
        cut = rows.select(F.concat_ws("#", REC, "clip_id").alias("clip_id"), REC, F.round(F.col("start_s") * settings.rate).cast("long").alias("first"), (F.round(F.col("end_s") * settings.rate) - 1).cast("long").alias("last"))
        every = samples(files.join(cut.select(F.col(REC).alias("path")).distinct(), "path", "left_semi"), settings.rate)
        held = cut_clips(every, cut.where("last >= first"))
        write_table(clip_files(held, settings.rate), f"{out}/clips")
    report = {"moments": n, "alerts": found.count(), "chunks": chunks.count(), "selection_mode": how.selection_mode, "rank_metric": how.rank_metric}
    write_text(spark, f"{out}/report.json", json.dumps(report, indent=1))
    return report


def validate_rows(recordings_: DataFrame, means: DataFrame, flags: DataFrame | None, rules: dict) -> DataFrame:
    """file, check_type, name, value, expected_min, expected_max, expected_flag, status, message: a row per recording and rule.

    ``means``: recording_id, metric, mean. A missing value or flag fails; a NaN breaks no limit.
    """
    spark = recordings_.sparkSession
    limits = threshold_rules(spark, rules)
    asked = recordings_.select(REC).distinct().crossJoin(F.broadcast(limits))  # as many rows as a file of rules has
    v, lo, hi = F.col("mean"), F.col("min"), F.col("max")
    message = (
        F.when(v.isNull(), "metric missing").when(~F.isnan(v) & (v < lo), F.concat(v.cast("string"), F.lit(" < min "), lo.cast("string"))).when(~F.isnan(v) & (v > hi), F.concat(v.cast("string"), F.lit(" > max "), hi.cast("string"))).otherwise("")
    )
    rows = asked.join(means.select(REC, "metric", "mean"), [REC, "metric"], "left").select(
        F.col(REC).alias("file"), F.lit("metric").alias("check_type"), F.col("metric").alias("name"), v.alias("value"), lo.alias("expected_min"), hi.alias("expected_max"), F.lit(None).cast("boolean").alias("expected_flag"), message.alias("message")
    )
    wanted = {str(n): bool(x) for n, x in rules.get("validity_flags", {}).items()}
    if wanted and flags is not None:
        held = {c for c in flags.columns if c != REC}
        checks = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(n) if n in held else F.lit(None).cast("boolean")).alias("flag"), F.lit(x).alias("want")) for n, x in wanted.items()])
        per = recordings_.select(REC).distinct().join(flags, REC, "left").select(F.col(REC).alias("file"), F.explode(checks).alias("c"))
        told = F.when(F.col("c.flag").eqNullSafe(F.col("c.want")), "").otherwise(F.concat(F.coalesce(F.col("c.flag").cast("string"), F.lit("none")), F.lit(" is not "), F.col("c.want").cast("string")))
        rows = rows.unionByName(
            per.select(
                "file", F.lit("validity_flag").alias("check_type"), F.col("c.name").alias("name"), F.col("c.flag").cast("double").alias("value"), F.lit(None).cast("double").alias("expected_min"),
                F.lit(None).cast("double").alias("expected_max"), F.col("c.want").alias("expected_flag"), told.alias("message"),
            )
        )
    return rows.withColumn("status", F.when(F.col("message") == "", "pass").otherwise("fail"))


def validate_folder(spark: SparkSession, folder: str, rules: dict, out: str, settings: Settings, metrics: tuple[str, ...] = ()) -> dict:
    """Checks all recordings of a folder against rules; writes a table of checks and a report; how many files failed."""
    files = audio_files(spark, folder)
    meta = keep(recordings(files))
    good = meta.where("error is null")
    names = list(dict.fromkeys([*metrics, *rules.get("metric_thresholds", {})]))
    known = [n for n in names if n in METRICS]
    source = folder_source(files, settings)
    means = analyze(source, known) if known else spark.createDataFrame([], f"{REC} string, metric string, mean double")
    flags = keep(validity_flags(source)) if rules.get("validity_flags") else None
    rows = keep(validate_rows(good, means, flags, rules))
    write_table(rows, f"{out}/checks", "csv")
    failed = rows.groupBy("file").agg(F.max((F.col("status") == "fail").cast("int")).alias("failed"))
    report = {"files": good.count(), "unreadable": meta.where("error is not null").count(), "files_failed": failed.where("failed = 1").count(), "checks": rows.count(), "checks_failed": rows.where("status = 'fail'").count()}
    write_text(spark, f"{out}/report.json", json.dumps(report, indent=1))
    return report


def record_variant(results: DataFrame, project: str, variant: str, root: str) -> None:
    """Adds the means of a run (recording_id, metric, mean, confidence) to a project's table of runs."""
    rows = results.groupBy("metric").agg(F.avg("mean").alias("value"), F.avg("confidence").alias("confidence"), F.count_distinct(REC).alias("recordings"))
    rows.select(F.lit(project).alias("project"), F.lit(variant).alias("variant"), "metric", "value", "confidence", "recordings", F.current_timestamp().alias("recorded_at")).coalesce(1).write.mode("append").parquet(f"{root}/runs")


def compare_project(spark: SparkSession, root: str, project: str, baseline: str | None = None, metrics: list[str] | None = None) -> DataFrame:
    """project, baseline_variant, variant, metric, baseline_value, value, delta, delta_pct, confidence: the last run of each variant against the baseline's.

    The baseline is the variant named, else the one recorded first; an unknown one, and a project without runs, is refused. The percentage is null where the baseline is 0.
    """
    runs = spark.read.parquet(f"{root}/runs").where(F.col("project") == project) if exists(spark, f"{root}/runs") else None
    first = runs.groupBy("variant").agg(F.min("recorded_at").alias("t")).orderBy("t", "variant").collect() if runs is not None else []  # a row per variant
    if not first:
        raise FileNotFoundError(f"no runs of {project}")
    base = baseline or first[0].variant
    if base not in {r.variant for r in first}:
        raise ValueError(f"no variant {base} in {project}")
    last = latest(runs, ["project", "variant", "metric"], ["recorded_at"], ["value", "confidence"])
    last = last if not metrics else last.where(F.col("metric").isin(metrics))
    of = last.where(F.col("variant") == base).select("metric", F.col("value").alias("baseline_value"))
    delta = F.col("value") - F.col("baseline_value")
    pct = F.when(F.abs("baseline_value") > 1e-12, 100 * delta / F.abs("baseline_value"))
    return last.join(of, "metric", "left").select("project", F.lit(base).alias("baseline_variant"), "variant", "metric", "baseline_value", "value", delta.alias("delta"), pct.alias("delta_pct"), "confidence")


def calibration_check(spark: SparkSession, tone: str, settings: Settings, most_drift_db: float = 1.0) -> dict:
    """Level of a recorded tone against its nominal level, and whether it lies within the tolerance."""
    source = replace_tone(folder_source(audio_files(spark, tone), settings))
    row = METRICS["calibration_drift_db"].compute(source).first()
    if row is None or row.v is None:
        raise ValueError(f"no readable tone at {tone}")
    return {"drift_db": row.v, "measured_dbfs": row.v + settings.tone_dbfs, "spl_db": row.v + settings.tone_dbfs + settings.spl_offset, "within": abs(row.v) <= most_drift_db}


def replace_tone(source):
    """The source whose own signal is the calibration tone."""
    return replace(source, tone=lambda: source.every)


def spatial(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    """recording_id, metric, mean, p95, confidence of the spatial metrics, and the bearing of each recording's mean delay."""
    source = folder_source(audio_files(spark, folder), settings)
    names = [n for n, m in METRICS.items() if m.category == "Spatial"]
    rows = keep(analyze(source, names).select(REC, "metric", "mean", "p95", "confidence"))
    heading = rows.where("metric = 'itd_s'").select(REC, F.lit("bearing_deg").alias("metric"), bearing(F.col("mean"), settings.mic_spacing_m).alias("mean"), bearing(F.col("p95"), settings.mic_spacing_m).alias("p95"), F.lit(0.7).alias("confidence"))
    return rows.unionByName(heading)


def beam_scores(signal: DataFrame, settings: Settings, step_deg: int = 5) -> DataFrame:
    """recording_id, azimuth_deg, score: delay-and-sum score of the first two channels per azimuth, divided by the largest. ``signal``: recording_id, n, x0, x1."""
    import math

    spark = signal.sparkSession
    steps = [(float(az), round(settings.mic_spacing_m / 343.0 * math.sin(math.radians(az)) * settings.rate)) for az in range(-90, 91, step_deg)]
    mean = signal.groupBy(REC).agg(F.avg("x0").alias("m0"), F.avg("x1").alias("m1"))
    z = signal.join(mean, REC).select(REC, "n", (F.col("x0") - F.col("m0")).alias("a"), (F.col("x1") - F.col("m1")).alias("b"))
    den = z.groupBy(REC).agg((F.sqrt(F.sum(F.col("a") ** 2)) * F.sqrt(F.sum(F.col("b") ** 2)) + 1e-12).alias("den"))
    shifts = sorted({s for _, s in steps})
    right = z.select(REC, F.col("n").alias("k"), "b").withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("n", F.col("k") + F.col("shift"))
    dots = z.select(REC, "n", "a").join(right, [REC, "n"]).groupBy(REC, "shift").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    score = dots.join(den, REC).join(spark.createDataFrame(steps, "azimuth_deg double, shift int"), "shift").withColumn("s", F.col("dot") / F.col("den"))
    top = score.groupBy(REC).agg(F.max(F.abs("s")).alias("top"))
    return score.join(top, REC).select(REC, "azimuth_deg", F.coalesce(F.when(F.col("top") > 0, F.col("s") / F.col("top")), F.col("s")).alias("score"))


def vectors_folder(spark: SparkSession, folder: str, settings: Settings, mels: int = 64) -> DataFrame:
    """Feature vectors of all recordings of a folder."""
    return feature_vectors(folder_source(audio_files(spark, folder), settings), mels)


def profiles_folder(spark: SparkSession, folder: str, out: str, settings: Settings, config: dict) -> DataFrame:
    """Analyses a folder under every profile of ``config``, each into a folder of its name; the index: profile, recordings, frame_size, hop_size, sample_rate, results."""
    rows = []
    for name, s, wanted in profiles(settings, config):
        s = replace(s, fft=s.frame, fft_hop=s.hop)
        made = analyze_folder(spark, folder, f"{out}/{name}", s, wanted or None, False)
        rows.append((name, made["recordings"], s.frame, s.hop, s.rate, f"{out}/{name}/results"))
    index = spark.createDataFrame(rows, "profile string, recordings long, frame_size int, hop_size int, sample_rate int, results string")
    write_table(index, f"{out}/index", "csv")
    return index


def ingest_urls(spark: SparkSession, urls: list[str], out: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Fetches addresses into a table of files under ``out`` and gives its manifest; decoding reads the table as it reads a folder."""
    write_table(fetch(spark.createDataFrame([(u,) for u in urls], "url string"), headers=headers), f"{out}/files")
    files = spark.read.parquet(f"{out}/files")
    manifest = _manifest(files.where("content is not null").select("path", "length", "content"), "url")
    lost = files.where("content is null").select("path", F.lit("url").alias("source"), *[F.lit(None).cast(t).alias(n) for n, t in manifest.dtypes[2:-1]], "error")
    return manifest.unionByName(lost)


def ingest_manifest(spark: SparkSession, folder: str, source: str = "local") -> DataFrame:
    """path, source, bytes, sha256, sample_rate, channels, duration_s, error of the files of a folder: what came in, told apart by content."""
    return _manifest(audio_files(spark, folder), source)


def _manifest(files: DataFrame, source: str) -> DataFrame:
    hashed = files.select(F.col("path").alias(REC), F.lit(source).alias("source"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.join(recordings(files), REC).select(F.col(REC).alias("path"), "source", "bytes", "sha256", "sample_rate", "channels", "duration_s", "error")


def pipeline_status(spark: SparkSession, out: str) -> dict:
    """The manifest of a pipeline's folder."""
    return read_json(spark, f"{out}/manifest.json")
