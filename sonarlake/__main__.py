"""Command line: python -m sonarlake COMMAND ...; exit code 1 for a failure, 2 for a check that failed."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session() -> SparkSession:
    """The session of the cluster it is submitted to; workers get this package."""
    spark = SparkSession.builder.appName("sonarlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, which need not have it installed."""
    import atexit
    import shutil
    import tempfile

    if spark.sparkContext.master.startswith("local"):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sonarlake-")  # on the driver, which serves it to the workers
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/sonarlake", "zip", root.parent, root.name))


def _names(text: str) -> list[str]:
    return [m.strip() for m in text.split(",") if m.strip()]


def parser() -> argparse.ArgumentParser:
    """All commands and their options."""
    p = argparse.ArgumentParser(prog="sonarlake")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *paths: str, signal: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        for path in paths:
            c.add_argument(path)
        if signal:
            c.add_argument("--metrics", default="")
            c.add_argument("--rate", type=int, default=48000)
            c.add_argument("--frame-size", type=int, default=2048)
            c.add_argument("--hop-size", type=int, default=512)
            c.add_argument("--calibration")
        return c

    a = command("analyze", "summaries, series, flags and documents of a file or folder", "folder", "out")
    a.add_argument("--no-series", action="store_true")
    a.add_argument("--project")
    a.add_argument("--variant", default="default")
    a.add_argument("--project-root")
    command("batch", "analyze a folder and write an index of its recordings", "folder", "out")
    c = command("stream", "means and alerts of every chunk", "folder", "rules", "out")
    c.add_argument("--chunk-size", type=int, default=131_072)
    c.add_argument("--max-chunks", type=int)
    m = command("moments", "clips around alerts", "folder", "rules", "out")
    m.add_argument("--chunk-size", type=int, default=131_072)
    m.add_argument("--max-chunks", type=int)
    for name, kind, default in (("pre-roll", float, 3.0), ("post-roll", float, 3.0), ("merge-gap", float, 2.0), ("event-window", float, None), ("window-before", float, None), ("window-after", float, None)):
        m.add_argument(f"--{name}", type=kind, default=default)
    m.add_argument("--min-alerts-per-chunk", type=int, default=1)
    m.add_argument("--selection-mode", choices=("all", "single", "top_k"), default="all")
    m.add_argument("--top-k", type=int, default=1)
    m.add_argument("--rank-metric", default="novelty_curve")
    m.add_argument("--max-clips", type=int)
    m.add_argument("--no-clips", action="store_true")
    v = command("validate", "check a folder of recordings, or stored results, against rules", "source", "rules")
    v.add_argument("--out")
    s = command("spatial", "spatial metrics, bearings and beam maps", "folder", "out")
    s.add_argument("--array", help="file with the geometry of the microphones")
    t = command("calibrate", "check a recorded calibration tone", "tone")
    t.add_argument("--tolerance", type=float, default=1.0)
    f = command("features", "feature vectors of every frame", "folder", "out")
    f.add_argument("--mels", type=int, default=64)
    i = command("ingest", "manifest of the files of a folder", "folder", "out", signal=False)
    i.add_argument("--source", default="local")
    pj = command("project", "compare the variants of a project", "root", "project", signal=False)
    pj.add_argument("--baseline")
    pj.add_argument("--metrics", default="")
    pj.add_argument("--out")
    r = command("pipeline", "stages over a folder; finished work is not done again", "folder", "out")
    r.add_argument("--stages", default="analyze,frames,digest")
    command("status", "what a pipeline has done", "out", signal=False)
    command("metrics", "list the catalog", signal=False)
    command("schema", "the schema of result documents", signal=False).add_argument("--out")
    command("quickstart", "commands to begin with", signal=False)
    q = command("query", "run a named query over a folder of parquet tables", "name", "folder", signal=False)
    q.add_argument("--out")
    return p


def _settings(args):
    from sonarlake.sources.settings import calibrated, read_object
    from sonarlake.sources.signals import Settings

    return calibrated(Settings.framed(args.rate, args.frame_size, args.hop_size), read_object(args.calibration) if args.calibration else None)


def _give(rows: DataFrame, out: str | None, kind: str = "parquet") -> None:
    from sonarlake.sources.exports import write_table

    if out:
        write_table(rows, out, kind)
    else:
        rows.show(50, False)


def run(args: argparse.Namespace) -> int:
    """Runs a parsed command."""
    if args.command == "metrics":
        from sonarlake.operators.metrics import METRICS

        for m in METRICS.values():
            print(json.dumps({"name": m.name, "category": m.category, "units": m.units, "confidence": m.confidence, "streaming_capable": m.streaming, "calibration_dependency": m.calibrated}))
        return 0
    if args.command == "schema":
        from sonarlake.functions.schema import schema_text

        if args.out:
            Path(args.out).write_text(schema_text())
        else:
            print(schema_text())
        return 0
    if args.command == "quickstart":
        print("python -m sonarlake analyze FOLDER OUT --metrics rms_dbfs,integrated_lufs\npython -m sonarlake moments FOLDER rules.json OUT\npython -m sonarlake validate FOLDER rules.json --out OUT")
        return 0
    from sonarlake.plans import workflows as w
    from sonarlake.sources.settings import read_object

    spark = session()
    if args.command == "query":
        from sonarlake.plans import metric_queries, preparation_queries, signal_queries, stream_queries, table_queries

        known = {n: f for m in (metric_queries, signal_queries, table_queries, preparation_queries, stream_queries) for n, f in m.QUERIES.items()}
        _give(known[args.name](spark, args.folder), args.out)
        return 0
    if args.command == "project":
        _give(w.compare_project(spark, args.root, args.project, args.baseline, _names(args.metrics)), args.out, "csv")
        return 0
    if args.command == "ingest":
        _give(w.ingest_manifest(spark, args.folder, args.source), args.out)
        return 0
    if args.command == "status":
        print(json.dumps(w.pipeline_status(spark, args.out)))
        return 0
    settings, metrics = _settings(args), _names(args.metrics)
    if args.command in ("analyze", "batch"):
        from sonarlake.operators.metrics import metric_names

        report = w.analyze_folder(spark, args.folder, args.out, settings, metric_names(metrics or None), args.command == "analyze" and not args.no_series)
        results = spark.read.parquet(f"{args.out}/results")
        if args.command == "batch":
            _give(w.batch_index(spark.read.parquet(f"{args.out}/recordings"), results), f"{args.out}/index", "csv")
        elif args.project:
            w.record_variant(results, args.project, args.variant, args.project_root or f"{args.out}/project")
        print(json.dumps(report))
        return 0
    if args.command == "stream":
        chunks, found = w.chunk_report(spark, args.folder, settings, metrics, read_object(args.rules), args.chunk_size, args.max_chunks)
        _give(chunks, f"{args.out}/chunks")
        _give(found, f"{args.out}/alerts")
        print(json.dumps({"chunks": spark.read.parquet(f"{args.out}/chunks").count(), "alerts": spark.read.parquet(f"{args.out}/alerts").count()}))
        return 0
    if args.command == "moments":
        how = w.Moments(args.pre_roll, args.post_roll, args.merge_gap, args.min_alerts_per_chunk, args.selection_mode, args.top_k, args.rank_metric, args.event_window, args.window_before, args.window_after, args.max_clips)
        print(json.dumps(w.moments_folder(spark, args.folder, args.out, settings, read_object(args.rules), how, tuple(metrics), args.chunk_size, args.max_chunks, not args.no_clips)))
        return 0
    if args.command == "validate":
        return _validate(spark, args, settings, metrics)
    if args.command == "spatial":
        from dataclasses import replace

        from sonarlake.plans.pipeline import folder_source
        from sonarlake.sources.recordings import audio_files

        if args.array:
            settings = replace(settings, mic_spacing_m=float(read_object(args.array).get("mic_spacing_m", settings.mic_spacing_m)))
        _give(w.spatial(spark, args.folder, settings), f"{args.out}/metrics")
        _give(w.beam_scores(folder_source(audio_files(spark, args.folder), settings).two, settings), f"{args.out}/beam", "csv")
        return 0
    if args.command == "calibrate":
        report = w.calibration_check(spark, args.tone, settings, args.tolerance)
        print(json.dumps(report))
        return 0 if report["within"] else 2
    if args.command == "features":
        _give(w.vectors_folder(spark, args.folder, settings, args.mels), args.out)
        return 0
    from sonarlake.plans.pipeline import Job
    from sonarlake.plans.pipeline import run as run_stages

    manifest = run_stages(spark, Job(args.folder, args.out, tuple(metrics) or Job.metrics, settings), tuple(_names(args.stages)))
    print(json.dumps(manifest))
    return 0 if manifest["status"] == "completed" else 1


def _validate(spark: SparkSession, args: argparse.Namespace, settings, metrics: list[str]) -> int:
    """Results that are stored (a table with metric and mean) are checked as they are; recordings are analysed first."""
    from sonarlake.plans import workflows as w
    from sonarlake.sources.settings import read_object
    from sonarlake.sources.storage import exists

    rules = read_object(args.rules)
    if args.source.endswith("results") or exists(spark, f"{args.source}/_SUCCESS"):
        rows = spark.read.parquet(args.source)
        checks = w.validate_rows(rows, rows, None, rules)
        failed = checks.where("status = 'fail'")
        if args.out:
            _give(checks, f"{args.out}/checks", "csv")
        failed.show(50, False)
        return 2 if failed.head(1) else 0
    report = w.validate_folder(spark, args.source, rules, args.out or f"{args.source}/validation", settings, tuple(metrics))
    print(json.dumps(report))
    return 2 if report["files_failed"] else 0


def main(argv: list[str] | None = None) -> int:
    """Parses and runs a command; what is missing or wrong in its inputs is told in a line."""
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (FileNotFoundError, ValueError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
