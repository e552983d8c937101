"""python -m sandglass.plans.cli run|budget|sample|download|queue: the engine's command line over frames, episodes and queues."""

from __future__ import annotations

import argparse
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import hours, sampling
from ..operators.numbering import shared_folder
from ..operators.queue import value_counts
from ..sources import charts, http, readers, schemas, sinks
from ..streaming import producer, worker
from . import corpus, reports

#: Columns of a sample manifest, in order.
MANIFEST = ("show_id", "show", "episode_id", "draw_order", "pub_date", "episode_title", "duration_sec", "duration_hr", "duration_source", "audio_url")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sandglass")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="corpus, exclusions, episodes, labels and summary from a frozen frame and feed snapshots")
    r.add_argument("--frame", required=True, help="root of frozen frames")
    r.add_argument("--chart-date", help="date of the frame, YYYYMMDD; today in UTC if not given")
    r.add_argument("--chart-url", help="pull the chart and freeze its frame, unless there is one of the date")
    r.add_argument("--lookup-url", help="where {ids} stands for up to 100 ids")
    r.add_argument("--category", default="")
    r.add_argument("--subcategory", default="")
    r.add_argument("--cache", required=True, help="folder of HTTP snapshots")
    r.add_argument("--fetcher", default="", help="module:function that gets a url; without it the cache alone is read")
    r.add_argument("--min-hours", type=float, default=10.0)
    r.add_argument("--labels-csv", help="external labels, by show name")
    r.add_argument("--rules-json", help="terms, patterns, exceptions and manual exclusions")
    r.add_argument("--refresh", action="store_true", help="fetch again what the cache holds")
    r.add_argument("--out", required=True)
    d = sub.add_parser("download", help="put audio of a manifest into a queue")
    d.add_argument("--manifest", required=True)
    d.add_argument("--queue", required=True)
    d.add_argument("--getter", required=True, help="module:function (url -> status, final url, content type, chunks)")
    d.add_argument("--failures", required=True)
    d.add_argument("--workers", type=int, default=8)
    d.add_argument("--limit", type=int)
    d.add_argument("--no-stop", action="store_true")
    b = sub.add_parser("budget", help="survival of shows over hours and windows")
    b.add_argument("--episodes", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--as-of")
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--sample-h", type=float)
    b.add_argument("--sample-window", type=int, default=24)
    s = sub.add_parser("sample", help="budgeted sample and saturation ladder")
    s.add_argument("--episodes", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--hours", type=float, default=25.0)
    s.add_argument("--window", type=int, default=24)
    s.add_argument("--seed", type=int, default=20260713)
    q = sub.add_parser("queue", help="work off a transcription queue")
    q.add_argument("--queue", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--checkpoint", required=True)
    q.add_argument("--engine", default="stub", choices=sorted(worker.ENGINES))
    q.add_argument("--batch-size", type=int, default=2)
    q.add_argument("--model", default="large-v3", help="handed to the engine")
    q.add_argument("--compute-type", default="float16", help="handed to the engine")
    q.add_argument("--language", default="en", help="handed to the engine")
    q.add_argument("--auto-lang", action="store_true", help="let the engine find the language")
    q.add_argument("--audio", help="folder of the audio files; items without one are dropped")
    q.add_argument("--workers", type=int, default=1, help="queries that attempt items side by side")
    q.add_argument("--tries", type=int, default=3, help="attempts at an item")
    q.add_argument("--lease", type=float, default=600.0, help="seconds after which an attempt without outcome is given up")
    q.add_argument("--patience", type=float, default=60.0, help="seconds that an item waits for its audio")
    q.add_argument("--smoke-test", action="store_true", help="one item through the engine, then end")
    for command in sub.choices.values():
        command.add_argument("--log", help="log to which a line is appended when the command begins and when it ends or fails")
    return p


def noted(spark: SparkSession, path: str | None, command: str, what: str) -> None:
    """A line of the log: time in UTC, command, what happened."""
    if path:
        line = f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ} {command} {' '.join(what.split())}"
        sinks.append_lines(spark.createDataFrame([(line,)], "value string").coalesce(1), path)


def run(a: argparse.Namespace, spark: SparkSession) -> str:
    """The corpus build from a frozen frame, pulled first if its chart's url is given."""
    date = a.chart_date or datetime.now(UTC).strftime("%Y%m%d")
    if a.chart_url and (a.refresh or not readers.there(spark, f"{a.frame}/chart_date={date}")):
        ids, found = charts.pull(spark, a.chart_url, a.lookup_url, a.cache, a.fetcher, refresh=a.refresh)
        sinks.freeze(readers.frame(ids, found, a.category, a.subcategory, ""), a.frame, date, a.refresh)
    frame = readers.frozen_frame(spark, f"{a.frame}/chart_date={date}").withColumns({"rank": F.col("rank").cast("int"), "collection_id": F.col("collection_id").cast("long")})
    spark.dataSource.register(http.SnapshotSource)
    urls = [r[0] for r in frame.where("trim(feed_url) <> ''").select("feed_url").distinct().collect()]  # a frame is one chart, some hundred shows
    options = {"urls": json.dumps(urls), "cache": a.cache, "fetcher": a.fetcher, "refresh": str(a.refresh).lower()}
    bodies = spark.read.format("snapshot").options(**options).load().withColumnRenamed("url", "feed_url")
    told = {"terms": [], "patterns": [], "exceptions": [], "manual": {}}
    if a.rules_json:
        with open(a.rules_json, encoding="utf-8") as f:
            told |= json.load(f)
    manual = {int(k): v for k, v in told["manual"].items()}
    out = corpus.build(frame, bodies, told["terms"], told["patterns"], told["exceptions"], manual, a.min_hours)
    labels = readers.labels_csv(spark, a.labels_csv) if a.labels_csv else None
    return corpus.write(out, a.out, frame, labels, chart_date=date, started_utc=datetime.now(UTC).isoformat())


def budget(a: argparse.Namespace, spark: SparkSession) -> str:
    """Survival, logs, bottleneck, report, manifest and, if asked for, a sample."""
    raw = readers.episodes_csv(spark, a.episodes).withColumnRenamed("collection_id", "show_id")
    pool = hours.usable(raw)
    as_of = F.to_timestamp(F.lit(a.as_of)) if a.as_of else None
    table = hours.show_hours(raw.select("show_id").distinct(), pool, as_of=as_of)
    names = raw.groupBy("show_id").agg(F.min("show_name").alias("show_name"))
    log = hours.duration_log(raw)
    sinks.csv(table, f"{a.out}/show_hours")
    sinks.csv(hours.survival_table(table), f"{a.out}/survival")
    sinks.csv(log, f"{a.out}/duration_log")
    sinks.csv(table.where(F.col("window_months") == reports.FOCUS).join(names, "show_id").orderBy("total_hours", "show_id"), f"{a.out}/bottleneck_shows")
    text = reports.budget_report(table, log, names)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/budget_summary")
    best = reports.recommendation(table).first()
    facts = {"as_of": a.as_of, "n_shows": best["n_total"] if best else 0, "windows_months": list(hours.WINDOWS), "H_grid": list(hours.GRID), "focus_window": reports.FOCUS, "density_floor_hours": reports.DENSITY_FLOOR, "retention_target": reports.RETENTION, "best_h": best["best_h"] if best else None, "seed": a.seed}
    if a.sample_h:
        facts |= {"sample_h": a.sample_h, "sample_window": a.sample_window}
        near = hours.lookback(pool.withColumn("episode_id", F.substring(F.md5("audio_url"), 1, 16)), a.sample_window, as_of)
        sinks.csv(sampling.budget_draw(near, a.sample_h, a.seed, keep_short=True), f"{a.out}/sample_manifest")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/budget_manifest")
    return text


def sample(a: argparse.Namespace, spark: SparkSession) -> str:
    pool = hours.lookback(readers.sampler_pool(readers.episodes_csv(spark, a.episodes)), a.window)
    drawn = sampling.budget_draw(pool, a.hours, a.seed)
    summary = sampling.per_show_summary(drawn)
    sinks.csv(drawn.select(*[c for c in MANIFEST if c in drawn.columns]), f"{a.out}/sample_manifest")
    sinks.csv(sampling.dropped_shows(pool, a.hours), f"{a.out}/excluded_shows")
    ladder = sampling.saturation_ladder(pool, a.seed)
    sinks.csv(ladder.select("rung_h", *[c for c in MANIFEST if c in ladder.columns and c != "draw_order"]), f"{a.out}/saturation_ladder")
    sinks.csv(summary, f"{a.out}/per_show_summary")
    return reports.sample_report(summary, a.hours)


def download(a: argparse.Namespace, spark: SparkSession) -> str:
    out = producer.dispatch(readers.manifest(spark, a.manifest), a.queue, a.getter, workers=a.workers, limit=a.limit)
    kept = f"{shared_folder(spark)}/outcomes-{uuid.uuid4().hex}"
    out.write.parquet(kept)
    told = spark.read.schema(producer.OUTCOMES).parquet(kept)
    sinks.append_log(producer.failures(told), a.failures, schemas.FAILURES)
    if not a.no_stop:
        producer.stop(a.queue)
    return ", ".join(f"{r['outcome']}: {r['n']}" for r in value_counts(told, "outcome").collect())


def work_off(a: argparse.Namespace, spark: SparkSession) -> str:
    """The transcription queue until nothing is left in it."""
    worker.drain(spark, a.queue, a.out, a.checkpoint, a.engine, a.batch_size, engine_options(a), a.audio, a.workers, worker.Rules(a.tries, a.lease, a.patience))
    return ", ".join(f"{r['outcome']}: {r['n']}" for r in value_counts(worker.results(spark, a.out), "outcome").collect())


def engine_options(a: argparse.Namespace) -> dict:
    return {"model": a.model, "compute_type": a.compute_type, "language": None if a.auto_lang else a.language}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    if a.command == "queue" and a.smoke_test:
        return json.dumps(worker.smoke_test(a.engine, options=engine_options(a)))
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    noted(spark, a.log, a.command, "begins")
    try:
        text = {"run": run, "budget": budget, "sample": sample, "download": download, "queue": work_off}[a.command](a, spark)
    except Exception as e:
        noted(spark, a.log, a.command, f"failed: {type(e).__name__}: {str(e)[:200]}")
        raise
    noted(spark, a.log, a.command, "ends")
    return text


if __name__ == "__main__":
    print(main())
