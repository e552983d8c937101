"""The corpus build end to end: frame and feeds in; corpus, exclusions, episodes and manifest out."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import hours, matching, rules
from ..sources import readers, schemas, sinks
from . import reports


def build(frame: DataFrame, bodies: DataFrame, terms: list[str], patterns: list[str], exceptions: list[int], manual: dict[int, str], min_hours: float = 10.0) -> dict[str, DataFrame]:
    """Lazy tables corpus, exclusions, episodes, judged; bodies are (feed_url, body, http_status, error) snapshots."""
    shows = frame.join(bodies, "feed_url", "left")
    parsed = readers.feed_channel(readers.feed_status(shows))
    episodes = readers.feed_episodes(parsed)
    stats = hours.feed_stats(episodes.select(F.col("collection_id").alias("show_id"), "audio_url", "pub_date", F.col("duration_raw").alias("duration_sec"), "duration_source"))
    wide = parsed.drop("feed", "body").withColumnRenamed("collection_id", "show_id").join(stats, "show_id", "left")
    wide = wide.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("hours_available", "hours_estimated_share", "avg_episode_minutes", "episodes_per_week")})
    judged = rules.first_failing_rule(wide, rules.inclusion_rules(terms, patterns, exceptions, manual, min_hours))
    corpus = judged.where("rule is null").drop("rule", "evidence", "status", "error", "http_status")
    excluded = judged.where("rule is not null").select("rank", F.col("show_id").alias("collection_id"), "show_name", "publisher", "rule", "evidence", "hours_available")
    kept = episodes.join(corpus.select(F.col("show_id").alias("collection_id")), "collection_id", "left_semi").drop("duration_raw")
    return {"corpus": corpus, "exclusions": excluded, "episodes": kept, "judged": judged, "manifest": sinks.run_manifest(corpus, excluded, min_hours=min_hours)}


def report(corpus: DataFrame, exclusions: DataFrame) -> str:
    """Text summary of small aggregates."""
    q = hours.quartiles(corpus.withColumnRenamed("hours_available", "total_hours")).first()
    lines = [f"corpus: {corpus.count():,} shows", f"hours p25/median/p75/max: {q['p25']} / {q['median']} / {q['p75']} / {q['max']}"]
    lines += [f"excluded {r['rule']}: {r['n']:,}" for r in exclusions.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").collect()]
    return "\n".join(lines)


def labelled(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus with its best external label: collection_id, show_name and the columns of match_status. For checks, never for sampling."""
    names = corpus.select(F.col("show_id").alias("id"), X.normalize_name(F.col("show_name")).alias("norm"))
    found = matching.match_status(matching.top2(names, labels, "composite")).withColumnRenamed("id", "show_id")
    return corpus.select("show_id", "show_name").join(found, "show_id").withColumnRenamed("show_id", "collection_id")


def write(out: dict[str, DataFrame], root: str, frame: DataFrame | None = None, labels: DataFrame | None = None, **params) -> str:
    """Everything a run leaves under root: frame copy, corpus, exclusions, episodes, labels where there are some, manifest and summary."""
    if frame is not None:
        sinks.csv(frame, f"{root}/raw_chart")
    ordered = [c for c in schemas.FRAME_COLUMNS if c in out["corpus"].columns or c == "collection_id"]
    rest = [c for c in out["corpus"].columns if c not in ordered and c != "show_id"]
    sinks.csv(out["corpus"].withColumnRenamed("show_id", "collection_id").select(*ordered, *rest).orderBy("rank"), f"{root}/corpus")
    sinks.csv(out["exclusions"].orderBy("rank"), f"{root}/exclusions")
    sinks.csv(out["episodes"], f"{root}/episodes", gzip=True)
    known = None
    if labels is not None:
        known = labelled(out["corpus"], labels)
        sinks.csv(known, f"{root}/lean_validation")
    counts = {"n_excluded": out["exclusions"].count(), "fuzzy_accept": matching.ACCEPT, "fuzzy_review": matching.REVIEW, "finished_utc": datetime.now(UTC).isoformat()}
    counts |= {"n_frame": frame.count()} if frame is not None else {}
    params |= {k: v for k, v in counts.items() if k not in params}
    sinks.manifest(out["manifest"].withColumns({"labels_joined": F.lit(labels is not None), **{k: F.lit(v) for k, v in params.items()}}), f"{root}/run_manifest")
    text = reports.run_summary(out["corpus"], out["exclusions"], known, **{k: v for k, v in params.items() if k not in counts})
    spark = out["corpus"].sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/summary")
    return text
