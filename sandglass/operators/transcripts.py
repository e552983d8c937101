"""Transcript records and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sanitize_title, word_count


def segments(raw: Column) -> Column:
    """Array of struct(start, end, text) with trimmed texts."""
    return F.transform(raw, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.trim(s["text"]).alias("text")))


def full_text(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["text"]), " ")


def metrics(df: DataFrame) -> DataFrame:
    """n_segments, n_words and realtime_factor of rows with segments, duration and wall_seconds."""
    words = F.aggregate(F.transform("segments", lambda s: word_count(s["text"])), F.lit(0), lambda a, b: a + b)
    speed = F.when(F.col("wall_seconds") > 0, F.round(F.col("duration") / F.col("wall_seconds"), 2)).otherwise(F.lit(float("nan")))
    return df.withColumns({"n_segments": F.size("segments"), "n_words": words, "realtime_factor": speed})


def record(df: DataFrame) -> DataFrame:
    """The JSON record of each transcript and its file stem."""
    fields = ["episode_id", "show_id", "episode_title", "engine", "model", "language", "duration", "audio_sha256", "segments"]
    return df.select("show_id", "episode_id", F.concat_ws("_", "episode_id", sanitize_title(F.col("episode_title"))).alias("stem"), F.to_json(F.struct(*fields)).alias("record"), full_text(F.col("segments")).alias("text"))


def cues(segs: Column) -> Column:
    """WebVTT text of segments."""
    clock = lambda s: F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), s - F.floor(s / 60) * 60)
    lines = F.transform(segs, lambda s: F.concat(clock(s["start"]), F.lit(" --> "), clock(s["end"]), F.lit("\n"), s["text"], F.lit("\n")))
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(lines, "\n"))


def ordered_concat(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return df.groupBy(group).agg(joined.alias("text"), F.count(F.lit(1)).alias("n_turns"))
