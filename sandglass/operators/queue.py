"""Frames, lookups, logs and outcomes as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_frame(ids: DataFrame, lookups: DataFrame, key: str = "id") -> DataFrame:
    """ids(rank, id) with their lookup's fields, and whether there was one."""
    return ids.join(lookups.withColumn("_found", F.lit(True)), key, "left").withColumn("lookup_found", F.col("_found").isNotNull()).drop("_found")


def last_wins(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of each key with the largest order value; aggregated map-side, no window."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*key, "_v.*")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def pending(items: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return items.join(done.select(*on).distinct(), on, "left_anti")


def already_same(items: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return items.join(done.select(*on).distinct(), on, "left_semi")


def probed(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """items(show_id, episode_id, audio_sha256, ...) with done: whether the first transcript of the episode, by stem, has their hash."""
    first = transcripts.groupBy("show_id", "episode_id").agg(F.min_by("audio_sha256", "stem").alias("_sha"))
    same = F.coalesce(F.col("_sha") == F.col("audio_sha256"), F.lit(False))
    return items.join(first, ["show_id", "episode_id"], "left").withColumn("done", same).drop("_sha")


def outcomes(items: DataFrame, transcripts: DataFrame, queued: DataFrame, key: str, ok: Column) -> DataFrame:
    """items with outcome skip-done, skip-queued, ok or fail, in that order of precedence."""
    t = transcripts.select(key).distinct().withColumn("_t", F.lit(True))
    q = queued.select(key).distinct().withColumn("_q", F.lit(True))
    said = F.when(F.col("_t").isNotNull(), "skip-done").when(F.col("_q").isNotNull(), "skip-queued").when(ok, "ok").otherwise("fail")
    return items.join(t, key, "left").join(q, key, "left").withColumn("outcome", said).drop("_t", "_q")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def first_rows(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first n rows in order; 0 or None means all."""
    return df.orderBy(*order).limit(n) if n else df.orderBy(*order)


def overlap_assign(words: DataFrame, turns: DataFrame, bucket: float = 30.0) -> DataFrame:
    """Each word(doc, w_start, w_end) with the speaker of most overlap; turns meet words in time buckets, not all pairs."""
    spread = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    pairs = spread(words, "w_start", "w_end").join(spread(turns, "t_start", "t_end"), ["doc", "_b"])
    shared = F.least("w_end", "t_end") - F.greatest("w_start", "t_start")
    best = pairs.withColumn("_o", shared).where("_o > 0").groupBy("doc", "w_start", "w_end").agg(F.max(F.struct("_o", (-F.col("t_start")).alias("s"), "speaker"))["speaker"].alias("speaker"))
    return words.join(best, ["doc", "w_start", "w_end"], "left")


def running_manifest(sample: DataFrame) -> DataFrame:
    """selection_order from 1 and running hours within each show, from the draw's own order and sums."""
    return sample.select(
        "show_id", "episode_id", (F.col("draw_order") + 1).alias("selection_order"), F.round(F.col("duration_sec") / 60, 1).alias("duration_min"),
        F.round(F.col("cum_sec") / 3600, 2).alias("cumulative_hours"),
    )
