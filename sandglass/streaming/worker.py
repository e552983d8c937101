"""The transcription queue as streaming queries: one that decides what becomes of each item, and workers that do what it claims for them.

The coordinator reads meta files, audio files and outcomes and keeps a state for each item (see lifecycle); its actions are a table. A
worker reads the claims that fall to it, by show and attempt, so each claim is one worker's and another attempt is
another's; it writes outcomes, which the coordinator reads in turn, and the status and failure logs. All of them restart from their
checkpoints. Under ``out`` lie actions, outcomes, status, failures and, once the queue is worked off, transcripts.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import SUFFIXES, path_stem, split_meta
from ..functions.shipping import ship
from ..sources import joblog, schemas, sinks
from .engines import ENGINES, RESULT, StubEngine, smoke_test, transcribe  # noqa: F401  the engines' other home
from .lifecycle import ACTIONS, EVENTS, Rules, lives
from .source import QueueReader, QueueSource

#: Audio files that a batch admits; they are names only.
AUDIO_BATCH = 10_000


def queue(spark: SparkSession, folder: str, log: str, admit: int = 2, suffixes: tuple = (".meta",)) -> DataFrame:
    """name, value and at of the folder's files, as a stream in the order of names."""
    ship(spark)
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("queue").options(folder=folder, log=log, admit=str(admit), suffixes=",".join(suffixes)).load()


def as_events(df: DataFrame, **columns) -> DataFrame:
    """df with the columns of EVENTS; those that are not given are null."""
    kinds = [c.split(" ") for c in EVENTS.split(", ")]
    return df.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds])


def events(spark: SparkSession, folder: str, out: str, log: str, admit: int, audio: str | None) -> DataFrame:
    """What happens to items, as a stream of EVENTS; an item is an episode, its audio's stem."""
    stem, f = path_stem(F.col("name")), split_meta(F.col("value"))
    metas = queue(spark, folder, f"{log}/meta", admit)
    found = as_events(metas, item=F.coalesce(f[1], stem), kind=F.lit("meta"), show_id=f[0], episode_id=f[1], audio_sha256=f[2], title=F.btrim(f[3], F.lit(" \t\r\n")))
    told = spark.readStream.schema(RESULT).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").parquet(f"{out}/outcomes")
    found = found.unionByName(as_events(told, item=F.col("item"), kind=F.col("outcome"), attempt=F.col("attempt"), reason=F.col("reason")))
    if audio:
        files = queue(spark, audio, f"{log}/audio", AUDIO_BATCH, tuple(sorted(SUFFIXES)))
        found = found.unionByName(as_events(files, item=stem, kind=F.lit("audio")))
    return found


def coordinate(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: Rules = Rules(), admit: int = 2, audio: str | None = None) -> StreamingQuery:
    """The query that claims; it goes on until it is stopped, so that leases run out when nothing else happens."""
    spark.createDataFrame([], RESULT).write.mode("append").parquet(f"{out}/outcomes")  # a stream's folder must be there
    actions = lives(events(spark, folder, out, f"{checkpoint}/log", admit, audio), rules)
    writer = actions.coalesce(1).writeStream.format("parquet").option("path", f"{out}/actions").option("checkpointLocation", f"{checkpoint}/coordinator")
    started = writer.outputMode("append").trigger(processingTime="200 milliseconds").start()
    while started.isActive and started.lastProgress is None:  # the first commit makes the table of actions one that others can follow
        time.sleep(0.1)
    return started


def work(spark: SparkSession, out: str, checkpoint: str, number: int = 0, workers: int = 1, engine: str = "stub", options: dict | None = None) -> StreamingQuery:
    """Worker ``number`` of so many: attempts what is claimed for it."""
    slot = F.pmod(F.xxhash64("show_id") + F.col("attempt"), F.lit(workers))
    claims = spark.readStream.schema(ACTIONS).parquet(f"{out}/actions").where((F.col("action") == "claim") & (slot == number))

    def batch(df: DataFrame, n: int) -> None:
        s, job = df.sparkSession, f"worker{number}-{n:08d}"
        path = f"{out}/outcomes/{job}"
        transcribe(df, engine, options).write.mode("overwrite").parquet(path)  # a batch that runs again replaces its rows
        rows = s.read.schema(RESULT).parquet(path)
        speed = F.round(F.try_divide("duration", "wall_seconds"), 2)
        joblog.append(sinks.in_columns(rows.where("outcome = 'ok'").withColumn("realtime_factor", speed), schemas.STATUS), f"{out}/status", job)
        failed = rows.where("outcome = 'fail'").select("*", F.lit(None).alias("audio_url"), F.col("title").alias("episode_title"))
        joblog.append(sinks.in_columns(failed, schemas.FAILURES), f"{out}/failures", job)

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/worker{number}").trigger(processingTime="200 milliseconds").start()


def actions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ACTIONS).parquet(f"{out}/actions")


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """Every attempt that was made."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(f"{out}/outcomes")


def results(spark: SparkSession, out: str) -> DataFrame:
    """show_id, episode_id, audio_sha256, title, outcome (ok, failed, dropped) and reason of items, as they ended last, one row each."""
    ended = actions(spark, out).where("action in ('done', 'failed', 'dropped')").withColumn("outcome", F.when(F.col("action") == "done", "ok").otherwise(F.col("action")))
    return ended.select("item", "attempt", "show_id", "episode_id", "audio_sha256", "title", "outcome", "reason")


def transcripts(spark: SparkSession, out: str) -> DataFrame:
    """TRANSCRIPT rows of the attempts that count."""
    kept = results(spark, out).where("outcome = 'ok'").select("item", "attempt", "audio_sha256").distinct()
    rows = outcomes(spark, out).where("outcome = 'ok'").join(kept, ["item", "attempt", "audio_sha256"], "left_semi").dropDuplicates(["item", "audio_sha256"])
    return sinks.in_columns(rows.withColumnRenamed("title", "episode_title"), schemas.TRANSCRIPT)


def worked_off(spark: SparkSession, folder: str, out: str, checkpoint: str) -> bool:
    """Whether every meta file was admitted and has come to its end."""
    reader = QueueReader({"folder": folder, "log": f"{checkpoint}/log/meta", "admit": "1"})
    return not reader.waiting() and actions(spark, out).where("action <> 'claim'").count() >= len(reader.admitted())


def drain(
    spark: SparkSession, folder: str, out: str, checkpoint: str, engine: str = "stub", per_trigger: int = 2, options: dict | None = None, audio: str | None = None, workers: int = 1,
    rules: Rules = Rules(), seconds: float | None = None,
) -> bool:
    """Work off what lies in the queue, write its transcripts and stop; False if that took longer than the seconds given.

    Items done with the same hash are skipped, failing ones tried again, those whose audio does not come dropped (with a folder of audio).
    """
    rules = rules if audio else Rules(rules.tries, rules.lease, rules.patience, needs_audio=False)
    os.makedirs(folder, exist_ok=True)
    end = None if seconds is None else time.monotonic() + seconds
    running = [coordinate(spark, folder, out, checkpoint, rules, per_trigger, audio)]
    try:
        running += [work(spark, out, checkpoint, i, workers, engine, options) for i in range(workers)]
        while not worked_off(spark, folder, out, checkpoint):
            for q in running:
                if q.exception():
                    raise q.exception()
            if end is not None and time.monotonic() > end:
                return False
            time.sleep(0.5)
        for q in running[1:]:
            q.processAllAvailable()  # the logs of the last outcomes
    finally:
        for q in running:
            q.stop()
    done = transcripts(spark, out)
    if not done.isEmpty():
        sinks.upsert_transcripts(done, f"{out}/transcripts")
    return True


def arrivals(metas: DataFrame, audio: DataFrame, patience: str = "60 seconds", early: str = "1 hour", late: str = "10 seconds") -> DataFrame:
    """Streams metas(item, at) and audio(item, at) joined by item: item, meta_at, audio_at, state (ready or dropped).

    Audio may come before its meta, by ``early`` at most, or after it, within the patience. A meta without audio is a row only when the
    watermark, which lags ``late`` behind both streams, has passed its patience: until then the item is waiting, in the join's state.
    """
    one = metas.select(F.col("item"), F.col("at").alias("meta_at")).withWatermark("meta_at", late)
    two = audio.select(F.col("item").alias("audio_item"), F.col("at").alias("audio_at")).withWatermark("audio_at", late)
    near = (F.col("item") == F.col("audio_item")) & F.expr(f"audio_at >= meta_at - interval {early} and audio_at <= meta_at + interval {patience}")
    return one.join(two, near, "leftOuter").select("item", "meta_at", "audio_at", F.when(F.col("audio_at").isNull(), "dropped").otherwise("ready").alias("state"))
