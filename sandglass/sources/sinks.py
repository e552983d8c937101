"""Sinks: frozen frames, CSV tables, manifests, append logs, transcripts by key."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import sanitize_title
from ..operators.numbering import shared_folder
from ..operators.transcripts import cues, full_text
from . import joblog, readers, schemas


def stem() -> Column:
    return F.concat_ws("_", "episode_id", sanitize_title(F.col("episode_title"))).alias("stem")


def freeze(frame: DataFrame, root: str, chart_date: str | None = None, refresh: bool = False) -> str:
    """Write a frame once for its date (today in UTC if none is given); a second write is an error unless it is a refresh."""
    chart_date = chart_date or datetime.now(UTC).strftime("%Y%m%d")
    path = f"{root}/chart_date={chart_date}"
    frame.write.mode("overwrite" if refresh else "errorifexists").csv(path, header=True, escape='"')
    return path


def csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def in_columns(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its order and types."""
    kinds = T.StructType.fromDDL(schema)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in kinds])


def append_log(df: DataFrame, path: str, schema: str | None = None, job: str | None = None) -> None:
    """Rows of a log, all or none; with a schema (STATUS, FAILURES) in its columns. A job that runs again under its name replaces its rows."""
    joblog.append(in_columns(df, schema) if schema else df, path, job)


def manifest(df: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def latest_transcripts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (show_id, episode_id): new rows replace old ones."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in ("show_id", "episode_id")]
    return both.groupBy("show_id", "episode_id").agg(F.max_by(F.struct(*rest), "_v").alias("v")).select("show_id", "episode_id", "v.*").select(*old.columns)


def write_transcripts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("show_id").json(path)


def upsert_transcripts(new: DataFrame, path: str) -> None:
    """Put transcripts(TRANSCRIPT) under path/json and their texts, named by stem, under path/text; rows of one episode, whatever its title was, are replaced.

    Only the shows of the new rows are rewritten. The merged rows are stored before they replace what they were read from.
    """
    spark = new.sparkSession
    there = spark.createDataFrame([], schemas.TRANSCRIPT)
    if readers.there(spark, f"{path}/json"):
        there = spark.read.schema(schemas.TRANSCRIPT).json(f"{path}/json").join(new.select("show_id").distinct(), "show_id", "left_semi")
    staged = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    latest_transcripts(there.select(*new.columns), new).write.parquet(staged)
    merged = spark.read.schema(new.schema).parquet(staged)
    writer = lambda df, keys: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    writer(merged, ["show_id"]).json(f"{path}/json")
    writer(merged.select("show_id", stem(), F.trim(full_text(F.col("segments"))).alias("text")), ["show_id"]).json(f"{path}/text")


def write_vtt(df: DataFrame, path: str) -> None:
    """Cues of transcripts as text, a folder for each safe title."""
    df.select("show_id", stem(), cues(F.col("segments")).alias("value")).write.mode("overwrite").partitionBy("show_id", "stem").text(path)


def raw_json(df: DataFrame, path: str) -> None:
    """A snapshot as JSON, kept if it is there."""
    df.write.mode("ignore").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Lines of a processed list or a log, all or none; df has one string column."""
    joblog.append(df, path, header="false", ext="txt")


def run_manifest(included: DataFrame, excluded: DataFrame, **params) -> DataFrame:
    """Counts, hours and exclusions by rule, with the run's parameters, as one row."""
    by_rule = excluded.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("exclusions_by_rule"))
    totals = included.agg(F.count(F.lit(1)).alias("corpus_size"), F.round(F.sum("hours_available"), 1).alias("corpus_hours"))
    return totals.crossJoin(F.broadcast(by_rule)).withColumns({k: F.lit(v) for k, v in params.items()})
