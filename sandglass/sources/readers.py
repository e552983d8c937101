"""Sources: charts, lookups, frames, feeds, labels, manifests, logs, queues."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import variants
from . import charts, schemas


def chart_ids(spark: SparkSession, path: str) -> DataFrame:
    """(rank, id) of a chart snapshot, ranks from 1; a chart without ids is an error when read."""
    raw = spark.read.schema(schemas.CHART_IDS).json(path, multiLine=True)
    there = F.when(F.col("result_ids").isNotNull(), F.col("result_ids")).otherwise(F.raise_error(F.lit("chart snapshot has no result_ids")))
    return raw.select(F.posexplode(there).alias("pos", "id")).select((F.col("pos") + 1).alias("rank"), "id")


def lookups(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of a snapshot of lookups, a file of JSON: results of podcasts or tracks, the last response winning."""
    each = spark.read.text(path, wholetext=True).select(F.posexplode(variants.elements(F.parse_json("value"), "$.responses")).alias("p", "r"))
    items = each.select("p", F.posexplode(variants.elements(F.col("r"), "$.response.results")).alias("q", "item"))
    return charts.typed(items.select(F.struct("p", "q").alias("place"), "item"))


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path has files; other errors of reading it are raised."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def frame(ids: DataFrame, found: DataFrame, category: str, subcategory: str, missing: str | None = None) -> DataFrame:
    """The sampling frame: every ranked id with its metadata; text that the lookup had not is ``missing``, numbers NULL."""
    x = lambda n: F.col(f"x.{n}") if missing is None or n == "trackCount" else F.coalesce(F.col(f"x.{n}"), F.lit(missing))
    return ids.join(found, "id", "left").select(
        "rank", F.col("id").alias("collection_id"), x("collectionName").alias("show_name"), x("artistName").alias("publisher"), x("feedUrl").alias("feed_url"),
        x("primaryGenreName").alias("primary_genre"), F.array_join(F.coalesce("x.genres", F.array().cast("array<string>")), "|").alias("genres"), F.lit(category).alias("apple_category"), F.lit(subcategory).alias("apple_subcategory"),
        x("trackCount").alias("track_count"), x("country").alias("country"), x("releaseDate").alias("release_date"), x("collectionViewUrl").alias("apple_url"),
        x("artworkUrl600").alias("artwork_url"), F.col("x").isNotNull().alias("lookup_found"),
    )


def frozen_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FRAME).csv(path, header=True, multiLine=True, escape='"')


def episodes_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EPISODES).csv(path, header=True, multiLine=True, escape='"')


def corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """The corpus table, ids as text; columns are found by their header."""
    if not there(spark, path):
        raise FileNotFoundError(f"no corpus at {path}; run the corpus build first")
    names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    kinds = dict(c.strip().split(" ") for c in schemas.CORPUS.split(","))
    return spark.read.schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).csv(path, header=True, multiLine=True, escape='"')


def fixed_ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    """A source of given numbers, in their order."""
    return spark.createDataFrame(list(enumerate(ids)), "turn int, id long")


def labels_csv(spark: SparkSession, path: str, name: str = "show name", value: str = "partisan leaning") -> DataFrame:
    """(label, value, norm); headers by trimmed name in any case, rows without a name dropped, of equal names the first by file and line kept."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    by = {c.strip().lower(): c for c in raw.columns}
    if name not in by or value not in by:
        raise ValueError(f"expected columns {name!r} and {value!r}, got {raw.columns}")
    rows = raw.select(F.col(f"`{by[name]}`").alias("label"), F.col(f"`{by[value]}`").alias("value"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("i"))
    first = rows.where("label is not null").groupBy("label").agg(F.min_by("value", "i").alias("value"))
    return first.withColumn("norm", X.normalize_name(F.col("label")))


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.limit(limit) if limit else df


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("id")).distinct()


def playlist(spark: SparkSession, path: str, min_sec: int = 2700) -> DataFrame:
    return spark.read.schema("id string, title string, duration double").json(path).where(F.col("duration") >= min_sec)


def audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("audio_sha256"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSCRIPT).json(path)


def parsed_feed(body: Column) -> Column:
    """The feed's struct; a second try without control bytes where the first finds no channel."""
    parse = lambda c: F.from_xml(c, schemas.FEED, {"ignoreNamespace": "true", "rowTag": "rss", "mode": "PERMISSIVE"})
    channel = F.coalesce(parse(body)["channel"], parse(X.strip_control(body))["channel"])  # each parsed once at most
    return F.when(body.isNotNull(), F.struct(channel.alias("channel")))


def feed_status(shows: DataFrame) -> DataFrame:
    """shows(collection_id, feed_url, body, http_status, error) with feed, status and error, first failure first."""
    got = shows.withColumn("feed", parsed_feed(F.col("body")))
    items = F.coalesce(F.col("feed.channel.item"), F.array().cast(f"array<{schemas.ITEM}>"))
    heard = F.exists(items, lambda i: F.coalesce(i["enclosure"]["_url"], F.lit("")) != "")
    status = (
        F.when(F.trim(F.coalesce("feed_url", F.lit(""))) == "", "no_feed_url")
        .when(F.col("body").isNull(), "feed_unreachable")
        .when(F.col("feed.channel").isNull(), "feed_unparseable")
        .when(~heard, "no_audio")
        .otherwise("ok")
    )
    why = (
        F.when(status == "no_feed_url", "no feed url in lookup")
        .when(status == "feed_unreachable", F.coalesce("error", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))))
        .when(status == "feed_unparseable", "no channel could be parsed")
        .when(status == "no_audio", "no episodes with audio enclosures")
        .otherwise("")
    )
    return got.withColumn("status", status).withColumn("error", why)


def feed_channel(parsed: DataFrame) -> DataFrame:
    c = lambda n: F.trim(F.coalesce(F.col(f"feed.channel.{n}"), F.lit("")))
    return parsed.withColumns({"rss_description": c("description"), "rss_language": c("language"), "rss_author": c("author"), "rss_owner_name": c("owner.name")})


def feed_episodes(parsed: DataFrame) -> DataFrame:
    """A row per item with repaired durations (full precision in duration_raw, one decimal in duration_sec)."""
    heard = parsed.where("body is not null") if "body" in parsed.columns else parsed
    # feeds without items fall out by their items' places: a filter on the feed, or explode's own, would parse it again
    rows = heard.select("collection_id", "show_name", F.posexplode_outer("feed.channel.item").alias("p", "i")).where("p is not null")
    size = X.enclosure_bytes(F.col("i.enclosure._length"))
    rows = rows.withColumn("d", X.estimate_duration(X.parse_duration(F.col("i.duration")), size))
    real = F.nullif(F.col("d.sec"), F.lit(0.0))
    return rows.select(
        "collection_id", "show_name", F.trim(F.coalesce("i.title", F.lit(""))).alias("episode_title"),
        F.substring(F.trim(F.coalesce("i.description", F.lit(""))), 1, 2000).alias("episode_description"),
        X.parse_pubdate(F.col("i.pubDate")).alias("pub_date"), F.coalesce("i.enclosure._url", F.lit("")).alias("audio_url"), size.alias("audio_bytes"),
        X.round_even(real, 1).alias("duration_sec"), real.alias("duration_raw"), F.col("d.source").alias("duration_source"),
    )


def sampler_pool(episodes: DataFrame, min_minutes: float = 5.0) -> DataFrame:
    """Episodes renamed and keyed for the sampler: long enough, dated, with a url, first of each key kept."""
    from ..operators.hours import usable
    from ..operators.queue import keep_first

    rows = usable(episodes, min_minutes * 60).withColumnsRenamed({"collection_id": "show_id", "show_name": "show"})
    rows = rows.withColumn("episode_id", X.episode_id(F.col("audio_url"))).withColumn("duration_hr", F.col("duration_sec") / 3600).withColumn("_i", F.monotonically_increasing_id())
    return keep_first(rows, ["show_id", "episode_id"], ["_i"]).drop("_i")
