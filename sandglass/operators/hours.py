"""Hours available per show and window, survival over an hours grid, diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import months_before, round_even
from .numbering import quantiles

WINDOWS = (12, 18, 24, 36)
GRID = (5, 10, 15, 20, 25, 30, 40, 50)


def usable(episodes: DataFrame, min_sec: float | None = None) -> DataFrame:
    """Episodes with a url, a date and a duration (of at least min_sec)."""
    ok = (F.col("audio_url") != "") & F.col("pub_date").isNotNull() & F.col("duration_sec").isNotNull()
    if min_sec is not None:
        ok = ok & (F.col("duration_sec") > 0) & (F.col("duration_sec") >= min_sec)
    return episodes.where(ok)


def with_anchor(episodes: DataFrame) -> DataFrame:
    """episodes with the latest pub_date of all as ``anchor``; a one-row scalar is all that is broadcast."""
    return episodes.crossJoin(F.broadcast(episodes.agg(F.max("pub_date").alias("anchor"))))


def lookback(episodes: DataFrame, months: int, as_of: Column | None = None) -> DataFrame:
    """Rows on or after the cutoff, without an upper bound; the anchor is as_of or the latest date."""
    if as_of is not None:
        return episodes.where(F.col("pub_date") >= months_before(as_of, months))
    return with_anchor(episodes).where(F.col("pub_date") >= months_before(F.col("anchor"), months)).drop("anchor")


def show_hours(shows: DataFrame, episodes: DataFrame, windows: tuple = WINDOWS, as_of: Column | None = None) -> DataFrame:
    """A row per show and window, shows without episodes too: counts and sums by conditional aggregation, medians from counted values."""
    rows = episodes.withColumn("anchor", as_of) if as_of is not None else with_anchor(episodes)
    aggs = []
    for w in windows:
        inside = F.col("pub_date") >= months_before(F.col("anchor"), w)
        sec = F.when(inside, F.col("duration_sec"))
        aggs += [F.count(sec).alias(f"n{w}"), F.coalesce(F.sum(sec), F.lit(0.0)).alias(f"s{w}")]
    oldest = F.coalesce(F.min("pub_date") > months_before(F.max("anchor"), max(windows)), F.lit(False)).alias("feed_truncated")
    per = rows.groupBy("show_id").agg(*aggs, oldest)
    long = shows.select("show_id").join(per, "show_id", "left").select(
        "show_id",
        F.coalesce("feed_truncated", F.lit(False)).alias("feed_truncated"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(w).alias("window_months"),
                        F.coalesce(f"n{w}", F.lit(0)).cast("long").alias("n_episodes"),
                        F.round(F.coalesce(f"s{w}", F.lit(0.0)) / 3600, 2).alias("total_hours"),
                    )
                    for w in windows
                ]
            )
        ).alias("x"),
    )
    inside = F.filter(F.array(*[F.when(F.col("pub_date") >= months_before(F.col("anchor"), w), w) for w in windows]), lambda w: w.isNotNull())
    in_window = rows.select(F.col("show_id").alias("_show"), "duration_sec", F.explode(inside).alias("_window"))
    middle = quantiles(in_window, "duration_sec", {"_median": 0.5}, ["_show", "_window"])
    told = long.select("show_id", "x.*", "feed_truncated").join(middle, (F.col("show_id") == F.col("_show")) & (F.col("window_months") == F.col("_window")), "left")
    minutes = F.round(F.coalesce("_median", F.lit(0.0)) / 60, 1).alias("median_ep_minutes")
    return told.select("show_id", "window_months", "n_episodes", "total_hours", minutes, "feed_truncated")


def survival_table(hours: DataFrame, grid: tuple = GRID) -> DataFrame:
    """Shows that reach H hours per window, and the corpus they make; one aggregation, then a grid of fixed size."""
    counts = hours.groupBy("window_months").agg(*[F.count_if(F.col("total_hours") >= h).alias(f"h{h}") for h in grid])
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("H"), F.col(f"h{h}").alias("n_surviving")) for h in grid])).alias("x")
    return counts.select("window_months", rows).select("window_months", "x.H", "x.n_surviving", (F.col("x.n_surviving") * F.col("x.H")).alias("corpus_hours"))


def quartiles(hours: DataFrame, column: str = "total_hours") -> DataFrame:
    c = F.col(column)
    ends = hours.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c == 0).alias("n_dormant"))
    return quantiles(hours, column, {"p25": 0.25, "median": 0.5, "p75": 0.75}).crossJoin(F.broadcast(ends))  # a row each


def quartile_diagnostics(hours: DataFrame) -> DataFrame:
    """Lowest quarter of shows against the rest: sizes, median episode length, median episode count."""
    cut = quantiles(hours, "total_hours", {"q1": 0.25})
    low = F.col("total_hours") <= F.col("q1")
    marked = hours.crossJoin(F.broadcast(cut)).withColumn("side", F.when(low, "low").otherwise("rest"))  # one row
    out = None
    for side in ("low", "rest"):
        own = marked.where(F.col("side") == side)
        size = own.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n_shows")).where("n_shows > 0")
        one = size.crossJoin(F.broadcast(quantiles(own, "median_ep_minutes", {"median_minutes": 0.5}))).crossJoin(F.broadcast(quantiles(own, "n_episodes", {"median_episodes": 0.5})))
        out = one if out is None else out.unionByName(one)
    return out


def knee(survival: DataFrame) -> DataFrame:
    """Per window the H before the steepest loss of shows per hour (first of ties), the mean slope, and whether it is sharp."""
    w = W.partitionBy("window_months").orderBy("H")
    steps = survival.select(
        "window_months", "H", "n_surviving", F.lag("H").over(w).alias("h0"), F.lag("n_surviving").over(w).alias("n0")
    ).withColumn("rate", (F.col("n0") - F.col("n_surviving")).cast("double") / (F.col("H") - F.col("h0")))
    ends = F.struct("H", "n_surviving")
    out = steps.groupBy("window_months").agg(F.max(F.when(F.col("rate").isNotNull(), F.struct("rate", (-F.col("h0")).alias("neg")))).alias("k"), F.min(ends).alias("a"), F.max(ends).alias("b"))
    mean = (F.col("a.n_surviving") - F.col("b.n_surviving")).cast("double") / (F.col("b.H") - F.col("a.H"))
    return out.select("window_months", (-F.col("k.neg")).alias("knee_h"), F.col("k.rate").alias("knee_rate"), mean.alias("mean_rate"), (F.col("k.rate") >= 2 * mean).alias("sharp"))


def retention_argmax(survival: DataFrame, n_total: DataFrame, target: float = 0.9) -> DataFrame:
    """Largest H per window that keeps the target share of shows; NULL if none does."""
    return survival.crossJoin(F.broadcast(n_total)).groupBy("window_months").agg(F.max(F.when(F.col("n_surviving") >= target * F.col("n_total"), F.col("H"))).alias("best_h"))


def histogram(hours: DataFrame, top: float = 300.0, bins: int = 40) -> DataFrame:
    clipped = F.least(F.col("total_hours"), F.lit(top))
    return hours.groupBy(F.least(F.floor(clipped / (top / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def duration_log(episodes: DataFrame) -> DataFrame:
    """Per show: items, usable ones, without duration, estimated from bytes."""
    missing = F.col("duration_sec").isNull() | (F.col("duration_source") == "missing")
    ok = (F.col("audio_url") != "") & F.col("pub_date").isNotNull() & F.col("duration_sec").isNotNull()
    return episodes.groupBy("show_id").agg(
        F.count(F.lit(1)).alias("episodes_in_feed"), F.count_if(ok).alias("episodes_usable"),
        F.count_if(missing).alias("duration_missing_or_unparseable"), F.count_if(F.col("duration_source") == "estimated_from_bytes").alias("duration_byte_estimated"),
    )


def feed_stats(episodes: DataFrame, rounded: Callable[[Column, int], Column] = round_even, no_share: float | None = 0.0) -> DataFrame:
    """Per show: counts, hours, estimated share (no_share without any such), mean minutes, first and last date, episodes a week; rounded half to even."""
    audio = F.col("audio_url") != ""
    counts = audio & (F.coalesce("duration_sec", F.lit(0.0)) != 0)
    sec = F.when(counts, F.col("duration_sec"))
    total = F.coalesce(F.sum(sec), F.lit(0.0))
    guessed = F.sum(F.when(F.col("duration_source") == "estimated_from_bytes", sec))
    first, last = F.min("pub_date"), F.max("pub_date")
    weeks = F.greatest(F.timestamp_diff("DAY", first, last) / 7, F.lit(1 / 7))
    return episodes.groupBy("show_id").agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.count_if(audio).alias("episodes_with_audio"),
        rounded(total / 3600, 2).alias("hours_available"),
        F.coalesce(rounded(F.try_divide(guessed, total), 3), F.lit(no_share).cast("double")).alias("hours_estimated_share"),
        F.coalesce(rounded(F.avg(rounded(sec, 1)) / 60, 1), F.lit(0.0)).alias("avg_episode_minutes"),
        first.alias("first_pub_date"),
        last.alias("last_pub_date"),
        F.coalesce(rounded(F.count("pub_date") / weeks, 2), F.lit(0.0)).alias("episodes_per_week"),
    )
