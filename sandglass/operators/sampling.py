"""Seeded draws until a budget of hours is met, and nested ladders of them.

The order is a hash of seed, show and episode: stable across runs, independent between shows, the same for all budgets,
so smaller budgets are prefixes of larger ones. One running sum per show computes everything; ladders explode its result.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import quantiles, running

LADDER = (5, 10, 15, 20, 25, 30, 40)


def drawn(episodes: DataFrame, seed: int | str) -> DataFrame:
    """episodes with draw_order (from 0), cum_sec up to each row, before_sec without it, and the show's total_sec."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("show_id"), F.col("episode_id")))
    found = running(episodes.withColumn("_o", key), ["show_id"], [F.asc("_o"), F.asc("episode_id")], {"upto": F.lit(1), "cum_sec": F.col("duration_sec")})
    return found.select(
        *episodes.columns, (F.col("upto") - 1).cast("int").alias("draw_order"), "cum_sec", (F.col("cum_sec") - F.col("duration_sec")).alias("before_sec"), F.col("total_cum_sec").alias("total_sec")
    )


def budget_draw(episodes: DataFrame, hours: float, seed: int | str, keep_short: bool = False) -> DataFrame:
    """Rows in draw order up to and with the one that reaches the budget; shows that can't reach it go, or stay whole."""
    d = drawn(episodes, seed)
    take = (F.col("before_sec") < hours * 3600) | (F.col("draw_order") == 0)
    return d.where(take if keep_short else take & (F.col("total_sec") >= hours * 3600))


def saturation_ladder(episodes: DataFrame, seed: int | str, rungs: tuple = LADDER) -> DataFrame:
    """The draws for each rung that a show reaches; each row appears at every rung that needs it."""
    rung = F.explode(F.filter(F.array(*[F.lit(r) for r in rungs]), lambda h: (F.col("total_sec") >= h * 3600) & (F.col("before_sec") < h * 3600)))
    return drawn(episodes, seed).withColumn("rung_h", rung)


def dropped_shows(episodes: DataFrame, hours: float) -> DataFrame:
    """Shows that can't reach the budget, with their name where episodes have one."""
    name = [F.min("show").alias("show")] if "show" in episodes.columns else []
    per = episodes.groupBy("show_id").agg(*name, F.sum("duration_sec").alias("sec"), F.count(F.lit(1)).alias("n_episodes")).where(F.col("sec") < hours * 3600)
    return per.select("show_id", *(["show"] if name else []), F.round(F.col("sec") / 3600, 2).alias("hours_available"), "n_episodes", F.lit(f"< {hours:g}h in window").alias("reason"))


def per_show_summary(sample: DataFrame) -> DataFrame:
    """Episodes, hours and median minutes of each show, most episodes first."""
    keys = ["show_id", "show"] if "show" in sample.columns else ["show_id"]
    per = sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_eps"), F.round(F.sum("duration_sec") / 3600, 2).alias("hours")
    )
    middle = quantiles(sample, "duration_sec", {"_median": 0.5}, keys).toDF(*[f"_{k}" for k in keys], "_median")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    told = per.join(middle, same, "left").select(*per.columns, F.round(F.col("_median") / 60, 1).alias("med_ep_min"))
    return told.orderBy(F.desc("n_eps"), "show_id")


def sample_check(summary: DataFrame) -> DataFrame:
    """One row: hours per show should lie near the budget, episode counts may vary."""
    ends = lambda c: [F.min(c).alias(f"min_{c}"), F.median(c).alias(f"median_{c}"), F.max(c).alias(f"max_{c}")]
    return summary.agg(*ends("hours"), *ends("n_eps"))


def rung_summary(ladder: DataFrame) -> DataFrame:
    return ladder.groupBy("rung_h").agg(F.count_distinct("show_id").alias("n_shows"), F.count(F.lit(1)).alias("n_eps"), F.round(F.sum("duration_sec") / 3600, 1).alias("hours"))


def permuted_draw(episodes: DataFrame, hours: float, seed: int) -> DataFrame:
    """The same draw with numpy's per-show permutation as the order: it is one of a whole show, which is an Arrow group."""
    import hashlib

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("episode_id").reset_index(drop=True)
        start = int.from_bytes(hashlib.md5(f"{seed}:{pdf.show_id.iloc[0]}".encode()).digest()[:4], "little")
        pdf = pdf.iloc[np.random.default_rng(start).permutation(len(pdf))].reset_index(drop=True)
        cum = pdf.duration_sec.cumsum()
        if not len(pdf) or cum.iloc[-1] < hours * 3600:
            return pdf.iloc[:0].assign(draw_order=pd.Series(dtype="int32"))
        return pdf.iloc[: int(np.searchsorted(cum, hours * 3600)) + 1].assign(draw_order=lambda x: np.arange(len(x), dtype="int32"))

    slim = episodes.select("show_id", "episode_id", "duration_sec")
    return slim.groupBy("show_id").applyInPandas(one, "show_id long, episode_id string, duration_sec double, draw_order int")


def shuffled_draw(episodes: DataFrame, hours: float, window: int, seed: int) -> DataFrame:
    """The draw that keeps short shows whole, ordered by a Mersenne shuffle of a show's episodes sorted by date and url.

    The show's id is part of the shuffle's seed, so that shows of one size are shuffled apart.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pub_date", "audio_url"], kind="stable").reset_index(drop=True)
        order = list(range(len(pdf)))
        random.Random(f"{seed}:{window}:{hours:g}:{pdf.show_id.iloc[0]}").shuffle(order)
        pdf = pdf.iloc[order].reset_index(drop=True)
        before = pdf.duration_sec.cumsum().shift(fill_value=0.0)
        pdf = pdf[before < hours * 3600]
        return pdf.assign(draw_order=np.arange(len(pdf), dtype="int32"))[["show_id", "episode_id", "duration_sec", "draw_order"]]

    slim = episodes.select("show_id", "episode_id", "duration_sec", "pub_date", "audio_url")
    return slim.groupBy("show_id").applyInPandas(one, "show_id long, episode_id string, duration_sec double, draw_order int")
