"""The best two labels of names that have two near ones, by keys: no pair beyond those that share a key is looked at.

Texts share a letter key if they are equal once each has lost one letter at most, and a word key if their words are the same. From the
pairs found this way follow two scores; from the lengths and the numbers of words that labels have follows the most that any other
label can reach. Where the second best is above that, the two are the best of all labels. Other names are left to a search of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.similarity import SLACK

#: Longest names that get keys; labels of FAR letters or more are half as long again as any of them and count as equally long.
LETTERS = 64
FAR = LETTERS * 3 // 2 + 1
#: Blanks as Python's split() has them.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def letter_keys(norm: Column) -> Column:
    """Hashes of a text and of what is left of it without one letter; of equal letters in a row only the first is left out."""
    first = lambda i: (i < 2) | (F.substring(norm, i, 1) != F.substring(norm, i - 1, 1))
    places = F.filter(F.sequence(F.lit(0), F.length(norm)), first)
    return F.transform(places, lambda i: F.xxhash64(F.concat(F.substring(norm, 1, i - 1), F.substring(norm, i + 1, FAR))))


def words(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, BLANKS), lambda w: w != ""))


def word_key(norm: Column) -> Column:
    """Hash of the sorted words; NULL without any."""
    return F.when(F.size(words(norm)) > 0, F.xxhash64(F.array_join(F.array_sort(words(norm)), " ")))


def alike(a: Column, b: Column) -> Column:
    """Whether lengths differ by less than half."""
    return F.greatest(a, b) * 2 < F.least(a, b) * 3


@dataclass(frozen=True)
class Near:
    """A score over texts of lengths la, lb and with as many distinct words as wa, wb say."""

    exact: Callable[[Column, Column], Column]
    of_letters: Callable[[], Column]  # of pairs that share a letter key: the score where it is above far, else no more than it; NULL of pairs to be left out
    of_words: float | None  # the same of pairs that share a word key only, where lengths are alike
    far: Callable[[], Column]  # the most that pairs without a key can reach, and of pairs with one what of_letters and of_words don't tell


def edit_of_letters() -> Column:
    longest, d = F.greatest("la", "lb"), F.levenshtein("norm", "label_norm", 1)
    return F.when(d >= 0, 100.0 * (longest - d) / longest)


def edit_far() -> Column:
    longest = F.greatest("la", "lb")
    return 100.0 * (longest - F.greatest(F.lit(2), F.abs(F.col("la") - F.col("lb")))) / longest


def composite_of_letters() -> Column:
    longest = F.greatest("la", "lb")
    common = F.when(F.col("norm") == F.col("label_norm"), longest).otherwise(longest - 1)
    same_words = F.when((F.col("words") == F.col("label_words")) & alike(F.col("la"), F.col("lb")), 0.95 * 100.0)
    return F.greatest(200.0 * common / (F.col("la") + F.col("lb")), same_words)


def composite_far() -> Column:
    longest = F.greatest("la", "lb")
    plain = 200.0 * F.least("la", "lb", longest - 2) / (F.col("la") + F.col("lb"))
    other_words = F.when(F.col("wa") == F.col("wb"), 200.0 * (longest - 1) / (longest * 2 - 1)).otherwise(100.0)  # one's words may be among the other's
    return F.greatest(plain, F.when(alike(F.col("la"), F.col("lb")), 0.95 * other_words).otherwise(0.9 * 100.0))


SCORES = {"edit": Near(fuzzy.edit_ratio, edit_of_letters, None, edit_far), "composite": Near(fuzzy.composite_ratio, composite_of_letters, 0.95 * 100.0, composite_far)}


def reach(names: DataFrame, labels: DataFrame, score: Near) -> DataFrame:
    """(la, wa, far) for each length and number of words of names; labels have few of them too, as long ones count as one."""
    kinds = lambda df, l, w: df.select(F.least(F.length("norm"), F.lit(FAR)).alias(l), F.size(words(F.col("norm"))).alias(w)).distinct()  # noqa: E731,E741
    one, two = kinds(names, "la", "wa"), kinds(labels.withColumn("norm", F.substring("norm", 1, FAR)), "lb", "wb")
    return one.crossJoin(F.broadcast(two)).groupBy("la", "wa").agg(F.greatest(F.max(score.far()), F.lit(0.0)).alias("far"))


def settled(names: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """(norm, a, b) of the distinct names(norm) whose best two of labels(label, value, norm) are found by keys; two labels of a norm at most."""
    score = SCORES[kind]
    same_norm = W.partitionBy("norm").orderBy("label", "value")
    first = labels.withColumn("_r", F.row_number().over(same_norm)).where("_r = 1").drop("_r")
    sized = lambda df, size, key: df.withColumns({size: F.length("norm"), key: word_key(F.col("norm")) if score.of_words is not None else F.lit(None).cast("long")})
    one = sized(names, "la", "words").where(F.col("la").between(1, LETTERS))
    two = sized(first, "lb", "label_words").where(F.col("lb").between(1, LETTERS + 1))
    keyed = lambda df: df.withColumn("key", F.explode(letter_keys(F.col("norm"))))
    # names look small enough to be broadcast before they get their keys; with them they may not be
    pairs = keyed(one).hint("merge").join(keyed(two).withColumnRenamed("norm", "label_norm"), "key").withColumn("score", score.of_letters())
    if score.of_words is not None:
        by_words = one.join(two.withColumnRenamed("norm", "label_norm"), (F.col("words") == F.col("label_words")) & (F.col("norm") != F.col("label_norm")) & alike(F.col("la"), F.col("lb")))
        apart = ~F.arrays_overlap(letter_keys(F.col("norm")), letter_keys(F.col("label_norm")))
        pairs = pairs.unionByName(by_words.where(apart).withColumn("score", F.lit(score.of_words)), allowMissingColumns=True)
    # a pair with several keys has one rank
    best = W.partitionBy("norm").orderBy(F.desc("score"), "label", "value", "label_norm")
    top = pairs.where("score is not null").select("norm", "score", "label", "value", "label_norm").withColumn("_r", F.dense_rank().over(best)).where("_r <= 2")
    norms = top.select("norm", "score", "label_norm").distinct()
    rows = norms.join(labels.withColumnRenamed("norm", "label_norm"), "label_norm")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("norm").orderBy(F.desc("score"), "label", "value"))).where("_r <= 2")
    told = ranked.withColumn("_ok", score.exact(F.col("norm"), F.col("label_norm")) == F.col("score"))  # hashes may be equal by chance
    pick = F.struct((-F.col("score")).alias("neg"), "label", "value", "label_norm")
    two_best = told.groupBy("norm").agg(
        F.max(F.when(F.col("_r") == 1, pick)).alias("a"), F.max(F.when(F.col("_r") == 2, pick)).alias("b"), F.min("score").alias("least"), F.min("_ok").alias("ok")
    )
    known = two_best.withColumns({"la": F.length("norm"), "wa": F.size(words(F.col("norm")))}).join(F.broadcast(reach(names, labels, score)), ["la", "wa"])
    return known.where(F.col("b").isNotNull() & F.col("ok") & (F.col("least") > F.col("far") + SLACK)).select("norm", "a", "b")
