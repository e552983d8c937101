"""Mixing sources to target weights (operator 4).

Token counts are summed per source; targets are found by weighted filling with a ceiling of ``most`` times each
source's own size; the rate target / size says how often a document is repeated: floor(rate) whole copies and one
more if a hash of its id, seeded, falls below the fraction (a Bernoulli draw that every rerun repeats). A
source's taken size has its target as its mean; its relative spread shrinks with the root of its documents.

Documents meet their source's rate in a join that Spark sizes itself: the targets, a row per source, are a stored table,
broadcast only while it is below spark.sql.autoBroadcastJoinThreshold. However many sources there are, none of their
ordered sums is taken in one task: ranges are summed within themselves, plus the sums of the ranges before them.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source of size 0 has
target 0 and its documents are taken 0 times; documents without an id draw by their text's hash; repeated rows
draw alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST = 2
SEED = 17


def size_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs, null as 0."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+", "")
    return F.length(F.regexp_replace(bare, r"[^ \t-\r]++[ \t-\r]*+", "x")).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with, for each name in sums, the sum of its column over all rows before in the order; stored by ranges."""
    parts = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    own = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = parts.groupBy("part").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])  # a row per range
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = whole.select("part", *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"base_{n}") for n in sums])
    inside = [F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"in_{n}") for n, c in sums.items()]
    joined = parts.select("*", *inside).join(F.broadcast(base), "part")
    return joined.select(*rows.columns, *[(F.col(f"in_{n}") + F.col(f"base_{n}")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sizes(source, size).

    Weighted filling with ceilings has a closed form: with sources ordered by ceiling / weight, the sources before
    some point stop at their ceilings and the rest share what is left by weight. Sums stay integers, so
    one division makes the target and reruns agree to the last bit.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    by_name = F.col("source").asc_nulls_last()
    num, den = share
    turned = running(per, [by_name], {"turn": F.lit(1)}, "mix-turns")
    weighed = turned.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    ratio = weighed.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    ranked = stored(running(ratio, [F.col("ratio").asc(), by_name], {"pos": F.lit(1), "spent": F.col("cap"), "w_before": F.col("w")}, "mix-ranks"), "mix-ranked")
    total = ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_all"))
    placed = (
        ranked.crossJoin(F.broadcast(total))  # one row
        .withColumn("w_left", F.col("w_all") - F.col("w_before"))
        .withColumn("left", F.col("total") * num - F.col("spent") * den)
        .withColumn("stops", F.col("cap") * den * F.col("w_left") <= F.col("w") * F.col("left"))
    )
    # the first source below its ceiling fixes the level for all that follow
    first = placed.agg(F.min(F.when(~F.col("stops"), F.struct("pos", "left", "w_left"))).alias("f"))
    share_of = (F.col("w") * F.col("f.left")) / (F.col("f.w_left") * den)
    return placed.crossJoin(F.broadcast(first)).select(  # one row
        "source",
        "source_size",
        F.when(F.col("f").isNull() | (F.col("pos") < F.col("f.pos")), F.col("cap").cast("double")).otherwise(share_of).alias("target"),
    )


def with_copies(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(row, doc_id, text, source) of docs, row having all columns, with size, source size, target and copies as __mix_*."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    sized = packed.withColumn("__mix_size", size_of(F.col("text")))
    # a stored table has a size that Spark knows: few sources are broadcast, and no text is shuffled
    goals = stored(source_targets(docs.select("source", size_of(F.col("text")).alias("size")), weights, share, most), "mix-targets")
    goals = goals.select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("long")
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    more = (draw < F.floor((rate - whole) * F.lit(4294967296.0))).cast("long")
    return sized.join(goals, sized["source"].eqNullSafe(goals["__mix_source"]), "left").drop("__mix_source").withColumn("__mix_copies", whole + more)


def mix_digest(docs: DataFrame, **how) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))
    return with_copies(slim, **how).select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"),
        F.col("__mix_copies").alias("copies"),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as it is drawn, with the columns of docs."""
    drawn = with_copies(docs, **how).where("__mix_copies > 0")
    return drawn.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select("row.*")
