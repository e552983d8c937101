"""Names against an external label table: the two best scores, and what they mean."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from ..functions.similarity import Block
from .near import settled
from .numbering import stored

ACCEPT, REVIEW, GAP = 90.0, 75.0, 5.0
#: Names and labels of a block at most; few names are dealt over all tasks.
NAMES, LABELS = 2048, 8192


def top2(names: DataFrame, labels: DataFrame, score: str = "edit", most: tuple[int, int] = (NAMES, LABELS)) -> DataFrame:
    """names(id, norm) with the best and second best of labels(label, value, norm), equal scores by label, as structs a and b.

    Exact for every score of functions.similarity, however low the best one is. Distinct names with two near labels are settled by
    keys (see near). The others meet the labels in blocks of bounded size; in a block, bounds of the scores leave a few labels of
    each name to be scored (see there), and the best two of all blocks are the best two of all labels. Of labels with one norm only
    the first two can be among them. Empty names and names without a norm find nothing; labels without a name or a norm take no part.
    """
    spark = names.sparkSession
    ship(spark)
    asked = names.where("norm <> ''").select("norm").distinct()
    same_norm = W.partitionBy("norm").orderBy("label", "value")
    side = labels.where("label is not null and norm is not null").select("label", "value", "norm").withColumn("_r", F.row_number().over(same_norm)).where("_r <= 2").drop("_r")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the number of partitions is given, here and below: by their bytes alone, small rows that make much work would be put together into few tasks
    near_pairs = stored(settled(asked.repartition(tasks, "norm"), side.repartition(tasks, "norm"), score), "near")
    asked = asked.join(near_pairs, "norm", "left_anti")
    n_asked = asked.count()
    if not n_asked:
        return names.join(near_pairs, "norm", "left").select(*names.columns, "a", "b")
    a = max(1, -(-n_asked // min(most[0], n_asked // tasks + 1)))
    b = max(1, -(-side.count() // most[1]))
    deal = lambda n: F.pmod(F.xxhash64("norm"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {f.name: f.dataType for f in side.schema}
    schema = T.StructType([T.StructField("norm", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("label", kinds["label"]), T.StructField("value", kinds["value"]), T.StructField("label_norm", T.StringType())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, found = left["norm"].to_pylist(), []
        if asks and right.num_rows:
            block = Block(right["label"].to_pylist(), right["norm"].to_pylist(), score)
            found = [(n, s, i) for n in asks for s, i in block.best_two(n)]
            right = right.take(pa.array(block.order))
        at = pa.array([i for *_, i in found], pa.int64())
        got = right.select(["label", "value", "norm"]).take(at)
        return pa.table([pa.array([n for n, *_ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), *got.columns], names=schema.names)

    one = asked.select("norm", deal(a).alias("a")).select("*", every(b).alias("b")).repartition(tasks, "a", "b")
    two = side.select("*", deal(b).alias("b")).select("*", every(a).alias("a")).repartition(tasks, "a", "b")
    scored = one.groupBy("a", "b").cogroup(two.groupBy("a", "b")).applyInArrow(search, schema)
    ranked = scored.withColumn("r", F.row_number().over(W.partitionBy("norm").orderBy(F.desc("score"), "label", "value"))).where("r <= 2")
    best = F.struct((-F.col("score")).alias("neg"), "label", "value", "label_norm")
    pairs = ranked.groupBy("norm").agg(F.max(F.when(F.col("r") == 1, best)).alias("a"), F.max(F.when(F.col("r") == 2, best)).alias("b"))
    return names.join(near_pairs.unionByName(pairs), "norm", "left").select(*names.columns, "a", "b")


def match_status(top: DataFrame) -> DataFrame:
    """id, label, value, scores, status and runner-up name; thresholds are applied to unrounded scores."""
    one, two = F.coalesce(-F.col("a.neg"), F.lit(0.0)), F.coalesce(-F.col("b.neg"), F.lit(0.0))
    near = F.col("b").isNotNull() & (one - two < GAP) & (F.col("a.label_norm") != F.col("b.label_norm"))
    status = F.when(one < REVIEW, "none").when(near, "ambiguous").when(one >= ACCEPT, "matched").otherwise("review")
    known = one >= REVIEW
    return top.select(
        "id",
        F.when(known, F.col("a.label")).otherwise("").alias("label_name"),
        F.when(known, F.col("a.value")).otherwise("").alias("label_value"),
        F.round(one, 1).alias("match_score"),
        F.round(two, 1).alias("runner_up_score"),
        status.alias("match_status"),
        F.when(known & near, F.col("b.label")).otherwise("").alias("runner_up_name"),
    )
