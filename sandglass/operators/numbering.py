"""Row numbers over a whole table without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(sc, "_sandglass_tables"):
        sc._sandglass_tables = f"file://{tempfile.mkdtemp(prefix='sandglass-tables-')}"
    return sc._sandglass_tables


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, numbered as _part and stored: range bounds are drawn anew each time a plan runs."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of its column up to and with the row within its keys, and all of them as total_*.

    Rows lie in ranges of (keys, order), so a key that holds a third of all rows is spread over a third of the ranges: sums are
    taken within a range, and what its key has in earlier ranges is added.
    """
    parts = ranges(df, [*[F.asc(k) for k in keys], *order])
    own = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per = parts.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    by_key = W.partitionBy(*keys)  # a row for each range that a key is in
    earlier = by_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums]
    totals = [F.sum(f"_all_{n}").over(by_key).alias(f"total_{n}") for n in sums]
    inside = parts.select("*", *[F.sum(c).over(own).alias(f"_in_{n}") for n, c in sums.items()])
    before = per.select("_part", *keys, *offsets, *totals).toDF("_p", *[f"_k{i}" for i in range(len(keys))], *[f"_base_{n}" for n in sums], *[f"total_{n}" for n in sums])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inside.join(before, same)
    return joined.select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums], *[f"total_{n}" for n in sums])


def quantiles(df: DataFrame, column: str, shares: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """A row per key (one row without keys) with linearly interpolated quantiles by name; rows without a value don't count.

    Values are counted first, by key, and counts are summed over ranges of (key, value): the quantiles are picked where the sums reach
    their places, so no buffer holds the values of a key, however many rows or values it has.
    """
    keys = list(keys)
    by = keys or ["_one"]
    rows = df if keys else df.withColumn("_one", F.lit(1))
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(stored(counts, "counts"), by, [F.asc("_v")], {"upto": F.col("_n")})
    at = lambda p: (F.col("total_upto") - 1) * F.lit(float(p))
    value = lambda i: F.min(F.when(F.col("upto") > i, F.col("_v")))  # noqa: E731  the first value that reaches beyond the place
    low = [value(F.floor(at(p))).alias(f"_low_{n}") for n, p in shares.items()]
    high = [value(F.ceil(at(p))).alias(f"_high_{n}") for n, p in shares.items()]
    rest = [F.max(at(p) - F.floor(at(p))).alias(f"_rest_{n}") for n, p in shares.items()]
    between = lambda n: (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_rest_{n}")).alias(n)
    picked = placed.groupBy(*keys).agg(*low, *high, *rest) if keys else placed.agg(*low, *high, *rest)
    return picked.select(*keys, *[between(n) for n in shares])


def numbered(df: DataFrame, order: list[Column], name: str, kind: str = "int") -> DataFrame:
    """df with its row number, from 1, in the order given: ranges are numbered within themselves, plus the rows before them."""
    parts = ranges(df, order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = parts.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(base), "_part").select((F.col("_base") + F.col("_in")).cast(kind).alias(name), *df.columns)
