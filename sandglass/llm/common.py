"""What the operators of this subpackage share: shared-folder tables, code shipping, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of all contracts; bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; a temporary one only where none is set and Spark runs in one process (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(sc, "_sandglass_shared", None) or f"file://{tempfile.mkdtemp(prefix='sandglass-')}"
        sc._sandglass_shared = path
    return f"{path.rstrip('/')}/sandglass-{sc.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there and survives lost executors.

    Tables lie in one folder per application, which can be removed once its results are no longer read.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, one: DataFrame, on: list[str], weight: str, total: int | None = None) -> DataFrame:
    """rows joined with ``one``, which has a row per key and says in ``weight`` how many of rows have that key.

    A key is crowded if its rows are more than a quarter of a task's even share. At most 4 * shuffle partitions keys can be, so
    these few rows of ``one`` are broadcast, however large the tables are; all other keys meet in a shuffle of even parts.
    ``total`` is the number of rows, where the caller knows it already.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = one.agg(F.sum(weight)).first()[0] or 0
    fair = total // (4 * partitions) + 1
    crowded = one.where(F.col(weight) > fair).drop(weight)
    thin = one.where(F.col(weight) <= fair).drop(weight)
    rest = rows.join(F.broadcast(crowded.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(crowded), on).unionByName(rest.join(thin, on))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run (once per Spark context)."""
    sc = spark.sparkContext
    if getattr(sc, "_sandglass_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix="sandglass-code-"), "sandglass_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "sandglass")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._sandglass_shipped = True


#: Rows that a Python worker turns into objects at once; Arrow batches of Spark hold many more.
PART_ROWS = 512


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows; freed memory goes back to the system after each batch, as workers live on."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
        if give_back is not None:
            give_back(0)


def map_rows(df: DataFrame, rows: Callable[[list[dict]], dict[str, list]], schema: str, part_rows: int = PART_ROWS) -> DataFrame:
    """mapInArrow where rows() turns the columns of one Arrow batch (as Python lists) into output columns."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in parts(batches, part_rows):
            if target is None:
                target = arrow_schema(schema)
            cols = rows(*[batch.column(i).to_pylist() for i in range(len(names))])
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(schema: str) -> pa.Schema:
    """A pyarrow schema of flat 'name type, ...' text."""
    return pa.schema([(n, _ARROW[t]) for n, t in (part.split() for part in schema.split(","))])


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))
