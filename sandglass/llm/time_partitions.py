"""Adaptive time partitions (operator 11): an RDD secondary sort into files whose time spans follow the rows.

Rows have a moment. The years from the first to the last moment are siblings; a node with more rows than ``limit`` is split into
all its months, days or hours, and siblings within the limit join in time order to runs of up to ``limit`` rows. Runs with rows are
leaves, as are hours above the limit and all rows without a moment. A leaf is one Parquet file, or as many parts of ``limit`` rows
as it fills.

Rows are counted by hour once, in a stored table with a row per hour; the driver asks it for the children of nodes that are split
only, so what it holds follows rows / limit and never the rows. Where each file begins is exact: in thin leaves at a moment, in
leaves of several parts at a row number, taken over ranges of (moment, order), so one hour that holds a third of all rows is numbered
and written by many tasks. Files above BUCKET_ROWS rows or BUCKET_BYTES in the mean are cut into buckets by time in the same way.
These offsets are the partitioner. Rows travel as Arrow blocks: a task cuts what it read into a block for each bucket, by offsets alone;
repartitionAndSortWithinPartitions on (file, bucket) delivers the blocks of a file bucket by bucket, and one task a file puts one bucket
after the other in order and streams it into one ParquetWriter. A task writes under a name of its own and renames at the end, so
tasks can be lost or run twice.

A rewrite compares each file's leaf, part, row count and sum of row hashes (64 bits a row) with the files there; those that
recur stay, others are written under the next version's name, and only then what is no longer named is removed.

Defined cases: rows without a moment form the leaf ``null``; within a leaf rows lie by moment and order, nulls first, ties by the hash
of the whole row, so repeated rows stay repeated and reruns write equal files; an empty table has no files; columns of any name
and type are written as they are, with two of one name an error, as Parquet has none. Order columns are whole numbers, dates or timestamps.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered
from .common import parts, shared_dir, ship, stored

HOUR = 3_600_000_000
DAY = 24 * HOUR
UNITS = "YMDh"
NULL = "null"
#: Rows of a row group.
GROUP = 65536
#: What a task cuts into blocks at once, and bytes of blocks that it hands on at once.
DEAL_ROWS, DEAL_BYTES, HAND_BYTES = 131072, 32 << 20, 4 << 20
#: What a writing task puts in order at once: rows, and bytes by the mean over all rows.
BUCKET_ROWS, BUCKET_BYTES = 262144, 64 << 20
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Leaf:
    name: str
    start: int | None  # hours since 1970; None for rows without a moment
    rows: int


@dataclass(frozen=True)
class File:
    leaf: str
    part: int
    rows: int
    check: Decimal  # sum of the rows' hashes
    path: str = ""
    digest: str = ""
    marked: int = 0
    written: bool = False


@dataclass(frozen=True)
class Cuts:
    """Where buckets begin: ascending row numbers and moments with the bucket that begins there, and the bucket without a moment."""

    ranks: np.ndarray
    by_rank: np.ndarray
    moments: np.ndarray
    by_moment: np.ndarray
    none: int
    file: np.ndarray  # of each bucket, -1 if it stays


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a date or of a timestamp, which counts as it stands if it has no zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    days = F.unix_date(column.cast("date")).cast("long") * DAY
    if isinstance(kind, T.DateType):
        return days
    second = (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    return days + F.hour(column).cast("long") * HOUR + F.minute(column).cast("long") * 60_000_000 + second


def floor_to(value: Column, step: int) -> Column:
    return value - F.pmod(value, F.lit(step).cast("long"))


def width(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(column.cast("string")), F.lit(0))
    return F.lit(8)


def hour_counts(keyed: DataFrame) -> DataFrame:
    """Stored (hour, n, h, b) of keyed(m, h, b): rows, the sum of their hashes and of their bytes for each hour, null among them."""
    hour = F.expr(f"(m - pmod(m, {HOUR}L)) div {HOUR}L").alias("hour")
    hashes = F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("h")
    return stored(keyed.groupBy(hour).agg(F.count(F.lit(1)).alias("n"), hashes, F.sum(F.col("b").cast("long")).alias("b")), "hours")


def sums(table: DataFrame, starts: list[int]) -> dict[int, tuple[int, Decimal]]:
    """By place in starts (ascending): rows and hash sums of table(hour, n, h) from that start up to the next."""
    at = np.array(starts, dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 65536):
            where = np.searchsorted(at, b.column(0).to_numpy(), "right") - 1
            yield pa.record_batch([pa.array(where), b.column(1), b.column(2)], names=["at", "n", "h"])

    got = table.where("hour is not null").select("hour", "n", "h").mapInArrow(place, "at long, n long, h decimal(38,0)")
    return {r["at"]: (r["n"], r["h"]) for r in got.groupBy("at").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where("at >= 0").collect()}


def joined(nodes: list[tuple[str, int, int]], limit: int) -> list[tuple[str, str, int, int, bool]]:
    """(first, last, start, rows, above the limit) of the runs of siblings (label, start, rows) in time order."""
    out: list[tuple[str, str, int, int, bool]] = []
    for label, start, n in nodes:
        if n <= limit and out and not out[-1][4] and out[-1][3] + n <= limit:
            first, _, begun, before, _ = out[-1]
            out[-1] = (first, label, begun, before + n, False)
        else:
            out.append((label, label, start, n, n > limit))
    return out


def children(start: np.datetime64, unit: str) -> list[tuple[str, int]]:
    """(label, start in hours) of the months of a year, the days of a month or the hours of a day, and the end as a last row."""
    above = UNITS[UNITS.index(unit) - 1]
    step = np.timedelta64(1, unit)
    first, end = start.astype(f"M8[{unit}]"), (start.astype(f"M8[{above}]") + 1).astype(f"M8[{unit}]")
    each = np.arange(first, end + step, step)
    label = {"M": lambda i: f"{i + 1:02d}", "D": lambda i: f"{i + 1:02d}", "h": lambda i: f"{i:02d}"}[unit]
    return [(label(i), int(t.astype("M8[h]").astype(np.int64))) for i, t in enumerate(each)]


def leaves(table: DataFrame, limit: int) -> list[Leaf]:
    """Leaves of the rows counted in table(hour, n, h), in time order, rows without a moment last."""
    ends = table.agg(F.min("hour").alias("low"), F.max("hour").alias("high"), F.sum(F.expr("if(hour is null, n, 0)")).alias("none")).first()
    found: list[Leaf] = []
    if ends["low"] is not None:
        year = lambda h: int(np.datetime64(h, "h").astype("M8[Y]").astype(np.int64))  # noqa: E731  years since 1970
        years = range(year(ends["low"]), year(ends["high"]) + 2)
        open_nodes = [("", [(f"{y + 1970:04d}", int(np.datetime64(y, "Y").astype("M8[h]").astype(np.int64))) for y in years])]
        for depth, unit in enumerate(UNITS):
            # the ends of siblings are places too, so that hours between two split nodes are in none of them
            starts = sorted({start for _, nodes in open_nodes for _, start in nodes})
            counted = sums(table, starts)
            by_start = {s: counted.get(i, (0, None))[0] for i, s in enumerate(starts)}
            split = []
            for above, nodes in open_nodes:
                for first, last, start, n, over in joined([(label, s, by_start[s]) for label, s in nodes[:-1]], limit):
                    if over and unit != "h":
                        split.append((f"{above}{first}/", children(np.datetime64(start, "h"), UNITS[depth + 1])))
                    elif n:
                        found.append(Leaf(f"{above}{first}-{last}", start, n))
            open_nodes = split
            if not open_nodes:
                break
    found.sort(key=lambda leaf: leaf.start)
    return found + ([Leaf(NULL, None, ends["none"])] if ends["none"] else [])


def carrier(column: Column, kind: T.DataType) -> Column:
    """What a column travels to the writer as: times as whole numbers, all else as it is."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(column, kind)
    return F.unix_date(column) if isinstance(kind, T.DateType) else column


def file_schema(kinds: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds])


def block_schema(schema: pa.Schema) -> pa.Schema:
    """Of the blocks that rows travel in: moment, hash and mark before the columns."""
    own = [("m", pa.int64()), ("h", pa.int64()), ("mark", pa.bool_())]
    return pa.schema([*own, *[(f"c{i}", f.type) for i, f in enumerate(schema)]])


def arrow_column(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        return column.view(kind)
    return column if column.type == kind else column.cast(kind)


def buckets_of(rank: pa.Array, moment: pa.Array, cuts: Cuts) -> np.ndarray:
    """The bucket of each row, by its row number if it has one (0: none), else by its moment."""
    ranks, at = rank.to_numpy(), moment.fill_null(0).to_numpy()
    out = np.full(len(ranks), cuts.none, dtype=np.int64)
    timed = moment.is_valid().to_numpy(zero_copy_only=False) & (ranks == 0)
    if len(cuts.moments):
        out[timed] = cuts.by_moment[np.searchsorted(cuts.moments, at[timed], "right") - 1]
    if len(cuts.ranks):
        numbered_rows = ranks > 0
        out[numbered_rows] = cuts.by_rank[np.searchsorted(cuts.ranks, ranks[numbered_rows], "right") - 1]
    return out


def deal(batches: Iterator[pa.RecordBatch], cuts: Cuts, schema: pa.Schema) -> Iterator[tuple[int, int, bytes]]:
    """(file, bucket, block) of rows (rank, m, h, mark, columns); rows of files that stay are left out."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bucket = buckets_of(rows.column(0), rows.column(1), cuts)
        (todo,) = np.nonzero(cuts.file[bucket] >= 0)
        order = todo[np.argsort(bucket[todo], kind="stable")]
        if not len(order):
            return
        dealt = rows.take(pa.array(order))
        block = pa.record_batch([arrow_column(c, f.type) for c, f in zip(dealt.columns[1:], schema, strict=True)], schema=schema)
        each, first = np.unique(bucket[order], return_index=True)
        for b, start, end in zip(each.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            yield int(cuts.file[b]), b, block.slice(start, end - start).serialize().to_pybytes()

    held, n, size = [], 0, 0
    for batch in parts(batches, DEAL_ROWS):
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= DEAL_ROWS or size >= DEAL_BYTES:
            yield from cut(held)
            held, n, size = [], 0, 0
    if n:
        yield from cut(held)


def handed(blocks: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The blocks as rows of Arrow batches of about HAND_BYTES."""
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["file", "bucket", "block"])

    for file, bucket, block in blocks:
        rows.append((file, bucket, block))
        size += len(block)
        if size >= HAND_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def stream_file(items: Iterator, folder: str, names: list[str], schema: pa.Schema, ident: int, order: list[int]) -> Iterator[tuple]:
    """One file of ((file number, bucket), block) in order, streamed; gives (file number, path, rows, marked rows, SHA-256 of the ids)."""
    first = next(items, None)
    if first is None:
        return
    number, carried = first[0][0], block_schema(schema)
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    path = f"{root}/{names[number]}"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.writing"
    digest, n, marked = hashlib.sha256(), 0, 0
    by = [(c, "ascending") for c in ("m", *[f"c{i}" for i in order], "h")]

    def all_items() -> Iterator:
        yield first
        yield from items

    with fs.open_output_stream(own) as sink, pq.ParquetWriter(sink, schema) as writer:
        for _, blocks in groupby(all_items(), key=lambda item: item[0]):
            table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(block), carried) for _, block in blocks])
            table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start"))
            ids = pa.concat_arrays(table.column(3 + ident).chunks)
            ids = ids.view(f"int{ids.type.bit_width}") if pa.types.is_timestamp(ids.type) or pa.types.is_date(ids.type) else ids
            digest.update(((b"," if n else b"") + ",".join("" if v is None else str(v) for v in ids.to_pylist()).encode()))
            n, marked = n + table.num_rows, marked + (pc.sum(table.column("mark")).as_py() or 0)
            writer.write_table(pa.Table.from_arrays(table.columns[3:], schema=schema), row_group_size=GROUP)
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(path)  # of an earlier attempt, with the same rows
    fs.move(own, path)
    yield number, path, n, marked, digest.hexdigest()


def write_layout(rows: DataFrame, moment: Column, order: list[str], ident: str, limit: int, folder: str, there: list[File] | None = None, mark: Column | None = None) -> list[File]:
    """The files of rows under folder, a URI; those of ``there``, the files of an earlier call, that recur stay, others go.

    moment is in microseconds since 1970; mark counts rows of files that are written.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    kinds, there = rows.schema, there or []
    if len(set(rows.columns)) < len(rows.columns):
        raise ValueError("two columns have the same name")
    whole = F.xxhash64(*[F.to_json(rows[f.name]) if isinstance(f.dataType, T.MapType) else rows[f.name] for f in kinds])
    keyed = rows.select(
        moment.cast("long").alias("m"), whole.alias("h"), (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("mark"),
        sum((width(rows[f.name], f.dataType) for f in kinds), F.lit(0)).alias("b"), *[carrier(rows[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(kinds)],
    )
    table = hour_counts(keyed)
    found = leaves(table, limit)
    size = table.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    step = max(1, min(limit, BUCKET_ROWS, BUCKET_BYTES * (size["n"] or 0) // max(1, size["b"] or 0)))
    fine = found if step == limit else leaves(table, step)
    files = [File(leaf.name, part + 1, min(limit, leaf.rows - part * limit), Decimal(0)) for leaf in found for part in range(-(-leaf.rows // limit))]
    number_of = {f.leaf: number for number, f in reversed(list(enumerate(files)))}  # of a leaf's first file

    # hours above a bucket (None: rows without a moment) have their rows numbered; at: the first row number of each
    crowded = sorted((leaf for leaf in fine if leaf.rows > step), key=lambda leaf: (leaf.start is not None, leaf.start))
    at, behind = {}, 1
    for leaf in crowded:
        at[leaf.start] = behind
        behind += leaf.rows
    timed = [leaf for leaf in found if leaf.start is not None]
    begin = [leaf.start for leaf in timed]
    cuts = {(number_of[leaf.name], leaf.start, 0) for leaf in timed if leaf.rows <= limit}  # (file, hour, row number) where a bucket begins
    for leaf in fine:
        if leaf.start is None:
            first, above = number_of[NULL], leaf.rows
        elif place := bisect_right(begin, leaf.start):
            first, above = number_of[timed[place - 1].name], timed[place - 1].rows
        else:
            continue  # empty hours before the first leaf, which a run of siblings begins with
        if leaf.start not in at:
            cuts.add((first, leaf.start, 0))
            continue
        for part in range(-(-leaf.rows // limit) if above > limit else 1):
            cuts |= {(first + part, leaf.start, at[leaf.start] + row) for row in range(part * limit, min(leaf.rows, (part + 1) * limit), step)}
    cuts = sorted(cuts, key=lambda c: (c[0], c[1] is not None, c[1], c[2]))

    starts = sorted({*begin, *[leaf.start + 1 for leaf in timed if leaf.rows > limit]})  # hours behind a crowded leaf are not its own
    checks = sums(table, starts) if starts else {}
    by_start = {s: checks.get(i, (0, Decimal(0)))[1] for i, s in enumerate(starts)}
    check_of = {leaf.name: by_start[leaf.start] for leaf in timed if leaf.rows <= limit}
    if found and found[-1].start is None and found[-1].rows <= limit:
        check_of[NULL] = table.where("hour is null").first()["h"]
    files = [replace(f, check=check_of.get(f.leaf, f.check)) for f in files]

    hour = F.expr(f"(m - pmod(m, {HOUR}L)) div {HOUR}L")
    in_crowd = F.lit(False)
    if crowded:
        hours_over = [h for h in at if h is not None]
        in_crowd = F.coalesce(hour.isin(hours_over) if hours_over else F.lit(False), F.lit(False)) | (F.col("m").isNull() if None in at else F.lit(False))
        by_hour = keyed.where(in_crowd).drop("b").withColumn("hour", hour).withColumn("tie", F.monotonically_increasing_id())
        across = numbered(by_hour, [F.asc(c) for c in ("hour", "m", *[f"c{rows.columns.index(c)}" for c in order], "h", "tie")], "rank", "long")
        across = stored(across.drop("hour", "tie"), "crowded-rows")
        parted = {at[leaf.start] + part * limit: number_of[leaf.name] + part for leaf in found if leaf.rows > limit for part in range(-(-leaf.rows // limit))}
        edges = sorted({*parted, *at.values()})
        place = F.col("rank").alias("hour")
        per = sums(across.select(place, F.lit(1).cast("long").alias("n"), F.col("h").cast("decimal(38,0)").alias("h")), edges)
        for i, edge in enumerate(edges):
            if edge in parted:
                files[parted[edge]] = replace(files[parted[edge]], check=per[i][1])

    stay = {(f.leaf, f.part, f.rows, f.check): f for f in there}
    kept = {i: replace(stay[k], written=False, marked=0) for i, f in enumerate(files) if (k := (f.leaf, f.part, f.rows, f.check)) in stay}
    version = 1 + max((int(f.path.rpartition(".v")[2].partition(".")[0]) for f in there), default=0)
    names = [f"{f.leaf}/part-{f.part:05d}.v{version}.parquet" for f in files]
    todo = {number: dense for dense, number in enumerate(i for i in range(len(files)) if i not in kept)}
    if todo:
        schema, where, by = file_schema(kinds), rows.columns.index(ident), [rows.columns.index(c) for c in order]
        columns = [F.col("m"), F.col("h"), F.col("mark"), *[F.col(f"c{i}") for i in range(len(kinds))]]
        all_rows = keyed.where(~in_crowd).select(F.lit(0).cast("long").alias("rank"), *columns)
        if crowded:
            all_rows = all_rows.unionByName(across.select("rank", *columns))
        by_rank = sorted((rank, bucket) for bucket, (_, _, rank) in enumerate(cuts) if rank)
        by_moment = sorted((max(h * HOUR, LOWEST), bucket) for bucket, (_, h, rank) in enumerate(cuts) if h is not None and not rank)
        without = next((bucket for bucket, (_, h, rank) in enumerate(cuts) if h is None and not rank), 0)
        whole_numbers = lambda x: np.array(list(x), dtype=np.int64)
        lookup = Cuts(
            whole_numbers(r for r, _ in by_rank), whole_numbers(b for _, b in by_rank), whole_numbers(m for m, _ in by_moment), whole_numbers(b for _, b in by_moment),
            without, whole_numbers(number if number in todo else -1 for number, _, _ in cuts),
        )
        blocks = all_rows.mapInArrow(lambda batches: handed(deal(batches, lookup, block_schema(schema))), "file int, bucket long, block binary")
        laid = blocks.rdd.map(lambda r: ((r[0], r[1]), r[2])).repartitionAndSortWithinPartitions(len(todo), lambda k: todo[k[0]])
        for number, path, n, marked, digest in laid.mapPartitions(lambda items: stream_file(items, folder, names, schema, where, by)).collect():
            if n != files[number].rows:
                raise ValueError(f"{path} has {n} rows, {files[number].rows} were counted: the rows changed between two reads")
            kept[number] = replace(files[number], path=path, digest=digest, marked=marked, written=True)
    if len(kept) < len(files):
        raise ValueError("a file has no rows: the rows changed between two reads")
    out = [kept[i] for i in range(len(files))]
    sweep(folder, {f.path for f in out})
    return sorted(out, key=lambda f: (f.leaf, f.part))


def sweep(folder: str, named: set[str]) -> None:
    """Removes all files under folder but those named: what a layout no longer has, and what lost tasks left."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.type == pyarrow.fs.FileType.File and info.path not in named:
            fs.delete_file(info.path)


def click_moment(clicks: DataFrame) -> Column:
    """The contract's moment: by k, a hash of the id, years ago, or at the start of its week; a null id leaves ts as it is."""
    k = F.crc32(clicks["click_id"].cast("string")) % 128
    at = micros(clicks["ts"], clicks.schema["ts"].dataType)
    monday = floor_to(at + 3 * DAY, 7 * DAY) - 3 * DAY  # 1970 began on a Thursday
    return F.when(k < 16, at - (k + 6) * (k + 6) * (k + 6) * DAY).when(k > 111, monday).otherwise(at)


RESULT = "leaf string, part long, columns string, ids_sha256 string, path string, n_rows long, n_new long, rewritten boolean"


def partition_clicks(clicks: DataFrame, share: int = 500, late: str = "2024-05-01 00:00:00") -> DataFrame:
    """The contract's result: a layout of what arrived before ``late``, rewritten for all rows; a row per final file."""
    spark = clicks.sparkSession
    folder = f"{shared_dir(spark)}/clicks-{uuid.uuid4().hex}"
    limit = 1 + clicks.count() // share
    kind = clicks.schema["arrived_at"].dataType
    early = F.coalesce(clicks["arrived_at"] < F.lit(late).cast(kind), F.lit(False))
    how = {"order": ["arrived_at", "click_id"], "ident": "click_id", "limit": limit, "folder": folder}
    begun = clicks.where(early)
    files = write_layout(begun, click_moment(begun), **how)
    files = write_layout(clicks, click_moment(clicks), **how, there=files, mark=~early)
    names = ",".join(clicks.columns)
    return spark.createDataFrame([(f.leaf, f.part, names, f.digest, f.path, f.rows, f.marked, f.written) for f in files], RESULT)
