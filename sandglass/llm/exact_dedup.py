"""Exact dedup (operator 7): an extendible-hash index whose owner tasks chain collisions and compare bytes.

Keys are 64-bit hashes of the text's bytes. The directory maps leading bits of a key to a bucket: starting from one bucket, every
bucket with more distinct keys than ``capacity`` is split by its next bit, as deep as its keys ask for. Buckets are key ranges, so
the directory is the sorted list of their first keys, which stays within some entries a shuffle partition.

Copies are combined batch by batch before anything is shuffled: one row for each distinct text, with the ids that have it. These
rows go to the owner task of their bucket, which walks the chain of its key, compares bytes and says in which entry of the
chain the ids belong; entries (bucket, key, chain) with SHA-256, length, the id that stays and the group's size are the
index. Ids meet their entry by bucket, key and chain. So a group that holds a third of all rows reaches its owner as one
row for each batch that had it, and is never gathered.

Defined cases: null counts as the empty text, and both are one group; the largest doc_id stays, null ids counting
as smaller than all others (a group of null ids only has keep_id null and all its rows are kept in the digest); repeated rows are
members of their group each, and rows that share the largest doc_id are all kept in the digest, as they can't be told apart;
``keep_largest`` keeps exactly one row of each text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, ship, spread_join, stored, text_or_empty

CAPACITY = 256
#: The capacity grows with the number of keys, so that there are about so many buckets a shuffle partition and no more.
BUCKETS_A_TASK = 64
FIRST_BITS, MORE_BITS = 12, 4
INDEX = "bucket int, key long, chain int, text_sha256 string, length long, keep_id long, group_size long, n_rows long"


def grow(leaves: list[tuple[int, int]], histogram: dict[int, int], depth: int, capacity: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(finished, open) leaves (prefix, local depth), split by a histogram of the keys' leading ``depth`` bits.

    A leaf with more keys than capacity is split by its next bit; one that is still overfull at ``depth`` stays open.
    """
    names, before = sorted(histogram), [0]
    for p in names:
        before.append(before[-1] + histogram[p])
    done, still, todo = [], [], list(leaves)
    while todo:
        prefix, local = todo.pop()
        low, high = (bisect_left(names, (prefix + i) << (depth - local)) for i in (0, 1))
        if before[high] - before[low] <= capacity:
            done.append((prefix, local))
        elif local < depth:
            todo += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
        else:
            still.append((prefix, local))
    return done, still


def directory(keys: DataFrame, capacity: int) -> np.ndarray:
    """First keys (unsigned) of the buckets, ascending, for the distinct keys of keys(key).

    The driver gets counts of leading bits: 4096 at first, then 16 for each bucket that is still overfull.
    """
    lead = lambda bits: F.shiftrightunsigned("key", 64 - bits)
    leaves, still, depth = [], [(0, 0)], FIRST_BITS
    while still and depth <= 64:
        rows = keys
        if depth > FIRST_BITS:
            shown = [(p - (1 << 64) if p >> 63 else p,) for p, _ in still]
            rows = keys.join(F.broadcast(keys.sparkSession.createDataFrame(shown, "_open long")), lead(depth - MORE_BITS) == F.col("_open"), "left_semi")
        found = rows.groupBy(lead(depth).alias("lead")).agg(F.count(F.lit(1)).alias("n")).collect()
        done, still = grow(still, {r["lead"] % (1 << 64): r["n"] for r in found}, depth, capacity)
        leaves += [p << (64 - local) for p, local in done]
        depth += MORE_BITS
    leaves += [p << (64 - local) for p, local in still]
    return np.array(sorted(leaves), dtype=np.uint64)


def owned(docs: DataFrame, hash_of: Callable[[Column], Column], capacity: int) -> DataFrame:
    """(bucket, key, text, ids): each batch's distinct texts with the ids that have them, at their bucket's owner in order of key."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(hash_of(text_or_empty()).cast("long").alias("key"), text_or_empty().cast("binary").alias("text"), F.col("doc_id").cast("long"))
    keys = stored(rows.select("key").distinct(), "keys")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = max(capacity, keys.count() // (BUCKETS_A_TASK * tasks))
    starts = directory(keys, capacity)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = pa.Table.from_batches([batch]).group_by(["key", "text"]).aggregate([("doc_id", "list")])
                key = got.column("key").combine_chunks()
                bucket = np.searchsorted(starts, key.to_numpy().view(np.uint64), "right") - 1
                out = pa.table([pa.array(bucket.astype(np.int32)), key, got.column("text"), got.column("doc_id_list")], names=["bucket", "key", "text", "ids"])
                yield from out.combine_chunks().to_batches()
            del batch
            pa.default_memory_pool().release_unused()

    combined = rows.mapInArrow(combine, "bucket int, key long, text binary, ids array<long>")
    return combined.repartition("bucket").sortWithinPartitions("bucket", "key")


def build_index(docs: DataFrame, capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(index of INDEX rows, members(bucket, key, chain, ids)), both stored."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema("bucket int, key long, chain int").append(pa.field("ids", pa.list_(pa.int64()))).append(pa.field("entry", pa.string()))
        target = target.append(pa.field("numbers", pa.list_(pa.int64())))
        last, chain = None, []

        def entries():
            for i, (text, keep, size) in enumerate(chain):
                yield (*last, i, None, hashlib.sha256(text).hexdigest(), [len(text), keep, size])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for bucket, key, text, ids in zip(*(c.to_pylist() for c in part.columns)):
                    if (bucket, key) != last:
                        out += entries()
                        last, chain = (bucket, key), []
                    keep = max((i for i in ids if i is not None), default=None)
                    for i, entry in enumerate(chain):
                        if entry[0] == text:  # byte by byte
                            entry[1] = keep if entry[1] is None else entry[1] if keep is None else max(keep, entry[1])
                            entry[2] += len(ids)
                            break
                    else:
                        i = len(chain)
                        chain.append([text, keep, len(ids)])
                    out.append((bucket, key, i, ids, None, None))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
        out = list(entries())
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    told = owned(docs, hash_of, capacity).mapInArrow(own, "bucket int, key long, chain int, ids array<long>, entry string, numbers array<long>")
    told = stored(told, "hash-index")
    # an entry's rows are as many as the batches that had its text
    members = told.where("ids is not null").select("bucket", "key", "chain", "ids")
    rows = members.groupBy("bucket", "key", "chain").agg(F.count(F.lit(1)).alias("n_rows"))
    number = lambda i, name: F.col("numbers")[i].alias(name)
    index = told.where("ids is null").select("bucket", "key", "chain", F.col("entry").alias("text_sha256"), number(0, "length"), number(1, "keep_id"), number(2, "group_size"))
    return stored(index.join(rows, ["bucket", "key", "chain"]), "hash-entries"), members


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, looked up in the index."""
    index, members = build_index(docs, capacity, hash_of)
    found = spread_join(members, index, ["bucket", "key", "chain"], "n_rows")
    rows = found.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_largest(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of equal texts, columns as they were: one with the largest doc_id, null ids last."""
    groups = exact_groups(docs, **how).groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "exact-marks")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    tied = groups.where("kept and n > 1").select(F.col("text_sha256").alias("_tied"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(text_or_empty(), 256).alias("sha"))
    left = rows.join(gone, F.col("id").eqNullSafe(F.col("_gone")) & (F.col("sha") == F.col("_sha")), "left_anti")
    if tied.isEmpty():
        return left.select("row.*")
    single = left.join(tied, F.col("sha") == F.col("_tied"), "left_anti").select("row")
    first = left.join(tied, F.col("sha") == F.col("_tied"), "left_semi").groupBy("sha").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(first).select("row.*")
