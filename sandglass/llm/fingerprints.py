"""SimHash near-duplicates (operator 2) with pigeonring candidate filtering.

A fingerprint is cut into ``segments`` equal segments set in a ring. If two fingerprints differ in at most
``radius`` bits, some ring position starts a chain in which the first l segments differ in at most
l * radius / segments bits, for every l (the strong form of the pigeonhole principle on a ring). The longest
prefix of that chain with a budget under one bit must be equal, so it is the index key: with 16 segments
of 4 bits and radius 2 that is 7 segments (28 bits) at each of 16 positions. Candidates of a key are pruned by
the budgets of the longer chains and only then compared in all 64 bits.

A key that more than ``bucket`` fingerprints share is split by the same principle: its members agree in the key's segments, so
the differences lie in the others, which form a smaller ring with keys of its own. Splitting goes on until groups are small or
no segment can be asked to be equal; nothing is capped and every radius is exact.

Only fingerprints, never texts or document pairs, are shuffled. Copies collapse before candidates are made.

The pipeline's stage (``similar_documents``, ``keep_one``) asks for a similarity of 0.8 on shingles of five words. Equal prefixes
prune nothing at that distance (10 of 64 bits in the mean), so there a fingerprint has 256 bits, of which at most a fifth may
differ, and candidates come from ``KEYS`` keys of ``EACH`` min-wise shingles each; pigeonring chains and then all 256 bits decide.
Keys shared by many are linked through leads first; pairs that this leaves apart are then all compared, in pairs of blocks.

Defined cases: a null or wordless text has fingerprint zero and links like any other; rows are told apart by fingerprint, so
a doc_id that stands on several texts is in the component of each; a null doc_id never names a component unless all members
are null (then component_id is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, parts, ship, spread_join, stored, text_or_empty

SHINGLE = 3
RADIUS = 2
SEGMENTS = 16
BUCKET = 1024
#: Of the pipeline's stage: words of a shingle, share of equal bits, words of a fingerprint, min-wise keys and shingles of each.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4
KEYS = 8
EACH = 4
#: Members of a key compared in all pairs; those of a larger one are dealt out in parts of about so many, half of them leads.
NEAR_BUCKET = 256
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash of each 64-bit hash, for each turn."""
    x = (x ^ (x >> np.uint64(29))) * _ODD[turn]
    return x ^ (x >> np.uint64(32))


def sketch(text: str | None, shingle: int = SHINGLE, words: int = 1, keys: int = 0, each: int = EACH) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash of words * 64 bits over XXH64 (seed 42) of space-joined word shingles, repeats included; min-wise keys)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(words, np.uint64), np.empty(0, np.uint64)
    count = max(1, len(tokens) - shingle + 1)
    total = np.zeros(64 * words, dtype=np.int64)
    least = np.full(keys * each, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, count, 65536):
        part = tokens[at : at + 65536 + shingle - 1]
        n = max(1, len(part) - shingle + 1)
        runs = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.fromiter((digest(b" ".join(r), 42) for r in runs), dtype=np.uint64, count=n)
        for w in range(words):
            own = mixed(hashes, w) if w else hashes
            total[64 * w : 64 * w + 64] += np.unpackbits(own.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k in range(keys * each):
            least[k] = min(least[k], (hashes * _ODD[16 + k]).min())
    bits = (2 * total > count).astype(np.uint8)
    fp = np.packbits(bits, bitorder="little").view(np.uint64)
    joined = np.zeros(keys, np.uint64)
    for j in range(each):  # keys of one turn never meet those of another: their number is mixed in
        joined = (joined * np.uint64(31) + mixed(least[j::each] + np.arange(keys, dtype=np.uint64), 1)) * _ODD[9]
    return fp, joined


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a number."""
    return int(sketch(text, shingle)[0][0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema("doc_id long, fp long")
        for batch in parts(batches):
            fps = [signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], schema=target)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def free_prefix(segments: int, radius: int) -> int:
    """Segments at a chain's start whose budget is under one bit."""
    return (segments - 1) // radius if radius else segments


def ring_of(fixed: int, segments: int) -> list[int]:
    """Bit masks of the segments that ``fixed`` does not hold, in ring order."""
    bits = 64 // segments
    masks = [((1 << bits) - 1) << (i * bits) for i in range(segments)]
    return [m for m in masks if not m & fixed]


def chain(fixed: int, at: int, segments: int, length: int) -> int:
    """Mask of ``length`` segments of the ring of ``fixed`` from position ``at`` on."""
    ring, mask = ring_of(fixed, segments), 0
    for i in range(length):
        mask |= ring[(at + i) % len(ring)]
    return mask


def chain_holds(diff: np.ndarray, fixed: int, at: int, segments: int, radius: int) -> np.ndarray:
    """Whether the chain from position ``at`` of the ring of ``fixed`` stays within its proportional budgets, for all lengths."""
    size = len(ring_of(fixed, segments))
    ok = np.ones(diff.shape, dtype=bool)
    for length in range(free_prefix(size, radius), size):
        ok &= np.bitwise_count(diff & np.uint64(chain(fixed, at, segments, length))).astype(np.int64) * size <= length * radius
    return ok


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def links_in_bucket(values: np.ndarray, fixed: int, at: int, segments: int, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links between the distinct fingerprints of one key: at most len(values) - 1 pairs."""
    forest, out = Forest(len(values)), []
    for i in range(len(values) - 1):
        diff = values[i + 1 :] ^ values[i]
        near = np.flatnonzero(chain_holds(diff, fixed, at, segments, radius))
        for j in near[np.bitwise_count(diff[near]) <= radius]:
            if forest.join(i, i + 1 + int(j)):
                out.append((int(values[i].view(np.int64)), int(values[i + 1 + j].view(np.int64))))
    return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, columns) of runs of two rows or more with one key in sorted batches of longs; one run is held at a time."""
    held: list[np.ndarray] | None = None

    def cut(cols: list[np.ndarray], last: bool):
        n = len(cols[0])
        new = np.ones(n, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        full = len(starts) if last else len(starts) - 1
        for i in np.flatnonzero((ends - starts)[:full] > 1):
            a, b = starts[i], ends[i]
            yield tuple(int(c[a]) for c in cols[:keys]), [c[a:b] for c in cols[keys:]]
        return [c[starts[-1] :] for c in cols]

    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            held = yield from cut([np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols, False)
    if held:
        yield from cut(held, True)


RING = "fixed long, at int, key long, then long, fp long"


def ring_rows(open_rows: DataFrame, segments: int, radius: int) -> DataFrame:
    """RING rows: the keys of fingerprints that agree in the bits ``fixed``.

    ``then`` is what a key's members agree in, null if no segment beyond it need be equal, so that it can't be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(RING)
        for batch in batches:
            fixed, fps = (batch.column(i).to_numpy() for i in (0, 1))
            for f in np.unique(fixed):
                own, mask = fps[fixed == f], int(f) % (1 << 64)
                size = len(ring_of(mask, segments))
                prefix = free_prefix(size, radius)
                for at in range(size):
                    then = mask | chain(mask, at, segments, prefix)
                    cols = [np.full(len(own), f), np.full(len(own), at, np.int32), own & np.uint64(then).view(np.int64)]
                    deeper = pa.array([signed(then) if free_prefix(size - prefix, radius) > 0 else None] * len(own), pa.int64())
                    yield pa.record_batch([*(pa.array(c) for c in cols), deeper, pa.array(own)], schema=target)

    return open_rows.select("fixed", "fp").mapInArrow(run, RING)


def links(reps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links among the distinct fingerprints of reps(fp) that keep all of its connections."""
    ship(reps.sparkSession)
    names = ["fixed", "at", "key"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema("a long, b long")
        for (fixed, at, _), (fps,) in groups_of(batches, 3):
            found = links_in_bucket(fps.view(np.uint64), fixed % (1 << 64), at, segments, radius)
            if found:
                yield pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=target)

    open_rows, out = reps.select(F.lit(0).cast("long").alias("fixed"), "fp"), None
    while True:
        rows = ring_rows(open_rows, segments, radius)
        sizes = rows.where("then is not null").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        crowded = stored(sizes.where(F.col("n") > bucket).select(*names), "ring-crowded")
        done = crowded.isEmpty()
        whole = rows if done else rows.join(crowded, names, "left_anti")
        sorted_rows = whole.select(*names, "fp").repartition(*names).sortWithinPartitions(*names)
        found = sorted_rows.mapInArrow(compare, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if done:
            return out
        open_rows = stored(rows.join(crowded, names).select(F.col("then").alias("fixed"), "fp"), "ring-open")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges(a, b) but the roots; alternating star contraction.

    Each round every node points its neighbours at the smallest one, first the larger neighbours, then the
    smaller; minima are pre-aggregated and hubs joined apart, so none is gathered in one task. Each round is a stored table.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        pairs = both(now)
        low = stored(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lows")
        large = spread_join(pairs.where("v > u"), low, ["u"], "n").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-stars")
        low2 = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "lows")
        small = spread_join(large, low2, ["a"], "n")
        nxt = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stored(nxt.where("a <> b").distinct(), "edges")
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (got["n"], got["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (got["n"], got["h"])


def named(reps: DataFrame, found: DataFrame) -> DataFrame:
    """reps(fp, rep, n) with the smallest rep of each fingerprint's component as ``first``; stored."""
    tree = components(found)
    rooted = stored(reps.join(tree, reps["fp"] == tree["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members")), "names")
    return stored(spread_join(rooted, names, ["root"], "members").select("fp", "first", "n"), "named")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    classes = named(reps, links(reps.select("fp"), radius, segments, bucket))
    return spread_join(prints, classes, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def wide(column: pa.Array, words: int) -> np.ndarray:
    """A binary column of equal widths as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), words)


def near_wide(values: np.ndarray, one: np.ndarray, radius: int, first: int = 4) -> np.ndarray:
    """Which rows of values differ from one in at most ``radius`` bits: some chain of ``first`` segments must hold, then all bits count."""
    diff = values ^ one
    counts = np.bitwise_count(diff.view(np.uint16)).astype(np.int32)
    m = counts.shape[1]
    turned = np.concatenate([counts, counts[:, : first - 1]], axis=1)
    so_far, holds = np.zeros((len(values), m), np.int32), np.ones((len(values), m), bool)
    for length in range(1, first + 1):
        so_far = so_far + turned[:, length - 1 : length - 1 + m]
        holds &= so_far * m <= length * radius
    near = np.flatnonzero(holds.any(axis=1))
    return near[counts[near].sum(axis=1) <= radius]


def similar_in_bucket(leads: np.ndarray, rest: np.ndarray, radius: int) -> list[tuple[bytes, bytes]]:
    """Spanning links of one key: leads among themselves, the rest with leads, and what is near none of them among itself."""
    def spanning(values: np.ndarray) -> Forest:
        forest = Forest(len(values))
        for i in range(len(values) - 1):
            for j in near_wide(values[i + 1 :], values[i], radius):
                if forest.join(i, i + 1 + int(j)):
                    out.append((values[i].tobytes(), values[i + 1 + j].tobytes()))
        return forest

    out: list[tuple[bytes, bytes]] = []
    if not len(leads):
        leads, rest = rest, rest[:0]
    forest, loose = spanning(leads), []
    for k, value in enumerate(rest):
        met: dict[int, int] = {}
        for j in near_wide(leads, value, radius):
            met.setdefault(forest.root(int(j)), int(j))
        out += [(value.tobytes(), leads[j].tobytes()) for j in met.values()]
        if not met:
            loose.append(k)
    if len(loose) > 1:
        spanning(rest[loose])
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, rows of right) that differ in at most ``radius`` bits, of all pairs.

    Rows of left further from the middle of right than its furthest row and ``radius`` together are near none (triangle inequality).
    """
    distance = lambda a, b: sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.uint16) for w in range(a.shape[1]))
    bits = np.unpackbits(right.view(np.uint8), axis=1)
    middle = np.packbits(2 * bits.sum(axis=0) > len(right)).view(np.uint64)[None]
    close = np.flatnonzero(distance(left, middle)[:, 0] <= int(distance(right, middle).max()) + radius)
    for at in range(0, len(close), rows):
        i, j = np.nonzero(distance(left[close[at : at + rows]], right) <= radius)
        yield close[at + i], j


def open_links(rooted: DataFrame, words: int, radius: int, block: int) -> DataFrame:
    """(a, b) links that join what is not joined yet: all near pairs of rooted(key, fp, root) with one key and two roots, connections kept.

    Of a key's roots the one with most members needs no comparison within itself. The others' members, and its own, are dealt out in
    blocks of about ``block``; each block of others meets all blocks, a pair of blocks in a group, so no pair with two roots is left out.
    """
    counts = stored(rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")), "near-roots")
    keys = counts.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("top")).where("top.n < members")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    keys = keys.select("key", "members", F.col("top.root").alias("main"), blocks(F.col("members") - F.col("top.n")).alias("others"), blocks(F.col("top.n")).alias("mains"))
    placed = spread_join(rooted, stored(keys, "near-open"), ["key"], "members").withColumn("draw", F.xxhash64("key", "fp"))
    own = F.when(F.col("root") == F.col("main"), F.col("others") + F.pmod("draw", "mains")).otherwise(F.pmod("draw", "others")).cast("int")
    placed = placed.select("key", "fp", "root", "others", "mains", own.alias("own"))
    last = F.when(F.col("own") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    spread = placed.select("key", "fp", "root", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    grouped = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp", "root").groupBy("key", "low", "high")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        own = table["own"].to_numpy()
        fps, root = table["fp"].to_pylist(), table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        values = np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), words)
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        forest, out = Forest(len(fps)), []
        if len(left) and len(right):
            for i, j in near_pairs(values[left], values[right], radius):
                a, b = left[i], right[j]
                apart = np.flatnonzero(root[a] != root[b])
                out += [(fps[x], fps[y]) for x, y in zip(a[apart].tolist(), b[apart].tolist()) if forest.join(int(root[x]), int(root[y]))]
        return pa.table([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return grouped.applyInArrow(run, "a binary, b binary")


def similar_links(rows: DataFrame, words: int, radius: int, bucket: int = NEAR_BUCKET) -> DataFrame:
    """(a, b) links that keep all connections of the near fingerprints of rows(fp, keys) that share a key.

    The members of a key shared by more than ``bucket`` are first dealt out evenly in parts of half as many; about as many leads, drawn
    by hash, go to each part, so this is linear in the members and no task has more. Each key draws other leads, and members near
    no lead are compared within their part. What this leaves apart in such a key is then compared exactly, by ``open_links``: all
    pairs of members that no link connects so far, here or through other keys.
    """
    ship(rows.sparkSession)
    keyed = stored(rows.select("fp", F.explode("keys").alias("key")).distinct(), "near-keys")
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    cut = spread_join(keyed, sizes.withColumn("members", F.col("n")), ["key"], "members").withColumn("draw", F.pmod(F.xxhash64("key", "fp"), F.lit(1 << 30)))
    half = max(1, bucket // 2)
    shares = F.ceil(F.col("n") / F.lit(half)).cast("int")
    lead = (F.col("n") > bucket) & (F.col("draw") * F.col("n") < F.lit(half).cast("long") * F.lit(1 << 30))
    part = F.when(F.col("n") <= bucket, F.array(F.lit(0))).when(lead, F.sequence(F.lit(0), shares - 1)).otherwise(F.array((F.col("draw") % shares).cast("int")))
    dealt = cut.select("key", F.explode(part).alias("part"), lead.alias("lead"), "fp").repartition("key", "part").sortWithinPartitions("key", "part", F.desc("lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def told(pairs):
            return pa.record_batch([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

        def close():
            if len(held) < 2:
                return []
            values = np.frombuffer(b"".join(v for _, v in held), "<u8").reshape(len(held), words)
            leads = sum(x for x, _ in held)
            return similar_in_bucket(values[:leads], values[leads:], radius)

        for batch in batches:
            out = []
            for key, share, is_lead, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, share) != last:
                    out += close()
                    last, held = (key, share), []
                held.append((is_lead, fp))
            if out:
                yield told(out)
        yield told(close())

    found = stored(dealt.mapInArrow(run, "a binary, b binary"), "near-links")
    crowded = stored(sizes.where(F.col("n") > bucket), "near-crowded")
    if crowded.isEmpty():
        return found
    tree = components(found)
    members = spread_join(keyed, crowded, ["key"], "n")
    rooted = members.join(tree, members["fp"] == tree["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    rest = open_links(stored(rooted, "near-rooted"), words, radius, 2 * bucket)
    return tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)


def row_tag() -> Column:
    return F.unhex(F.md5(text_or_empty()))


def similar_documents(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, words: int = WORDS, keys: int = KEYS, each: int = EACH) -> DataFrame:
    """(doc_id, tag, first): each row (named by id and text) with the row that stands first in its group; stored.

    Rows are similar if their fingerprints agree in a share of ``similarity`` of their bits or more, and groups are what
    such links connect. ``first`` has the smallest doc_id, null ids last.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [sketch(t, shingle, words, keys, each) for t in batch.column(2).to_pylist()]
            prints = pa.array([f.astype("<u8").tobytes() for f, _ in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), prints, pa.array([k.view(np.int64).tolist() for _, k in found], pa.list_(pa.int64()))], names=["doc_id", "tag", "fp", "keys"])

    slim = docs.select(F.col("doc_id").cast("long"), row_tag().alias("tag"), "text")
    prints = stored(slim.mapInArrow(run, "doc_id long, tag binary, fp binary, keys array<long>"), "wide-prints")
    entries = prints.groupBy("fp", "doc_id", "tag").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "copies")
    reps = stored(entries.groupBy("fp").agg(F.min(place).alias("rep"), F.sum("copies").alias("n")), "wide-classes")
    found = similar_links(prints.select("fp", "keys"), words, int(round((1 - similarity) * 64 * words, 6)))
    return spread_join(prints.select("doc_id", "tag", "fp"), named(reps, found), ["fp"], "n").select("doc_id", "tag", "first")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of similar documents, columns as they were: the one with the smallest doc_id, null ids last.

    Rows are named by id and text, so a doc_id that goes in one group can stay in another; of repeated rows one stays.
    """
    marks = stored(similar_documents(docs, **how), "near-marks")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))
    gone = stored(marks.where(~stays).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct(), "near-gone")
    tied = stored(marks.where(stays & (F.col("first.copies") > 1)).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct(), "near-tied")
    named_rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), row_tag().alias("tag"))
    same = lambda other: F.col("id").eqNullSafe(other["_id"]) & (F.col("tag") == other["_tag"])
    left = named_rows.join(gone, same(gone), "left_anti")
    if tied.isEmpty():
        return left.select("row.*")
    single = left.join(tied, same(tied), "left_anti").select("row")
    first = left.join(tied, same(tied), "left_semi").groupBy("id", "tag").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(first).select("row.*")
