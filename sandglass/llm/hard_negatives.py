"""Hard-negative mining (operator 12): a pivot table over vectors whose inner products became distances.

Scores are inner products of whole numbers. A further component sqrt(M^2 - |x|^2), with M the longest vector's length, puts all rows on a
sphere; an anchor is drawn out to the length M and gets 0 there. Its squared distance to a row is 2 * M^2 - 2 * score * M / |anchor|, so
near rows are those of high score. The table holds, beside each vector, its distances to a few pivots. By the triangle inequality d lies between
|d(anchor, pivot) - d(row, pivot)| and d(anchor, pivot) + d(row, pivot); the best of all pivots brackets the score. Rows whose
bracket can't matter are left out, all others are checked with the exact inner product.

Positives: the lowest ends of the brackets of same-label rows give a score that the five best reach; rows whose upper end is below it
are out. Negatives of a positive lie in a window of scores; rows whose bracket misses it are out, and so are those whose upper end is
below what three rows surely inside the window reach. Both thresholds come from a block's own rows, so what a block
gives is exact for the block, and the best of all blocks is exact for all rows.

Anchors are a stated share of all rows and meet all rows in blocks: both sides are dealt out in blocks of bounded size by a number
that Spark gives each row, so no label, vector or id is one task's, and a pair of blocks is one group. Pivots are chosen, far
apart from each other, among ``SAMPLE`` rows; all rows are in the table.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do those with a
component of 2^20 or more, whose scores could leave 63 bits; shorter vectors count as filled up with zeros; a null vec_id comes
last among ties and is no anchor; repeated rows are rows of their own (another row of the anchor's id is another row); an empty
table, no anchors or a single label give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, ship, stored

#: Pivots, rows from which they are chosen, rows of a block and anchors of a block.
PIVOTS, SAMPLE, BLOCK, ANCHORS = 8, 1024, 8192, 2048
LIMIT = float(1 << 20)
NO_ID = (1 << 63) - 1
POSITIVES, NEGATIVES = 5, 3


def whole_vectors(rows: DataFrame, label: Column, vector: str = "embedding") -> DataFrame:
    """(uid, id, label, vec array<long>) of the rows that take part, stored, so that uid stays."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LIMIT), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    kept = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), F.when(fine, whole).alias("vec"))
    kept = kept.where("label is not null and vec is not null").withColumn("uid", F.monotonically_increasing_id())
    return stored(kept.select("uid", "id", "label", "vec"), "whole-vectors")


def matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up to width with zeros."""
    arr = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(arr.offsets.to_numpy())
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def choose_pivots(vectors: DataFrame, width: int, reach: float, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to n augmented vectors far apart from each other, among the rows with the smallest hashes."""
    got = vectors.select("vec", F.xxhash64("uid").alias("h"), "uid").orderBy("h", "uid").limit(sample).select("vec").toArrow()
    points = augment(matrix(got["vec"], width), reach)
    chosen = points[:1]
    while 0 < len(chosen) < min(n, len(points)):
        apart = np.min([((points - c) ** 2).sum(1) for c in chosen], axis=0)
        if not apart.max():
            break
        chosen = np.vstack([chosen, points[apart.argmax()]])
    return chosen


def augment(vecs: np.ndarray, reach: float) -> np.ndarray:
    """The vectors with the component that makes all as long as reach, the root of which is taken."""
    own = vecs.astype(np.float64)
    return np.hstack([own, np.sqrt(np.maximum(reach - (own * own).sum(1), 0))[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(points, pivots) Euclidean distances of augmented vectors."""
    square = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def pivot_table(vectors: DataFrame, width: int, reach: float, pivots: np.ndarray) -> DataFrame:
    """vectors with their distances to the pivots, stored."""
    ship(vectors.sparkSession)

    def measure(batches):
        for b in parts(batches, 4096):
            far = distances(augment(matrix(b.column(3), width), reach), pivots)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.record_batch([*b.columns, listed], names=["uid", "id", "label", "vec", "far"])

    return stored(vectors.mapInArrow(measure, "uid long, id long, label long, vec array<long>, far array<double>"), "pivot-table")


def query_points(vecs: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Anchors drawn out to the sphere, and what a score is to be multiplied by there (0 for a vector without length)."""
    own = vecs.astype(np.float64)
    square = (own * own).sum(1)
    factor = np.sqrt(np.divide(reach, square, out=np.zeros(len(own)), where=square > 0))
    return np.hstack([own * factor[:, None], np.zeros((len(own), 1))]), factor


def brackets(own: np.ndarray, factor: float, table: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) ends of each row's score with an anchor that has the distances ``own`` to the pivots and was drawn out by ``factor``."""
    if not factor:
        return np.zeros(len(table)), np.zeros(len(table))
    near, far = np.abs(table - own).max(1), (table + own).min(1)
    slack = 1 + 1e-9 * reach / factor  # more than rounding can be
    return (2 * reach - far * far) / (2 * factor) - slack, (2 * reach - near * near) / (2 * factor) + slack


def exact(vecs: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; floating point where it is exact."""
    most = float(np.abs(vecs).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
    return (vecs.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64) if most < 2**53 else vecs @ anchor


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by id, then by row."""
    if len(scores) > n:
        keep = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
        return keep[np.lexsort((uids[keep], ids[keep], -scores[keep]))[:n]]
    return np.lexsort((uids, ids, -scores))


def nth(values: np.ndarray, n: int) -> float:
    return np.partition(values, -n)[-n] if len(values) >= n else -np.inf


def best_positives(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], reach: float) -> list[tuple[int, int, int, int]]:
    """(anchor uid, row uid, row id, score): a block's best rows of each anchor's label, the anchor left out."""
    out, of_label = [], {int(v): np.flatnonzero(rows["label"] == v) for v in np.unique(rows["label"])}
    for i, uid in enumerate(anchors["uid"]):
        at = of_label.get(int(anchors["label"][i]), np.empty(0, np.int64))
        at = at[rows["uid"][at] != uid]
        if len(at):
            low, high = brackets(anchors["far"][i], anchors["factor"][i], rows["far"][at], reach)
            at = at[high >= nth(low, POSITIVES)]
            score = exact(rows["vec"][at], anchors["vec"][i])
            for k in best(score, rows["id"][at], rows["uid"][at], POSITIVES):
                out.append((int(uid), int(rows["uid"][at[k]]), int(rows["id"][at[k]]), int(score[k])))
    return out


def best_negatives(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], reach: float) -> list[tuple[int, int, int, int, int]]:
    """(anchor uid, place of the positive, row uid, row id, score): a block's best rows in each positive's window."""
    out = []
    for i, uid in enumerate(anchors["uid"]):
        other = np.flatnonzero(rows["label"] != anchors["label"][i])
        windows = [(k, p) for k, p in enumerate(anchors["positives"][i]) if p >= 0]  # below 0 no score satisfies both ends
        if not len(other) or not windows:
            continue
        low, high = brackets(anchors["far"][i], anchors["factor"][i], rows["far"][other], reach)
        needed = np.zeros(len(other), bool)
        for _, p in windows:
            inside = (2 * low >= p) & (20 * high <= 19 * p)
            needed |= (2 * high >= p) & (20 * low <= 19 * p) & (high >= nth(low[inside], NEGATIVES))
        at = other[needed]
        score = exact(rows["vec"][at], anchors["vec"][i])
        for k, p in windows:
            fits = np.flatnonzero((2 * score >= p) & (20 * score <= 19 * p))
            for j in fits[best(score[fits], rows["id"][at[fits]], rows["uid"][at[fits]], NEGATIVES)]:
                out.append((int(uid), k, int(rows["uid"][at[j]]), int(rows["id"][at[j]]), int(score[j])))
    return out


def mine(vectors: DataFrame, is_anchor: Column, pivots: int = PIVOTS, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors as whole_vectors() gives them."""
    spark = vectors.sparkSession
    ship(spark)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"), F.count_if(is_anchor).alias("anchors"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("reach")).first()
    n, width, reach = size["n"], size["width"] or 0, float(size["reach"] or 0)
    chosen = choose_pivots(vectors, width, reach, pivots)
    table = pivot_table(vectors, width, reach, chosen)
    n_blocks, n_anchor_blocks = -(-max(n, 1) // block), -(-max(size["anchors"], 1) // anchor_block)
    deal = lambda seed, k: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = table.select("uid", "id", "label", "vec", "far", deal(1, n_blocks).alias("b")).select("*", every(n_anchor_blocks).alias("a"))

    def columns(t: pa.Table, query: bool) -> dict[str, np.ndarray]:
        got = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("uid", "label")} | {"vec": matrix(t["vec"], width)}
        if query:
            points, factor = query_points(got["vec"], reach)
            got |= {"factor": factor, "far": distances(points, chosen)}
            return got | ({"positives": t["positives"].to_pylist()} if "positives" in t.column_names else {})
        return got | {"id": t["id"].combine_chunks().to_numpy(), "far": matrix_of_doubles(t["far"], chosen.shape[0])}

    def meet(anchors: DataFrame, work, schema: str, names: list[str]) -> DataFrame:
        def group(left: pa.Table, right: pa.Table) -> pa.Table:
            found = work(columns(left, True), columns(right, False), reach) if left.num_rows and right.num_rows else []
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * len(names))], names=names)

        dealt = anchors.select("*", deal(2, n_anchor_blocks).alias("a")).select("*", every(n_blocks).alias("b"))
        dealt = dealt.toDF(*dealt.columns)  # both sides come from one table: these columns are others
        return dealt.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInArrow(group, schema)

    by_score = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    asked = table.where(is_anchor).select("uid", "id", "label", "vec")
    found = meet(asked, best_positives, "uid long, row long, id long, score long", ["uid", "row", "id", "score"])
    ranked = found.withColumn("k", F.row_number().over(by_score("uid")) - 1).where(F.col("k") < POSITIVES)
    positives = stored(ranked.select("uid", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = positives.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    with_windows = asked.join(listed, "uid")
    names = ["uid", "k", "row", "id", "score"]
    found = meet(with_windows, best_negatives, "uid long, k long, row long, id long, score long", names)
    ranked = found.withColumn("rank", F.row_number().over(by_score("uid", "k"))).where(F.col("rank") <= NEGATIVES)
    told = ranked.join(positives, ["uid", "k"]).join(asked.select("uid", F.col("id").alias("anchor_id")), "uid")
    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return told.select(
        "anchor_id", shown("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), shown("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def matrix_of_doubles(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def hard_negatives(embeddings: DataFrame, **how) -> DataFrame:
    """The contract's rows: every 7th id's label is moved on by one, every 50th id is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    anchor = (F.col("id") % 50 == 0) & (F.col("id") != NO_ID)
    return mine(whole_vectors(embeddings, label), anchor, **how)
