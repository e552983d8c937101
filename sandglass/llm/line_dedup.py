"""Line dedup (operator 9): a suffix array over line-ID sequences by distributed prefix doubling. DataFrame functions only.

Texts are split at newlines and a line's ID is its MD5. Suffixes (one per line) are ranked by their first h lines, for
doubling h: the rank of 2h lines orders the pairs (rank of h lines here, rank of h lines h further on). Suffixes whose
prefix stands nowhere else leave the array, as they have no neighbour with so long a common prefix; doubling ends when none is
left, or when the longest length that is asked for (see below) is reached. Equal ranks are the intervals of a longest common prefix of h
lines or more; for a length L between h and 2h, those of the pair (rank of h lines from the first line, rank of h lines up
to the last). In each interval the first place stays whole, and the lines of all later places are deleted, but for lines
that belong to the first place too where a run overlaps itself.

Two kinds of runs count: ``min_lines`` lines or more of which the first has a word, and single lines of at least ``min_words``
words. Places are ordered by (doc_id, line), ids that are null last. A run that goes on over a further line with a word has an
interval of ``min_lines`` lines that ends there too. So the lengths to look up are ``min_lines`` and, from each line with a
word, those that reach over blank lines up to the next line with a word: together they delete all lines of all repeated runs.

Ranks come from range-partitioned distinct pairs numbered within their partition plus the partitions before it, so no
task sorts everything. Frequent lines and runs are pre-aggregated, intervals are reduced to their first place, and members of
crowded intervals meet it apart from the others (``spread_join``); nothing is gathered.

Defined cases: a null text has no lines; an empty one has a single empty line; blank lines take part in runs but start
none; rows with equal doc_id and equal text are one place, so repeated rows lose the same lines;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread_join, stored

MIN_LINES = 2
MIN_WORDS = 50
_BLANK = r"[ \t-\r]+"


def doc_key() -> Column:
    """Names a row by its id and text, null ids too."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, pos, id, words): a row per line; doc names the row together with doc_id. Repeated rows are folded."""
    rows = docs.select(F.col("doc_id").cast("long"), doc_key().alias("doc"), "text")
    twins = stored(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "repeated-rows")
    if not twins.isEmpty():
        one = rows.join(twins, "doc", "left_semi").groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        rows = rows.join(twins, "doc", "left_anti").unionByName(one)
    line = F.col("line")
    bare = F.regexp_replace(line, "^" + _BLANK, "")
    words = F.when(bare == "", 0).otherwise(F.length(F.regexp_replace(bare, r"[^ \t-\r]++[ \t-\r]*+", "x")))
    lines = rows.select("doc_id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "doc", "pos", F.unhex(F.md5("line")).alias("id"), words.cast("int").alias("words"))


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys (distinct rows of ``by``, each with n) and their place in the order of ``by`` as longer, from 0; no single-task sort."""
    parts = stored(keys.repartitionByRange(*by).select(*by, "n", F.spark_partition_id().alias("part")), "ranges")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row per partition
    base = sizes.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = parts.withColumn("in", F.row_number().over(W.partitionBy("part").orderBy(*by)) - 1)
    return stored(inside.join(F.broadcast(base), "part").select(*by, "n", (F.col("in") + F.col("base")).cast("long").alias("longer")), "ranks")


def reranked(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """The suffixes of rows (stored) whose ``by`` stands twice or more, ranked by it; stored, with their number."""
    keys = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = spread_join(rows, ranked(keys, by), by, "n", rows.count())
    array = stored(found.select("doc_id", "doc", "pos", "words", F.col("longer").alias("rank")), "suffixes")
    return array, array.count()


def doubled(array: DataFrame, shift: int) -> tuple[DataFrame, int]:
    """The array by ``shift`` more lines: suffixes whose longer prefix stands twice or more, ranked by it."""
    ahead = W.partitionBy("doc").orderBy("pos").rangeBetween(shift, shift)
    pairs = array.withColumn("next", F.max("rank").over(ahead)).where("next is not null")
    return reranked(stored(pairs, "pairs"), ["rank", "next"])


def suffix_array(lines: DataFrame, most: int | None = None) -> list[DataFrame]:
    """(doc_id, doc, pos, words, rank) for prefixes of 1, 2, 4, ... lines, up to ``most`` if given: the suffixes whose prefix stands twice or more."""
    levels: list[DataFrame] = []
    array, n = reranked(lines, ["id"])
    while n:
        levels.append(array)
        if most is not None and 1 << len(levels) > most:
            break
        array, n = doubled(array, 1 << (len(levels) - 1))
    return levels


def later_places(array: DataFrame, by: list[str]) -> DataFrame:
    """Members of each interval but its first place, with that as ``first``; array is stored."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("doc"), F.col("pos"))
    first = array.groupBy(*by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread_join(array, stored(first, "first-places"), by, "n", array.count()).where(place != F.col("first"))


def lines_of(places: DataFrame, length: int) -> DataFrame:
    """(doc, pos) of the lines of later places of ``length`` lines that are not lines of their first place."""
    start = F.when(F.col("first.doc") == F.col("doc"), F.greatest("pos", F.col("first.pos") + length)).otherwise(F.col("pos"))
    return places.select("doc", F.explode(F.sequence(start, F.col("pos") + (length - 1))).alias("pos"))


def lengths_over_blanks(docs: DataFrame, lines: DataFrame, min_lines: int) -> DataFrame:
    """Stored (doc, pos, length) over ``min_lines`` long: from each line with a word over blank lines to the next line with one."""
    blank = r"\n[ \t-\r]*" + (r"\n" if min_lines > 1 else r"(\n|\z)")
    gaps = docs.where(F.col("text").rlike(blank)).select(doc_key().alias("doc")).distinct()
    before = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -(min_lines - 1))
    start = F.max(F.when(F.col("words") > 0, F.col("pos"))).over(before)
    asked = lines.join(gaps, "doc", "left_semi").select("doc", start.alias("pos"), (F.col("pos") - start + 1).alias("length"))
    return stored(asked.where(F.col("length") > min_lines), "lengths")


def through_blanks(asked: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """(doc, pos): last lines of repeated runs of the lengths asked for."""
    out = []
    for k, array in enumerate(levels):
        h = 1 << k
        part = asked.where((F.col("length") > h) & (F.col("length") <= 2 * h)).withColumn("at", F.col("pos") + F.col("length") - h)
        tail = array.select("doc", F.col("pos").alias("at"), F.col("rank").alias("tail"))
        runs = part.join(array, ["doc", "pos"]).join(tail, ["doc", "at"]).select("doc_id", "doc", "pos", "length", "rank", "tail")
        found = later_places(stored(runs, "runs"), ["length", "rank", "tail"])
        out.append(found.select("doc", (F.col("pos") + F.col("length") - 1).alias("pos")))
    return out


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(deleted(doc, pos), lines), both stored."""
    lines = stored(line_table(docs), "lines")
    asked = lengths_over_blanks(docs, lines, min_lines)
    longest = asked.agg(F.max("length")).first()[0] or 0
    levels = suffix_array(lines, max(min_lines, longest - 1))
    nothing = lines.select("doc", "pos").where("false")
    if not levels:
        return nothing, lines
    found = [lines_of(later_places(levels[0].where(F.col("words") >= min_words), ["rank"]), 1)]
    k = min_lines.bit_length() - 1  # min_lines is 2^k lines and a rest
    if k < len(levels):
        array = levels[k] if min_lines == 1 << k else doubled(levels[k], min_lines - (1 << k))[0]
        found.append(lines_of(later_places(array.where("words > 0"), ["rank"]), min_lines))
    found += through_blanks(asked, levels) if longest else []
    return stored(reduce(DataFrame.unionByName, found).distinct(), "deleted-lines"), lines


def dedup_digest(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed runs as first-last line numbers from 0, comma-joined."""
    gone, _ = deleted_lines(docs, min_lines, min_words)
    order = W.partitionBy("doc").orderBy("pos")
    runs = (
        gone.withColumn("run", F.col("pos") - F.row_number().over(order))
        .groupBy("doc", "run")
        .agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
        .groupBy("doc")
        .agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
        .select("doc", "n", F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["a"], r["b"])), ",").alias("removed"))
    )
    text = F.col("text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    rows = docs.select(F.col("doc_id").cast("long"), doc_key().alias("doc"), n_lines.cast("long").alias("n_lines"))
    return rows.join(runs, "doc", "left").select(
        "doc_id", "n_lines", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed")
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the deleted lines taken out of text; other columns as they were, whatever their names."""
    gone, lines = deleted_lines(docs, min_lines, min_words)
    touched = lines.join(gone.select("doc").distinct(), "doc", "left_semi").select("doc", "pos")
    marked = touched.join(gone.select("doc", "pos", F.lit(True).alias("gone")), ["doc", "pos"], "left")
    flag = F.struct("pos", F.coalesce("gone", F.lit(False)).alias("gone"))
    flags = marked.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(flag)), lambda x: x["gone"]).alias("flags"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_key().alias("doc")).join(flags, "doc", "left")
    text = F.col("row.text")
    cut = F.filter(F.arrays_zip(F.split(text, "\n", -1).alias("line"), F.col("flags").alias("gone")), lambda x: ~x["gone"])
    out = F.when(F.col("flags").isNull(), text).otherwise(F.array_join(F.transform(cut, lambda x: x["line"]), "\n"))
    return rows.select(*[out.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
