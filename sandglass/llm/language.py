"""Language ID (operator 6): language-bitmask n-gram filters.

Each language's own letter trigrams (word borders count as a letter) go into a Bloom filter; the filters of all languages are
stored sliced: one table of bit masks, in which a slot has the bits of all languages that set it. ANDing the masks of a
trigram's slots returns every language that holds it, at once. Per language, the trigrams of a text that it holds are counted
and corrected for the filter's false-positive rate; the largest share decides.

A language holds every trigram that is at least ``OWN`` times as frequent in its learned texts as in those of the language where it
is most frequent, however many these are: passages in another language add nothing to it. The filters are fitted on a
bounded sample of labelled rows (``SAMPLE`` rows a language in the mean, chosen by hash, whole texts), which bounds what
reaches the driver; prediction reads every text whole. Rows whose crc32(doc_id) is divisible by ``FOLDS`` are never learned from.

Defined cases: a null text and one without letters is 'und' with score 0; ties go to the language that sorts first; a null
doc_id is not held out and not learned from; with no labelled row at all every text is 'und'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, ship, stored

FOLDS = 5
SAMPLE = 1500
OWN = 0.2
HASHES = 3
BITS_PER_GRAM = 16
_STEP = 1 << 20
_LETTER: list = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit codes of the trigrams with a letter in the middle, in steps of bounded size."""
    table = letter_table()
    text = text.lower()
    for at in range(0, max(len(text), 1), _STEP):
        part = np.frombuffer(text[max(0, at - 1) : at + _STEP + 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = table[part]
        code = np.where(letters, part, 32).astype(np.uint64)
        inner = slice(1 if at else 0, len(code) - (1 if at + _STEP < len(text) else 0))
        code = np.concatenate(([np.uint64(32)], code, [np.uint64(32)]))
        mid = np.arange(1, len(code) - 1)[inner][letters[inner]]
        yield (code[mid - 1] << np.uint64(42)) | (code[mid] << np.uint64(21)) | code[mid + 1]


def slots(codes: np.ndarray, mask: int, hashes: int = HASHES) -> list[np.ndarray]:
    x = codes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(i) * step) & np.uint64(mask)).astype(np.int64) for i in range(hashes)]


class Filters:
    """Bit-sliced Bloom filters of several languages."""

    def __init__(self, by_language: dict[str, np.ndarray], hashes: int = HASHES):
        self.languages = sorted(by_language)
        most = max([1, *(len(v) for v in by_language.values())])
        self.mask = (1 << (most * BITS_PER_GRAM - 1).bit_length()) - 1
        self.hashes = hashes
        self.table = np.zeros((max(1, -(-len(self.languages) // 8)), self.mask + 1), dtype=np.uint8)
        self.false_rate = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            for s in slots(by_language[name], self.mask, hashes):
                np.bitwise_or.at(self.table[k // 8], s, np.uint8(1 << k % 8))
            self.false_rate[k] = float(((self.table[k // 8] >> (k % 8)) & 1).mean()) ** hashes

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """(trigrams, of these held by each language)."""
        total, held = 0, np.zeros(len(self.table) * 8, dtype=np.int64)
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        for codes in grams(text):
            if len(codes):
                total += len(codes)
                where = slots(codes, self.mask, self.hashes)
                for b, row in enumerate(self.table):
                    m = row[where[0]]
                    for s in where[1:]:
                        m &= row[s]
                    held[8 * b : 8 * b + 8] += np.bincount(m, minlength=256) @ bits
        return total, held[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        total, held = self.counts(text)
        if not total:
            return "und", 0.0
        true = np.clip((held - total * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, total)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / total)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, own: float = OWN) -> Filters:
    """Filters from the labelled rows outside the held-out fold. What reaches the driver is the trigrams of the sample."""
    by: dict[str, list[int]] = {}
    for r in own_grams(docs, sample, own).collect():
        by.setdefault(r["lang"], []).append(r["code"])
    return Filters({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in by.items()})


def own_grams(docs: DataFrame, sample: int = SAMPLE, own: float = OWN) -> DataFrame:
    """(lang, code): the trigrams that each language holds."""
    ship(docs.sparkSession)
    usable = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out())
    # a stored table has a size that Spark knows: it is broadcast only below spark.sql.autoBroadcastJoinThreshold
    share = stored(usable.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share")), "language-shares")
    drawn = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))
    picked = usable.select("doc_id", "text", "lang").join(share, "lang").where(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema("lang string, code long, n long")
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).extend(np.unique(c, return_counts=True) for c in grams(text))
            for lang, found in by.items():
                codes = np.concatenate([c for c, _ in found])
                names, where = np.unique(codes, return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([k for _, k in found]), minlength=len(names)).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(names), pa.string()), pa.array(names.astype(np.int64)), pa.array(n)], schema=target)

    counts = stored(picked.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "trigram-counts")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("total")), "trigram-totals")
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    # a code's window has a row for each language at most
    return rates.withColumn("most", F.max("rate").over(W.partitionBy("code"))).where(F.col("rate") >= own * F.col("most")).select("lang", "code")


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the prediction sees the text alone."""
    filters = filters or fit(docs)
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(filters)  # of a size bounded by the sample's trigrams, BITS_PER_GRAM and the number of languages
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        model = sent.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                schema=target,
            )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, schema)
