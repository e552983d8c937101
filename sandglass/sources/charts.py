"""Charts pulled from the network: a ranked list of ids, and lookups of them in batches.

Two data sources plan the requests. ``chart`` is one request and gives (rank, id). ``lookups`` deals the ids out in batches, a partition each, which
tasks request side by side but never faster than all together may: the plan gives every batch the time from which it may be sent. Both
go through the snapshot cache (see http), with its retries; a request without a body ends the job, as a chart is whole or not at all.

Options: url (of lookups with {ids}), cache, fetcher (module:function, url -> status, body), refresh; of lookups also ids (JSON), size (100), rate
(seconds between requests).
"""

from __future__ import annotations

import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import variants
from ..functions.shipping import ship
from .http import fetch_cached

SIZE, RATE = 100, 0.5


class Requests(DataSourceReader):
    def __init__(self, options):
        self.url, self.cache, self.fetcher = options["url"], options["cache"], options.get("fetcher", "")
        self.refresh = options.get("refresh", "false") == "true"
        self.options = dict(options)

    def body(self, url: str) -> str:
        module, _, name = self.fetcher.partition(":")
        get = getattr(importlib.import_module(module), name) if module else None
        status, body, error = fetch_cached(url, self.cache, get, refresh=self.refresh)
        if body is None:
            raise RuntimeError(f"{url} gave no body: {error or status}")
        return body


class ChartReader(Requests):
    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        told = json.loads(self.body(self.url))
        if "resultIds" not in told:
            raise ValueError(f"{self.url} is no chart: it has no resultIds")
        yield from enumerate(map(int, told["resultIds"]), 1)


class Batch(InputPartition):
    def __init__(self, number: int, ids: list[int], at: float):
        self.number, self.ids, self.at = number, ids, at


class LookupReader(Requests):
    def partitions(self):
        ids, size = json.loads(self.options.get("ids", "[]")), int(self.options.get("size", SIZE))
        rate, now = float(self.options.get("rate", RATE)), time.time()
        return [Batch(n, ids[i : i + size], now + n * rate) for n, i in enumerate(range(0, len(ids), size))] or [Batch(0, [], now)]

    def read(self, partition):
        if partition.ids:
            time.sleep(max(0.0, partition.at - time.time()))
            url = self.url.replace("{ids}", ",".join(map(str, partition.ids)))
            yield partition.number, url, self.body(url)


class ChartSource(DataSource):
    @classmethod
    def name(cls):
        return "chart"

    def schema(self):
        return "rank int, id long"

    def reader(self, schema):
        return ChartReader(self.options)


class LookupSource(DataSource):
    @classmethod
    def name(cls):
        return "lookups"

    def schema(self):
        return "batch int, url string, response string"

    def reader(self, schema):
        return LookupReader(self.options)


def typed(results: DataFrame) -> DataFrame:
    """(id, x) of results(place, item variant): podcasts and tracks, the result with the largest place of each id."""
    item = F.col("item")
    names = ("collectionName", "artistName", "feedUrl", "primaryGenreName", "country", "releaseDate", "collectionViewUrl", "artworkUrl600")
    x = F.struct(*[variants.text(item, f"$.{n}").alias(n) for n in names], F.try_variant_get(item, "$.trackCount", "int").alias("trackCount"), variants.strings(item, "$.genres").alias("genres"))
    wanted = (variants.text(item, "$.kind", "") == "podcast") | (variants.text(item, "$.wrapperType", "") == "track")
    rows = results.where(wanted).select(F.try_variant_get(item, "$.collectionId", "bigint").alias("id"), x.alias("x"), "place")
    return rows.groupBy("id").agg(F.max_by("x", "place").alias("x"))


def merged(responses: DataFrame) -> DataFrame:
    """(id, x) of responses(batch, response): results of later batches and places win."""
    items = variants.elements(F.parse_json("response"), "$.results")
    return typed(responses.select("batch", F.posexplode(items).alias("q", "item")).select(F.struct("batch", "q").alias("place"), "item"))


def pull(spark: SparkSession, chart_url: str, lookup_url: str, cache: str, fetcher: str = "", rate: float = RATE, size: int = SIZE, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ids(rank, id), found(id, x)) of a chart. A chart has some hundred ids, which go to the driver to be dealt out in batches."""
    ship(spark)
    for source in (ChartSource, LookupSource):
        spark.dataSource.register(source)
    options = {"cache": cache, "fetcher": fetcher, "refresh": str(refresh).lower()}
    ranked = [tuple(r) for r in spark.read.format("chart").options(url=chart_url, **options).load().collect()]
    ids = json.dumps([i for _, i in sorted(ranked)])
    found = merged(spark.read.format("lookups").options(url=lookup_url, ids=ids, rate=str(rate), size=str(size), **options).load())
    return spark.createDataFrame(ranked, "rank int, id long"), found
