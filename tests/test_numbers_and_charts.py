"""Half-even rounding, quantiles by key, heterogeneous lookups and charts pulled from the network."""

import json
import random
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandglass.functions import scalars as X
from sandglass.functions import variants as V
from sandglass.operators import hours, sampling
from sandglass.operators.numbering import quantiles
from sandglass.plans import cli
from sandglass.sources import charts, readers

CALLS: list[str] = []
LOCK = threading.Lock()


def test_rounds_like_exact_arithmetic(spark):
    rng = random.Random(5)
    values = [0.125, 0.375, 2.675, 1.115, 1.005, 0.285, 25.25, -25.25, -0.04, 0.5, 1.5, 2.5, -2.5, 0.0, 1e300, 4.5e14 + 0.0625, 2.0**52 + 0.5, 9e15, 123456789.125, 5e-324, 0.049999999999999996, 0.95, 1e22]
    values += [rng.randrange(10**9) / 8 for _ in range(60_000)] + [rng.randrange(10**7) / 1000 for _ in range(60_000)] + [round(rng.uniform(-1e6, 1e6), 3) for _ in range(60_000)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-5, 16) for _ in range(60_000)]
    values += [v for v in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(15_000)) if v == v and abs(v) < 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = df.select("x", *[X.round_even(F.col("x"), d).alias(f"r{d}") for d in range(4)]).toPandas()  # four roundings of each, a million in all
    assert len(got) > 250_000
    for d in range(4):
        want = np.array([float(round(x, d)) for x in got["x"]])
        assert (got[f"r{d}"].to_numpy() == want).all()
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(X.round_even(F.col("x"), 2)).collect()
    assert str([r[0] for r in odd]) == "[nan, inf, None]"
    with pytest.raises(ValueError):
        X.round_even(F.col("x"), 8)


def test_quantiles_of_a_hot_key_and_of_null_keys(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.4 else rng.choice([None, *range(2, 30)]), rng.choice([None, *[float(i) for i in range(500)]])) for _ in range(6000)]
    got = {r["k"]: (r["q"], r["m"]) for r in quantiles(spark.createDataFrame(rows, "k int, x double").repartition(6), "x", {"q": 0.25, "m": 0.5}, ["k"]).collect()}
    by = {}
    for k, x in rows:
        if x is not None:
            by.setdefault(k, []).append(x)
    assert got == {k: pytest.approx((np.quantile(v, 0.25), np.quantile(v, 0.5))) for k, v in by.items()}
    plan = quantiles(spark.createDataFrame(rows, "k int, x double"), "x", {"m": 0.5}, ["k"])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "median" not in plan.lower()


def test_medians_of_shows_without_a_buffer_for_each(spark):
    from datetime import datetime

    eps = spark.createDataFrame([(1, "u", datetime(2026, 1, 1), 60.0 * i) for i in range(101)] + [(2, "u", datetime(2022, 1, 1), 60.0)], "show_id long, audio_url string, pub_date timestamp, duration_sec double")
    shows = spark.createDataFrame([(1,), (2,), (3,)], "show_id long")
    got = {(r["show_id"], r["window_months"]): (r["n_episodes"], r["median_ep_minutes"]) for r in hours.show_hours(shows, eps).collect()}
    assert got[1, 12] == (101, 50.0) and got[2, 12] == (0, 0.0) and got[3, 36] == (0, 0.0) and len(got) == 12
    told = {r["show_id"]: r["med_ep_min"] for r in sampling.per_show_summary(eps).collect()}
    assert told == {1: 50.0, 2: 1.0}


def test_variants_tell_strings_from_other_elements(spark):
    rows = [('{"g": ["a", 1, null, "2", true, {"x": 1}, ["b"], ""], "t": 5, "n": null}',), ('{"g": "text"}',), ("[1]",), ("no json",), (None,)]
    v = F.try_parse_json("j")
    got = spark.createDataFrame(rows, "j string").select(V.strings(v, "$.g").alias("g"), V.text(v, "$.t", "").alias("t"), V.text(v, "$.n", "").alias("n"), F.size(V.elements(v, "$.g")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(["a", "2", ""], "5", "", 8), ([], "", "", 0), ([], "", "", 0), ([], "", "", 0), ([], "", "", 0)]


def answers(url):
    """Stands for the network: a chart of 250 ids, lookups of them, one that fails at first."""
    with LOCK:
        CALLS.append(url)
    if url.startswith("http://c/chart"):
        return 200, json.dumps({"resultIds": list(range(1, 251)) if url.endswith("full") else []} if "broken" not in url else {})
    ids = [int(i) for i in url.partition("id=")[2].split("&")[0].split(",")]
    if 101 in ids and CALLS.count(url) == 1:
        return 500, None
    if 249 in ids and "gone" in url:
        return 404, None
    results = [{"kind": "podcast", "collectionId": i, "collectionName": f"old {i}", "genres": ["News", 7, None, "Politics"], "trackCount": i} for i in ids if i % 5]
    return 200, json.dumps({"results": [*results, {"wrapperType": "track", "collectionId": 7, "collectionName": f"from {min(ids)}"}, {"kind": "song", "collectionId": 9999}]})


def test_pulled_chart(spark, tmp_path, monkeypatch):
    from sandglass.sources import http

    monkeypatch.setattr(http.time, "sleep", lambda s: None)
    ids, found = charts.pull(spark, "http://c/chart-full", "http://l?id={ids}&entity=podcast", str(tmp_path / "cache"), "tests.test_numbers_and_charts:answers", rate=0.05)
    got = {r["collection_id"]: r for r in readers.frame(ids, found, "News", "Politics", "").collect()}
    assert len(got) == 250 and got[1]["genres"] == "News|Politics" and got[1]["rank"] == 1 and got[1]["publisher"] == "" and got[104]["track_count"] == 104
    assert not got[5]["lookup_found"] and got[5]["show_name"] == "" and got[7]["show_name"] == "from 201"  # the last batch wins
    ids, found = charts.pull(spark, "http://c/chart-none", "http://l?id={ids}", str(tmp_path / "cache"), "tests.test_numbers_and_charts:answers")
    assert ids.count() == 0 and found.count() == 0 and readers.frame(ids, found, "a", "b").count() == 0
    for chart, lookup in (("http://c/chart-broken", "http://l?id={ids}"), ("http://c/chart-full", "http://l/gone?id={ids}")):
        with pytest.raises(Exception):
            charts.pull(spark, chart, lookup, str(tmp_path / "cache2"), "tests.test_numbers_and_charts:answers", rate=0.0)[1].count()


def test_batches_are_paced_together():
    reader = charts.LookupReader({"url": "u", "cache": "c", "ids": json.dumps(list(range(250))), "rate": "2"})
    dealt = reader.partitions()
    assert [len(b.ids) for b in dealt] == [100, 100, 50] and [round(b.at - dealt[0].at) for b in dealt] == [0, 2, 4]


def test_run_pulls_its_frame_once(spark, tmp_path):
    argv = ["run", "--frame", f"{tmp_path}/frames", "--chart-date", "20260801", "--chart-url", "http://c/chart-none", "--lookup-url", "http://l?id={ids}", "--cache", f"{tmp_path}/cache", "--fetcher", "tests.test_numbers_and_charts:answers", "--out", f"{tmp_path}/out"]
    assert "| frame | 0 |" in cli.main(argv, spark) and readers.there(spark, f"{tmp_path}/frames/chart_date=20260801")
    assert not readers.there(spark, f"{tmp_path}/nothing")
    with pytest.raises(Exception):
        readers.there(spark, "unknown://x/y")
