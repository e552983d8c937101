"""Runs end to end: corpus build, budget, sample and download by command line; reports, queue files, transcripts, caches, name scores."""

import hashlib
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sandglass.functions import fuzzy
from sandglass.operators import hours, queue, sampling, transcripts
from sandglass.operators.numbering import numbered, quantiles, running
from sandglass.plans import cli, reports
from sandglass.sources import http, readers, schemas, sinks
from sandglass.streaming import producer, worker

CALLS = []


def fetch_feed(url):
    CALLS.append(url)
    item = '<item><title>t{0}</title><pubDate>Tue, 14 Jul 2026 18:31:0{0} GMT</pubDate><itunes:duration>10:00:00</itunes:duration><enclosure url="http://a/{1}{0}" length="9"/></item>'
    body = "<rss xmlns:itunes='http://x'><channel><language>en</language>" + "".join(item.format(i, url[-1]) for i in range(3)) + "</channel></rss>"
    return (404, None) if url.endswith("gone") else (200, body)


def get_audio(url):
    if url.endswith("404"):
        return 404, url, None, iter(())
    if url.endswith("cut"):
        def broken():
            yield b"half"
            raise OSError("connection lost")

        return 200, url + ".mp3", "audio/mpeg", broken()
    return 200, url + "/final", "audio/mp4; x=1", iter([b"au", b"", b"dio"])


def text_of(path):
    return "\n".join(open(os.path.join(path, n)).read() for n in sorted(os.listdir(path)) if n.startswith("part"))


def test_run_writes_everything(spark, tmp_path):
    rows = [(str(i), str(100 + i), f"Show {n}", "pub", f"http://f/{n}") for i, n in enumerate(["alpha", "beta", "gone"], 1)] + [("4", "104", "No Feed", "pub", "")]
    frame = spark.createDataFrame(rows, "rank string, collection_id string, show_name string, publisher string, feed_url string")
    for c in schemas.FRAME_COLUMNS:
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit(None).cast("string"))
    sinks.freeze(frame.select(*schemas.FRAME_COLUMNS), f"{tmp_path}/frames", "20260714")
    (tmp_path / "labels.csv").write_text("Show Name,Partisan Leaning\nThe Alpha Show,left\nBetta,right\nZulu,left\n")
    (tmp_path / "rules.json").write_text(json.dumps({"terms": [], "patterns": [], "exceptions": [], "manual": {}}))
    argv = ["run", "--frame", f"{tmp_path}/frames", "--chart-date", "20260714", "--cache", f"{tmp_path}/cache", "--fetcher", "tests.test_outputs:fetch_feed", "--out", f"{tmp_path}/out", "--labels-csv", f"{tmp_path}/labels.csv", "--rules-json", f"{tmp_path}/rules.json"]
    text = cli.main(argv, spark)
    assert "| frame | 4 | 100% |" in text and "| corpus | 2 | 50% |" in text and "| R1_no_feed_url | 1 | 50% |" in text and "| 60.0 | 30.0 | 30.0 | 30.0 | 30.0 | 30.0 |" in text and "| chart_date | 20260714 |" in text
    assert sorted(os.listdir(tmp_path / "out")) == ["corpus", "episodes", "exclusions", "lean_validation", "raw_chart", "run_manifest", "summary"]
    corpus = readers.corpus_csv(spark, f"{tmp_path}/out/corpus")
    assert [(r["rank"], r["collection_id"], r["hours_available"]) for r in corpus.orderBy("rank").collect()] == [(1, "101", 30.0), (2, "102", 30.0)]
    assert readers.episodes_csv(spark, f"{tmp_path}/out/episodes").count() == 6
    known = {r["collection_id"]: (r["label_name"], r["match_status"]) for r in spark.read.csv(f"{tmp_path}/out/lean_validation", header=True).collect()}
    assert known["101"] == ("The Alpha Show", "matched") and known["102"][0] in ("Betta", None)
    told = json.loads(text_of(tmp_path / "out/run_manifest"))
    assert told["corpus_size"] == 2 and told["labels_joined"] and told["exclusions_by_rule"]["R1_no_feed_url"] == 1
    with pytest.raises(FileNotFoundError):
        readers.corpus_csv(spark, f"{tmp_path}/none")


def test_budget_and_sample_by_command_line(spark, tmp_path):
    start = datetime(2026, 7, 1)
    rows = [(s, f"Show {s}", f"t{i}", "d", start - timedelta(days=7 * i), f"http://a/{s}/{i}", 1000, 3600.0 * s, "itunes:duration") for s in (1, 2, 3) for i in range(30)]
    sinks.csv(spark.createDataFrame(rows, schemas.EPISODES), f"{tmp_path}/eps", gzip=True)
    text = cli.main(["budget", "--episodes", f"{tmp_path}/eps", "--out", f"{tmp_path}/b", "--as-of", "2026-07-02", "--sample-h", "5"], spark)
    assert "| **hours a show** | 25 |" in text and "| shows at the floor | 3 (100%) |" in text and "| floor keeps enough | yes |" in text and "| hours in the sample | 75 |" in text
    assert sorted(os.listdir(tmp_path / "b")) == ["bottleneck_shows", "budget_manifest", "budget_summary", "duration_log", "sample_manifest", "show_hours", "survival"]
    assert json.loads(text_of(tmp_path / "b/budget_manifest"))["best_h"] == 30
    text = cli.main(["sample", "--episodes", f"{tmp_path}/eps", "--out", f"{tmp_path}/s", "--hours", "50", "--log", f"{tmp_path}/log"], spark)
    with pytest.raises(Exception):
        cli.main(["sample", "--episodes", f"{tmp_path}/none", "--out", f"{tmp_path}/s2", "--log", f"{tmp_path}/log"], spark)
    noted = sorted(r["value"].split(" ", 1) for r in spark.read.text(f"{tmp_path}/log").collect())
    assert sorted(x[1].split(":")[0] for x in noted) == ["sample begins", "sample begins", "sample ends", "sample failed"] and all(x[0].endswith("Z") for x in noted)
    assert "| hours | 50.0 |" in text and "| 50.0 | yes |" in text
    dropped = spark.read.csv(f"{tmp_path}/s/excluded_shows", header=True).collect()
    assert [(r["show"], r["reason"]) for r in dropped] == [("Show 1", "< 50h in window")]
    assert spark.read.csv(f"{tmp_path}/s/sample_manifest", header=True).columns[:4] == ["show_id", "show", "episode_id", "draw_order"]


def test_report_follows_the_figures(spark):
    rows = [(i, 24, 10, 3.0 if i < 6 else 60.0, 30.0, False) for i in range(10)]
    table = spark.createDataFrame([(i, w, n, h, m, t) for i, _, n, h, m, t in rows for w in hours.WINDOWS], "show_id long, window_months int, n_episodes long, total_hours double, median_ep_minutes double, feed_truncated boolean")
    log = spark.createDataFrame([(1, 3, 1)], "show_id long, duration_missing_or_unparseable long, duration_byte_estimated long")
    text = reports.budget_report(table, log)
    assert "| floor keeps enough | no |" in text and "| most hours that keep them | - |" in text and "| episodes left out for want of a duration | 3 |" in text
    assert "| lowest quarter | 6 | 30.0 | 10.0 |" in text and "| 0 | 3.0 |" in text and "| 50 | 4 | 4 | 4 | 4 | 200 |" in text
    assert "| 0 |" in reports.budget_report(table.where("false"), log)


def test_download_fills_the_queue(spark, tmp_path):
    q = tmp_path / "queue"
    q.mkdir()
    (q / "e9.mp3").write_bytes(b"x")
    rows = [("s1", "e1", "http://h/1", "One\ntitle"), ("s1", "e2", "http://h/404", "Two"), ("s2", "e3", "http://h/cut", "Three"), ("s2", "e4", "", "Four"), ("s3", "e9", "http://h/9", "Nine"), ("s3", "e5", "http://h/5", "a|||b")]
    manifest = spark.createDataFrame(rows, "show_id string, episode_id string, audio_url string, episode_title string")
    out = {r["episode_id"]: (r["outcome"], r["reason"]) for r in producer.dispatch(manifest, str(q), "tests.test_outputs:get_audio", done=[("s3", "e5")], delay=0.0, workers=2).collect()}
    assert out == {"e1": ("ok", ""), "e2": ("fail", "status 404"), "e3": ("fail", "audio broke off (connection lost)"), "e4": ("fail", "row without a url"), "e9": ("skip-queued", ""), "e5": ("skip-done", "")}
    assert sorted(os.listdir(q)) == ["e1.m4a", "e1.meta", "e9.mp3"]
    assert (q / "e1.meta").read_text() == f"s1|||e1|||{hashlib.sha256(b'audio').hexdigest()}|||One title\n"
    sinks.csv(manifest.where("episode_id in ('e1', 'e2', 'e5')"), f"{tmp_path}/m")
    text = cli.main(["download", "--manifest", f"{tmp_path}/m", "--queue", str(q), "--getter", "tests.test_outputs:get_audio", "--failures", f"{tmp_path}/failures", "--workers", "1"], spark)
    assert sorted(text.split(", ")) == ["fail: 1", "ok: 1", "skip-queued: 1"] and (q / "STOP").exists()
    failed = spark.read.csv(f"{tmp_path}/failures", header=True)
    assert failed.columns == [c.split()[0] for c in schemas.FAILURES.split(", ")] and failed.first()["reason"] == "status 404"
    assert not producer.drained(str(q), 1.0, 2.0, lambda _: None)
    for n in ("e1.meta", "e5.meta"):
        (q / n).unlink()
    assert producer.drained(str(q))


def test_pace_and_retries():
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = producer.Pace(1.0, lambda: now[0], sleep)
    for key in ("a", "b", "a", "a"):
        pace.wait(key)
    assert slept == [1.0, 1.0]
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) == 1:
            raise OSError("reset")
        return (500 if len(tries) == 2 else 200), url, "", iter(())

    found, reason = producer.fetch(flaky, "u", "k", producer.Pace(0.0, lambda: now[0], sleep))
    assert found.url == "u" and reason == "" and slept[2:] == [2.0, 4.0]
    assert producer.fetch(lambda u: (500, u, "", iter(())), "u", "k", producer.Pace(0.0, lambda: 0.0, sleep))[1] == "status 500"


def test_back_pressure_waits_for_room(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.meta").touch()
    waits = []
    producer.room(str(tmp_path), 2, 0.5, lambda s: (waits.append(s), (tmp_path / f"{len(waits)}.meta").unlink()))
    assert waits == [0.5, 0.5]
    producer.room(str(tmp_path), None)


def test_smoke_test_and_options(spark):
    told = json.loads(cli.main(["queue", "--queue", "q", "--out", "o", "--checkpoint", "c", "--smoke-test", "--language", "fr"]))
    assert told["ok"] and told["language"] == "fr" and told["n_words"] == 2
    with pytest.raises(NotImplementedError):
        worker.smoke_test("whisper")


def test_transcripts_replace_those_of_the_same_episode(spark, tmp_path):
    seg = [(0.0, 1.0, "hi there")]
    one = spark.createDataFrame([("e1", "s1", "old title", "x", "m", "en", 1.0, "h1", seg), ("e2", "s2", "b", "x", "m", "en", 1.0, "h2", seg)], schemas.TRANSCRIPT)
    sinks.upsert_transcripts(one, f"{tmp_path}/t")
    two = spark.createDataFrame([("e1", "s1", "new: title", "x", "m", "en", 1.0, "h9", [(0.0, 1.0, "bye")])], schemas.TRANSCRIPT)
    sinks.upsert_transcripts(two, f"{tmp_path}/t")
    got = {r["episode_id"]: (r["episode_title"], r["audio_sha256"]) for r in readers.transcripts(spark, f"{tmp_path}/t/json").collect()}
    assert got == {"e1": ("new: title", "h9"), "e2": ("b", "h2")}
    texts = {r["stem"]: r["text"] for r in spark.read.json(f"{tmp_path}/t/text").collect()}
    assert texts == {"e1_new_ title": "bye", "e2_b": "hi there"}
    sinks.write_vtt(two, f"{tmp_path}/vtt")
    assert spark.read.text(f"{tmp_path}/vtt").where("value = 'WEBVTT'").count() == 1
    items = spark.createDataFrame([("s1", "e1", "h9"), ("s1", "e1", "h1"), ("s3", "e3", "h")], "show_id string, episode_id string, audio_sha256 string")
    stored = readers.transcripts(spark, f"{tmp_path}/t/json").withColumn("stem", sinks.stem())
    assert sorted((r["audio_sha256"], r["done"]) for r in queue.probed(items, stored).collect()) == [("h", False), ("h1", False), ("h9", True)]


def test_caches_keep_what_was_tried(spark, tmp_path):
    cache = str(tmp_path / "c")
    assert http.fetch_cached("http://h/x", cache) == (None, None, "not in the cache") and not os.path.exists(cache)
    assert http.fetch_cached("http://h/x", cache, lambda u: (200, "hi")) == (200, "hi", "")
    assert http.fetch_cached("http://h/x", cache, lambda u: (200, "new")) == (200, "hi", "")
    assert http.fetch_cached("http://h/x", cache, lambda u: (200, "new"), refresh=True) == (200, "new", "")
    assert http.fetch_cached("http://h/gone", cache, lambda u: (404, None)) == (404, None, "HTTP 404")
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><rss>Müller</rss>"
    assert http.fetch_cached("http://h/latin", cache, lambda u: (200, latin.encode("latin-1")))[1] == latin == http.fetch_cached("http://h/latin", cache)[1]
    assert http.decoded("é".encode()) == "é" and http.decoded("é".encode("utf-16")) == "é" and http.decoded(b"\xef\xbb\xbfx") == "x"
    assert http.decoded(b"a\xff") == "a\ufffd" and http.decoded(b"<?xml encoding='no-such'?>\xc3\xa9").endswith("é")
    sinks.raw_json(readers.fixed_ids(spark, [3, 1]), f"{tmp_path}/raw")
    sinks.raw_json(readers.fixed_ids(spark, [9]), f"{tmp_path}/raw")
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/raw").collect()) == [1, 3]
    sinks.append_lines(spark.createDataFrame([("a",)], "v string"), f"{tmp_path}/done")
    sinks.append_lines(spark.createDataFrame([("b",)], "v string"), f"{tmp_path}/done")
    assert sorted(r["id"] for r in readers.log_lines(spark, f"{tmp_path}/done").collect()) == ["a", "b"]
    assert sinks.freeze(readers.fixed_ids(spark, [1]), f"{tmp_path}/f")[-8:].isdigit()


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_name_scores():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert fuzzy.common(a, b) == plain_common(a, b) and fuzzy.composite(a, b) == fuzzy.composite(b, a) <= 100.0
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.551724) and fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(90.909090) and fuzzy.token_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.composite("this is a test", "this is a new test!!!") == pytest.approx(85.5) and fuzzy.composite("a b", "") == 0


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k int, v int").repartition(7)
    got = numbered(df, [F.desc("k")], "n").collect()
    assert sorted((r["n"], r["k"]) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert numbered(df.where("false"), [F.asc("k")], "n").count() == 0


def test_running_sums_of_a_hot_key(spark):
    import random

    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.5 else rnd.randrange(40), i, float(rnd.randrange(50))) for i in range(3000)]
    rnd.shuffle(rows)
    got = running(spark.createDataFrame(rows, "k int, o int, x double").repartition(5), ["k"], [F.asc("o")], {"n": F.lit(1), "s": F.col("x")}).collect()
    want, seen, total = set(), {}, {}
    for k, o, x in sorted(rows):
        n, s = seen.get(k, (0, 0.0))
        seen[k] = (n + 1, s + x)
        want.add((k, o, *seen[k]))
    assert {(r["k"], r["o"], r["n"], r["s"]) for r in got} == want and all((r["total_n"], r["total_s"]) == seen[r["k"]] for r in got)


def test_quantiles_are_interpolated(spark):
    import numpy as np

    for values in ([5.0], [1.0, 2.0], [3.0, 3.0, 3.0, 9.0, None], [float(i * i % 37) for i in range(101)]):
        q = quantiles(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
        known = [v for v in values if v is not None]
        assert [q["a"], q["b"], q["c"]] == pytest.approx([np.quantile(known, p) for p in (0.25, 0.5, 0.9)])
    empty = quantiles(spark.createDataFrame([], "x double"), "x", {"a": 0.5}).first()
    assert empty["a"] is None


def test_playlist_manifest_and_first_rows(spark, tmp_path):
    lists = [{"id": "a", "title": "short", "duration": 2699.0}, {"id": "b", "title": "long", "duration": 2700.0}, {"id": "c", "title": "none"}]
    (tmp_path / "list.json").write_text("\n".join(map(json.dumps, lists)))
    assert [r["id"] for r in readers.playlist(spark, f"{tmp_path}/list.json").collect()] == ["b"]
    plan = readers.playlist(spark, f"{tmp_path}/list.json")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(duration), GreaterThanOrEqual(duration,2700.0)]" in plan
    sinks.csv(spark.createDataFrame([("s", str(i)) for i in range(9)], "show_id string, episode_id string").coalesce(1), f"{tmp_path}/m")
    assert readers.manifest(spark, f"{tmp_path}/m").count() == 9 and readers.manifest(spark, f"{tmp_path}/m", 4).count() == 4
    rows = spark.createDataFrame([(i * 7 % 10, i) for i in range(10)], "k int, v int").repartition(4)
    assert [r["k"] for r in queue.first_rows(rows, [F.desc("k")], 3).collect()] == [9, 8, 7]
    assert [r["k"] for r in queue.first_rows(rows, ["k"], None).collect()] == list(range(10)) == [r["k"] for r in queue.first_rows(rows, ["k"], 0).collect()]


def test_transcript_records_and_sorted_summaries(spark):
    one = spark.createDataFrame([("e1", "s1", 'A "title": x', "x", "m", "en", 1.0, "h1", [(0.0, 1.0, "hi"), (1.0, 2.0, "there")])], schemas.TRANSCRIPT)
    got = transcripts.record(one).first()
    told = json.loads(got["record"])
    assert got["stem"] == "e1_A _title__ x" and got["text"] == "hi there" and told["segments"][1] == {"start": 1.0, "end": 2.0, "text": "there"} and told["audio_sha256"] == "h1"
    eps = spark.createDataFrame([(s, f"e{i}", 60.0) for s, n in ((3, 1), (1, 2), (2, 2)) for i in range(n)], "show_id long, episode_id string, duration_sec double")
    assert [(r["show_id"], r["n_eps"]) for r in sampling.per_show_summary(eps).collect()] == [(1, 2), (2, 2), (3, 1)]
