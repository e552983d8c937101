"""Edge rows of the scalars, invariants of draws, rules, matching, feeds, queue."""

import json
from datetime import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sandglass.functions import fuzzy
from sandglass.functions import scalars as X
from sandglass.operators import hours, matching, queue, rules, sampling, transcripts
from sandglass.plans import corpus, registry
from sandglass.sources import http, readers, sinks

SF = "/root/testdata/sf0.001"


def one(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_duration(spark):
    raw = ["3600", "12.5", "5:30", "1:02:03", "1:90", "", "abc", "1:2:3:4", "-5", "1:", " 90 ", None]
    assert one(spark, raw, X.parse_duration) == [3600, 12.5, 330, 3723, 150, None, None, None, None, None, 90, None]


def test_estimate(spark):
    df = spark.createDataFrame([(None, 100000), (None, 100001), (0.0, 200000)], "s double, b long")
    got = [tuple(r[0]) for r in df.select(X.estimate_duration(F.col("s"), F.col("b"))).collect()]
    assert got == [(None, "missing"), (6.2500625, "estimated_from_bytes"), (0.0, "itunes:duration")]


def test_pubdate_title_meta_names(spark):
    got = one(spark, ["Tue, 14 Jul 2026 18:31:04 -0400", "14 Jul 2026 18:31:04 GMT", "junk", None], X.parse_pubdate)
    assert got[0] == datetime(2026, 7, 14, 22, 31, 4) and got[1] == datetime(2026, 7, 14, 18, 31, 4) and got[2:] == [None, None]
    assert one(spark, ["a/b:c", "x" * 79 + "  yy", "", None], X.sanitize_title) == ["a_b_c", "x" * 79, "untitled", "untitled"]
    assert one(spark, ["1|||2|||3|||a|||b"], X.split_meta) == [["1", "2", "3", "a|||b"]]
    assert one(spark, ["Café with Ünï!", "The Podcast Show"], X.normalize_name) == ["cafe uni", ""]
    assert one(spark, ["k"], lambda c: X.stable_seed("s", c)) == [int.from_bytes(__import__("hashlib").md5(b"s:k").digest()[:4], "little")]
    df = spark.createDataFrame([("http://h/a.M4A?x=1", None), ("http://h/a", "audio/ogg; q=1"), ("http://h/a.xyz", "text/html")], "u string, t string")
    assert [r[0] for r in df.select(X.guess_extension(F.col("u"), F.col("t"))).collect()] == [".m4a", ".ogg", ".html"]


def test_dates_as_the_standard_library_reads_them(spark):
    from datetime import timezone
    from email.utils import parsedate_to_datetime

    raw = ["Tue, 14 Jul 26 18:31:04 GMT", "Tue, 14 Jul 2026 18:31:04", "Tuesday, 14 July 2026 18:31:04 +0000", "14 Jul 99 01:02 EST", "1 Jan 2024 00:00:00 +1345", "Tue,14 Jul 2026 18:31:04 Z", "29 Feb 2023 00:00:00 GMT", "14 Foo 2026 00:00:00 GMT", " 14 Jul 2026 25:00:00 GMT", "", "14 Jul 2026", "Sun, 06-Nov-94 08:49:37 GMT"]
    want = []
    for r in raw:
        try:
            d = parsedate_to_datetime(r)
            want.append((d.astimezone(timezone.utc) if d.tzinfo else d).replace(tzinfo=None))
        except (TypeError, ValueError):
            want.append(None)
    want[5] = datetime(2026, 7, 14, 18, 31, 4)
    got = one(spark, raw, lambda c: X.parse_pubdate(c).cast("timestamp_ntz"))
    assert got == want
    assert one(spark, ["\t5:00\n", "\r7 "], X.parse_duration) == [300, 7]


def test_suffixes(spark):
    rows = [("http://h/a.oga", None, ".oga"), ("http://h/a.mp4", "video/mp4", ".mp4"), ("http://h/a", "audio/x-wav", ".wav"), ("http://h/a", "audio/mpeg; x", ".mp3"), ("http://h/redirect.mp3/x", "", ".mp3"), ("http://h/a", "audio/mp4", ".m4a"), (None, None, ".mp3")]
    df = spark.createDataFrame(rows, "u string, t string, want string")
    assert all(r[0] == r[1] for r in df.select(X.guess_extension(F.col("u"), F.col("t")), "want").collect())
    assert one(spark, ["file:/q/a.b.meta", "x", "/d.e/.part"], X.path_stem) == ["a.b", "x", ".part"] and one(spark, ["file:/q/a.b.meta", "x"], X.path_suffix) == [".meta", ""]


def test_shuffles_are_the_libraries(spark):
    import hashlib
    import random

    import numpy as np

    rows = [(s, f"e{i}", 600.0 + i, datetime(2026, 1, 1 + i % 9), f"u{i}") for s in (1, 2) for i in range(30)] + [(3, "e", 60.0, datetime(2026, 1, 1), "u")]
    eps = spark.createDataFrame(rows, "show_id long, episode_id string, duration_sec double, pub_date timestamp, audio_url string")
    got = {}
    for r in sampling.shuffled_draw(eps, 1.0, 24, 5).orderBy("show_id", "draw_order").collect():
        got.setdefault(r["show_id"], []).append(r["episode_id"])
    assert len(got[3]) == 1
    for s in (1, 2):
        pool = sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[4]))
        random.Random(f"5:24:1:{s}").shuffle(pool)
        want, total = [], 0.0
        for r in pool:
            if total >= 3600:
                break
            want.append(r[1])
            total += r[2]
        assert got[s] == want
    got = {}
    for r in sampling.permuted_draw(eps, 1.0, 5).orderBy("show_id", "draw_order").collect():
        got.setdefault(r["show_id"], []).append(r["episode_id"])
    assert set(got) == {1, 2}
    for s in (1, 2):
        pool = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        order = np.random.default_rng(int.from_bytes(hashlib.md5(f"5:{s}".encode()).digest()[:4], "little")).permutation(30)
        assert got[s] == [pool[i][1] for i in order][: len(got[s])] and sum(pool[i][2] for i in order[: len(got[s])]) >= 3600


def test_word_boundary_language(spark):
    assert one(spark, ["verte", "RTE Radio", None], lambda c: rules.first_term(c, ["rte"])) == [None, "rte", None]
    assert one(spark, [" EN-us", "es-ES", "", None], rules.not_english) == [False, True, False, False]


def episodes(spark, rows):
    return spark.createDataFrame(rows, "show_id long, episode_id string, duration_sec double")


def test_draw_edges(spark):
    rows = [(1, f"a{i}", 3600.0) for i in range(5)] + [(2, "b", 1800.0)] + [(3, "c", 90000.0)]
    got = {r[0]: r[1] for r in sampling.budget_draw(episodes(spark, rows), 2, 1).groupBy("show_id").count().collect()}
    assert got == {1: 2, 3: 1}
    got = {r[0]: r[1] for r in sampling.budget_draw(episodes(spark, rows), 2, 1, keep_short=True).groupBy("show_id").count().collect()}
    assert got == {1: 2, 2: 1, 3: 1}
    assert sampling.budget_draw(episodes(spark, []), 2, 1).count() == 0


def test_ladder_is_nested(spark):
    pool = registry.pool(spark, SF)
    ladder = sampling.saturation_ladder(pool, 7)
    by = {}
    for r in ladder.select("rung_h", "show_id", "episode_id").collect():
        by.setdefault(r[0], set()).add(r[1:])
    rungs = sorted(by)
    for a, b in zip(rungs, rungs[1:]):
        shows = {s for s, _ in by[b]}
        assert {x for x in by[a] if x[0] in shows} <= by[b]
    assert by[25] == {tuple(r) for r in sampling.budget_draw(pool, 25, 7).select("show_id", "episode_id").collect()}


def test_lookback_and_survival(spark):
    df = spark.createDataFrame([(1, datetime(2024, 2, 29)), (1, datetime(2024, 2, 28, 23, 59, 59)), (1, datetime(2025, 3, 31))], "show_id long, pub_date timestamp")
    assert hours.lookback(df, 13).count() == 2  # the cutoff is clamped to the month's end and kept
    shows = spark.createDataFrame([(1,), (9,)], "show_id long")
    eps = spark.createDataFrame([(1, datetime(2025, 1, 1), 36000.0, "u")], "show_id long, pub_date timestamp, duration_sec double, audio_url string")
    table = hours.show_hours(shows, eps)
    assert {(r["show_id"], r["total_hours"]) for r in table.collect()} == {(1, 10.0), (9, 0.0)}
    s = hours.survival_table(table).where("window_months = 12").orderBy("H").collect()
    assert [r["n_surviving"] for r in s] == [1, 1, 0, 0, 0, 0, 0, 0]
    flat = spark.createDataFrame([(12, h, 5) for h in (5, 10, 15)], "window_months int, H int, n_surviving long")
    k = hours.knee(flat).first()
    assert (k["knee_h"], k["knee_rate"]) == (5, 0.0)


def test_rule_order(spark):
    cols = "show_id long, status string, error string, publisher string, show_name string, rss_description string, rss_author string, rss_language string, hours_available double"
    rows = [
        (1, "no_audio", "none", "rte radio", "", "", "", "", 50.0), (2, "ok", "", "rte radio", "", "", "", "", 5.0), (3, "ok", "", "RTE Radio", "", "", "", "", 50.0),
        (4, "ok", "", "rte", "", "", "", "es", 50.0), (5, "ok", "", "x", "", "", "", " EN-us", 10.0), (6, "ok", "", "x", "uk politics now", "", "", None, 50.0), (7, "ok", "", "x", "", "", "", "", 9.99),
    ]
    df = rules.first_failing_rule(spark.createDataFrame(rows, cols), rules.inclusion_rules(["rte"], [r"\buk politics\b"], [2], {4: "by hand"}, 10.0))
    got = {r["show_id"]: (r["rule"], r["evidence"]) for r in df.collect()}
    assert got[1] == ("R4_no_audio", "none") and got[2][0] == "R6_insufficient_catalog"
    assert got[3] == ("R5_non_us_politics", "publisher matches blocklist term 'rte' (RTE Radio)") and got[4][1] == "curated list: by hand"
    assert got[5] == (None, None) and got[6][1] == r"title/description matches /\buk politics\b/ ('uk politics')" and got[7][1] == "9.99 h available < 10.0 h threshold"


def test_match_status(spark):
    n = lambda x, y, same=False: ({"neg": -x, "label": "A", "value": "v", "label_norm": "a"}, None if y is None else {"neg": -y, "label": "B", "value": "w", "label_norm": "a" if same else "b"})
    cases = [n(90.0, 0.0), n(89.96, 0.0), n(75.0, None), n(74.9, 0.0), n(95.0, 91.0), n(95.0, 95.0, True), n(95.0, 90.0)]
    kind = "struct<neg:double,label:string,value:string,label_norm:string>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)] + [(7, None, None)], f"id int, a {kind}, b {kind}")
    got = matching.match_status(df).orderBy("id").collect()
    assert [r["match_status"] for r in got] == ["matched", "review", "review", "none", "ambiguous", "matched", "matched", "none"]
    assert got[1]["match_score"] == 90.0 and got[4]["runner_up_name"] == "B"
    assert fuzzy.composite("morning news", "news morning") == pytest.approx(95.0) and fuzzy.composite("", "a") == 0


FEED = """<rss xmlns:itunes="http://x"><channel><description> d </description><language>en</language><itunes:author>me</itunes:author>{}</channel></rss>"""
ITEM = '<item><title>t{}</title><pubDate>Tue, 14 Jul 2026 18:31:04 GMT</pubDate><itunes:duration>{}</itunes:duration><enclosure url="{}" length="200000"/></item>'


def test_feeds_and_build(spark):
    good = FEED.format(ITEM.format(1, "1:00:00", "u1") + ITEM.format(2, "", "u2"))
    bodies = [("f1", good, 200, None), ("f2", good.replace("t1", "t\x01"), 200, None), ("f3", good[:60], 200, None), ("f4", FEED.format(""), 200, None), ("f5", None, 404, None), ("f6", FEED.format(ITEM.format(1, "36000", "u")), 200, None)]
    frame = spark.createDataFrame([(i + 1, i + 1, f"s{i}", "p", f) for i, f in enumerate(["f1", "f2", "f3", "f4", "f5", "", "f6"])], "rank int, collection_id long, show_name string, publisher string, feed_url string")
    out = corpus.build(frame, spark.createDataFrame(bodies, "feed_url string, body string, http_status int, error string"), [], [r"\bnone\b"], [], {}, 1.0)
    judged = {r["show_id"]: r for r in out["judged"].collect()}
    assert [judged[i]["status"] for i in range(1, 8)] == ["ok", "ok", "feed_unparseable", "no_audio", "feed_unreachable", "no_feed_url", "ok"]
    assert judged[1]["hours_available"] == 1.0 and judged[1]["rule"] is None and judged[5]["evidence"] == "HTTP 404"
    assert out["corpus"].count() + out["exclusions"].count() == 7 and out["episodes"].count() == 5
    assert out["manifest"].first()["exclusions_by_rule"]["R1_no_feed_url"] == 1 and "corpus: 3" in corpus.report(out["corpus"], out["exclusions"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps({"pulled_at_utc": "x", "url": "u", "genre_id": 1, "storefront": "us", "result_ids": [7, 5]}))
    look = {"pulled_at_utc": "x", "responses": [{"url": "u", "response": {"results": [{"kind": "podcast", "collectionId": 7, "collectionName": "old"}, {"kind": "song", "collectionId": 5}]}}, {"url": "u", "response": {"results": [{"wrapperType": "track", "collectionId": 7, "collectionName": "new", "genres": ["a", "b"]}]}}]}
    (tmp_path / "look.json").write_text(json.dumps(look))
    f = readers.frame(readers.chart_ids(spark, str(tmp_path / "ids.json")), readers.lookups(spark, str(tmp_path / "look.json")), "News", "Politics")
    got = {r["collection_id"]: r for r in f.collect()}
    assert got[7]["show_name"] == "new" and got[7]["genres"] == "a|b" and got[7]["rank"] == 1 and not got[5]["lookup_found"]
    path = sinks.freeze(f, str(tmp_path / "frame"), "20260713")
    assert readers.frozen_frame(spark, path).count() == 2
    with pytest.raises(Exception):
        sinks.freeze(f, str(tmp_path / "frame"), "20260713")
    (tmp_path / "labels.csv").write_text('" Show Name ",Partisan Leaning\nA,x\nA,y\n,z\n"B, ""q"" b",w\n')
    assert {(r["label"], r["value"], r["norm"]) for r in readers.labels_csv(spark, str(tmp_path / "labels.csv")).collect()} == {("A", "x", ""), ('B, "q" b', "w", "b q b")}
    eps = spark.createDataFrame([(1, 's "x"\nz', "t", "d", datetime(2026, 1, 1), "u", 5, 600.0, "missing"), (1, "s", "t", "d", datetime(2026, 1, 1), "u", 5, 700.0, "missing"), (1, "s", "t", "d", datetime(2026, 1, 1), "v", 5, 299.0, "missing")], "collection_id long, show_name string, episode_title string, episode_description string, pub_date timestamp, audio_url string, audio_bytes long, duration_sec double, duration_source string")
    sinks.csv(eps.coalesce(1), str(tmp_path / "eps"), gzip=True)
    back = readers.episodes_csv(spark, str(tmp_path / "eps"))
    assert back.count() == 3 and [r["duration_sec"] for r in readers.sampler_pool(back).collect()] == [600.0]
    status, body, _ = http.fetch_cached("http://h/x", str(tmp_path / "c"), lambda u: (200, "hi"))
    assert (status, body) == (200, "hi")
    spark.dataSource.register(http.SnapshotSource)
    df = spark.read.format("snapshot").option("urls", json.dumps(["http://h/x", "http://g/y"])).option("cache", str(tmp_path / "c")).load()
    assert {(r["url"], r["body"]) for r in df.collect()} == {("http://h/x", "hi"), ("http://g/y", None)}


def test_queue_joins_and_transcripts(spark):
    items = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "item long, ok boolean")
    t, q = spark.createDataFrame([(1,)], "item long"), spark.createDataFrame([(1,), (2,)], "item long")
    assert [r["outcome"] for r in queue.outcomes(items, t, q, "item", F.col("ok")).orderBy("item").collect()] == ["skip-done", "skip-queued", "ok", "fail"]
    w = spark.createDataFrame([("d", 0.0, 1.0), ("d", 29.5, 31.0), ("d", 90.0, 91.0)], "doc string, w_start double, w_end double")
    s = spark.createDataFrame([("d", 0.0, 30.0, "a"), ("d", 30.0, 60.0, "b")], "doc string, t_start double, t_end double, speaker string")
    assert [r["speaker"] for r in queue.overlap_assign(w, s).orderBy("w_start").collect()] == ["a", "b", None]
    segs = spark.createDataFrame([([(0.0, 1.5, " hi there "), (61.0, 62.0, "you")], 10.0, 0.0)], "s array<struct<start:double,end:double,text:string>>, duration double, wall_seconds double").withColumn("segments", transcripts.segments(F.col("s")))
    m = transcripts.metrics(segs).first()
    assert m["n_words"] == 3 and m["n_segments"] == 2 and m["realtime_factor"] != m["realtime_factor"]
    assert "00:01:01.000 --> 00:01:02.000" in segs.select(transcripts.cues(F.col("segments"))).first()[0]


ALL = registry.build()


def test_titles_and_names_of_whole_texts(spark, tmp_path):
    rows = [(1, "One" + " " * 200 + "two"), (2, "word " * 40 + "Last"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r["doc_id"]: r[1] for r in ALL[n][0](spark, str(tmp_path)).collect()} for n in ("sanitize_title", "normalize_name_folded")}
    assert got["sanitize_title"] == {1: "One two", 2: ("word " * 16).strip(), 3: "untitled"}
    assert got["normalize_name_folded"] == {1: "one two", 2: "word " * 40 + "last", 3: ""}


def test_labels_are_all_customers(spark, tmp_path):
    spark.createDataFrame([(i, f"Supplier#{i:09d}", 1, 0.0) for i in (3, 151, 4321)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    keys = [*range(1, 161), 4320, 4321]
    spark.createDataFrame([(i, f"Customer#{i:09d}", "AUTO") for i in keys], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    norm = {f"Customer#{i:09d}": f"supplier {i:09d}" for i in keys}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for i in (3, 151, 4321):
        name = f"supplier {i:09d}"
        best = sorted((-100.0 * (len(name) - distance(name, n)) / len(name), label) for label, n in norm.items())[:2]
        want[i] = (best[0][1], round(-best[0][0], 1), round(-best[1][0], 1))
    got = {r["id"]: (r["label_name"], r["match_score"], r["runner_up_score"]) for r in ALL["fuzzy_top2"][0](spark, str(tmp_path)).collect()}
    assert got == want and all(v[1] == 100.0 for v in got.values())
    assert {r["label_name"] for r in ALL["fuzzy_top2_composite"][0](spark, str(tmp_path)).collect()} == {v[0] for v in want.values()}
    assert sum(r["n"] for r in ALL["match_status"][0](spark, str(tmp_path)).collect()) == 3


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations labels clicks".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = ALL[name][0](spark, SF).toPandas()
    want = con.sql(ALL[name][1]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    plain = lambda df: sorted((tuple("" if v is None or v != v else f"{v:.12g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).values.tolist()))
    for c in cols:
        if got[c].dtype.kind in "if" or want[c].dtype.kind in "if":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
        if got[c].dtype.kind == "M" or want[c].dtype.kind == "M":
            got[c], want[c] = (pd.to_datetime(x[c]).astype("datetime64[us]").astype(str) for x in (got, want))
    assert plain(got) == plain(want)
