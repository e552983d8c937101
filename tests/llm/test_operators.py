"""Operators against SQL, libraries or brute force, over rows with nulls, blanks, copies, ties and clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sandglass.llm import bpe_stream, exact_dedup, fingerprints, language, licenses, line_dedup, mixing, quality, registry, secrets, simple8b, token_files
from sandglass.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
LINE = "one two three four five six seven eight nine ten eleven twelve\n"
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [
    None, "", " ", "\n\n", "a", "The same text here", "The same text here", LINE * 6, LONG, LONG + " x", "mixed\tspace\x0bçà 日本語 😀 nb",
    "token = \"abcdef123456\" passwd: x AKIA" + "Q" * 16 + " " + "ab" * 14 + " secret=token: abcdefgh", "Licensed under CC BY-NC 4.0.\nAll  rights\nreserved! all rights reserve",
    "GNU General Public Licence v3 and the GNU General Public License", "<|endoftext|> don't <|startoftext|>", "### $$$ %%% && a b c\nclick here\nfoo | bar | baz | qux",
    " ".join(["alpha", "beta", "gamma", "delta"] * 20), LINE + "other words\n" + LINE, "x " * 60 + "\n" + "y\n" + "x " * 60,
]
ROWS = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "clash", i) for i, t in enumerate(TEXTS)]
ROWS += [(None, "no id", None, None, None, None, None), (5, "The same text here", "en", "s1", 18, "clash", 1), (5, "The same text here", "en", "s1", 18, "clash", 1)]
KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, __mix_size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


APPLY = {
    "op1_quality_rules": quality.score_documents, "op2_simhash_near_dedup": fingerprints.near_duplicates, "op3_license_scan": licenses.scan_licenses,
    "op4_mix_sources": mixing.mix_digest, "op5_token_files": lambda d: token_files.token_digest(d, token_files.tokenizer_path(d.sparkSession, "byte_bpe_50k.json")),
    "op6_language_id": language.identify, "op7_exact_dedup": exact_dedup.exact_groups, "op8_bpe_round_trip": lambda d: bpe_stream.bpe_digest(d, token_files.tokenizer_path(d.sparkSession, "word_bpe_49k.json")),
    "op9_line_dedup": line_dedup.dedup_digest, "op10_secret_scan": secrets.scan_secrets,
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_every_row_once_and_empty_table(docs, none, name):
    assert sorted(str(r["doc_id"]) for r in APPLY[name](docs).collect()) == sorted(str(r[0]) for r in ROWS)
    assert APPLY[name](none).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES.keys() & APPLY.keys()))
def test_against_sql(spark, docs, name):
    import pandas as pd

    documents = pd.DataFrame(ROWS, columns=["doc_id", "text", "lang", "source", "n_chars", "size", "extra"]).astype({"doc_id": "Int64"})  # noqa: F841
    if name == "op9_line_dedup":  # rows that share id and text are one place to the operator
        documents = documents.drop_duplicates(["doc_id", "text"])  # noqa: F841
        docs = docs.dropDuplicates(["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents.drop(columns="extra"))
    show = lambda df: sorted(str([None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert show(APPLY[name](docs).toPandas()) == show(con.sql(ORACLES[name]).df())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert show(registry.queries()[name](spark, SF).toPandas()) == show(con.sql(ORACLES[name]).df())


def components(values, radius):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    return {v: root(v) for v in vs}


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_brute_force(spark):
    rows = real(spark).select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in rows}
    comp = components(set(prints.values()), 2)
    name = {}
    for i, f in prints.items():
        name[comp[f]] = min(i, name.get(comp[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in fingerprints.near_duplicates(real(spark)).collect()}
    assert got == {i: (f"{f:016x}", name[comp[f]]) for i, f in prints.items()}


def test_licenses():
    got = licenses.scan(TEXTS[12])
    assert got[1] == 2 and got[4] == "cc-by,reserved" and "cc-by-nc" in got[5].split(",") and 0 < got[6] <= 1
    got = licenses.scan("gnu generl public license")
    assert (got[1], got[4], got[5]) == (0, "", "gpl") and got[7] == "gpl:0:4:1"
    assert licenses.scan("the general public likes licenses") == (5, 0, None, None, "", "", 0.0, "")
    for t in TEXTS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert licenses.scan(t)[:4] == (len(words), len(at), min(at, default=None), max(at, default=None))


def edits_to_prefixes(text, of):
    """Plain edit distance of text to each prefix of ``of``."""
    row = list(range(len(of) + 1))
    for i, c in enumerate(text, 1):
        new = [i]
        for j, d in enumerate(of, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def holds(text, parts):
    if not parts:
        return not text
    (own, errors), rest = parts[0], parts[1:]
    if not errors:
        return text.startswith(own) and holds(text[len(own) :], rest)
    found = edits_to_prefixes(own, text)
    return any(found[n] <= errors and holds(text[n:], rest) for n in range(max(0, len(own) - errors), min(len(text), len(own) + errors) + 1))


def test_notices_against_plain_edit_distance():
    rnd = random.Random(21)
    plain = [re.sub(r"[\[\]]", "", n) for n, _ in licenses.NOTICES]
    for turn in range(60):
        chars = list(plain[turn % len(plain)])
        for _ in range(rnd.randrange(4)):
            at, what = rnd.randrange(len(chars)), rnd.randrange(3)
            chars[at : at + (what < 2)] = [] if what == 0 else [rnd.choice("aeix")]
        text = " ".join([*rnd.choices(["of", "the", "nc", "x"], k=2), *"".join(chars).split(), *rnd.choices(["sa", "by", "y"], k=rnd.randrange(3))])
        words, want = text.split(), set()
        for notice, label in licenses.NOTICES:
            if label == "cc-by":
                continue  # what completes these is tested below
            parts = licenses.parts_of(notice, licenses.ERRORS_PER_CHAR)
            n, k = sum(len(x) for x, _ in parts), sum(e for _, e in parts)
            for i in range(len(words)):
                for j in range(i + 1, len(words) + 1):
                    part = " ".join(words[i:j])
                    if abs(len(part) - n) <= k and holds(part, parts):
                        want.add(label)
        got = {s[2] for s in licenses.fuzzy_spans(text)}
        assert {x for x in got if not x.startswith("cc-by")} == want, text


@pytest.mark.parametrize("text, label", [
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("CC BY-ND", "cc-by-nd"), ("cc by nc sa", "cc-by-nc-sa"), ("CC BY 4.0", "cc-by"), ("Creative Commons Atribution Share Alike", "cc-by-sa"),
    ("Apache License version 1.1", "apache-1.1"), ("under the Apache License, Version 2.0", "apache-2.0"), ("MIT License", "mit"), ("The MIT License (MIT)", "mit"), ("ISC license", "isc"),
    ("GNU GPL v3", "gpl"), ("GNU Lesser General Public Licence", "lgpl"), ("limit license", ""), ("ccby", ""), ("the general public likes", ""),
])
def test_labels_of_notices(text, label):
    assert ",".join(sorted({s.split(":")[0] for s in licenses.scan(text)[7].split(",")})) == label


def test_license_scan_is_linear():
    import time

    took = []
    for n in (10_000, 80_000):
        start = time.process_time()
        assert licenses.scan("cc by " * n)[1] == n
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]


def test_mix_nears_targets(spark, docs):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 7}") for i in range(7000)], "doc_id long, text string, source string")
    per = mixing.mix_digest(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["g"]) < 0.1 * r["g"] and r["g"] <= 2 * r["s"] for r in per)
    assert sum(r["g"] for r in per) == pytest.approx(1.5 * sum(r["s"] for r in per))
    assert mixing.mix(docs).columns == docs.columns and {r[6] for r in mixing.mix(docs).collect()} <= {r[6] for r in ROWS}
    assert mixing.mix(df).count() == mixing.mix_digest(df).agg(F.sum("copies")).first()[0]


def test_targets_of_many_sources(spark):
    rnd = random.Random(14)
    sizes = {(None if k == 5 else f"s{k:04}"): rnd.choice([0, 1, 10, 500, rnd.randrange(100_000)]) for k in range(900)}
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9  # the level that fills 150 % of all sizes
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], weight[s] * level) for s in names) < 1.5 * sum(sizes.values()) else (low, level)
    assert all(got[s] == (sizes[s], pytest.approx(min(2 * sizes[s], weight[s] * level), rel=1e-9, abs=1e-6)) for s in names)


def test_simple8b():
    rnd = np.random.default_rng(1)
    for a in ([], [0], [1] * 700, [0, 1 << 63, 2**60, 2**60 - 1, 5], list(rnd.integers(0, 1 << 40, 3000)), list(rnd.integers(0, 60000, 999))):
        v = np.array(a, dtype=np.uint64)
        words, escapes = simple8b.encode(v)
        assert (simple8b.decode(words, escapes, len(v)) == v).all() and words.dtype == np.uint64


def test_tokens_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path(spark, "byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = real(spark).select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, {}
    for r in rows:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_files.token_digest(real(spark), path).collect()} == want
    for t in TEXTS:
        assert token_files.encoder(path).encode([t or ""])[0].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path(spark, "word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe_stream.codec(path)
    rnd = random.Random(2)
    alphabet = "ab e'sTL 12½é\n.,!İßÿ_<|> "
    more = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)] + ["a" * 3000, "ab" * 900 + "!" * 200, "ΣΑΣ ﬁ K"]
    for t in [*(x or "" for x in TEXTS), *more, *(r[0] for r in real(spark).select("text").limit(60).collect())]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.run(t) == (len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))


def test_blocks_are_read_from_anywhere(spark):
    rnd = np.random.default_rng(7)
    ids = np.concatenate([rnd.integers(0, 50_000, 20_000), rnd.integers(0, 2, 5000), rnd.integers(0, 50_000, 3001)]).astype(np.uint64)
    ids[77], ids[20_100] = 1 << 62, (1 << 64) - 1
    cuts = np.sort(rnd.integers(0, len(ids), 60))
    lengths = np.diff([0, *cuts, len(ids)])
    block = token_files.Block(token_files.pack([None if i % 7 == 0 else i for i in range(61)], lengths, ids))
    for first, count in [(0, len(ids)), (77, 1), (0, 0), (len(ids) - 1, 1), (20_099, 3), *((int(a), int(rnd.integers(0, len(ids) - a + 1))) for a in rnd.integers(0, len(ids), 200))]:
        assert (block.read_ids(first, count) == ids[first : first + count]).all()
    for sections in (1, 3, 64):
        found = list(block.documents(sections))
        assert [n for n, _ in found] == [None if i % 7 == 0 else i for i in range(61)]
        assert (np.concatenate([x for _, x in found]) == ids).all() and [len(x) for _, x in found] == lengths.tolist()
    damaged = bytearray(token_files.pack([1], np.array([3]), ids[:3]))
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.Block(bytes(damaged))
    path = token_files.tokenizer_path(spark, "byte_bpe_50k.json")
    tok = token_files.encoder(path).tok
    blocks = token_files.write_token_files(real(spark), path, block_ids=5000)
    texts = {r["doc_id"]: r["text"] for r in real(spark).collect() if r["doc_id"] % 17 == 0}
    got = {r["doc_id"]: r["ids"] for r in token_files.read_documents(blocks, sorted(texts)).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}


def test_slices_are_bounded():
    import pyarrow as pa

    texts = ["x" * 50, None, "", "y" * 200, "z", "z", "z", "é" * 30]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    got = [s.column(0).to_pylist() for s in token_files.slices(batch, 3, 60)]
    assert got == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert list(token_files.slices(batch.slice(0, 0))) == []


def test_pieces_that_open_inside_are_encoded_alone(spark):
    enc = token_files.PieceEncoder(token_files.tokenizer_path(spark, "byte_bpe_50k.json"))
    enc.opens[:] = True
    texts = ["a b-c don't; x", "Ünï cödé 12,5 %"]
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer_against_plain_merging():
    from tokenizers import Tokenizer, models

    rnd = random.Random(12)
    for _ in range(40):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(rnd.randrange(1, 12)):
            pair = rnd.choice(list(vocab)), rnd.choice(list(vocab))
            if pair[0] + pair[1] not in vocab:
                merges.append(pair)
                vocab[pair[0] + pair[1]] = len(vocab)
        machine = bpe_stream.Transducer(vocab, merges, "")
        library = Tokenizer(models.BPE(vocab, merges))
        for _ in range(40):
            piece = "".join(rnd.choice("abcabcx") for _ in range(rnd.randrange(1, 90)))
            given: list = []
            assert machine.encode(piece) == library.encode(piece).tokens
            machine.encode(piece, given.extend)
            assert given == library.encode(piece).tokens


def test_tokens_leave_before_the_end(spark):
    own = bpe_stream.codec(token_files.tokenizer_path(spark, "word_bpe_49k.json"))
    own.machine.settled = 0
    own.words.clear(), own.older.clear()
    for r in real(spark).select("text").limit(40).collect():
        own.run(r[0])
    assert own.machine.settled > 0
    left: list = []
    held = own.machine.encode("thorough" * 4000, left.append)
    assert not held and len(left) > 100 and max(map(len, left[:-1])) < 4 * own.machine.lookahead


def test_memory_stays_flat(spark):
    import tracemalloc

    own = bpe_stream.codec(token_files.tokenizer_path(spark, "word_bpe_49k.json"))
    peaks = []
    for times in (1, 8):
        text = "Thorough ablation hétier, ñ thinking; " * (30_000 * times)
        own.digest(text[:200_000])
        tracemalloc.start()
        own.digest(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_bytes_become_text_as_they_come():
    raw = "é日😀x".encode() + b"\xe6\x97"
    machine = bpe_stream.ByteText({i: bytes([b]) for i, b in enumerate(raw)}, b"")
    out = [machine.feed([i]) for i in range(len(raw))]
    assert [x for x in out if x] == ["é", "日", "😀", "x"] and machine.finish() == "\ufffd" == (b"\xe6\x97").decode("utf-8", "replace")
    named = bpe_stream.ByteText({0: b"a", 1: b"b"}, b" ")
    assert named.feed([0]) + named.feed([9]) + named.feed([1, 0]) + named.finish() == "a b a"


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    f = language.fit(df)
    assert f.predict(None) == ("und", 0.0) and f.predict("12 34 !") == ("und", 0.0)


def test_language_by_exact_sets(spark):
    """The filters against plain sets of trigrams: none lost, few false ones, and the same languages where sets decide clearly."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {}
    for r in language.own_grams(df).collect():
        held.setdefault(r["lang"], set()).add(r["code"] % 2**64)
    filters = language.Filters({k: np.array(sorted(v), dtype=np.uint64) for k, v in held.items()})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df).collect()}
    rows = df.select("doc_id", "text").collect()
    for r in rows[:300]:
        low = f" {r['text'].lower()} "
        letters = [c if c.isalpha() else " " for c in low]
        codes = [ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in zip(letters, letters[1:], letters[2:]) if b != " "]
        exact = {k: sum(c in v for c in codes) for k, v in held.items()}
        total, counts = filters.counts(r["text"])
        assert total == len(codes) and all(0 <= n - exact[k] <= 0.05 * total + 3 for k, n in zip(filters.languages, counts))
        best = sorted(exact.values())
        if best and best[-1] - best[-2] > 0.1 * total:
            assert got[r["doc_id"]][0] == max(exact, key=exact.get) and got[r["doc_id"]][1] == pytest.approx(best[-1] / total, abs=0.05)


def test_filters_of_many_languages():
    rnd = np.random.default_rng(4)
    sets = {f"l{k:02}": rnd.integers(0, 1 << 62, 400, dtype=np.uint64) for k in range(19)}
    filters = language.Filters(sets)
    assert filters.table.shape[0] == 3
    for k, name in enumerate(filters.languages):
        where = language.slots(sets[name], filters.mask)
        mask = filters.table[k // 8][where[0]] & filters.table[k // 8][where[1]] & filters.table[k // 8][where[2]]
        assert (mask >> (k % 8) & 1).all()
        assert filters.false_rate[k] < 0.05


def test_directory_splits_overfull_buckets(spark):
    done, still = exact_dedup.grow([(0, 0)], {0: 100, 1: 1, 7: 1}, 3, 50)
    assert sorted(done) == [(1, 1), (1, 2), (1, 3)] and still == [(0, 3)]
    assert exact_dedup.grow([(0, 0)], {}, 3, 1) == ([(0, 0)], [])
    keys = [k << 40 for k in range(50)] + [-(1 << 62), -1, (1 << 62) + 5]
    starts = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), 4)
    held = np.bincount(np.searchsorted(starts, np.array(keys).view(np.uint64), "right") - 1, minlength=len(starts))
    assert starts[0] == 0 and held.max() <= 4 and (np.diff(starts.astype(object)) > 0).all()


@pytest.mark.parametrize("keys", [1, 3])
def test_chains_tell_colliding_texts_apart(spark, docs, keys):
    weak = lambda text: F.pmod(F.xxhash64(text), F.lit(keys))
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs, hash_of=weak).collect())
    texts = {}
    for r in ROWS:
        texts.setdefault(r[1] or "", []).append(r[0])
    want = []
    for t, ids in texts.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(str(i), keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got == sorted(want)
    index, _ = exact_dedup.build_index(docs, hash_of=weak)
    places = [(r["key"], r["chain"]) for r in index.collect()]
    assert len(places) == len(set(places)) == len(texts) and max(c for _, c in places) >= len(texts) // keys - 1
    assert exact_dedup.keep_largest(docs, hash_of=weak).count() == len(texts)


def test_exact_dedup_of_very_long_texts(spark):
    text = "word " * 2_000_000
    df = spark.createDataFrame([(1, text), (2, text), (3, text + "x"), (None, text)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df).collect()) == [("1", 2, 3), ("2", 2, 3), ("3", 3, 1), ("None", 2, 3)]
    assert sorted(r["doc_id"] for r in exact_dedup.keep_largest(df).select("doc_id").collect()) == [2, 3]


def without_repeats(rows, length):
    """Texts without the lines of later places of repeated runs of any length, first places whole."""
    first, gone = {}, {}
    for i, t in rows:
        lines = t.split("\n")
        for p in range(len(lines)):
            for end in range(p + length, len(lines) + 1):
                if not lines[p].strip():
                    break
                doc, q = first.setdefault(tuple(lines[p:end]), (i, p))
                if (doc, q) != (i, p):
                    gone.setdefault(i, set()).update(k for k in range(p, end) if doc != i or k >= q + end - p)
                elif end - p > 600:
                    break
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


@pytest.mark.parametrize("length", [1, 2, 5])
def test_line_runs_brute_force(spark, length):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice("abc" + " " * (i % 9)) for _ in range(rnd.randrange(1, 16)))) for i in range(60)]
    rows += [(60, "x\n" + "\n" * 13 + "y\nz"), (61, "x\n" + "\n" * 13 + "y\nw"), (62, "x\n" + "\n" * 13 + "z"), (63, "p\n\nq\nr"), (64, "p\n\nq\ns")]
    rows += [(65, "k l\n" * 7 + "m"), (66, "u v\nw\n" * 5 + "end"), (67, "t\n\n" * 6 + "t")]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, __line_doc string").repartition(3)
    want = without_repeats(rows, length)
    got = line_dedup.dedup_lines(df, min_lines=length).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and {r["__line_doc"] for r in got} == {"kept"}
    if length == 2:
        assert want[64] == "s" and want[65] == "k l\nk l\nm" and want[66] == "u v\nw\nend"


def test_long_line_runs(spark):
    """Runs of 2 to 500 lines planted in two documents each, between lines of their own."""
    rnd = random.Random(2)
    rows, number = [], iter(range(10**9))
    own = lambda k: [f"own {next(number)}" for _ in range(k)]
    for k, n in enumerate((2, 3, 7, 64, 65, 127, 500)):
        run = [f"run {k} {j}" if rnd.random() < 0.9 else "" for j in range(n - 1)] + [f"last {k}"]
        run[0] = f"run {k}"
        rows += [(2 * k, "\n".join(own(3) + run + own(2))), (2 * k + 1, "\n".join(own(1) + run + own(4)))]
    levels = line_dedup.suffix_array(line_dedup.stored(line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string")), "lines"))
    assert len(levels) == 9  # 256 of 500 lines
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        assert got[i] == (t if i % 2 == 0 else "\n".join(x for x in t.split("\n") if x.startswith("own")))


def test_line_dedup_query_takes_whole_runs(spark, tmp_path):
    spark.createDataFrame([(1, "p\n\nq\nr"), (2, "p\n\nq\ns")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in registry.queries()["op9_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "0-2"}


def test_trigram_queries_and_spans(docs):
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == [] and secrets.trigram_query("AKIA[A-Z0-9]+") == [[["aki", "kia"]]]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}[11]
    assert got["spans"].startswith("assign:0:21,") and (got["n_access"], got["n_hex"]) == (1, 1)
    assert got["base_sha256"] == hashlib.sha256(got["spans"].encode()).hexdigest()


def test_trigram_postings_and_masks(spark):
    rnd = random.Random(9)
    bits = ["password=abcdefgh", "token: zzzzzz", "AKIA" + "A" * 16, "ghp_" + "a1" * 20, "sk_live_" + "9" * 20, "no_key", "Ünï cödé ſecret=abcdef", "ab" * 13, "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, " ".join(rnd.choice([*bits, "of", "the", "THE x-y"]) for _ in range(rnd.randrange(5)))) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    numbered = secrets.numbered_rows(df)
    index = {(r["segment"], r["gram"]): r["mask"] % 2**64 for r in secrets.build_index(numbered).collect()}
    want = {}
    for r in numbered.collect():
        low = r["text"].lower()
        for g in {low[i : i + 3] for i in range(len(low) - 2)}:
            if all("!" <= c <= "~" for c in g):
                want[r["segment"], g] = want.get((r["segment"], g), 0) | 1 << r["bit"]
    assert index == want
    plain = {}
    for i, text in rows:
        found = []
        for turn, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
                if len(m.group(rule.group)) >= rule.least:
                    found.append((m.start(), turn, m.end()))
        plain[i] = ",".join(f"{secrets.RULES[t].kind}:{a}:{b}" for a, t, b in sorted(found))
    assert {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()} == plain


def test_secrets_in_very_long_texts(spark):
    text = "plain words " * 200_000 + "token=abcdef12 " + "x" * 100_000
    got = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["spans"] == f"assign:{12 * 200_000}:{12 * 200_000 + 14}"


def test_quality_text_and_copies(docs):
    kept = {r["doc_id"]: r["text"] for r in quality.clean_documents(docs).collect()}
    assert kept[8] == LONG and 7 not in kept and None not in kept and quality.clean_documents(docs).columns == docs.columns
    assert {r["doc_id"] for r in exact_dedup.keep_largest(docs).where("text like 'The same%'").collect()} == {6}


@pytest.mark.parametrize("line, times, rule", [
    ("Home | About | Contact", 1, "navigation"), ("Accueil|Produits|Contact", 1, "navigation"), ("Start > Produkte > Preise", 1, "navigation"), ("• buy some milk", 1, ""),
    ("Il dit « non » et part.", 1, ""), ("This | is a sentence with one bar that goes on and ends.", 1, ""), ("a### b$$$ c%%% d&&&", 1, "punctuation"), ("BUY!! NOW!! ALL!! MUST!! GO!!", 1, "punctuation"),
    ("one two three four five six seven eight nine ten", 1, "punctuation"), ("one two three four five six seven eight nine ten.", 1, ""), ("A short heading", 1, ""), ("Lire la suite", 1, "boilerplate"),
    ("Datenschutz und Impressum", 1, "boilerplate"), ("POLÍTICA DE PRIVACIDAD", 1, ""), ("Volver arriba", 1, "boilerplate"), ("Seite drei", 4, "boilerplate"), ("Seite drei", 3, ""), ("Les.", 9, ""), ("", 9, ""),
])
def test_line_rules(line, times, rule):
    assert quality.line_fails(line.encode().split(), line.encode(), times) == rule


def test_one_row_of_each_text_stays(spark, none):
    rows = [(None, "a"), (None, "a"), (None, "b"), (3, "b"), (4, "c"), (4, "c"), (2, "c"), (4, "d"), (None, None), (None, ""), (7, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["text"] or "", r["doc_id"]) for r in exact_dedup.keep_largest(df).collect()), key=str)
    assert got == sorted([("a", None), ("b", 3), ("c", 4), ("d", 4), ("", None), ("e", 7)], key=str)
    assert exact_dedup.keep_largest(none).count() == 0


def test_pipeline_brute_force(spark):
    """Each stage against plain Python on the rows that its predecessor kept; the near-duplicate stage by 256-bit prints of all pairs."""
    stages, d = dict(corpus_pipeline.STAGES), real(spark)
    step = stages["quality_rules"](spark, d, SF)
    want = {r["doc_id"]: quality.judge(r["text"])[-1] for r in d.collect() if quality.judge(r["text"])[6]}
    assert {r["doc_id"]: r["text"] for r in step.collect()} == want
    last = {}
    for i, t in want.items():
        last[t] = max(i, last.get(t, i))
    want = {i: t for t, i in last.items()}
    exact = stages["exact_dedup"](spark, step, SF)
    assert {r["doc_id"]: r["text"] for r in exact.collect()} == want
    prints = {i: int.from_bytes(fingerprints.sketch(t, 5, 4)[0].tobytes(), "little") for i, t in want.items()}
    comp = components(set(prints.values()), 51)
    first = {}
    for i in want:
        first[comp[prints[i]]] = min(i, first.get(comp[prints[i]], i))
    near = stages["simhash_near_dedup"](spark, exact, SF)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(first.values()) and near.columns == d.columns
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_digest(near).collect()}
    assert {r["doc_id"]: r["count"] for r in stages["mix_sources"](spark, near, SF).groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    from tokenizers import Tokenizer

    tok, digests = Tokenizer.from_file(token_files.tokenizer_path(spark, "word_bpe_49k.json")), []
    for i, n in taken.items():
        ids = tok.encode(want[i], add_special_tokens=False).ids
        told = tok.decode(ids, skip_special_tokens=False)
        digests += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest())] * n
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(digests)


def test_pipeline_stages_take_odd_rows(docs, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(docs.sparkSession, none, SF).count() == 0
        out = stage(docs.sparkSession, docs, SF)
        assert out.count() <= 2 * len(ROWS) and (name == "bpe_round_trip" or out.columns == docs.columns)


@pytest.mark.parametrize("name", sorted(APPLY))
def test_long_texts_with_hits(spark, name):
    """Two documents of over a megabyte that hold something for each operator, one on a single line."""
    part = "token=abcdef1234 All rights reserved. Licensed under CC BY-SA 4.0 | a | b ünï " + "some plain words of a text, ok. " * 20
    rows = [(1, (part + "\n") * 1500, "en", "s", 1, "x", 1), (2, part * 1500, "en", "s", 1, "x", 1), (3, None, None, None, None, None, None)]
    got = {r["doc_id"]: r for r in APPLY[name](spark.createDataFrame(rows, KIND)).collect()}
    assert set(got) == {1, 2, 3}
    if name == "op10_secret_scan":
        assert got[1]["n_assign"] == got[2]["n_assign"] == 1500
    if name == "op3_license_scan":
        assert got[1]["n_base"] == got[2]["n_base"] == 3000 and "cc-by-sa" in got[2]["labels"]
    if name == "op9_line_dedup":
        assert (got[1]["n_removed"], got[2]["n_removed"]) == (1498 if got[1]["removed"] == "2-1499" else 1499, 0)


def test_pipeline_of_long_texts(spark, tmp_path):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(150_000)) + "."
    rows = [(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, text.replace("w17 ", "w18 "), "en", "s", len(text)), (4, "other " + text[::-1], "en", "t", len(text))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {2, 4}


def test_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    assert quality.judge(text)[4] == 200_000 and licenses.scan(text)[0] == 200_000 and fingerprints.fingerprint(text) == fingerprints.fingerprint(text.upper())
