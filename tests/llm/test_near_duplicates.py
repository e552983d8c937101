"""Links, components and kept rows of the near-duplicate operator against all pairs."""

import random

import numpy as np
import pytest

from sandglass.llm import fingerprints
from tests.llm.test_operators import KIND, components, real


def groups(edges, nodes):
    parent = {v: v for v in nodes}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    out = {}
    for v in nodes:
        out.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, out.values()))


def found(spark, values, **how):
    reps = spark.createDataFrame([(fingerprints.signed(v),) for v in values], "fp long")
    return [(r["a"] % 2**64, r["b"] % 2**64) for r in fingerprints.links(reps, **how).collect()]


@pytest.mark.parametrize("radius, bucket", [(0, 4), (1, 1024), (2, 1024), (2, 3), (3, 1024), (6, 64), (6, 1024)])
def test_links_lose_none(spark, radius, bucket):
    rnd = random.Random(radius)
    values = set()
    for _ in range(15):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            v = centre
            for b in rnd.sample(range(64), rnd.randrange(radius + 1)):
                v ^= 1 << b
            values.add(v)
    pairs = found(spark, values, radius=radius, bucket=bucket)
    assert all((a ^ b).bit_count() <= radius for a, b in pairs)
    want = components(values, radius)
    assert groups(pairs, values) == groups([(v, want[v]) for v in values], values)


def test_crowded_key_is_split(spark):
    rnd = random.Random(8)
    base = rnd.getrandbits(28)
    values = {base | rnd.getrandbits(36) << 28 for _ in range(5000)}
    values |= {v ^ 1 << 28 + rnd.randrange(36) for v in sorted(values)[:500]}
    fps = np.array(sorted(values), dtype=np.uint64)
    want = []
    for i in range(len(fps)):
        want += [(int(fps[i]), int(fps[i + 1 + j])) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2)]
    assert groups(found(spark, values), values) == groups(want, values)


def test_components_of_paths_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(1000, 1400)] + [(i, 7) for i in range(2000, 2050)] + [(1399, 5000)]
    got = {r["node"]: r["root"] for r in fingerprints.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 40 + 400 + 50 + 1
    assert all(got[i] == (100 if 100 <= i <= 140 else 7) for i in got)
    assert fingerprints.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = "A b c d e f g h", "q w e r t y u i o"
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (8, b, 4), (None, b, 5), (3, None, 6), (2, "", 7), (None, "x y", 8), (None, "x y", 9), (9, "p p p", 10), (9, "p p p", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag int").repartition(3)
    got = sorted((str(r["doc_id"]), r["text"]) for r in fingerprints.keep_one(df).collect())
    assert got == sorted([("1", a), ("5", b), ("2", ""), ("None", "x y"), ("9", "p p p")])
    assert fingerprints.keep_one(df).columns == df.columns
    assert fingerprints.keep_one(spark.createDataFrame([], KIND)).count() == 0


def test_similar_in_crowded_key(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    rows = []
    for c in centres:
        for _ in range(120):
            flips = np.zeros(256, np.uint8)
            flips[rnd.choice(256, 20, replace=False)] = 1
            rows.append((c ^ np.packbits(flips, bitorder="little").view(np.uint64)).tobytes())
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame([(bytearray(r), [1, 2]) for r in rows], "fp binary, keys array<long>")
    for bucket in (1024, 16):
        pairs = [(bytes(r["a"]), bytes(r["b"])) for r in fingerprints.similar_links(df, 4, 51, bucket).collect()]
        assert len(groups(pairs, rows)) == 6


def test_crowded_key_loses_no_pair(spark):
    """Pairs near each other and near nothing else in one crowded key, beside a large group: no lead is near most of them."""
    rnd = np.random.default_rng(7)

    def turned(value, count):
        flips = np.zeros(256, np.uint8)
        flips[rnd.choice(256, count, replace=False)] = 1
        return value ^ np.packbits(flips, bitorder="little").view(np.uint64)

    values = []
    for one in rnd.integers(0, 1 << 63, (150, 4), dtype=np.uint64) * np.uint64(2):
        values += [one, turned(one, 51)]
    centre = rnd.integers(0, 1 << 63, 4, dtype=np.uint64)
    values += [turned(centre, 20) for _ in range(200)]
    values += [turned(centre, 128) for _ in range(50)]
    rows = [v.tobytes() for v in values]
    near = np.bitwise_count(np.array(values)[:, None] ^ np.array(values)[None]).sum(axis=2, dtype=np.int64) <= 51
    want = groups([(rows[i], rows[j]) for i, j in zip(*np.nonzero(near)) if i < j], rows)
    df = spark.createDataFrame([(bytearray(r), [1, 2]) for r in rows], "fp binary, keys array<long>")
    for bucket in (1024, 32, 8):
        pairs = [(bytes(r["a"]), bytes(r["b"])) for r in fingerprints.similar_links(df, 4, 51, bucket).collect()]
        assert groups(pairs, rows) == want


def test_stage_finds_near_copies(spark):
    """Word edits in planted copies: all with a similarity of 0.8 or more on shingles of five words are in their source's group."""
    rnd = random.Random(1)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near = [], []
    for k in range(150):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(40, 400))]
        copy = [w if rnd.random() > 0.02 else "new" for w in words]
        one, two = shingles(words), shingles(copy)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        if len(one & two) >= 0.8 * len(one | two):
            near.append(k)
    marks = fingerprints.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {r["doc_id"]: r["first"]["doc_id"] for r in marks}
    assert len(near) > 50 and sum(first[2 * k + 1] == 2 * k for k in near) >= 0.95 * len(near)
    assert all(first[i] in (i, i - i % 2) for i in first)
    assert len(first) == 300 and real(spark).count() == fingerprints.similar_documents(real(spark)).count()
