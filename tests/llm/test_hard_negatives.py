"""Hard negatives against all scores worked out pair by pair."""

import duckdb
import numpy as np
import pytest

from sandglass.llm import hard_negatives as hn
from sandglass.llm import registry
from sandglass.llm.oracles import ORACLES

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>, label int, uid long, score string"


def expected(rows):
    """(anchor, positive, rank, negative, scores), each a row of every anchor row."""
    kept = []
    for n, (vec_id, vec, label, *_) in enumerate(rows):
        if label is None or vec is None or any(x is None or not np.isfinite(np.float32(x)) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((n, vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vec], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for n, anchor, vec, label in kept:
        if anchor is None or anchor % 50:
            continue
        scored = sorted(((-score(vec, v), last(i), m, i, own) for m, i, v, own in kept if m != n))
        for p, _, _, positive, _ in [x for x in scored if x[4] == label][:5]:
            window = [x for x in scored if x[4] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(anchor, positive, r, x[3], -p, -x[0]) for r, x in enumerate(window, 1)]
    return sorted(out, key=str)


def held(df, rows):
    assert sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str) == expected(rows)


def made(n=900, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6) * 0.4], int(rng.integers(0, 4)), None, "clash") for i in range(n)]
    rows += [(50, None, 1, 1, None), (100, [1.0], None, None, None), (150, [1.0, None], 2, None, None), (200, [float("nan")], 2, None, None), (250, [float("inf"), 1.0], 2, None, None)]
    rows += [rows[50]] * 3 + [(None, rows[51][1], 3, None, None), (2000, [], 0, None, None), (2050, [0.5], 1, None, None), (2100, [-1.0] * 6, 9, None, None)]
    rows += [(3000 + i, [0.25] * 6, i % 2, None, None) for i in range(40)]
    return rows


@pytest.mark.parametrize("how", [{}, {"block": 100, "anchor_block": 7, "pivots": 3}])
def test_against_all_pairs(spark, how):
    rows = made()
    held(hn.hard_negatives(spark.createDataFrame(rows, KIND).repartition(5), **how), rows)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float((i * 7919) % 1000) * 1000, -float(i) * 900], i % 3, None, None) for i in range(60)]
    held(hn.hard_negatives(spark.createDataFrame(rows, KIND)), rows)
    assert hn.hard_negatives(spark.createDataFrame([], KIND)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1, None, None)], KIND)).count() == 0


def test_brackets_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    vecs = rng.integers(-200, 200, (2000, 3))
    reach = float((vecs * vecs).sum(1).max())
    points = hn.augment(vecs, reach)
    assert np.allclose((points**2).sum(1), reach)
    pivots = points[:24]
    for i in (7, 11, 500):
        query, factor = hn.query_points(vecs[i : i + 1], reach)
        low, high = hn.brackets(hn.distances(query, pivots)[0], factor[0], hn.distances(points, pivots), reach)
        score = vecs @ vecs[i]
        assert (low <= score).all() and (score <= high).all()
        assert (high < hn.nth(low, 5)).mean() > 0.5
    low, high = hn.brackets(np.zeros(24), 0.0, hn.distances(points, pivots), reach)
    assert not low.any() and not high.any()


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = registry.queries()["op12_hard_negatives"](spark, SF)
    cols = sorted(got.columns)
    assert got.count() > 0 and sorted(map(tuple, got.select(cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op12_hard_negatives']})").fetchall())
