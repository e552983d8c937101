"""The pruned name join against every pair scored."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandglass.functions import fuzzy, similarity
from sandglass.operators import matching
from sandglass.plans import registry

WORDS = "daily news politics hour left right radio live talk report american morning with of jane smith nation union free straße 日本 ok o k a".split()
COLUMNS = {"edit": fuzzy.edit_ratio, "composite": fuzzy.composite_ratio}


def some(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 7))) + (f" {rng.randint(0, 30)}" if rng.random() < 0.4 else "") for _ in range(n)]


def every_pair(names, labels, score):
    """Best two by scoring all pairs."""
    pairs = names.where("norm <> ''").crossJoin(labels.where("label is not null and norm is not null").withColumnRenamed("norm", "label_norm")).withColumn("s", score(F.col("norm"), F.col("label_norm")))
    ranked = pairs.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("s"), "label", "value"))).where("r <= 2")
    found = {n["id"]: [None, None] for n in names.collect()}
    for r in ranked.collect():
        found[r["id"]][r["r"] - 1] = (r["s"], r["label"], r["value"], r["label_norm"])
    return found


def found(top):
    return {r["id"]: [None if x is None else (-x["neg"], x["label"], x["value"], x["label_norm"]) for x in (r["a"], r["b"])] for r in top.collect()}


@pytest.mark.parametrize("score", sorted(COLUMNS))
@pytest.mark.parametrize("most", [(matching.NAMES, matching.LABELS), (5, 60)])
def test_best_two_of_all_pairs(spark, score, most):
    names = [(i, n) for i, n in enumerate(some(40, 1) + ["", None, "x", "b" * 70 + " radio", "日本 ok", "daily news", "daily news"])]
    labels = [(f"l{i:03d}", f"v{i % 3}", n) for i, n in enumerate(some(150, 2) + ["", "daily news", "daily news", "daily news", "c" * 300 + " radio", "radio " * 60])]
    labels += [(None, "v", "radio"), ("none", "v", None)]
    one, two = spark.createDataFrame(names, "id int, norm string"), spark.createDataFrame(labels, "label string, value string, norm string").repartition(3)
    assert found(matching.top2(one, two, score, most)) == every_pair(one, two, COLUMNS[score])


def test_no_labels_and_no_names(spark):
    names, labels = spark.createDataFrame([(1, "radio")], "id int, norm string"), spark.createDataFrame([("a", "v", "radio")], "label string, value string, norm string")
    assert found(matching.top2(names, labels.limit(0))) == {1: [None, None]}
    assert found(matching.top2(names, labels)) == {1: [(100.0, "a", "v", "radio"), None]}
    assert matching.top2(names.limit(0), labels).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é日 ", max_size=12), min_size=1, max_size=25), st.text(alphabet="ab é日 ", min_size=1, max_size=12))
def test_bounds_never_leave_out_a_winner(labels, name):
    for kind, score in similarity.SCORES.items():
        block = similarity.Block(list(range(len(labels))), labels, kind)
        assert block.best_two(name) == sorted(((score.exact(name, n), i) for i, n in enumerate(labels)), key=lambda x: (-x[0], x[1]))[:2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc日", max_size=90), st.text(alphabet="abc日", max_size=90))
def test_edit_distance_by_bits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert similarity.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("score", sorted(COLUMNS))
def test_few_pairs_are_scored_on_the_test_tables(spark, score):
    sf = "/root/testdata/sf0.1"
    labels = registry.label_table(spark, sf).orderBy("label").collect()
    names = [r["norm"] for r in registry.names(spark, sf).orderBy("id").limit(60).collect()]
    block = similarity.Block([r["label"] for r in labels], [r["norm"] for r in labels], score)
    for n in names:
        block.best_two(n)
    assert block.scored < 0.02 * len(names) * len(labels)
