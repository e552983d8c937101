"""Best two labels by keys: the same as of all pairs, and no search of all pairs where two near labels are there."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandglass.functions.shipping import ship
from sandglass.operators import matching, near
from sandglass.plans import registry

from .test_similarity import COLUMNS, every_pair, found

KINDS = ["composite", "edit"]


def tables(spark, names, labels):
    one = spark.createDataFrame(list(enumerate(names)), "id int, norm string")
    two = spark.createDataFrame([(f"l{i * 7919 % len(labels):04d}", f"v{i % 3}", n) for i, n in enumerate(labels)], "label string, value string, norm string")
    return one, two.repartition(3)


def changed(rng, text, letters):
    text = list(text)
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
        i = rng.randrange(len(text) + 1)
        text[i : i + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
    words = "".join(text).split(" ")
    if rng.random() < 0.2:
        rng.shuffle(words)
        words += words[: rng.randint(0, 1)]
    return " ".join(words)


@pytest.mark.parametrize("kind", KINDS)
def test_numbered_names_need_no_search_of_all_pairs(spark, kind):
    """Names as those of the test tables: each has its own label and many that differ in one digit."""
    names, labels = tables(spark, [f"supplier {i:09d}" for i in range(0, 300, 4)], [f"supplier {i:09d}" for i in range(700)])
    top = matching.top2(names, labels, kind)
    assert "CoGroup" not in top._jdf.queryExecution().toString()
    assert found(top) == every_pair(names, labels, COLUMNS[kind])


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("letters", ["ab 1", "0123456789", "日é x\x1c "])
def test_settled_names_are_those_of_all_pairs(spark, kind, letters):
    rng = random.Random(letters)
    base = ["".join(rng.choices(letters, k=n)) for n in (1, 2, 5, 9, 16, 30, 63, 64, 66)] + ["news radio 12", "radio news", "radio 123456789 live", "radio"]
    draw = lambda n: [changed(rng, rng.choice(base), letters) for _ in range(n)]
    names, labels = tables(spark, [*draw(90), *base], [*draw(250), *base, *base[:4], "", "radio news 123456789 live x"])
    want = every_pair(names, labels, COLUMNS[kind])
    assert found(matching.top2(names, labels, kind)) == want
    ship(spark)
    two_of_each = labels.withColumn("r", F.row_number().over(W.partitionBy("norm").orderBy("label", "value"))).where("r <= 2").drop("r")
    known = names.join(near.settled(names.where("norm <> ''").select("norm").distinct(), two_of_each, kind), "norm").select("id", "a", "b")
    got = found(known)
    assert len(got) > 10 and got == {i: want[i] for i in got}


def test_match_status_counts_without_a_search_of_all_pairs(spark):
    counted = registry.queries()["match_status"](spark, "/root/testdata/sf0.01")
    assert "CoGroup" not in counted._jdf.queryExecution().toString()
    assert [tuple(r) for r in counted.collect()] == [("matched", 100)]
