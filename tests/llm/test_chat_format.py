"""Chat formatting: round trips over texts made of marks, and digests against plain Python and SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sandglass.llm import chat_format as cf
from sandglass.llm import registry
from sandglass.llm.oracles import ORACLES

SF = "/root/testdata/sf0.01"
KIND = "conv_id long, turn long, role string, text string, marks string, pieces int"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:746F6F6C]", "[/ROLE]", "\\", "<", "[", "<\\/s>", "[\\\\INST]", "s>", "/INST]", "$1", " ", "\n", "ok", "é😀", "]", ">"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    chats = {}
    for conv, turn, role, text, *_ in rows:
        chats.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, own in chats.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_texts_made_of_marks(spark):
    rng = random.Random(4)
    texts = ["".join(c) for n in (1, 2) for c in itertools.product(BITS, repeat=n)] + ["".join(rng.choices(BITS, k=rng.randint(3, 12))) for _ in range(1500)]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", "", None, "<s>"]), t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert sorted((tuple(r)[:5] for r in cf.chat_digest(df).collect()), key=str) == expected(rows)
    # no mark of the grammar is left in a text, and none of an unescaped conversation was touched
    marks = {r["conv_id"]: r["formatted"] for r in cf.format_chats(df).collect()}
    for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        assert len(re.findall(cf.TOKEN, marks[conv])) == 2 * len(own)
        if not any(re.search(cf.PLAIN, r[3]) for r in own):
            assert all(r[3] in marks[conv] for r in own)


def test_odd_rows(spark):
    rows = [(1, None, "user", None, None, None), (1, 0, None, "a", None, None), (1, 0, None, "a", None, None), (None, 3, "assistant", "no id", None, None), (None, 1, "user", "", None, None)]
    rows += [(2, i, ("user", "assistant")[i % 2], f"text {i} " * 40 + "</s>" * (i % 7 == 0), None, None) for i in range(3000)] + [(3, 0, "assistant", "[INST" + "x<" * 600_000, None, None)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted((tuple(r)[:5] for r in cf.chat_digest(df).collect()), key=str) == expected(rows)
    assert cf.chat_digest(spark.createDataFrame([], KIND)).count() == 0
    assert [r["conv_id"] for r in cf.chat_digest(cf.with_case(spark.createDataFrame([], KIND))).collect()] == [-7]


@pytest.mark.parametrize("text", ["<s>a", "<s>a</s>b", "[INST]a</s>", "<s>a</s>[/INST]", "x", "<s><s>a</s></s>"])
def test_what_is_no_chat_is_not_read(spark, text):
    df = cf.with_pieces(spark.createDataFrame([(text,)], "t string"), "t")
    assert df.select(cf.parse(F.col("marks"), F.col("pieces"))).first()[0] is None


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = registry.queries()["op13_chat_format"](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op13_chat_format']})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want) and len(want) == 101
