"""Secret scans (operator 10): a trigram inverted index in front of the rules. DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived: those that every match must hold, as ANDs of
ORs. Rows are numbered once, in a stored copy, and 64 in a row form a segment. The index is a stored table of postings
(segment, trigram, mask): every trigram of printable ASCII without blanks that stands in a segment's lower-cased texts, with a
bit for each row that has it. One pass over a text finds all its trigrams, and as segments lie within a task, postings are
complete before they are shuffled. A query intersects and unites masks, 64 rows at a time; what remains are the
candidates of a rule, and the scan of the numbered rows verifies a rule only on its candidates. Rules without
mandatory trigrams scan every text. Masks of segments meet their rows in a join that Spark sizes itself.

Base kinds are assign, access and hex; the method adds its own kinds (private keys, other vendors' keys).

Defined cases: a null text counts as empty: no spans, the digest of the empty string; rows are scanned one by one, so repeated
rows repeat their result; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # of which least counts
    least: int
    base: bool


#: Patterns of the contract are fixed values; then the method's own kinds. Runs of hex digits are matched from 24 on, which
#: finds the same runs as matching all and dropping the shorter.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 1, False),
)
_MOST = 24


def literals(tree) -> tuple[set[str] | None, list[frozenset[str]]]:
    """(the strings it can be, None if too many; ORs of strings of which each match holds one)."""
    exact: set[str] | None = {""}
    musts: list[frozenset[str]] = []

    def close() -> None:
        nonlocal exact
        if exact and min(map(len, exact)) >= 3:
            musts.append(frozenset(exact))
        exact = {""}

    def follow(more: set[str] | None) -> None:
        nonlocal exact
        if more is None or exact is None or len(exact) * len(more) > _MOST:
            close()
            exact = more if more else {""}
        else:
            exact = {a + b for a in exact for b in more}

    ended = True
    for kind, arg in tree:
        if kind is op.LITERAL:
            follow({chr(arg)})
        elif kind is op.SUBPATTERN:
            inner, own = literals(arg[3])
            musts += own
            if inner is None:
                close()
                ended = False
            else:
                follow(inner)
        elif kind is op.BRANCH:
            parts = [literals(p) for p in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MOST:
                follow(set().union(*(e for e, _ in parts)))
            else:
                close()
                ended = False
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 5:
            follow({chr(v) for _, v in arg})
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            one, own = literals(inner)
            if low:
                musts += own
            if (low, high) == (0, 1) and one is not None:
                follow({"", *one})
            elif low == high and low <= 8 and one is not None:
                for _ in range(low):
                    follow(one)
            else:
                close()
                ended = False
        elif kind is not op.AT:
            close()
            ended = False
    if ended:
        return exact, musts
    close()
    return None, musts


#: Trigrams that the index holds: printable ASCII without blanks, in lower case.
GRAM = r"(?=([!-@\[-~]{3}))"


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs of lower-cased trigrams that every match holds; [] if there are none."""
    exact, musts = literals(parser.parse(pattern))
    if exact is not None and min(map(len, exact)) >= 3:
        musts = [*musts, frozenset(exact)]
    query = []
    for alternatives in musts:
        low = sorted({a.lower() for a in alternatives})
        clause = [sorted({a[i : i + 3] for i in range(len(a) - 2) if re.match(GRAM, a[i : i + 3])}) for a in low]
        if all(clause):
            query.append(clause)
    return query


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, segment, bit), stored, so that index and scan agree on the numbers."""
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), number.alias("n"))
    return stored(rows.select("doc_id", "text", F.shiftright("n", 6).alias("segment"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("bit")), "numbered")


def build_index(rows: DataFrame) -> DataFrame:
    """Stored postings (segment, gram, mask) of rows(text, segment, bit): all trigrams, whatever the rules."""
    grams = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(GRAM), F.lit(1)))
    each = rows.select("segment", F.expr("shiftleft(1L, bit)").alias("mask"), F.explode(grams).alias("gram"))
    return stored(each.groupBy("segment", "gram").agg(F.bit_or("mask").alias("mask")), "trigram-index")


def candidates(index: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(segment, m0, m1, ...): masks of the rows whose postings satisfy each rule's query; segments without any are left out."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    named = sorted({g for q in queries for clause in q for grams in clause for g in grams})
    held = F.map_from_entries(F.collect_list(F.struct("gram", "mask")))  # an entry for each trigram that the rules name
    found = index.where(F.col("gram").isin(named)).groupBy("segment").agg(held.alias("held"))
    mask = lambda g: F.coalesce(F.try_element_at("held", F.lit(g)), F.lit(0).cast("long"))
    both, either = (lambda a, b: a.bitwiseAND(b)), (lambda a, b: a.bitwiseOR(b))
    masks = [reduce(both, [reduce(either, [reduce(both, map(mask, grams)) for grams in clause]) for clause in q]).alias(f"m{i}") for i, q in enumerate(queries) if q]
    some = reduce(either, [F.col(f"m{i}") for i, q in enumerate(queries) if q])
    return stored(found.select("segment", *masks).where(some != 0), "candidates")


def spans_of(rule: Rule, turn: int, text: Column) -> Column:
    """Array of (start, turn, end) of a rule's matches, leftmost and non-overlapping, in code points.

    What lies between the matches gives their places: split and extract walk the text alike.
    """
    java = rule.pattern
    between = F.transform(F.split(text, java, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(java), F.lit(rule.group)) if rule.group else whole
    both = F.zip_with(whole, counted, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("g")))
    steps = F.zip_with(F.slice(between, 1, F.size(both)), both, lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["g"].alias("g")))
    empty = F.array().cast("array<struct<start:int,turn:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def take(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["n"]
        found = F.array(F.struct(begin.alias("start"), F.lit(turn).alias("turn"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["g"] >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, take, lambda acc: acc["out"])


def scan_secrets(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = numbered_rows(docs)
    flagged = rows.join(candidates(build_index(rows), rules), "segment", "left")
    none = F.array().cast("array<struct<start:int,turn:int,end:int>>")
    text = F.col("text")
    columns = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            there = F.expr(f"coalesce(shiftrightunsigned(m{i}, bit) & 1L, 0L) != 0L")
        else:
            there = text.rlike(rule.pattern)
        columns.append(F.when(there, spans_of(rule, i, text)).otherwise(none).alias(f"s{i}"))
    spans = flagged.select("doc_id", *columns)
    names = F.array(*[F.lit(r.kind) for r in rules])
    show = lambda arr: F.array_join(F.transform(F.array_sort(arr), lambda x: F.concat_ws(":", F.element_at(names, x["turn"] + 1), x["start"], x["end"])), ",")
    base = F.concat(*[F.col(f"s{i}") for i, r in enumerate(rules) if r.base])
    return spans.select(
        "doc_id",
        *[F.size(f"s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base],
        F.sha2(show(base), 256).alias("base_sha256"),
        show(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("spans"),
    )
