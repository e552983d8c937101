"""License scans (operator 3): fuzzy search for short notices.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters; a text is searched as its words
joined by spaces. Base phrases are found exactly. A notice is a phrase whose words in brackets tell licenses apart (names,
version numbers): these must stand there exactly, and edits are allowed in the parts between them only. The longest part
with k edits allowed is split into k + 1 pieces, of which one stays whole (pigeonhole), so exact hits of pieces
(Aho-Corasick) give the places where a match may begin: with k edits in all, a hit leaves 2k + 1 of them, and only those that
begin a word count. For each, once, one pass over the notice's length gives the edits to the end of every word that a match could
reach; where they are few enough, the regex library's bounded-error matching verifies the text between and counts its edits. (It is asked
for a match of all of that text: after a fuzzy group it takes lookaheads back too late and loses matches.) Of overlapping spans of one
notice the one with fewer edits is told.
A part too short for an edit is a seed as it is. For Creative Commons, the words after a match (nc, sharealike, ...) are read
exactly and complete the label. Work is linear in the text: a verification reads no more than a notice's length and its edits.

Defined cases: null and empty texts have no words, no labels and score 0; rows are judged one by one, so repeated
rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed values of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices, as words joined by spaces (those in brackets exact), and the label that each gives.
NOTICES = (
    ("released under the [mit] license", "mit"),
    ("[the mit license]", "mit"),
    ("[mit license]", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the [apache] license version [2 0]", "apache-2.0"),
    ("[apache] license version [2 0]", "apache-2.0"),
    ("[apache license 2 0]", "apache-2.0"),
    ("[apache] license version [1 1]", "apache-1.1"),
    ("[apache] license version [1 0]", "apache-1.0"),
    ("[isc license]", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("[bsd 2 clause]", "bsd-2-clause"),
    ("[bsd 3 clause]", "bsd-3-clause"),
    ("[bsd license]", "bsd"),
    ("[gnu] general public license", "gpl"),
    ("[gnu gpl]", "gpl"),
    ("[gpl v2]", "gpl"),
    ("[gpl v3]", "gpl"),
    ("[gplv2]", "gpl"),
    ("[gplv3]", "gpl"),
    ("[gnu lesser] general public license", "lgpl"),
    ("[gnu library] general public license", "lgpl"),
    ("[gnu lgpl]", "lgpl"),
    ("[gnu affero] general public license", "agpl"),
    ("[gnu agpl]", "agpl"),
    ("[gnu free] documentation license", "gfdl"),
    ("[mozilla] public license", "mpl"),
    ("[eclipse] public license", "epl"),
    ("[boost] software license", "bsl"),
    ("[artistic license]", "artistic"),
    ("[zlib license]", "zlib"),
    ("this is free and [unencumbered] software released into the public domain", "unlicense"),
    ("[apache 2 0]", "apache-2.0"),
    ("[gpl 2 0]", "gpl"),
    ("[gpl 3 0]", "gpl"),
    ("[lgplv2]", "lgpl"),
    ("[lgplv3]", "lgpl"),
    ("[lgpl 2 1]", "lgpl"),
    ("[lgpl 3 0]", "lgpl"),
    ("[agplv3]", "agpl"),
    ("[agpl 3 0]", "agpl"),
    ("[mpl 2 0]", "mpl"),
    ("[epl 2 0]", "epl"),
    ("[bsl 1 0]", "bsl"),
    ("[spdx license identifier mit]", "mit"),
    ("[spdx license identifier isc]", "isc"),
    ("[spdx license identifier zlib]", "zlib"),
    ("[spdx license identifier unlicense]", "unlicense"),
    ("[creative commons by]", "cc-by"),
    ("[cc by]", "cc-by"),
    ("[cc0]", "cc0"),
    ("creative commons [zero]", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
#: Words after a Creative Commons label that complete it, longest first.
COMPLETES = (("non commercial", "nc"), ("no derivatives", "nd"), ("no derivs", "nd"), ("share alike", "sa"), ("noncommercial", "nc"), ("noderivatives", "nd"), ("noderivs", "nd"), ("sharealike", "sa"), ("nc", "nc"), ("nd", "nd"), ("sa", "sa"))
ERRORS_PER_CHAR = 0.1
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """(offset, text) of errors + 1 parts of nearly equal length."""
    n, k = len(phrase), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def parts_of(notice: str, per_char: float) -> list[tuple[str, int]]:
    """(text, edits allowed) of a notice's parts; those in brackets allow none. Joined, they are the notice."""
    out = []
    for exact, loose in re.findall(r"\[([^\]]*)\]|([^\[\]]+)", notice):
        out.append((exact or loose, 0 if exact else int(len(loose.strip()) * per_char)))
    return out


def places(phrase: str) -> dict[str, int]:
    """The letters' places in a phrase, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(phrase):
        out[c] = out.get(c, 0) | 1 << i
    return out


def near_ends(where: dict[str, int], n: int, k: int, text: str, at: int) -> list[tuple[int, int]]:
    """(edits, end) of the ends of words up to which the text from ``at`` is within k edits of a phrase of n letters, fewest first.

    One column of the table of edit distances at a time, as two bit vectors; it ends where k is out of reach.
    """
    every, last = (1 << n) - 1, 1 << n - 1
    up, down, d, out = every, 0, n, []
    stop = min(len(text), at + n + k)
    for j in range(at, stop):
        eq = where.get(text[j], 0)
        flat = ((eq & up) + up ^ up) | eq
        eq |= down
        rise, fall = down | (every & ~(flat | up)), up & flat
        if rise & last:
            d += 1
        elif fall & last:
            d -= 1
        if d <= k:
            if j + 1 == len(text) or text[j + 1] == " ":
                out.append((d, j + 1))
        elif d - (stop - j - 1) > k:
            break
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | (every & ~(eq | rise)), rise & eq
    return sorted(out)


@lru_cache(maxsize=4)
def machine(notices: tuple, per_char: float):
    import ahocorasick
    import regex

    seeds: dict[str, list] = {}
    rules = []
    for i, (notice, label) in enumerate(notices):
        parts = parts_of(notice, per_char)
        shown = [regex.escape(text) if not k else rf"(?:{regex.escape(text)}){{e<={k}}}" for text, k in parts]
        whole, errors = "".join(text for text, _ in parts), sum(k for _, k in parts)
        rules.append((regex.compile(rf"(?b){''.join(shown)}"), whole, places(whole), errors, label))
        best = max(range(len(parts)), key=lambda j: len(parts[j][0]) / (parts[j][1] + 1))
        lead = sum(len(text) for text, _ in parts[:best])
        for off, piece in pieces(*parts[best]):
            seeds.setdefault(piece, []).append((i, lead + off))
    auto = ahocorasick.Automaton()
    for piece, where in seeds.items():
        auto.add_word(piece, (len(piece), tuple(where)))
    auto.make_automaton()
    return auto, rules


def completed(joined: str, end: int, label: str) -> tuple[int, str]:
    """(end, label) of a Creative Commons match with the words after it that complete the label."""
    marks: list[str] = []
    while True:
        for words, mark in COMPLETES:
            stop = end + 1 + len(words)
            if joined.startswith(" " + words, end) and (stop == len(joined) or joined[stop] == " "):
                end = stop
                marks += [mark] if mark not in marks else []
                break
        else:
            return end, "-".join([label, *marks])


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) without those that overlap one with fewer edits, or with as many and an earlier start."""
    kept: list[tuple[int, int, int]] = []
    for a, b, edits in sorted(spans, key=lambda x: (x[2], x[0], x[1])):
        at = bisect_right(kept, (a, b, edits))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
            kept.insert(at, (a, b, edits))
    return kept


def fuzzy_spans(joined: str, notices: tuple = NOTICES, per_char: float = ERRORS_PER_CHAR) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) in characters of the joined words, by start."""
    auto, rules = machine(notices, per_char)
    begins: dict[int, set[int]] = {}  # of each notice: places where words begin and a match may
    for end, (length, where) in auto.iter(joined):
        start = end - length + 1
        for i, off in where:
            k, own = rules[i][3], begins.setdefault(i, set())
            for at in range(max(0, start - off - k), min(len(joined), start - off + k + 1)):
                if at == 0 or joined[at - 1] == " ":
                    own.add(at)
    found = set()
    for i, own in begins.items():
        pattern, whole, where, k, label = rules[i]
        spans = []
        for at in own:
            for _, end in near_ends(where, len(whole), k, joined, at):
                m = pattern.fullmatch(joined, at, end)
                if m:
                    spans.append((at, end, sum(m.fuzzy_counts)))
                    break
        for a, b, edits in apart(spans):
            b, told = completed(joined, b, label) if label == "cc-by" else (b, label)
            found.add((a, b, told, edits))
    return sorted(found)


def scan(text: str | None, notices: tuple = NOTICES, per_char: float = ERRORS_PER_CHAR) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
    words = _WORD.findall((text or "").encode().lower().decode())
    if not words:
        return 0, 0, None, None, "", "", 0.0, ""
    joined = " ".join(words)
    framed = f" {joined} "
    hits = []
    for phrase, label in BASE.items():
        at = framed.find(f" {phrase} ")
        while at >= 0:
            hits.append((at, label))
            at = framed.find(f" {phrase} ", at + 1)
    spans = fuzzy_spans(joined, notices, per_char)
    if not hits and not spans:
        return len(words), 0, None, None, "", "", 0.0, ""
    begins = list(accumulate((len(w) + 1 for w in words), initial=0))
    word_at = lambda place: bisect_right(begins, place) - 1
    starts = [word_at(at) for at, _ in hits]
    covered, shown = set(starts), []
    for a, b, label, edits in spans:
        first, end = word_at(a), word_at(b - 1) + 1
        covered.update(range(first, end))
        shown.append(f"{label}:{first}:{end}:{edits}")
    base = {label for _, label in hits}
    labels = base | {s[2] for s in spans}
    score = min(1.0, len(covered) / len(words))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(shown)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string"
)


def scan_licenses(docs: DataFrame, notices: tuple = NOTICES, per_char: float = ERRORS_PER_CHAR) -> DataFrame:
    """One row per document; spans are label:first word:end word:edits. No shuffle."""

    def rows(ids, texts):
        found = [scan(t, notices, per_char) for t in texts]
        return [ids, *([list(c) for c in zip(*found)] if found else [[]] * 8)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, SCHEMA)
