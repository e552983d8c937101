"""Fuzzy notices with text before and behind them, their spans, and what near misses cost."""

import random
import re
import time

import pytest

from sandglass.llm import licenses

COPY = "permission is hereby granted free of charge to any person obtaining a"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("before, behind", [("", ""), ("", " permission"), ("this software", ""), ("a b c", " permission to use"), ("", " " + COPY), (COPY, " permission")])
def test_what_stands_around_a_notice_takes_nothing_from_it(before, behind):
    text = f"{before} {COPY}{behind}".strip()
    spans = [s for s in licenses.fuzzy_spans(text) if s[2] == "mit"]
    assert len(spans) == text.count(COPY) and all(text[a:b] == COPY and edits == 5 for a, b, _, edits in spans)


def test_spans_are_the_best_of_plain_edit_distance():
    rnd = random.Random(8)
    loose = [(n, label) for n, label in licenses.NOTICES if "[" not in n and label != "cc-by"]
    for turn in range(80):
        notice, label = loose[turn % len(loose)]
        k, chars = int(len(notice) * licenses.ERRORS_PER_CHAR), list(notice)
        for _ in range(rnd.randrange(k + 2)):
            at, what = rnd.randrange(len(chars)), rnd.randrange(3)
            chars[at : at + (what < 2)] = [] if what == 0 else [rnd.choice("aeix")]
        around = ["of", "the", "quick", "a", "permission", "software"]
        text = " ".join([*rnd.choices(around, k=rnd.randrange(4)), *"".join(chars).split(), *rnd.choices(around, k=rnd.randrange(4))])
        ends = [m.end() for m in re.finditer(r"[^ ]+", text)]
        begins = [m.start() for m in re.finditer(r"[^ ]+", text)]
        best = min((distance(notice, text[a:b]) for a in begins for b in ends if b > a and abs(b - a - len(notice)) <= k), default=k + 1)
        got = licenses.fuzzy_spans(text, ((notice, label),))
        assert bool(got) == (best <= k), text
        if got:
            a, b, _, edits = min(got, key=lambda s: s[3])
            assert edits == best == distance(notice, text[a:b])


def test_overlapping_spans_keep_the_one_with_fewer_edits():
    assert licenses.apart([(0, 10, 3), (5, 15, 1), (15, 20, 2), (18, 30, 2)]) == [(5, 15, 1), (15, 20, 2)]


@pytest.mark.parametrize("text, label", [
    ("Licensed under the Apache-2.0 license", "apache-2.0"), ("SPDX-License-Identifier: MIT", "mit"), ("GPL-3.0", "gpl"), ("LGPL-2.1", "lgpl"), ("AGPLv3", "agpl"),
    ("Creative Commons BY-NC-SA", "cc-by-nc-sa"), ("MPL-2.0", "mpl"), ("apache 2", ""), ("gpl", ""),
])
def test_short_names(text, label):
    assert licenses.scan(text)[5] == label


def test_a_megabyte_of_near_misses_is_scanned_at_once():
    miss = "permission was herebx granted freed of chargeable to any personal obtaining "
    text = miss * (1_000_000 // len(miss))
    start = time.process_time()
    assert licenses.scan(text)[5] == ""
    assert time.process_time() - start < 20  # 3 seconds on an idle machine; half an hour by merged windows
