"""Quality rules (operator 1): line-first cleaning.

Every line is judged by punctuation, navigation and boilerplate rules (see ``line_fails``), which look at a line's shape rather
than its language; failing lines are removed and a document that loses more than ``max_loss`` of its word characters is
rejected. The base statistics (words, symbols, repeated lines and windows) are computed over the whole text and decide
base_failed.

Defined cases: a null text counts as an empty one (no words, base_failed); a text of blanks has no words;
repeated rows are judged alike and all stay or go; extra columns pass through clean_documents untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, parts, ship

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOSS = 0.5

RULES = ("punctuation", "navigation", "boilerplate")
#: Words from which on a line must close with a mark, in texts where half of the lines do; shorter ones may be headings.
OPEN_LINE_WORDS = 10
#: Phrases of page furniture in English, German, French and Spanish, matched in short lines only.
PHRASES = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "accept all cookies", "accept cookies", "click here", "read more", "subscribe now", "subscribe to our",
    "sign up now", "sign up for our", "log in", "share this", "back to top", "follow us on", "skip to content", "cookie-richtlinie", "datenschutz", "nutzungsbedingungen", "impressum",
    "cookies akzeptieren", "hier klicken", "weiterlesen", "jetzt abonnieren", "newsletter anmelden", "nach oben", "politique de confidentialité", "mentions légales", "conditions d'utilisation",
    "accepter les cookies", "cliquez ici", "lire la suite", "abonnez-vous", "se connecter", "haut de page", "política de privacidad", "aviso legal", "términos de uso", "aceptar cookies",
    "haga clic aquí", "leer más", "suscríbete", "iniciar sesión", "volver arriba",
)
BOILERPLATE = re.compile(rb"\b(?:" + b"|".join(re.escape(p.encode()) for p in PHRASES) + rb")(?![a-z0-9_])")
SHORT_LINE_WORDS = 12
#: Times that a short line of two words or more must stand in one text to count as its furniture.
FURNITURE_TIMES = 4
CLOSING = ".!?…:;\"')]»”’。！？"
_CLOSING = tuple(c.encode() for c in CLOSING)
_MARKED = re.compile("[#*$%&|<>»•·]|!!|\\?\\?".encode())
_DOUBLED = re.compile(rb"(?:!!|\?\?)$")
_LEADING = re.compile("^(?:[ \t-\r|<>]|»|•|·)+".encode())
_ONLY_SEPARATORS = re.compile("^(?:[|<>]|»|•|·)+$".encode())
_ARROWS = re.compile("^(?:[<>]|»)+$".encode())


def line_fails(words: list[bytes], line: bytes, times: int = 1, closes: bool = True) -> str:
    """The first rule that a line fails ('' for none).

    ``times`` is how often it stands in its text, ``closes`` whether half of the text's lines with a word close with a mark.

    punctuation: with 4 words or more, as many symbols as words, or half of the words ending in doubled marks; with
    ``OPEN_LINE_WORDS`` or more, no closing mark at the end though the text closes its lines. navigation: a menu, that is separators after the first word (|, •, ·
    anywhere, arrows as words of their own) and at most two words an item. boilerplate: a short line with a phrase of page
    furniture, or one of two words or more that stands ``FURNITURE_TIMES`` times.
    """
    n = len(words)
    if not n:
        return ""
    if _MARKED.search(line):
        rest = _LEADING.sub(b"", line)
        apart = rest.count(b"|") + rest.count("•".encode()) + rest.count("·".encode())
        if "«".encode() not in line:
            apart += sum(1 for w in rest.split() if _ARROWS.match(w))
        if apart and sum(1 for w in words if not _ONLY_SEPARATORS.match(w)) <= 2 * (apart + 1):
            return "navigation"
        if n >= 4 and sum(line.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) >= n:
            return "punctuation"
        if n >= 4 and 2 * sum(1 for w in words if _DOUBLED.search(w)) >= n:
            return "punctuation"
    if closes and n >= OPEN_LINE_WORDS and not words[-1].endswith(_CLOSING):
        return "punctuation"
    if n <= SHORT_LINE_WORDS and (n >= 2 and times >= FURNITURE_TIMES or BOILERPLATE.search(line.lower())):
        return "boilerplate"
    return ""


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more (first one included).

    Windows are named exactly by doubling: equal pairs of equal halves get equal names.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict = {}
    name = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = name[: len(name) - step] * (int(name.max()) + 1) + name[step:]
        _, name = np.unique(pair, return_inverse=True)
        width += step
    counts = np.bincount(name)
    hit = counts[name] >= 2
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def judge(text: str | None, max_loss: float = MAX_LOSS) -> tuple:
    """SCORES without doc_id, then the cleaned text."""
    text = text or ""
    raw = text.encode()
    words: list[bytes] = []
    kept_lines, lines = [], raw.split(b"\n")
    times, split = Counter(lines), [line.split() for line in lines]
    closed = [own[-1].endswith(_CLOSING) for own in split if own]
    closes = 2 * sum(closed) >= len(closed)
    n_dup = chars_removed = 0
    removed = dict.fromkeys(RULES, 0)
    seen = set()
    for line, own in zip(lines, split):
        if own:
            words += own
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
            if rule := line_fails(own, line, times[line], closes):
                removed[rule] += 1
                chars_removed += sum(len(w.decode()) for w in own)
                continue
        kept_lines.append(line)
    n_words = len(words)
    word_chars = len(text) - sum(raw.count(s) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    n_symbols = sum(raw.count(s.encode()) for s in SYMBOLS)
    n_repeat = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base_failed and chars_removed <= max_loss * word_chars
    gone = sum(removed.values())
    cleaned = b"\n".join(kept_lines).decode() if gone else text
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, gone, chars_removed, *removed.values(), cleaned


SCORES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "lines_removed long, chars_removed long, punctuation_lines long, navigation_lines long, boilerplate_lines long"
)


def score_documents(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document with the base statistics and the verdict; no shuffle."""

    def rows(ids, texts):
        found = [judge(t, max_loss)[:-1] for t in texts]
        return [ids, *([list(c) for c in zip(*found)] if found else [[]] * 12)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, SCORES)


def clean_documents(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that stay, all columns kept, their failing lines removed (n_chars follows the text if it is there).

    A document without failing lines keeps its text and n_chars as they are.
    """
    ship(docs.sparkSession)
    at_text = docs.columns.index("text")
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(at_text).to_pylist()
            found = [judge(t, max_loss) for t in texts]
            keep = [i for i, v in enumerate(found) if v[6]]
            cols = list(batch.take(pa.array(keep, pa.int64())).columns)
            cols[at_text] = pa.array([found[i][-1] for i in keep], batch.schema.field(at_text).type)
            if at_chars is not None:
                old = cols[at_chars].to_pylist()
                cols[at_chars] = pa.array([len(found[i][-1]) if found[i][7] else o for i, o in zip(keep, old)], batch.schema.field(at_chars).type)
            yield pa.record_batch(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
