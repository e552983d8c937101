"""Scalar building blocks as Column expressions (JVM-side)."""

from __future__ import annotations

import functools
import mimetypes
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
STOPWORDS = ("the", "a", "an", "podcast", "show", "with")
BYTES_FLOOR = 100_000
BIT_RATE = 128_000


def parse_duration(raw: Column) -> Column:
    """Seconds of '90', '5:30' or '1:02:03' (no range checks); anything else is NULL."""
    t = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    part = r"\d+(\.\d+)?"
    bits = F.split(t, ":")
    num = lambda i: F.try_element_at(bits, F.lit(i)).try_cast("double")
    return (
        F.when(t.rlike(f"^{part}$"), t.try_cast("double"))
        .when(t.rlike(f"^{part}:{part}$"), num(1) * 60 + num(2))
        .when(t.rlike(f"^{part}:{part}:{part}$"), num(1) * 3600 + num(2) * 60 + num(3))
    )


def enclosure_bytes(raw: Column) -> Column:
    """Length attribute as a number; zero and non-numbers are NULL."""
    return F.nullif(raw.try_cast("bigint"), F.lit(0).cast("bigint"))


def estimate_duration(seconds: Column, size: Column) -> Column:
    """struct(sec, source): seconds, or an estimate from the byte size where there are none."""
    guess = seconds.isNull() & (size > BYTES_FLOOR)
    return F.struct(
        F.when(guess, size * 8 / BIT_RATE).otherwise(seconds).alias("sec"),
        F.when(guess, "estimated_from_bytes").when(seconds.isNull(), "missing").otherwise("itunes:duration").alias("source"),
    )


#: Hours of the zone names of RFC 2822.
ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AST": -4, "ADT": -3}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_PUBDATE = r"(?s)^\s*(?:[A-Za-z]+(?:,\s*|\s+))?(\d{1,2})[ \-]+([A-Za-z]{3})[A-Za-z]*[ \-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s*([+-]\d{4})|\s+([A-Za-z]+))?.*$"
#: All its groups, each behind a mark that stands in none.
_PARTS = "".join(f"\x1f${i}" for i in range(1, 9))


def parse_pubdate(raw: Column) -> Column:
    """RFC 2822 date as a UTC timestamp; NULL if it isn't one.

    Any weekday or none, two-digit years (69 to 99 in the last century), seconds optional. Without a zone, or with a name that
    stands for none, the time counts as UTC.
    """
    found = F.regexp_replace(raw, _PUBDATE, _PARTS)  # one match for all parts; what doesn't match stays as it is

    def stamp(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        number = lambda i: part(i).try_cast("int")
        month = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)]), F.lower(part(2)))
        year = F.when(F.length(part(3)) == 4, number(3)).otherwise(number(3) + F.when(number(3) > 68, 1900).otherwise(2000))
        second = F.coalesce(number(6), F.lit(0)).cast("decimal(8,6)")
        local = F.try_make_timestamp(year, month, number(1), number(4), number(5), second, F.lit("UTC"))
        shift = part(7)
        zones = F.create_map(*[F.lit(x) for zone, hours in ZONES.items() for x in (zone, hours * 60)])
        named = F.coalesce(F.try_element_at(zones, F.upper(part(8))), F.lit(0))
        hours, minutes = F.substring(shift, 2, 2).try_cast("int"), F.substring(shift, 4, 2).try_cast("int")
        ahead = F.when(shift != "", (hours * 60 + minutes) * F.when(F.startswith(shift, F.lit("-")), -1).otherwise(1)).otherwise(named)
        return F.when(month.isNotNull(), local - F.make_dt_interval(mins=ahead))

    return F.when(found != raw, let(F.split(found, "\x1f"), stamp))


def strip_control(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


@F.pandas_udf(T.StringType())
def fold_ascii(names: pd.Series) -> pd.Series:
    """Compatibility decomposition with non-ASCII characters dropped (Spark has no builtin for it)."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def normalize_ascii(name: Column) -> Column:
    """Lower case, letters and digits only, without stopwords; for names that are ASCII already."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", *STOPWORDS)), " ")


def normalize_name(name: Column) -> Column:
    return normalize_ascii(fold_ascii(name))


def sanitize_title(title: Column, most: int = 80) -> Column:
    """A file-name-safe title: forbidden characters to _, blanks collapsed, cut, 'untitled' if nothing is left."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r'[/\\:*?"<>|]', "_")
    t = F.rtrim(F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most))
    return F.when(t == "", "untitled").otherwise(t)


def episode_id(url: Column) -> Column:
    return F.when(url.isNull() | (url == ""), "").otherwise(F.substring(F.md5(url), 1, 16))


def stable_seed(seed: int | str, key: Column) -> Column:
    """32-bit number from the first four digest bytes, least significant first."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def split_meta(meta: Column, fields: int = 4) -> Column:
    """Fields of a ||| record; the last keeps further delimiters."""
    return F.split(meta, r"\|\|\|", fields)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


#: Audio suffixes that are kept.
SUFFIXES = (".mp3", ".m4a", ".wav", ".ogg", ".oga", ".aac", ".flac", ".opus")


@functools.cache
def content_suffixes() -> dict[str, str]:
    """Suffix of each content type: fixed for three, the standard table's otherwise."""
    table = mimetypes.MimeTypes(filenames=())
    known = {kind: table.guess_extension(kind) for kind in table.types_map_inv[True]}
    known = {kind: ".mp3" if suffix == ".mpga" else suffix for kind, suffix in known.items()}
    known.setdefault("audio/ogg", ".ogg")  # which the standard table lacks in some versions
    return known | {"audio/mpeg": ".mp3", "audio/mp4": ".m4a", "audio/x-m4a": ".m4a"}


def guess_extension(url: Column, content_type: Column) -> Column:
    """Suffix of the final URL's path if it is an audio one, else by content type, else .mp3."""
    suffix = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"[^/](\.[^./]+)$", 1))
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    by_type = F.create_map(*[F.lit(x) for pair in sorted(content_suffixes().items()) for x in pair])
    return F.when(suffix.isin(*SUFFIXES), suffix).otherwise(F.coalesce(F.try_element_at(by_type, kind), F.lit(".mp3")))


def path_stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def path_suffix(path: Column) -> Column:
    """Last suffix of a file name with its point, '' if there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def http_class(status: Column) -> Column:
    """ok, permanent (never retried) or retry."""
    return F.when(status == 200, "ok").when(status.isin(403, 404, 410), "permanent").otherwise("retry")


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def months_before(ts: Column, months: int | Column) -> Column:
    """Calendar months back with the day clamped to the month's end."""
    m = F.lit(months) if isinstance(months, int) else months
    return ts - F.make_ym_interval(F.lit(0), m)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_even(x: Column, digits: int) -> Column:
    """x to so many digits (0 to 7) as exact arithmetic rounds it: the nearest, of two equally near the even one, by the binary value.

    The fraction times a power of ten is a product and its rounding error (split in two halves of 26 bits), so a value is a tie only
    if it is exactly between two decimals: 2.675 is less and goes to 2.67, 0.125 is and goes to 0.12. Infinities and NaN stay.
    """
    if not 0 <= digits <= 7:
        raise ValueError("0 to 7 digits")
    ten = 10.0**digits

    def rounded(x: Column, rest: Column, product: Column) -> Column:
        whole = F.abs(x) - rest
        wide = rest * 134217729.0
        high = wide - (wide - rest)
        error = (high * ten - product) + (rest - high) * ten
        below = product - product % 1.0
        past_half = (product - below - 0.5) + error
        odd = ((below if digits else whole) % 2.0) == 1.0
        last = below + F.when((past_half > 0) | ((past_half == 0) & odd), 1.0).otherwise(0.0)
        found = let(last, lambda k: F.when(whole < 2.0**52 / ten, (whole * ten + k) / ten).otherwise(whole + k / ten))
        return F.when(F.abs(x) < float("inf"), found * F.when(x < 0, -1.0).otherwise(1.0)).otherwise(x)

    return let(x.cast("double"), lambda x: let(F.abs(x) % 1.0, lambda rest: let(rest * ten, lambda product: rounded(x, rest, product))))


def round_scaled(x: Column, digits: int) -> Column:
    """x to so many digits as SQL's round_even does: by its product with a power of ten, so 0.0375, of which the binary value is less, goes to 0.038."""
    ten = 10.0**digits
    return let(x.cast("double"), lambda x: let(F.rint(x * ten) / ten, lambda found: F.when(F.abs(found) < float("inf"), found).otherwise(x)))
