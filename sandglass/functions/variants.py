"""Fields of heterogeneous JSON as VARIANT: what a value is decides what is taken, nothing is turned into text by a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, DECIMAL(..), ARRAY<..>, OBJECT<..> or VOID."""
    return F.schema_of_variant(v)


def elements(v: Column, path: str) -> Column:
    """The elements of an array, as variants; none where there is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def strings(v: Column, path: str) -> Column:
    """The elements of an array that are strings, in order; numbers, nulls, objects and others are dropped."""
    found = F.filter(elements(v, path), lambda x: kind(x) == "STRING")
    return F.transform(found, lambda x: F.try_variant_get(x, "$", "string"))


def text(v: Column, path: str, default: str | None = None) -> Column:
    """A field as text, whatever it is; the default where it is missing or null."""
    got = F.try_variant_get(v, path, "string")
    return got if default is None else F.coalesce(got, F.lit(default))
