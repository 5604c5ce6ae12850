"""Column functions on ARRAY<FLOAT|DOUBLE> vectors, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, where ``f`` uses the value for each entry of an array: as an argument it is
    computed once a row, not once an entry."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """v / max(norm, 1e-10)."""
    return once(F.greatest(norm(v), F.lit(1e-10)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def dense(entries: Column, size: int) -> Column:
    """The vector of ``size`` entries that ``entries`` (structs of slot and x, by slot) says, 0
    elsewhere; all 0 for null."""
    entries = F.coalesce(entries, F.array().cast("array<struct<slot: int, x: double>>"))
    slot = lambda i: F.coalesce(F.get(entries, i)["slot"], F.lit(-1))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    parts = F.transform(entries, lambda e, i: F.concat(zeros(e["slot"] - slot(i - 1) - 1), F.array(e["x"])))
    return F.concat(F.flatten(parts), zeros(size - 1 - slot(F.size(entries) - 1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
