"""Column expressions that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def once(value: Column, body) -> Column:
    """body(value) with value worked out once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(value: Column, digits: int) -> Column:
    """A double to so many digits as SQL engines round it: scaled, to the nearest whole number (halves away from 0), scaled back.

    F.round goes by the shortest decimal form instead and differs where a sum of products lies next to a half.
    """
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0 or null."""
    return top / F.nullif(bottom, F.lit(0))


def cascade(branches: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """The name of the first branch that holds."""
    out = F
    for test, name in branches:
        out = out.when(test, name)
    return out.otherwise(otherwise)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def words(text: Column) -> Column:
    """Runs of a to z of the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def tone_label(score: Column, edge: float = 0.15) -> Column:
    return F.when(score > edge, "positive").when(score < -edge, "negative").otherwise("neutral")
