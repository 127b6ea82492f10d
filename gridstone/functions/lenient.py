"""Rows whose keys are spelled in several ways and whose numbers come as text: one schema out of any of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def said(row: Column, *keys: str) -> Column:
    """Text of the first of some keys that a VARIANT object has and that is not null there; an object or list is its JSON. Keys may be paths (a.b)."""
    return F.coalesce(*[F.try_variant_get(row, f"$.{k}", "string") for k in keys])


def counted(row: Column, *keys: str, default: float | None = 0.0) -> Column:
    """The number that the first key says: text is read as a number, nothing but spaces is 0, true 1 and false 0; what is no finite number is null. default where no key is there."""
    text = F.trim(F.lower(said(row, *keys)))
    number = F.when(text == "", 0.0).when(text == "true", 1.0).when(text == "false", 0.0).when(F.regexp_like(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")), F.expr("1D") * text.try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number)
    return F.when(text.isNull(), F.lit(default)).otherwise(finite)


def overlaid(default: Column, season: Column) -> Column:
    """A map of defaults with a season's own entries over it: a season's value holds where it has one that is not null; keys of either are in it."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(default, none), F.coalesce(season, none), lambda k, d, s: F.coalesce(s, d))


def entity_row(row: Column) -> Sequence[Column]:
    """A summary's fields with the spellings under which they come, in order."""
    return [
        F.coalesce(said(row, "driverName", "driver_name", "entityName", "entity_name"), F.lit("UNKNOWN")).alias("name"),
        counted(row, "mentions", "mentionCount", "mention_count", "total_mentions_7d").alias("mentions"),
        counted(row, "sentimentAvg", "sentiment_avg", "sentiment_7d_avg").alias("sentiment"),
        counted(row, "sentimentDelta", "sentiment_delta", "sentimentTrend", "sentiment_trend").alias("delta"),
        F.coalesce(said(row, "sentimentLabel", "sentiment_label", "overall_label"), F.lit("neutral")).alias("label"),
        counted(row, "positiveCount", "positive_count").alias("positive"),
        counted(row, "negativeCount", "negative_count").alias("negative"),
        counted(row, "neutralCount", "neutral_count").alias("neutral"),
        said(row, "topCluster", "top_cluster").alias("top"),
        said(row, "lastDate", "last_mentioned", "date").alias("last"),
    ]
