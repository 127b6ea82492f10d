"""GeoJSON: features of several geometry types, read as VARIANT, to one line of points each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the points of a geometry are, by its type: the first ring of a polygon, that of a collection's first polygon, a line as it is.
POINTS_AT = {"Polygon": "$.geometry.coordinates[0]", "MultiPolygon": "$.geometry.coordinates[0][0]", "LineString": "$.geometry.coordinates"}


def ring(feature: Column) -> Column:
    """array<array<double>> of a feature's points; null for other types and broken coordinates."""
    kind = F.try_variant_get(feature, "$.geometry.type", "string")
    out = F.lit(None).cast("array<array<double>>")
    for name, at in POINTS_AT.items():
        out = F.when(kind == name, F.try_variant_get(feature, at, "array<array<double>>")).otherwise(out)
    return out


def features(texts: DataFrame, column: str = "value") -> DataFrame:
    """id, name, points of every feature: of texts that are a FeatureCollection, or one Feature each.

    Points are [longitude, latitude] pairs; further numbers of a point are cut off, points without two
    numbers left out. Features without a point, of another type, or in a text that is no JSON are left out. A feature without
    a name is an unknown circuit.
    """
    parsed = texts.select(F.try_parse_json(F.col(column)).alias("v"))
    many = F.try_variant_get("v", "$.features", "array<variant>")
    one = F.when(F.try_variant_get("v", "$.type", "string") == "Feature", F.array("v"))
    each = parsed.select(F.explode(F.coalesce(many, one)).alias("f"))
    name = F.coalesce(F.try_variant_get("f", "$.properties.Name", "string"), F.try_variant_get("f", "$.properties.name", "string"), F.lit("Unknown Circuit"))
    sound = F.filter(F.transform(ring(F.col("f")), lambda p: F.slice(p, 1, 2)), lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    rows = each.select(F.try_variant_get("f", "$.properties.id", "string").alias("id"), name.alias("name"), sound.alias("points"))
    return rows.where(F.size("points") > 0)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files, one document a file (files are read whole, so a large collection should come as a feature a line: read those with spark.read.text)."""
    return features(spark.read.text(path, wholetext=True))


def outline(rows: DataFrame) -> DataFrame:
    """id, name, n, west, east, south, north, closed: extent of each feature, and whether it ends where it begins."""
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    return rows.select("id", "name", F.size("points").cast("long").alias("n"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.array_min(ys).alias("south"), F.array_max(ys).alias("north"), (F.element_at("points", 1) == F.element_at("points", -1)).alias("closed"))
