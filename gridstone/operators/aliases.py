"""Names found in text by a dictionary: whole words, the leftmost and longest first, and names that shut others out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of so many names or fewer is broadcast; a larger one is joined by shuffle.
BROADCAST_NAMES = 100_000


def plain_words(text: Column) -> Column:
    """Words of a headline: lower case, apostrophes gone, numbers after # read as cars, anything but a to z and digits a border."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, "#0?([0-9]+)", "car $1"), "[^a-z0-9]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def dictionary(spark, names: dict[str, str | None]) -> DataFrame:
    """alias, entity of a dictionary; a name without an entity is one that only shuts others out."""
    rows = spark.createDataFrame(sorted(names.items()), "alias string, entity string")
    return rows.select(F.array_join(plain_words(F.col("alias")), " ").alias("alias"), "entity").where("alias <> ''").dropDuplicates(["alias"])


def alias_spans(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, entity, alias, first (word, from 1), words: what a reader takes who goes from left to right and always takes the longest name.

    A name is met only as whole words, so "alpine" is not in "alpines". Names without an entity take their
    words like any other and then are left out, so "harry williams" keeps "williams" from being met in it.
    key must be unique; null and empty texts have no names. Runs of words are joined with the dictionary, so
    its size does not show in the work on a text; a text is never joined with more than its own runs.
    """
    longest = names.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        names = F.broadcast(names)
    said = rows.select(key, plain_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.struct(i.alias("first"), n.alias("words"), F.array_join(F.slice("w", i, n), " ").alias("alias")))))
    hits = said.select(key, F.explode(runs).alias("r")).select(key, "r.*").join(names, "alias")
    met = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", (-F.col("words")).alias("less"), "alias", "entity"))).alias("h"))  # a text's own hits
    taken = F.aggregate(
        "h", F.struct(F.lit(1).alias("free"), F.slice("h", 1, 0).alias("out")),
        lambda s, x: F.when(x["first"] >= s["free"], F.struct((x["first"] - x["less"]).alias("free"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s),
    )["out"]
    return met.select(key, F.explode(taken).alias("x")).where("x.entity is not null").select(key, "x.entity", "x.alias", "x.first", (-F.col("x.less")).alias("words"))
