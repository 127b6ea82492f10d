"""Running totals, overlapping intervals and order statistics whose largest group need not fit in one task.

Each works in two levels: a group is cut into chunks along its order, the chunks are totalled,
and a chunk's rows then start from what all chunks before it came to. Only chunk totals, a row
a chunk, pass through a window over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.operators.relational import stored


def running(df: DataFrame, by: Sequence[str], at: str, width: int, sums: Sequence[str] = (), maxes: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """df with each of sums and maxes replaced by its running total or maximum per group in order of the number `at`.

    Rows at the same place all get the total that includes them all. With `last`, a column previous holds
    `at` and those columns of the last place strictly before (its greatest row; null for the first).
    Chunks are `width` wide; a null counts nothing; rows without a place come first.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(at) / width))
    keys = [*by, "_chunk"]
    seen = F.struct(at, *last)
    totals = rows.groupBy(*keys).agg(F.max(seen).alias("_last"), *[F.sum(c).alias(f"_s_{c}") for c in sums], *[F.max(c).alias(f"_m_{c}") for c in maxes])
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    start = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.max("_last").over(before).alias("_b_last"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.max(f"_m_{c}").over(before).alias(f"_b_{c}") for c in maxes])
    met = rows.join(start, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    order = W.partitionBy(*keys).orderBy(at)
    upto = order.rangeBetween(W.unboundedPreceding, 0)
    done = {c: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums} | {c: F.greatest(F.col(f"_b_{c}"), F.max(c).over(upto)) for c in maxes}
    previous = [F.coalesce(F.max(seen).over(order.rangeBetween(W.unboundedPreceding, -1)), F.col("_b_last")).alias("previous")] if last else []
    return met.select(*[done[c].alias(c) if c in done else F.col(c) for c in df.columns], *previous)


def _deltas(intervals: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    """Per group and place: how many intervals of each level begin less how many end there. Empty, reversed and unbounded intervals count nothing."""
    sound = intervals.where("start_at < stop_at and level is not null")
    ends = sound.select(*by, "level", F.explode(F.array(F.struct(F.col("start_at").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop_at").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    return ends.groupBy(*by, F.col("e.at").alias("at")).agg(*[F.sum(F.when(F.col("level") == k, F.col("e.d")).otherwise(0)).alias(f"open_{k}") for k in range(1, levels + 1)])


def _highest(levels: int) -> Column:
    """The highest level with an open interval, 0 if there is none."""
    return F.coalesce(*[F.when(F.col(f"open_{k}") > 0, k) for k in range(levels, 0, -1)], F.lit(0))


def sweep(intervals: DataFrame, by: Sequence[str], levels: int, width: int) -> DataFrame:
    """Stretches of equal highest level under overlapping intervals: by, from_at, to_at, level, most (intervals open at once).

    intervals: by, start_at, stop_at (whole numbers; the end is not in it), level from 1 to `levels`,
    of which the highest open one holds. Stretches without an open interval are left out, and
    neighbours of one level are one stretch, however often intervals change under it.
    """
    opens = [f"open_{k}" for k in range(1, levels + 1)]
    now = running(_deltas(intervals, by, levels), by, "at", width, sums=opens).select(*by, "at", _highest(levels).alias("level"), sum((F.col(c) for c in opens), F.lit(0)).alias("open"))
    steps = running(now, by, "at", width, last=["level", "open"]).withColumn("new", (~F.col("level").eqNullSafe(F.col("previous.level"))).cast("long"))
    runs = running(steps.withColumn("run", F.col("new")), by, "at", width, sums=["run"]).withColumn("run", F.col("run") - F.col("new"))  # the stretch that ends at this place
    return runs.where("previous.level > 0").groupBy(*by, "run").agg(F.min("previous.at").alias("from_at"), F.max("at").alias("to_at"), F.max("previous.level").alias("level"), F.max("previous.open").alias("most")).drop("run")


def highest_within(spans: DataFrame, intervals: DataFrame, by: Sequence[str], levels: int, width: int) -> DataFrame:
    """by, number, level: the highest level open at any time in a span, 0 if none; spans tile their group.

    spans: by, number (growing along the group), at; a span runs to the next one's place, the last for ever,
    and of several that begin at one place all but the last are empty. One union and one running total decide,
    so neither side is replicated and spans with many intervals cost no more than their rows.
    """
    opens = [f"open_{k}" for k in range(1, levels + 1)]
    starts = spans.groupBy(*by, "at").agg(F.max("number").alias("number"))
    events = _deltas(intervals, by, levels).unionByName(starts, allowMissingColumns=True).groupBy(*by, "at").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in opens], F.max("number").alias("number"))
    now = running(events, by, "at", width, sums=opens, maxes=["number"]).where("number is not null")
    found = now.groupBy(*by, "number").agg(F.max(_highest(levels)).alias("level"))
    return spans.select(*by, "number").join(found, [*by, "number"], "left").select(*by, "number", F.coalesce("level", F.lit(0)).alias("level"))


def _placed(df: DataFrame, by: Sequence[str], value: str, pieces: int) -> DataFrame:
    """Distinct values of each group with how often they occur (n), cut into pieces at sketched quantiles, and how many rows stand before their piece (ahead) and in the group (total).

    The sketch only places the cuts; all counts are exact. Equal values are one row, so no value is too frequent.
    The cuts are stored: a sketch depends on the order in which rows reach it, and rows and sizes must be of the same pieces.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = stored(counts.groupBy(*by).agg(F.percentile_approx("v", [k / pieces for k in range(1, pieces)] or [1.0], 1000).alias("cuts")))  # a row a group
    at = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    rows = counts.join(cuts, list(by)).select(*by, "v", "n", at.alias("piece"))
    sizes = rows.groupBy(*by, "piece").agg(F.sum("n").alias("rows"))
    group, before = W.partitionBy(*by), W.partitionBy(*by).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.select(*by, "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"), "rows", F.sum("rows").over(group).alias("total"))
    return rows.join(placed, [*by, "piece"])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], pieces: int = 32) -> DataFrame:
    """by and an exact quantile a name, by linear interpolation between neighbours; groups without a value are left out.

    Only the pieces that hold a wanted place are ordered, each in a task of its own; a group of any size is
    never sorted whole.
    """
    rows = _placed(df, by, value, pieces)
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    wanted = F.array(*[f(place(q)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)])
    hit = F.exists(wanted, lambda p: (p >= F.col("ahead")) & (p < F.col("ahead") + F.col("rows")))
    inside = W.partitionBy(*by, "piece").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    near = rows.where(hit).withColumn("first", first)
    at = lambda p: F.max(F.when((p >= F.col("first")) & (p < F.col("first") + F.col("n")), F.col("v").cast("double")))
    picked = near.groupBy(*by).agg(F.max("total").alias("total"), *[at(f(place(q)).cast("long")).alias(f"_{n}_{s}") for n, q in shares.items() for s, f in (("low", F.floor), ("high", F.ceil))])
    share = lambda q: place(q) - F.floor(place(q))
    return picked.select(*by, *[(F.col(f"_{n}_low") + share(q) * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n) for n, q in shares.items()])


def ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "rank", pieces: int = 32) -> DataFrame:
    """df with the rank of its value in its group: one more than the rows with a smaller value, as rank() gives it; nulls come last, with one rank.

    The rank is worked out on distinct values, a piece at a time, and joined back by group and value.
    """
    placed = _placed(df, by, value, pieces)
    inside = W.partitionBy(*by, "piece").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    first = placed.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("v").alias("_v"), (F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1).cast("int").alias("_rank"))
    whole = df.groupBy(*by).agg((F.count(value) + 1).cast("int").alias("_last")).select(*[F.col(b).alias(f"_g_{b}") for b in by], "_last")
    met = df.join(first, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by] + [F.col(value) == F.col("_v")], "left")
    met = met.join(whole, [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by], "left")
    return met.select(*df.columns, F.coalesce("_rank", "_last").alias(name))
