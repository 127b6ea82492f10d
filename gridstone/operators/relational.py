"""Relational operators that Spark has no single call for: upserts, as-of and nearest joins, islands, point-in-time frames, greedy choice."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], combine: dict[str, Column] | None = None, when: str | None = None) -> DataFrame:
    """target after changes, with a column action: insert, update or keep.

    combine gives a column from t.* and c.* (greatest, or, coalesce); other columns take the
    change's value. `when` is an SQL condition on t.* and c.* without which a match is kept.
    Both sides must have unique, non-null keys.
    """
    t, c = target.withColumn("_t", F.lit(True)).alias("t"), changes.withColumn("_c", F.lit(True)).alias("c")
    both = t.join(c, [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys], "full_outer")
    old, new = F.col("t._t").isNotNull(), F.col("c._c").isNotNull()
    updated = old & new & (F.expr(when) if when else F.lit(True))
    combine = combine or {}
    out = [F.coalesce(F.col(f"t.{k}"), F.col(f"c.{k}")).alias(k) for k in keys]
    for name in target.columns:
        if name not in keys:
            value = combine.get(name, F.col(f"c.{name}"))
            out.append(F.when(updated, value).when(old, F.col(f"t.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
    return both.select(*out, F.when(~old, "insert").when(updated, "update").otherwise("keep").alias("action"))


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key target lacks, each key once."""
    return rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row at or before it, per `by`; null if there is none.

    Both sides are unioned and one window carries the last values on, so there is one shuffle
    on `by` and no range join. Ties on the right go to the greatest values.
    """
    tagged = F.struct(F.col(right_on).alias("_at"), *values)
    a = left.withColumn("_at", F.col(left_on)).withColumn("_right", F.lit(None).cast(right.select(tagged.alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(1))
    b = right.groupBy(*by, right_on).agg(F.max(F.struct(*values)).alias("_v")).select(*by, F.col(right_on).alias("_at"), F.struct(F.col(right_on).alias("_at"), *[F.col(f"_v.{v}").alias(v) for v in values]).alias("_right"), F.lit(0).alias("_side"))
    w = W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with `island`: a number from 1 that grows where the value differs from the row before (nulls are equal)."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("_new", changed).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def previous_mean(value: str, by: Sequence[str], order: Sequence[str], rows: int | None = None) -> Column:
    """Mean of the last `rows` rows (all, if none is given) strictly before the row."""
    w = W.partitionBy(*by).orderBy(*order)
    return F.avg(value).over(w.rowsBetween(W.unboundedPreceding if rows is None else -rows, -1))


def keyset_page(df: DataFrame, ts: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The newest rows after a cursor (ts, key), in descending order: a top-k, never an offset."""
    if after is not None:
        at, k = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < k)))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(size)


def stored(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read back, so that lost executors don't cost what came before.

    The folder is spark.checkpoint.dir; where that is unset, a local session (tests) gets a temporary one, and a cluster an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='gridstone-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def first_independent(nodes: DataFrame, edges: DataFrame, key: str, low: str = "low_id", high: str = "high_id") -> DataFrame:
    """The nodes a reader in order of `key` keeps who drops every node with an edge to one kept before.

    Each round keeps the nodes whose earlier neighbours are all dropped and drops their later
    neighbours; the smallest open node is always among them, so rounds end with no open edge.
    edges has each pair once, low < high.
    """
    open_edges = stored(edges.select(F.col(low).alias("low"), F.col(high).alias("high")).distinct())
    dropped = None
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("high").alias("low")).distinct()
        free = open_edges.join(waiting, "low", "left_anti")  # edges from nodes that nothing before can drop
        gone = stored(free.select(F.col("high").alias("node")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)  # no node goes twice, so all rounds together store each once
        left = open_edges.join(gone.withColumnRenamed("node", "high"), "high", "left_anti").join(gone.withColumnRenamed("node", "low"), "low", "left_anti")
        open_edges = stored(left)
    return nodes if dropped is None else nodes.join(dropped.withColumnRenamed("node", key), key, "left_anti")
