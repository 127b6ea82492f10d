"""Helpers shared by the corpus operators: table access, shared-folder tables and expression idioms."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the characters 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than one of so many rows, and more than HOT_LEAST rows, is hot.
HOT_SHARE, HOT_LEAST = 1000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a temporary one; on a cluster that is an
    error, since executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which the session's end removes with all that is in it."""
    path = f"{shared_folder(spark)}/gridstone/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)  # only what exists can be marked
    store.deleteOnExit(at)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns it reread.

    Cuts lineage so that what follows survives lost executors without running df again,
    and fixes rows that a retry might otherwise number differently.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined on key with keyed, which has one row a key and the number of rows of that key as weight.

    Keys with more than a thousandth of all rows are fewer than a thousand: they are broadcast, so
    no task takes all rows of one. The others are shuffled. rows and keyed are read twice: both should
    be stored or cheap. Keyed's weight is left out of the result; a null key joins nothing.
    """
    total, most = keyed.agg(F.sum(weight), F.max(weight)).first()
    bound = max((total or 0) / HOT_SHARE, HOT_LEAST)
    if (most or 0) <= bound:
        return rows.join(keyed.drop(weight), key, how)
    hot = keyed.where(F.col(weight) > bound)
    names = [c for c in keyed.columns if c not in (key, weight)]
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_gs_hot"), *[F.col(c).alias(f"_gs_{c}") for c in names])), key, "left")
    few = marked.where("_gs_hot").select(*rows.columns, *[F.col(f"_gs_{c}").alias(c) for c in names])
    many = marked.where("_gs_hot is null").select(*rows.columns).join(keyed.drop(weight), key, how)
    return few.unionByName(many.select(*rows.columns, *names))


#: Bits of a membership filter: 8 MB, whatever is put in.
FILTER_BITS = 1 << 26


def maybe_in(hashes: DataFrame):
    """A function of a column of 64-bit hashes: false only for hashes that are not in the one column of this table.

    A Bloom filter of fixed size with two bits a hash. It spares shuffles; the exact join that must follow
    decides. Beyond some ten million hashes it lets ever more rows through, which costs time, not results.
    """
    h, mask = F.col(hashes.columns[0]), F.lit(FILTER_BITS - 1)
    places = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        x = column.to_numpy(dtype=np.int64).view(np.uint64)
        out = np.ones(len(x), dtype=bool)
        for at in (x & np.uint64(FILTER_BITS - 1), (x >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
            out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return pd.Series(out)

    return test


def labelled_rows(documents: DataFrame, labels: DataFrame, per_class: int, seen) -> list:
    """doc_id, quality, x of at most per_class labelled documents of each quality, by doc_id: x is seen(text).

    One row an id reaches the driver: of documents that repeat an id, the one whose text has the smallest hash.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample = known.where("quality = 1").orderBy(*order).limit(per_class).union(known.where("quality = 0").orderBy(*order).limit(per_class))
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class rows are broadcast
    rows = rows.select("doc_id", "quality", F.xxhash64("text").alias("hash"), seen("text").alias("x"))
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("hash", "x")).alias("r"))
    return sorted(one.select("doc_id", "quality", F.col("r.x").alias("x")).collect(), key=lambda r: r.doc_id)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no further than the bound."""
    return df.limit(rows + 1).count() <= rows
