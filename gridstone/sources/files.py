"""Files that others hand over: feeds as XML, row files as JSON or CSV, and partitioned tables as a sink."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_ITEM = "title string, link string, guid string, pubDate string, description string, _corrupt string"
#: Ways of writing a date in feeds, tried in this order, after the weekday is gone.
FEED_DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX")
PLAIN_DATE = "yyyy-MM-dd HH:mm:ss Z"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it goes when the session ends.

    Where that is unset, a local session (tests) gets a temporary folder, and a cluster an error.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = f"file://{tempfile.mkdtemp(prefix='gridstone-')}"
        spark.conf.set("spark.checkpoint.dir", home)
    folder = f"{home.rstrip('/')}/gridstone/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)  # only what exists can be marked
    files.deleteOnExit(path)
    return folder


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, one object a line; broken lines stay, with their text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header; quoted fields may hold line ends. Broken rows stay, with their text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def feed_date(text: Column) -> Column:
    """The time that a feed's date names, as UTC without a zone; null if it fits no known form. Times without a zone are UTC."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", "")
    tries = [F.try_to_timestamp(F.regexp_replace(bare, r"\b(GMT|UTC|Z)$", "+0000") if f.endswith("Z") else bare, F.lit(f)) for f in FEED_DATES]
    tries.append(F.try_to_timestamp(F.concat(bare, F.lit(" +0000")), F.lit(PLAIN_DATE)))
    return F.to_utc_timestamp(F.coalesce(*tries), F.current_timezone()).cast("timestamp_ntz")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: guid (else the link), title, link, summary without markup, published_at, source file.

    Files are split by Spark's XML reader at <item>. Items without guid and link are left out;
    an item that several files repeat appears once, the latest (then the greatest title) holding.
    """
    raw = spark.read.format("xml").option("rowTag", "item").option("columnNameOfCorruptRecord", "_corrupt").schema(FEED_ITEM).load(path).withColumn("source", F.input_file_name())
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("description", F.lit("")), r"(?s)<[^>]*>", " "), r"\s+", " "))
    key = F.coalesce(F.nullif(F.trim("guid"), F.lit("")), F.nullif(F.trim("link"), F.lit("")))
    rows = raw.select(key.alias("guid"), F.trim("title").alias("title"), F.trim("link").alias("link"), bare.alias("summary"), feed_date(F.col("pubDate")).alias("published_at"), "source").where("guid is not null")
    latest = F.max(F.struct("published_at", "title", "link", "summary", "source")).alias("r")
    return rows.groupBy("guid").agg(latest).select("guid", "r.*")


#: An Atom entry; text elements may bear a type, and links say by `rel` what they lead to.
FEED_ENTRY = "title string, link array<struct<_href:string,_rel:string>>, id string, published string, updated string, summary string, content string, _corrupt string"


def atom_items(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files in the shape of feed_items: guid (the id, else the link), title, link, summary without markup, published_at, source file.

    The link is the first that is an alternate or says nothing of itself, else the first of all; an empty summary gives way
    to the content, a missing time of publication to that of the last change. Entries without title or link are left
    out; an entry that several files repeat appears once, the latest holding.
    """
    raw = spark.read.format("xml").option("rowTag", "entry").option("columnNameOfCorruptRecord", "_corrupt").schema(FEED_ENTRY).load(path).withColumn("source", F.input_file_name())
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<[^>]*>", " "), r"\s+", " "))
    some = lambda c: F.nullif(plain(F.col(c)), F.lit(""))
    links = F.filter("link", lambda x: x["_href"].isNotNull() & (F.trim(x["_href"]) != ""))
    fit = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.trim(F.coalesce(F.get(fit, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]))
    rows = raw.select(link.alias("link"), some("title").alias("title"), F.coalesce(F.nullif(F.trim("id"), F.lit("")), link).alias("guid"), F.coalesce(some("summary"), some("content"), F.lit("")).alias("summary"), F.coalesce(feed_date(F.col("published")), feed_date(F.col("updated"))).alias("published_at"), "source")
    latest = F.max(F.struct("published_at", "title", "link", "summary", "source")).alias("r")
    return rows.where("title is not null and link is not null").groupBy("guid").agg(latest).select("guid", "r.*")


def all_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of feeds of either kind under a path, each once; of one that both kinds have, the latest holds."""
    both = feed_items(spark, path).unionByName(atom_items(spark, path))
    return both.groupBy("guid").agg(F.max(F.struct("published_at", "title", "link", "summary", "source")).alias("r")).select("guid", "r.*")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], files: int | None = None) -> None:
    """Replaces the partitions that df has rows of and leaves the others; a repeated run gives the same table.

    With `files`, each partition is dealt to that many tasks by a hash of the whole row, so that
    one large partition isn't written by one task.
    """
    if files:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
        df = df.repartition(*by, salt)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export(df: DataFrame, folder: str, formats: Sequence[str] = ("parquet", "csv", "json")) -> None:
    """Writes df once per format under the folder, replacing what was there; CSV has a header, and JSON keeps null fields."""
    for kind in formats:
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", True).option("escape", '"')
        if kind == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.format(kind).save(f"{folder}/{kind}")


@contextmanager
def logged(spark: SparkSession, folder: str, job: str) -> Iterator[dict]:
    """Appends one row to a run log when the block ends, also when it fails: job, seconds, rows (what the block puts in `rows`), status, error."""
    began, said = time.time(), {"rows": None}
    status, error = "ok", None
    try:
        yield said
    except Exception as e:
        status, error = "failed", f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        row = [(job, round(time.time() - began, 3), said["rows"], status, error)]
        spark.createDataFrame(row, "job string, seconds double, rows long, status string, error string").write.mode("append").parquet(folder)


def has_room(spark: SparkSession, folder: str, most_mb: float = 400.0) -> bool:
    """Whether a folder, wherever it lies, holds less than a bound; a folder that does not exist has room. New work is not begun without it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(path) or files.getContentSummary(path).getLength() < most_mb * 1_000_000
