"""Exact deduplication: two-pass Bloom filtering keeps texts that occur once away from every shuffle.

Texts are equal when they are identical after lower-casing A to Z. Their SHA-256 stands for
them. The first pass puts each digest into two cells of a filter and counts what a cell got;
the second takes a row whose two cells both got more than one digest as possibly repeated.
Only those rows are shuffled and grouped by their whole digest, which decides; all others are
the only row of their text and pass straight through. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import join_hot, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells of the filter for each row, and the least cells: with two cells a row about 1.4 % of single rows look repeated.
CELLS_A_ROW, LEAST_CELLS = 16, 1 << 16
#: Up to so many cells the filter is broadcast: 2^22 words of 64 cells at most, some 130 MB in an executor. A larger one is joined by shuffle.
BROADCAST_CELLS = 1 << 28


def normal(text: Column) -> Column:
    """The text (null: empty) with A to Z lower-cased and nothing else changed."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))  # lower is the faster one, and right for ASCII


def digest(text: Column) -> Column:
    """The 32 bytes of the normal text's SHA-256."""
    return F.unhex(F.sha2(F.encode(normal(text), "UTF-8"), 256))


def cells_for(rows: int) -> int:
    """A power of two: the number of cells of a filter for so many rows."""
    return max(LEAST_CELLS, 1 << (CELLS_A_ROW * rows - 1).bit_length())


def _places(key: Column, cells: int) -> tuple[Column, Column]:
    return tuple(F.pmod(F.xxhash64(key, F.lit(k)), F.lit(cells)) for k in (1, 2))


def repeated_words(keys: DataFrame, key: str, cells: int) -> DataFrame:
    """First pass: word, bits; of each 64 cells those that got more than one row. Words without such cells are left out."""
    places = keys.select(F.explode(F.array(*_places(F.col(key), cells))).alias("cell"))
    often = places.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))


def flag_repeated(rows: DataFrame, key: str, words: DataFrame, cells: int) -> DataFrame:
    """Second pass: rows with _gs_maybe, false only where no other row has the key. Rows are shuffled only beyond BROADCAST_CELLS."""
    out = rows
    for k, at in enumerate(_places(F.col(key), cells)):
        side = words.select(F.col("word").alias(f"_gs_word{k}"), F.col("bits").alias(f"_gs_bits{k}"))
        if cells <= BROADCAST_CELLS:
            side = F.broadcast(side)
        out = out.withColumn(f"_gs_at{k}", at).join(side, F.shiftright(F.col(f"_gs_at{k}"), 6) == F.col(f"_gs_word{k}"), "left")
    hit = F.lit(True)
    for k in (0, 1):
        hit &= F.coalesce(F.expr(f"shiftrightunsigned(_gs_bits{k}, cast(_gs_at{k} & 63 as int)) & 1"), F.lit(0)) == 1
    return out.select(*rows.columns, hit.alias("_gs_maybe"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept; of rows that repeat that id, too, one
    of them, so each group keeps exactly one row. A null doc_id comes after all others (keep_id is
    null if the group has no other). A null text equals the empty one. Texts of any length are read
    whole; other columns of docs are not read. An empty table gives an empty result. Texts are read
    once: what is stored and, where possibly repeated, shuffled are the ids and digests.
    """
    keys = materialize(docs.select("doc_id", digest(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row")), "digests")
    cells = cells_for(keys.count())
    flagged = flag_repeated(keys, "key", materialize(repeated_words(keys, "key", cells), "repeated-words"), cells)
    single = flagged.where("not _gs_maybe").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = materialize(flagged.where("_gs_maybe").drop("_gs_maybe"), "possibly-repeated")
    groups = maybe.groupBy("key").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"), F.count("*").alias("weight"))
    several = join_hot(maybe, groups, "key", "weight").select("doc_id", "key", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"))
    return single.unionByName(several).withColumn("text_sha256", F.lower(F.hex("key"))).drop("key")


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one with the largest doc_id.

    The same rules as exact_groups. Texts are read twice; only those that may be repeated are shuffled,
    at most one a digest and task.
    """
    rows = docs.select(digest(F.col("text")).alias("key"), F.struct(*docs.columns).alias("r"))
    cells = cells_for(docs.count())
    flagged = flag_repeated(rows, "key", materialize(repeated_words(rows.select("key"), "key", cells), "repeated-words"), cells)
    last = flagged.where("_gs_maybe").groupBy("key").agg(F.max_by("r", F.struct("r.doc_id")).alias("r"))
    return flagged.where("not _gs_maybe").select("r.*").union(last.select("r.*"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)"""
