"""Document fingerprints from closed syncmers, in DataFrame functions only.

Words are hashed; k words in a row are an anchor if the smallest of their inner s-word
hashes stands at either edge. Whether k words are an anchor depends on them alone, so equal
passages have equal anchors wherever they stand and whatever surrounds them. A fingerprint
holds the hashes of all distinct anchors, ascending, each as eight hexadecimal digits, so it
grows with the text; two fingerprints are compared by the share of common hashes among all of
both. Positions tell whether anchors also follow each other alike: two texts are aligned by
their steps, an anchor with the next one and the words between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.llm.common import SPACE, let

#: Words of an anchor and of its inner substrings: two of K - S + 1 windows are anchors.
K, S = 5, 2
#: Hexadecimal digits of one hash.
DIGITS = 8
#: Documents of an id bucket on average, most buckets, and sampled ids of a bucket that place its border.
BUCKET_ROWS, MAX_BUCKETS, SAMPLED = 512, 65_536, 32
#: Rows that repeat a frequent id are dealt by so many bits of a hash of their text.
TEXT_BITS = 20


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _get(items: Column, at: Column) -> Column:
    return F.get(items, at)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position, hash>>: the closed syncmers of a text, position counted in words from 0.

    Texts of fewer than k words are one anchor of all their words; texts without words have none.
    Equal smallest inner hashes count wherever they stand.
    """

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[_get(h, i + j) for j in range(s)]))

        def of_inner(m: Column) -> Column:
            starts = F.sequence(F.lit(0), n - k)
            low = lambda i: F.least(*[_get(m, i + j) for j in range(k - s + 1)])
            chosen = F.filter(starts, lambda i: (_get(m, i) == low(i)) | (_get(m, i + (k - s)) == low(i)))
            return F.transform(chosen, lambda i: F.struct(i.alias("position"), F.xxhash64(*[_get(h, i + j) for j in range(k)]).alias("hash")))

        short = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash")))
        none = F.slice(short, 1, 0)
        return F.when(n >= k, let(inner, of_inner)).when(n > 0, short).otherwise(none)

    return let(_word_hashes(text), of_hashes)


def distinct_hashes(found: Column) -> Column:
    """array<bigint>: the distinct 32-bit hashes of anchors, ascending."""
    cut = (1 << (4 * DIGITS)) - 1
    return F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"].bitwiseAND(F.lit(cut)))))


def steps(found: Column) -> Column:
    """array<bigint>: distinct hashes of each anchor with the next anchor and the words from one to the other.

    Texts that share a step share both anchors at the same shift; the only anchor of a text is a step alone.
    """

    def of(a: Column) -> Column:
        pair = lambda x, i: F.xxhash64(x["hash"], F.get(a, i + 1)["hash"], F.get(a, i + 1)["position"] - x["position"])
        return F.array_distinct(F.when(F.size(a) > 1, F.slice(F.transform(a, pair), 1, F.size(a) - 1)).otherwise(F.transform(a, lambda x: x["hash"])))

    return let(found, of)


def sketch(text: Column, k: int = K, s: int = S) -> Column:
    """array<bigint>: all distinct 32-bit anchor hashes of a text, ascending."""
    return distinct_hashes(anchors(text, k, s))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), DIGITS, "0"))), "")


def likeness(left: Column, right: Column) -> Column:
    """Share of common hashes among all of two arrays of distinct hashes: 1 for two empty ones, 0 for an empty and another."""

    def of_common(common: Column) -> Column:
        both = F.size(left) + F.size(right) - common
        return F.when(both == 0, F.lit(1.0)).otherwise(common / both)

    return let(F.size(F.array_intersect(left, right)), of_common)


def _borders(ids: DataFrame, n: int) -> list[int]:
    """Ascending ids that cut the documents into buckets of about equal size, from a sample of bounded size; a frequent id repeats.

    The borders bear on speed alone: any would give the same rows.
    """
    buckets = min(n // BUCKET_ROWS, MAX_BUCKETS)
    if buckets < 2:
        return []
    cuts = [k / buckets for k in range(1, buckets)]
    seen = ids.where("doc_id is not null").sample(min(1.0, SAMPLED * buckets / n), seed=1)
    return seen.agg(F.percentile_approx("doc_id", cuts, SAMPLED * buckets).alias("cuts")).first().cuts or []


def _below(borders: list[int], value: Column, equal: bool) -> Column:
    """How many borders are less than (or equal to) a value: a binary search in one constant array."""
    levels = len(borders).bit_length()
    padded = [*borders, *[(1 << 63) - 1] * ((1 << levels) - 1 - len(borders))]
    table = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")

    def step(at: Column, width: Column) -> Column:
        border = F.element_at(table, at + width)
        return F.when(border <= value if equal else border < value, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(levels - 1, -1, -1)]), F.lit(0), step)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text and next_text of the document that comes next by descending doc_id, for every row.

    After the last comes the first again. Ids are cut into at most MAX_BUCKETS buckets of about
    equal size by borders from a sample, an id of very many rows further by a hash of their texts;
    a window orders each bucket, and the head of the bucket that follows is appended to it as an
    extra row. Rows that repeat an id follow each other by (for frequent ids: hash and) text. Rows
    without an id have no next row. One document alone is its own next.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    borders = _borders(rows.select("doc_id"), rows.count())
    mixed = F.shiftrightunsigned(F.xxhash64("text"), 64 - TEXT_BITS)
    hot = len(set(borders)) < len(borders)
    # order by key, then text: doc_id first, and the text's hash within an id where some id is hot
    key = F.col("doc_id").cast("decimal(20, 0)") * F.lit(1 << TEXT_BITS) + (mixed if hot else F.lit(0))
    bucket = F.lit(0)
    if borders:
        bucket = _below(borders, F.col("doc_id"), True)
    if hot:
        under = _below(borders, F.col("doc_id"), False)
        times = bucket - under
        bucket = F.when(times > 1, under + F.shiftright(mixed * times, TEXT_BITS)).otherwise(bucket)
    without = -1 - F.pmod(F.xxhash64("text"), F.lit(len(borders) + 1))
    rows = rows.withColumn("key", key.cast("decimal(28, 0)")).withColumn("bucket", F.when(F.col("doc_id").isNotNull(), bucket).otherwise(without).cast("long"))
    # at most MAX_BUCKETS rows: one task can order them, and they can be broadcast
    heads = rows.where("doc_id is not null").groupBy("bucket").agg(F.max("key").alias("key"))
    order = W.orderBy(F.col("bucket"))
    before = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("key", before.alias("to_bucket"))
    extra = rows.join(F.broadcast(heads), "key").groupBy("key", "to_bucket").agg(F.min("text").alias("text"))
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", F.col("to_bucket").alias("bucket"), F.lit(True).alias("extra"))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    w = W.partitionBy("bucket").orderBy("extra", F.col("key").desc_nulls_last(), "text")
    led = both.select("*", F.lead("text").over(w).alias("next_text")).where(~F.col("extra"))
    return led.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("next_text")).alias("next_text"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, anchors of every document row; null text is empty, its fingerprint too."""
    return documents.select("doc_id", as_text(sketch(F.col("text"))).alias("fingerprint"), anchors(F.col("text")).alias("anchors"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_*, aligned_*.

    near_edited and near_next are shares of common anchors, aligned_edited and aligned_next of
    common steps, all from whole texts. Null text is empty. A row without doc_id has no next
    document: its edited text loses its end and gets nothing for it, and near_next is 0 (1 if its
    own fingerprint is empty). Repeated ids follow each other by text (see with_next). An empty table gives no rows.
    """
    rows = with_next(documents)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    # the next text's anchors are made anew from it: they would be larger to shuffle than the text is
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), anchors(F.col("text")).alias("own"), anchors(edited).alias("edited"), anchors(F.col("next_text")).alias("next"))
    whole = [f(F.col(c)).alias(f"{c}_{f.__name__}") for c in ("own", "edited", "next") for f in (distinct_hashes, steps)]
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *whole)
    near = [likeness(F.col(f"own_{f}"), F.col(f"{c}_{f}")).alias(f"{name}_{c}") for name, f in (("near", "distinct_hashes"), ("aligned", "steps")) for c in ("edited", "next")]
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own_distinct_hashes")).alias("fingerprint"), as_text(F.col("edited_distinct_hashes")).alias("edited_fingerprint"), *near)


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    return edited_fingerprints(table(spark, sf_dir, "documents"))
