"""Best-fit packing planned on the length histogram.

Documents become token pieces of at most `capacity`; only the number of pieces of each
length reaches the driver (at most `capacity` numbers). Best-fit decreasing runs on these
counts and yields a plan of runs: ranks [rank, rank + n) of a length go to consecutive
sequences. Pieces then take their slots by a join on length and rank within the length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.llm.common import materialize

CAPACITY, END = 2048, 0
#: Groups that each length is split in for ranking, so that no length is ranked in one task.
RANK_CHUNKS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, offset_from long"


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document: its ids and then id 0, cut from the end so that only the first piece is shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                start = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str):
    """text -> ids as the tokenizers library gives them; built once a worker, whatever number of tasks it runs.

    The rank file beside the vocabulary holds the same merges for a faster library; texts
    that hold a special token, or that it gives up on, go to the tokenizers library itself.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    exact.no_truncation()
    exact.no_padding()
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def slow(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids

    ranks = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import tiktoken

    from gridstone.llm.bpe import SPLIT

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("rank file", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow(text)
        try:
            return fast(text)
        except BaseException as e:  # its splitter gives up on very long runs with an exception outside Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Lengths are taken longest first; pieces go to the open sequences with the least room
    that is enough. Sequences in the same state are kept as ranges of ids, so the plan's
    size depends on the number of lengths, not on the number of pieces.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted; with the open ranges of each room
    ranges: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def open_range(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = min(room // length, left)
            full = min(n, left // per)
            plan.append((length, rank, rank + full * per, per, first, capacity - room))
            open_range(room - per * length, first, full)
            open_range(room, first + full, n - full)
            left -= full * per
            rank += full * per
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_chunks: int = RANK_CHUNKS) -> DataFrame:
    """Adds sequence_id and offset to pieces (which must be stored: they are read three times)."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_slots(histogram, capacity), PLAN)
    at = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(rank_chunks)))
    within = at.withColumn("place", F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")))
    counts = at.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("length", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = within.join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    rank = F.col("rank")
    slots = F.broadcast(plan.withColumnRenamed("length", "plan_length"))  # bounded by the number of lengths
    placed = ranked.join(slots, (F.col("length") == F.col("plan_length")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to")))
    nth = rank - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + (nth % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_packing(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document row; one row per piece.

    A null text is empty and yields one piece of the end id alone, as an empty text does;
    null and repeated doc_ids are packed row by row. An empty table gives no rows. Texts of
    any length are cut into full pieces, only the first of which may be shorter.
    """
    return pack(materialize(pieces_of(documents, vocabulary, capacity), "pieces"), capacity)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary_path())
