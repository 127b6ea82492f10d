"""Near titles: exact pairs, and few candidates where many titles share a word."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridstone.plans.news import _meeting, _title_sets, near_titles


def letters(n: int) -> str:
    return "".join(chr(97 + int(d)) for d in str(n))


@pytest.fixture(scope="module")
def unlike(spark):
    """300 titles of twelve words, of which one is in all and the others in one each."""
    rows = [(i, " ".join(["zebra", *(f"w{letters(i)}x{letters(k)}" for k in range(11))])) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, title string")


def test_unlike_titles_do_not_meet(spark, unlike):
    """Titles that share a word only are ruled out inside the join: they are no pairs that are shuffled."""
    common = unlike.withColumn("title", F.regexp_replace("title", "x[a-z]+", ""))  # two words each: zebra is in every prefix
    for titles in (unlike, common.union(unlike.select(F.col("doc_id") + 1000, "title"))):
        sets = _title_sets(titles).groupBy("tokens").agg(F.min("doc_id").alias("id"))
        assert _meeting(sets, 0.58, 4, 5).count() < 20


def test_near_pairs_are_exact(spark):
    rng = random.Random(5)
    names = [letters(k) + "q" for k in range(60)]
    kinds = [rng.sample(names, rng.randint(1, 25)) for _ in range(60)]
    sets = {i: frozenset(w for w in rng.choice(kinds) if rng.random() < 0.85) for i in range(400)}
    sets |= {1000 + i: frozenset(letters(k) for k in range(i, i + 200)) for i in range(0, 120, 10)}  # more words than the bit maps have bits free
    first: dict = {}
    for i, s in sets.items():
        if s:
            first.setdefault(s, i)
    want = set()
    for (x, i), (y, j) in itertools.combinations(first.items(), 2):
        small, large = sorted((x, y), key=len)
        if (len(small) >= 4 and small <= large) or (len(large) >= 5 and len(x & y) / len(x | y) >= 0.58):
            want.add((min(i, j), max(i, j)))
    got = near_titles(spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, title string"))
    assert want and {(r.low_id, r.high_id) for r in got.collect()} == want


def test_dropped_nodes_are_stored_once(spark, monkeypatch):
    """A chain takes a round for every other node; what earlier rounds dropped is not written again."""
    from gridstone.operators import relational

    written, whole = [], relational.stored

    def counted(df):
        if df.columns == ["node"]:
            written.append(df.count())
        return whole(df)

    monkeypatch.setattr(relational, "stored", counted)
    nodes = spark.range(9).withColumnRenamed("id", "key")
    edges = spark.range(8).selectExpr("id as low_id", "id + 1 as high_id")
    kept = relational.first_independent(nodes, edges, "key")
    assert sorted(r.key for r in kept.collect()) == [0, 2, 4, 6, 8]
    assert sum(written) == 4
