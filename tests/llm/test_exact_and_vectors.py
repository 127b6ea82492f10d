"""Exact dedup, hard negatives and centroid clustering against SQL and brute force, with odd rows."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.llm import catalog, clusters, exact_dedup, hard_negatives

SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_hard_negatives", "op13_exponion_clusters"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.select(sorted(got.columns)).collect()) == ordered(want.project(", ".join(sorted(want.columns))).fetchall())


# exact dedup

TEXTS = ["", None, "A b", "a B", "a b ", "É", "é", "İ", "i̇", "ẞ", "ß", "K", "k", "x" * 300_000, "X" * 300_000, "line\nline", "LINE\nline", "\u0000", "日本", "日本 A", "日本 a"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_documents(spark):
    rng = random.Random(3)
    rows = [(k, t, "s", 1) for k, t in enumerate(TEXTS)] + [(100 + k, rng.choice(TEXTS), "s", 2) for k in range(60)] + [(100, TEXTS[2], "t", 3)] * 3 + [(None, "only null", "s", 4)] * 2 + [(None, "a b", "s", 4)]
    rows += [(1000 + k, f"single {k}", "s", 5) for k in range(200)] + [(5000 + k, "hot " + "HOT"[k % 3], "s", 6) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row int").repartition(5), rows


def brute_groups(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_groups_of_odd_rows(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(exact_dedup, "BROADCAST_CELLS", 0)
    docs, rows = odd_documents(spark)
    groups = brute_groups(rows)
    got = exact_dedup.exact_groups(docs).collect()
    want = Counter((i, *groups[lowered(t)], hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept, key=repr) == sorted(((keep, hashlib.sha256(t.encode()).hexdigest()) for t, (keep, _) in groups.items()), key=repr)  # one row a text, also where an id repeats


def test_keep_last_and_empty(spark):
    docs, rows = odd_documents(spark)
    groups = brute_groups(rows)
    out = exact_dedup.keep_last(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, lowered(r.text)) for r in out.collect()) == Counter((keep, t) for t, (keep, _) in groups.items())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.keep_last(docs.limit(0)).count() == 0


def test_single_rows_are_not_shuffled(spark):
    """Of many distinct texts the filter lets few through, whatever the number of rows; all repeated ones pass."""
    rows = spark.range(40_000).select(F.sha2((F.col("id") - F.when(F.col("id") >= 39_000, 1000).otherwise(0)).cast("string"), 256).alias("key"))
    cells = exact_dedup.cells_for(40_000)
    flagged = exact_dedup.flag_repeated(rows, "key", exact_dedup.repeated_words(rows, "key", cells), cells)
    n, maybe = flagged.count(), flagged.where("_gs_maybe")
    assert n == 40_000
    assert maybe.groupBy("key").count().where("count > 1").count() == 1000
    assert maybe.count() < 2000 + 0.03 * 40_000
    plan = exact_dedup.exact_groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# hard negatives


def odd_vectors(spark, n=700, dims=7, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(dims)], rng.choice([0, 1, 1, 1, 2, 9, 12345, -4])) for i in range(-100, n)]
    rows += [rows[100], rows[300], rows[301], rows[301]]  # row 0 and 200 are anchors
    rows += [(None, [0.5] * dims, 1), (None, [0.5] * dims, 1), (4000, None, 1), (4100, [0.1] * dims, None), (4200, [None] + [0.1] * (dims - 1), 1), (4300, [float("nan")] * dims, 1), (4400, [float("inf")] * dims, 1), (4500, [], 1), (4600, [0.75, 0.5], 2), (4700, [0.25] * dims, 77)]
    return spark.createDataFrame([(*r, r[0], 1) for r in rows], "vec_id long, embedding array<float>, label int, row long, class int").repartition(6), rows


def brute_negatives(rows):
    kept = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scores = [(-dot(v, w), last(j), j, m == label) for n, (j, w, m) in enumerate(kept) if n != k]
        for p, _, pid, _ in sorted((s for s in scores if s[3]), key=lambda s: s[:2])[:5]:
            fits = sorted((s for s in scores if not s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p), key=lambda s: s[:2])[:10]
            out += [(i, pid, r, s[2], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return out


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    for name, value in (("ROWS", 37), ("ANCHORS", 2), ("CHUNK", 3), ("CLASSES", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    table, rows = odd_vectors(spark)
    got = hard_negatives.hard_negatives(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert len(want) > 100
    assert ordered(got.collect()) == ordered(want)


def test_hard_negatives_without_rows(spark):
    table, _ = odd_vectors(spark, 250)
    for some in (table.limit(0), table.where("vec_id % 100 != 0"), table.where("vec_id = 0"), table.where("size(embedding) = 0"), table.where("label = 77")):
        assert hard_negatives.hard_negatives(some).count() == 0
    with pytest.raises(Exception, match="would not fit"):
        hard_negatives.hard_negatives(table.withColumn("embedding", F.transform("embedding", lambda x: x * 1e7))).count()


def test_product_is_exact_beyond_53_bits():
    rng = np.random.default_rng(1)
    for size in (50, 1 << 23):
        a, b = rng.integers(-size, size, (5, 300)).astype(np.int32), rng.integers(-size, size, (9, 300)).astype(np.int32)
        assert hard_negatives.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


# clustering


def brute_clusters(rows, centroids=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:centroids]]
    way = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        found = [min((way(v, c), k) for k, c in enumerate(at)) for _, v in kept]
        if turn < rounds:
            for k in range(len(at)):
                if own := [v for (_, v), f in zip(kept, found) if f[1] == k]:
                    at[k] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, k, d) for (i, _), (d, k) in zip(kept, found)], at


@pytest.mark.parametrize("dims,n,size,centroids", [(64, 300, 1, 16), (2, 400, 0.05, 16), (1, 300, 0.2, 5), (3, 6, 1, 16), (3, 400, 1000, 1), (2, 200, 0.02, 16)])
def test_clusters_by_brute_force(spark, dims, n, size, centroids):
    """Few different values make ties, equal centroids and empty clusters common."""
    rng = random.Random(dims * n)
    rows = [(i, [rng.uniform(-size, size) for _ in range(dims)]) for i in range(n)] + [(None, [0.1] * dims), (3, [0.1] * dims), (3, [0.1] * dims), (n + 1, None), (n + 2, [0.1] * (dims + 1)), (n + 3, []), (n + 4, [float("nan")] * dims), (n + 5, [None] * dims), (n + 6, [float("-inf")] * dims)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, cluster int, distance double").repartition(4)
    state, at = clusters.exponion_clusters(table, centroids, dims=dims)
    want, centres = brute_clusters(rows, centroids, dims=dims)
    assert at == centres
    assert ordered(state.select("vec_id", "cluster", "distance").collect()) == ordered(want)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    state, at = clusters.exponion_clusters(empty)
    assert state.count() == 0 and at == []
    with pytest.raises(Exception, match="would not fit"):
        clusters.exponion_clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>"))[0].count()


def test_search_skips_what_bounds_part():
    """Well parted groups: after a small move of the centroids most vectors compute one distance at most, with the same result as all."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (16, 8))
    x = np.concatenate([c + rng.integers(-20, 20, (200, 8)) for c in centres])
    before = clusters.Centroids.of(centres)
    cluster, upper, lower, _ = clusters.first_search(x, before)
    after = clusters.Centroids.of(centres + rng.integers(-3, 3, centres.shape), centres)
    found = clusters.exponion_search(x, cluster, upper, lower, after)
    assert found[0].tolist() == clusters.first_search(x, after)[0].tolist()
    assert found[3].sum() < 0.2 * 16 * len(x)
