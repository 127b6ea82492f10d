"""Two-level operators against plain loops: small chunks, ties, nulls, empty tables, one group with a third of all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridstone.operators.prefix import highest_within, quantiles, ranks, running, sweep
from gridstone.plans import control


def spells(rng, n):
    out = []
    for _ in range(n):
        start = rng.randint(0, 60)
        out.append((rng.choice(["hot", "hot", "a", "b"]), start, start + rng.randint(-2, 15), rng.choice([1, 1, 2, 3, None])))
    return out + [("c", None, 4, 1), ("c", 3, None, 2)]


def plain_level(rows, by, x):
    return max((lvl for b, s, e, lvl in rows if b == by and None not in (s, e, lvl) and s <= x < e), default=0)


@pytest.mark.parametrize("seed,n,width", [(1, 60, 7), (2, 5, 1), (3, 200, 1000), (4, 0, 3)])
def test_sweep_and_spans(spark, seed, n, width):
    rng = random.Random(seed)
    rows = spells(rng, n)
    table = spark.createDataFrame(rows, "g string, start_at long, stop_at long, level int").repartition(3)
    got = sorted((r.g, r.from_at, r.to_at, r.level, r.most) for r in sweep(table, ["g"], 3, width).collect())
    want = []
    for g in ("hot", "a", "b", "c"):
        at = 0
        while at < 90:
            end = at
            while end < 90 and plain_level(rows, g, end) == plain_level(rows, g, at):
                end += 1
            if level := plain_level(rows, g, at):
                want.append((g, at, end, level, max(sum(1 for b, s, e, lvl in rows if b == g and None not in (s, e, lvl) and s <= x < e) for x in range(at, end))))
            at = end
    assert got == sorted(want)
    starts = [(g, k, at) for g in ("hot", "a", "z") for k, at in enumerate([0, 5, 5, 9, 30, 31], 1)]
    spans = spark.createDataFrame(starts, "g string, number long, at long")
    found = {(r.g, r.number): r.level for r in highest_within(spans, table, ["g"], 3, width).collect()}
    for g, k, at in starts:
        until = min((a for h, j, a in starts if h == g and j == k + 1), default=200)
        assert found[g, k] == max((plain_level(rows, g, x) for x in range(at, until)), default=0)


def test_running_totals(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("ab"), at, rng.choice([None, 1, 2, -3])) for at in range(150)]
    out = running(spark.createDataFrame(rows, "g string, at long, x long").withColumn("top", F.col("x")), ["g"], "at", 11, sums=["x"], maxes=["top"], last=["g"]).collect()
    assert len(out) == 150
    for r in out:
        upto = [(a, x) for g, a, x in rows if g == r.g and a <= r.at]
        assert r.x == sum(x or 0 for _, x in upto)
        assert r.top == max((x for _, x in upto if x is not None), default=None)
        before = [a for a, _ in upto if a < r.at]
        assert (r.previous.at if r.previous else None) == (max(before) if before else None)


@pytest.mark.parametrize("pieces", [1, 4, 32])
def test_quantiles_and_ranks(spark, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, 7.0, 7.0, rng.randint(0, 40) / 4, -1.5])) for _ in range(500)] + [("one", 3.0), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    known = table.where("g is not null")
    want = {r.g: (r.a, r.b, r.c) for r in known.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in (("a", 0.25), ("b", 0.5), ("c", 0.9))]).where("a is not null").collect()}
    got = {r.g: (r.a, r.b, r.c) for r in quantiles(known, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}, pieces).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    plain = known.selectExpr("g", "v", "rank() over (partition by g order by v nulls last) as rank")
    assert sorted(map(tuple, ranks(known, ["g"], "v", pieces=pieces).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert quantiles(known.limit(0), ["g"], "v", {"a": 0.5}).count() == 0 and ranks(known.limit(0), ["g"], "v").count() == 0


def test_cuts_that_differ_each_time(spark, monkeypatch):
    """A sketch depends on the order of its rows, which differs each time it is worked out on several executors: wherever it cuts, results are exact."""
    anywhere = F.pandas_udf(lambda v: sorted(random.SystemRandom().uniform(v.min(), v.max()) for _ in range(7)), "array<double>", F.PandasUDFType.GROUPED_AGG)
    monkeypatch.setattr(F, "percentile_approx", lambda v, *_: anywhere(v))
    table = spark.range(2000).select((F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 1000 / 4).alias("v"))
    want = {r.g: (r.a, r.b) for r in table.groupBy("g").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.75).alias("b")).collect()}
    plain = table.selectExpr("g", "v", "rank() over (partition by g order by v) as rank").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables: no broadcast holds the cuts for both sides
    try:
        assert {r.g: (r.a, r.b) for r in quantiles(table, ["g"], "v", {"a": 0.25, "b": 0.75}).collect()} == want
        assert sorted(map(tuple, ranks(table, ["g"], "v").collect())) == sorted(map(tuple, plain))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_status_ranges_by_hand(spark):
    """Before the first lap, repeated, unknown, to the end; a session without laps has none."""
    events = [("s", -5, 1, "4"), ("s", 3, 2, "4"), ("s", 12, 3, "1"), ("s", 25, 4, "9"), ("s", 31, 5, "2"), ("s", 45, 6, "6"), ("t", 1, 7, "5"), ("s", 60, 8, None)]
    starts = [("s", 1, 0), ("s", 2, 10), ("s", 3, 20), ("s", 4, 30), ("s", 5, 40), ("s", 6, 50)]
    got = control.status_ranges(spark.createDataFrame(events, "session string, at long, event_id long, code string"), spark.createDataFrame(starts, "session string, lap long, at long"))
    assert sorted(map(tuple, got.select("lap_start", "lap_end", "status").collect())) == [(1, 1, "SC"), (3, 3, "STATUS_9"), (5, 5, "VSC"), (6, 6, "STATUS_")]


def test_messages_and_frame(spark):
    raw = [("s", 1, "3", "Flag", "  RED FLAG "), ("s", 2, "x", None, "y" * 1500), ("s", 3, None, "Drs", "NaN"), ("s", 4, "4.0", "", None), ("s", 5, "4", "Flag", "\t"), ("s", 6, "1e30", "Flag", "SAFETY CAR")]
    kept = control.load_messages(spark.createDataFrame(raw, "session string, event_id long, lap string, category string, message string"))
    assert sorted((r.event_id, r.lap, r.category, len(r.message)) for r in kept.collect()) == [(1, 3, "Flag", 8), (2, None, "OTHER", 1000), (6, None, "Flag", 10)]
    assert control.safety_car(kept).first().active
    starts = spark.createDataFrame([("s", 1, 0), ("s", 2, 10)], "session string, lap long, at long")
    readings = spark.createDataFrame([("s", 5, 20.0, False), ("s", 9, 21.0, True)], "session string, at long, air double, rain boolean")
    none = spark.createDataFrame([], "session string, start_at long, stop_at long, level int")
    frame = sorted(map(tuple, control.race_frame(starts, readings, none).select("lap", "status", "air", "rain", "messages").collect()))
    assert frame == [(1, "CLEAR", 20.0, False, 0), (2, "CLEAR", 21.0, True, 0)]
