"""Hand-made cases: text rules, upserts, joins in time, models' invariants and streams against their batch twins."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridstone.functions.expressions import tone_label
from gridstone.operators.relational import asof_join, first_independent, islands, upsert
from gridstone.plans import news, racing, ratings, weekend
from gridstone.sources.files import csv_rows, feed_items, json_rows, write_partitioned
from gridstone.sources.tables import results, table
from gridstone.streaming.incremental import event_stream, first_seen, hourly_counts

SF = "/root/testdata/sf0.001"


def test_negation_turns_the_tone(spark):
    rows = spark.createDataFrame([("not confident after the failure",), ("win",), ("no a b c win",), (None,), ("",)], "text string")
    got = [r[0] for r in rows.select(news.lexical_sentiment(F.col("text"))).collect()]
    assert got[0] < 0
    assert got == pytest.approx([math.tanh((-0.525 - 1.2) / 3), math.tanh(0.5), math.tanh(0.5), 0, 0])


def test_tone_labels(spark):
    rows = spark.createDataFrame([(0.3,), (-0.3,), (0.1,)], "x double").select(tone_label(F.col("x"), 0.16))
    assert [r[0] for r in rows.collect()] == ["positive", "negative", "neutral"]


def test_tags_take_the_greatest_confidence(spark):
    docs = spark.createDataFrame([(1, "Stewards open an investigation; a penalty"), (2, None), (3, "quiet")], "doc_id long, text string")
    assert {tuple(r) for r in news.regulatory_tags(docs).collect()} == {(1, "INVESTIGATION", 0.92), (1, "PENALTY", 0.90)}


def test_upsert_keeps_combines_and_inserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, hash string, n int")
    new = spark.createDataFrame([(1, "a", 9), (2, "c", 3), (3, None, 1)], "k int, hash string, n int")
    out = upsert(old, new, ["k"], {"n": F.greatest("t.n", "c.n")}, "t.hash is distinct from c.hash")
    assert {tuple(r) for r in out.collect()} == {(1, "a", 5, "keep"), (2, "c", 5, "update"), (3, None, 1, "insert")}


def test_asof_and_islands(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5), (1, 10)], "g int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 5, "z")], "g int, u int, v string")
    assert {tuple(r) for r in asof_join(left, right, ["g"], "t", "u", ["v"]).collect()} == {(1, 5, "z"), (1, 1, None), (2, 5, None), (1, 10, "z")}
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None)], "g int, k int, v string")
    assert [r.island for r in islands(rows, ["g"], ["k"], "v").orderBy("k").collect()] == [1, 1, 2, 3]


def test_ratings_and_calibration(spark):
    r = results(spark, SF)
    rated = ratings.elo(r).collect()
    assert len(rated) == r.count()
    one = spark.createDataFrame([(1, 1, 7, 1)], "season int, round int, driver long, finish int")
    assert ratings.elo(one).first().rating == pytest.approx(1400 + 20 * 0.5)
    wins = [x.win for x in racing.calibration(r).orderBy("grid").collect()]
    assert wins == sorted(wins, reverse=True)


def test_streams_give_what_tables_give(spark, tmp_path):
    events = table(spark, SF, "events")
    folder = str(tmp_path / "in")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(folder)
    events.limit(5).write.mode("append").parquet(folder)
    stream = event_stream(spark, folder, events)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(first_seen(stream), "seen", "append").count() == events.count()
    got = {tuple(r) for r in run(hourly_counts(stream), "hours", "complete").collect()}
    twice = events.unionByName(events.limit(5))
    assert got == {tuple(r) for r in hourly_counts(twice).collect()}


def test_first_independent_against_a_reader(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5), (5, 6), (7, 9), (8, 9), (9, 10)]
    nodes = spark.range(1, 13).toDF("id")
    got = {r.id for r in first_independent(nodes, spark.createDataFrame(pairs, "low_id long, high_id long"), "id").collect()}
    kept: set = set()
    for k in range(1, 13):
        if not any((j, k) in pairs for j in kept):
            kept.add(k)
    assert got == kept
    none = first_independent(nodes, spark.createDataFrame([], "low_id long, high_id long"), "id")
    assert none.count() == 12


def test_newsletter_against_a_reader(spark):
    titles = [
        (1, "Team one wins the night race"), (2, "team ONE wins the night race!"), (3, "Team one wins the night race again today"), (4, "wins the race"), (5, None), (6, ""),
        (7, "A penalty for the second driver after the sprint"), (8, "A penalty for the second driver after the finish"), (9, "rain expected"), (9, "rain expected"), (None, "rain expected"),
    ]
    df = spark.createDataFrame(titles, "doc_id long, title string")
    sets = sorted((k, frozenset(t.lower().replace("!", "").split())) for k, t in titles if k and t)

    def near(a, b):
        k, small, large = len(a & b), min(len(a), len(b)), max(len(a), len(b))
        return a == b or (small >= 4 and k == small) or (large >= 5 and k / len(a | b) >= 0.58)

    kept: list = []
    for k, t in sets:
        if not any(near(t, u) for _, u in kept):
            kept.append((k, t))
    assert sorted(r.doc_id for r in weekend.newsletter(df).collect()) == sorted({k for k, _ in kept}) == [1, 4, 7, 9]
    assert weekend.newsletter(df.limit(0)).count() == 0


def test_weekend_sessions(spark):
    races = spark.sql("select 1998 as season, 8 as round, date'1998-08-09' as race_date, date'1998-08-07' as fp1_date, null as fp3_date, date'1998-08-08' as quali_date, date'1998-08-08' as sprint_date")
    races = races.withColumn("fp3_date", F.col("fp3_date").cast("date"))
    for day, session in (("1998-08-09", "RACE"), ("1998-08-08", "SPRINT / QUALIFYING"), ("1998-08-07", "FP1"), ("1998-08-05", "RACE_WEEK"), ("1998-07-01", None)):
        assert weekend.weekend_state(races, day).first().current_session == session
    assert weekend.weekend_state(races, "1998-08-10").count() == 0


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<rss><channel><title>x</title>
<item><title> One </title><link>http://a/1</link><guid>g1</guid><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Some  text&lt;/p&gt;</description></item>
<item><title>Old</title><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate></item>
<item><title>Two</title><link>http://a/2</link><pubDate>2024-01-03T12:00:00+02:00</pubDate></item>
<item><title>No key</title></item></channel></rss>""")
    got = {r.guid: r for r in feed_items(spark, str(tmp_path / "a.xml")).collect()}
    assert sorted(got) == ["g1", "http://a/2"]
    assert (got["g1"].title, got["g1"].summary, str(got["g1"].published_at)) == ("One", "Some text", "2024-01-02 10:00:00")
    assert str(got["http://a/2"].published_at) == "2024-01-03 10:00:00"
    (tmp_path / "b.json").write_text('{"k": 1, "v": "x"}\n{"k": broken\n')
    assert [(r.k, r.v, r._corrupt is None) for r in json_rows(spark, str(tmp_path / "b.json"), "k int, v string").collect()] == [(1, "x", True), (None, None, False)]
    (tmp_path / "c.csv").write_text('k,v\n1,"two\nlines, ""quoted"""\n')
    assert [tuple(r)[:2] for r in csv_rows(spark, str(tmp_path / "c.csv"), "k int, v string").collect()] == [(1, 'two\nlines, "quoted"')]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, p string")
    write_partitioned(rows, str(tmp_path / "t"), ["p"], files=2)
    write_partitioned(spark.createDataFrame([(9, "a")], "k int, p string"), str(tmp_path / "t"), ["p"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(9, "a"), (2, "b")}


def test_hours_count_whole_seconds(spark):
    """A row half a second past an hour is as old as the hour, as date_diff of seconds has it."""
    import datetime

    from gridstone.sources.tables import hours_ago

    times = ["2024-01-30 23:59:59.5", "2024-01-30 23:00:00.5", "2024-01-30 23:00:00", "2024-01-28 00:00:00.000001", "2024-01-28 00:00:01", "2024-01-31 00:00:00.5", "2024-01-31 00:00:01"]
    rows = spark.createDataFrame([(i, datetime.datetime.fromisoformat(t)) for i, t in enumerate(times)], "i int, published_at timestamp_ntz")
    assert [r[0] for r in rows.orderBy("i").select(hours_ago()).collect()] == [0, 1, 1, 72, 71, 0, -1]


def test_rounding_next_to_a_half(spark):
    """Doubles are rounded scaled, as in SQL: 0.45 * 2.3 is 1.035 in its shortest form, and less than that half when scaled."""
    import duckdb

    from gridstone.functions.expressions import rounded

    given = [(14 * n + 0.45 * (p / 100),) for n in range(3) for p in range(10, 10000, 10)]
    want = duckdb.sql("select round(x, 2) from (select unnest(?) as x)", params=[[x for (x,) in given]]).fetchall()
    got = spark.createDataFrame(given, "x double").coalesce(1).select(rounded(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [r[0] for r in want]


def test_large_fields_cost_their_rows(spark):
    """A race with very many starters: what is the same for all of them is worked out once."""
    import time

    from gridstone.plans.predictions import predictions

    n = 30_000
    r = spark.range(1, n + 1).select(F.lit(2000).alias("season"), F.lit(1).alias("round"), F.col("id").alias("driver"), F.lit(1).alias("team"), F.col("id").cast("int").alias("grid"), F.col("id").cast("int").alias("finish"), F.lit(0).alias("points"))
    began = time.time()
    got = predictions(r).where("driver = 1").collect()
    total = predictions(r).agg(F.sum("win")).first()[0]
    assert [x.win for x in got] == [round(1 / sum(1 / k for k in range(1, n + 1)), 6)] and 0.9 < total < 1.1
    assert time.time() - began < 30


def test_concentration_next_to_a_half(spark):
    """402 / 80 squared is 0.0628125, whose double lies below the half: SQL rounds it down."""
    import datetime

    from gridstone.plans.bulletin import controversy_profile

    parts = next(_parts(80, 402))
    at = datetime.datetime(2024, 1, 30)
    rows = [(k * 100 + n, at, f"c{k}", 1, 70.0, "neutral") for k, size in enumerate(parts) for n in range(size)]
    made = spark.createDataFrame(rows, "guid long, published_at timestamp_ntz, cluster string, entity long, priority double, label string")
    assert [r.concentration for r in controversy_profile(made).collect()] == [0.062812]


def _parts(total: int, squares: int):
    """Sizes with a given sum and sum of squares."""
    if total == 0:
        if squares == 0:
            yield []
        return
    for k in range(int(squares**0.5), 0, -1):
        if k <= total and k * k <= squares and (total - k) <= squares - k * k <= (total - k) ** 2:
            for rest in _parts(total - k, squares - k * k):
                yield [k, *rest]
                return
