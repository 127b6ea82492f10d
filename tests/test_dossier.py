"""Profiles, comparisons, quotes and kept columns on small tables with nulls, ties, repeats and no rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridstone.plans import dossier

FEED = "guid long, published_at timestamp_ntz, cluster string, entity long, priority double, label string, score double, source string"
SAYING = "guid long, source string, url string, title string, summary string"


def feed(spark, rows):
    made = []
    for guid, (entity, day, label, priority) in enumerate(rows):
        at = None if day is None else dt.datetime(2024, 1, day, 12)
        made.append((guid, at, "c", entity, priority, label, {"positive": 0.5, "negative": -0.5}.get(label, 0.0), "news"))
    return spark.createDataFrame(made, FEED)


def test_sentiment_labels(spark):
    rows = [(1, 1, "positive", 10.0), (1, 2, "positive", 10.0), (1, 3, "neutral", 10.0), (2, 1, "positive", 10.0), (2, 1, "negative", 10.0), (3, 1, "neutral", 10.0), (4, 1, "negative", 10.0), (None, 1, "negative", 10.0), (5, None, "negative", 10.0)]
    got = {r["cluster"]: r for r in dossier.sentiment_labels(dossier.entity_days(feed(spark, rows))).collect()}
    assert {k: (r["label"], r["recent_bias"]) for k, r in got.items()} == {"1": ("strongly positive", "positive"), "2": ("mixed", "neutral"), "3": ("neutral", "neutral"), "4": ("strongly negative", "negative")}
    assert got["1"]["acceleration"] == -0.5 and got["4"]["volatility"] == 0


def test_compared_counts_less_of_what_is_bad(spark):
    days = dossier.entity_days(feed(spark, [(1, 1, "positive", 10.0)] * 3 + [(2, 1, "negative", 90.0)] + [(3, 1, "positive", 10.0)] * 3))
    known = dossier.dimensions(days)
    assert {r["cluster"]: r["controversy"] for r in known.collect()} == {"1": 0, "2": 11, "3": 0}
    got = {(r["a"], r["b"]): r for r in dossier.compared(known).collect()}
    assert set(got) == {("1", "2"), ("1", "3"), ("2", "3")}
    assert (got["1", "3"]["wins_a"], got["1", "3"]["wins_b"], got["1", "3"]["leader"]) == (0, 0, "3")  # less than half is the other's, ties or not
    assert got["1", "2"]["wins_a"] == 5 and got["1", "2"]["leader"] == "1"  # mentions, influence, tone, controversy, polarity
    assert got["2", "3"]["leader"] == "3"


def test_quotes_kept(spark):
    rows = [
        (1, "bbc", "u1", 'Norris: "We were quick in the end"', None), (2, "sky", "u2", 'Norris: "We were quick in the end"', "x"),
        (3, "sky", "u3", 'Norris: "We were quick in the end" and more', None), (4, None, " ", "“A phrase that nobody owns”", ""), (5, "bbc", "u5", 'He was "unbelievable-pace"', None),
        (6, "bbc", "u6", 'Wolff: "http://a.example/page"', None), (7, "bbc", "u7", None, None), (8, "bbc", "u8", '"too short"', None), (None, "bbc", "u9", '"A phrase without an id here"', None),
        (10, "bbc", "u10", 'Lando Norris: "' + "word " * 12 + 'one"', None), (11, "bbc", "u11", 'Lando Norris: "' + "word " * 12 + 'two"', None),
    ]
    got = {(r["who"], r["quote"], r["url"], r["named"]) for r in dossier.quotes_kept(spark.createDataFrame(rows, SAYING)).collect()}
    long = "word " * 12
    assert got == {
        ("Norris", "We were quick in the end", "u1", True), ("sky", "We were quick in the end", "u2", False), ("Source", "A phrase that nobody owns", "#", False),
        ("Lando Norris", long + "one", "u10", True), ("bbc", long + "two", "u11", False),
    }
    assert dossier.quotes_kept(spark.createDataFrame([], SAYING)).collect() == []


def test_token_table(spark):
    rows = [(1, "s", "u", "Upgrade upgrade &amp;nbsp; https://a.example/upgrade", "<b>Floor</b> that floor"), (2, "s", "u", None, "long-run floor"), (3, "s", "u", None, None)]
    got = dossier.token_table(spark.createDataFrame(rows, SAYING), k=4).collect()
    assert [tuple(r) for r in got] == [("floor", 3), ("upgrade", 2), ("long-run", 1), ("nbsp", 1)]


def test_kept_upsert_keeps_what_a_vector_gave(spark):
    fields = "guid long, title string, cluster string, score double, label string, embedding array<float>"
    old = spark.createDataFrame([(1, "a", "X", 0.5, "positive", [1.0]), (2, "b", "X", None, None, None), (3, "c", "X", 0.1, "neutral", None)], fields)
    new = spark.createDataFrame([(1, "a2", "Y", -0.5, "negative", None), (2, "b2", "Y", -0.5, "negative", None), (4, "d", "Y", 0.0, "neutral", None)], fields)
    got = {r["guid"]: (r["title"], r["cluster"], r["score"], r["label"], r["embedding"], r["action"]) for r in dossier.kept_upsert(old, new).collect()}
    assert got == {1: ("a2", "X", 0.5, "positive", [1.0], "update"), 2: ("b2", "Y", -0.5, "negative", None, "update"), 3: ("c", "X", 0.1, "neutral", None, "keep"), 4: ("d", "Y", 0.0, "neutral", None, "insert")}
    again = dossier.kept_upsert(dossier.kept_upsert(old, new).drop("action"), new).drop("action")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, dossier.kept_upsert(old, new).drop("action").collect()), key=str)


def test_quiet_reset(spark):
    rows = feed(spark, [(1, 2, "neutral", 95.0), (2, 2, "neutral", 95.0), (2, 30, "neutral", 10.0), (3, 26, "neutral", 60.0)])
    kept = dossier.summaries(rows.where(F.dayofmonth("published_at") < 30))
    got = {r["name"]: tuple(r)[1:] for r in dossier.quiet_reset(kept, rows).collect()}
    assert got == {"c:1": (0, 0, False, True), "c:2": (1, 1, True, False), "c:3": (1, 1, False, False)}


def test_rounded_projection(spark):
    rows = [(2020, 1, 1, 7, 1, 25), (2020, 1, 2, 8, 11, 0), (2020, 1, 3, 8, 2, 18), (2020, 2, 1, 9, 3, 15), (2020, 2, 2, 8, 12, 0)]
    r = spark.createDataFrame(rows, "season int, round int, driver long, team int, grid int, points int")
    got = {x["driver"]: tuple(x)[2:] for x in dossier.rounded_projection(r, 4).collect()}
    assert got == {1: (9, 40, 40 + 2 * 15, 2, 2), 2: (8, 0, 0, 2, 2), 3: (8, 18, 18 + 2 * 2, 2, 2)}
    assert dossier.rounded_projection(r, 1).agg(F.max("races_left")).first()[0] == 0
