"""Aliases against a reader of words, incidents against a loop, awards by hand."""

from __future__ import annotations

import datetime
import random
import re

from pyspark.sql import functions as F

from gridstone.operators.aliases import alias_spans, dictionary, plain_words
from gridstone.plans import wire
from gridstone.sources.tables import articles

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = re.sub("['’]", "", (text or "").lower())
    return re.sub("[^a-z0-9]+", " ", re.sub("#0?([0-9]+)", r"car \1", low)).split()


def reader(text, names):
    known = {" ".join(words_of(a)): e for a, e in names.items()}
    words, out, i = words_of(text), [], 0
    while i < len(words):
        for n in range(min(len(words) - i, 6), 0, -1):
            alias = " ".join(words[i : i + n])
            if alias in known:
                if known[alias]:
                    out.append((known[alias], alias, i + 1, n))
                i += n
                break
        else:
            i += 1
    return out


NAMES = {"a": "A", "a b": "AB", "b c": "BC", "a b c d": None, "red bull": "RB", "#06": "car", "mercedes": "M", "mercedes-benz stadium": None, "x'y": "XY"}


def test_aliases_against_a_reader(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "A,", "red", "bull", "bulls", "#06", "mercedes", "mercedes-benz", "stadium", "x'y", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "!!", "a" * 5000, "a " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("entity", F.lit(1)).withColumn("alias", F.lit(2))
    got = sorted(map(tuple, alias_spans(rows, "id", "t", dictionary(spark, NAMES)).collect()))
    want = sorted((k, *hit) for k, t in enumerate(texts) for hit in reader(t, NAMES))
    assert got == want and len(got) > 300
    assert alias_spans(rows.limit(0), "id", "t", dictionary(spark, NAMES)).count() == 0


def test_teams_of_all_titles(spark):
    rows = wire.wire(articles(spark, SF))
    names = {a: team for team, known in wire.TEAM_ALIASES.items() for a in known} | dict.fromkeys(wire.SHUT_OUT)
    got = sorted((r.guid, r.team, r.alias) for r in wire.teams_named(rows).collect() for _ in range(r.times))
    want = [(r.guid, e, a) for r in rows.collect() if not re.search(wire.OTHER_SPORTS, r.title.lower()) for e, a, *_ in reader(r.title, names)]
    assert got == sorted(want)
    alpine = {g for g, t, _ in got if t == "Alpine"}
    assert all(re.search("alpine,", r.title.lower()) for r in rows.collect() if "Alpines" in r.title and r.guid in alpine)


def test_incidents_across_titles(spark):
    base = datetime.datetime(2024, 1, 1)
    rng = random.Random(2)
    titles = ["Russell referred to stewards", "George excluded", "Kimi disqualified", "Stewards meet", "Miami storm threat", "quiet day", None, ""]
    rows = [(k, rng.choice(titles), base + datetime.timedelta(minutes=rng.randint(0, 20000)), rng.choice([None, 10.0, 90.0]), "s") for k in range(250)]
    rows += [(900, "Stewards meet", None, 1.0, "s")]
    table = spark.createDataFrame(rows, "guid long, title string, published_at timestamp_ntz, priority double, source string")
    got = {(r.incident, r.people, r.number): (r.begins, r.ends, r.articles, r.titles) for r in wire.incidents(table, 12).collect()}
    keys = {"Russell referred to stewards": "russell", "George excluded": "russell", "Kimi disqualified": "antonelli", "Stewards meet": "general"}
    want = {}
    for people in set(keys.values()):
        run: list = []
        number = 0
        for _, t, at, *_ in [*sorted((r for r in rows if keys.get(r[1]) == people and r[2]), key=lambda r: r[2]), (0, None, datetime.datetime.max, 0, 0)]:
            if run and at - run[-1][1] > datetime.timedelta(hours=12):
                number += 1
                want["regulatory-technical", people, number] = (str(run[0][1]), str(run[-1][1]), len(run), len({x[0] for x in run}))
                run = []
            run.append((t, at))
    assert {k: v for k, v in got.items() if k[0] == "regulatory-technical"} == want and len(want) > 20
    assert any(v[3] > 1 for v in got.values())  # several titles, one incident
    assert wire.incidents(table.limit(0)).count() == 0


def test_tests_on_titles_are_not_pushed_to_articles(spark):
    """What a title says is worked out once a title and stored: no plan that is left tests the titles of articles by expressions."""
    rows = wire.wire(articles(spark, SF))
    for found in (wire.story_keys(rows), wire.incidents(rows), wire.stories(rows), wire.teams_named(rows)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "stewards|" not in plan and "pga" not in plan
    assert not wire.incidents(rows).inputFiles()  # articles are totalled and stored by then


def test_incidents_with_no_gap_and_ties(spark):
    base = datetime.datetime(1999, 12, 31, 23, 59, 58)
    at = lambda s: base + datetime.timedelta(seconds=s)
    rows = [(1, "Stewards meet", at(0), 5.0), (2, "Stewards sit", at(0), 5.0), (3, "Stewards rise", at(1), None), (4, "Stewards meet", at(7202), 5.0), (5, "Stewards sit", at(7203), 5.0), (6, "Stewards sit", at(14404), 5.0)]
    table = spark.createDataFrame(rows, "guid long, title string, published_at timestamp_ntz, priority double")
    got = lambda hours: sorted((r.number, r.begins[11:], r.ends[11:], r.articles, r.titles, r.lead) for r in wire.incidents(table, hours).collect())
    assert got(2) == [(1, "23:59:58", "23:59:59", 3, 3, "Stewards meet"), (2, "02:00:00", "02:00:01", 2, 2, "Stewards sit"), (3, "04:00:02", "04:00:02", 1, 1, "Stewards sit")]
    assert [r[0] for r in got(0)] == [1, 2, 3, 4, 5] and [r[:1] + r[3:] for r in got(3)] == [(1, 6, 3, "Stewards sit")]


def test_awards_by_hand(spark):
    told = spark.createDataFrame([("a", "A", True, 9, 1, 100, 5, False), ("b", "B", False, 9, 7, 90, 9, False), ("c", "C", False, 9, 6, 90, 9, False), ("d", "D", True, 1, 1, 10, 0, False)], "story string, title string, driver boolean, articles long, sources long, score long, momentum long, breaking boolean")
    got = sorted((r.label, r.place, r.story) for r in wire.awards(told, 2).collect())
    assert got == sorted([("Main character energy", 1, "a"), ("Biggest siren", 1, "b"), ("Receipts department", 1, "c"), ("Momentum merchant", 1, "d")])
    assert wire.awards(told.limit(0)).count() == 0


def test_words_and_narratives(spark):
    rows = spark.createDataFrame([("Lewis' #06 car—won't STOP",), (None,), ("...",)], "t string").select(plain_words(F.col("t")))
    assert [r[0] for r in rows.collect()] == [["lewis", "car", "6", "car", "wont", "stop"], [], []]
    names = spark.createDataFrame([("DRIVER_NEWS",), ("constructor",), (None,), ("FIA",), ("grand prix",)], "c string").select(wire.narrative(F.col("c")))
    assert [r[0] for r in names.collect()] == ["DRIVER", "GENERAL", "GENERAL", "REGULATION", "GENERAL"]
