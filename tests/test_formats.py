"""Lenient rows, overlays, GeoJSON, Atom, pages and predictions: broken, empty and repeated ones."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gridstone.functions.lenient import counted, overlaid, said
from gridstone.plans import formats, predictions, ratings
from gridstone.sources.files import all_feed_items, atom_items
from gridstone.sources.geo import features, outline, read_features
from gridstone.sources.paged import PagedReader, PagedSource


def test_numbers_of_any_spelling(spark):
    values = [("1", 1.0), ('"2.5"', 2.5), ('" 7 "', 7.0), ('""', 0.0), ("true", 1.0), ("false", 0.0), ('"many"', None), ('"1,5"', None), ('"1e2"', 100.0), ('"NaN"', None), ('"Infinity"', None), ('"1e999"', None), ('{"a":1}', None), ("[1]", None), ("null", 9.0), ('"-.5"', -0.5)]
    rows = spark.createDataFrame([(k, f'{{"n":{v},"m":9}}') for k, (v, _) in enumerate(values)] + [(99, "{}"), (100, "[]"), (101, "broken")], "k long, raw string")
    parsed = rows.select("k", F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("{}"))).alias("v"))
    got = {r.k: r.n for r in parsed.select("k", counted(F.col("v"), "n", "m").alias("n")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(values)} | {99: 0.0, 100: 0.0, 101: 0.0}
    nested = spark.createDataFrame([('{"a":{"b":"x"},"c":null}',)], "raw string").select(F.parse_json("raw").alias("v"))
    assert nested.select(said(F.col("v"), "c", "a.b")).first()[0] == "x"
    out = formats.lenient_rows(spark.createDataFrame([(1, None), (2, "nonsense"), (3, '{"driverName":"x","mentions":"many"}')], "guid long, raw string")).orderBy("guid").collect()
    assert [(r.name, r.mentions, r.label, r.top) for r in out] == [("UNKNOWN", 0.0, "neutral", None), ("UNKNOWN", 0.0, "neutral", None), ("x", None, "neutral", None)]


def test_overlays(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "9", "c": "3", "a": None}), ({"a": "1"}, None), (None, {"z": "0"}), (None, None)], "d map<string,string>, s map<string,string>")
    assert [r[0] for r in rows.select(overlaid(F.col("d"), F.col("s"))).collect()] == [{"a": "1", "b": "9", "c": "3"}, {"a": "1"}, {"z": "0"}, {}]


def test_geojson_of_every_kind(spark, tmp_path):
    feature = lambda kind, at, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": at}}
    texts = [
        json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [[[0, 0, 7], [2, 1], [0, 0]], [[9, 9]]], id="p", Name="P"), feature("MultiPolygon", [[[[5, 5], [6, 7]]], [[[0, 0]]]], id="m", name="M"), feature("LineString", [[1.5, 2], [3, 4]], id=7)]}),
        json.dumps(feature("LineString", [[1, 1], [2]], id="one")), json.dumps(feature("Point", [1, 2], id="pt")), json.dumps(feature("Polygon", [["x"]], id="bad")), json.dumps(feature("Polygon", [], id="empty")),
        json.dumps({"type": "Feature", "geometry": None}), '{"type":"FeatureCollection"}', "{", "", None, '{"type":"FeatureCollection","features":[]}',
    ]
    rows = spark.createDataFrame([(t, 1, "x") for t in texts], "value string, id int, points string")
    got = {(r.id, r.name, r.n, r.west, r.east, r.south, r.north, r.closed) for r in outline(features(rows)).collect()}
    assert got == {("p", "P", 3, 0.0, 2.0, 0.0, 1.0, True), ("m", "M", 2, 5.0, 6.0, 5.0, 7.0, False), ("7", "Unknown Circuit", 2, 1.5, 3.0, 2.0, 4.0, False), ("one", "Unknown Circuit", 1, 1.0, 1.0, 1.0, 1.0, True)}
    (tmp_path / "a.geojson").write_text(json.dumps(json.loads(texts[0]), indent=1))
    assert read_features(spark, f"{tmp_path}/*.geojson").count() == 3


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title type="html">One &amp; &lt;b&gt;two&lt;/b&gt;</title><link rel="enclosure" href="http://x/e"/><link href="http://x/1"/><id>u1</id><updated>2024-01-01T10:00:00Z</updated><summary></summary><content type="html">&lt;p&gt;Body&lt;/p&gt;</content></entry>
<entry><title>Changed</title><link href="http://x/2" rel="alternate"/><published>2024-01-02T00:00:00+01:00</published><updated>2024-02-02T00:00:00Z</updated><summary>S</summary></entry>
<entry><title>No link</title><id>u3</id></entry><entry><link href="http://x/4"/></entry>
<entry><title>Odd date</title><link rel="self" href="http://x/5"/><published>yesterday</published></entry></feed>"""
RSS = """<rss><channel><item><title>Older</title><link>http://x/2</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>d</description></item>
<item><title>Only here</title><guid>g9</guid><link>http://x/9</link></item></channel></rss>"""


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    (tmp_path / "again.xml").write_text(ATOM)
    (tmp_path / "r.xml").write_text(RSS)
    got = {r.guid: (r.title, r.link, r.summary, str(r.published_at)) for r in atom_items(spark, f"{tmp_path}/a*.xml").collect()}
    assert got == {"u1": ("One & two", "http://x/1", "Body", "2024-01-01 10:00:00"), "http://x/2": ("Changed", "http://x/2", "S", "2024-01-01 23:00:00"), "http://x/5": ("Odd date", "http://x/5", "", "None")}
    both = {r.guid: r.title for r in all_feed_items(spark, f"{tmp_path}/*.xml").collect()}
    assert both == {"u1": "One & two", "http://x/2": "Changed", "http://x/5": "Odd date", "g9": "Only here"}


def pages(folder, total, limit, lost=(), short=()):
    for offset in range(0, max(total, 1), limit):
        if offset not in lost:
            rows = [{"k": k, "x": None if k % 3 else k / 2} for k in range(offset, min(offset + limit, total))][: -1 if offset in short else None]
            at = folder / f"offset={offset}"
            at.mkdir(parents=True)
            (at / "part-0.txt").write_text(json.dumps({"total": total, "rows": rows}) + "\n")
    return f"file://{folder}"


def flaky_source():
    """Classes of a function are pickled with their code, so workers need not import this module."""

    class Flaky(PagedReader):
        def fetch(self, offset):
            from pathlib import Path

            mark = Path(self.path.removeprefix("file://")).parent / f"tried-{offset}"
            if not mark.exists():
                mark.touch()
                raise OSError("the line dropped")
            return super().fetch(offset)

    class FlakySource(PagedSource):
        reader_type = Flaky

        @classmethod
        def name(cls):
            return "flaky"

    return FlakySource


def test_pages_give_each_row_once(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    spark.dataSource.register(flaky_source())
    load = lambda path, kind="paged": spark.read.format(kind).schema("k bigint, x double").option("path", path).option("limit", 10).option("pause", 0.01).load()
    for total in (0, 1, 10, 35):
        rows = load(pages(tmp_path / f"t{total}", total, 10)).collect()
        assert sorted(r.k for r in rows) == list(range(total)) and all(r.x == (None if r.k % 3 else r.k / 2) for r in rows)
    assert load(pages(tmp_path / "f" / "pages", 25, 10), "flaky").count() == 25
    for name, kind in (("lost", {"lost": (10,)}), ("short", {"short": (10,)}), ("first", {"lost": (0,)})):
        with pytest.raises(Exception):
            load(pages(tmp_path / name, 35, 10, **kind)).collect()


def plain_ratings(races, new=1400.0):
    held, out = {}, {}
    for number in sorted({r[1] for r in races}):
        field = [r for r in races if r[1] == number]
        mean = sum(held.get(d, new) for _, _, d, _, _ in field) / len(field)
        moved = {d: held.get(d, new) + k * (s - 1 / (1 + 10 ** ((mean - held.get(d, new)) / 400))) for _, _, d, s, k in field}
        out |= {(number, d): (held.get(d, new), moved[d]) for d in moved}
        held |= moved
    return out


@pytest.mark.parametrize("block", [1, 3, 16])
def test_ratings_are_carried(spark, block):
    import random

    rng = random.Random(block)
    races = [(lane, number, d, round(rng.random(), 3), 20.0) for lane in (0, 7) for number in range(1, 9 if lane else 6) for d in rng.sample(range(9), rng.randint(1, 6)) if not (lane and number == 3)]
    table = spark.createDataFrame(races, "lane long, number long, driver long, score double, k double")
    got = {(r.lane, r.number, r.driver): (r.before, r.after) for r in ratings.carried(table, block).collect()}
    want = {(lane, n, d): v for lane in (0, 7) for (n, d), v in plain_ratings([r for r in races if r[0] == lane]).items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert ratings.carried(table.limit(0), block).count() == 0


def test_sprints_follow_races(spark):
    rows = spark.createDataFrame([(2021, 1, 1, 1), (2021, 1, 2, 2), (2022, 1, 2, 1), (2022, 1, 1, 2), (2022, 1, 3, None)], "season int, round int, driver long, finish int")
    got = {(r.kind, r.season, r.driver): (r.before, r.after) for r in ratings.elo_with_sprints(rows, rows.where("season = 2021")).collect()}
    assert got["R", 2021, 1] == (1400.0, 1404.0)  # 40 * 0.2 * 0.5
    assert got["S", 2021, 1][0] == got["R", 2022, 1][1] and len(got) == 6
    assert ratings.elo_with_sprints(rows, rows.limit(0)).count() == 4


def test_prediction_rules(spark):
    p = spark.createDataFrame([(1, 1, 5, 9, "dev_a", 1, 0.9, 0.9, 900, "known", 1), (1, 1, 5, 9, "prod_a", 1, 0.5, 0.2, 10, "Unknown", 2), (1, 1, 6, 9, "prod_a", 2, 0.4, 0.1, 10, "Unknown", 1), (1, 2, 5, 9, "dev_b", 1, 0.3, 0.1, 50, None, 1)], "season int, round int, driver long, team int, model string, predicted long, win double, podium double, made long, circuit string, actual long")
    assert {(r.round, r.model, r.models) for r in predictions.rounds(p).collect()} == {(1, "prod_a", 2), (2, "dev_b", 1)}
    assert tuple(predictions.latest_race(p).first()) == (1, 1)
    assert {(r.round, r.favourite, r.spread, r.pool, r.tone) for r in predictions.tone(p).collect()} == {(1, 5, 0.1, 1, "Lean, not lock"), (2, 5, 0.0, 0, "Open field")}
    assert predictions.history(p.limit(0)).count() == 0
    import datetime as dt

    races = spark.createDataFrame([(1, 1, dt.date(2024, 1, 10)), (1, 2, dt.date(2024, 2, 10)), (2, 1, dt.date(2024, 1, 10))], "season int, round int, race_date date")
    at = lambda *a: dt.datetime(2024, *a)
    sessions = spark.createDataFrame([(1, 3, at(1, 9, 12), False), (1, 4, at(1, 10, 12), False), (1, 5, at(1, 10, 0), True), (1, 6, at(2, 12, 0), False), (1, 7, None, False)], "season int, number long, begins timestamp_ntz, cancelled boolean")
    got = {(r.season, r.round): (r.number, r.seconds_off) for r in predictions.nearest_session(races, sessions).collect()}
    assert got == {(1, 1): (3, 43200), (1, 2): (None, None), (2, 1): (None, None)}
