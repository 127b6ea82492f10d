"""Rows in the shapes in which others hand them over: lenient keys, season overlays, GeoJSON, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions.lenient import entity_row, overlaid
from gridstone.sources.files import scratch
from gridstone.sources.geo import features, outline
from gridstone.sources.paged import PagedSource
from gridstone.sources.tables import results, sql, table

PAGE = 100


def raw_rows(events: DataFrame) -> DataFrame:
    """guid, raw: an entity's row as JSON text, spelled in one of seven ways, one of them broken."""
    n, who, tone = F.floor("value").cast("long").cast("string"), F.concat(F.lit("d"), F.col("user_id").cast("string")), (F.col("event_id") % 7 - 3).cast("string")
    ways = (
        F.concat(F.lit('{"driverName":"'), who, F.lit('","mentions":'), n, F.lit(',"sentimentAvg":'), tone, F.lit("}")),
        F.concat(F.lit('{"driver_name":"'), who, F.lit('","mention_count":"'), n, F.lit('","sentiment_avg":"'), tone, F.lit('.5","positive_count":"1e2"}')),
        F.concat(F.lit('{"entityName":"'), who, F.lit('","mentionCount":" '), n, F.lit(' ","sentimentDelta":true,"lastDate":"2024-01-01"}')),
        F.concat(F.lit('{"entity_name":"'), who, F.lit('","total_mentions_7d":"many","overall_label":"hot","negativeCount":"-3"}')),
        F.concat(F.lit('{"driverName":null,"driver_name":"'), who, F.lit('","mentions":null,"mentionCount":"","neutral_count":"1,5"}')),
        F.concat(F.lit('{"driverName":"'), who),
        F.concat(F.lit('{"mentions":{"x":1},"mention_count":'), n, F.lit(',"top_cluster":"c","date":20240101}')),
    )
    return events.select(F.col("event_id").alias("guid"), F.element_at(F.array(*ways), (F.floor(F.col("event_id") / 3) % len(ways) + 1).cast("int")).alias("raw"))


def lenient_rows(raw: DataFrame) -> DataFrame:
    """guid and one schema of fields, whatever the spelling; a text that is no JSON gives the defaults."""
    parsed = raw.select("guid", F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("{}"))).alias("v"))
    return parsed.select("guid", *entity_row(F.col("v")))


def season_overlay(r: DataFrame) -> DataFrame:
    """season, round, name, value: each race's settings, the circuit's defaults with the season's own over them."""
    races = r.select("season", "round").distinct()
    text = lambda c: c.cast("string")
    default = F.create_map(F.lit("laps"), text(50 + F.col("round")), F.lit("drs"), text(F.col("round") % 3), F.lit("safety_car"), F.lit("0.3"))
    own = F.when((F.col("season") + F.col("round")) % 3 == 0, F.create_map(F.lit("laps"), text(60 + F.col("season") % 10), F.lit("drs"), F.lit(None).cast("string"), F.lit("extra"), F.lit("x")))
    return races.select("season", "round", F.explode(overlaid(default, own)).alias("name", "value"))


def circuit_texts(supplier: DataFrame) -> DataFrame:
    """FeatureCollections of up to fifty circuits a text: polygons, multipolygons, lines, a type that has no line, broken coordinates and none."""
    k = F.col("s_suppkey")
    point = lambda i: F.concat(F.lit("["), (k * 7 % 300 - 150 + i).cast("string"), F.lit(","), (k * 3 % 120 - 60 + i * i).cast("string"), F.lit(",5]"))
    points = F.array_join(F.transform(F.sequence(F.lit(0), (k % 4 + 2).cast("int")), point), ",")
    ring = F.concat(F.lit("["), points, F.lit(","), point(F.lit(0)), F.lit("]"))
    kinds = (
        F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit(",[[0,0],[1,1],[0,0]]]}")), F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],[[[9,9],[8,8],[9,9]]]]}")),
        F.concat(F.lit('{"type":"LineString","coordinates":['), points, F.lit("]}")), F.lit('{"type":"Point","coordinates":[1,2]}'), F.lit('{"type":"Polygon","coordinates":[["x"]]}'), F.lit("null"),
    )
    name = F.element_at(F.array(F.lit("Name"), F.lit("name"), F.lit("title")), (k % 3 + 1).cast("int"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":"c'), k.cast("string"), F.lit('","'), name, F.lit('":"Circuit '), k.cast("string"), F.lit('"},"geometry":'), F.element_at(F.array(*kinds), (F.floor(k / 3) % len(kinds) + 1).cast("int")), F.lit("}"))
    group = supplier.select("s_nationkey", F.floor(k / 50).alias("part"), feature.alias("f")).groupBy("s_nationkey", "part").agg(F.array_join(F.collect_list("f"), ",").alias("all"))
    return group.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value"))


def paged_standings(s: SparkSession, d: str) -> DataFrame:
    """Career standings read back from pages of a hundred: the pages are written by Spark, a folder a page, and read by a task each."""
    keys = table(s, d, "supplier").select(F.col("s_suppkey").alias("driver"))
    per = results(s, d).groupBy("driver").agg(F.sum("points").alias("points"), F.count_if(F.col("finish") == 1).alias("wins"))
    size = keys.agg(F.min("driver").alias("first"), F.count("*").alias("total"))  # one row
    rows = keys.join(per, "driver", "left").crossJoin(F.broadcast(size)).select("total", "driver", (F.floor((F.col("driver") - F.col("first")) / PAGE) * PAGE).alias("offset"), F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("wins", F.lit(0)).alias("wins"))
    page = F.to_json(F.struct(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("driver", "points", "wins"))).alias("rows")))  # a hundred rows
    folder = scratch(s, "pages")
    rows.groupBy("offset").agg(page.alias("value")).write.mode("overwrite").partitionBy("offset").text(folder)
    s.dataSource.register(PagedSource)
    return s.read.format("paged").schema("driver bigint, points bigint, wins bigint").option("path", folder).option("limit", PAGE).load()


QUERIES = {
    "lenient_rows": lambda s, d: lenient_rows(raw_rows(table(s, d, "events"))),
    "season_overlay": lambda s, d: season_overlay(results(s, d)),
    "circuit_outlines": lambda s, d: outline(features(circuit_texts(table(s, d, "supplier")))),
    "paged_standings": paged_standings,
}

_RAW = """raw as (select event_id as guid, [
 '{"driverName":"d' || user_id || '","mentions":' || cast(floor(value) as bigint) || ',"sentimentAvg":' || (event_id % 7 - 3) || '}',
 '{"driver_name":"d' || user_id || '","mention_count":"' || cast(floor(value) as bigint) || '","sentiment_avg":"' || (event_id % 7 - 3) || '.5","positive_count":"1e2"}',
 '{"entityName":"d' || user_id || '","mentionCount":" ' || cast(floor(value) as bigint) || ' ","sentimentDelta":true,"lastDate":"2024-01-01"}',
 '{"entity_name":"d' || user_id || '","total_mentions_7d":"many","overall_label":"hot","negativeCount":"-3"}',
 '{"driverName":null,"driver_name":"d' || user_id || '","mentions":null,"mentionCount":"","neutral_count":"1,5"}',
 '{}',
 '{"mentions":{"x":1},"mention_count":' || cast(floor(value) as bigint) || ',"top_cluster":"c","date":20240101}'][cast(event_id // 3 % 7 + 1 as int)] as raw from events)"""


def _said(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(raw, '$.{k}')" for k in keys) + ", null)"


def _counted(*keys: str) -> str:
    text = f"trim({_said(*keys)})"
    return f"case when {_said(*keys)} is null then 0.0::double when {text} = '' then 0 when {text} = 'true' then 1 when {text} = 'false' then 0 else try_cast({text} as double) end"


ORACLE_SQL = {
    "lenient_rows": f"""with {_RAW} select guid, coalesce({_said('driverName', 'driver_name', 'entityName', 'entity_name')}, 'UNKNOWN') as name, {_counted('mentions', 'mentionCount', 'mention_count', 'total_mentions_7d')} as mentions,
 {_counted('sentimentAvg', 'sentiment_avg', 'sentiment_7d_avg')} as sentiment, {_counted('sentimentDelta', 'sentiment_delta', 'sentimentTrend', 'sentiment_trend')} as delta, coalesce({_said('sentimentLabel', 'sentiment_label', 'overall_label')}, 'neutral') as label,
 {_counted('positiveCount', 'positive_count')} as positive, {_counted('negativeCount', 'negative_count')} as negative, {_counted('neutralCount', 'neutral_count')} as neutral, {_said('topCluster', 'top_cluster')} as top, {_said('lastDate', 'last_mentioned', 'date')} as last from raw""",
    "season_overlay": sql(""", r as (select distinct season, round from results), d as (select season, round, 'laps' as name, cast(50 + round as varchar) as value from r union all select season, round, 'drs', cast(round % 3 as varchar) from r union all select season, round, 'safety_car', '0.3' from r),
o as (select season, round, 'laps' as name, cast(60 + season % 10 as varchar) as value from r where (season + round) % 3 = 0 union all select season, round, 'drs', null from r where (season + round) % 3 = 0 union all select season, round, 'extra', 'x' from r where (season + round) % 3 = 0)
select season, round, name, coalesce(o.value, d.value) as value from d full join o using (season, round, name)""", "results"),
    "circuit_outlines": """with k as (select s_suppkey as k, s_suppkey // 3 % 6 as kind, s_suppkey % 4 + 3 as m from supplier)
select 'c' || k as id, case when k % 3 = 2 then 'Unknown Circuit' else 'Circuit ' || k end as name, m + case when kind < 2 then 1 else 0 end as n, cast(k * 7 % 300 - 150 as double) as west, cast(k * 7 % 300 - 150 + m - 1 as double) as east,
 cast(k * 3 % 120 - 60 as double) as south, cast(k * 3 % 120 - 60 + (m - 1) * (m - 1) as double) as north, kind < 2 as closed from k where kind < 3""",
    "paged_standings": sql(" select s_suppkey as driver, cast(coalesce(sum(points), 0) as bigint) as points, count(*) filter (where finish = 1) as wins from supplier left join results on driver = s_suppkey group by 1", "results"),
}
