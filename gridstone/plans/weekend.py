"""Race weekends and stories: calendar state, session chatter, title matches, story arcs, comparisons and newsletter choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, clamp, ratio
from gridstone.operators.relational import first_independent
from gridstone.plans.insight import _mean, foremost, placed
from gridstone.plans.news import _titles, near_titles, title_classes
from gridstone.sources.tables import as_of, daily, feed, hours_ago, sql, table

#: Day on which the invented calendar is looked at.
CALENDAR_DAY = "1998-05-27"
# Sessions named in headlines, in the order in which they are tried.
SESSION_WORDS = (
    ("RACE", ("RACE RESULT", "WINS ")), ("QUALIFYING", ("QUALIFYING", " QUALI", " POLE")), ("SPRINT", ("SPRINT",)),
    ("FP3", ("FP3", "FREE PRACTICE 3")), ("FP2", ("FP2", "FREE PRACTICE 2")), ("FP1", ("FP1", "FREE PRACTICE 1")),
)
SCORED_WORDS = ("FP1", "FP2", "FP3", "QUALIFYING", "POLE", "SPRINT", "RACE DAY", "PODIUM", "FASTEST LAP")
CHATTER_WORDS = (
    "FP1", "FP2", "FP3", "FREE PRACTICE", "QUALIFYING", "POLE POSITION", "POLE LAP", "SPRINT RACE", "GRID PENALTY", "RACE RESULT", "PODIUM", "FASTEST LAP",
    "PARC FERME", "FORMATION LAP", "SAFETY CAR", "VIRTUAL SAFETY CAR", "RED FLAG", "CHEQUERED",
)
#: Headlines of the invented feed by event type; places are numbered cities.
HEADLINES = {"click": "Fastest lap seen", "purchase": "Qualifying pole taken", "signup": "FP1 report", "error": "Race result after safety car"}


def _has(text: Column, fragments) -> Column:
    out = F.lit(False)
    for f in fragments:
        out = out | F.contains(text, F.lit(f))
    return out


def calendar(s, d) -> DataFrame:
    """A race per month with orders, each once: season, round, race_date, sessions' days; every fourth round has a sprint."""
    months = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round")).agg(F.to_date(F.max("o_orderdate")).alias("race_date"))
    sprint = F.col("round") % 4 == 0
    back = lambda k: F.date_sub("race_date", k)
    return months.select("season", "round", "race_date", back(2).alias("fp1_date"), F.when(~sprint, back(1)).alias("fp3_date"), back(1).alias("quali_date"), F.when(sprint, back(1)).alias("sprint_date"))


def weekend_state(races: DataFrame, day: str = CALENDAR_DAY) -> DataFrame:
    """One row: the next race on or after the day, how far it is, and the session of the day (the first that fits)."""
    today = F.lit(day).cast("date")
    ahead = F.date_diff("race_date", today)
    sprint = F.coalesce(F.col("sprint_date") == F.col("quali_date"), F.lit(False))
    session = cascade([
        (F.col("race_date") == today, "RACE"), ((F.col("sprint_date") == today) & ~sprint, "SPRINT"), ((F.col("quali_date") == today) & sprint, "SPRINT / QUALIFYING"),
        (F.col("quali_date") == today, "QUALIFYING"), (F.col("fp3_date") == today, "FP3"), (F.col("fp1_date") == today, "FP1"), (ahead <= 5, "RACE_WEEK"),
    ], None)
    nearest = races.where(F.col("race_date") >= today).orderBy("race_date", "season", "round").limit(1)
    return nearest.select("season", "round", F.date_format("race_date", "yyyy-MM-dd").alias("race_date"), ahead.alias("days_until"), (ahead <= 5).alias("is_race_week"), session.alias("current_session"))


def headlined(articles: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in HEADLINES.items() for x in pair])
    title = F.concat(F.coalesce(F.try_element_at(names, "cluster"), F.lit("Paddock view")), F.lit(" in City"), (F.col("entity") % 12).cast("string"), F.lit("."))
    return articles.withColumn("title", title)


def session_chatter(articles: DataFrame, state: DataFrame, days: int = 5, least_priority: float = 80) -> DataFrame:
    """Recent articles of a race week that name its place or a session or are urgent, with session and relevance.

    state is one row (weekend_state) and is broadcast; without a race week there are no rows.
    """
    week = state.where("is_race_week").select("round", F.concat(F.lit("CITY"), F.col("round").cast("string"), F.lit(".")).alias("place"))
    a = articles.withColumn("upper", F.upper("title")).withColumn("age", hours_ago()).where(F.col("age").between(0, 24 * days - 1))
    a = a.crossJoin(F.broadcast(week))
    here = F.contains("upper", F.col("place"))
    rows = a.where(here | _has(F.col("upper"), CHATTER_WORDS) | (F.col("priority") >= least_priority))
    session = cascade([(_has(F.col("upper"), words), name) for name, words in SESSION_WORDS], "GENERAL")
    recency = F.when(F.col("age") < 24, 0.25).when(F.col("age") < 48, 0.15).otherwise(0.05)
    relevance = F.when(here, 0.4).otherwise(0.1) + F.when(_has(F.col("upper"), SCORED_WORDS), 0.35).otherwise(0.0) + recency
    return rows.select("guid", "round", session.alias("session"), F.round(relevance, 3).alias("relevance"))


def title_entities(articles: DataFrame, names: DataFrame) -> DataFrame:
    """Tone and reach of names that titles contain: name, articles, clusters, tone.

    Titles are met word by word, by an equality join; a nested-loop join on "contains" would
    compare every title with every name. Names are single words.
    """
    said = articles.select("guid", "cluster", "score", F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9]+"))).alias("name"))
    found = said.join(names.select("name").distinct(), "name")
    return found.groupBy("name").agg(F.count("*").alias("articles"), F.countDistinct("cluster").alias("clusters"), F.round(F.avg("score"), 4).alias("tone"))


def story_arc(days: DataFrame) -> DataFrame:
    """Phase, peak, intensity, turn of the tone and days to resolution of every series of three days or more."""
    p = placed(days).where("n >= 3")
    week, two = F.col("back") <= 6, F.col("back") <= 13
    s = p.groupBy("cluster", "n").agg(
        F.avg("mentions").alias("mean"), F.max("mentions").alias("peak"), F.min_by("day", F.struct(-F.col("mentions"), F.col("day"))).alias("peak_day"),
        (F.col("n") - 1 - F.max_by("back", F.struct("mentions", "back"))).alias("peak_at"), _mean("mentions", 0, 6).alias("recent"),
        F.coalesce(F.regr_slope(F.when(week, F.col("mentions").cast("double")), F.when(week, -F.col("back").cast("double"))), F.lit(0.0)).alias("slope"),
        _mean("tone", 0, 6).alias("tone"), F.coalesce(_mean("tone", 7, 13), F.lit(0.0)).alias("tone_before"), F.stddev_pop(F.when(two, F.col("tone"))).alias("spread"),
    )
    c = F.col
    intensity = clamp(100 * c("recent") / F.greatest(c("peak"), F.lit(1)), 0.0, 100.0)
    phase = cascade([
        (c("recent") < 0.3 * c("mean"), "dormant"), ((c("slope") > 2) & (c("recent") < 0.6 * c("peak")), "ignition"), ((c("slope") > 1) & (c("recent") > c("mean")), "amplification"),
        (intensity > 70, "peak"), ((c("slope") < -1) & (c("recent") < 0.5 * c("peak")), "resolution"), ((c("slope") > 0.5) & (c("peak_at") < c("n") - 10), "resurgence"),
    ], "dormant")
    arc = cascade([(c("spread") > 0.15, "volatile"), (c("tone") > c("tone_before") + 0.05, "improving"), (c("tone") < c("tone_before") - 0.05, "worsening")], "flat")
    s = s.withColumn("intensity", F.round(intensity, 3)).withColumn("phase", phase)
    left = F.when(c("phase").isin("peak", "resolution"), F.floor(ratio(c("recent") - 0.4 * c("mean"), F.abs("slope")) + 0.5))
    return s.select("cluster", "phase", F.date_format("peak_day", "yyyy-MM-dd").alias("peak_day"), "peak", "intensity", arc.alias("arc"), left.cast("bigint").alias("days_left"))


def compare(days: DataFrame, tie: float = 0.02) -> DataFrame:
    """Each pair of the foremost series (a < b) over mentions, tone, negative share, spread and pace: wins of either and who leads.

    Values within `tie` of the larger are tied; a series is one row by then.
    """
    p = placed(foremost(days)).groupBy("cluster").agg(F.sum("mentions").cast("double").alias("mentions"), F.avg("tone").alias("tone"), (F.sum("negative") / F.sum("mentions")).alias("negative"), F.stddev_pop("tone").alias("spread"), _mean("mentions", 0, 6).alias("pace"))
    good = {"mentions": 1, "tone": 1, "negative": -1, "spread": -1, "pace": 1}
    wide = p.select("cluster", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), (F.col(k) * v).alias("v")) for k, v in good.items()])).alias("m")).select("cluster", "m.*")
    a, b = wide.select(F.col("cluster").alias("a"), "what", F.col("v").alias("x")), wide.select(F.col("cluster").alias("b"), "what", F.col("v").alias("y"))
    gap = F.col("x") - F.col("y")
    tied = F.abs(gap) < tie * F.greatest(F.abs("x"), F.abs("y"), F.lit(0.001))
    wins = a.join(b, "what").where("a < b").groupBy("a", "b").agg(F.count_if(~tied & (gap > 0)).alias("wins_a"), F.count_if(~tied & (gap < 0)).alias("wins_b"))
    half = len(good) / 2
    return wins.withColumn("leader", F.when(F.col("wins_a") > half, F.col("a")).when(F.col("wins_b") > half, F.col("b")).otherwise("tied"))


def newsletter(titles: DataFrame) -> DataFrame:
    """The ids of the titles that a reader who drops near-duplicates of what is kept before would keep, in order of id."""
    firsts = title_classes(titles).select(F.col("first_id").alias("id")).distinct()
    return first_independent(firsts, near_titles(titles), "id").select(F.col("id").alias("doc_id"))


def _chatter(s, d) -> DataFrame:
    return session_chatter(headlined(feed(s, d)), weekend_state(calendar(s, d)))


def _entities(s, d) -> DataFrame:
    names = table(s, d, "supplier").select(F.concat(F.lit("city"), F.col("s_suppkey").cast("string")).alias("name"))
    return title_entities(headlined(feed(s, d)), names)


QUERIES = {
    "weekend_state": lambda s, d: weekend_state(calendar(s, d)),
    "session_chatter": _chatter,
    "entity_title_sentiment": _entities,
    "story_arc": lambda s, d: story_arc(daily(s, d)),
    "entity_compare": lambda s, d: compare(daily(s, d)),
    "newsletter_dedupe": lambda s, d: newsletter(_titles(s, d)),
}


def _any(column: str, fragments) -> str:
    return "(" + " or ".join(f"contains({column}, '{f}')" for f in fragments) + ")"


_CALENDAR = f"""m as (select year(o_orderdate) as season, month(o_orderdate) as round, cast(max(o_orderdate) as date) as r from orders group by 1, 2),
 state as (select season, round, strftime(r, '%Y-%m-%d') as race_date, cast(r - date '{CALENDAR_DAY}' as int) as days_until, r - date '{CALENDAR_DAY}' <= 5 as is_race_week,
  case when r = date '{CALENDAR_DAY}' then 'RACE' when r - 1 = date '{CALENDAR_DAY}' and round % 4 = 0 then 'SPRINT / QUALIFYING' when r - 1 = date '{CALENDAR_DAY}' then 'QUALIFYING'
   when r - 2 = date '{CALENDAR_DAY}' then 'FP1' when r - date '{CALENDAR_DAY}' <= 5 then 'RACE_WEEK' end as current_session from m where r >= date '{CALENDAR_DAY}' order by r limit 1)"""
_HEADLINED = "h as (select *, case cluster " + " ".join(f"when '{k}' then '{v}'" for k, v in HEADLINES.items()) + " else 'Paddock view' end || ' in City' || (entity % 12) || '.' as title from aged)"
_SERIES = ", p as (select *, row_number() over (partition by cluster order by day desc) - 1 as back, count(*) over (partition by cluster) as n from daily)"
ORACLE_SQL = {
    "weekend_state": f"with {_CALENDAR} select * from state",
    "session_chatter": sql(f""", {_HEADLINED}, {_CALENDAR}, x as (select guid, age, priority, upper(title) as u, s.round, contains(upper(title), 'CITY' || s.round || '.') as here from h, state s where s.is_race_week and age between 0 and 119)
select guid, round, case {" ".join(f"when {_any('u', w)} then '{n}'" for n, w in SESSION_WORDS)} else 'GENERAL' end as session,
 round(cast(case when here then 0.4 else 0.1 end + case when {_any('u', SCORED_WORDS)} then 0.35 else 0 end + case when age < 24 then 0.25 when age < 48 then 0.15 else 0.05 end as double), 3) as relevance
 from x where here or {_any('u', CHATTER_WORDS)} or priority >= 80""", "feed"),
    "entity_title_sentiment": sql(f""", {_HEADLINED}, w as (select guid, cluster, score, unnest(list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+'))) as name from h)
select name, count(*) as articles, count(distinct cluster) as clusters, round(avg(cast(score as double)), 4) as tone from w join (select distinct 'city' || s_suppkey as name from supplier) using (name) group by name""", "feed"),
    "story_arc": sql(_SERIES + """, s as (select cluster, n, avg(mentions) as mean, max(mentions) as peak, min(day) filter (where mentions = top) as peak_day, n - 1 - max(back) filter (where mentions = top) as peak_at,
 avg(mentions) filter (where back <= 6) as recent, coalesce(regr_slope(mentions, -back) filter (where back <= 6), 0) as slope, avg(tone) filter (where back <= 6) as tone,
 coalesce(avg(tone) filter (where back between 7 and 13), 0) as tone_before, stddev_pop(tone) filter (where back <= 13) as spread from (select *, max(mentions) over (partition by cluster) as top from p) where n >= 3 group by cluster, n),
i as (select *, least(100, greatest(0, 100 * recent / greatest(peak, 1))) as inten from s),
f as (select *, case when recent < 0.3 * mean then 'dormant' when slope > 2 and recent < 0.6 * peak then 'ignition' when slope > 1 and recent > mean then 'amplification' when inten > 70 then 'peak'
 when slope < -1 and recent < 0.5 * peak then 'resolution' when slope > 0.5 and peak_at < n - 10 then 'resurgence' else 'dormant' end as phase from i)
select cluster, phase, strftime(peak_day, '%Y-%m-%d') as peak_day, peak, round(inten, 3) as intensity, case when spread > 0.15 then 'volatile' when tone > tone_before + 0.05 then 'improving' when tone < tone_before - 0.05 then 'worsening' else 'flat' end as arc,
 case when phase in ('peak', 'resolution') then cast(floor((recent - 0.4 * mean) / nullif(abs(slope), 0) + 0.5) as bigint) end as days_left from f""", "feed", "daily"),
    "entity_compare": sql(_SERIES + """, s as (select cluster, cast(sum(mentions) as double) as m, avg(tone) as t, -sum(negative) / sum(mentions) as g, -stddev_pop(tone) as d, avg(mentions) filter (where back <= 6) as v from p group by cluster),
l as (select cluster, unnest([{'k': 1, 'v': m}, {'k': 2, 'v': t}, {'k': 3, 'v': g}, {'k': 4, 'v': d}, {'k': 5, 'v': v}]) as q from s),
j as (select a.cluster as a, b.cluster as b, a.q.v - b.q.v as gap, abs(a.q.v - b.q.v) < cast(0.02 as double) * greatest(abs(a.q.v), abs(b.q.v), 0.001) as tied from l a join l b on a.q.k = b.q.k and a.cluster < b.cluster),
w as (select a, b, count(*) filter (where not tied and gap > 0) as wins_a, count(*) filter (where not tied and gap < 0) as wins_b from j group by 1, 2)
select *, case when wins_a > 2.5 then a when wins_b > 2.5 then b else 'tied' end as leader from w""", "feed", "daily"),
}
