"""What is published: pre-race context, daily briefing, newsletter sections, serving copies, calendar and prediction upserts, guards, cursors and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, ratio, rounded, tone_label
from gridstone.operators.relational import upsert
from gridstone.plans.ingest import TOPICS, regex_tags, team_sentiment
from gridstone.plans.weekend import _CALENDAR, CALENDAR_DAY, calendar, weekend_state
from gridstone.sources.tables import articles, as_of, hours_ago, results, sql

SESSION = ["season", "round"]
RUN = ["season", "round", "driver"]
# Weights of priority tiers, and of a story's figures with their caps, in its newsletter score (times 100); points of a sprint.
TIER_WEIGHTS = {"P0": 4800, "P1": 3400, "P2": 2200, "P3": 1000}
BREAKING, PER_SOURCE, SOURCES, PER_EVENT, EVENTS = 3500, 340, 10, 150, 18
SPRINT_POINTS = (8, 7, 6, 5, 4, 3, 2, 1)
# Kinds of controversy by the regular expression that names them.
ISSUES = (("technical", "technical|floor|scrutineer"), ("stewards", "steward|penalty|investigat"), ("cost", "cost cap|budget"), ("seat", "contract|seat|rookie"))
INCIDENT = r"\b(disqualified|disqualification|excluded|technical directive|technical breach|grid drop|penalty|stewards)\b"
INTENSITIES = {"low": 25, "medium": 50, "high": 75, "extreme": 100}
#: Sections of the newsletter in the order in which they choose, the topic they take (none: any) and how many stories.
SECTIONS = (("lead", None, 2), ("stewards", "REGULATORY", 3), ("teams", "TEAM_NEWS", 2), ("paddock", None, 4))
#: Sources by name, tier and whether they are fetched.
REGISTRY = (("official", 1, True), ("news", 2, True), ("reddit", 3, True), ("archive", 4, False))


def _topic(text: Column) -> Column:
    return cascade([(F.regexp_like(F.lower(text), F.lit(p)), n) for n, p in TOPICS], "GENERAL_F1")


def _hundredths(x: Column) -> Column:
    """x in whole hundredths, half up, as text."""
    return F.floor(100 * x + 0.5).cast("string")


def _listed(rows: DataFrame, order: list, most: int, text: Column, between: str) -> DataFrame:
    """One row: the texts of the first rows, joined. Only a top-k meets in one task."""
    top = rows.orderBy(*order).limit(most).select(F.row_number().over(W.orderBy(*order)).alias("k"), text.alias("t"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), between).alias("text"), F.count("*").alias("n"))


def pre_race_context(rows: DataFrame, races: DataFrame) -> DataFrame:
    """The next race with its risks, form, headlines and leading cluster, as text that a summary is written from; one row while there is a next race."""
    tags = regex_tags(rows, 3).groupBy("tag").agg(F.count("*").alias("n"))
    form = team_sentiment(rows.where(hours_ago().between(0, 71))).groupBy("team").agg(F.sum("articles").alias("articles"), (F.sum(F.col("tone") * F.col("articles")) / F.sum("articles")).alias("tone"))
    recent = rows.where(hours_ago().between(0, 71))
    lead = recent.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(1).select(F.col("cluster").alias("top_cluster"))
    risk = _listed(tags, [F.desc("n"), F.col("tag")], 5, F.concat("tag", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), " | ").select(F.col("text").alias("risk"), F.col("n").alias("risks"))
    said = _listed(form, [F.desc("articles"), F.col("team")], 6, F.concat("team", F.lit(": "), tone_label(F.col("tone")), F.lit(" x"), F.col("articles").cast("string")), " | ").select(F.col("text").alias("form"))
    heads = _listed(recent, [F.desc("priority"), F.col("guid")], 10, F.concat(F.lit("- "), "title"), "\n").select(F.col("text").alias("headlines"), F.col("n").alias("signals"))
    one = weekend_state(races).select(*SESSION, "race_date", "days_until")
    for part in (risk, said, heads):  # one row each
        one = one.crossJoin(F.broadcast(part))
    return one.join(F.broadcast(lead), how="left")


def daily_briefing(rows: DataFrame) -> DataFrame:
    """A briefing per day: headline, the first stories, what to watch, counts and tone, of the day's five foremost articles; every day is its own group."""
    day = F.to_date("published_at")
    place = F.row_number().over(W.partitionBy("day").orderBy(F.desc("priority"), F.desc("published_at"), "guid"))
    top = rows.withColumn("day", day).withColumn("place", place).where("place <= 5")
    per = top.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("t"), F.avg("score").alias("tone"))
    counts = rows.groupBy(day.alias("day")).agg(F.count("*").alias("signals"), F.count_if(F.col("priority") >= 90).alias("breaking"))
    titles = F.transform("t", lambda x: x["title"])
    return per.join(counts, "day").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), titles[0].alias("headline"), F.array_join(F.slice(titles, 1, 3), " | ").alias("stories"),
        F.concat(F.lit("Watch "), F.array_join(F.slice(titles, 2, 3), ", ")).alias("watch"), "signals", "breaking", _hundredths(F.col("tone")).alias("tone"), tone_label(F.col("tone")).alias("label"),
    )


def scored_stories(rows: DataFrame) -> DataFrame:
    """Stories by title with their newsletter score, topic and incident; scores are in whole points, half up."""
    tier = cascade([(F.col("priority") >= 85, "P0"), (F.col("priority") >= 70, "P1"), (F.col("priority") >= 50, "P2")], "P3")
    per = rows.groupBy("title").agg(F.min(tier).alias("tier"), F.bool_or(F.col("priority") >= 95).alias("breaking"), F.countDistinct("source").alias("sources"), F.count("*").alias("events"), F.max("published_at").alias("last"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_WEIGHTS.items() for x in kv]), F.col("tier"))
    score = weight + F.when(F.col("breaking"), BREAKING).otherwise(0) + PER_SOURCE * F.least("sources", F.lit(SOURCES)) + PER_EVENT * F.least("events", F.lit(EVENTS))
    incident = F.when(F.regexp_like(F.lower("title"), F.lit(INCIDENT)), "regulatory").otherwise("none")
    return per.select("title", "last", F.floor((score + 50) / 100).cast("bigint").alias("score"), _topic(F.col("title")).alias("topic"), incident.alias("incident"))


def sections(stories: DataFrame) -> DataFrame:
    """Sections in order each take their foremost stories that none before took. The number of sections is fixed; what is taken is a top-k each."""
    left, out = stories, None
    order = [F.desc("score"), F.desc("last"), F.col("title")]
    for name, topic, most in SECTIONS:
        fits = left if topic is None else left.where(F.col("topic") == topic)
        top = fits.orderBy(*order).limit(most).select("title", "score", "incident", F.row_number().over(W.orderBy(*order)).cast("bigint").alias("place"), F.lit(name).alias("section"))
        out = top if out is None else out.unionByName(top)
        left = left.join(F.broadcast(top.select("title")), "title", "left_anti")
    return out


def content_copy(rows: DataFrame, most: int = 5000) -> DataFrame:
    """The newest articles as the serving copy holds them: no null figures, flags as booleans."""
    newest = rows.orderBy(F.col("published_at").desc_nulls_last(), "guid").limit(most)
    return newest.select("guid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.floor("priority"), F.lit(0)).cast("bigint").alias("priority"), F.coalesce(F.col("priority") >= 90, F.lit(False)).alias("is_breaking"))


def seeded_calendar(races: DataFrame, seed: DataFrame, last_round: int = 10, day: str = CALENDAR_DAY) -> DataFrame:
    """The calendar after a seed: its races inserted or moved, rounds beyond the season's dropped, past ones marked complete."""
    met = upsert(races, seed, SESSION)
    return met.where(F.col("round") <= last_round).select(*SESSION, F.date_format("race_date", "yyyy-MM-dd").alias("race_date"), (F.col("race_date") < F.lit(day).cast("date")).alias("completed"), "action")


def stored_predictions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Predictions after an upsert: the error is computed anew where the outcome is known, else stays as it was."""
    both = upsert(stored, fresh, RUN, {"actual": F.coalesce("c.actual", "t.actual"), "error": F.col("t.error")})
    return both.withColumn("error", F.when(F.col("actual").isNotNull(), F.abs(F.col("predicted") - F.col("actual"))).otherwise(F.col("error")))


def registry(rows: DataFrame, most_tier: int = 3) -> DataFrame:
    """Sources that are fetched up to a tier, with their articles and newest time; sources without articles stay."""
    names = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(t).alias("tier"), F.lit(a).alias("active")) for n, t, a in REGISTRY])
    known = rows.sparkSession.range(1).select(F.explode(names).alias("r")).select("r.*").where(F.col("active") & (F.col("tier") <= most_tier))
    per = rows.groupBy("source").agg(F.count("*").alias("articles"), F.max("published_at").alias("newest"))
    return known.join(per, "source", "left").select("source", "tier", F.coalesce("articles", F.lit(0)).alias("articles"), F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


def cursors(rows: DataFrame) -> DataFrame:
    """Each article's page cursor, and the time and id read back from it."""
    text = F.concat_ws("|", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("guid").cast("string"))
    plain = F.unbase64("cursor").cast("string")
    out = rows.select("guid", F.base64(text.cast("binary")).alias("cursor"))
    return out.select("guid", "cursor", F.split_part(plain, F.lit("|"), F.lit(1)).alias("at"), F.split_part(plain, F.lit("|"), F.lit(2)).cast("bigint").alias("read_back"))


def velocities(rows: DataFrame) -> DataFrame:
    """Stories of the last three days by pace: counts of the last 6, 24 and 72 hours and a label of them, with the best priority's name."""
    age = hours_ago()
    n = lambda k: F.count_if(age < k)
    per = rows.where(age.between(0, 71)).groupBy("title").agg(n(6).alias("h6"), n(24).alias("h24"), F.count("*").alias("h72"), F.max("priority").alias("best"))
    label = cascade([(F.col("h6") * 4 > F.col("h24") * 2, "SURGING"), (F.col("h24") * 3 > F.col("h72"), "RISING"), (F.col("h24") > 0, "STEADY")], "FADING")
    name = cascade([(F.col("best") >= 85, "critical"), (F.col("best") >= 70, "high"), (F.col("best") >= 50, "medium")], "low")
    return per.select("title", "h6", "h24", "h72", label.alias("velocity"), name.alias("priority"))


def sprint_results(rows: DataFrame) -> DataFrame:
    """Results of sprints, held in every fourth round, with the points of a sprint; none where a season has no such round."""
    places = F.create_map(*[F.lit(x) for k, p in enumerate(SPRINT_POINTS, 1) for x in (k, p)])
    return rows.where("round % 4 = 0").select(*RUN, "team", F.col("grid").alias("finish"), F.coalesce(F.try_element_at(places, "grid"), F.lit(0)).cast("bigint").alias("sprint_points"))


def team_issues(rows: DataFrame) -> DataFrame:
    """Issues by kind: articles, distinct entities, share of their kind in all, and the kind's tone. An article may name several."""
    low = F.lower("title")
    found = F.filter(F.array(*[F.when(F.regexp_like(low, F.lit(p)), F.lit(k)) for k, p in ISSUES]), lambda x: x.isNotNull())
    met = rows.select("entity", "score", F.explode(found).alias("issue")).groupBy("issue").agg(F.count("*").alias("articles"), F.countDistinct("entity").alias("entities"), F.avg("score").alias("tone"))
    total = met.agg(F.sum("articles").alias("total"))  # one row
    return met.crossJoin(F.broadcast(total)).select("issue", "articles", "entities", F.round(F.col("articles") / F.col("total"), 6).alias("share"), tone_label(F.col("tone"), 0.05).alias("label"))


def controversy_profile(rows: DataFrame) -> DataFrame:
    """Each entity's negative articles: a score by tier, their concentration over clusters, the dominant cluster, and the way the last ten days go."""
    bad = rows.where("label = 'negative' or priority >= 60").groupBy("entity", "cluster").agg(F.count("*").alias("n"), F.count_if(hours_ago().between(0, 239)).alias("new"), F.count_if(hours_ago().between(240, 479)).alias("old"))
    top = F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster")))
    per = bad.groupBy("entity").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max("n").alias("most"), top.alias("top"), F.sum("new").alias("new"), F.sum("old").alias("old"))
    score = F.least(10 * F.col("total"), F.lit(100))
    tier = cascade([(score >= 75, "extreme"), (score >= 50, "high"), (score >= 25, "medium")], "low")
    number = F.element_at(F.create_map(*[F.lit(x) for kv in INTENSITIES.items() for x in kv]), F.col("tier"))
    way = cascade([(F.col("new") > F.col("old"), "escalating"), (F.col("new") < F.col("old"), "cooling")], "stable")
    rows = per.select("*", score.cast("bigint").alias("score"), tier.alias("tier"))
    dominant = F.when(F.col("most") > 0.45 * F.col("total"), F.col("top")).otherwise("mixed")
    return rows.select("entity", "score", "tier", number.cast("bigint").alias("intensity"), rounded(ratio(F.col("squares").cast("double"), F.col("total") * F.col("total")), 6).alias("concentration"), dominant.alias("dominant"), way.alias("trajectory"))


def due(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Clusters whose text is written anew: those not made on the day of reference, and made ones that have turned critical since."""
    recent = rows.where(hours_ago().between(0, 71)).groupBy("cluster").agg(F.max("priority").alias("best"))
    done = made.where(F.to_date("made_at") == F.to_date(as_of())).select("cluster", F.lit(True).alias("done"))
    met = recent.join(done, "cluster", "left")
    reason = cascade([(F.col("done").isNull(), "new"), (F.col("best") >= 95, "critical")], None)
    return met.select("cluster", reason.alias("reason")).where("reason is not null")


def overview(rows: DataFrame) -> DataFrame:
    """One row of the figures on the front page."""
    age = hours_ago()
    return rows.agg(
        F.count("*").alias("articles"), F.count_if(age.between(0, 23)).alias("today"), F.count_if((F.col("priority") >= 90) & age.between(0, 23)).alias("breaking"), F.countDistinct("source").alias("sources"),
        F.countDistinct(F.when(age.between(0, 71), F.col("title"))).alias("stories"), tone_label(F.coalesce(F.avg(F.when(age.between(0, 71), F.col("score"))), F.lit(0.0))).alias("tone"),
    )


def _a(f):
    return lambda s, d: f(articles(s, d))


def _seed(s, d):
    races = calendar(s, d).select(*SESSION, "race_date")
    moved = races.where("round % 3 = 0").withColumn("race_date", F.date_add("race_date", 1))
    added = races.where("round = 1").select((F.col("season") + 100).alias("season"), "round", "race_date")
    return seeded_calendar(races, moved.union(added))


def _predictions(s, d):
    r = results(s, d)
    known = lambda test, value: F.when(F.expr(test), F.col(value)).cast("int")
    stored = r.where("driver % 3 <> 0").select(*RUN, F.col("grid").alias("predicted"), F.lit(None).cast("int").alias("actual"), F.lit(-1).alias("error"))
    fresh = r.where("driver % 2 = 0").select(*RUN, (F.col("grid") + 1).alias("predicted"), known("round % 2 = 0", "finish").alias("actual"), F.lit(None).cast("int").alias("error"))
    return stored_predictions(stored, fresh)


def _due(s, d):
    a = articles(s, d)
    made = a.groupBy("cluster").agg(F.count("*")).select("cluster", F.when(F.length("cluster") % 2 == 0, as_of()).otherwise(as_of() - F.expr("interval 2 days")).alias("made_at"))
    return due(a, made)


QUERIES = {
    "pre_race_context": lambda s, d: pre_race_context(articles(s, d), calendar(s, d)),
    "daily_briefing": _a(daily_briefing),
    "newsletter_sections": _a(lambda a: sections(scored_stories(a))),
    "content_copy": _a(content_copy),
    "calendar_seed": _seed,
    "prediction_upsert": _predictions,
    "source_registry": _a(registry),
    "page_cursors": _a(cursors),
    "story_velocity": _a(velocities),
    "sprint_results": lambda s, d: sprint_results(results(s, d)),
    "team_issues": _a(team_issues),
    "controversy_profile": _a(controversy_profile),
    "generation_guard": _due,
    "intelligence_overview": _a(overview),
}

_LABEL = "case when {0} > cast({1} as double) then 'positive' when {0} < cast(-{1} as double) then 'negative' else 'neutral' end"
_TOPIC = "case " + " ".join(f"when regexp_matches(lower(title), '{p}') then '{n}'" for n, p in TOPICS) + " else 'GENERAL_F1' end"


def _sql(body: str) -> str:
    return sql(body, "feed", "articles")


def _context() -> str:
    from gridstone.plans.ingest import RULES, TEAMS

    rules = ", ".join(f"('{t}', '{p}')" for t, p, _ in RULES)
    teams = ", ".join(f"('{a}', '{t}')" for a, t in TEAMS.items())
    return _sql(f""", {_CALENDAR}, recent as (select * from articles where age between 0 and 71),
g as (select tag, count(*) as n from recent join (values {rules}) v(tag, pattern) on regexp_matches(lower(title || ' ' || summary), pattern) group by 1 order by n desc, tag limit 5),
named as (select distinct guid, score, cast(published_at as date) as day, team from recent join (values {teams}) v(alias, team) on contains(lower(title), alias)),
d as (select team, day, count(*) as articles, round(avg(cast(score as double)), 4) as tone from named group by 1, 2),
f as (select team, sum(articles) as articles, sum(tone * articles) / sum(articles) as tone from d group by 1 order by 2 desc, team limit 6),
h as (select * from recent order by priority desc, guid limit 10)
select season, round, race_date, days_until, (select string_agg(tag || ' (' || n || ')', ' | ' order by n desc, tag) from g) as risk, (select count(*) from g) as risks,
 (select string_agg(team || ': ' || {_LABEL.format('tone', 0.15)} || ' x' || articles, ' | ' order by articles desc, team) from f) as form,
 (select string_agg('- ' || title, chr(10) order by priority desc, guid) from h) as headlines, (select count(*) from h) as signals,
 (select cluster from recent group by 1 order by count(*) desc, 1 limit 1) as top_cluster from state""")


def _sections() -> str:
    body, taken = [], []
    for k, (name, topic, most) in enumerate(SECTIONS):
        tests = [f"topic = '{topic}'"] if topic else []
        tests += [f"title not in (select title from s{j})" for j in taken]
        where = " where " + " and ".join(tests) if tests else ""
        body.append(f"s{k} as (select title, score, incident, row_number() over (order by score desc, last desc, title) as place, '{name}' as section from st{where} qualify place <= {most})")
        taken.append(k)
    weights = " ".join(f"when '{t}' then {w}" for t, w in TIER_WEIGHTS.items())
    return _sql(f""", t as (select *, case when priority >= 85 then 'P0' when priority >= 70 then 'P1' when priority >= 50 then 'P2' else 'P3' end as tier from articles),
p as (select title, min(tier) as tier, bool_or(priority >= 95) as breaking, count(distinct source) as sources, count(*) as events, max(published_at) as last from t group by 1),
st as (select title, last, (case tier {weights} end + case when breaking then {BREAKING} else 0 end + {PER_SOURCE} * least(sources, {SOURCES}) + {PER_EVENT} * least(events, {EVENTS}) + 50) // 100 as score,
 {_TOPIC} as topic, case when regexp_matches(lower(title), '{INCIDENT}') then 'regulatory' else 'none' end as incident from p),
{", ".join(body)} {" union all ".join(f"select * from s{k}" for k in taken)}""")


ORACLE_SQL = {
    "pre_race_context": _context(),
    "daily_briefing": _sql(f""", t as (select *, cast(published_at as date) as day, row_number() over (partition by cast(published_at as date) order by priority desc, published_at desc, guid) as place from articles),
p as (select day, list(title order by place) as t, avg(cast(score as double)) as tone from t where place <= 5 group by 1), c as (select day, count(*) as signals, count(*) filter (where priority >= 90) as breaking from t group by 1)
select strftime(day, '%Y-%m-%d') as day, t[1] as headline, array_to_string(t[1:3], ' | ') as stories, 'Watch ' || array_to_string(t[2:4], ', ') as watch, signals, breaking,
 cast(cast(floor(100 * tone + 0.5) as bigint) as varchar) as tone, {_LABEL.format('tone', 0.15)} as label from p join c using (day)"""),
    "newsletter_sections": _sections(),
    "content_copy": _sql("select guid, coalesce(title, '') as title, coalesce(cast(floor(priority) as bigint), 0) as priority, coalesce(priority >= 90, false) as is_breaking from articles order by published_at desc nulls last, guid limit 5000"),
    "calendar_seed": f"""with m as (select year(o_orderdate) as season, month(o_orderdate) as round, cast(max(o_orderdate) as date) as r from orders group by 1, 2),
c as (select season, round, case when round % 3 = 0 then r + 1 else r end as r, case when round % 3 = 0 then 'update' else 'keep' end as action from m union all select season + 100, round, r, 'insert' from m where round = 1)
select season, round, strftime(r, '%Y-%m-%d') as race_date, r < date '{CALENDAR_DAY}' as completed, action from c where round <= 10""",
    "prediction_upsert": sql("""select season, round, driver, case when driver % 2 = 0 then grid + 1 else grid end as predicted, case when driver % 2 = 0 and round % 2 = 0 then finish end as actual,
 case when driver % 2 = 0 and round % 2 = 0 then abs(grid + 1 - finish) when driver % 3 <> 0 then -1 end as error,
 case when driver % 3 = 0 then 'insert' when driver % 2 = 0 then 'update' else 'keep' end as action from results where driver % 3 <> 0 or driver % 2 = 0""", "results"),
    "source_registry": _sql(", r as (select * from (values " + ", ".join(f"('{n}', {t}, {str(a).lower()})" for n, t, a in REGISTRY) + """) v(source, tier, active) where active and tier <= 3)
select r.source, tier, count(guid) as articles, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') as newest from r left join articles a on a.source = r.source group by 1, 2"""),
    "page_cursors": _sql("select guid, to_base64(encode(strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '|' || guid)) as cursor, strftime(published_at, '%Y-%m-%dT%H:%M:%S') as at, guid as read_back from articles"),
    "story_velocity": _sql(""", p as (select title, count(*) filter (where age < 6) as h6, count(*) filter (where age < 24) as h24, count(*) as h72, max(priority) as best from articles where age between 0 and 71 group by 1)
select title, h6, h24, h72, case when h6 * 4 > h24 * 2 then 'SURGING' when h24 * 3 > h72 then 'RISING' when h24 > 0 then 'STEADY' else 'FADING' end as velocity,
 case when best >= 85 then 'critical' when best >= 70 then 'high' when best >= 50 then 'medium' else 'low' end as priority from p"""),
    "sprint_results": sql("select season, round, driver, team, grid as finish, greatest(9 - grid, 0) as sprint_points from results where round % 4 = 0", "results"),
    "team_issues": _sql(", m as (select entity, score, issue from articles join (values " + ", ".join(f"('{k}', '{p}')" for k, p in ISSUES) + f""") v(issue, pattern) on regexp_matches(lower(title), pattern)),
p as (select issue, count(*) as articles, count(distinct entity) as entities, avg(cast(score as double)) as tone from m group by 1)
select issue, articles, entities, round(articles / cast((select sum(articles) from p) as double), 6) as share, {_LABEL.format('tone', 0.05)} as label from p"""),
    "controversy_profile": _sql(""", b as (select entity, cluster, count(*) as n, count(*) filter (where age between 0 and 239) as new, count(*) filter (where age between 240 and 479) as old from articles where label = 'negative' or priority >= 60 group by 1, 2),
p as (select entity, sum(n) as total, sum(n * n) as squares, max(n) as most, list(cluster order by n desc, cluster)[1] as top, sum(new) as new, sum(old) as old, least(10 * sum(n), 100) as score from b group by 1)
select entity, score, case when score >= 75 then 'extreme' when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end as tier, case when score >= 75 then 100 when score >= 50 then 75 when score >= 25 then 50 else 25 end as intensity,
 round(cast(squares as double) / (total * total), 6) as concentration, case when most > cast(0.45 as double) * total then top else 'mixed' end as dominant, case when new > old then 'escalating' when new < old then 'cooling' else 'stable' end as trajectory from p"""),
    "generation_guard": _sql(""", r as (select cluster, max(priority) as best from articles where age between 0 and 71 group by 1)
select cluster, case when length(cluster) % 2 = 1 then 'new' else 'critical' end as reason from r where length(cluster) % 2 = 1 or best >= 95"""),
    "intelligence_overview": _sql(f""", o as (select count(*) as articles, count(*) filter (where age between 0 and 23) as today, count(*) filter (where priority >= 90 and age between 0 and 23) as breaking, count(distinct source) as sources,
 count(distinct title) filter (where age between 0 and 71) as stories, coalesce(avg(cast(score as double)) filter (where age between 0 and 71), 0) as tone from articles)
select articles, today, breaking, sources, stories, {_LABEL.format('tone', 0.15)} as tone from o"""),
}
