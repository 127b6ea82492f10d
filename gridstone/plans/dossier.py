"""What is known of an entity and who said what: sentiment profiles, comparisons over eight dimensions, quotes, words, kept columns, quiet summaries, rounded projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, clamp
from gridstone.operators.relational import upsert
from gridstone.plans.insight import foremost, influence, placed, profile
from gridstone.sources.tables import POINTS, articles, feed, hours_ago, results, sql, table

# Words that are no topic, and leftovers of markup.
STOP = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "as", "at", "by", "from", "into",
    "is", "are", "was", "were", "it", "this", "that", "these", "those", "be", "been", "being",
    "will", "would", "can", "could", "should", "may", "might",
    "they", "their", "them", "he", "she", "his", "her", "you", "your", "we", "our", "i", "me", "my", "us",
    "after", "before", "during", "over", "under", "again", "new", "latest", "says", "say", "said",
    "also", "just", "more", "one", "two", "first", "last", "has", "have", "had", "not", "but", "what",
    "href", "span", "class", "style", "sport", "strong", "table", "thead", "tbody",
    "width", "height", "color", "align", "font", "type", "name", "data", "text",
    "http", "https", "www", "com", "reddit", "html", "head", "body",
)
# A phrase in quotes, one with a name before it, and what makes a phrase no quote.
ANY_QUOTE = r'["“”](.*?)["“”]'
NAMED_QUOTE = r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s*:\s*" + ANY_QUOTE
JUNK = r"^http|^/|<|>|\{|text-align|class=|^[\w-]+$"
LEAST_QUOTE, QUOTE_KEY = 12, 60
# A comparison's tie, the recent days and how much more is a bias, points expected of who is not predicted.
TIE, RECENT, BIAS, EXPECTED = 0.02, 7, 1.3, 2.0
#: What the wire adds to titles in turn, so that some are quotes and some only look like them.
SAID = (
    "", ' - Norris: "We were quick but the tyres went away"', " Lando Norris : “Box now, box now, box now”", ' "unbelievable-pace"', ' Wolff: "http://example.com/quotes" and "a second phrase of car {n}"',
    ' Sainz: "short"', ' Albon: "Car {n} was never on the right side of it all"', ' "class=quote of the day" Russell: "', ' Hamilton: "We had a plan and we kept to it, lap {n}"',
)


def entity_days(rows: DataFrame) -> DataFrame:
    """A row per entity (as `cluster`) and day with articles: mentions, tone, positive, neutral, negative, heavy. Rows without entity or time are left out."""
    known = rows.where("entity is not null and published_at is not null")
    count = lambda label: F.count_if(F.col("label") == label).alias(label)
    return known.groupBy(F.col("entity").cast("string").alias("cluster"), F.to_date("published_at").alias("day")).agg(F.count("*").alias("mentions"), F.avg("score").alias("tone"), count("positive"), count("neutral"), count("negative"), F.count_if(F.col("priority") >= 70).alias("heavy"))


def _polarity() -> Column:
    return (F.col("positive") - F.col("negative")) / F.greatest(F.col("positive") + F.col("neutral") + F.col("negative"), F.lit(1))


def sentiment_labels(days: DataFrame) -> DataFrame:
    """How an entity is spoken of: polarity, subjectivity, the bias of its last seven days, volatility, acceleration and a label.

    Neutral where under a quarter takes sides, mixed where the sides are even.
    """
    late = lambda c: F.sum(F.when(F.col("back") < RECENT, F.col(c))).alias(f"late_{c}")
    s = placed(days).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("positive", "neutral", "negative")], late("positive"), late("negative"))
    s = s.join(profile(days).select("cluster", "volatility", "acceleration"), "cluster")
    sides = (F.col("positive") + F.col("negative")) / F.greatest(F.col("positive") + F.col("neutral") + F.col("negative"), F.lit(1))
    bias = cascade([(F.col("late_positive") > F.col("late_negative") * BIAS, "positive"), (F.col("late_negative") > F.col("late_positive") * BIAS, "negative")], "neutral")
    p = F.col("polarity")
    label = cascade([(F.col("subjectivity") < 0.25, "neutral"), (p > 0.4, "strongly positive"), (p > 0.1, "positive"), (p < -0.4, "strongly negative"), (p < -0.1, "negative")], "mixed")
    s = s.withColumn("polarity", _polarity()).withColumn("subjectivity", sides)
    return s.select("cluster", "positive", "neutral", "negative", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"), bias.alias("recent_bias"), "volatility", "acceleration", label.alias("label"))


#: Dimensions of a comparison, and whether more of it is better.
DIMENSIONS = {"mentions": True, "influence": True, "tone": True, "delta": True, "controversy": False, "polarity": True, "volatility": False, "velocity": True}


def dimensions(days: DataFrame) -> DataFrame:
    """Each of the foremost entities with its value in every dimension; influence is scaled over all entities, whatever is missing counts as 0."""
    p = placed(foremost(days))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("tone")))
    two_weeks = F.col("back") <= 13
    s = p.groupBy("cluster").agg(
        F.sum("mentions").alias("mentions"), *[F.sum(c).alias(c) for c in ("positive", "neutral", "negative", "heavy")], F.avg("tone").alias("tone"), (at(0) - at(1)).alias("delta"), F.stddev_pop("tone").alias("volatility"),
        F.regr_slope(F.when(two_weeks, F.col("mentions").cast("double")), F.when(two_weeks, -F.col("back").cast("double"))).alias("velocity"),
    )
    s = s.withColumn("controversy", clamp(6 * F.col("negative") + 5 * F.col("heavy"), 0, 100)).withColumn("polarity", _polarity()).join(influence(days), "cluster")
    return s.select("cluster", *[F.coalesce(F.round(F.col(c).cast("double"), 6), F.lit(0.0)).alias(c) for c in DIMENSIONS])


def compared(known: DataFrame) -> DataFrame:
    """Each pair (a < b) of entities with the dimensions that either wins and who leads.

    Values within 2 % of the larger are tied. a leads with more than half of all dimensions, b as soon as a has
    less than half, ties or not.
    """
    wide = known.select("cluster", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), (F.col(k) if up else -F.col(k)).alias("v")) for k, up in DIMENSIONS.items()])).alias("m")).select("cluster", "m.*")
    a, b = wide.select(F.col("cluster").alias("a"), "what", F.col("v").alias("x")), wide.select(F.col("cluster").alias("b"), "what", F.col("v").alias("y"))
    gap, most = F.col("x") - F.col("y"), F.greatest(F.abs("x"), F.abs("y"), F.lit(0.001))
    won = lambda which: F.count_if((F.abs(gap) >= most * TIE) & which)
    pairs = a.join(b, "what").where("a < b").groupBy("a", "b").agg(won(gap > 0).alias("wins_a"), won(gap < 0).alias("wins_b"))
    half = len(DIMENSIONS) / 2
    return pairs.select("a", "b", "wins_a", "wins_b", F.when(F.col("wins_a") > half, F.col("a")).when(F.col("wins_a") < half, F.col("b")).otherwise("tied").alias("leader"))


def spoken(rows: DataFrame) -> DataFrame:
    """Articles with something said, or what looks like it, after their title, invented from each row's id."""
    said = F.replace(F.element_at(F.array(*[F.lit(t) for t in SAID]), (F.col("guid") % len(SAID) + 1).cast("int")), F.lit("{n}"), (F.col("guid") % 40).cast("string"))
    return rows.withColumn("title", F.concat("title", said))


def quotes_kept(rows: DataFrame) -> DataFrame:
    """who, quote, url, named of each quote once: by the name before it, else by the article's source.

    An article's named quote counts if it is none of the junk and no article with a smaller guid has it; otherwise its
    first phrase in quotes does, on the same terms. Quotes are the same if who and the first sixty characters are.
    Null titles and summaries are empty, articles without a source are by "Source", those without a url get "#".
    """
    text = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    some = lambda c, otherwise: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(otherwise))
    fit = lambda q: F.when((F.length(q) >= LEAST_QUOTE) & ~F.regexp_like(q, F.lit(JUNK)), q)
    found = lambda pattern, k: fit(F.trim(F.regexp_extract("text", pattern, k)))
    met = rows.where("guid is not null").select("guid", some(F.col("source"), "Source").alias("source"), some(F.col("url"), "#").alias("url"), text.alias("text"))
    met = met.select("guid", "source", "url", F.regexp_extract("text", NAMED_QUOTE, 1).alias("name"), found(NAMED_QUOTE, 2).alias("named_quote"), found(ANY_QUOTE, 1).alias("any_quote"))

    def first(rows: DataFrame, who: str, quote: str, named: bool) -> DataFrame:
        best = F.min(F.struct("guid", F.col(quote).alias("quote"), "url")).alias("r")
        per = rows.where(F.col(quote).isNotNull()).groupBy(F.col(who).alias("who"), F.left(F.col(quote), F.lit(QUOTE_KEY)).alias("key")).agg(best)
        return per.select("r.guid", "who", "r.quote", "r.url", F.lit(named).alias("named"))

    named = first(met, "name", "named_quote", True)
    others = met.join(named.select("guid"), "guid", "left_anti")
    return named.unionByName(first(others, "source", "any_quote", False)).drop("guid")


def token_table(rows: DataFrame, k: int = 12, least: int = 4) -> DataFrame:
    """The k most frequent words of titles and summaries without links, markup and stop words (ties: by the word); a character reference counts as a space."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    for pattern, by in ((r"&#?[a-z0-9]+;", " "), (r"https?://\S+", ""), (r"<[^>]+>", " "), (r"[^a-z0-9\s-]", " ")):
        text = F.regexp_replace(text, pattern, by)
    words = rows.select(F.explode(F.split(text, r"\s+")).alias("word")).where((F.length("word") >= least) & ~F.col("word").isin(*STOP))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


KEPT = ("cluster", "score", "label")


def kept_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored articles after new ones: rows that have a vector keep what was worked out from it; title, priority, time and source are the new one's."""
    keep = {c: F.when(F.col("t.embedding").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"c.{c}")) for c in KEPT} | {"embedding": F.col("t.embedding")}
    return upsert(stored, new, ["guid"], keep)


def _stored_and_new(s, d) -> tuple[DataFrame, DataFrame]:
    rows = articles(s, d).select("guid", "title", "source", "cluster", F.col("score").cast("double").alias("score"), "label", "priority")
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("guid"), "embedding")
    old = rows.where("guid % 5 <> 4").join(vectors, "guid", "left")
    changed = rows.where("guid % 5 <> 0").select("guid", F.concat("title", F.lit(" (updated)")).alias("title"), "source", F.lit("GENERAL").alias("cluster"), (F.col("score") / 2).alias("score"), F.lit("neutral").alias("label"), "priority")
    return old, changed.withColumn("embedding", F.lit(None).cast(vectors.schema["embedding"].dataType))


QUIET_HOURS, ACTIVE_HOURS = 7 * 24, 72


def summaries(rows: DataFrame) -> DataFrame:
    """name, article_count, momentum (articles of priority 50 and more), is_spike, updated (hours ago) of each cluster and entity."""
    name = F.concat_ws(":", "cluster", F.col("entity").cast("string"))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("article_count"), F.count_if(F.col("priority") >= 50).alias("momentum"), F.bool_or(F.col("priority") >= 90).alias("is_spike"), F.min(hours_ago()).alias("updated"))


def quiet_reset(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored summaries, those set to nothing that were not updated for seven days and whose name no recent article has."""
    active = summaries(rows.where(hours_ago().between(0, ACTIVE_HOURS - 1))).select("name", F.lit(True).alias("active"))
    quiet = (F.col("updated") >= QUIET_HOURS) & F.col("active").isNull()
    return kept.join(active, "name", "left").select("name", F.when(quiet, 0).otherwise(F.col("article_count")).cast("long").alias("article_count"), F.when(quiet, 0).otherwise(F.col("momentum")).cast("long").alias("momentum"), (F.col("is_spike") & ~quiet).alias("is_spike"), quiet.alias("reset"))


def _kept_summaries(rows: DataFrame) -> DataFrame:
    """Summaries as they were stored: every third entity's some days ago."""
    return summaries(rows.where((F.col("entity") % 3 != 0) | (hours_ago() >= 10 * 24)))


def rounded_projection(r: DataFrame, rounds: int = 14) -> DataFrame:
    """Every season's points and, in whole points, what they come to: the points of the place that the last race's grid predicts for each race left, two where it has no place for a driver."""
    last = r.groupBy("season").agg(F.max("round").alias("last"), F.countDistinct("round").alias("races_done"))  # a row a season
    place = F.when(F.col("round") == F.col("last"), F.col("grid"))
    per = r.join(F.broadcast(last), "season").groupBy("season", "driver", "races_done").agg(F.max_by("team", "round").alias("team"), F.sum("points").cast("long").alias("points"), F.max(place).alias("place"))
    expected = F.when(F.col("place").isNull(), F.lit(EXPECTED)).otherwise(F.coalesce(F.try_element_at(F.array(*[F.lit(float(p)) for p in POINTS]), F.col("place").cast("int")), F.lit(0.0)))
    left = F.greatest(F.lit(rounds) - F.col("races_done"), F.lit(0))
    return per.select("season", "driver", "team", "points", F.floor(F.col("points") + expected * left + 0.5).cast("long").alias("projected"), "races_done", left.cast("long").alias("races_left"))


QUERIES = {
    "sentiment_labels": lambda s, d: sentiment_labels(entity_days(feed(s, d))),
    "entity_dimensions": lambda s, d: dimensions(entity_days(feed(s, d))),
    "entity_duels": lambda s, d: compared(dimensions(entity_days(feed(s, d)))),
    "quotes_kept": lambda s, d: quotes_kept(spoken(articles(s, d))),
    "token_table": lambda s, d: token_table(articles(s, d)),
    "kept_upsert": lambda s, d: kept_upsert(*_stored_and_new(s, d)).select("guid", "title", "source", "cluster", "score", "label", "priority", F.col("embedding").isNotNull().alias("has_vector"), "action"),
    "quiet_reset": lambda s, d: quiet_reset(_kept_summaries(feed(s, d)), feed(s, d)),
    "rounded_projection": lambda s, d: rounded_projection(results(s, d)),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DAYS = """, daily as (select cast(entity as varchar) as cluster, cast(published_at as date) as day, count(*) as mentions, avg(cast(score as double)) as tone, count(*) filter (where label = 'positive') as positive, count(*) filter (where label = 'neutral') as neutral,
 count(*) filter (where label = 'negative') as negative, count(*) filter (where priority >= 70) as heavy from feed group by 1, 2), p as (select *, row_number() over (partition by cluster order by day desc) - 1 as back, count(*) over (partition by cluster) as n from daily)"""
_DIMENSIONS = _DAYS + """, i as (select cluster, sum(mentions) as m, avg(tone) as t, sum(heavy) as h, count(*) as d from daily group by 1),
inf as (select cluster, round(100 * (0.45::double * coalesce((m - min(m) over ()) / nullif(max(m) over () - min(m) over (), 0), 0.5) + 0.2::double * coalesce((t - min(t) over ()) / nullif(max(t) over () - min(t) over (), 0), 0.5)
 + 0.2::double * coalesce((h - min(h) over ()) / nullif(max(h) over () - min(h) over (), 0), 0.5) + 0.15::double * coalesce((d - min(d) over ()) / nullif(max(d) over () - min(d) over (), 0), 0.5)), 3) as influence from i),
top as (select cluster from daily group by 1 order by sum(mentions) desc, 1 limit 200),
s as (select cluster, sum(mentions) as mentions, sum(positive) as pos, sum(neutral) as neu, sum(negative) as neg, sum(heavy) as heavy, avg(tone) as tone, max(tone) filter (where back = 0) - max(tone) filter (where back = 1) as delta,
 stddev_pop(tone) as volatility, regr_slope(mentions, -back) filter (where back <= 13) as velocity from p semi join top using (cluster) group by 1),
dims as (select cluster, cast(mentions as double) as mentions, influence, round(tone, 6) as tone, coalesce(round(delta, 6), 0) as delta, cast(least(100, 6 * neg + 5 * heavy) as double) as controversy,
 round((pos - neg)::double / greatest(pos + neu + neg, 1), 6) as polarity, round(volatility, 6) as volatility, coalesce(round(velocity, 6), 0) as velocity from s join inf using (cluster))"""
_JUNK = "length({0}) >= 12 and not (starts_with({0}, 'http') or starts_with({0}, '/') or contains({0}, '<') or contains({0}, '>') or contains({0}, '{{') or contains({0}, 'text-align') or contains({0}, 'class=') or regexp_full_match({0}, '[\\w-]+'))"


def _fit(name: str) -> str:
    return f"case when {_JUNK.format(name)} then {name} end"


ORACLE_SQL = {
    "sentiment_labels": sql(_DAYS + """, k as (select *, n - 1 - back as k, n // 2 as mid from p),
s as (select cluster, n, cast(sum(positive) as bigint) as positive, cast(sum(neutral) as bigint) as neutral, cast(sum(negative) as bigint) as negative, sum(positive) filter (where back < 7) as lp, sum(negative) filter (where back < 7) as ln, stddev_pop(tone) as v,
 max(tone) filter (where k = 0) as a, max(tone) filter (where k = mid - 1) as b, max(tone) filter (where k = mid) as c, max(tone) filter (where k = n - 1) as d from k group by 1, 2),
r as (select *, (positive - negative)::double / greatest(positive + neutral + negative, 1) as pi, (positive + negative)::double / greatest(positive + neutral + negative, 1) as su from s)
select cluster, positive, neutral, negative, round(pi, 6) as polarity, round(su, 6) as subjectivity, case when lp > ln * 1.3::double then 'positive' when ln > lp * 1.3::double then 'negative' else 'neutral' end as recent_bias, round(v, 5) as volatility,
 round(d - c - case when n // 2 > 1 then b - a else 0 end, 5) as acceleration, case when su < 0.25 then 'neutral' when pi > 0.4::double then 'strongly positive' when pi > 0.1::double then 'positive' when pi < -0.4::double then 'strongly negative' when pi < -0.1::double then 'negative' else 'mixed' end as label from r""", "feed"),
    "entity_dimensions": sql(_DIMENSIONS + " select * from dims", "feed"),
    "entity_duels": sql(_DIMENSIONS + """, l as (select cluster, unnest([{'k': 1, 'v': mentions}, {'k': 2, 'v': influence}, {'k': 3, 'v': tone}, {'k': 4, 'v': delta}, {'k': 5, 'v': -controversy}, {'k': 6, 'v': polarity}, {'k': 7, 'v': -volatility}, {'k': 8, 'v': velocity}]) as q from dims),
j as (select a.cluster as a, b.cluster as b, a.q.v - b.q.v as gap, greatest(abs(a.q.v), abs(b.q.v), 0.001::double) * 0.02::double as tie from l a join l b on a.q.k = b.q.k and a.cluster < b.cluster),
w as (select a, b, count(*) filter (where gap > 0 and abs(gap) >= tie) as wins_a, count(*) filter (where gap < 0 and abs(gap) >= tie) as wins_b from j group by 1, 2)
select *, case when wins_a > 4 then a when wins_a < 4 then b else 'tied' end as leader from w""", "feed"),
    "quotes_kept": sql(f""", w as (select guid, source, url, trim(title || replace([{', '.join(_quoted(t) for t in SAID)}][cast(guid % {len(SAID)} + 1 as int)], '{{n}}', cast(guid % 40 as varchar)) || ' ' || summary) as text from articles),
x as (select *, regexp_extract(text, '{NAMED_QUOTE}', 1) as name, trim(regexp_extract(text, '{NAMED_QUOTE}', 2)) as nq, trim(regexp_extract(text, '{ANY_QUOTE}', 1)) as aq from w),
y as (select guid, source, url, name, {_fit('nq')} as nq, {_fit('aq')} as aq from x),
a as (select distinct on (name, left(nq, 60)) guid, name as who, nq as quote, url, true as named from y where nq is not null order by name, left(nq, 60), guid),
b as (select distinct on (source, left(aq, 60)) guid, source as who, aq as quote, url, false as named from y where aq is not null and guid not in (select guid from a) order by source, left(aq, 60), guid)
select * exclude (guid) from a union all select * exclude (guid) from b""", "feed", "articles"),
    "token_table": sql(f""", t as (select regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title || ' ' || summary), '&#?[a-z0-9]+;', ' ', 'g'), 'https?://\\S+', '', 'g'), '<[^>]+>', ' ', 'g'), '[^a-z0-9\\s-]', ' ', 'g') as text from articles),
w as (select unnest(regexp_split_to_array(text, '\\s+')) as word from t)
select word, count(*) as n from w where length(word) >= 4 and word not in ({', '.join(_quoted(x) for x in STOP)}) group by 1 order by 2 desc, 1 limit 12""", "feed", "articles"),
    "kept_upsert": sql(""", old as (select a.*, e.vec_id is not null and e.embedding is not null as has from articles a left join embeddings e on vec_id = guid where guid % 5 <> 4), new as (select * from articles where guid % 5 <> 0)
select coalesce(o.guid, n.guid) as guid, case when n.guid is null then o.title else n.title || ' (updated)' end as title, coalesce(n.source, o.source) as source, case when n.guid is null or coalesce(o.has, false) then o.cluster else 'GENERAL' end as cluster,
 cast(case when n.guid is null or coalesce(o.has, false) then o.score else n.score / 2 end as double) as score, case when n.guid is null or coalesce(o.has, false) then o.label else 'neutral' end as label, coalesce(n.priority, o.priority) as priority,
 coalesce(o.has, false) as has_vector, case when o.guid is null then 'insert' when n.guid is null then 'keep' else 'update' end as action from old o full join new n on o.guid = n.guid""", "feed", "articles"),
    "quiet_reset": sql(""", named as (select *, cluster || ':' || entity as name from aged),
k as (select name, count(*) as article_count, count(*) filter (where priority >= 50) as momentum, bool_or(priority >= 90) as is_spike, min(age) as updated from named where entity % 3 <> 0 or age >= 240 group by 1),
q as (select *, updated >= 168 and name not in (select name from named where age between 0 and 71) as reset from k)
select name, case when reset then 0 else article_count end as article_count, case when reset then 0 else momentum end as momentum, is_spike and not reset as is_spike, reset from q""", "feed"),
    "rounded_projection": sql(f""", l as (select season, max(round) as last, count(distinct round) as races_done from results group by 1),
d as (select r.season, driver, races_done, arg_max(team, round) as team, cast(sum(points) as bigint) as points, max(grid) filter (where round = last) as place from results r join l using (season) group by 1, 2, 3)
select season, driver, team, points, cast(floor(points + case when place is null then 2.0 else coalesce([{', '.join(map(str, POINTS))}][place], 0) end * greatest(14 - races_done, 0) + 0.5) as bigint) as projected, races_done, greatest(14 - races_done, 0) as races_left from d""", "results"),
}
