"""Feed ingestion and serving: clean-up of summaries, topics, priorities, stories, tags, team tone, search, candidates and retention."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, clamp, once, tone_label
from gridstone.sources.tables import articles, hours_ago, sql

# Markers from which official summaries are cut.
FOOTERS = (
    " FIA Formula One World Championship", " Formula One World Championship", " FIA Formula 1", " FIA Formula One", " About the FIA", " About Tomorrow.io", " SEASON ",
    " Thursday,", " Wednesday,", " Tuesday,", " Monday,", " Sunday,", " Saturday,", " Friday,",
)
# Topics in order, with their expressions over lower-cased text.
TOPICS = (
    ("REGULATORY", r"\b(fia|steward|penalty|appeal|regulation|technical directive|scrutineering)\b"),
    ("DRIVER_NEWS", r"\b(contract|seat|rookie|driver|verstappen|norris|piastri|hamilton|leclerc|russell|alonso|sainz)\b"),
    ("TEAM_NEWS", r"\b(ferrari|mercedes|mclaren|red bull|williams|aston martin|alpine|haas|sauber|racing bulls|cadillac)\b"),
    ("RACE_WEEKEND", r"\b(qualifying|sprint|race|practice|session|pole|podium|win)\b"),
)
# Base priorities of sources, and expressions that raise them.
BASE = {"official": 74, "reddit": 42}
RAISES = ((r"\b(breaking|penalty|disqualified|investigation|appeal|crash|fire|injury|cancelled|canceled)\b", 18), (r"\b(wins|pole|championship|stewards|fia|technical directive|regulation)\b", 10))
RELEVANT = r"\b(f1|formula 1|formula one|fia formula one|fia formula 1|formula-1|/formula-1/)\b"
# Regulatory rules with their confidences.
RULES = (
    ("INVESTIGATION", r"\b(investigat(?:e|ed|ion)|under review|summoned|stewards?)\b", 0.95),
    ("PENALTY", r"\b(penalt(?:y|ies)|grid drop|time penalty|reprimand|disqualif(?:y|ied|ication))\b", 0.95),
    ("TECHNICAL_DIRECTIVE", r"\b(technical directive|td\s*\d+|scrutineer|illegal car|technical regulation)\b", 0.93),
    ("COST_CAP", r"\b(cost cap|financial regulation|budget cap|overspend)\b", 0.96),
    ("SAFETY", r"\b(safety regulation|medical car|red flag|unsafe release|safety car procedure)\b", 0.82),
    ("LICENSING", r"\b(super licen[cs]e|penalty points|licen[cs]e points)\b", 0.92),
    ("SPORTING_REGULATION", r"\b(sporting regulation|race control|fia rule|rules breach|parc ferm[eé])\b", 0.88),
    ("POWER_UNIT", r"\b(power unit allocation|engine penalty|power unit penalty)\b", 0.88),
)
#: Of each rule, pieces of text of which every text that meets it has one: looking for them costs far less than the rule's expression.
PIECES = {
    "INVESTIGATION": ("investigat", "under review", "summoned", "steward"),
    "PENALTY": ("penalt", "grid drop", "reprimand", "disqualif"),
    "TECHNICAL_DIRECTIVE": ("technical directive", "td", "scrutineer", "illegal car", "technical regulation"),
    "COST_CAP": ("cost cap", "financial regulation", "budget cap", "overspend"),
    "SAFETY": ("safety regulation", "medical car", "red flag", "unsafe release", "safety car procedure"),
    "LICENSING": ("licen", "penalty points"),
    "SPORTING_REGULATION": ("sporting regulation", "race control", "fia rule", "rules breach", "parc ferm"),
    "POWER_UNIT": ("power unit allocation", "engine penalty", "power unit penalty"),
}
# Entities that summaries use, with their signs; & comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&#32;", " "), ("&nbsp;", " "), ("&amp;", "&"))
# Community feeds' boilerplate: who submitted, links to the thread, empty brackets.
SUBMITTED, THREAD, EMPTY = r"(?i)\s*submitted by\s*/u/[^\s]+\s*(?:\[[^\]]*\]\s*)*\s*$", r"(?i)\s*\[(?:link|comments?)\]\s*", r"\s*\[\s*\]\s*"
# Elements whose text is no text, and tags.
UNREAD, TAGS = r"(?is)<(script|style).*?</\1>", "<[^>]+>"
#: What every ninth summary has besides, as feeds have it.
MARKUP = " <script>var a = '<p>no</p>';</script>It&#039;s &apos;that&apos;&#32;&nbsp;&amp;lt; <STYLE>p {}</STYLE><b>bold</b>"
# Signals of the client's tone and heat.
GOOD = ("great", "good", "love", "fast", "quick", "strong", "impressive", "win", "wins", "top", "excited", "happy", "best", "clean", "fresh")
BAD = ("bad", "slow", "awful", "hate", "washed", "terrible", "worse", "worst", "problem", "issue", "off pace", "struggle")
HEATED = ("cheat", "cheating", "fraud", "robbed", "stewards", "penalty", "ban", "illegal", "controversy", "scandal", "rigged")
#: Names by which titles call teams.
TEAMS = {"ferrari": "Ferrari", "scuderia": "Ferrari", "mclaren": "McLaren", "mercedes": "Mercedes", "red bull": "Red Bull", "aston martin": "Aston Martin", "williams": "Williams", "alpine": "Alpine", "haas": "Haas"}


def clean_summary(raw: Column, source: Column, most: int = 420) -> Column:
    """Scripts, styles and tags of feeds that have them gone, entities decoded, white space made one, a source's boilerplate cut off, at most so many characters."""
    s = F.coalesce(raw, F.lit(""))
    s = F.when(source.isin("official", "reddit"), F.regexp_replace(F.regexp_replace(s, UNREAD, " "), TAGS, " ")).otherwise(s)
    for entity, sign in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(sign))
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def without_tail(x: Column) -> Column:
        cut = F.least(*[F.nullif(F.locate(m, x), F.lit(0)) for m in FOOTERS])
        official = F.when(cut.isNotNull(), F.trim(F.left(x, cut - 1))).otherwise(x)
        reddit = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, SUBMITTED, ""), THREAD, " "), EMPTY, " ")
        return F.when(source == "official", official).when(source == "reddit", reddit).otherwise(x)

    return once(tidy(once(tidy(s), without_tail)), lambda x: F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most - 1))), F.lit("…"))).otherwise(x))


def ingested(rows: DataFrame) -> DataFrame:
    """Relevant articles as they are stored: clean summary, topic, priority and tier. Only official feeds are asked for relevance."""
    said = F.lower(F.concat_ws(" ", "title", "summary"))
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.col("source")), F.lit(58))
    score = clamp(score + sum(F.when(F.regexp_like(said, F.lit(p)), n).otherwise(0) for p, n in RAISES), 0, 100)
    tier = cascade([(F.col("rank_score") >= 85, "P0"), (F.col("rank_score") >= 70, "P1"), (F.col("rank_score") >= 50, "P2")], "P3")
    kept = rows.where((F.col("source") != "official") | F.regexp_like(F.lower(F.concat_ws(" ", "title", "summary", "url")), F.lit(RELEVANT)))
    out = kept.select("*", clean_summary(F.col("summary"), F.col("source")).alias("clean"), cascade([(F.regexp_like(said, F.lit(p)), n) for n, p in TOPICS], "GENERAL_F1").alias("topic"), score.cast("bigint").alias("rank_score"))
    return out.withColumn("tier", tier)


def stories(rows: DataFrame) -> DataFrame:
    """Stories by title: counts, sources and their breakdown, first and last sight, best priority, whether any is urgent."""
    by_source = rows.groupBy("title", "source").agg(
        F.count("*").alias("n"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.max("rank_score").alias("best"), F.bool_or(F.col("tier") == "P0").alias("urgent"),
    )
    breakdown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws("=", x["source"], x["n"].cast("string"))), ",")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return by_source.groupBy("title").agg(
        F.sum("n").alias("events"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("sources"), breakdown.alias("breakdown"),
        at(F.min("first")).alias("first_seen"), at(F.max("last")).alias("last_seen"), F.max("best").alias("best"), F.bool_or("urgent").alias("breaking"),
    )


def marked_up(rows: DataFrame) -> DataFrame:
    """Articles with markup, scripts and entities in every ninth summary."""
    return rows.withColumn("summary", F.concat("summary", F.when(F.col("guid") % 9 == 0, MARKUP).otherwise("")))


def regex_tags(rows: DataFrame, days: int = 30) -> DataFrame:
    """guid, tag, confidence of every rule that an article of the last days meets; the rules are literals, so no join is needed.

    A text is put together once, and only rules of which it has a piece are tried on it.
    """
    said = F.lower(F.concat_ws(" ", "title", "summary"))
    met = lambda t, p: reduce(or_, [F.contains("said", F.lit(x)) for x in PIECES[t]]) & F.regexp_like("said", F.lit(p))
    tried = rows.where(hours_ago().between(0, 24 * days - 1)).select("guid", said.alias("said")).select("guid", *[met(t, p).alias(t) for t, p, _ in RULES])
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(c).alias("confidence"), F.col(t).alias("hit")) for t, _, c in RULES]), lambda s: s["hit"])
    return tried.select("guid", F.explode(hits).alias("h")).select("guid", "h.tag", "h.confidence")


def team_sentiment(rows: DataFrame) -> DataFrame:
    """Tone of each team by day, met by any of its names in the title; mentions are distinct clusters."""
    low = F.lower("title")
    named = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.lit(t)) for a, t in TEAMS.items()])))
    met = rows.select("cluster", "label", "score", F.to_date("published_at").alias("day"), F.explode(named).alias("team"))
    per = met.groupBy("team", "day").agg(F.countDistinct("cluster").alias("mentions"), F.count("*").alias("articles"), F.round(F.avg("score"), 4).alias("tone"), *[F.count_if(F.col("label") == x).alias(x) for x in ("positive", "negative", "neutral")])
    change = F.round(F.col("tone") - F.lag("tone").over(W.partitionBy("team").orderBy("day")), 4)
    return per.select("team", F.date_format("day", "yyyy-MM-dd").alias("day"), "mentions", "articles", "tone", "positive", "negative", "neutral", tone_label(F.col("tone")).alias("label"), change.alias("change"))


def search(rows: DataFrame, source: str = "all", text: str | None = None, size: int = 50) -> DataFrame:
    """A page of articles: optional source, optional words in title, summary, source or url; urgent first, then by priority and time."""
    if source != "all":
        rows = rows.where(F.lower("source") == source.lower())
    if text:
        like = f"%{text.lower()}%"
        rows = rows.where(F.lower("title").like(like) | F.lower("summary").like(like) | F.lower("source").like(like) | F.lower("url").like(like))
    key = F.coalesce(F.nullif(F.col("cluster"), F.lit("view")), F.col("url"))
    return rows.orderBy((F.col("priority") >= 90).desc(), F.coalesce(F.col("priority"), F.lit(0.0)).desc(), F.col("published_at").desc_nulls_last(), "guid").limit(min(max(size, 1), 500)).select("guid", "title", "source", key.alias("event_key"))


def candidates(rows: DataFrame, stored: DataFrame, days: int = 180, batch: int = 500) -> DataFrame:
    """The newest articles that have no stored vector, or one of another content: what an incremental run takes on."""
    fresh = rows.where(hours_ago().between(0, 24 * days - 1)).join(stored, "guid", "left").where("not embedded <=> true or not hash <=> stored_hash")
    return fresh.orderBy(F.col("published_at").desc_nulls_last(), "guid").limit(batch).select("guid", "hash")


def tone_and_heat(rows: DataFrame) -> DataFrame:
    """Client scores of a title: +1 and -1 per word contained, and 2 per heated word with up to five exclamation marks."""
    low = F.lower("title")
    hits = lambda names: sum(F.contains(low, F.lit(w)).cast("bigint") for w in names)
    return rows.select("guid", (hits(GOOD) - hits(BAD)).alias("tone"), (2 * hits(HEATED) + F.least(F.regexp_count("title", F.lit("!")), F.lit(5))).cast("bigint").alias("heat"))


def retention(rows: DataFrame, keep_days: int = 25, vector_days: int = 10) -> DataFrame:
    """What stays after retention: rows of the last days, their vectors only while they are younger still."""
    kept = rows.where(hours_ago() < 24 * keep_days)
    return kept.select("guid", F.when(hours_ago() < 24 * vector_days, F.md5(F.col("title").cast("binary"))).alias("vector"))


def spike_flags(rows: DataFrame, least: float = 60.0) -> DataFrame:
    """Every story with its spike flag and count raised from the day's aggregate, where there is one: an update from an aggregate."""
    per = rows.groupBy("title").agg(F.count("*").alias("count"))
    hot = rows.where((F.col("priority") >= least) & (hours_ago() < 72)).groupBy("title").agg(F.count("*").alias("hot"))
    return per.join(hot, "title", "left").select("title", F.greatest("count", F.coalesce(2 * F.col("hot"), F.lit(0))).alias("count"), F.col("hot").isNotNull().alias("is_spike"))


def named_sources(rows: DataFrame) -> DataFrame:
    """Each cluster's sources, of its urgent and of its negative articles together, beside the type that their names suggest."""
    urgent, bad = rows.where("priority >= 80").select("cluster", "source"), rows.where("label = 'negative'").select("cluster", "source")
    kind = cascade([(F.lower("source").like("%reddit%"), "community"), (F.lower("source").rlike("official|fia"), "official")], "media")
    both = urgent.union(bad).distinct()
    names = both.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("all_sources"))  # a list is made once a cluster
    return both.join(names, "cluster").select("cluster", "source", kind.alias("kind"), "all_sources")


def _news(f):
    return lambda s, d: f(articles(s, d))


def _candidates(s, d):
    rows = articles(s, d).withColumn("hash", F.md5(F.concat("title", "summary").cast("binary")))
    stored = rows.where("guid % 3 <> 0").select("guid", F.when(F.col("guid") % 7 == 0, "old").otherwise(F.col("hash")).alias("stored_hash"), (F.col("guid") % 5 != 0).alias("embedded"))
    return candidates(rows, stored)


QUERIES = {
    "ingest_articles": _news(lambda a: ingested(marked_up(a)).select("guid", F.col("clean").alias("summary"), "topic", "rank_score", "tier")),
    "ingest_stories": _news(lambda a: stories(ingested(marked_up(a)))),
    "regulatory_tags_regex": _news(regex_tags),
    "team_sentiment_daily": _news(team_sentiment),
    "feed_search": _news(lambda a: search(a, "News", "fia")),
    "feed_search_all": _news(search),
    "embedding_candidates": _candidates,
    "client_tone_heat": _news(tone_and_heat),
    "retention_prune": _news(retention),
    "spike_flag_update": _news(spike_flags),
    "named_sources": _news(named_sources),
}

_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_DECODED = "case when source in ('official', 'reddit') then regexp_replace(regexp_replace(regexp_replace(coalesce(summary, ''), '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g') else coalesce(summary, '') end"
for _entity, _sign in ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_INGESTED = f"""f as (select * replace (summary || case when guid % 9 = 0 then '{MARKUP.replace(chr(39), chr(39) * 2)}' else '' end as summary) from articles),
d as (select *, {_CLEAN.format(_DECODED)} as s, lower(title || ' ' || summary) as said from f
 where source <> 'official' or regexp_matches(lower(title || ' ' || summary || ' ' || url), '{RELEVANT}')),
k as (select *, least({", ".join(f"nullif(instr(s, '{m}'), 0)" for m in FOOTERS)}) as cut from d),
c as (select *, {_CLEAN.format(r"case source when 'official' then case when cut is not null then trim(left(s, cut - 1)) else s end when 'reddit' then regexp_replace(regexp_replace(regexp_replace(s, '\s*submitted by\s*/u/[^\s]+\s*(?:\[[^\]]*\]\s*)*\s*$', '', 'i'), '\s*\[(?:link|comments?)\]\s*', ' ', 'gi'), '\s*\[\s*\]\s*', ' ', 'g') else s end")} as s2,
 greatest(0, least(100, case source when 'official' then 74 when 'reddit' then 42 else 58 end + {" + ".join(f"case when regexp_matches(said, '{p}') then {n} else 0 end" for p, n in RAISES)})) as rank_score from k),
ingested as (select *, case when length(s2) > 420 then rtrim(left(s2, 419)) || '…' else s2 end as clean, case {" ".join(f"when regexp_matches(said, '{p}') then '{n}'" for n, p in TOPICS)} else 'GENERAL_F1' end as topic,
 case when rank_score >= 85 then 'P0' when rank_score >= 70 then 'P1' when rank_score >= 50 then 'P2' else 'P3' end as tier from c)"""
_HITS = lambda names: "(" + " + ".join(f"cast(contains(lower(title), '{w}') as int)" for w in names) + ")"
_PAGE = "guid, title, source, coalesce(nullif(cluster, 'view'), url) as event_key from articles"
_ORDER = "order by priority >= 90 desc, coalesce(priority, 0) desc, published_at desc nulls last, guid limit 50"


def _sql(body: str) -> str:
    return sql(body, "feed", "articles")


ORACLE_SQL = {
    "ingest_articles": _sql(f", {_INGESTED} select guid, clean as summary, topic, cast(rank_score as bigint) as rank_score, tier from ingested"),
    "ingest_stories": _sql(f""", {_INGESTED}, p as (select title, source, count(*) as n from ingested group by 1, 2), b as (select title, string_agg(source, '|' order by source) as sources, string_agg(source || '=' || n, ',' order by source) as breakdown from p group by 1)
select title, count(*) as events, any_value(sources) as sources, any_value(breakdown) as breakdown, strftime(min(published_at), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') as last_seen, max(rank_score) as best, bool_or(tier = 'P0') as breaking
from ingested join b using (title) group by title"""),
    "regulatory_tags_regex": _sql("select guid, tag, confidence from articles join (values " + ", ".join(f"('{t}', '{p}', cast({c} as double))" for t, p, c in RULES) + ") v(tag, pattern, confidence) on regexp_matches(lower(title || ' ' || summary), pattern) where age between 0 and 719"),
    "team_sentiment_daily": _sql(", m as (select distinct guid, cluster, label, score, cast(published_at as date) as day, team from articles join (values " + ", ".join(f"('{a}', '{t}')" for a, t in TEAMS.items()) + """) v(alias, team) on contains(lower(title), alias)),
p as (select team, day, count(distinct cluster) as mentions, count(*) as articles, round(avg(cast(score as double)), 4) as tone, count(*) filter (where label = 'positive') as positive, count(*) filter (where label = 'negative') as negative, count(*) filter (where label = 'neutral') as neutral from m group by 1, 2)
select team, strftime(day, '%Y-%m-%d') as day, mentions, articles, tone, positive, negative, neutral, case when tone > 0.15 then 'positive' when tone < -0.15 then 'negative' else 'neutral' end as label, round(tone - lag(tone) over (partition by team order by p.day), 4) as change from p"""),
    "feed_search": _sql(f"select {_PAGE} where lower(source) = 'news' and (title ilike '%fia%' or summary ilike '%fia%' or source ilike '%fia%' or url ilike '%fia%') {_ORDER}"),
    "feed_search_all": _sql(f"select {_PAGE} {_ORDER}"),
    "embedding_candidates": _sql(""", h as (select guid, published_at, age, md5(title || summary) as hash from articles), s as (select guid, case when guid % 7 = 0 then 'old' else hash end as stored_hash, guid % 5 <> 0 as embedded from h where guid % 3 <> 0)
select guid, hash from h left join s using (guid) where age between 0 and 4319 and (embedded is distinct from true or hash is distinct from stored_hash) order by published_at desc nulls last, guid limit 500"""),
    "client_tone_heat": _sql(f"select guid, {_HITS(GOOD)} - {_HITS(BAD)} as tone, 2 * {_HITS(HEATED)} + least(len(regexp_extract_all(title, '!')), 5) as heat from articles"),
    "retention_prune": _sql("select guid, case when age < 240 then md5(title) end as vector from articles where age < 600"),
    "spike_flag_update": _sql(""", h as (select title, count(*) as hot from articles where priority >= 60 and age < 72 group by 1)
select title, greatest(count(*), coalesce(2 * any_value(hot), 0)) as count, any_value(hot) is not null as is_spike from articles left join h using (title) group by title"""),
    "named_sources": _sql(""", b as (select cluster, source from articles where priority >= 80 union select cluster, source from articles where label = 'negative')
select cluster, source, case when lower(source) like '%reddit%' then 'community' when regexp_matches(lower(source), 'official|fia') then 'official' else 'media' end as kind, string_agg(source, ', ' order by source) over (partition by cluster) as all_sources from b"""),
}
