"""What headlines are about: teams and people by alias, incidents that stories under different titles share, awards, narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, tone_label
from gridstone.operators.aliases import alias_spans, dictionary, plain_words
from gridstone.operators.relational import stored
from gridstone.plans.bulletin import _topic
from gridstone.plans.ingest import TOPICS
from gridstone.sources.tables import articles, hours_ago, sql

# Names by which titles call teams.
TEAM_ALIASES = {
    "Aston Martin": ("aston martin", "alonso", "stroll"),
    "Alpine": ("alpine", "gasly", "colapinto", "doohan"),
    "Audi": ("audi", "sauber", "kick sauber", "hulkenberg", "bortoleto"),
    "Cadillac": ("cadillac", "perez", "bottas"),
    "Ferrari": ("ferrari", "leclerc", "hamilton"),
    "Haas F1 Team": ("haas", "bearman", "ocon"),
    "McLaren": ("mclaren", "norris", "piastri"),
    "Mercedes": ("mercedes", "antonelli", "russell", "wolff"),
    "Racing Bulls": ("racing bulls", "lawson", "lindblad"),
    "Red Bull Racing": ("red bull", "verstappen", "hadjar"),
    "Williams": ("williams", "albon", "sainz"),
}
# Words of other sports, whose texts are about no team.
OTHER_SPORTS = r"\b(golf|pga|scheffler|young stretches|harry williams)\b"
# Names by which incidents call people.
ENTITY_ALIASES = {"antonelli": ("antonelli", "kimi"), "bortoleto": ("bortoleto", "gabriel"), "hadjar": ("hadjar", "isack", "#06", "car 06"), "russell": ("russell", "george"), "mercedes": ("mercedes", "wolff")}
# Incidents in order, the place that a title must name (none: any) and the words.
INCIDENTS = (
    ("miami-weather-start-time", "miami", r"\b(start time|moved earlier|forward|changed|combat|risk|threat)\b"),
    ("regulatory-technical", None, r"\b(disqualified|disqualification|excluded|exclusion|failed technical inspection|technical inspection|technical breach|floorboard|floorboards|referred to stewards|stewards)\b"),
    ("miami-qualifying-results", "miami", r"\b(post qualifying|qualifying results|qualifying discussion|qualifying result)\b"),
    ("miami-starting-grid", "miami", r"\b(starting grid|grid for the main race|race grid)\b"),
)
WEATHER = r"\b(storm|thunderstorm|weather|lightning|rain)\b"
# Words that make a story one of drivers.
DRIVER_WORDS = r"\b(driver|contract|seat|teammate|rookie|verstappen|norris|piastri|leclerc|hamilton|russell|alonso|sainz|antonelli|tsunoda|lawson|gasly|ocon|albon|bearman|hulkenberg|bortoleto|hadjar|stroll)\b"
#: Names that hold a team's name without meaning it.
SHUT_OUT = ("mercedes benz stadium", "williams college", "george street")
#: What the wire adds to headlines in turn.
TAILS = ("", ", says Harry Williams", " at Mercedes-Benz Stadium", ": the Alpines wait", " for Kimi's Mercedes", " after Miami storm threat", " - Russell referred to stewards", " #06", " as Red Bull and Racing Bulls split")
ROLL_UP, GAP_HOURS = 18, 2
HOUR_S = 3600


def wire(rows: DataFrame) -> DataFrame:
    """Articles with a tail on their title, invented from each row's id."""
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("guid") % len(TAILS) + 1).cast("int"))
    return rows.withColumn("title", F.concat("title", tail))


def _titles(rows: DataFrame) -> DataFrame:
    """Each distinct title once, stored: the work on titles does not grow with their articles, as no test on a title is pushed down to them."""
    return stored(rows.where("title is not null").select("title").distinct())


def teams_named(rows: DataFrame) -> DataFrame:
    """guid, team, alias, times: every team named in an article's title, by which name and how often; titles of other sports name none."""
    names = {a: team for team, known in TEAM_ALIASES.items() for a in known} | dict.fromkeys(SHUT_OUT)
    titles = _titles(rows)
    spans = alias_spans(titles.where(~F.regexp_like(F.lower("title"), F.lit(OTHER_SPORTS))), "title", "title", dictionary(rows.sparkSession, names))
    per = spans.groupBy("title", F.col("entity").alias("team"), "alias").agg(F.count("*").alias("times"))
    named = stored(titles.join(per, "title", "left")).where("team is not null")  # a left join forgets the tests on titles, which the next join would repeat on all articles
    return rows.select("guid", "title").join(named, "title").select("guid", "team", "alias", "times")


def incident_of(title: Column) -> Column:
    """The first incident whose words a title has, null if there is none."""
    text = F.array_join(plain_words(title), " ")
    tests = []
    for name, place, words in INCIDENTS:
        test = F.regexp_like(text, F.lit(words))
        if place:
            test &= F.contains(text, F.lit(place))
        if name == "miami-weather-start-time":
            test &= F.regexp_like(text, F.lit(WEATHER))
        tests.append((test, name))
    return cascade(tests, None)


def story_keys(rows: DataFrame) -> DataFrame:
    """title, incident, people (joined names, else general), driver (whether it is a drivers' story) of each distinct title; stored, so that no join infers a test on its articles' titles from them."""
    titles = _titles(rows)
    names = {a: who for who, known in ENTITY_ALIASES.items() for a in known} | dict.fromkeys(SHUT_OUT)
    spans = alias_spans(titles, "title", "title", dictionary(rows.sparkSession, names))
    people = spans.groupBy("title").agg(F.array_join(F.sort_array(F.collect_set("entity")), "+").alias("people"))
    met = titles.join(people, "title", "left")
    return stored(met.select("title", incident_of(F.col("title")).alias("incident"), F.coalesce("people", F.lit("general")).alias("people"), F.regexp_like(F.lower("title"), F.lit(DRIVER_WORDS)).alias("driver")))


def incidents(rows: DataFrame, gap_hours: int = GAP_HOURS) -> DataFrame:
    """Incidents: articles that share incident and people, whatever their titles, as long as no pause is longer than a gap.

    incident, people, number (from 1 along the time), begins, ends, articles, titles, lead: the title with the greatest
    priority (ties: the later, then the first by name). Articles of a stretch as long as a gap are never parted, so they are
    totalled by title and stretch before anything else, and only a row a stretch passes through a window over
    its incident: one with a third of all articles is no task's own.
    """
    by, gap = ["incident", "people"], gap_hours * HOUR_S
    at = F.timestamp_diff("SECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("published_at"))
    timed = rows.select("title", "published_at", "priority", at.alias("at")).where("title is not null and at is not null")
    foremost = F.min(F.struct((-F.coalesce("priority", F.lit(-1.0))).alias("a"), (-F.col("at")).alias("b")))
    totals = timed.groupBy(F.floor(F.col("at") / max(gap, 1)).alias("stretch"), "title").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("published_at").alias("begins"), F.max("published_at").alias("ends"), foremost.alias("foremost"))
    keyed = stored(totals.join(story_keys(rows).where("incident is not null").drop("driver"), "title"))
    along = W.partitionBy(*by).orderBy("stretch")  # a row a stretch
    stretches = keyed.groupBy(*by, "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("before", F.lag("last").over(along))
    new = (F.col("before").isNull() | (F.col("first") - F.col("before") > gap)).cast("long")
    numbered = stretches.select(*by, "stretch", F.sum(new).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("number"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    lead = F.min_by("title", F.struct("foremost.a", "foremost.b", "title"))
    out = keyed.join(numbered, [*by, "stretch"]).groupBy(*by, "number").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.sum("n").alias("articles"), F.countDistinct("title").alias("titles"), lead.alias("lead"))
    return out.select(*by, "number", stamp("begins").alias("begins"), stamp("ends").alias("ends"), "articles", "titles", "lead")


def stories(rows: DataFrame) -> DataFrame:
    """Stories of the newsletter: articles of an incident are one, others one by their words; title (the foremost), driver, articles, sources, score, momentum, breaking."""
    keys = story_keys(rows)
    words = F.array_join(F.array_sort(F.array_distinct(plain_words(F.col("title")))), " ")
    story = F.when(F.col("incident").isNotNull(), F.concat_ws(":", F.lit("incident"), "incident", "people")).otherwise(F.concat_ws(":", F.lit("title"), words))
    lowest = F.min(-F.coalesce("priority", F.lit(-1.0))).alias("a")
    totals = rows.where("title is not null").groupBy("title", "source").agg(F.count("*").alias("n"), lowest, F.max("priority").alias("priority"), F.count_if(hours_ago().between(0, 71)).alias("momentum"))
    met = totals.join(keys, "title").withColumn("story", story)
    first = F.min_by("title", F.struct("a", "title"))
    per = met.groupBy("story").agg(first.alias("title"), F.bool_or("driver").alias("driver"), F.sum("n").alias("articles"), F.countDistinct("source").alias("sources"), F.floor(F.max("priority")).cast("long").alias("best"), F.sum("momentum").alias("momentum"))
    return per.select("story", "title", "driver", "articles", "sources", (F.col("best") + F.least(F.col("articles"), F.lit(18)) + 3 * F.col("sources")).alias("score"), "momentum", (F.col("best") >= 95).alias("breaking"))


#: Awards in order: label, which stories may have it, and by what figure (then the score, then the story's key).
AWARDS = (("Main character energy", "driver", "score"), ("Biggest siren", "breaking", "score"), ("Receipts department", None, "sources"), ("Momentum merchant", None, "momentum"))


def awards(told: DataFrame, roll_up: int = ROLL_UP) -> DataFrame:
    """label, place, story, title, figure: each award to the foremost story that none before took, then the roll-up of what is left.

    An award whose kind of story does not occur is open to all. Each is a top-k of the stored stories; the driver holds the four that have won.
    """
    told, taken, out = stored(told), [], None
    for label, kind, figure in (*AWARDS, ("Roll-up", None, "score")):
        order = [F.desc(figure), F.desc("score"), F.col("story")]
        left = told.where(~F.col("story").isin(taken)) if taken else told
        if kind and not told.where(kind).isEmpty():
            left = left.where(kind)
        top = left.orderBy(*order).limit(roll_up if label == "Roll-up" else 1)
        won = top.select(F.lit(label).alias("label"), F.row_number().over(W.orderBy(*order)).cast("long").alias("place"), "story", "title", F.col(figure).alias("figure"))  # over a top-k
        out = won if out is None else out.unionByName(won)
        if label != "Roll-up":
            taken += [r["story"] for r in top.select("story").collect()]  # one row an award
    return out


# Narratives in order, with the words that a cluster's name or a title must contain.
CLUSTER_NARRATIVES = (("DRIVER", ("driver",)), ("TEAM", ("team",)), ("REGULATION", ("fia", "regulation")), ("TECH", ("technical", "engine")), ("PACE", ("race", "pace")))
TITLE_NARRATIVES = (
    ("Qualifying", ("pole", "qualifying")), ("Race Result", ("win", "victory", "podium")), ("Championship", ("championship", "title", "rival")),
    ("Technical", ("upgrade", "car", "engine", "technical")), ("Team News", ("contract", "team", "seat")),
)


def narrative(text: Column, kinds=CLUSTER_NARRATIVES, otherwise: str = "GENERAL") -> Column:
    """The first narrative of which a text contains a word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return cascade([(F.regexp_like(low, F.lit("|".join(words))), name) for name, words in kinds], otherwise)


def narratives(rows: DataFrame) -> DataFrame:
    """Articles and distinct titles by narrative of title and of topic, with the tone."""
    met = rows.select(narrative(F.col("title"), TITLE_NARRATIVES, "Coverage").alias("narrative"), narrative(_topic(F.col("title"))).alias("subject"), "title", "score")
    return met.groupBy("narrative", "subject").agg(F.count("*").alias("articles"), F.countDistinct("title").alias("titles"), tone_label(F.avg("score"), 0.05).alias("tone"))


def _w(f):
    return lambda s, d: f(wire(articles(s, d)))


QUERIES = {"teams_named": _w(teams_named), "newsletter_incidents": _w(incidents), "newsletter_stories": _w(stories), "newsletter_awards": _w(lambda rows: awards(stories(rows))), "narratives": _w(narratives)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _alternatives(known: dict) -> str:
    import re

    def plain(a: str) -> str:
        return re.sub("[^a-z0-9]+", " ", re.sub("#0?([0-9]+)", r"car \1", a.lower().replace("'", ""))).strip()

    names = {plain(a): who for who, group in known.items() for a in group} | {plain(a): None for a in SHUT_OUT}
    return "|".join(sorted(names, key=lambda a: (-len(a), a))), "map {" + ", ".join(f"'{a}': {_quoted(w) if w else 'null'}" for a, w in sorted(names.items())) + "}"


def _spans(known: dict, name: str, where: str = "") -> str:
    pattern, lookup = _alternatives(known)
    return f"{name} as (select title, {lookup}[alias] as entity, alias from (select title, unnest(regexp_extract_all(text, '\\b(?:{pattern})\\b')) as alias from titles{where}) where {lookup}[alias] is not null)"


_WIRE = f"wire as (select * replace (title || [{', '.join(_quoted(t) for t in TAILS)}][cast(guid % {len(TAILS)} + 1 as int)] as title) from articles)"
_TITLES = """titles as (select title, trim(regexp_replace(regexp_replace(replace(replace(lower(title), '''', ''), '’', ''), '#0?([0-9]+)', 'car \\1', 'g'), '[^a-z0-9]+', ' ', 'g')) as text from (select distinct title from wire where title is not null))"""
_KEYS = (
    _spans(ENTITY_ALIASES, "spans")
    + ", keys as (select title, text, case "
    + " ".join("when " + " and ".join([f"regexp_matches(text, '{words}')", *([f"contains(text, '{place}')"] if place else []), *([f"regexp_matches(text, '{WEATHER}')"] if name == "miami-weather-start-time" else [])]) + f" then '{name}'" for name, place, words in INCIDENTS)
    + f" end as incident, coalesce((select string_agg(distinct entity, '+' order by entity) from spans s where s.title = t.title), 'general') as people, regexp_matches(lower(title), '{DRIVER_WORDS}') as driver from titles t)"
)
_STORIES = """met as (select w.*, driver, case when incident is not null then 'incident:' || incident || ':' || people else 'title:' || array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') end as story from wire w join keys using (title)),
per as (select story, arg_min(title, {'a': -priority, 't': title}) as title, bool_or(driver) as driver, count(*) as articles, count(distinct source) as sources, cast(floor(max(priority)) as bigint) as best, count(*) filter (where age between 0 and 71) as momentum from met group by 1),
stories as (select story, title, driver, articles, sources, best + least(articles, 18) + 3 * sources as score, momentum, best >= 95 as breaking from per)"""


def _award_steps() -> str:
    steps, taken = [], []
    for k, (label, kind, figure) in enumerate((*AWARDS, ("Roll-up", None, "score"))):
        fits = f"({kind} or not (select bool_or({kind}) from stories))" if kind else "true"
        out = "".join(f" and story not in (select story from {t})" for t in taken)
        most = ROLL_UP if label == "Roll-up" else 1
        steps.append(f"w{k} as (select '{label}' as label, row_number() over (order by {figure} desc, score desc, story) as place, story, title, {figure} as figure from stories where {fits}{out} order by 2 limit {most})")
        taken.append(f"w{k}")
    return ", ".join(steps) + " " + " union all ".join(f"select * from {t}" for t in taken)


def _case(kinds, text: str, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{'|'.join(words) if not isinstance(words, str) else words}') then '{name}'" for name, words in kinds) + f" else '{otherwise}' end"


ORACLE_SQL = {
    "narratives": sql(f""", {_WIRE}, t as (select *, {_case(TOPICS, 'lower(title)', 'GENERAL_F1')} as topic from wire),
n as (select *, {_case(TITLE_NARRATIVES, 'lower(title)', 'Coverage')} as narrative, {_case(CLUSTER_NARRATIVES, 'lower(topic)', 'GENERAL')} as subject from t)
select narrative, subject, count(*) as articles, count(distinct title) as titles, case when avg(score) > 0.05 then 'positive' when avg(score) < -0.05 then 'negative' else 'neutral' end as tone from n group by 1, 2""", "feed", "articles"),
    "teams_named": sql(f""", {_WIRE}, {_TITLES}, {_spans(TEAM_ALIASES, 'spans', f" where not regexp_matches(lower(title), '{OTHER_SPORTS}')")},
x as (select title, entity, alias, count(*) as times from spans group by all)
select guid, x.entity as team, alias, times from wire join x using (title)""", "feed", "articles"),
    "newsletter_incidents": sql(f""", {_WIRE}, {_TITLES}, {_KEYS},
k as (select w.*, incident, people, date_diff('second', timestamp '2000-01-01 00:00:00', published_at) as moment from wire w join keys using (title) where incident is not null),
g as (select *, case when moment - lag(moment) over (partition by incident, people order by moment) <= {GAP_HOURS * HOUR_S} then 0 else 1 end as new from k),
n as (select *, sum(new) over (partition by incident, people order by moment range unbounded preceding) as number from g)
select incident, people, cast(number as bigint) as number, strftime(min(published_at), '%Y-%m-%d %H:%M:%S') as begins, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') as ends, count(*) as articles, count(distinct title) as titles,
 arg_min(title, {{'a': -priority, 'b': -moment, 't': title}}) as lead from n group by incident, people, number""", "feed", "articles"),
    "newsletter_stories": sql(f""", {_WIRE}, {_TITLES}, {_KEYS}, {_STORIES} select * from stories""", "feed", "articles"),
    "newsletter_awards": sql(f""", {_WIRE}, {_TITLES}, {_KEYS}, {_STORIES}, {_award_steps()}""", "feed", "articles"),
}
