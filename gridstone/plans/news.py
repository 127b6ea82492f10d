"""News intelligence: cluster figures, spikes, sentiment, controversy, momentum, regulatory risk, clustering and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, clamp, cosine, jaccard, ratio, rounded, tone_label, words
from gridstone.operators.relational import insert_new, keyset_page, upsert
from gridstone.sources.tables import AS_OF, articles, as_of, feed, hours_ago, sql, table

LONG = "bigint"

# Weights of words for the lexical sentiment.
POSITIVE_WEIGHTS = {
    "win": 1.5, "wins": 1.5, "won": 1.5, "victory": 1.5, "podium": 1.2, "pole": 1.0, "fastest": 0.8, "upgrade": 0.5, "improved": 0.8,
    "confident": 0.7, "breakthrough": 1.2, "dominant": 1.1, "praised": 0.6,
}
NEGATIVE_WEIGHTS = {
    "penalty": 1.3, "crash": 1.4, "investigation": 1.2, "failure": 1.2, "retired": 1.0, "disqualified": 1.5, "damage": 0.9, "concern": 0.6,
    "struggled": 0.8, "controversy": 0.9, "appeal": 0.7, "issue": 0.5,
}
NEGATIONS = ("not", "no", "never")
# Tag, confidence and upper-case fragment.
TAG_PATTERNS = (
    ("TECHNICAL_DIRECTIVE", 0.95, "TECHNICAL DIRECTIVE"), ("PENALTY", 0.90, "PENALTY"), ("PENALTY", 0.90, "GRID PEN"), ("INVESTIGATION", 0.92, "INVESTIGATION"),
    ("INVESTIGATION", 0.88, "SUMMONED"), ("INVESTIGATION", 0.85, "STEWARDS"), ("COST_CAP", 0.93, "COST CAP"), ("COST_CAP", 0.88, "FINANCIAL REGULATION"),
    ("PROTEST", 0.91, "PROTEST"), ("CLARIFICATION", 0.87, "CLARIFICATION"), ("CLARIFICATION", 0.85, "TECHNICAL NOTE"), ("DQ", 0.95, "DISQUALIF"),
    ("DQ", 0.92, "EXCLUDED"), ("WARNING", 0.88, "OFFICIAL WARNING"), ("WARNING", 0.85, "BLACK AND WHITE"),
)


def _within(low: int, high: int) -> Column:
    return hours_ago().between(low, high - 1)


def cluster_figures(articles: DataFrame, hours: int = 72, headlines: int = 5) -> DataFrame:
    """Per cluster of the last hours: counts, mean score, sources, top priority and the ids of the top headlines.

    Headlines are cut to a few per cluster before they are gathered, so no group is unbounded.
    """
    recent = articles.where(_within(0, hours))
    figures = recent.groupBy("cluster").agg(
        F.count("*").alias("articles"), F.count_if(hours_ago() < 60).alias("recent"), F.round(F.avg("score"), 4).alias("score"),
        F.count_if(F.col("source") == "official").alias("official"), F.count_if(F.col("source") == "reddit").alias("reddit"), F.round(F.max("priority"), 4).alias("top_priority"),
    ).where("articles >= 2")
    ranked = recent.withColumn("n", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("priority"), "guid"))).where(F.col("n") <= headlines)
    lines = ranked.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "guid"))), lambda s: s["guid"].cast("string")), " | ").alias("headlines"))
    return figures.join(lines, "cluster")


def momentum_v1(articles: DataFrame, hours: int = 72) -> DataFrame:
    """Score min(100, 10 n + 20 recent + priority / 2) and its tier."""
    f = cluster_figures(articles, hours)
    score = F.least(F.lit(100.0), F.round(10 * F.col("articles") + 20 * F.col("recent") + 0.5 * F.col("top_priority")))
    tier = cascade([(F.col("momentum") >= 90, "BREAKING"), (F.col("momentum") >= 70, "HIGH"), (F.col("momentum") >= 40, "NORMAL")], "LOW")
    return f.select("cluster", score.alias("momentum")).withColumn("tier", tier)


def _horizons(articles: DataFrame, key: str, *hours: int) -> DataFrame:
    return articles.where(_within(0, max(hours))).groupBy(key).agg(*[F.count_if(hours_ago() < h).alias(f"a{h}") for h in hours], F.max("priority").alias("top_priority"))


def momentum_v2(articles: DataFrame) -> DataFrame:
    """Weighted counts of several horizons per entity, with velocity, direction and tier."""
    a1, a6, a24, a72 = (F.col(f"a{h}") for h in (1, 6, 24, 72))
    velocity = rounded(a6 / F.greatest(a72 / 12, F.lit(1.0)), 3)
    momentum = rounded(F.least(F.lit(100.0), 12 * a1 + 5 * a6 + 1.5 * a24 + 0.25 * a72), 2)
    rows = _horizons(articles, "entity", 1, 6, 24, 72).select("entity", velocity.alias("velocity"), momentum.alias("momentum"))
    m, v = F.col("momentum"), F.col("velocity")
    return rows.select("*", cascade([(v >= 2, "surging"), (v >= 1.2, "rising"), (v < 0.5, "cooling")], "steady").alias("direction"), cascade([(m >= 85, "P0"), (m >= 70, "P1"), (m >= 45, "P2")], "P3").alias("tier"), (m >= 70).alias("spike"))


def momentum_heuristic(articles: DataFrame) -> DataFrame:
    a24, top = F.col("a24"), F.coalesce(F.col("top_priority"), F.lit(0.0))
    rows = _horizons(articles, "entity", 24, 72)
    return rows.select("entity", rounded(F.least(F.lit(100.0), 14 * a24 + 0.45 * top), 2).alias("momentum"), ((a24 >= 5) | (top >= 85)).alias("spike"))


def momentum_72h(articles: DataFrame) -> DataFrame:
    """Label per entity from 1 to 72 hours; the order of the branches matters."""
    a1, a24, a48 = F.col("a1"), F.col("a24"), F.col("a48")
    velocity = a24 - (a48 - a24)
    score = F.least(F.lit(100), 5 * a1 + 3 * F.col("a6") + 2 * a24 + F.col("a72"))
    label = cascade([(a1 >= 5, "SURGING"), (velocity > 3, "BUILDING"), (F.abs(velocity) < 3, "STABLE"), (velocity < -3, "FADING"), (a24 == 0, "DEAD")], "STABLE")
    return _horizons(articles, "entity", 1, 6, 24, 48, 72).select("entity", "a1", "a6", "a24", "a48", "a72", velocity.cast(LONG).alias("velocity"), score.cast(LONG).alias("momentum"), label.alias("label"))


def _severity(z: Column) -> Column:
    return cascade([(z >= 4, "CRITICAL"), (z >= 3, "HIGH")], "MEDIUM")


#: Reference time of the registered spike query: in the feed's midst, so that the newest hour has neighbours on all sizes of the tables.
SPIKE_TIME = "2024-01-12 17:00:00"


def spikes(articles: DataFrame, bucket: str = "hour", least: float = 2.5, days: int = 7, as_of: str = AS_OF) -> DataFrame:
    """Clusters whose newest bucket before the reference time stands out from the closed, non-empty buckets of the days before."""
    counts = articles.where(F.col("published_at") < F.lit(as_of).cast("timestamp_ntz")).groupBy("cluster", F.date_trunc(bucket, "published_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    newest = counts.agg(F.max("bucket").alias("newest"))  # one row
    placed = counts.crossJoin(F.broadcast(newest)).where(F.col("bucket") >= F.expr(f"newest - interval {days} days"))
    base = placed.where("bucket < newest").groupBy("cluster").agg(F.avg("n").alias("mean"), F.stddev("n").alias("spread"))
    z = ratio(F.col("n") - F.col("mean"), F.col("spread"))
    rows = placed.where("bucket = newest").join(base, "cluster").withColumn("z", z).where(F.col("z") > least)
    return rows.select("cluster", F.col("n").alias("current"), F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"), F.round("z", 4).alias("z"), _severity(F.col("z")).alias("severity"))


def spike_alerts(articles: DataFrame, least: float = 2.0, idle_hours: int = 3) -> DataFrame:
    """Every hourly spike of the feed's history against its trailing week, raised once per quiet spell and resolved if idle at the end."""
    hour = F.date_trunc("hour", "published_at").cast("timestamp_ntz")
    counts = articles.groupBy("cluster", hour.alias("bucket")).agg(F.count("*").alias("n")).withColumn("h", F.timestamp_diff("HOUR", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("bucket")))
    past = W.partitionBy("cluster").orderBy("h").rangeBetween(-168, -1)
    scored = counts.withColumn("z", ratio(F.col("n") - F.avg("n").over(past), F.stddev("n").over(past))).where(F.col("z") > least)
    gap = F.col("h") - F.lag("h").over(W.partitionBy("cluster").orderBy("h"))
    raised = scored.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > 1))
    idle = F.timestamp_diff("HOUR", F.col("bucket"), as_of()) > idle_hours
    return raised.select("cluster", F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "n", F.round("z", 4).alias("z"), _severity(F.col("z")).alias("severity"), idle.alias("resolved"))


def entity_sentiment(articles: DataFrame) -> DataFrame:
    """Per entity and day: counts, mean score, its change on the day before, its label and the most frequent cluster (ties: the first by name)."""
    day = F.to_date("published_at").alias("day")
    per = articles.groupBy("entity", day, "cluster").agg(F.count("*").alias("n"), F.sum("score").alias("s"), *[F.count_if(F.col("label") == x).alias(x) for x in ("positive", "negative", "neutral")])
    top = F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster")))
    rows = per.groupBy("entity", "day").agg(F.sum("n").alias("mentions"), F.round(F.sum("s") / F.sum("n"), 4).alias("score"), *[F.sum(x).alias(x) for x in ("positive", "negative", "neutral")], top.alias("top_cluster"))
    change = F.round(F.col("score") - F.lag("score").over(W.partitionBy("entity").orderBy("day")), 4)
    return rows.select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"), "mentions", "score", "positive", "negative", "neutral", "top_cluster", change.alias("change"), tone_label(F.col("score")).alias("tone"))


def controversy(articles: DataFrame) -> DataFrame:
    """Daily controversy of every entity from its negative, official, heavy and media shares, with its change on the day before."""
    day = F.to_date("published_at").alias("day")
    per = articles.groupBy("entity", day).agg(F.count("*").alias("mentions"), F.count_if(F.col("label") == "negative").alias("negative"), F.count_if(F.col("source") == "official").alias("official"), F.count_if(F.col("priority") >= 85).alias("heavy"))
    base = W.partitionBy("entity")
    spread = F.stddev("mentions").over(base)
    media = F.when(F.coalesce(spread, F.lit(0.0)) == 0, 50.0).otherwise(clamp(50 + 15 * ratio(F.col("mentions") - F.avg("mentions").over(base), spread), 0.0, 100.0))
    score = rounded(0.35 * (100 * F.col("negative") / F.col("mentions")) + 0.30 * F.least(F.lit(100), 28 * F.col("official")) + 0.20 * F.least(F.lit(100), 35 * F.col("heavy")) + 0.15 * media, 3)
    rows = per.withColumn("controversy", score)
    c = F.col("controversy")
    rows = rows.withColumn("change", F.round(c - F.lag(c).over(W.partitionBy("entity").orderBy("day")), 3))
    trend = cascade([(F.col("change") > 3, "rising"), (F.col("change") < -3, "falling")], "stable")
    return rows.select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"), "mentions", "controversy", cascade([(c >= 65, "HIGH"), (c >= 35, "MEDIUM"), (c >= 10, "LOW")], "MINIMAL").alias("label"), "change", trend.alias("trend"))


def regulatory_tags(documents: DataFrame, patterns=TAG_PATTERNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, tag, confidence: each tag of a text once, with its greatest confidence. The patterns are literals, so no join is needed."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(c).alias("confidence"), F.contains(upper, F.lit(p)).alias("hit")) for t, c, p in patterns]), lambda s: s["hit"])
    return documents.select(key, F.explode(hits).alias("h")).groupBy(key, F.col("h.tag").alias("tag")).agg(F.max("h.confidence").alias("confidence"))


def regulatory_risk(articles: DataFrame) -> DataFrame:
    """Risk per entity of four partial counts, combined by chained full outer joins on the entity."""
    recent = articles.where(_within(0, 720))

    def part(name: str, test: Column) -> DataFrame:
        return recent.where(test).groupBy("entity").agg(F.count("*").alias(name))

    parts = [part("inv", F.col("label") == "negative"), part("pen", (F.col("label") == "negative") & (F.col("priority") >= 60)), part("fia", F.col("source") == "official"), part("con", F.col("priority") >= 80)]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(p, "entity", "full_outer")
    n = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("inv", "pen", "fia", "con")}
    risk = rounded(0.40 * F.least(F.lit(100), 40 * n["inv"]) + 0.30 * F.least(F.lit(100), 25 * n["pen"]) + 0.20 * F.least(F.lit(100), 20 * n["fia"]) + 0.10 * F.least(F.lit(100), n["con"]), 3)
    r = F.col("risk")
    return joined.select("entity", risk.alias("risk")).withColumn("label", cascade([(r >= 75, "CRITICAL"), (r >= 50, "HIGH"), (r >= 25, "MEDIUM"), (r > 5, "LOW")], "CLEAR"))


def risk_v2(articles: DataFrame) -> DataFrame:
    """Fourteen-day risk; entities without any stay out."""
    neg, off, hot = F.count_if(F.col("label") == "negative"), F.count_if(F.col("source") == "official"), F.count_if(F.col("priority") >= 80)
    cap = lambda x: F.least(F.lit(100), x)
    rows = articles.where(_within(0, 336)).groupBy("entity").agg(rounded(0.35 * cap(18 * hot) + 0.35 * cap(20 * neg) + 0.15 * cap(5 * off) + 0.15 * cap(6 * neg + 5 * hot), 3).alias("risk")).where("risk > 0")
    r = F.col("risk")
    return rows.withColumn("label", cascade([(r >= 75, "critical"), (r >= 50, "high"), (r >= 25, "medium")], "low"))


def semantic_clusters(vectors: DataFrame, pool: int = 400, seed_at: float = 0.25, assign_at: float = 0.20) -> DataFrame:
    """Greedy seeds among the top `pool` by priority; a vector that a stronger one dominates joins its closest seed.

    The pool is a fixed top-k, so the pair step is bounded and its one side is broadcast.
    """
    top = vectors.select("vec_id", "embedding", ((F.col("vec_id") * 37) % 101).alias("priority")).orderBy(F.desc("priority"), "vec_id").limit(pool)
    top = top.withColumn("unit", F.transform("embedding", lambda x: x.cast("double"))).drop("embedding")
    other = F.broadcast(top.select(F.col("vec_id").alias("o_id"), F.col("priority").alias("o_priority"), F.col("unit").alias("o_unit")))
    strong = top.join(other, (F.col("o_priority") > F.col("priority")) & (cosine(F.col("unit"), F.col("o_unit")) >= seed_at), "left_semi").select("vec_id")
    seeds = top.join(F.broadcast(strong), "vec_id", "left_anti")
    rest = top.join(F.broadcast(strong), "vec_id")
    s = F.broadcast(seeds.select(F.col("vec_id").alias("seed_id"), F.col("unit").alias("s_unit")))
    near = rest.join(s, F.round(cosine(F.col("unit"), F.col("s_unit")), 9) >= assign_at).select("vec_id", "seed_id", F.round(cosine(F.col("unit"), F.col("s_unit")), 9).alias("likeness"))
    best = near.groupBy("vec_id").agg(F.min_by("seed_id", F.struct(-F.col("likeness"), F.col("seed_id"))).alias("seed_id"), F.round(F.max("likeness"), 5).alias("likeness"))
    return best.unionByName(seeds.select("vec_id", F.col("vec_id").alias("seed_id"), F.lit(1.0).alias("likeness")))


#: Labels that may have a prototype: they pass through one row.
MOST_TOPICS = 1000


def prototype_topics(vectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """Each vector's closest label prototype (mean vector), ties to the smaller label.

    Prototypes of at most MOST_TOPICS labels (more are an error) are one broadcast row; the closest is chosen within each vector's row, without a shuffle.
    """
    parts = labelled.where("label is not null").select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    prototypes = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("prototype"))
    if prototypes.limit(MOST_TOPICS + 1).count() > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} labels")
    whole = prototypes.agg(F.collect_list(F.struct("label", "prototype")).alias("all"))
    met = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(whole))
    best = F.array_max(F.transform("all", lambda p: F.struct(F.round(cosine(F.col("embedding"), p["prototype"]), 6).alias("l"), (-p["label"]).alias("n"))))
    return met.withColumn("s", best).where("s is not null").select("vec_id", (-F.col("s.n")).alias("topic"), F.round("s.l", 4).alias("likeness"))


def lexical_sentiment(text: Column) -> Column:
    """tanh(score / 3) of weighted words; a negation among the three words before turns a weight by -0.75."""
    weight = F.create_map(*[F.lit(x) for k, v in (POSITIVE_WEIGHTS | {k: -v for k, v in NEGATIVE_WEIGHTS.items()}).items() for x in (k, v)])

    def score(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), F.try_element_at(weight, x).alias("v"))), lambda s: s["v"].isNotNull())
        near = lambda i: F.arrays_overlap(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), F.array(*map(F.lit, NEGATIONS)))
        return F.aggregate(at, F.lit(0.0), lambda s, x: s + F.when((x["i"] > 0) & near(x["i"]), -0.75 * x["v"]).otherwise(x["v"]))

    return F.tanh(F.element_at(F.transform(F.array(words(text)), score), 1) / 3)


def term_sentiment(text: Column, positive=tuple(POSITIVE_WEIGHTS), negative=tuple(NEGATIVE_WEIGHTS)) -> Column:
    """(positive - negative) / max(3, both) of term counts."""

    def of(w: Column) -> Column:
        p = F.size(F.filter(w, lambda x: x.isin(*positive)))
        n = F.size(F.filter(w, lambda x: x.isin(*negative)))
        return (p - n) / F.greatest(F.lit(3), p + n)

    return F.element_at(F.transform(F.array(words(text)), of), 1)


def top_tokens(rows: DataFrame, k: int = 20, least: int = 4) -> DataFrame:
    """The k most frequent words of at least so many letters; ties by word."""
    return rows.select(F.explode(words(F.col("text"))).alias("token")).where(F.length("token") >= least).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def page_title(html: Column) -> Column:
    """The text of a page's title element, "" where there is none."""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def _title_sets(titles: DataFrame) -> DataFrame:
    """doc_id, tokens: the set of words of each title; titles without words are left out."""
    return titles.select("doc_id", F.array_sort(F.array_distinct(words(F.col("title")))).alias("tokens")).where(F.size("tokens") > 0)


def title_classes(titles: DataFrame) -> DataFrame:
    """doc_id, first_id: the smallest doc_id whose title has the same set of words; titles without words are left out."""
    rows = _title_sets(titles)
    first = rows.groupBy("tokens").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "tokens").select("doc_id", "first_id", "tokens")


#: Longs of a set's bit map: each word sets one of their bits.
MAPS = 4


def _maps(tokens: str) -> list[Column]:
    """The bit map of a set of words, m0, m1, ...: a bit that one set has and another lacks stands for a word that the other lacks."""
    bit = "shiftleft(1L, cast(pmod(shiftright(xxhash64(t), 8), 64) as int))"
    return [F.expr(f"aggregate({tokens}, 0L, (m, t) -> if(pmod(xxhash64(t), {MAPS}) = {k}, m | {bit}, m))").alias(f"m{k}") for k in range(MAPS)]


def _lacks(x: str, y: str) -> Column:
    """How many words of x at least are not in y, by their bit maps."""
    return F.expr(" + ".join(f"bit_count({x}m{k} & ~{y}m{k})" for k in range(MAPS)))


def _meeting(sets: DataFrame, least: float, contained: int, least_words: int) -> DataFrame:
    """a, b: pairs of sets that may be near, each once and among them all that are; see near_titles."""
    mapped = sets.select("id", F.size("tokens").alias("n"), "tokens", *_maps("tokens"))  # once a set, before its words are dealt
    spread = mapped.withColumn("token", F.explode("tokens")).drop("tokens")
    frequency = spread.groupBy("token").agg(F.count("*").alias("df"))
    ranked = spread.join(frequency, "token").withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("df", "token")))
    prefix = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    side = lambda rows, x: rows.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("n", "token", *[f"m{k}" for k in range(MAPS)])])
    shared = (F.col("atoken") == F.col("btoken")) & (F.col("a") != F.col("b")) & (F.col("an") <= F.col("bn"))
    most = F.least(F.col("an") - _lacks("a", "b"), F.col("bn") - _lacks("b", "a"))  # words that both may have
    alike = (F.col("an") >= F.lit(least) * F.col("bn") - 1e-9) & (most >= F.lit(least) * (F.col("an") + F.col("bn") - most) - 1e-6)
    overlap = side(prefix, "a").join(side(prefix.where(F.col("n") >= least_words), "b"), shared & alike)
    within = side(ranked.where((F.col("k") == 1) & (F.col("n") >= contained)), "a").join(side(spread, "b"), shared & (_lacks("a", "b") == 0))
    return overlap.select("a", "b").union(within.select("a", "b")).distinct()


def near_titles(titles: DataFrame, least: float = 0.58, contained: int = 4, least_words: int = 5) -> DataFrame:
    """low_id, high_id, likeness: near-duplicates among the first articles of title classes (membership: title_classes).

    Near are titles of which the smaller has `contained` words at least and lies in the larger,
    or the larger has `least_words` and their word overlap is `least`. Two exact arms find them.
    Overlap: at least ceil(least * n) of a title's n words are common then, so two such titles
    share one of their n - ceil(least * n) + 1 rarest words, and their sizes differ by that share at
    most. Containment: the rarest word of the smaller is in the larger. Pairs that meet in a word grow
    faster than the titles, so bit maps of both sets rule out the unlike ones inside the joins: what is
    shuffled after them is little more than the near pairs.
    """
    sets = _title_sets(titles).groupBy("tokens").agg(F.min("doc_id").alias("id"))
    met = _meeting(sets, least, contained, least_words)
    both = met.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    small, large = F.size("x"), F.size("y")
    like = jaccard(F.col("x"), F.col("y"))
    near = ((small >= contained) & (F.size(F.array_except("x", "y")) == 0)) | ((large >= least_words) & (like >= least))
    return both.where(near).select(F.least("a", "b").alias("low_id"), F.greatest("a", "b").alias("high_id"), F.round(like, 4).alias("likeness")).distinct()


def quotes(rows: DataFrame, key: str = "guid", text: str = "title") -> DataFrame:
    """Spans in double quotes of 20 to 240 characters per row, and whether somebody is named as saying them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"\\n]{20,240})"'), F.lit(1))
    said = F.regexp_like(F.coalesce(text, F.lit("")), F.lit('[A-Z][a-z]+ (said|says|told) "'))
    return rows.select(key, said.alias("attributed"), F.explode(found).alias("quote"))


def html_clean(pages: DataFrame) -> DataFrame:
    """Title and plain length of each page after scripts, styles and tags are gone and white space is one."""
    page = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<script.*?</script>|<style.*?</style>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", page_title(F.col("html")).alias("title"), F.length(F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))).cast(LONG).alias("plain_chars"))


def latest_by_source(pages: DataFrame) -> DataFrame:
    """The newest page of each host, and how many it has."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return pages.groupBy(host.alias("host")).agg(F.max("page_id").alias("page_id"), F.max_by("url", "page_id").alias("url"), F.count("*").alias("pages"))


def timeline(articles: DataFrame) -> DataFrame:
    day, hour = F.date_format("published_at", "yyyy-MM-dd"), F.hour("published_at").cast(LONG)
    return articles.groupBy(day.alias("day"), hour.alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("priority"), 3).alias("priority"))


def briefing(articles: DataFrame) -> DataFrame:
    """One row per day's signals: the strongest cluster, the worst entity and counts, put together from one-row parts."""
    recent = articles.where(_within(0, 72))
    part = recent.agg(F.count("*").alias("signals"), F.round(F.avg("score"), 4).alias("score"))
    top = recent.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("top_cluster"))
    worst = recent.where("label = 'negative'").groupBy("entity").agg(F.count("*").alias("n")).agg(F.min_by("entity", F.struct(-F.col("n"), F.col("entity"))).alias("worst_entity"))
    joined = part.join(F.broadcast(top), F.lit(True), "left").join(F.broadcast(worst), F.lit(True), "left")  # one row each
    return joined.withColumn("status", F.when(F.col("signals") >= 5, "ready").otherwise("skipped"))


def _before_after(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    changed = F.when(F.col("key") % 3 == 0, F.lit("changed")).otherwise(F.col("hash"))
    return docs.where("key % 2 = 0"), docs.select("key", changed.alias("hash"), (F.col("size") + 1).alias("size"))


def upsert_actions(s: SparkSession, d: str) -> DataFrame:
    """Half of the documents stored, all of them arriving with a third changed: what a conditional, monotone upsert does."""
    stored, arriving = _before_after(s, d)
    return upsert(stored, arriving, ["key"], {"size": F.greatest("t.size", "c.size")}, "t.hash is distinct from c.hash")


def _news(f):
    return lambda s, d: f(feed(s, d))


def _of(name, f):
    return lambda s, d: f(table(s, d, name))


def _titles(s: SparkSession, d: str) -> DataFrame:
    """An article's title is its first line, whole."""
    return table(s, d, "documents").select("doc_id", F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)).alias("title"))


def _feed_page(a: DataFrame) -> DataFrame:
    rows = a.select("guid", "cluster", "published_at").where("cluster in ('error', 'purchase')")
    return keyset_page(rows, "published_at", "guid", 100, ("2024-01-20 00:00:00", 0)).select("guid", "cluster", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


QUERIES = {
    "cluster_agg_headlines": _news(cluster_figures),
    "cluster_momentum_v1": _news(momentum_v1),
    "cluster_momentum_v2": _news(momentum_v2),
    "cluster_momentum_heuristic": _news(momentum_heuristic),
    "momentum_72h_labels": _news(momentum_72h),
    "spike_zscore": _news(lambda a: spikes(a, as_of=SPIKE_TIME)),
    "spike_alert_dedupe": _news(spike_alerts),
    "entity_sentiment_daily_delta": _news(entity_sentiment),
    "controversy_history": _news(controversy),
    "regulatory_tags_like": lambda s, d: regulatory_tags(articles(s, d), key="guid", text="title"),
    "regulatory_risk_full_outer": _news(regulatory_risk),
    "risk_v2": _news(risk_v2),
    "semantic_clusters": _of("embeddings", semantic_clusters),
    "prototype_topic_classify": _of("embeddings", lambda v: prototype_topics(v, v)),
    "lexical_sentiment_negation": _of("documents", lambda r: r.select("doc_id", F.round(lexical_sentiment(F.col("text")), 5).alias("sentiment"))),
    "term_count_sentiment": _of("documents", lambda r: r.select("doc_id", F.round(term_sentiment(F.col("text")), 5).alias("sentiment"))),
    "top_tokens": _of("conversations", top_tokens),
    "near_dup_titles": lambda s, d: near_titles(_titles(s, d)),
    "title_key_dedupe": lambda s, d: title_classes(_titles(s, d)).select("doc_id", "first_id"),
    "quote_extract": lambda s, d: quotes(articles(s, d)),
    "html_clean": _of("pages", html_clean),
    "latest_by_source": _of("pages", latest_by_source),
    "timeline_day_hour": _news(timeline),
    "feed_page": _news(_feed_page),
    "briefing_context": _news(briefing),
    "upsert_actions": upsert_actions,
    "insert_only_new": lambda s, d: insert_new(*_before_after(s, d), ["key"]),
}

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


def _names(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_TITLES = r"""with t as (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z]+'))) as t from documents),
c as (select doc_id, t, len(t) as n, min(doc_id) over (partition by t) as first_id from t where len(t) > 0)"""
_WEIGHT = "case x " + " ".join(f"when '{k}' then {v}" for k, v in (POSITIVE_WEIGHTS | {k: -v for k, v in NEGATIVE_WEIGHTS.items()}).items()) + " end"
_FIGURES = """fig as (select cluster, count(*) as articles, count(*) filter (where age < 60) as recent, round(avg(cast(score as double)), 4) as score,
  count(*) filter (where source = 'official') as official, count(*) filter (where source = 'reddit') as reddit, round(max(priority), 4) as top_priority
  from aged where age between 0 and 71 group by cluster having count(*) >= 2)"""
_SEVERITY = "case when z >= 4 then 'CRITICAL' when z >= 3 then 'HIGH' else 'MEDIUM' end as severity"
ORACLE_SQL = {
    "cluster_agg_headlines": sql(f""", {_FIGURES}, top as (select cluster, string_agg(cast(guid as varchar), ' | ' order by priority desc, guid) as headlines from
  (select *, row_number() over (partition by cluster order by priority desc, guid) as n from aged where age between 0 and 71) where n <= 5 group by cluster)
select fig.*, headlines from fig join top using (cluster)""", "feed"),
    "cluster_momentum_v1": sql(f""", {_FIGURES}, m as (select cluster, least(100.0, round(10 * articles + 20 * recent + 0.5 * top_priority)) as momentum from fig)
select *, case when momentum >= 90 then 'BREAKING' when momentum >= 70 then 'HIGH' when momentum >= 40 then 'NORMAL' else 'LOW' end as tier from m""", "feed"),
    "cluster_momentum_v2": sql(""", h as (select entity, count(*) filter (where age < 1) as a1, count(*) filter (where age < 6) as a6, count(*) filter (where age < 24) as a24, count(*) as a72 from aged where age between 0 and 71 group by entity),
m as (select entity, round(cast(a6 as double) / greatest(a72 / 12.0, 1.0), 3) as velocity, round(least(100.0, 12.0 * a1 + 5.0 * a6 + cast(1.5 as double) * a24 + cast(0.25 as double) * a72), 2) as momentum from h)
select *, case when velocity >= 2 then 'surging' when velocity >= 1.2 then 'rising' when velocity < 0.5 then 'cooling' else 'steady' end as direction,
 case when momentum >= 85 then 'P0' when momentum >= 70 then 'P1' when momentum >= 45 then 'P2' else 'P3' end as tier, momentum >= 70 as spike from m""", "feed"),
    "cluster_momentum_heuristic": sql("""select entity, round(least(100.0, 14.0 * count(*) filter (where age < 24) + cast(0.45 as double) * coalesce(max(priority), 0)), 2) as momentum,
 count(*) filter (where age < 24) >= 5 or coalesce(max(priority), 0) >= 85 as spike from aged where age between 0 and 71 group by entity""", "feed"),
    "momentum_72h_labels": sql(""", h as (select entity, count(*) filter (where age < 1) as a1, count(*) filter (where age < 6) as a6, count(*) filter (where age < 24) as a24,
 count(*) filter (where age < 48) as a48, count(*) as a72 from aged where age between 0 and 71 group by entity), v as (select *, a24 - (a48 - a24) as velocity from h)
select entity, a1, a6, a24, a48, a72, velocity, least(100, 5 * a1 + 3 * a6 + 2 * a24 + a72) as momentum, case when a1 >= 5 then 'SURGING' when velocity > 3 then 'BUILDING'
 when abs(velocity) < 3 then 'STABLE' when velocity < -3 then 'FADING' when a24 = 0 then 'DEAD' else 'STABLE' end as label from v""", "feed"),
    "spike_zscore": sql(f""", c as (select cluster, date_trunc('hour', published_at) as bucket, count(*) as n from feed where published_at < timestamp '{SPIKE_TIME}' group by 1, 2),
p as (select * from c where bucket >= (select max(bucket) from c) - interval 7 days), b as (select cluster, avg(n) as mean, stddev_samp(n) as spread from p where bucket < (select max(bucket) from c) group by 1),
j as (select cluster, n, mean, spread, (n - mean) / nullif(spread, 0) as z from p join b using (cluster) where bucket = (select max(bucket) from c))
select cluster, n as current, round(mean, 4) as mean, round(spread, 4) as spread, round(z, 4) as z, {_SEVERITY} from j where z > 2.5""", "feed"),
    "spike_alert_dedupe": sql(f""", c as (select cluster, date_trunc('hour', published_at) as bucket, count(*) as n from feed group by 1, 2),
z as (select *, (n - avg(n) over w) / nullif(stddev_samp(n) over w, 0) as z from c window w as (partition by cluster order by bucket range between interval 168 hours preceding and interval 1 hour preceding)),
g as (select *, date_diff('hour', lag(bucket) over (partition by cluster order by bucket), bucket) as gap from z where z > 2)
select cluster, strftime(bucket, '%Y-%m-%d %H') as hour, n, round(z, 4) as z, {_SEVERITY}, date_diff('hour', bucket, timestamp '2024-01-31') > 3 as resolved from g where gap is null or gap > 1""", "feed"),
    "entity_sentiment_daily_delta": sql(""", p as (select entity, cast(published_at as date) as day, cluster, count(*) as n, sum(cast(score as double)) as s, count(*) filter (where label = 'positive') as positive,
 count(*) filter (where label = 'negative') as negative, count(*) filter (where label = 'neutral') as neutral from feed group by 1, 2, 3),
r as (select entity, day, cast(sum(n) as bigint) as mentions, round(sum(s) / sum(n), 4) as score, cast(sum(positive) as bigint) as positive, cast(sum(negative) as bigint) as negative, cast(sum(neutral) as bigint) as neutral,
 list(cluster order by n desc, cluster)[1] as top_cluster from p group by 1, 2)
select entity, strftime(day, '%Y-%m-%d') as day, mentions, score, positive, negative, neutral, top_cluster, round(score - lag(score) over (partition by entity order by r.day), 4) as change,
 case when score > 0.15 then 'positive' when score < -0.15 then 'negative' else 'neutral' end as tone from r""", "feed"),
    "controversy_history": sql(""", p as (select entity, cast(published_at as date) as day, count(*) as mentions, count(*) filter (where label = 'negative') as negative, count(*) filter (where source = 'official') as official,
 count(*) filter (where priority >= 85) as heavy from feed group by 1, 2), s as (select *, avg(mentions) over (partition by entity) as mean, stddev_samp(mentions) over (partition by entity) as spread from p),
c as (select entity, day, mentions, round(cast(0.35 as double) * (100.0 * negative / mentions) + cast(0.30 as double) * least(100, 28 * official) + cast(0.20 as double) * least(100, 35 * heavy)
 + cast(0.15 as double) * case when coalesce(spread, 0) = 0 then 50 else least(100, greatest(0, 50 + 15 * (mentions - mean) / spread)) end, 3) as controversy from s),
l as (select *, round(controversy - lag(controversy) over (partition by entity order by day), 3) as change from c)
select entity, strftime(day, '%Y-%m-%d') as day, mentions, controversy, case when controversy >= 65 then 'HIGH' when controversy >= 35 then 'MEDIUM' when controversy >= 10 then 'LOW' else 'MINIMAL' end as label,
 change, case when change > 3 then 'rising' when change < -3 then 'falling' else 'stable' end as trend from l""", "feed"),
    "regulatory_tags_like": sql("select guid, tag, max(confidence) as confidence from articles join (values " + ", ".join(f"('{t}', cast({c} as double), '{p}')" for t, c, p in TAG_PATTERNS) + ") v(tag, confidence, pattern) on contains(upper(title), pattern) group by 1, 2", "feed", "articles"),
    "regulatory_risk_full_outer": sql(""", n as (select entity, count(*) filter (where label = 'negative') as inv, count(*) filter (where label = 'negative' and priority >= 60) as pen,
 count(*) filter (where source = 'official') as fia, count(*) filter (where priority >= 80) as con from aged where age between 0 and 719 group by entity),
r as (select entity, round(cast(0.4 as double) * least(100, 40 * inv) + cast(0.3 as double) * least(100, 25 * pen) + cast(0.2 as double) * least(100, 20 * fia) + cast(0.1 as double) * least(100, con), 3) as risk from n where inv + pen + fia + con > 0)
select *, case when risk >= 75 then 'CRITICAL' when risk >= 50 then 'HIGH' when risk >= 25 then 'MEDIUM' when risk > 5 then 'LOW' else 'CLEAR' end as label from r""", "feed"),
    "risk_v2": sql(""", n as (select entity, count(*) filter (where label = 'negative') as neg, count(*) filter (where source = 'official') as fia, count(*) filter (where priority >= 80) as hot from aged where age between 0 and 335 group by entity),
r as (select entity, round(cast(0.35 as double) * least(100, 18 * hot) + cast(0.35 as double) * least(100, 20 * neg) + cast(0.15 as double) * least(100, 5 * fia) + cast(0.15 as double) * least(100, 6 * neg + 5 * hot), 3) as risk from n)
select *, case when risk >= 75 then 'critical' when risk >= 50 then 'high' when risk >= 25 then 'medium' else 'low' end as label from r where risk > 0""", "feed"),
    "semantic_clusters": """with t as (select vec_id, cast(embedding as double[]) as unit, (vec_id * 37) % 101 as priority from embeddings order by priority desc, vec_id limit 400),
strong as (select distinct a.vec_id from t a join t b on b.priority > a.priority and list_cosine_similarity(a.unit, b.unit) >= 0.25), seeds as (select * from t where vec_id not in (select vec_id from strong)),
near as (select a.vec_id, s.vec_id as seed_id, round(list_cosine_similarity(a.unit, s.unit), 9) as likeness from t a join strong using (vec_id) join seeds s on round(list_cosine_similarity(a.unit, s.unit), 9) >= 0.2)
select vec_id, list(seed_id order by likeness desc, seed_id)[1] as seed_id, round(max(likeness), 5) as likeness from near group by vec_id union all select vec_id, vec_id, 1.0 from seeds""",
    "prototype_topic_classify": """with e as (select vec_id, label, generate_subscripts(embedding, 1) as k, unnest(cast(embedding as double[])) as x from embeddings), p as (select label, k, avg(x) as x from e group by 1, 2),
g as (select label, list(x order by k) as prototype from p group by label), s as (select vec_id, g.label, round(list_cosine_similarity(cast(embedding as double[]), prototype), 6) as l from embeddings, g)
select vec_id, list(label order by l desc, label)[1] as topic, round(max(l), 4) as likeness from s group by vec_id""",
    "lexical_sentiment_negation": f"""with w as (select doc_id, {_WORDS} as w from documents)
select doc_id, round(tanh(coalesce(list_sum([case when list_has_any(w[greatest(i - 3, 1):i - 1], ['not', 'no', 'never']) then -0.75 else 1 end * cast({_WEIGHT.replace('case x', 'case w[i]')} as double) for i in range(1, len(w) + 1) if ({_WEIGHT.replace('case x', 'case w[i]')}) is not null]), 0) / 3), 5) as sentiment from w""",
    "term_count_sentiment": f"""with w as (select doc_id, {_WORDS} as w from documents), n as (select doc_id, len([x for x in w if x in {_names(POSITIVE_WEIGHTS)}]) as p, len([x for x in w if x in {_names(NEGATIVE_WEIGHTS)}]) as q from w)
select doc_id, round((p - q) / greatest(3, p + q), 5) as sentiment from n""",
    "top_tokens": f"select token, count(*) as n from (select unnest({_WORDS}) as token from conversations) where length(token) >= 4 group by token order by n desc, token limit 20",
    "near_dup_titles": _TITLES + """, f as (select first_id as id, any_value(t) as t, any_value(n) as n from c group by 1),
p as (select a.id as low_id, b.id as high_id, len(list_intersect(a.t, b.t)) as k, least(a.n, b.n) as small, greatest(a.n, b.n) as large from f a join f b on a.id < b.id)
select low_id, high_id, round(k / (small + large - k), 4) as likeness from p where (small >= 4 and k = small) or (large >= 5 and k / (small + large - k) >= 0.58)""",
    "title_key_dedupe": _TITLES + " select doc_id, first_id from c",
    "quote_extract": sql("""select guid, regexp_matches(title, '[A-Z][a-z]+ (said|says|told) "') as attributed, unnest(regexp_extract_all(title, '"([^"\\n]{20,240})"', 1)) as quote from articles""", "feed", "articles"),
    "html_clean": r"""select page_id, trim(regexp_extract(coalesce(html, ''), '<title[^>]*>(.*?)</title>', 1, 'is')) as title,
 length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \t\r\n]+', ' ', 'g'))) as plain_chars from pages""",
    "latest_by_source": "select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, max(page_id) as page_id, arg_max(url, page_id) as url, count(*) as pages from pages group by 1",
    "timeline_day_hour": sql("select strftime(published_at, '%Y-%m-%d') as day, hour(published_at) as hour, count(*) as n, round(avg(priority), 3) as priority from feed group by 1, 2", "feed"),
    "feed_page": sql("""select guid, cluster, strftime(published_at, '%Y-%m-%d %H:%M:%S') as at from feed where cluster in ('error', 'purchase') and (published_at < timestamp '2024-01-20' or (published_at = timestamp '2024-01-20' and guid < 0))
order by published_at desc, guid desc limit 100""", "feed"),
    "briefing_context": sql(""", r as (select * from aged where age between 0 and 71), p as (select count(*) as signals, round(avg(cast(score as double)), 4) as score from r)
select *, (select cluster from r group by 1 order by count(*) desc, cluster limit 1) as top_cluster, (select entity from r where label = 'negative' group by 1 order by count(*) desc, entity limit 1) as worst_entity,
 case when signals >= 5 then 'ready' else 'skipped' end as status from p""", "feed"),
    "upsert_actions": """with d as (select doc_id as key, md5(coalesce(text, '')) as hash, coalesce(n_chars, 0) as size from documents), c as (select key, case when key % 3 = 0 then 'changed' else hash end as hash, size + 1 as size from d)
select key, c.hash, case when key % 2 = 0 and key % 3 <> 0 then d.size else c.size end as size, case when key % 2 <> 0 then 'insert' when key % 3 = 0 then 'update' else 'keep' end as action from d join c using (key)""",
    "insert_only_new": "select doc_id as key, case when doc_id % 3 = 0 then 'changed' else md5(coalesce(text, '')) end as hash, coalesce(n_chars, 0) + 1 as size from documents where doc_id % 2 <> 0",
}
