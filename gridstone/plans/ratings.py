"""Driver ratings carried from race to race.

All drivers of a race meet its field's mean rating, so races follow one another; within a race all
drivers are independent. The state is a table with a row a driver (per lane: the whole calendar is
one lane, and each circuit is one whose races are independent of other circuits'). A race costs one
aggregate, the field's mean per lane, which is all that reaches the driver; what a race does to a
rating is a fold inside the row. After every block of races the state is stored and joined with the
next block's results, so no group holds more than a driver's races of a block and a lost executor
costs one block. The number of jobs is the number of races of the longest lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.operators.relational import stored
from gridstone.plans.bulletin import sprint_results
from gridstone.sources.tables import results_once, sql

RACE = ["season", "round"]
#: Weight of a race in the ratings, share of it on a circuit of its own and in a sprint, what a new driver starts with, and what a season without a weight of its own counts.
ELO_K, CIRCUIT_SHARE, SPRINT_SHARE, NEW_RATING, SEASON_WEIGHT = 40, 0.5, 0.17, 1400.0, 0.5
SEASON_WEIGHTS = {2021: 0.20, 2022: 0.50, 2023: 0.75, 2024: 0.85, 2025: 0.90, 2026: 1.00}
#: Races of a lane between two stored states.
BLOCK = 16


def _fold(start: str, entries: str, means: str, after: str) -> str:
    """The rating after the entries numbered below `after`, in SQL: each moves it by k times (score less expectation against the field's mean)."""
    step = f"r + e.k * (e.score - 1 / (1 + power(10D, (element_at({means}, cast(e.number as int)) - r) / 400)))"
    return f"aggregate(filter({entries}, e -> e.number < {after}), {start}, (r, e) -> {step})"


def _means(means: dict, first: int, until: int) -> str:
    """The means of the lane's races from first to until - 1, in order; 0 stands for a race that the lane has not."""
    lists = [f"when {lane} then array({', '.join(f'{by.get(k, 0.0)!r}D' for k in range(first, until))})" for lane, by in sorted(means.items())]
    return f"case lane {' '.join(lists)} end" if lists and until > first else "cast(array() as array<double>)"


def carried(races: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ratings before and after each race: lane, number, driver, before, after.

    races: lane, number (1, 2, ... within the lane), driver, score (1 for the first, 0 for the last), k. A driver
    without a race before starts at NEW_RATING. Of rows that repeat a driver in a race each counts in the field.
    """
    spark = races.sparkSession
    numbered = races.withColumn("block", F.floor((F.col("number") - 1) / block)).withColumn("number", F.col("number") - F.col("block") * block)
    parts = stored(numbered.groupBy("block", "lane", "driver").agg(F.sort_array(F.collect_list(F.struct("number", "score", "k"))).alias("entries")))  # at most `block` races, but for repeats
    longest = races.agg(F.max("number")).first()[0] or 0
    state, out = spark.createDataFrame([], "lane long, driver long, rating double"), None
    for turn in range(-(-longest // block)):
        last = min(block, longest - turn * block)
        mine = stored(parts.where(F.col("block") == turn).join(state, ["lane", "driver"], "left").select("lane", "driver", "entries", F.coalesce("rating", F.lit(NEW_RATING)).alias("start")))
        means: dict = {}
        for number in range(1, last + 1):
            here = mine.where(f"exists(entries, e -> e.number = {number})")
            rating = _fold("start", "entries", _means(means, 1, number), str(number))
            for r in here.groupBy("lane").agg(F.expr(f"sum(cast({rating} as decimal(28,12)))").alias("sum"), F.count("*").alias("n")).collect():  # a row a lane
                means.setdefault(r["lane"], {})[number] = float(r["sum"]) / r["n"]
        done = mine.selectExpr("*", f"{_means(means, 1, last + 1)} as means")
        rows = done.selectExpr("*", "explode(array_distinct(transform(entries, e -> e.number))) as at")
        history = rows.selectExpr("lane", f"at + {turn * block} as number", "driver", f"{_fold('start', 'entries', 'means', 'at')} as before", f"{_fold('start', 'entries', 'means', 'at + 1')} as after")
        out = history if out is None else out.unionByName(history)
        if (turn + 1) * block < longest:
            now = done.selectExpr("lane", "driver", f"{_fold('start', 'entries', 'means', str(block + 1))} as now")
            state = stored(state.join(now, ["lane", "driver"], "full_outer").select("lane", "driver", F.coalesce("now", "rating").alias("rating")))
    return out if out is not None else spark.createDataFrame([], "lane long, number long, driver long, before double, after double")


def _scored(r: DataFrame, share: float) -> DataFrame:
    """season, round, driver, score, k of each result with a place; places of a race are taken in order, ties by driver."""
    fields = r.where("finish is not null").groupBy(*RACE).agg(F.count("*").alias("n"))
    weights = F.create_map(*[F.lit(x) for kv in SEASON_WEIGHTS.items() for x in kv])
    k = ELO_K * share * F.coalesce(F.try_element_at(weights, F.col("season")), F.lit(SEASON_WEIGHT))
    return r.where("finish is not null").join(F.broadcast(fields), RACE).select(*RACE, "driver", (1 - (F.col("finish") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).cast("double").alias("score"), k.alias("k"))  # a row a race is broadcast


def _numbered(scored: DataFrame, lane: Column, names: list[str], after: int = 0) -> DataFrame:
    """scored with its lane and each race's number in it; races, a row each, are numbered in one window a lane."""
    order = scored.select(*RACE).distinct().withColumn("lane", lane.cast("long")).withColumn("number", F.row_number().over(W.partitionBy("lane").orderBy(*names)).cast("long") + after)
    return scored.join(F.broadcast(order), RACE)


def elo(r: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rating of every driver after every race, and after the races on its circuit (a round) alone."""
    whole = _numbered(_scored(r, 1.0), F.lit(0), RACE)
    local = _numbered(_scored(r, CIRCUIT_SHARE), F.col("round"), ["season"])
    a = carried(whole, block).join(F.broadcast(whole.select("number", *RACE).distinct()), "number").select(*RACE, "driver", F.round("after", 4).alias("rating"))
    b = carried(local, block).join(F.broadcast(local.select("lane", "number", *RACE).distinct()), ["lane", "number"]).select(*RACE, "driver", F.round("after", 4).alias("circuit_rating"))
    return a.join(b, [*RACE, "driver"])


def elo_with_sprints(r: DataFrame, sprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ratings before and after each race (kind R), then each sprint (kind S), which counts less and follows all races; without sprints only races."""
    races = _numbered(_scored(r, 1.0), F.lit(0), RACE).withColumn("kind", F.lit("R"))
    held = races.agg(F.max("number")).first()[0] or 0
    short = _numbered(_scored(sprints, SPRINT_SHARE), F.lit(0), RACE, held).withColumn("kind", F.lit("S"))
    both = races.unionByName(short)
    named = both.select("number", *RACE, "kind").distinct()
    return carried(both, block).join(F.broadcast(named), "number").select(*RACE, "kind", "driver", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


def _with_sprints(r: DataFrame) -> DataFrame:
    return elo_with_sprints(r, sprint_results(r))


QUERIES = {
    "elo_ratings": lambda s, d: elo(results_once(s, d)),
    "sprint_ratings": lambda s, d: _with_sprints(results_once(s, d)),
}


def _recursive(name: str, fields: str) -> str:
    """Ratings by a recursive query over `fields` (lane, number, driver, finish, n, k): after every number a row a driver."""
    return f"""{name}(lane, number, driver, before, rating, ran) as (select lane, 0::bigint, driver, {NEW_RATING}::double, {NEW_RATING}::double, false from (select distinct lane, driver from {fields})
union all select s.lane, s.number + 1, s.driver, s.rating, case when f.driver is null then s.rating else s.rating + f.k * (1 - (f.finish - 1)::double / greatest(f.n - 1, 1)
 - 1 / (1 + pow(10::double, (avg(case when f.driver is not null then s.rating end) over (partition by s.lane) - s.rating) / 400))) end, f.driver is not null
 from {name} s left join {fields} f on f.lane = s.lane and f.number = s.number + 1 and f.driver = s.driver where s.number < (select max(number) from {fields}))"""


_K = "case season " + " ".join(f"when {k} then {v}::double" for k, v in SEASON_WEIGHTS.items()) + f" else {SEASON_WEIGHT}::double end * {ELO_K}"
_FIELDS = f"whole as (select 0 as lane, dense_rank() over (order by season, round) as number, season, round, driver, finish, count(*) over (partition by season, round) as n, {_K} as k, 'R' as kind from results)"
_RECURSE = lambda text: text.replace("with ", "with recursive ", 1)

ORACLE_SQL = {
    "elo_ratings": _RECURSE(sql(f""", {_FIELDS}, local as (select round as lane, dense_rank() over (partition by round order by season) as number, season, round, driver, finish, n, k * {CIRCUIT_SHARE} as k from whole),
{_recursive('a', 'whole')}, {_recursive('b', 'local')}
select w.season, w.round, w.driver, round(a.rating, 4) as rating, round(b.rating, 4) as circuit_rating from whole w join local l using (season, round, driver)
 join a on a.number = w.number and a.driver = w.driver join b on b.lane = l.lane and b.number = l.number and b.driver = l.driver""", "results")),
    "sprint_ratings": _RECURSE(sql(f""", {_FIELDS}, short as (select 0 as lane, dense_rank() over (order by season, round) + (select max(number) from whole) as number, season, round, driver, grid as finish, count(*) over (partition by season, round) as n, {_K} * {SPRINT_SHARE} as k, 'S' as kind
 from results where round % 4 = 0), fields as (select * from whole union all select * from short), {_recursive('a', 'fields')}
select f.season, f.round, f.kind, f.driver, round(a.before, 4) as before, round(a.rating, 4) as after from fields f join a using (number, driver)""", "results")),
}
