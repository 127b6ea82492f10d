"""The training matrix: what is known of each starter when a race begins, from every table there is, strictly before the race.

Ratings come from the stored state, form and affinity from windows over earlier races, team strength from
a running total, a circuit's memory from its earlier seasons, qualifying from the weekend itself. What
the race itself shows (laps, stints) stands apart under names that begin with `race_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade
from gridstone.operators.relational import islands, stored
from gridstone.plans import forecast
from gridstone.plans.bulletin import sprint_results
from gridstone.plans.racing import qualifying
from gridstone.plans.ratings import _FIELDS, _RECURSE, _recursive, CIRCUIT_SHARE, RACE, SEASON_WEIGHT, SEASON_WEIGHTS, _numbered, _scored, carried
from gridstone.sources.tables import laps, results_once, sql

RUN = ["season", "round", "driver"]
#: What stands for a driver, team or circuit without history.
NO_FINISH, NO_DNF, NO_TEAM = 10.5, 0.12, 10.5
MEMORY = {"volatility": 3.0, "front_hold": 0.55, "shuffle": 0.30, "circuit_dnf": 0.03, "one_stop": 0.45, "two_stop": 0.35, "pit_stops": 2.0}
#: Weight of the overall rating beside the circuit's, races that shrink a grid gain, last results of a team, risk on the first lap by place on the grid.
OVERALL, SHRINK, TEAM_ROWS = 0.70, 8, 10
FIRST_LAP = ((3, 0.01), (10, 0.03))
FIRST_LAP_ELSE = 0.06
#: The compound that counts as soft.
SOFT = "A"
#: From this season on a driver's gained places are of the present rules.
ERA = 1999


def _last3(value: Column, keys: list[str]) -> Column:
    return value.over(W.partitionBy(*keys).orderBy(*RACE).rowsBetween(-3, -1))


def driver_form(r: DataFrame) -> DataFrame:
    """Form of the last three races, affinity to the circuit and places gained under the present rules, of races before."""
    own = W.partitionBy("driver").orderBy(*RACE).rowsBetween(W.unboundedPreceding, -1)
    here = W.partitionBy("driver", "round").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    clean = (F.col("season") >= ERA) & ~F.col("is_dnf")
    gained, n = F.avg(F.when(clean, F.col("grid") - F.col("finish"))).over(own), F.count_if(clean).over(own)
    form = F.coalesce(_last3(F.avg("finish"), ["driver"]), F.lit(NO_FINISH))
    return r.select(
        *RUN, "team", "finish", F.col("is_dnf").cast("int").alias("dnf"), F.col("points").cast("long").alias("points"), "grid", form.alias("form"), F.count("*").over(own).alias("starts"),
        F.coalesce(_last3(F.avg(F.col("is_dnf").cast("int")), ["driver"]), F.lit(NO_DNF)).alias("form_dnf"), F.coalesce(_last3(F.sum("points"), ["driver"]), F.lit(0)).cast("long").alias("points3"),
        F.avg("finish").over(here).alias("affinity"), F.coalesce(gained * n / (n + SHRINK), F.lit(0.0)).alias("gained"),
    )


def sprint_form(r: DataFrame, sprints: DataFrame) -> DataFrame:
    """Points of each starter's last three sprints before the race: a running total of sprints, met by races as of their time."""
    races = r.select(*RUN, F.lit(None).cast("long").alias("p"))
    held = sprints.select(*RUN, F.col("sprint_points").alias("p"))
    total = held.withColumn("k", F.row_number().over(W.partitionBy("driver").orderBy(*RACE))).withColumn("s", F.sum("p").over(W.partitionBy("driver").orderBy("k")))
    three = total.withColumn("three", F.col("s") - F.coalesce(F.lag("s", 3).over(W.partitionBy("driver").orderBy("k")), F.lit(0))).select(*RUN, F.lit(1).alias("side"), "three")
    both = races.select(*RUN, F.lit(0).alias("side"), F.lit(None).cast("long").alias("three")).unionByName(three)  # a race's own sprint comes after it: it does not count yet
    upto = W.partitionBy("driver").orderBy(*RACE, "side").rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("sprint3", F.last("three", ignorenulls=True).over(upto)).where("side = 0").select(*RUN, F.coalesce("sprint3", F.lit(0)).cast("long").alias("sprint3"))


def team_strength(r: DataFrame, rows: int = TEAM_ROWS) -> DataFrame:
    """Mean place of a team's last results before each race, whichever race they are of: two places in its running total."""
    placed = r.select("team", *RACE, "finish", "driver").withColumn("k", F.row_number().over(W.partitionBy("team").orderBy(*RACE, "finish", "driver")).cast("long")).withColumn("s", F.sum("finish").over(W.partitionBy("team").orderBy("k")))
    races = placed.groupBy("team", *RACE).agg((F.min("k") - 1).alias("before"))
    totals = placed.select("team", "k", "s")
    upto = races.join(totals.select(F.col("team"), F.col("k").alias("before"), F.col("s").alias("now")), ["team", "before"], "left")
    back = upto.withColumn("from", F.greatest(F.col("before") - rows, F.lit(0).cast("long"))).join(totals.select("team", F.col("k").alias("from"), F.col("s").alias("old")), ["team", "from"], "left")
    mean = (F.col("now") - F.coalesce("old", F.lit(0))) / (F.col("before") - F.col("from"))
    return back.select("team", *RACE, F.when(F.col("before") > 0, mean).otherwise(F.lit(NO_TEAM)).alias("team_strength"))


def circuit_memory_before(r: DataFrame, stops: DataFrame) -> DataFrame:
    """What races of the circuit's earlier seasons were like, as sums per race and running totals over them; each race is one row in its circuit's window."""
    move = F.abs(F.col("grid") - F.col("finish"))
    sums = {
        "volatility": (F.sum(move), F.count("*")), "front_hold": (F.count_if((F.col("grid") <= 3) & (F.col("finish") <= 3)), F.count_if(F.col("grid") <= 3)),
        "shuffle": (F.count_if((F.col("grid") <= 10) & (move >= 3)), F.count_if(F.col("grid") <= 10)), "circuit_dnf": (F.count_if(F.col("is_dnf")), F.count("*")),
        "one_stop": (F.count_if(F.col("pits") == 1), F.count_if(F.col("pits") > 0)), "two_stop": (F.count_if(F.col("pits") == 2), F.count_if(F.col("pits") > 0)), "pit_stops": (F.sum(F.when(F.col("pits") > 0, F.col("pits"))), F.count_if(F.col("pits") > 0)),
    }
    per = r.join(stops, RUN, "left").groupBy(*RACE).agg(*[x.alias(f"{name}_{s}") for name, pair in sums.items() for s, x in zip("an", pair)])
    w = W.partitionBy("round").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    ratio = lambda name: F.sum(f"{name}_a").over(w) / F.nullif(F.sum(f"{name}_n").over(w), F.lit(0))
    return per.select(*RACE, *[F.round(F.coalesce(ratio(name), F.lit(MEMORY[name])), 4).alias(name) for name in sums])


def race_figures(lap: DataFrame) -> DataFrame:
    """Stops, soft tyres, middle and spread of lap times of each starter: known after the race."""
    runs = islands(lap, RUN, ["lap"], "compound")
    return runs.groupBy(*RUN).agg(
        (F.max("island") - 1).cast("long").alias("pits"), F.max((F.col("compound") == SOFT).cast("int")).alias("soft"), F.round(F.median("lap_ms"), 3).alias("median_ms"),
        F.when(F.count("*") > 3, F.round(F.stddev("lap_ms"), 2)).alias("spread_ms"),
    )


def ratings_before(r: DataFrame) -> DataFrame:
    """Each starter's rating and circuit rating before the race."""
    whole, local = _numbered(_scored(r, 1.0), F.lit(0), RACE), _numbered(_scored(r, CIRCUIT_SHARE), F.col("round"), ["season"])
    a = carried(whole).join(F.broadcast(whole.select("number", *RACE).distinct()), "number").select(*RUN, F.col("before").alias("elo"))
    b = carried(local).join(F.broadcast(local.select("lane", "number", *RACE).distinct()), ["lane", "number"]).select(*RUN, F.col("before").alias("circuit_elo"))
    return a.join(b, RUN)


def training_matrix(r: DataFrame, lap: DataFrame, sprints: DataFrame) -> DataFrame:
    """A row a result with its features; see the module. Starters without a history have the defaults, without a qualifying lap nulls."""
    figures = race_figures(lap)
    weights = F.create_map(*[F.lit(x) for kv in SEASON_WEIGHTS.items() for x in kv])
    met = driver_form(r).join(sprint_form(r, sprints), RUN).join(team_strength(r), ["team", *RACE]).join(ratings_before(r), RUN)
    met = met.join(qualifying(lap).select(*RUN, "q1", "q2", "q3", "gap"), RUN, "left").join(figures, RUN, "left").join(circuit_memory_before(r, figures.select(*RUN, "pits")), RACE)
    risk = cascade_number([(F.col("grid") <= edge, risk) for edge, risk in FIRST_LAP], FIRST_LAP_ELSE)
    over = F.when(F.col("starts") > 0, F.col("team_strength") - F.col("form")).otherwise(0.0)
    return met.select(
        *RUN, "team", "finish", "dnf", "points", "grid", F.round(OVERALL * F.col("elo") + (1 - OVERALL) * F.col("circuit_elo"), 4).alias("rating"), F.round("circuit_elo", 4).alias("circuit_rating"),
        F.round("form", 4).alias("form"), F.round("form_dnf", 4).alias("form_dnf"), (F.col("points3") + F.col("sprint3")).alias("points3"), "sprint3", F.round(F.coalesce("affinity", "form"), 4).alias("affinity"),
        F.round(over, 4).alias("over_team"), F.round("gained", 4).alias("gained"), F.round("team_strength", 4).alias("team_strength"), F.col("gap").alias("gap_ms"), F.round(F.col("gap") / 1000, 5).alias("gap_s"),
        F.round(F.col("q3") - F.col("q1"), 2).alias("q1_to_q3"), F.round(F.col("q3") - F.col("q2"), 2).alias("q2_to_q3"), risk.alias("first_lap_risk"), *MEMORY,
        F.coalesce(F.try_element_at(weights, F.col("season")), F.lit(SEASON_WEIGHT)).alias("season_weight"), F.col("pits").alias("race_pits"), F.col("soft").alias("race_soft"), F.col("median_ms").alias("race_median_ms"), F.col("spread_ms").alias("race_spread_ms"),
    )


def cascade_number(branches: list[tuple[Column, float]], otherwise: float) -> Column:
    return cascade([(test, F.lit(value)) for test, value in branches], F.lit(otherwise))


#: What a model may be fitted on: all that is known before the start.
KNOWN = (
    "grid", "rating", "circuit_rating", "form", "form_dnf", "points3", "sprint3", "affinity", "over_team", "gained", "team_strength", "gap_ms", "q1_to_q3", "q2_to_q3", "first_lap_risk", *MEMORY,
)



def matrix_forecast(r: DataFrame, lap: DataFrame, sprints: DataFrame) -> DataFrame:
    """Places of the last season by three models, each fitted on all that the matrix knows of the seasons before: season, round, driver, ridge, forest, boosted."""
    return forecast.by_models(stored(training_matrix(r, lap, sprints).select(*RUN, "team", "finish", *KNOWN)), KNOWN)


def _of_tables(f):
    def query(s, d):
        r = results_once(s, d)
        return f(r, laps(s, d), sprint_results(r))

    return query


QUERIES = {
    "matrix_forecast": _of_tables(matrix_forecast),
    "training_matrix": _of_tables(training_matrix),
}

_RATIOS = {
    "volatility": ("sum(abs(grid - finish))", "count(*)"), "front_hold": ("count(*) filter (where grid <= 3 and finish <= 3)", "count(*) filter (where grid <= 3)"), "shuffle": ("count(*) filter (where grid <= 10 and abs(grid - finish) >= 3)", "count(*) filter (where grid <= 10)"),
    "circuit_dnf": ("count(*) filter (where is_dnf)", "count(*)"), "one_stop": ("count(*) filter (where pits = 1)", "count(*) filter (where pits > 0)"), "two_stop": ("count(*) filter (where pits = 2)", "count(*) filter (where pits > 0)"), "pit_stops": ("sum(pits) filter (where pits > 0)", "count(*) filter (where pits > 0)"),
}
ORACLE_SQL = {
    "training_matrix": _RECURSE(sql(f""", {_FIELDS}, local as (select round as lane, dense_rank() over (partition by round order by season) as number, season, round, driver, finish, n, k * {CIRCUIT_SHARE} as k from whole),
{_recursive('ra', 'whole')}, {_recursive('rb', 'local')},
elo as (select w.season, w.round, w.driver, a.before as elo, b.before as circuit_elo from whole w join local l using (season, round, driver) join ra a on a.number = w.number and a.driver = w.driver join rb b on b.lane = l.lane and b.number = l.number and b.driver = l.driver),
ql as (select season, round, driver, min(lap_ms) filter (where sector = 1) as q1, min(lap_ms) filter (where sector = 2) as q2, min(lap_ms) filter (where sector = 3) as q3 from laps group by 1, 2, 3),
qu as (select *, round(coalesce(q3, q2, q1) - min(coalesce(q3, q2, q1)) over (partition by season, round), 2) as gap from ql where coalesce(q3, q2, q1) is not null),
lb as (select *, case when lag(compound) over (partition by season, round, driver order by lap) is distinct from compound then 1 else 0 end as new from laps),
fig as (select season, round, driver, sum(new) - 1 as pits, cast(max(cast(compound = '{SOFT}' as int)) as int) as soft, round(median(lap_ms), 3) as median_ms, case when count(*) > 3 then round(stddev_samp(lap_ms), 2) end as spread_ms from lb group by 1, 2, 3),
o as (select r.*, coalesce((select avg(finish) from (select finish from results p where p.driver = r.driver and (p.season, p.round) < (r.season, r.round) order by season desc, round desc limit 3)), {NO_FINISH}) as form,
 (select count(*) from results p where p.driver = r.driver and (p.season, p.round) < (r.season, r.round)) as starts,
 coalesce((select avg(cast(is_dnf as int)) from (select is_dnf from results p where p.driver = r.driver and (p.season, p.round) < (r.season, r.round) order by season desc, round desc limit 3)), {NO_DNF}) as form_dnf,
 coalesce((select sum(points) from (select points from results p where p.driver = r.driver and (p.season, p.round) < (r.season, r.round) order by season desc, round desc limit 3)), 0) as race3,
 coalesce((select sum(case grid when 1 then 8 when 2 then 7 when 3 then 6 when 4 then 5 when 5 then 4 when 6 then 3 when 7 then 2 when 8 then 1 else 0 end) from (select grid from results p where p.driver = r.driver and p.round % 4 = 0 and (p.season, p.round) < (r.season, r.round) order by season desc, round desc limit 3)), 0) as sprint3,
 (select avg(finish) from results p where p.driver = r.driver and p.round = r.round and p.season < r.season) as affinity,
 coalesce((select avg(grid - finish) * count(*) / (count(*) + {SHRINK}) from results p where p.driver = r.driver and p.season >= {ERA} and not p.is_dnf and (p.season, p.round) < (r.season, r.round)), 0) as gained,
 coalesce((select avg(finish) from (select finish from results p where p.team = r.team and (p.season, p.round) < (r.season, r.round) order by season desc, round desc, finish desc, driver desc limit {TEAM_ROWS})), {NO_TEAM}) as team_strength from results r),
pr as (select season, round, {', '.join(f'{a} as {n}_a, {b} as {n}_n' for n, (a, b) in _RATIOS.items())} from results left join fig using (season, round, driver) group by 1, 2),
mem as (select season, round, {', '.join(f"round(coalesce(cast(sum({n}_a) over w as double) / nullif(sum({n}_n) over w, 0), {MEMORY[n]}), 4) as {n}" for n in _RATIOS)} from pr window w as (partition by round order by season rows between unbounded preceding and 1 preceding))
select season, round, driver, team, finish, cast(is_dnf as int) as dnf, cast(points as bigint) as points, grid, round({OVERALL}::double * elo + {1 - OVERALL!r}::double * circuit_elo, 4) as rating, round(circuit_elo, 4) as circuit_rating, round(form, 4) as form, round(form_dnf, 4) as form_dnf,
 cast(race3 + sprint3 as bigint) as points3, cast(sprint3 as bigint) as sprint3, round(coalesce(affinity, form), 4) as affinity, round(case when starts > 0 then team_strength - form else 0 end, 4) as over_team, round(gained, 4) as gained, round(team_strength, 4) as team_strength,
 gap as gap_ms, round(gap / 1000, 5) as gap_s, round(q3 - q1, 2) as q1_to_q3, round(q3 - q2, 2) as q2_to_q3, cast(case when grid <= 3 then 0.01 when grid <= 10 then 0.03 else {FIRST_LAP_ELSE} end as double) as first_lap_risk, {', '.join(MEMORY)}, cast({SEASON_WEIGHT} as double) as season_weight,
 cast(pits as bigint) as race_pits, soft as race_soft, median_ms as race_median_ms, spread_ms as race_spread_ms
from o join elo using (season, round, driver) left join qu using (season, round, driver) left join fig using (season, round, driver) join mem using (season, round)""", "results", "laps")),
}
