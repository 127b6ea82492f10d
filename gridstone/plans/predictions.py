"""What is asked of stored predictions: history of their accuracy, rounds, the bundle of a race, its tone; and a race's session by nearness in time.

Predictions are derived from the grid: one model takes it as it is, one turns it round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade
from gridstone.operators.relational import asof_join
from gridstone.plans.weekend import _CALENDAR, calendar
from gridstone.sources.tables import results, sql

RACE = ["season", "round"]
#: Production models' prefix, most rounds of a history, chance from which a driver is in the podium pool, and that pool's size.
PROD, HISTORY, POOL_CHANCE, POOL = "prod_", 50, 0.18, 6
#: The lead in win chance beyond which the favourite is pointed or leant to.
POINTED, LEANT = 0.18, 0.08
#: Fixed value: a session farther than this from its race's time is not the race's.
NEAREST_S = 36 * 3600
#: Models by name, in which rounds they predict (every n-th), and whether they turn the grid round.
MODELS = (("prod_v1", 1, False), ("prod_v2", 3, True), ("dev_x", 2, True))


def predictions(r: DataFrame) -> DataFrame:
    """A row per race, model and driver: predicted place, win and podium chance, when (a number that grows), circuit (unknown for some), actual place and points."""
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(k).alias("every"), F.lit(t).alias("turned"), F.lit(i).alias("step")) for i, (n, k, t) in enumerate(MODELS)])
    fields = r.groupBy(*RACE).agg(F.count("*").alias("n"))
    fields = fields.withColumn("whole", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0.0), lambda s, k: s + 1 / k))  # once a race: a sum over the field for each starter would be quadratic in it
    rows = r.join(F.broadcast(fields), RACE).withColumn("m", F.explode(models)).where(F.col("round") % F.col("m.every") == 0)  # a row a race is broadcast
    place = F.when(F.col("m.turned"), F.col("n") + 1 - F.col("grid")).otherwise(F.col("grid"))
    circuit = F.when(F.col("round") % 6 == 0, "Unknown").otherwise(F.concat(F.lit("circuit "), F.col("round").cast("string")))
    rows = rows.select(*RACE, "driver", "team", F.col("m.model").alias("model"), place.cast("long").alias("predicted"), "n", "whole", (F.col("season") * 10_000 + F.col("round") * 100 + F.col("m.step") * 7 % 5).cast("long").alias("made"), circuit.alias("circuit"), F.col("finish").cast("long").alias("actual"), F.col("points").cast("long").alias("points"))
    win = (1 / (F.col("predicted") * F.col("whole"))).cast("double")
    return rows.withColumn("win", F.round(win, 6)).withColumn("podium", F.least(F.round(3 * F.col("win"), 6), F.lit(1.0))).drop("n", "whole")


def accuracy(p: DataFrame) -> DataFrame:
    """How right each model was on each race: mean error of places in whole millionths, winner, hits in the first three and five."""
    hits = lambda k: F.count_if((F.col("predicted") <= k) & (F.col("actual") <= k))
    return p.groupBy(*RACE, "model", "made").agg(F.floor(F.sum(F.abs(F.col("predicted") - F.col("actual"))) * 1_000_000 / F.count("*")).cast("long").alias("mae_millionths"), (F.count_if((F.col("predicted") == 1) & (F.col("actual") == 1)) > 0).alias("winner"), hits(3).alias("podium"), hits(5).alias("top5"))


def history(p: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last evaluation of each race, of the newest races."""
    last = accuracy(p).groupBy(*RACE).agg(F.max_by(F.struct("model", "mae_millionths", "winner", "podium", "top5"), F.struct("made", "model")).alias("r"))
    return last.orderBy(F.desc("season"), F.desc("round")).limit(most).select(*RACE, "r.*")


def _production(c: str = "model") -> Column:
    return F.when(F.col(c).startswith(PROD), 0).otherwise(1)


def rounds(p: DataFrame) -> DataFrame:
    """Each race with predictions: number of models, the one that is shown (production first, then known circuit, the newest, the greatest name), and when it was made."""
    per = p.groupBy(*RACE, "model").agg(F.max("made").alias("made"), F.count("*").alias("drivers"), F.bool_or(F.lower("circuit") != "unknown").alias("known"))
    shown = F.max_by(F.struct("model", "made", "drivers"), F.struct(-_production(), F.coalesce("known", F.lit(False)).alias("k"), F.col("made"), F.col("model")))
    return per.groupBy(*RACE).agg(F.count("*").alias("models"), shown.alias("r")).select(*RACE, "models", "r.*")


def latest_race(p: DataFrame) -> DataFrame:
    """One row: the race of the newest prediction, production models and known circuits first."""
    order = [_production(), F.when(F.col("circuit").isNull() | (F.lower("circuit") == "unknown"), 1).otherwise(0), F.desc("made"), F.desc("season"), F.desc("round")]
    return p.orderBy(*order).limit(1).select(*RACE)


def bundle(p: DataFrame, r: DataFrame, races_in_season: int = 12) -> DataFrame:
    """The newest race's predictions by its shown model with each driver's points of the season and what they come to: two points a race are expected of a driver without a prediction."""
    race = latest_race(p)
    shown = rounds(p.join(F.broadcast(race), RACE)).select(*RACE, "model")
    mine = p.join(F.broadcast(shown), [*RACE, "model"]).select("driver", "model", "predicted", "win", "podium", "actual")
    season = r.join(F.broadcast(race.select("season")), "season")
    done = season.agg(F.countDistinct("round").alias("done"))  # one row
    standing = season.groupBy("driver").agg(F.sum("points").alias("points"), F.max_by("team", "round").alias("team"))
    met = standing.join(mine, "driver", "left").crossJoin(F.broadcast(done))
    expected = F.when(F.col("predicted").isNull(), 2.0).otherwise(F.greatest(11 - F.col("predicted"), F.lit(0)).cast("double"))
    left = F.greatest(F.lit(races_in_season) - F.col("done"), F.lit(0))
    return met.select("driver", "team", "model", "predicted", "win", "podium", "actual", F.col("points").cast("long").alias("points"), F.round(F.col("points") + expected * left).cast("long").alias("projected"), left.cast("long").alias("races_left"))


def tone(p: DataFrame) -> DataFrame:
    """Per race, by its shown model: the favourite, its lead in win chance, the podium pool's size and what the forecast comes to."""
    mine = p.join(rounds(p).select(*RACE, "model"), [*RACE, "model"])
    places = W.partitionBy(*RACE).orderBy("predicted", "driver")
    first = mine.withColumn("k", F.row_number().over(places)).groupBy(*RACE, "model").agg(
        F.max(F.when(F.col("k") == 1, F.col("driver"))).alias("favourite"), F.max(F.when(F.col("k") == 1, F.col("win"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("win"))).alias("b"), F.least(F.count_if(F.col("podium") >= POOL_CHANCE), F.lit(POOL)).alias("pool")
    )
    spread = F.greatest(F.round(F.col("a") - F.coalesce("b", F.col("a")), 6), F.lit(0.0))
    said = cascade([(spread > POINTED, "Pointed favorite"), (spread > LEANT, "Lean, not lock")], "Open field")
    return first.select(*RACE, "model", "favourite", spread.alias("spread"), F.col("pool").cast("long").alias("pool"), said.alias("tone"))


def sessions_near(races: DataFrame) -> DataFrame:
    """season, number, begins, cancelled: sessions as another source has them, some days off, some called off."""
    k = F.col("season") * 5 + F.col("round") * 11
    begins = F.timestamp_add("HOUR", (k % 97 - 48).cast("int"), F.col("race_date").cast("timestamp_ntz"))
    return races.select("season", (F.col("season") * 100 + F.col("round")).cast("long").alias("number"), begins.alias("begins"), (F.col("round") % 5 == 0).alias("cancelled"))


def nearest_session(races: DataFrame, sessions: DataFrame, most: int = NEAREST_S) -> DataFrame:
    """Each race with the session of its season that begins nearest to it (ties: the earlier, then the smaller number), and how many seconds off; none farther than `most`.

    A race without a session within the bound has nulls: who needs one stops there. Cancelled sessions are none.
    """
    clock = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    held = sessions.where("not cancelled and begins is not null").groupBy("season", clock("begins").alias("begins_at")).agg(F.min("number").alias("number"))
    wanted = races.select(*RACE, clock("race_date").alias("at"))
    back = asof_join(wanted, held.select("season", F.col("begins_at").alias("t"), F.col("begins_at").alias("b_at"), F.col("number").alias("b_number")), ["season"], "at", "t", ["b_at", "b_number"])
    both = asof_join(back.withColumn("turned", -F.col("at")), held.select("season", (-F.col("begins_at")).alias("t"), F.col("begins_at").alias("f_at"), F.col("number").alias("f_number")), ["season"], "turned", "t", ["f_at", "f_number"])
    to_b, to_f = F.col("at") - F.col("b_at"), F.col("f_at") - F.col("at")
    earlier = to_f.isNull() | (to_b <= to_f)
    off = F.when(earlier, to_b).otherwise(to_f)
    near = both.withColumn("off", off).withColumn("number", F.when(earlier, F.col("b_number")).otherwise(F.col("f_number")))
    return near.select(*RACE, F.when(F.col("off") <= most, F.col("number")).alias("number"), F.when(F.col("off") <= most, F.col("off")).alias("seconds_off"))


def _p(f):
    return lambda s, d: f(predictions(results(s, d)))


QUERIES = {
    "prediction_history": _p(history),
    "prediction_rounds": _p(rounds),
    "prediction_bundle": lambda s, d: bundle(predictions(results(s, d)), results(s, d)),
    "forecast_tone": _p(tone),
    "nearest_session": lambda s, d: nearest_session(calendar(s, d), sessions_near(calendar(s, d))),
}

_PRED = f""", f as (select *, count(*) over (partition by season, round) as n from results), md as (select * from (values {', '.join(f"('{n}', {k}, {str(t).lower()}, {i})" for i, (n, k, t) in enumerate(MODELS))}) v(model, every, turned, step)),
p0 as (select season, round, driver, team, model, case when turned then n + 1 - grid else grid end as predicted, n, season * 10000 + round * 100 + step * 7 % 5 as made, case when round % 6 = 0 then 'Unknown' else 'circuit ' || round end as circuit, finish as actual, points from f, md where round % every = 0),
p1 as (select *, round(1 / (predicted * list_sum(list_transform(range(1, n + 1), lambda k: 1::double / k))), 6) as win from p0), p as (select * exclude (n), least(round(3 * win, 6), 1) as podium from p1),
acc as (select season, round, model, made, cast(floor(sum(abs(predicted - actual)) * 1000000 / count(*)) as bigint) as mae_millionths, count(*) filter (where predicted = 1 and actual = 1) > 0 as winner, count(*) filter (where predicted <= 3 and actual <= 3) as podium, count(*) filter (where predicted <= 5 and actual <= 5) as top5 from p group by 1, 2, 3, 4),
offered as (select season, round, model, max(made) as made, count(*) as drivers, bool_or(lower(circuit) <> 'unknown') as known from p group by 1, 2, 3),
shown as (select *, count(*) over (partition by season, round) as models from offered qualify row_number() over (partition by season, round order by starts_with(model, '{PROD}') desc, known desc, made desc, model desc) = 1)"""
ORACLE_SQL = {
    "prediction_history": sql(f"{_PRED} select season, round, model, mae_millionths, winner, podium, top5 from acc qualify row_number() over (partition by season, round order by made desc, model desc) = 1 order by season desc, round desc limit {HISTORY}", "results"),
    "prediction_rounds": sql(f"{_PRED} select season, round, models, model, made, drivers from shown", "results"),
    "prediction_bundle": sql(f"""{_PRED}, t as (select season, round from p order by starts_with(model, '{PROD}') desc, lower(circuit) = 'unknown', made desc, season desc, round desc limit 1),
x as (select p.* from p join t using (season, round) join shown using (season, round, model)), s as (select results.* from results join t using (season)), d as (select greatest(12 - count(distinct round), 0) as races_left from s),
st as (select driver, sum(points) as points, arg_max(team, round) as team from s group by 1)
select st.driver, st.team, model, predicted, win, podium, actual, cast(st.points as bigint) as points, cast(round(st.points + case when predicted is null then 2.0 else greatest(11 - predicted, 0) end * races_left) as bigint) as projected, races_left from st left join x using (driver), d""", "results"),
    "forecast_tone": sql(f"""{_PRED}, x as (select p.*, row_number() over (partition by season, round order by predicted, driver) as k from p join shown using (season, round, model)),
g as (select season, round, model, max(driver) filter (where k = 1) as favourite, max(win) filter (where k = 1) as a, max(win) filter (where k = 2) as b, least(count(*) filter (where podium >= {POOL_CHANCE}), {POOL}) as pool from x group by 1, 2, 3),
h as (select *, greatest(round(a - coalesce(b, a), 6), 0) as spread from g) select season, round, model, favourite, spread, pool, case when spread > {POINTED} then 'Pointed favorite' when spread > {LEANT} then 'Lean, not lock' else 'Open field' end as tone from h""", "results"),
    "nearest_session": f"""with {_CALENDAR}, s as (select season, season * 100 + round as number, cast(race_date as timestamp) + to_hours(cast((season * 5 + round * 11) % 97 - 48 as int)) as begins from (select season, round, r as race_date from m) where round % 5 <> 0),
near as (select r.season, r.round, s.number, date_diff('second', cast(r.r as timestamp), begins) as off from m r left join s on r.season = s.season),
o as (select *, row_number() over (partition by season, round order by abs(off), off, number) as k from near)
select season, round, case when abs(off) <= {NEAREST_S} then number end as number, case when abs(off) <= {NEAREST_S} then abs(off) end as seconds_off from o where k = 1""",
}
