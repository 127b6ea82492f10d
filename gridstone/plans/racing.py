"""Racing analytics: laps, stints, joins in time, ratings, point-in-time features, scoring and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, ratio
from gridstone.operators.relational import asof_join, islands, previous_mean, stored
from gridstone.sources.tables import laps, results, sql, table

SESSION = ["season", "round"]
RUN = ["season", "round", "driver"]


def stints(lap: DataFrame) -> DataFrame:
    """Runs of laps on one compound per driver and session."""
    marked = islands(lap, RUN, ["lap"], "compound")
    return marked.groupBy(*RUN, F.col("island").cast("long").alias("stint")).agg(F.first("compound").alias("compound"), F.min("lap").alias("start_lap"), F.max("lap").alias("end_lap"), F.count("*").alias("laps"))


def practice(lap: DataFrame) -> DataFrame:
    """Best, median and number of laps and the most frequent compound (ties: the first by name) of the three practice sectors."""
    per = lap.where("sector <= 3").groupBy(*RUN, "sector", "compound").agg(F.count("*").alias("n"))
    top = per.groupBy(*RUN, "sector").agg(F.min_by("compound", F.struct(-F.col("n"), F.col("compound"))).alias("compound"))
    figures = lap.where("sector <= 3").groupBy(*RUN, "sector").agg(F.min("lap_ms").alias("best"), F.round(F.median("lap_ms"), 3).alias("median"), F.count("*").alias("laps"))
    return figures.join(top, [*RUN, "sector"])


def qualifying(lap: DataFrame) -> DataFrame:
    """q1 to q3 as the best of the first three sectors; the latest counts, with its gap to pole and its place."""
    q = lap.groupBy(*RUN).agg(*[F.min(F.when(F.col("sector") == k, F.col("lap_ms"))).alias(f"q{k}") for k in (1, 2, 3)])
    q = q.withColumn("best", F.coalesce("q3", "q2", "q1")).where("best is not null")
    w = W.partitionBy(*SESSION)
    return q.select("*", F.round(F.col("best") - F.min("best").over(w), 2).alias("gap"), F.row_number().over(w.orderBy("best", "driver")).alias("place"))


def clean_laps(lap: DataFrame, within: float = 1.2) -> DataFrame:
    """Laps of at most `within` times their session's median; the median is one row per session and is joined back.

    The mean is rounded half up from whole cents, so that neither the order of summation nor a tie can move it.
    """
    cents = F.sum(F.round(F.col("lap_ms") * 100).cast("bigint"))
    mean = F.floor((20 * cents + F.count("*")) / (2 * F.count("*"))) / 1000
    middle = lap.groupBy(*SESSION).agg(F.median("lap_ms").alias("middle"))
    return lap.join(middle, SESSION).where(F.col("lap_ms") <= within * F.col("middle")).groupBy(*SESSION).agg(F.count("*").alias("laps"), mean.alias("mean"))


def pace(lap: DataFrame, low: float = 5_000, high: float = 300_000, clip: float = 1.07) -> DataFrame:
    """Sane laps within 7 % of their session's best, per driver."""
    sane = lap.where(F.col("lap_ms").between(low, high))
    best = sane.groupBy(*SESSION).agg(F.min("lap_ms").alias("best"))
    return sane.join(best, SESSION).where(F.col("lap_ms") <= clip * F.col("best")).groupBy(*RUN).agg(F.count("*").alias("laps"), F.round(F.min("lap_ms"), 2).alias("fastest"))


def sector_best(lap: DataFrame) -> DataFrame:
    """Best time of each sector of a session and who owns it (ties: the smaller driver)."""
    return lap.groupBy(*SESSION, "sector").agg(F.min("lap_ms").alias("best"), F.min_by("driver", F.struct("lap_ms", "driver")).alias("owner"))


def overtakes(r: DataFrame) -> DataFrame:
    """Gained and lost places per session."""
    gain = F.col("grid") - F.col("finish")
    return r.groupBy(*SESSION).agg(F.sum(F.greatest(gain, F.lit(0))).alias("gained"), F.max(gain).alias("most"), F.sum(F.abs(gain)).alias("moved"))


def tyre_fit(lap: DataFrame, least: int = 15) -> DataFrame:
    """Second-degree fit of lap time on tyre life per round and compound, from sums about the group's mean life."""
    keys = ["round", "compound"]
    centre = lap.groupBy(*keys).agg(F.avg("tyre_life").alias("c"), F.avg("lap_ms").alias("m"))
    x, y = F.col("tyre_life") - F.col("c"), F.col("lap_ms") - F.col("m")
    sums = lap.join(centre, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x * x).alias("x2"), F.sum(x * x * x).alias("x3"), F.sum(x * x * x * x).alias("x4"), F.sum(x * y).alias("xy"), F.sum(x * x * y).alias("x2y"))
    n, x2, x3, x4, xy, x2y = (F.col(k) for k in ("n", "x2", "x3", "x4", "xy", "x2y"))
    quad = ratio(x2y * x2 - x3 * xy, (x4 - x2 * x2 / n) * x2 - x3 * x3)
    return sums.where(n >= least).select(*keys, "n", F.round(quad, 3).alias("quad"))


def constructor_strength(r: DataFrame) -> DataFrame:
    """Mean points per team with the weight of its races: full from twenty on, less in sparse seasons."""
    per = r.groupBy("team", "season").agg(F.count("*").alias("n"), F.avg("points").alias("mean"))
    weight = F.least(F.col("n") / 20, F.lit(1.0)) * F.when(F.col("season") < 1995, 0.6).otherwise(1.0)
    return per.groupBy("team").agg(F.round(F.sum(weight * F.col("mean")) / F.sum(weight), 4).alias("strength"), F.sum("n").alias("races"))


def circuit_profile(r: DataFrame) -> DataFrame:
    """Per round: share of retirements, mean move, share of winners from the front, and the retirement curve's scale."""
    retired = F.avg(F.col("is_dnf").cast("int"))
    scale = 58 / F.pow(-F.ln(F.greatest(1 - retired, F.lit(0.01))), 1 / 0.8)
    front = F.avg(F.when(F.col("finish") == 1, (F.col("grid") <= 3).cast("int")))
    return r.groupBy("round").agg(F.round(retired, 4).alias("dnf_rate"), F.round(F.avg(F.abs(F.col("grid") - F.col("finish"))), 4).alias("moves"), F.round(front, 4).alias("front_hold"), F.when(retired > 0, F.round(scale, 3)).alias("dnf_scale"))


def features(r: DataFrame) -> DataFrame:
    """Point-in-time features: only races strictly before a row's own enter, also where a team has several rows in a race.

    Team figures are first brought to one row per team and race, then looked back on.
    """
    order = SESSION
    team = r.groupBy("team", *SESSION).agg(F.sum("points").alias("p"), F.count("*").alias("k"))
    w = W.partitionBy("team").orderBy(*order).rowsBetween(-10, -1)
    team = team.select("team", *SESSION, F.round(F.sum("p").over(w) / F.sum("k").over(w), 4).alias("team_form"))
    n = F.count("*").over(W.partitionBy("driver").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    delta = F.avg(F.col("grid") - F.col("finish")).over(W.partitionBy("driver").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = r.select(
        *RUN, "team", "finish",
        F.round(previous_mean("finish", ["driver"], order, 3), 4).alias("form3"),
        F.round(previous_mean("finish", ["driver", "round"], order), 4).alias("circuit_affinity"),
        F.round(delta * (n / (n + 8)), 4).alias("grid_delta"),
    )
    return rows.join(team, ["team", *SESSION], "left")


def _last_season(r: DataFrame) -> DataFrame:
    return r.join(F.broadcast(r.agg(F.max("season").alias("season"))), "season")


def projection(r: DataFrame, rounds: int = 12) -> DataFrame:
    """Points of the last season and what they come to over its remaining rounds, with the driver's latest team."""
    last = _last_season(r)
    done = last.agg(F.max("round").alias("done"))
    per = last.groupBy("driver").agg(F.sum("points").alias("points"), F.count("*").alias("n"), F.max_by("team", "round").alias("team"))
    left = F.greatest(F.lit(rounds) - F.col("done"), F.lit(0))
    return per.join(F.broadcast(done)).select("driver", "team", "points", F.round(F.col("points") + F.coalesce(F.col("points") / F.col("n"), F.lit(2.0)) * left, 3).alias("projected"))


def prior(r: DataFrame, temperature: float = 3.0) -> DataFrame:
    """Win chance of each starter of the newest race: softmax of its previous form and grid."""
    newest = r.agg(F.max(F.struct(*SESSION)).alias("m")).select("m.*")
    f = r.withColumn("form", previous_mean("points", ["driver"], SESSION, 3)).join(F.broadcast(newest), SESSION)
    strength = F.coalesce("form", F.lit(0.0)) * 0.6 + 10.0 / F.col("grid") * 0.4
    e = F.exp(strength / temperature)
    return f.select("driver", F.round(e / F.sum(e).over(W.partitionBy(*SESSION)), 6).alias("win"))


def scoring(r: DataFrame) -> DataFrame:
    """Grid order as a prediction of each race: mean error, hits in the top places and the Brier score of a winner's chance of 1 / grid."""
    p = 1.0 / F.col("grid")
    won = (F.col("finish") == 1).cast("int")
    hits = lambda k: F.count_if((F.col("grid") <= k) & (F.col("finish") <= k))
    return r.groupBy(*SESSION).agg(F.round(F.avg(F.abs(F.col("grid") - F.col("finish"))), 4).alias("mae"), (hits(1) == 1).alias("winner"), hits(3).alias("podium"), hits(5).alias("top5"), F.round(F.avg((p - won) * (p - won)), 6).alias("brier"))


def model_version(r: DataFrame) -> DataFrame:
    """One model per race of several candidates: production first, then known circuits, then the newest."""
    name = F.when(F.col("driver") % 3 == 0, "prod_").when(F.col("driver") % 3 == 1, "test_").otherwise("dev_")
    per = r.groupBy(*SESSION, F.concat(name, F.col("team").cast("string")).alias("model")).agg(F.max("driver").alias("newest"))
    w = W.partitionBy(*SESSION).orderBy(F.when(F.col("model").startswith("prod_"), 0).otherwise(1), F.desc("newest"), "model")
    return per.withColumn("n", F.row_number().over(w)).where("n = 1").select(*SESSION, "model")


def calibration(r: DataFrame) -> DataFrame:
    """Chance of a win by grid place, monotone by isotonic regression; the raw share where there are under 50 rows."""
    from pyspark.ml.regression import IsotonicRegression

    won = (F.col("finish") == 1).cast("double")
    places = stored(r.groupBy("grid").agg(F.avg(won).alias("won"), F.count("*").alias("n")))  # a row a place: rows of a place are pooled by the fit anyhow
    if (places.agg(F.sum("n")).first()[0] or 0) < 50:
        return places.select("grid", F.col("won").alias("win"))
    rows = places.select("grid", F.col("grid").cast("double").alias("x"), "won", F.col("n").cast("double").alias("n"))
    model = IsotonicRegression(featuresCol="x", labelCol="won", weightCol="n", isotonic=False).fit(rows)
    return model.transform(rows).select("grid", F.round("prediction", 6).alias("win"))


def team_report(r: DataFrame, lap: DataFrame) -> DataFrame:
    """Per team and race: best practice, best qualifying place, best finish and points, whichever exist."""
    q = lap.groupBy(*RUN).agg(*[F.min(F.when(F.col("sector") == k, F.col("lap_ms"))).alias(f"q{k}") for k in (1, 2, 3)], F.min(F.when(F.col("sector") <= 3, F.col("lap_ms"))).alias("practice"))
    q = q.withColumn("best", F.coalesce("q3", "q2", "q1"))  # as in `practice` and `qualifying`, from one pass over the laps
    place = F.row_number().over(W.partitionBy(*SESSION).orderBy(F.col("best").asc_nulls_last(), "driver"))
    q = q.select(*RUN, "practice", F.when(F.col("best").isNotNull(), place).alias("place"))
    return r.join(q, RUN, "left").groupBy("team", *SESSION).agg(F.min("finish").alias("finished"), F.sum("points").alias("points"), F.min("practice").alias("practice"), F.min("place").alias("qualified"))


def completeness(r: DataFrame, least: int = 10) -> DataFrame:
    return r.groupBy(*SESSION).agg(F.count("*").alias("drivers")).withColumn("complete", F.col("drivers") >= least)


def session_counts(r: DataFrame, lap: DataFrame) -> DataFrame:
    n = lap.groupBy(*SESSION).agg(F.count("*").alias("laps"), F.countDistinct("compound").alias("compounds"))
    return r.groupBy(*SESSION).agg(F.count("*").alias("drivers"), F.sum("points").alias("points")).join(n, SESSION, "left")


def positions_as_of(s, d) -> DataFrame:
    """For each purchase of a user, the last view at or before it: a backward as-of join."""
    e = table(s, d, "events").select(F.col("event_id"), F.col("user_id"), F.col("ts"), "event_type", "value")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("view_value"))
    out = asof_join(buys, views, ["user_id"], "ts", "seen", ["view_value"])
    return out.select("event_id", "user_id", F.round("view_value", 4).alias("view_value"))


def nearest(s, d) -> DataFrame:
    """For each error of a user, the value of the click nearest in time (ties: the earlier), from as-of joins both ways."""
    e = table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("t").alias("at"), F.col("value").alias("v"))
    back = asof_join(errors, clicks.withColumn("b_at", F.col("at")).withColumnRenamed("v", "b_v"), ["user_id"], "t", "at", ["b_at", "b_v"])
    turned = back.withColumn("t", -F.col("t"))
    ahead = asof_join(turned, clicks.select("user_id", (-F.col("at")).alias("at"), (-F.col("at")).alias("f_at"), F.col("v").alias("f_v")), ["user_id"], "t", "at", ["f_at", "f_v"])
    to_b, to_f = -F.col("t") - F.col("b_at"), -F.col("f_at") + F.col("t")
    pick = F.when(to_f.isNull() | (to_b <= to_f), F.col("b_v")).otherwise(F.col("f_v"))
    return ahead.select("event_id", F.round(pick, 4).alias("value"))


def status_ranges(s, d) -> DataFrame:
    """Runs of equal event types per user, with their first and last time and number."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    runs = islands(e, ["user_id"], ["ts", "event_id"], "event_type")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return runs.groupBy("user_id", F.col("island").cast("long").alias("run")).agg(F.first("event_type").alias("status"), stamp(F.min("ts")).alias("from_ts"), stamp(F.max("ts")).alias("to_ts"), F.count("*").alias("n"))


def resample(lap: DataFrame, frames: int = 8) -> DataFrame:
    """Laps as a path: the point nearest to each of equally spaced distances, for paths of at least five points.

    Each point covers the frames nearer to it than to its neighbours, so no frame meets all points.
    """
    w = W.partitionBy(*RUN).orderBy("lap")
    path = lap.withColumn("far", F.sum(F.col("lap_ms").cast("decimal(18,2)")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double"))
    whole = W.partitionBy(*RUN)
    path = path.select(*RUN, "lap", "far", F.lag("far").over(w).alias("before"), F.lead("far").over(w).alias("after"), F.max("far").over(whole).alias("total"), F.count("*").over(whole).alias("points")).where("points >= 5")
    step = F.col("total") / frames
    low = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.floor((F.col("before") + F.col("far")) / 2 / step) + 1)
    high = F.when(F.col("after").isNull(), F.lit(frames)).otherwise(F.floor((F.col("far") + F.col("after")) / 2 / step))
    return path.where(low <= high).select(*RUN, "lap", F.explode(F.sequence(low, high)).alias("frame"))


def circuit_memory(r: DataFrame, lap: DataFrame) -> DataFrame:
    """What races on a circuit (a round of every season) were like: grids, first stops, strategies and an archetype.

    A stop is the start of a further stint, a strategy the sequence of compounds, of which the
    most frequent (ties: the first by name) is common; its entropy is relative to that of equal shares.
    """
    runs = islands(lap, RUN, ["lap"], "compound").groupBy(*RUN, "island").agg(F.min("lap").alias("start"), F.first("compound").alias("compound"))
    plan = runs.groupBy(*RUN).agg(
        (F.count("*") - 1).alias("stops"), F.min(F.when(F.col("island") == 2, F.col("start") - 1)).alias("first_stop"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "compound"))), lambda x: x["compound"]), "-").alias("strategy"),
    )
    rows = stored(r.join(plan, RUN, "left").select(*SESSION, "grid", "finish", "is_dnf", "stops", "first_stop", "strategy", (F.col("grid") - F.col("finish")).alias("gain")))  # read three times
    middle = rows.groupBy("round").agg(F.median("first_stop").alias("middle"))
    rows = rows.join(middle, "round").withColumn("early", F.col("first_stop") <= F.col("middle"))
    stopped = F.col("first_stop").isNotNull()
    share = lambda test, among: F.avg(F.when(among, test.cast("int")))
    s = rows.groupBy("round").agg(
        F.count_distinct("season").alias("races"), F.avg(F.abs("gain")).alias("volatility"), F.coalesce(share(F.col("finish") <= 3, F.col("grid") <= 3), F.lit(0.55)).alias("front_hold"),
        F.coalesce(share(F.abs("gain") >= 3, F.col("grid") <= 10), F.lit(0.30)).alias("shuffle"), F.avg(F.col("is_dnf").cast("int")).alias("dnf"),
        F.coalesce(F.avg(F.when(stopped, F.col("stops"))), F.lit(2.0)).alias("stops"), F.coalesce(share(F.col("stops") == 1, stopped), F.lit(0.45)).alias("one_stop"),
        F.coalesce(F.max("middle"), F.lit(20.0)).alias("first_stop"),
        (F.coalesce(F.avg(F.when(F.col("early"), F.col("gain"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~F.col("early"), F.col("gain"))), F.lit(0.0))).alias("early_gain"),
    )
    plans = rows.where(stopped).groupBy("round", "strategy").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(W.partitionBy("round"))
    mixed = plans.withColumn("p", p).groupBy("round").agg(F.min(F.struct(-F.col("k"), "strategy"))["strategy"].alias("common"), (-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.count("*").alias("kinds"))
    s = s.join(mixed, "round", "left")
    entropy = F.when(F.col("kinds") > 1, F.col("h") / F.ln("kinds")).otherwise(0.0)
    kind = cascade([(F.col("early_gain") >= 0.8, "undercut_friendly"), ((F.col("one_stop") >= 0.58) & (F.col("volatility") <= 2.8), "track_position"), (F.col("stops") >= 1.7, "high_degradation")], "balanced")
    rounded = [F.round(c, 3).alias(c) for c in ("volatility", "front_hold", "shuffle", "dnf", "stops", "one_stop", "first_stop", "early_gain")]
    return s.select("round", "races", *rounded, F.round(entropy, 3).alias("entropy"), F.coalesce("common", F.lit("UNKNOWN")).alias("common"), kind.alias("archetype"))


#: Weights of the practice sessions.
PRACTICE_WEIGHTS = (0.5, 0.35, 0.15)


def practice_pace(lap: DataFrame) -> DataFrame:
    """Per driver and race: gap of the median lap to the best median of each practice sector, over 5000 and at most 0.2, weighted over the sectors that the race has.

    Laps are in whole cents, so medians are whole half cents; all is summed in them and divided once.
    """
    medians = lap.where("sector <= 3").groupBy(*RUN, "sector").agg(F.round(200 * F.median("lap_ms")).cast("bigint").alias("m"))
    weight = F.element_at(F.array(*[F.lit(round(100 * w)) for w in PRACTICE_WEIGHTS]), F.col("sector").cast("int"))
    best = medians.groupBy(*SESSION, "sector").agg(F.min("m").alias("best"))
    total = best.groupBy(*SESSION).agg(F.sum(weight).alias("total"))
    loss = F.least(F.col("m") - F.col("best"), F.lit(200_000)) * weight
    rows = medians.join(best, [*SESSION, "sector"]).join(total, SESSION).groupBy(*RUN, "total").agg(F.sum(loss).alias("loss"))
    return rows.select(*RUN, (-F.expr("(2 * loss + total) div (2 * total)") / 1_000_000).alias("pace"))


def training_weights(r: DataFrame, since: int = 1998, older: float = 0.55, newer: float = 2.25, latest: float = 2.0, rounds: int = 3) -> DataFrame:
    """Weight of each race in training: less before a change of rules, more after it, twice for the last four rounds."""
    races = r.select(*SESSION).distinct()
    newest = races.agg(F.max(F.struct(*SESSION)).alias("m")).select(F.col("m.season").alias("s"), (F.col("m.round") - rounds).alias("k"))
    w = F.when(F.col("season") < since, older).otherwise(newer) * F.when(F.struct("season", "round") >= F.struct("s", "k"), latest).otherwise(1.0)
    return races.crossJoin(F.broadcast(newest)).select(*SESSION, F.round(w, 4).alias("weight"))


def standings(r: DataFrame, top: int = 5) -> DataFrame:
    """The first five drivers and teams of the last season by points (ties: wins, then number)."""
    last = _last_season(r)
    out = []
    for kind in ("driver", "team"):
        per = last.groupBy(F.col(kind).cast("long").alias("id")).agg(F.sum("points").alias("points"), F.count_if(F.col("finish") == 1).alias("wins")).orderBy(F.desc("points"), F.desc("wins"), "id").limit(top)
        place = F.row_number().over(W.orderBy(F.desc("points"), F.desc("wins"), "id"))  # over `top` rows
        out.append(per.select(F.lit(kind).alias("kind"), place.alias("place"), "id", "points", "wins"))
    return out[0].unionByName(out[1])


def _r(f):
    return lambda s, d: f(results(s, d))


def _l(f):
    return lambda s, d: f(laps(s, d))


QUERIES = {
    "stints_islands": _l(stints), "practice_agg": _l(practice), "quali_gap": _l(qualifying), "outlier_laps": _l(clean_laps), "lap_pace_clip": _l(pace), "sector_best": _l(sector_best),
    "overtakes": _r(overtakes), "tyre_quadratic_fit": _l(tyre_fit), "constructor_strength": _r(constructor_strength), "circuit_profile": _r(circuit_profile), "feature_matrix": _r(features),
    "championship_projection": _r(projection), "prior_softmax": _r(prior), "prediction_scoring": _r(scoring), "model_version_pick": _r(model_version),
    "team_weekend_report": lambda s, d: team_report(results(s, d), laps(s, d)), "completeness_check": _r(completeness), "sessions_with_counts": lambda s, d: session_counts(results(s, d), laps(s, d)),
    "asof_position": positions_as_of, "nearest_weather": nearest, "status_ranges": status_ranges, "telemetry_resample": _l(resample),
    "circuit_memory": lambda s, d: circuit_memory(results(s, d), laps(s, d)), "practice_pace": _l(practice_pace), "training_weights": _r(training_weights), "standings_top": _r(standings),
    "isotonic_calibration": _r(calibration),
}

_Q = """, q0 as (select season, round, driver, min(lap_ms) filter (where sector = 1) as q1, min(lap_ms) filter (where sector = 2) as q2, min(lap_ms) filter (where sector = 3) as q3 from laps group by 1, 2, 3),
q as (select *, coalesce(q3, q2, q1) as best from q0 where coalesce(q3, q2, q1) is not null),
qual as (select *, round(best - min(best) over (partition by season, round), 2) as gap, row_number() over (partition by season, round order by best, driver) as place from q)"""
_ISLAND = "sum(case when {v} is not distinct from before and k > 1 then 0 else 1 end) over (partition by {p} order by k)"
ORACLE_SQL = {
    "stints_islands": sql(f""", l as (select *, lag(compound) over (partition by season, round, driver order by lap) as before, lap as k from laps),
i as (select *, {_ISLAND.format(v='compound', p='season, round, driver')} as stint from l)
select season, round, driver, cast(stint as bigint) as stint, min(compound) as compound, min(lap) as start_lap, max(lap) as end_lap, count(*) as laps from i group by 1, 2, 3, 4""", "laps"),
    "circuit_memory": sql(""", l as (select *, lag(compound) over (partition by season, round, driver order by lap) as before from laps),
i as (select *, sum(case when lap = 1 or compound is distinct from before then 1 else 0 end) over (partition by season, round, driver order by lap) as island from l),
u as (select season, round, driver, island, min(lap) as start, any_value(compound) as compound from i group by all),
n as (select season, round, driver, count(*) - 1 as stops, min(start - 1) filter (where island = 2) as first_stop, string_agg(compound, '-' order by island) as strategy from u group by 1, 2, 3),
x as (select *, grid - finish as gain from results left join n using (season, round, driver)),
y as (select x.*, m.middle, first_stop <= middle as early from x join (select round, median(first_stop) as middle from x group by 1) m using (round)),
g as (select round, count(distinct season) as races, avg(abs(gain)) as volatility, coalesce(avg(cast(finish <= 3 as int)) filter (where grid <= 3), 0.55) as front_hold,
 coalesce(avg(cast(abs(gain) >= 3 as int)) filter (where grid <= 10), 0.3) as shuffle, avg(cast(is_dnf as int)) as dnf, coalesce(avg(stops) filter (where first_stop is not null), 2) as stops,
 coalesce(avg(cast(stops = 1 as int)) filter (where first_stop is not null), 0.45) as one_stop, coalesce(max(middle), 20) as first_stop,
 coalesce(avg(gain) filter (where early), 0) - coalesce(avg(gain) filter (where not early), 0) as early_gain from y group by round),
k as (select round, strategy, count(*) as k from y where first_stop is not null group by 1, 2), q as (select *, k / sum(k) over (partition by round) as p from k),
e as (select round, first(strategy order by k desc, strategy) as common, -sum(p * ln(p)) as h, count(*) as kinds from q group by round)
select round, races, round(volatility, 3) as volatility, round(front_hold, 3) as front_hold, round(shuffle, 3) as shuffle, round(dnf, 3) as dnf, round(stops, 3) as stops, round(one_stop, 3) as one_stop,
 round(first_stop, 3) as first_stop, round(early_gain, 3) as early_gain, round(case when kinds > 1 then h / ln(kinds) else 0 end, 3) as entropy, coalesce(common, 'UNKNOWN') as common,
 case when early_gain >= 0.8 then 'undercut_friendly' when one_stop >= 0.58 and volatility <= 2.8 then 'track_position' when stops >= 1.7 then 'high_degradation' else 'balanced' end as archetype from g left join e using (round)""", "results", "laps"),
    "practice_pace": sql(""", m as (select season, round, driver, sector, cast(round(200 * median(lap_ms)) as bigint) as m from laps where sector <= 3 group by 1, 2, 3, 4),
b as (select *, [50, 35, 15][sector] as w from (select season, round, sector, min(m) as best from m group by 1, 2, 3)), t as (select season, round, sum(w) as total from b group by 1, 2),
s as (select season, round, driver, total, sum(least(m - best, 200000) * w) as loss from m join b using (season, round, sector) join t using (season, round) group by 1, 2, 3, 4)
select season, round, driver, -((2 * loss + total) // (2 * total)) / 1000000.0 as pace from s""", "laps"),
    "training_weights": sql(""", c as (select distinct season, round from results), m as (select season as s, round - 3 as k from c order by season desc, round desc limit 1)
select season, round, round(case when season < 1998 then cast(0.55 as double) else cast(2.25 as double) end * case when season > s or season = s and round >= k then 2 else 1 end, 4) as weight from c, m""", "results"),
    "standings_top": sql(""", l as (select * from results where season = (select max(season) from results)),
a as (select 'driver' as kind, driver as id, sum(points) as points, count(*) filter (where finish = 1) as wins from l group by 2 union all select 'team', team, sum(points), count(*) filter (where finish = 1) from l group by 2)
select kind, row_number() over (partition by kind order by points desc, wins desc, id) as place, id, points, wins from a qualify place <= 5""", "results"),
    "practice_agg": sql(""", c as (select season, round, driver, sector, compound, count(*) as n from laps where sector <= 3 group by all), t as (select season, round, driver, sector, list(compound order by n desc, compound)[1] as compound from c group by all),
f as (select season, round, driver, sector, min(lap_ms) as best, round(median(lap_ms), 3) as median, count(*) as laps from laps where sector <= 3 group by all) select * from f join t using (season, round, driver, sector)""", "laps"),
    "quali_gap": sql(_Q + " select * from qual", "laps"),
    "outlier_laps": sql(""", m as (select season, round, median(lap_ms) as middle from laps group by 1, 2) select season, round, count(*) as laps, floor((20 * sum(cast(round(lap_ms * 100) as bigint)) + count(*)) / (2 * count(*))) / 1000 as mean from laps join m using (season, round) where lap_ms <= cast(1.2 as double) * middle group by 1, 2""", "laps"),
    "lap_pace_clip": sql(""", x as (select * from laps where lap_ms between 5000 and 300000), b as (select season, round, min(lap_ms) as best from x group by 1, 2)
select season, round, driver, count(*) as laps, round(min(lap_ms), 2) as fastest from x join b using (season, round) where lap_ms <= cast(1.07 as double) * best group by 1, 2, 3""", "laps"),
    "sector_best": sql("select season, round, sector, min(lap_ms) as best, list(driver order by lap_ms, driver)[1] as owner from laps group by 1, 2, 3", "laps"),
    "overtakes": sql("select season, round, cast(sum(greatest(grid - finish, 0)) as bigint) as gained, max(grid - finish) as most, cast(sum(abs(grid - finish)) as bigint) as moved from results group by 1, 2", "results"),
    "tyre_quadratic_fit": sql(""", m as (select round, compound, avg(tyre_life) as c, avg(lap_ms) as m from laps group by 1, 2), z as (select round, compound, tyre_life - c as x, lap_ms - m as y from laps join m using (round, compound)),
s as (select round, compound, count(*) as n, sum(x * x) as x2, sum(x * x * x) as x3, sum(x * x * x * x) as x4, sum(x * y) as xy, sum(x * x * y) as x2y from z group by 1, 2)
select round, compound, n, round((x2y * x2 - x3 * xy) / nullif((x4 - x2 * x2 / n) * x2 - x3 * x3, 0), 3) as quad from s where n >= 15""", "laps"),
    "constructor_strength": sql(""", p as (select team, season, count(*) as n, avg(points) as mean from results group by 1, 2), w as (select *, least(n / 20, 1) * case when season < 1995 then cast(0.6 as double) else 1 end as w from p)
select team, round(sum(w * mean) / sum(w), 4) as strength, cast(sum(n) as bigint) as races from w group by team""", "results"),
    "circuit_profile": sql(""", p as (select round, avg(cast(is_dnf as int)) as r, avg(abs(grid - finish)) as moves, avg(case when finish = 1 then cast(grid <= 3 as int) end) as f from results group by 1)
select round, round(r, 4) as dnf_rate, round(moves, 4) as moves, round(f, 4) as front_hold, case when r > 0 then round(58 / pow(-ln(greatest(1 - r, 0.01)), 1 / 0.8), 3) end as dnf_scale from p""", "results"),
    "feature_matrix": sql(""", t as (select team, season, round, sum(points) as p, count(*) as k from results group by 1, 2, 3),
tf as (select team, season, round, round(cast(sum(p) over w as double) / sum(k) over w, 4) as team_form from t window w as (partition by team order by season, round rows between 10 preceding and 1 preceding))
select season, round, driver, team, finish, round(avg(finish) over (partition by driver order by season, round rows between 3 preceding and 1 preceding), 4) as form3,
 round(avg(finish) over (partition by driver, round order by season rows between unbounded preceding and 1 preceding), 4) as circuit_affinity,
 round(avg(grid - finish) over w * (cast(count(*) over w as double) / (count(*) over w + 8)), 4) as grid_delta, team_form from results left join tf using (team, season, round)
 window w as (partition by driver order by season, round rows between unbounded preceding and 1 preceding)""", "results"),
    "championship_projection": sql(""", l as (select * from results where season = (select max(season) from results))
select driver, arg_max(team, round) as team, cast(sum(points) as bigint) as points, round(sum(points) + cast(sum(points) as double) / count(*) * greatest(12 - (select max(round) from l), 0), 3) as projected from l group by driver""", "results"),
    "prior_softmax": sql(""", f as (select *, avg(points) over (partition by driver order by season, round rows between 3 preceding and 1 preceding) as form from results),
n as (select * from f where (season, round) = (select (season, round) from results order by season desc, round desc limit 1)), e as (select driver, exp((coalesce(form, 0) * 0.6 + 10.0 / grid * 0.4) / 3) as e from n)
select driver, round(e / sum(e) over (), 6) as win from e""", "results"),
    "prediction_scoring": sql("""select season, round, round(avg(abs(grid - finish)), 4) as mae, count(*) filter (where grid = 1 and finish = 1) = 1 as winner, count(*) filter (where grid <= 3 and finish <= 3) as podium,
 count(*) filter (where grid <= 5 and finish <= 5) as top5, round(avg(pow(1.0 / grid - cast(finish = 1 as int), 2)), 6) as brier from results group by 1, 2""", "results"),
    "model_version_pick": sql(""", p as (select season, round, case driver % 3 when 0 then 'prod_' when 1 then 'test_' else 'dev_' end || team as model, max(driver) as newest from results group by 1, 2, 3)
select season, round, list(model order by case when starts_with(model, 'prod_') then 0 else 1 end, newest desc, model)[1] as model from p group by 1, 2""", "results"),
    "team_weekend_report": sql(_Q + """, f as (select team, season, round, min(finish) as finished, cast(sum(points) as bigint) as points from results group by all),
p as (select team, season, round, min(lap_ms) as practice from laps join results using (season, round, driver) where sector <= 3 group by all), g as (select team, season, round, min(place) as qualified from qual join results using (season, round, driver) group by all)
select * from f left join p using (team, season, round) left join g using (team, season, round)""", "results", "laps"),
    "completeness_check": sql("select season, round, count(*) as drivers, count(*) >= 10 as complete from results group by 1, 2", "results"),
    "sessions_with_counts": sql(""", n as (select season, round, count(*) as laps, count(distinct compound) as compounds from laps group by 1, 2), r as (select season, round, count(*) as drivers, cast(sum(points) as bigint) as points from results group by 1, 2)
select * from r left join n using (season, round)""", "results", "laps"),
    "asof_position": """with v as (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2), p as (select * from events where event_type = 'purchase')
select p.event_id, p.user_id, round(v.value, 4) as view_value from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""",
    "nearest_weather": """with c as (select user_id, epoch_us(ts) as t, max(value) as v from events where event_type = 'click' group by 1, 2), e as (select event_id, user_id, epoch_us(ts) as t from events where event_type = 'error')
select event_id, round(list(v order by abs(e.t - c.t), c.t)[1], 4) as value from e left join c using (user_id) group by event_id""",
    "status_ranges": f"""with e as (select *, row_number() over w as k, lag(event_type) over w as before from events window w as (partition by user_id order by ts, event_id)), i as (select *, {_ISLAND.format(v='event_type', p='user_id')} as run from e)
select user_id, cast(run as bigint) as run, min(event_type) as status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as from_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as to_ts, count(*) as n from i group by 1, 2""",
    "telemetry_resample": sql(""", p as (select season, round, driver, lap, cast(sum(cast(lap_ms as decimal(18,2))) over (partition by season, round, driver order by lap) as double) as far from laps),
g as (select *, max(far) over (partition by season, round, driver) as total, count(*) over (partition by season, round, driver) as points from p), f as (select unnest(range(0, 9)) as frame)
select season, round, driver, list(lap order by abs(far - frame * (total / 8)), lap)[1] as lap, frame from g, f where points >= 5 group by season, round, driver, frame""", "laps"),
}
