"""Race forecasts: features known before a race, models trained on earlier seasons, simulation from the grid or from any lap, smoothing of chances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.operators.relational import previous_mean, stored
from gridstone.plans.entry import blend
from gridstone.sources.tables import POINTS, laps, results_once, sql

SESSION = ["season", "round"]
RUN = ["season", "round", "driver"]
FEATURES = ("grid", "form3", "form10", "circuit_form", "grid_gain", "team_form", "points_before", "retired_share", "trend", "starts")

# Loss per lap of tyre life in ms and longest life by compound; what follows a compound at a stop, with many or few laps left.
TYRES = {"SOFT": (120, 25), "MEDIUM": (70, 38), "HARD": (35, 55)}
NEXT_MANY, NEXT_FEW = {"SOFT": "MEDIUM", "MEDIUM": "HARD", "HARD": "MEDIUM"}, {"SOFT": "MEDIUM", "MEDIUM": "SOFT", "HARD": "MEDIUM"}
# Wear by place (up to 3, 5, 10, 15, beyond), overtaking by place (up to 3, 8, 15, beyond), risk on the first lap by grid (up to 3, 10, beyond).
WEAR = ((3, 0.92), (5, 0.96), (10, 1.00), (15, 1.04), (None, 1.08))
PASSING = ((3, 0.4), (8, 0.7), (15, 1.0), (None, 1.4))
FIRST_LAP_RISK = ((3, 0.01), (10, 0.03), (None, 0.06))
# Seconds lost in the pit lane, most places gained, fuel in ms a lap, shape and scale of retirements, chance of a safety car in a race, most of them.
PIT_LOSS, MOST_GAIN, FUEL_MS, SHAPE, SCALE, SAFETY_CAR, MOST_SAFETY_CARS = 21.0, 12, 28, 0.8, 60.0, 0.35, 3
RACE_LAPS = 58
#: Simulated races a task takes on, about.
RUNS_A_TASK = 32
#: Trees of a forest fitted at once, at most: a row carries a number for each while they grow, and their bins should not outgrow a core's cache.
TREES_A_FIT = 20


def model_features(r: DataFrame) -> DataFrame:
    """What is known of each starter before its race, but for its place on the grid: nothing of the race itself or of later ones.

    Nulls where there is no earlier race. The finishing place stands beside as the label.
    """
    own = W.partitionBy("driver").orderBy(*SESSION).rowsBetween(W.unboundedPreceding, -1)
    season = W.partitionBy("driver", "season").orderBy("round").rowsBetween(W.unboundedPreceding, -1)
    team = r.groupBy("team", *SESSION).agg(F.avg("points").alias("team_points"))
    team = team.select("team", *SESSION, F.round(previous_mean("team_points", ["team"], SESSION, 5), 4).alias("team_form"))
    form = lambda n: previous_mean("finish", ["driver"], SESSION, n)
    rows = r.select(
        *RUN, "team", "finish", "grid",
        F.round(form(3), 4).alias("form3"), F.round(form(10), 4).alias("form10"),
        F.round(previous_mean("finish", ["driver", "round"], SESSION), 4).alias("circuit_form"),
        F.round(F.avg(F.col("grid") - F.col("finish")).over(own), 4).alias("grid_gain"),
        F.coalesce(F.sum("points").over(season), F.lit(0)).cast("bigint").alias("points_before"),
        F.round(F.avg(F.col("is_dnf").cast("int")).over(own), 4).alias("retired_share"),
        F.count("*").over(own).alias("starts"),
    )
    return rows.join(team, ["team", *SESSION], "left").select(*RUN, "team", "finish", "grid", "form3", "form10", "circuit_form", "grid_gain", "team_form", "points_before", "retired_share", F.round(F.col("form3") - F.col("form10"), 4).alias("trend"), "starts")


def _prepared(r: DataFrame, features: DataFrame | None = None, names: Sequence[str] = FEATURES, older: float = 0.55, newer: float = 2.25, latest: float = 2.0, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: earlier seasons and the last one, with medians of the training rows for nulls and a weight of each training race.

    features has names, `finish` and the race of each starter, stored; model_features(r) where it is not given. Both are
    stored with their vectors, which every pass of a fit reads.
    """
    from pyspark.ml.feature import Imputer, VectorAssembler

    f = (stored(model_features(r)) if features is None else features).withColumns({c: F.col(c).cast("double") for c in (*names, "finish")})
    last = f.agg(F.max("season").alias("last"))  # one row
    f = f.crossJoin(F.broadcast(last))
    train, test = f.where("season < last"), f.where("season = last").drop("last")
    newest = train.agg(F.max(F.struct(*SESSION)).alias("m")).select(F.col("m.season").alias("s"), (F.col("m.round") - rounds).alias("k"))  # one row
    weight = F.when(F.col("season") < F.col("s"), older).otherwise(newer) * F.when(F.struct("season", "round") >= F.struct("s", "k"), latest).otherwise(1.0)
    train = train.crossJoin(F.broadcast(newest)).withColumn("weight", weight).drop("last", "s", "k")
    names = list(names)
    if not train.isEmpty():
        medians = Imputer(strategy="median", inputCols=names, outputCols=names).fit(train)
        train, test = medians.transform(train), medians.transform(test)
    vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return stored(vectors.transform(train).select(*RUN, "finish", "weight", "features")), stored(vectors.transform(test).select(*RUN, "grid", "finish", "features"))


def _clipped(p: DataFrame) -> DataFrame:
    n = F.max("finish").over(W.partitionBy(*SESSION))
    return p.select(*RUN, F.round(F.least(F.greatest("prediction", F.lit(1.0)), n), 4).alias("predicted"))


def _ridge(train: DataFrame, test: DataFrame, alpha: float = 50.0) -> DataFrame:
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression

    w, y = F.col("weight"), F.col("finish")
    total, mean, square = train.agg(F.sum(w), F.sum(w * y) / F.sum(w), F.sum(w * y * y) / F.sum(w)).first()
    if not total or square <= mean * mean:
        return _clipped(test.withColumn("prediction", F.col("grid")))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
    # the solver divides the label by its deviation, so the penalty is multiplied with it
    penalty = alpha / total * float(np.sqrt(square - mean * mean))
    model = LinearRegression(featuresCol="scaled", labelCol="finish", weightCol="weight", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal").fit(scaler.transform(train))
    return _clipped(model.transform(scaler.transform(test)))


def _forest(train: DataFrame, test: DataFrame, trees: int = 200, depth: int = 6, leaf: int = 10) -> DataFrame:
    """Trees are fitted some at a time, each fit with draws of its own; a forest is the mean of its trees, however they are grouped."""
    from pyspark.ml.regression import RandomForestRegressor

    if train.isEmpty():
        return _clipped(test.withColumn("prediction", F.col("grid")))
    fits = -(-trees // TREES_A_FIT)
    sizes = [trees // fits + (k < trees % fits) for k in range(fits)]  # even: a fit of one tree alone would draw neither rows nor features
    for k, n in enumerate(sizes):
        model = RandomForestRegressor(labelCol="finish", weightCol="weight", predictionCol=f"mean_{k}", numTrees=n, maxDepth=depth, minInstancesPerNode=leaf, seed=7 + 1_000_000 * k).fit(train)
        test = model.transform(test)
    return _clipped(test.withColumn("prediction", sum((n * F.col(f"mean_{k}") for k, n in enumerate(sizes)), F.lit(0.0)) / trees))


def _boosted(train: DataFrame, test: DataFrame, least_races: int = 8, rounds: int = 30, depth: int = 3) -> DataFrame:
    from pyspark.ml.regression import GBTRegressor

    races = train.select(*SESSION).distinct().groupBy("season").count().agg(F.max_by("count", "season")).first()[0]
    if not races or races < least_races:
        return _forest(train, test)
    model = GBTRegressor(labelCol="finish", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=7).fit(train)
    return _clipped(model.transform(test))


def ridge(r: DataFrame, alpha: float = 50.0, features: DataFrame | None = None, names: Sequence[str] = FEATURES) -> DataFrame:
    """Finishing places of the last season by weighted ridge regression on the seasons before, clipped to the field; the grid where there are none."""
    return _ridge(*_prepared(r, features, names), alpha)


def forest(r: DataFrame, trees: int = 200, depth: int = 6, leaf: int = 10, features: DataFrame | None = None, names: Sequence[str] = FEATURES) -> DataFrame:
    """As `ridge`, by a random forest."""
    return _forest(*_prepared(r, features, names), trees, depth, leaf)


def boosted(r: DataFrame, least_races: int = 8, rounds: int = 30, depth: int = 3, features: DataFrame | None = None, names: Sequence[str] = FEATURES) -> DataFrame:
    """As `ridge`, by boosted trees; by the forest where the newest training season has too few races for them."""
    return _boosted(*_prepared(r, features, names), least_races, rounds, depth)


def by_models(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Places of the last season by all three on the same rows, prepared once: season, round, driver, ridge, forest, boosted."""
    rows = _prepared(features, features, names)
    out = None
    for name, model in (("ridge", _ridge), ("forest", _forest), ("boosted", _boosted)):
        one = model(*rows).withColumnRenamed("predicted", name)
        out = one if out is None else out.join(one, RUN)
    return out


def _steps(place: np.ndarray, table) -> np.ndarray:
    edges = [edge for edge, _ in table[:-1]]
    return np.array([value for _, value in table])[np.searchsorted(edges, place)]


def _drive(field: pd.DataFrame, seed: int, race_laps: int) -> np.ndarray:
    """Places of one simulated race. Cars are arrays, laps are steps; a car's state is its time, tyre, wear and stops."""
    n, done = len(field), int(field["done"].iloc[0])
    rng = np.random.default_rng(seed)
    start = field["place"].to_numpy(float)
    time, tyre, age = field["behind"].to_numpy(float).copy(), field["compound"].to_numpy(object).copy(), field["age"].to_numpy(float).copy()
    stops, out = field["stops"].to_numpy(int).copy(), np.where(field["out"], 0.0, np.inf)  # lap of retirement
    pace = field["pace_ms"].to_numpy(float) + rng.normal(0, 200, n)
    scale = SCALE * field["reliability"].to_numpy(float)
    if done == 0:
        hit = rng.random(n) < _steps(start, FIRST_LAP_RISK)
        out[hit & (rng.random(n) < 0.3) & np.isinf(out)] = 1
        time[hit] += rng.uniform(2, 6, n)[hit]
    slow, seen = 0, 0
    for lap in range(done + 1, race_laps + 1):
        running = np.isinf(out)
        if not running.any():
            break
        noise, luck, fate, limit = rng.normal(0, 60, n), rng.random(n), rng.random(n), rng.normal(0.82, 0.08, n)
        safety, length = rng.random(), int(rng.integers(3, 8))
        if slow == 0 and seen < MOST_SAFETY_CARS and safety < SAFETY_CAR / race_laps:
            slow, seen = length, seen + 1
        fails = running & (fate < np.exp(-(((lap - 1) / scale) ** SHAPE)) - np.exp(-((lap / scale) ** SHAPE)))
        out[fails] = lap
        running &= ~fails
        order = np.lexsort((start, np.where(running, time, np.inf)))
        place = np.empty(n)
        place[order] = np.arange(1, n + 1)
        age += 1
        worn = age * _steps(place, WEAR)
        loss, life = (np.array([TYRES.get(x, TYRES["MEDIUM"])[k] for x in tyre], dtype=float) for k in (0, 1))
        left = race_laps - lap
        pits = running & ((worn >= life * limit) & (stops < 2) & (left > 8) & (slow == 0) | (worn > 1.15 * life) & (left > 3))
        lap_ms = pace + loss * worn - FUEL_MS * left + noise
        if slow:
            ahead = time[running].min()
            time = np.where(running, ahead + (time - ahead) * 0.5, time)
            lap_ms = np.zeros(n)
            slow -= 1
        fresh = time + lap_ms / 1000 + np.where(pits, PIT_LOSS + rng.normal(0, 0.3, n), 0)
        # who may not pass stays behind the cars before it, but for those in the pits
        held = running & ~pits & ((luck >= 0.5 * _steps(place, PASSING)) | (slow > 0))
        front = np.where(running & ~pits, fresh, -np.inf)[order]
        before = np.concatenate([[-np.inf], np.maximum.accumulate(front)[:-1]])
        kept = fresh[order]
        kept = np.where(held[order], np.maximum(kept, before + 0.2), kept)
        time[order] = kept
        for k in np.flatnonzero(pits):
            tyre[k] = (NEXT_MANY if left > 20 else NEXT_FEW).get(tyre[k], "MEDIUM")
        age[pits] = 0
        stops += pits
    home = np.isinf(out)
    order = np.lexsort((start, np.where(home, time, -out), ~home))  # finishers by time, then the others, the latest to retire first
    place = np.empty(n)
    place[order] = np.arange(1, n + 1)
    place = np.where(home, np.maximum(place, start - MOST_GAIN), place)
    order = np.lexsort((np.where(home, time, -out), place, ~home))
    final = np.empty(n, dtype=np.int64)
    final[order] = np.arange(1, n + 1)
    return final


def simulate_from(state: DataFrame, runs: int = 500, seed: int = 11, race_laps: int = RACE_LAPS) -> DataFrame:
    """Chances of winning and of the podium, mean points and median place of every car over simulated races from a state on.

    state has a row per car of one race: driver, place, behind (seconds after the leader), pace_ms, reliability,
    compound, age, stops, out, done (laps behind them, the same in all rows). Each run is a group of its own,
    holding one field, with a generator of its own seed, so that any split gives the same result; a lost run is simulated again alike.
    """

    def one(key: tuple, cars: pd.DataFrame) -> pd.DataFrame:
        cars = cars.sort_values(["place", "driver"]).reset_index(drop=True)
        return pd.DataFrame({"run": key[0], "driver": cars["driver"], "place": _drive(cars, seed + key[0], race_laps)})

    dealt = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    dealt = dealt.repartition(max(runs // RUNS_A_TASK, 1), "run")  # few bytes but much work: not to be coalesced by size
    places = dealt.groupBy("run").applyInPandas(one, "run int, driver long, place long")
    points = F.create_map(*[F.lit(x) for k, p in enumerate(POINTS, 1) for x in (k, p)])
    earned = F.coalesce(F.try_element_at(points, F.col("place").cast("int")), F.lit(0))
    share = lambda k: F.avg((F.col("place") <= k).cast("int"))
    return places.groupBy("driver").agg(share(1).alias("win"), share(3).alias("podium"), F.avg(earned).alias("points"), F.median("place").alias("median"))


def starters(r: DataFrame) -> DataFrame:
    """The newest race's field before its start: pace from form and grid, reliability from earlier retirements."""
    newest = r.agg(F.max(F.struct(*SESSION)).alias("m")).select("m.*")  # one row
    f = model_features(r).join(F.broadcast(newest), SESSION)
    pace = 40.0 * F.col("grid") + 30.0 * F.coalesce("form10", F.col("grid").cast("double")) + 20.0 * F.coalesce("trend", F.lit(0.0))
    compound = F.element_at(F.array(*[F.lit(x) for x in TYRES]), (F.col("driver") % 3 + 1).cast("int"))
    return f.select(
        "driver", F.col("grid").alias("place"), ((F.col("grid") - 1) * 0.2).alias("behind"), pace.alias("pace_ms"),
        (1.5 - F.coalesce("retired_share", F.lit(0.5))).alias("reliability"), compound.alias("compound"), F.lit(0).alias("age"), F.lit(0).alias("stops"), F.lit(False).alias("out"), F.lit(0).alias("done"),
    )


def live_state(field: DataFrame, lap: DataFrame, done: int = 30) -> DataFrame:
    """A field's state after some laps of its race: latest tyre, its age and the stops seen; cars without a lap are out.

    lap has driver, lap, compound, sector (7: a stop) of that one race; its latest row up to `done` counts, whatever order rows come in.
    """
    seen = lap.where(F.col("lap") <= done).groupBy("driver").agg(
        F.max("lap").alias("at"), F.count_if(F.col("sector") == 7).alias("seen_stops"), F.max_by("tyre_life", "lap").alias("life"),
        F.element_at(F.array(*[F.lit(x) for x in TYRES]), (F.ascii(F.max_by("compound", "lap")) % 3 + 1).cast("int")).alias("tyre"), F.sum(F.col("lap_ms") % 1000).alias("spent"),
    )
    met = field.join(seen, "driver", "left")
    w = W.partitionBy()  # one race's field
    order = F.row_number().over(w.orderBy(F.col("at").isNull(), F.desc("at"), "spent", "driver"))
    return met.select(
        "driver", order.alias("place"), (0.8 * (order - 1)).alias("behind"), "pace_ms", "reliability", F.coalesce("tyre", "compound").alias("compound"),
        F.coalesce(F.least("life", F.lit(float(done))), F.lit(0.0)).alias("age"), F.least(F.coalesce("seen_stops", F.lit(0)), F.lit(2)).cast("int").alias("stops"), F.col("at").isNull().alias("out"), F.lit(done).alias("done"),
    )


def live_simulation(r: DataFrame, lap: DataFrame, runs: int = 500) -> DataFrame:
    """The newest race simulated on from its thirtieth lap."""
    newest = r.agg(F.max(F.struct(*SESSION)).alias("m")).select("m.*")  # one row
    return simulate_from(live_state(starters(r), lap.join(F.broadcast(newest), SESSION)), runs)


def smoothed(p: DataFrame) -> DataFrame:
    """Chances of every race made to fall along its predicted order: a rise between neighbours is split between them, from the front on once; win chances sum to one again.

    A race is a group: the pass is sequential within its field.
    """

    def fall(values: pd.Series, slack: float) -> np.ndarray:
        v = values.tolist()  # Python's floats round ties by their exact value
        for i in range(1, len(v)):
            if v[i] > v[i - 1] * slack:
                middle = (v[i] + v[i - 1]) / 2
                v[i - 1], v[i] = round(middle + 0.001, 4), round(middle - 0.001, 4)
        return np.array(v)

    def one(field: pd.DataFrame) -> pd.DataFrame:
        field = field.sort_values("predicted_position").reset_index(drop=True)
        win, podium = fall(field["win_probability"], 1.0), fall(field["podium_probability"], 1.05)
        total = win.sum()
        field["win_probability"], field["podium_probability"] = np.round(win / total, 4) if total > 0 else win, podium
        return field

    rows = p.select(*RUN, "win_probability", "podium_probability", "predicted_position")
    return rows.groupBy(*SESSION).applyInPandas(one, rows.schema)


def _r(f):
    return lambda s, d: f(results_once(s, d))


QUERIES = {
    "model_features": _r(model_features),
    "ridge_predict": _r(ridge),
    "forest_predict": _r(forest),
    "boosted_predict": _r(boosted),
    "monte_carlo": _r(lambda r: simulate_from(starters(r))),
    "live_simulation": lambda s, d: live_simulation(results_once(s, d), laps(s, d)),
    "prediction_smoothed": _r(lambda r: smoothed(blend(r))),
}
ORACLE_SQL = {
    "model_features": sql(""", t as (select team, season, round, avg(points) as tp from results group by 1, 2, 3),
tf as (select team, season, round, round(avg(tp) over (partition by team order by season, round rows between 5 preceding and 1 preceding), 4) as team_form from t),
f as (select *, round(avg(finish) over (partition by driver order by season, round rows between 3 preceding and 1 preceding), 4) as form3,
 round(avg(finish) over (partition by driver order by season, round rows between 10 preceding and 1 preceding), 4) as form10,
 round(avg(finish) over (partition by driver, round order by season rows between unbounded preceding and 1 preceding), 4) as circuit_form,
 round(avg(grid - finish) over own, 4) as grid_gain, cast(coalesce(sum(points) over (partition by driver, season order by round rows between unbounded preceding and 1 preceding), 0) as bigint) as points_before,
 round(avg(cast(is_dnf as int)) over own, 4) as retired_share, count(*) over own as starts
 from results window own as (partition by driver order by season, round rows between unbounded preceding and 1 preceding))
select f.season, f.round, driver, f.team, finish, grid, form3, form10, circuit_form, grid_gain, team_form, points_before, retired_share, round(form3 - form10, 4) as trend, starts
from f left join tf on f.team = tf.team and f.season = tf.season and f.round = tf.round""", "results"),
}
