"""Forecasts: models against closed forms and held-out seasons, simulations against their rules, smoothing against a plain loop."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.plans import entry, forecast
from gridstone.sources.tables import laps, results

SF = "/root/testdata/sf0.001"
CAR = "driver long, place int, behind double, pace_ms double, reliability double, compound string, age int, stops int, out boolean, done int"


def test_ridge_is_the_closed_form(spark):
    r = results(spark, SF)
    train, test = (x.orderBy("season", "round", "driver").toPandas() for x in forecast._prepared(r))
    assert train["season"].max() < test["season"].min()  # no row is both trained on and predicted
    x, z = (np.array([v.toArray() for v in rows["features"]]) for rows in (train, test))
    w, y = train["weight"].to_numpy(), train["finish"].to_numpy()
    spread = x.std(axis=0, ddof=1)
    spread[spread == 0] = 1
    x, z = (x - x.mean(axis=0)) / spread, (z - train["features"].map(lambda v: v.toArray()).mean()) / spread
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - mx, y - my
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + 50.0 * np.eye(x.shape[1]), (xc * w[:, None]).T @ yc)
    plain = np.clip(my + (z - mx) @ beta, 1, test.groupby(["season", "round"])["finish"].transform("max").to_numpy())
    got = forecast.ridge(r).orderBy("season", "round", "driver").toPandas()["predicted"].to_numpy()
    assert got == pytest.approx(plain, abs=2e-4)


@pytest.mark.parametrize("model", [lambda r: forecast.forest(r, trees=20), lambda r: forecast.boosted(r, rounds=5), forecast.ridge])
def test_models_beat_the_middle_of_the_field(spark, model):
    r = results(spark, SF)
    last = r.join(model(r), ["season", "round", "driver"])
    middle = F.avg("finish").over(__import__("pyspark").sql.Window.partitionBy("season", "round"))
    error, blind, n, low = last.withColumn("m", middle).agg(F.avg(F.abs(F.col("predicted") - F.col("finish"))), F.avg(F.abs(F.col("m") - F.col("finish"))), F.count("*"), F.min("predicted")).first()
    assert n == r.where(F.col("season") == r.agg(F.max("season")).first()[0]).count() and low >= 1 and error < blind


def test_trees_are_fitted_some_at_a_time(spark, monkeypatch):
    """No fit grows more trees than a row can carry numbers for; what the forest says is the mean of all its trees; rows are prepared once for all models."""
    from pyspark.ml.feature import Imputer
    from pyspark.ml.regression import RandomForestRegressor

    fits, prepared, fit, impute = [], [], RandomForestRegressor.fit, Imputer.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows: fits.append(fit(self, rows)) or fits[-1])
    monkeypatch.setattr(Imputer, "fit", lambda self, rows: prepared.append(1) or impute(self, rows))
    r = results(spark, SF)
    got = {(x["round"], x.driver): x.predicted for x in forecast.forest(r, trees=21, depth=3).collect()}
    assert [m.getNumTrees for m in fits] == [11, 10]
    trees = [t for m in fits for t in m.trees]
    assert len(trees) == 21 and len({t.toDebugString.split("\n", 1)[1] for t in trees}) > 15  # draws differ between fits
    test = forecast._prepared(r)[1].where("round = 5").collect()
    field = max(x.finish for x in test)
    for x in test[:5]:
        assert got[5, x.driver] == pytest.approx(min(max(np.mean([t.predict(x.features) for t in trees]), 1), field), abs=1e-4)
    prepared.clear()
    fits.clear()
    forecast.by_models(forecast.stored(forecast.model_features(r)), forecast.FEATURES)
    assert len(prepared) == 1 and sum(m.getNumTrees for m in fits) == 200 and max(m.getNumTrees for m in fits) <= forecast.TREES_A_FIT


def test_models_without_earlier_seasons_give_the_grid(spark):
    r = results(spark, SF).where("season = 1996")
    for model in (forecast.ridge, forecast.forest, forecast.boosted):
        got = r.join(model(r), ["season", "round", "driver"]).collect()
        assert len(got) == r.count() and all(x.predicted == min(x.grid, max(y.finish for y in got if y["round"] == x["round"])) for x in got)


def test_simulation_follows_its_rules(spark):
    cars = [(k, k, 0.2 * k, 100.0 * k, 1.0, "MEDIUM", 0, 0, False, 0) for k in range(1, 21)]
    cars[11] = (12, 12, 2.4, -3000.0, 1.0, "MEDIUM", 0, 0, False, 0)  # much the fastest, from the twelfth place
    state = spark.createDataFrame(cars, CAR)
    sim = {x.driver: x for x in forecast.simulate_from(state, 60).collect()}
    assert len(sim) == 20 and sum(x.win for x in sim.values()) == pytest.approx(1) and sum(x.podium for x in sim.values()) == pytest.approx(3)
    assert max(sim.values(), key=lambda x: x.win).driver == 12 and sim[2].points > sim[19].points
    again = {x.driver: x for x in forecast.simulate_from(state.repartition(7), 60).collect()}
    assert sim == again


def test_live_simulation_keeps_what_has_happened(spark):
    cars = [(k, k, 1.0 * k, 100.0, 1.0, "HARD", 5, 1, k == 4, 58) for k in range(1, 7)]
    sim = {x.driver: x["median"] for x in forecast.simulate_from(spark.createDataFrame(cars, CAR), 5).collect()}
    assert sim == {1: 1, 2: 2, 3: 3, 5: 4, 6: 5, 4: 6}  # no lap is left; who is out is last
    cars = [(*c[:9], 30) for c in cars]
    assert next(x for x in forecast.simulate_from(spark.createDataFrame(cars, CAR), 40).collect() if x.driver == 4).win == 0
    r = results(spark, SF)
    field = forecast.starters(r).count()
    sim = forecast.live_simulation(r, laps(spark, SF), 20).collect()
    assert len(sim) == field and sum(x.win for x in sim) == pytest.approx(1)


def test_smoothing_is_the_plain_pass(spark):
    p = entry.blend(results(spark, SF))
    got = forecast.smoothed(p).toPandas()
    for race, field in p.toPandas().groupby(["season", "round"]):
        field = field.sort_values("predicted_position")
        win = field["win_probability"].tolist()
        for i in range(1, len(win)):
            if win[i] > win[i - 1]:
                m = (win[i] + win[i - 1]) / 2
                win[i - 1], win[i] = round(m + 0.001, 4), round(m - 0.001, 4)
        total = sum(win)
        mine = got[(got["season"] == race[0]) & (got["round"] == race[1])].sort_values("predicted_position")
        assert mine["driver"].tolist() == field["driver"].tolist()
        assert mine["win_probability"].to_numpy() == pytest.approx([w / total for w in win], abs=6e-5)
