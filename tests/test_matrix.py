"""The training matrix looks only back, and its models beat the middle of the field."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.plans import matrix
from gridstone.plans.bulletin import sprint_results
from gridstone.sources.tables import laps, results

SF = "/root/testdata/sf0.001"


def test_later_races_change_nothing(spark):
    """Features of the first seasons are the same whether later seasons are there or not; only what a race itself shows may differ with it."""
    r, lap = results(spark, SF), laps(spark, SF)
    early = F.col("season") <= 1996
    whole = matrix.training_matrix(r, lap, sprint_results(r)).where(early)
    cut = matrix.training_matrix(r.where(early), lap.where(early), sprint_results(r.where(early)))
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr)
    first = whole.where("season = 1995 and round = 1").collect()
    assert first and all((x.form, x.form_dnf, x.sprint3, x.rating, x.team_strength, x.volatility) == (10.5, 0.12, 0, 1400.0, 10.5, 3.0) for x in first)
    assert set(matrix.KNOWN) <= set(whole.columns) and not any(c.startswith("race_") for c in matrix.KNOWN)


def test_empty_tables_and_starters_without_laps(spark):
    r, lap = results(spark, SF), laps(spark, SF)
    assert matrix.training_matrix(r.limit(0), lap.limit(0), sprint_results(r.limit(0))).count() == 0
    bare = matrix.training_matrix(r, lap.limit(0), sprint_results(r)).collect()
    assert len(bare) == r.count() and all(x.gap_ms is None and x.race_pits is None and x.one_stop == 0.45 for x in bare)


def test_models_on_the_matrix(spark):
    r, lap = results(spark, SF), laps(spark, SF)
    got = matrix.matrix_forecast(r, lap, sprint_results(r)).join(r.select("season", "round", "driver", "finish"), ["season", "round", "driver"]).toPandas()
    field = got.groupby(["season", "round"])["finish"].transform("max")
    middle = ((field + 1) / 2 - got["finish"]).abs().mean()
    assert len(got) == r.where(F.col("season") == r.agg(F.max("season")).first()[0]).count()
    for name in ("ridge", "forest", "boosted"):
        assert (got[name] - got["finish"]).abs().mean() < middle
        assert ((got[name] >= 1) & (got[name] <= field)).all()
