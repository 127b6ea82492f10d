"""Queries that read derived tables several times work them out once."""

from __future__ import annotations

import pytest

from gridstone.plans import catalog
from gridstone.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["elo_ratings", "sprint_ratings", "model_features", "grid_overrides", "circuit_memory", "isotonic_calibration"])
def test_tables_are_not_read_again(spark, name):
    """What is left of the plan starts from what was stored, not from line items."""
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize(("name", "most"), [("training_matrix", 4), ("team_weekend_report", 2), ("summary_figures", 2)])
def test_line_items_are_joined_few_times(spark, name, most):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey#") and sum("Relation [l_orderkey" in line for line in plan.splitlines()) <= most


def test_calibration_by_places(spark):
    """Places with their shares and numbers give what all rows give."""
    from pyspark.ml.regression import IsotonicRegression
    from pyspark.sql import functions as F

    from gridstone.plans.racing import calibration

    r = tables.results(spark, SF)
    rows = r.select("grid", F.col("grid").cast("double").alias("x"), (F.col("finish") == 1).cast("double").alias("won"))
    model = IsotonicRegression(featuresCol="x", labelCol="won", isotonic=False).fit(rows)
    want = {x["grid"]: round(x["prediction"], 6) for x in model.transform(rows.select("grid", "x").distinct()).collect()}
    got = {x["grid"]: x["win"] for x in calibration(r).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 for k in want)
