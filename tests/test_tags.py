"""Regulatory rules by their pieces against the rules alone."""

from __future__ import annotations

import re

from gridstone.plans import catalog
from gridstone.plans.ingest import PIECES, RULES, regex_tags

# A text for every alternative of every rule, and near ones.
SAID = (
    "investigate", "investigated", "investigation", "investigating", "under review", "summoned", "steward", "Stewards!", "stewardship", "penalty", "penalties", "grid drop", "time penalty", "reprimand", "disqualify", "disqualified", "disqualification",
    "technical directive", "TD12", "td  7", "td", "scrutineer", "illegal car", "technical regulation", "cost cap", "financial regulation", "budget cap", "overspend", "overspending", "safety regulation", "medical car", "red flag", "unsafe release", "safety car procedure",
    "super license", "super licence", "penalty points", "license points", "licence points", "licensed", "sporting regulation", "race control", "fia rule", "rules breach", "parc ferme", "Parc Fermé", "power unit allocation", "engine penalty", "power unit penalty", "quiet day", "",
)


def test_pieces_leave_no_rule_out(spark):
    assert set(PIECES) == {t for t, *_ in RULES}
    texts = [f"so {x}, they say" for x in SAID] + list(SAID)
    rows = [(k, *((x, "a b") if k % 3 else ("a b", x) if k % 2 else (x, None))) for k, x in enumerate(texts)] + [(1000, None, None)]
    table = spark.createDataFrame(rows, "guid long, title string, summary string").selectExpr("*", "timestamp_ntz '2024-01-30 00:00:00' as published_at")
    got = sorted((r.guid, r.tag, r.confidence) for r in regex_tags(table).collect())
    said = {k: " ".join(x for x in both if x is not None).lower() for k, *both in rows}
    want = sorted((k, t, c) for k, x in said.items() for t, p, c in RULES if re.search(p, x))
    assert got == want and {t for _, t, _ in got} == set(PIECES)


def test_a_text_is_put_together_once(spark):
    plan = catalog.QUERIES["regulatory_tags_regex"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("RLIKE") == len(RULES)
