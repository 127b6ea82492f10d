"""File sinks, the run log and the storage guard."""

from __future__ import annotations

import pytest

from gridstone.sources.files import csv_rows, export, has_room, json_rows, logged

SCHEMA = "k int, note string"


def test_every_format_gives_the_rows_back(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    export(df, str(tmp_path))
    export(df, str(tmp_path))  # a repeated run replaces
    for back in (spark.read.parquet(f"{tmp_path}/parquet"), csv_rows(spark, f"{tmp_path}/csv", SCHEMA), json_rows(spark, f"{tmp_path}/json", SCHEMA)):
        assert sorted(tuple(r) for r in back.select("k", "note").collect()) == rows
    export(df.limit(0), str(tmp_path))
    assert json_rows(spark, f"{tmp_path}/json", SCHEMA).isEmpty()


def test_runs_are_logged_even_when_they_fail(spark, tmp_path):
    folder = str(tmp_path / "log")
    with logged(spark, folder, "good") as said:
        said["rows"] = 5
    with pytest.raises(ValueError), logged(spark, folder, "bad"):
        raise ValueError("no")
    got = sorted((r.job, r.rows, r.status, r.error) for r in spark.read.parquet(folder).collect())
    assert got == [("bad", None, "failed", "ValueError: no"), ("good", 5, "ok", None)]


def test_storage_guard(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 2_000_000)
    assert has_room(spark, f"file://{tmp_path}") and not has_room(spark, f"file://{tmp_path}", 1.5) and has_room(spark, f"file://{tmp_path}/none", 0)
