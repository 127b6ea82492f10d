"""Streams of state against the same by aggregation, and versioned tables whose writers fail."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridstone.plans import news
from gridstone.sources.tables import feed, table
from gridstone.sources.versioned import VersionedTable, copy_window
from gridstone.streaming.live import alert_stream, latest, latest_stream, rocks_state, state_rows

SF = "/root/testdata/sf0.001"


def run(df, mode, to, folder, batches=None):
    """Runs a stream to the end of what has come so far."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(to) if callable(to) else writer.format("parquet").option("path", to)
    query = writer.start()
    query.awaitTermination(120)
    return query


def test_latest_state_of_shuffled_repeated_and_late_batches(spark, tmp_path):
    events = table(spark, SF, "events")
    rows = events.collect()
    random.Random(4).shuffle(rows)  # late rows everywhere
    source = str(tmp_path / "in")
    batches = [rows[:400], rows[300:700], rows[650:], rows[:50]]
    target = VersionedTable(spark, f"file://{tmp_path}/table", latest(state_rows(events)).schema, keys=["key"], buckets=4)

    def put(batch, n):
        target.merge(batch.drop("rows"), "at", note=f"batch {n}")
        target.merge(batch.drop("rows"), "at", note=f"batch {n}")  # a batch that comes again

    with rocks_state(spark):
        for some in batches:
            spark.createDataFrame(some, events.schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
            run(latest_stream(state_rows(stream)), "Update", put, tmp_path)
    want = {r.key: tuple(r) for r in latest(state_rows(events)).collect()}
    assert {r.key: tuple(r) for r in target.read().collect()} == want
    assert len(target.versions()) == len(batches) - 1  # a repeated batch and one without news commit nothing


def test_latest_state_tells_changes_only_and_keeps_nulls(spark, tmp_path):
    shape = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    parts = [
        [(None, at(5), 1, None, None, None), (2, at(5), 2, "view", None, None), (3, at(1), 3, "view", 1.0, None), (4, None, 4, "view", 1.0, None)],
        [(2, at(5), 2, "view", 7.0, None), (3, at(1), 3, "view", 1.0, None), (1, at(4), 1, "click", 1.0, None), (5, at(9), 5, "view", 1.0, None)],
    ]
    told = []
    with rocks_state(spark):
        for some in parts:
            spark.createDataFrame(some, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = latest_stream(state_rows(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")))
            assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "InPandas" not in stream._jdf.queryExecution().analyzed().toString()
            run(stream, "Update", lambda batch, n: told.append(sorted((r.key, r.seq, r.what, r.value, r.rows) for r in batch.collect())), tmp_path)
    assert told == [[(1, None, None, None, 1), (2, 2, "view", None, 1), (3, 3, "view", 1.0, 1)], [(2, 2, "view", 7.0, 2), (5, 5, "view", 1.0, 1)]]


def test_alert_stream_equals_the_table(spark, tmp_path):
    events = table(spark, "/root/testdata/sf0.01", "events")
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    ordered = events.orderBy("ts").collect()
    late = [r for k, r in enumerate(ordered) if k % 500 == 3][2:-3]  # held back for a day's worth of rows
    names = {r.event_id for r in late}
    on_time = [r for r in ordered if r.event_id not in names]
    third = len(on_time) // 3
    end = [(None, "clock", 0, "tick")]
    ticks = spark.createDataFrame(end, "event_id long, event_type string, user_id long, props string").withColumn("ts", F.expr("timestamp_ntz '2024-01-31 02:00:00'")).withColumn("value", F.lit(0.0)).select(*events.columns)
    parts = [spark.createDataFrame(x, events.schema) for x in (on_time[:third], on_time[third:], late)] + [ticks]
    with rocks_state(spark):
        for some in parts:
            some.coalesce(1).write.mode("append").parquet(source)
            run(alert_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)), "Append", out, tmp_path)
    rows = spark.read.parquet(out).where("cluster <> 'clock'").collect()
    told = sum(r.n for r in rows if r.kind == "late")
    kept = spark.createDataFrame([r for r in ordered if r.event_id not in names], events.schema)
    kept.write.parquet(f"{tmp_path}/table/events.parquet")
    want = {(r.cluster, r.hour, r.n, r.z): r.resolved for r in news.spike_alerts(feed(spark, str(tmp_path / "table"))).collect()}
    stamp = lambda ms: str(datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc))[:13]
    raised = {(r.cluster, stamp(r.hour_ms), r.n, round(r.z, 4)) for r in rows if r.kind == "raised"}
    assert told == len(late)  # told, not lost, and in no hour's count
    assert raised == set(want) and len(raised) > 20
    until = {c: max(stamp(r.hour_ms) for r in rows if r.kind == "resolved" and r.cluster == c) for c, *_ in raised}
    assert {k for k, resolved in want.items() if resolved} == {k for k in raised if k[1] <= until[k[0]]}


@pytest.fixture
def people(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/people", spark.createDataFrame([], "id long, name string, at long").schema, keys=["id"], buckets=4)


def make(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string, at long")


def test_merge_rewrites_touched_buckets_only(spark, people):
    assert people.read().count() == 0
    people.merge(make(spark, *[(k, f"n{k}", 1) for k in range(40)], (None, "x", 1)), "at")
    before = people.manifest()
    people.merge(make(spark, (3, "older", 0), (3, "new", 5), (3, "new", 5), (77, "added", 1)), "at")
    after = people.manifest()
    got = {r.id: r.name for r in people.read().collect()}
    assert len(got) == 41 and got[3] == "new" and got[77] == "added" and got[4] == "n4"
    changed = [p for p in after["parts"] if after["parts"][p] != before["parts"].get(p)]
    assert 1 <= len(changed) <= 2
    assert {r.id: r.name for r in people.read(0).collect()}[3] == "n3"  # the version before is still whole
    people.merge(make(spark, (3, "late", 2)), "at")
    assert {r.id: r.name for r in people.read().collect()}[3] == "new"
    assert people.merge(make(spark).limit(0), "at") == people.versions()[-1]
    assert people.vacuum(1) > 0 and len(people.versions()) == 1 and people.read().count() == 41


def test_changes_are_worked_out_once(spark, people):
    seen = spark.sparkContext.accumulator(0)

    def number(k):
        seen.add(1)
        return k

    people.merge(spark.range(10).select(F.udf(number, "long").asNondeterministic()("id").alias("id"), F.lit("n").alias("name"), F.lit(1).cast("long").alias("at")), "at")
    assert people.read().count() == 10 and seen.value == 10


def test_failed_writers_leave_the_table(spark, people, monkeypatch, tmp_path):
    people.merge(make(spark, (1, "a", 1), (2, "b", 1)), "at")
    broken = make(spark, (1, "z", 9)).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):  # while rows are written
        people.merge(broken, "at")
    with monkeypatch.context() as m:  # between the rows and the manifest
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            people.merge(make(spark, (1, "z", 9)), "at")
    assert sorted(map(tuple, people.read().collect())) == [(1, "a", 1), (2, "b", 1)] and people.versions() == [0]
    stale = people.manifest()
    people.merge(make(spark, (5, "c", 1)), "at")
    with pytest.raises(Exception):  # another writer was first
        people._commit(stale, {}, None)
    assert people.read().count() == 3


def test_replace_of_sessions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "season int, round int, driver string")
    sessions = VersionedTable(spark, f"file://{tmp_path}/laps", rows((1, 1, "a")).schema, by=["season", "round"])
    sessions.replace(rows((1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (None, 2, "d")))
    sessions.replace(rows((1, 1, "z"), (2, 1, "y")), deal=2)
    assert sorted(map(tuple, sessions.read().collect()), key=repr) == sorted([(1, 1, "z"), (1, 2, "c"), (2, 1, "y"), (None, 2, "d")], key=repr)
    assert sessions.replace(rows((1, 1, "q")).limit(0)) == 2 and sessions.read().count() == 4


def test_windows_are_copied(spark, people):
    copy_window(people, make(spark, *[(k, f"n{k}", k) for k in range(30)]), [F.desc("at")], 10, "at")
    assert sorted(r.id for r in people.read().collect()) == list(range(20, 30))
    copy_window(people, make(spark, (5, "five", 99), (6, None, 98)), [F.desc("at")], 1, "at")
    assert people.read().count() == 11
