"""State that is kept while data come in: the live state, alerts as a stream, and serving tables with a window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.plans import news
from gridstone.sources.files import scratch
from gridstone.sources.tables import AS_OF, articles, as_of, daily, feed, hours_ago, sql, table
from gridstone.sources.versioned import VersionedTable, copy_window
from gridstone.streaming.live import alert_stream, latest, latest_stream, rocks_state, state_rows

LATE = "2 hours"


def _as_folder(d: str) -> str:
    """The event table as a stream's source; as a pattern, it may be one file or a folder of them."""
    return f"{d}/event[s].parquet"


def live_state(events: DataFrame) -> DataFrame:
    """The race as it stands: each driver's latest row, how long ago, and its place by the value it shows (ties: the smaller key)."""
    now = latest(state_rows(events))
    newest = now.agg(F.max("at").alias("now"))  # one row
    return now.crossJoin(F.broadcast(newest)).select("key", "seq", "what", "value", ((F.col("now") - F.col("at")) / 1_000_000).cast("long").alias("idle_s"))


def latest_by_stream(s: SparkSession, d: str) -> DataFrame:
    """The same rows as the stream leaves them: changes of each batch merged into a table whose untouched buckets stay."""
    events, home = table(s, d, "events"), scratch(s, "latest")
    target = VersionedTable(s, f"{home}/table", latest(state_rows(events)).schema, keys=["key"])
    stream = s.readStream.schema(events.schema).parquet(_as_folder(d))
    with rocks_state(s):
        query = latest_stream(state_rows(stream)).writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
        query.foreachBatch(lambda batch, n: target.merge(batch.drop("rows"), "at", note=n) and None).start().awaitTermination()
    return target.read().select("key", "seq", "what", "value")


def alerts_by_stream(s: SparkSession, d: str) -> DataFrame:
    """The alerts of the feed's history as the stream raises and resolves them, the watermark running on to the reference time."""
    events, home = table(s, d, "events"), scratch(s, "alerts")
    clock = events.sparkSession.range(1).select(*[(F.lit("clock") if f.name == "event_type" else (as_of() + F.expr(f"interval {LATE}")) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    clock.write.parquet(f"{home}/clock")
    stream = s.readStream.schema(events.schema).parquet(_as_folder(d)).union(s.readStream.schema(events.schema).parquet(f"{home}/clock"))
    with rocks_state(s):
        query = alert_stream(stream, LATE).writeStream.outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
        query.format("parquet").option("path", f"{home}/out").start().awaitTermination()
    told = s.read.parquet(f"{home}/out").where("cluster <> 'clock'")
    done = told.where("kind = 'resolved'").groupBy("cluster").agg(F.max("hour_ms").alias("until"))
    hour = F.date_format(F.timestamp_add("MILLISECOND", F.col("hour_ms"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH")
    raised = told.where("kind = 'raised'").join(done, "cluster", "left")
    return raised.select("cluster", hour.alias("hour"), "n", F.round("z", 4).alias("z"), news._severity(F.col("z")).alias("severity"), (F.coalesce(F.col("hour_ms") <= F.col("until"), F.lit(False))).alias("resolved"))


#: The window of each serving table: hours back (None: all), and most rows (None: all in the window).
WINDOWS = {"article_embeddings": (6, 500), "regulatory_tags": (168, None), "session_chatter": (120, 200), "driver_sentiment": (720, None), "controversy_index": (168, None), "daily_briefings": (720, None), "content": (None, 5000)}


def serving_sources(s: SparkSession, d: str) -> dict[str, tuple[DataFrame, list[Column]]]:
    """key, at, figure of each serving table's source, with the order in which its rows count."""
    rows, days = articles(s, d), daily(s, d)
    one = rows.select(F.col("guid").cast("string").alias("key"), F.col("published_at").alias("at"), F.round(F.col("priority") * 100).cast("long").alias("figure"), "label")
    per = days.select(F.concat_ws("|", "cluster", F.date_format("day", "yyyy-MM-dd")).alias("key"), F.col("day").cast("timestamp_ntz").alias("at"), "mentions", "negative", "heavy")
    whole = per.groupBy("at").agg(F.sum("mentions").alias("figure")).select(F.date_format("at", "yyyy-MM-dd").alias("key"), "at", "figure")
    newest, foremost = [F.desc("at"), F.asc("key")], [F.desc("figure"), F.desc("at"), F.asc("key")]
    return {
        "article_embeddings": (one.drop("label"), newest), "regulatory_tags": (one.where("label = 'negative'").drop("label"), newest), "session_chatter": (one.drop("label"), foremost), "content": (one.drop("label"), newest),
        "driver_sentiment": (per.select("key", "at", F.col("mentions").alias("figure")), newest), "controversy_index": (per.select("key", "at", (F.col("negative") + F.col("heavy")).alias("figure")), newest), "daily_briefings": (whole, newest),
    }


def serve(s: SparkSession, d: str, home: str) -> dict[str, VersionedTable]:
    """Brings every serving table up to its source's window; run again, it changes nothing."""
    out = {}
    for name, (rows, order) in serving_sources(s, d).items():
        hours, most = WINDOWS[name]
        rows = rows if hours is None else rows.where(hours_ago("at").between(0, hours - 1))
        out[name] = VersionedTable(s, f"{home}/{name}", rows.schema, keys=["key"], buckets=8)
        copy_window(out[name], rows, order, most, "at")
    return out


def served(s: SparkSession, d: str) -> DataFrame:
    """Rows of all serving tables after a run."""
    out = None
    for name, target in serve(s, d, scratch(s, "serving")).items():
        rows = target.read().select(F.lit(name).alias("target"), "key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "figure")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "live_state": lambda s, d: live_state(table(s, d, "events")),
    "latest_state_stream": latest_by_stream,
    "spike_alert_stream": alerts_by_stream,
    "serving_windows": served,
}

_LATEST = "l as (select user_id as key, unnest(max(struct_pack(at_us := epoch_us(ts), seq := event_id, what := event_type, value := value))) from events where user_id is not null and ts is not null group by 1)"


def _window(name: str, body: str, order: str) -> str:
    hours, most = WINDOWS[name]
    test = "" if hours is None else f" where floor(date_diff('second', moment, timestamp '{AS_OF}') / 3600.0) between 0 and {hours - 1}"
    return f"select '{name}' as target, key, strftime(moment, '%Y-%m-%d %H:%M:%S') as at, figure from (select * from ({body}){test} order by {order}{f' limit {most}' if most else ''})"


_ONE = "select cast(guid as varchar) as key, published_at as moment, cast(round(priority * 100) as bigint) as figure from feed"
_PER = "select cluster || '|' || strftime(day, '%Y-%m-%d') as key, cast(day as timestamp) as moment, {} as figure from daily"
_NEW, _TOP = "moment desc, key", "figure desc, moment desc, key"
ORACLE_SQL = {
    "live_state": f"with {_LATEST} select key, seq, what, value, ((select max(at_us) from l) - at_us) // 1000000 as idle_s from l",
    "latest_state_stream": f"with {_LATEST} select key, seq, what, value from l",
    "spike_alert_stream": news.ORACLE_SQL["spike_alert_dedupe"],
    "serving_windows": sql(" " + " union all ".join([
        _window("article_embeddings", _ONE, _NEW), _window("regulatory_tags", _ONE + " where label = 'negative'", _NEW), _window("session_chatter", _ONE, _TOP), _window("content", _ONE, _NEW),
        _window("driver_sentiment", _PER.format("mentions"), _NEW), _window("controversy_index", _PER.format("cast(negative + heavy as bigint)"), _NEW),
        _window("daily_briefings", "select strftime(day, '%Y-%m-%d') as key, cast(day as timestamp) as moment, cast(sum(mentions) as bigint) as figure from daily group by day", _NEW),
    ]), "feed", "daily"),
}
