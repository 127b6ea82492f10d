"""What happens around a race's laps: track status, race control and weather, and their join into one frame.

A session is a day of the event feed and its clock runs in microseconds from midnight. Views are the
leader's laps, clicks change the track's status, errors open a neutralised spell of some minutes (spells overlap),
purchases are race-control messages and sign-ups weather readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade
from gridstone.operators.prefix import highest_within, quantiles, ranks, running, sweep
from gridstone.operators.relational import asof_join
from gridstone.sources.tables import laps, sql, table

#: Track status by code.
STATUS = {"1": "CLEAR", "2": "YELLOW", "4": "SC", "5": "RED", "6": "VSC", "7": "VSC_ENDING"}
#: Codes that clicks take in turn; 9 is none that is known.
CODES = ("1", "2", "4", "4", "6", "7", "5", "9", "1")
#: Statuses that are no range of their own.
PLAIN = ("CLEAR", "YELLOW")
#: Spells from the lowest to the highest.
LEVELS = ("YELLOW", "VSC", "SC", "RED")
MESSAGE_CAP = 1000
#: Texts that messages take in turn.
MESSAGES = ("SAFETY CAR DEPLOYED", None, "", "   ", "nan", " NaN ", "TRACK LIMITS CAR 4 ", "SAFETY CAR IN THIS LAP, ENDED", "DRS ENABLED")
CATEGORIES = ("SafetyCar", "Flag", None, "Drs", "Other")
HOUR = 3_600_000_000


def _clock(ts: str = "ts") -> list[Column]:
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    return [F.date_format(ts, "yyyy-MM-dd").alias("session"), F.timestamp_diff("MICROSECOND", day, F.col(ts)).alias("at")]


def _turn(values, by: str = "event_id") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def lap_starts(events: DataFrame) -> DataFrame:
    """session, lap, at: the leader's laps in order; two that start at one time are ordered by their event. Laps are numbered by a two-level running count."""
    views = events.where("event_type = 'view'").select(*_clock(), "event_id").withColumn("lap", F.lit(1).cast("long"))
    first = views.groupBy("session", "at").agg(F.count("*").alias("k"), F.sort_array(F.collect_list("event_id")).alias("ids"))  # events of one microsecond
    upto = running(first.withColumn("lap", F.col("k")), ["session"], "at", HOUR, sums=["lap"])
    return upto.select("session", "at", "lap", "k", F.posexplode("ids").alias("pos", "event_id")).select("session", (F.col("lap") - F.col("k") + F.col("pos") + 1).alias("lap"), "at")


def status_events(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'click'").select(*_clock(), "event_id", _turn(CODES).alias("code"))


def spells(events: DataFrame) -> DataFrame:
    """session, start_at, stop_at, level: neutralised spells, as many minutes long as the event's value says; some are empty."""
    return events.where("event_type = 'error'").select(*_clock(), (F.col("event_id") % len(LEVELS) + 1).cast("int").alias("level"), F.floor("value").cast("long").alias("minutes")).select(
        "session", F.col("at").alias("start_at"), (F.col("at") + F.col("minutes") * 60_000_000).alias("stop_at"), "level"
    )


def raw_messages(events: DataFrame) -> DataFrame:
    """session, event_id, lap text, category, message as they come in: blank, broken and overlong ones too."""
    lap = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.floor("value").cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise("")))
    text = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit(" "), F.expr(f"repeat('LONG ', {MESSAGE_CAP // 4})"))).otherwise(_turn(MESSAGES))
    return events.where("event_type = 'purchase'").select(_clock()[0], "event_id", lap.alias("lap"), _turn(CATEGORIES).alias("category"), text.alias("message"))


def weather(events: DataFrame) -> DataFrame:
    """session, at, air, rain: readings, of which a missing one is left out."""
    return events.where("event_type = 'signup' and value is not null").select(*_clock(), ((F.floor("value") + 100) / 10).alias("air"), (F.col("event_id") % 5 == 0).alias("rain"))


def status_ranges(status: DataFrame, starts: DataFrame) -> DataFrame:
    """Lap ranges of statuses other than clear and yellow: session, lap_start, lap_end, status.

    A repeated status is no event. An event lies in the last lap that began at or before it, before the first
    in the first. A range ends a lap before the next event, not before its own start; the last one with the
    session's last lap. Sessions without laps have no ranges. Unknown codes are named after themselves.
    """
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("code")), F.concat(F.lit("STATUS_"), F.coalesce("code", F.lit(""))))
    named = status.groupBy("session", "at").agg(F.max_by("code", "event_id").alias("code")).select("session", "at", name.alias("status"))  # of one microsecond the last holds
    changes = running(named, ["session"], "at", HOUR, last=["status"]).where("previous is null or status <> previous.status").drop("previous")
    bounds = starts.groupBy("session").agg(F.min("lap").alias("first_lap"), F.max("lap").alias("last_lap"))
    placed = asof_join(changes, starts.groupBy("session", "at").agg(F.max("lap").alias("in_lap")), ["session"], "at", "at", ["in_lap"])
    placed = placed.join(bounds, "session").withColumn("lap", F.coalesce("in_lap", "first_lap"))
    ends = running(placed.select("session", (-F.col("at")).alias("at"), "lap"), ["session"], "at", HOUR, last=["lap"])  # backwards: the next event
    following = ends.select("session", (-F.col("at")).alias("at"), F.col("previous.lap").alias("next_lap"))
    rows = placed.join(following, ["session", "at"]).where(~F.col("status").isin(*PLAIN))
    return rows.select("session", F.col("lap").alias("lap_start"), F.greatest("lap", F.coalesce(F.col("next_lap") - 1, "last_lap")).alias("lap_end"), "status")


def lap_status(intervals: DataFrame, starts: DataFrame) -> DataFrame:
    """Each lap with the highest status open at any time in it, CLEAR if none is."""
    found = highest_within(starts.withColumnRenamed("lap", "number"), intervals, ["session"], len(LEVELS), HOUR)
    names = F.array(F.lit("CLEAR"), *[F.lit(x) for x in LEVELS])
    return found.select("session", F.col("number").alias("lap"), F.element_at(names, F.col("level").cast("int") + 1).alias("status"))


def status_segments(intervals: DataFrame) -> DataFrame:
    """Stretches of one highest status, with the most spells open at once."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    return sweep(intervals, ["session"], len(LEVELS), HOUR).select("session", "from_at", "to_at", F.element_at(names, F.col("level").cast("int")).alias("status"), F.col("most").cast("long").alias("most"))


def load_messages(raw: DataFrame) -> DataFrame:
    """Messages as they are kept: trimmed, blank and `nan` ones dropped, cut at MESSAGE_CAP; a lap that is no number is null, a missing category OTHER."""
    text = F.btrim(F.coalesce("message", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    return raw.withColumn("text", text).where((F.col("text") != "") & (F.lower("text") != "nan")).select(
        "session", "event_id", F.expr("try_cast(try_cast(lap as double) as bigint)").alias("lap"), F.coalesce("category", F.lit("OTHER")).alias("category"), F.left("text", F.lit(MESSAGE_CAP)).alias("message")
    )


def safety_car(messages: DataFrame) -> DataFrame:
    """Per session: number of messages by category, of safety-car messages, and whether the last of those leaves it on the track."""
    car = F.upper("message").contains("SAFETY CAR")
    last = F.max_by(F.upper("message"), F.when(car, F.col("event_id")))
    per = messages.groupBy("session").agg(F.count("*").alias("messages"), F.count_if(F.col("category") == "OTHER").alias("other"), F.count_if(car).alias("safety_car"), last.alias("last"))
    active = (F.col("safety_car") > 0) & (F.col("last").contains("DEPLOYED") | ~F.col("last").contains("ENDED"))
    return per.select("session", "messages", "other", "safety_car", active.alias("active"))


def race_frame(starts: DataFrame, readings: DataFrame, intervals: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """A row a lap: its status, the last weather reading at or before its start (else the session's first), and its messages by number.

    Without a message table all laps have none.
    """
    if messages is None:
        messages = starts.select("session", F.lit(None).cast("long").alias("lap")).limit(0)
    per = messages.where("lap is not null").groupBy("session", "lap").agg(F.count("*").alias("messages"))
    first = readings.groupBy("session").agg(F.min(F.struct("at", "air", "rain")).alias("first"))
    met = asof_join(starts, readings, ["session"], "at", "at", ["air", "rain"]).join(first, "session", "left").join(lap_status(intervals, starts), ["session", "lap"]).join(per, ["session", "lap"], "left")
    return met.select("session", "lap", "status", F.coalesce("air", "first.air").alias("air"), F.coalesce("rain", "first.rain").alias("rain"), F.coalesce("messages", F.lit(0)).alias("messages"))


def pace_quartiles(lap: DataFrame) -> DataFrame:
    """Quartiles of lap times per season and round, a group's laps never sorted in one task."""
    found = quantiles(lap, ["season", "round"], "lap_ms", {"low": 0.25, "middle": 0.5, "high": 0.75})
    return found.select("season", "round", *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")])


def compound_ranks(lap: DataFrame) -> DataFrame:
    """Each lap's rank by time among all laps on its compound; equal times share a rank. Three compounds hold all laps."""
    return ranks(lap.select("season", "round", "driver", "lap", "compound", "lap_ms"), ["compound"], "lap_ms", pieces=128)


def _e(f):
    return lambda s, d: f(table(s, d, "events"))


QUERIES = {
    "track_status_ranges": _e(lambda e: status_ranges(status_events(e), lap_starts(e))),
    "lap_status": _e(lambda e: lap_status(spells(e), lap_starts(e))),
    "status_segments": _e(lambda e: status_segments(spells(e))),
    "race_control_load": _e(lambda e: load_messages(raw_messages(e))),
    "safety_car_state": _e(lambda e: safety_car(load_messages(raw_messages(e)))),
    "race_frame": _e(lambda e: race_frame(lap_starts(e), weather(e), spells(e), load_messages(raw_messages(e)))),
    "pace_quartiles": lambda s, d: pace_quartiles(laps(s, d)),
    "compound_ranks": lambda s, d: compound_ranks(laps(s, d)),
}


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


_CLOCK = "strftime(ts, '%Y-%m-%d') as session, date_diff('microsecond', date_trunc('day', ts), ts) as moment"
_STARTS = f"starts as (select session, moment, row_number() over (partition by session order by moment, event_id) as lap from (select {_CLOCK}, event_id from events where event_type = 'view'))"
_SPELLS = f"spells as (select session, moment as start_at, moment + cast(floor(value) as bigint) * 60000000 as stop_at, event_id % {len(LEVELS)} + 1 as level from (select *, {_CLOCK} from events where event_type = 'error'))"
_RAW = f"""raw as (select session, event_id, case when event_id % 11 = 0 then 'n/a' when event_id % 7 = 0 then null else cast(floor(value) as bigint) || case when event_id % 2 = 0 then '.0' else '' end end as lap,
 {_list(CATEGORIES)}[event_id % {len(CATEGORIES)} + 1] as category, case when event_id % 13 = 0 then ' ' || repeat('LONG ', {MESSAGE_CAP // 4}) else {_list(MESSAGES)}[event_id % {len(MESSAGES)} + 1] end as message
 from (select *, {_CLOCK} from events where event_type = 'purchase')),
messages as (select session, event_id, cast(try_cast(lap as double) as bigint) as lap, coalesce(category, 'OTHER') as category, left(trim(message), {MESSAGE_CAP}) as message from raw where trim(coalesce(message, '')) <> '' and lower(trim(message)) <> 'nan')"""
_LAPSTATUS = f"""spans as (select *, coalesce(lead(moment) over (partition by session order by lap), 9223372036854775807) as until from starts),
covered as (select p.session, p.lap, max(s.level) as level from spans p join spells s on p.session = s.session and s.start_at < p.until and s.stop_at > p.moment and s.start_at < s.stop_at and p.moment < p.until group by 1, 2),
lap_status as (select session, lap, (['CLEAR'] || {_list(LEVELS)})[coalesce(level, 0) + 1] as status from starts left join covered using (session, lap))"""

ORACLE_SQL = {
    "track_status_ranges": f"""with {_STARTS}, e as (select {_CLOCK}, event_id, coalesce({{{', '.join(f"'{k}': '{v}'" for k, v in STATUS.items())}}}[code], 'STATUS_' || code) as status from (select *, {_list(CODES)}[event_id % {len(CODES)} + 1] as code from events where event_type = 'click')),
c as (select * from (select *, lag(status) over (partition by session order by moment, event_id) as before from e) where before is distinct from status),
b as (select session, min(lap) as first_lap, max(lap) as last_lap from starts group by 1),
p as (select c.*, first_lap, last_lap, coalesce((select max(lap) from starts s where s.session = c.session and s.moment <= c.moment), first_lap) as lap from c join b using (session)),
n as (select *, lead(lap) over (partition by session order by moment, event_id) as next_lap from p)
select session, lap as lap_start, greatest(lap, coalesce(next_lap - 1, last_lap)) as lap_end, status from n where status not in ('CLEAR', 'YELLOW')""".replace("{'1'", "map {'1'"),
    "lap_status": f"with {_STARTS}, {_SPELLS}, {_LAPSTATUS} select * from lap_status",
    "status_segments": f"""with {_SPELLS}, s as (select * from spells where start_at < stop_at), t as (select distinct session, moment from (select session, start_at as moment from s union all select session, stop_at from s)),
g as (select session, moment, lead(moment) over (partition by session order by moment) as until from t),
h as (select g.session, g.moment, g.until, max(s.level) as level, count(*) as open from g join s on g.session = s.session and s.start_at <= g.moment and s.stop_at >= g.until group by 1, 2, 3),
i as (select *, case when lag(level) over w = level and lag(until) over w = moment then 0 else 1 end as new from h window w as (partition by session order by moment)),
r as (select *, sum(new) over (partition by session order by moment) as run from i)
select session, min(moment) as from_at, max(until) as to_at, {_list(LEVELS)}[any_value(level)] as status, max(open) as most from r group by session, run""",
    "race_control_load": f"with {_RAW} select * from messages",
    "safety_car_state": f"""with {_RAW}, c as (select *, contains(upper(message), 'SAFETY CAR') as car from messages),
p as (select session, count(*) as messages, count(*) filter (where category = 'OTHER') as other, count(*) filter (where car) as safety_car, arg_max(upper(message), event_id) filter (where car) as last from c group by 1)
select session, messages, other, safety_car, coalesce(safety_car > 0 and (contains(last, 'DEPLOYED') or not contains(last, 'ENDED')), false) as active from p""",
    "race_frame": f"""with {_STARTS}, {_SPELLS}, {_RAW}, {_LAPSTATUS}, w as (select {_CLOCK}, (floor(value) + 100) / 10 as air, event_id % 5 = 0 as rain from events where event_type = 'signup' and value is not null),
u as (select session, moment, max(struct_pack(a := air, r := rain)) as v from w group by 1, 2), f as (select session, arg_min(v, moment) as first from u group by 1),
m as (select session, lap, count(*) as messages from messages where lap is not null group by 1, 2),
j as (select s.session, s.lap, s.moment, u.v from starts s asof left join u on s.session = u.session and s.moment >= u.moment)
select session, lap, status, coalesce(v.a, first.a) as air, coalesce(v.r, first.r) as rain, coalesce(messages, 0) as messages from j left join f using (session) join lap_status using (session, lap) left join m using (session, lap)""",
    "pace_quartiles": sql(" select season, round, round(quantile_cont(lap_ms, 0.25), 4) as low, round(quantile_cont(lap_ms, 0.5), 4) as middle, round(quantile_cont(lap_ms, 0.75), 4) as high from laps group by 1, 2", "laps"),
    "compound_ranks": sql(" select season, round, driver, lap, compound, lap_ms, cast(rank() over (partition by compound order by lap_ms) as int) as rank from laps", "laps"),
}
