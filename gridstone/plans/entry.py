"""Entry lists and forecasts: grids, overrides, statuses, blends, distances, calendars, strategies, splits and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, clamp, ratio
from gridstone.operators.relational import asof_join, stored
from gridstone.sources.tables import daily, feed, laps, results, sql, table

SESSION = ["season", "round"]
RUN = [*SESSION, "driver"]
# Statuses that count as classified.
CLASSIFIED = ("Finished", "Lapped", "+1 Lap", "+2 Laps", "+3 Laps", "+4 Laps", "+5 Laps", "+6 Laps")
#: Race laps where the calendar has none, by round of the year, and where neither has.
STATIC_LAPS, DEFAULT_LAPS = {4: 71, 8: 44}, 58
RACES_PER_SEASON = 24


def _raw_slots(rows: DataFrame) -> DataFrame:
    """Results with a source slot that repeats for some drivers and is missing for others."""
    slot = F.when(F.col("driver") % 7 != 0, F.when(F.col("driver") % 4 == 0, F.greatest(F.col("grid") - 1, F.lit(1))).otherwise(F.col("grid")))
    return rows.withColumn("slot", F.when(F.col("round") % 2 == 0, F.col("grid")).otherwise(slot))


def dense_grid(rows: DataFrame) -> DataFrame:
    """Starting places 1 to n of each session: the source's if they are just that, else dealt anew by slot (missing last), best and driver."""
    shape = rows.groupBy(*SESSION).agg(F.count("*").alias("n"), F.countDistinct("slot").alias("kinds"), F.count("slot").alias("known"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    sound = (F.col("kinds") == F.col("n")) & (F.col("known") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    placed = rows.join(shape.select(*SESSION, "n", sound.alias("sound")), SESSION)
    order = W.partitionBy(*SESSION).orderBy(F.coalesce("slot", F.col("n") + 1), "finish", "driver")
    return placed.select(*RUN, "slot", "n", F.when(F.col("sound"), F.col("slot")).otherwise(F.row_number().over(order)).cast("bigint").alias("place"))


def override_slots(grid: DataFrame, fixed: DataFrame) -> DataFrame:
    """The grid with fixed drivers at their slots (held within 1 to n) and the others on the free slots in order of their places."""
    held = grid.join(fixed, RUN).select(*RUN, F.least(F.greatest("wanted", F.lit(1)), F.col("n")).alias("new_place"))
    every = grid.groupBy(*SESSION).agg(F.max("n").alias("n")).select(*SESSION, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("new_place"))
    free = every.join(held.select(*SESSION, "new_place").distinct(), [*SESSION, "new_place"], "left_anti")
    free = free.withColumn("k", F.row_number().over(W.partitionBy(*SESSION).orderBy("new_place")))
    rest = grid.join(held, RUN, "left_anti").withColumn("k", F.row_number().over(W.partitionBy(*SESSION).orderBy("place")))
    return held.unionByName(rest.join(free, [*SESSION, "k"]).select(*RUN, "new_place"))


def status_of(rows: DataFrame) -> DataFrame:
    """Label, retirement flag and reason of a result's status."""
    s = F.col("status")
    done = s.isin(*CLASSIFIED) | F.regexp_like("status", F.lit(r"^\+\d"))
    label = cascade([(F.coalesce(s, F.lit("")) == "", "UNKNOWN"), (done, "FINISHED"), (s == "Did Not Start", "DNS"), (s == "Disqualified", "DSQ")], "DNF")
    out = (F.coalesce(s, F.lit("")) != "") & ~done & (s != "Did Not Start")
    return rows.select(*RUN, label.alias("label"), F.coalesce(out, F.lit(False)).alias("is_dnf"), F.when(out, F.left(F.upper(s), F.lit(12))).alias("reason"))


def _with_status(rows: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Finished", "+1 Lap", "+7 Laps", "Did Not Start", "Disqualified", "Collision damage", "Engine", "")])
    return rows.withColumn("status", F.when((F.col("driver") + F.col("round")) % 9 != 8, F.element_at(kinds, ((F.col("driver") + F.col("round")) % 9 + 1).cast("int"))))


def confidence(done: Column) -> Column:
    """Share of the season that is known, as confidence."""
    return F.least(0.30 + clamp(done / RACES_PER_SEASON, 0.0, 1.0) * 0.65, F.lit(0.95))


def blend(rows: DataFrame) -> DataFrame:
    """Win and podium chances of every race: chances by grid blended with a prior from points, floors for the front, made to sum to one; rank by expected points.

    The season's rounds before a race are the evidence that takes weight from the prior.
    """
    race = W.partitionBy(*SESSION)
    done = F.col("round") - 1
    prior_weight = F.greatest(0.45 - F.least(done / 10, F.lit(0.9)) * 0.25, F.lit(0.15))
    by_grid = (1000 / F.col("grid")).cast("bigint")
    win, prior = by_grid / F.sum(by_grid).over(race), (F.col("points") + 1) / F.sum(F.col("points") + 1).over(race)
    p = rows.select(*RUN, "grid", "points", prior_weight.alias("w"), win.alias("win"), prior.alias("prior"), confidence(done).alias("confidence"))
    p = p.select("*", ((1 - F.col("w")) * F.col("win") + F.col("w") * F.col("prior")).alias("mixed"), F.least((1 - F.col("w")) * F.least(3 * F.col("win"), F.lit(1.0)) + F.col("w") * F.least(3 * F.col("prior"), F.lit(1.0)), F.lit(1.0)).alias("podium"))
    upset = F.col("mixed") / F.greatest(F.lit(0.001), 1 - (F.col("grid") - 1) * 0.08)
    is_upset = (F.col("grid") >= 5) & (F.col("mixed") >= 0.08) & (upset >= 2.0)
    floor = F.when((F.col("grid") <= 10) & (F.col("mixed") < 0.004), 0.004).when((F.col("grid") <= 5) & (F.col("mixed") < 0.008), 0.008).otherwise(F.round("mixed", 4))
    p = p.select("*", is_upset.alias("is_upset"), F.when(is_upset, F.round(upset - 1, 3)).otherwise(0.0).alias("upset_score"), floor.cast("decimal(10,4)").alias("floored"))
    share = F.round(F.col("floored").cast("double") / F.sum("floored").over(race).cast("double"), 4)
    p = p.select("*", share.alias("win_probability"), F.round("podium", 4).alias("podium_probability"))
    rank = F.row_number().over(race.orderBy(F.desc("points"), F.desc("podium_probability"), F.desc("win_probability"), "driver"))
    return p.select(*RUN, "win_probability", "podium_probability", F.round("confidence", 3).alias("confidence"), "is_upset", "upset_score", rank.cast("bigint").alias("predicted_position"))


def race_distance(races: DataFrame, calendar: DataFrame) -> DataFrame:
    """Laps of each race: the calendar's, else the circuit's, else a default."""
    static = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATIC_LAPS.items() for x in kv]), F.col("round"))
    return races.join(calendar, SESSION, "left").select(*SESSION, F.coalesce("race_laps", static, F.lit(DEFAULT_LAPS)).cast("bigint").alias("laps"))


def normal_calendar(rows: DataFrame) -> DataFrame:
    """One row per season, day and circuit however it is spelt: the one with the smallest id, beside the newest id."""
    key = F.lower(F.trim("circuit"))
    return rows.groupBy("season", F.date_format("day", "yyyy-MM-dd").alias("day"), key.alias("name")).agg(F.min("id").alias("id"), F.min_by(F.trim("circuit"), "id").alias("circuit"), F.max("id").alias("newest"))


def strategies(lap: DataFrame) -> DataFrame:
    """Stops of every drive: those seen as pit laps, else one less than its compounds; null where there are none. First stop and longest run between pit laps."""
    per = lap.groupBy(*RUN).agg(
        F.count_if(F.col("sector") == 7).alias("seen"), F.countDistinct("compound").alias("compounds"), F.min(F.when(F.col("sector") == 7, F.col("lap"))).alias("first_stop"), F.count("*").alias("laps"),
    )
    return per.select(*RUN, F.nullif(F.when(F.col("seen") > 0, F.col("seen")).otherwise(F.col("compounds") - 1), F.lit(0)).alias("stops"), F.col("first_stop").cast("bigint").alias("first_stop"), "laps")


def points_in_laps(points: DataFrame, starts: DataFrame, most_hours: int = 6) -> DataFrame:
    """Telemetry points with the lap in whose window [start, end) they lie; a lap ends where the next begins, after some hours at most.

    The last start at or before a point is carried to it in one window; then only the end is asked. No range join is needed.
    """
    w = W.partitionBy("car").orderBy("start")
    limit = F.col("start") + F.expr(f"interval {most_hours} hours")
    windows = starts.select("car", "start", F.row_number().over(w).cast("bigint").alias("lap"), F.least(F.coalesce(F.lead("start").over(w), limit), limit).alias("end"))
    met = asof_join(points, windows, ["car"], "at", "start", ["lap", "end"])
    return met.where(F.col("at") < F.col("end")).select("point", "car", "lap")


def careers(rows: DataFrame) -> DataFrame:
    """Races, wins, podiums, points, seasons, titles and last season of every driver."""
    season = rows.groupBy("season", "driver").agg(F.count("*").alias("races"), F.count_if(F.col("finish") == 1).alias("wins"), F.count_if(F.col("finish") <= 3).alias("podiums"), F.sum("points").alias("points"))
    place = F.row_number().over(W.partitionBy("season").orderBy(F.desc("points"), F.desc("wins"), "driver"))
    ranked = season.withColumn("place", place)
    return ranked.groupBy("driver").agg(*[F.sum(c).alias(c) for c in ("races", "wins", "podiums", "points")], F.count("*").alias("seasons"), F.count_if(F.col("place") == 1).alias("titles"), F.max("season").cast("bigint").alias("last_season"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, null share, mean, least and greatest of each column, in one pass."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    v = F.col("p.v")
    return rows.select(F.explode(parts).alias("p")).groupBy("p.feature").agg(F.count("*").alias("n"), F.round(F.avg(v.isNull().cast("double")), 6).alias("null_share"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def split_figures(rows: DataFrame) -> DataFrame:
    """Size of the training seasons and of the test season, the last."""
    last = rows.agg(F.max("season").alias("last"))  # one row
    part = F.when(F.col("season") == F.col("last"), "test").otherwise("train")
    return rows.crossJoin(F.broadcast(last)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.countDistinct("season", "round").alias("races"), F.countDistinct("driver").alias("drivers"), F.round(F.avg("finish"), 4).alias("mean_finish"))


def concentration(rows: DataFrame) -> DataFrame:
    """Herfindahl index of a season's points over teams, and the team that holds more than 45 % of them, if any."""
    per = rows.groupBy("season", "team").agg(F.sum("points").alias("p"))
    top = F.min_by("team", F.struct(-F.col("p"), F.col("team")))
    out = per.groupBy("season").agg(F.sum(F.col("p") * F.col("p")).alias("squares"), F.sum("p").alias("total"), F.max("p").alias("most"), top.alias("top"))
    return out.select("season", F.round(ratio(F.col("squares").cast("double"), F.col("total") * F.col("total")), 6).alias("index"), F.when(F.col("most") > 0.45 * F.col("total"), F.col("top").cast("string")).otherwise("balanced").alias("dominant"))


def scaled(lap: DataFrame) -> DataFrame:
    """Every lap's coordinates within its session's bounds, 0 to 1; 0 where the bounds meet."""
    w = W.partitionBy(*SESSION)

    def unit(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.round(F.coalesce(ratio(F.col(c) - low, high - low), F.lit(0.0)), 5)

    return lap.select(*RUN, F.col("lap").cast("bigint").alias("lap"), unit("lap_ms").alias("x"), unit("tyre_life").alias("y"))


def top_three(lap: DataFrame) -> DataFrame:
    """The three fastest drivers of each session by best lap."""
    best = lap.groupBy(*RUN).agg(F.min("lap_ms").alias("best"))
    place = F.row_number().over(W.partitionBy(*SESSION).orderBy("best", "driver"))
    return best.withColumn("place", place.cast("bigint")).where("place <= 3")


def race_windows(lap: DataFrame) -> DataFrame:
    """Days of each race's window: from its first session's day on, four at least."""
    per = lap.groupBy(*SESSION).agg(F.min("run_at").alias("first"), F.max("run_at").alias("last"))
    return per.select(*SESSION, F.greatest(F.datediff("last", "first") + 1, F.lit(4)).cast("bigint").alias("days"))


def lap_labels(best: DataFrame) -> DataFrame:
    """Best laps as m:ss.mmm, read back as milliseconds, with a place label; text that is no number becomes null."""
    ms = F.round("best").cast("bigint")
    text = F.concat(F.expr("cast(ms div 60000 as string)"), F.lit(":"), F.lpad(F.expr("cast(ms % 60000 div 1000 as string)"), 2, "0"), F.lit("."), F.lpad(F.expr("cast(ms % 1000 as string)"), 3, "0"))
    part = lambda k: F.expr(f"try_cast(regexp_extract(lap_time, '^([0-9]+):([0-9]{{2}})\\\\.([0-9]{{3}})$', {k}) as bigint)")
    rows = best.withColumn("ms", ms).withColumn("lap_time", text)
    junk = F.expr("try_cast(case when place = 2 then 'n/a' else cast(place as string) end as bigint)")
    return rows.select(*RUN, "lap_time", (part(1) * 60000 + part(2) * 1000 + part(3)).alias("read_back"), F.concat(F.lit("P"), F.col("place").cast("string")).alias("label"), junk.alias("safe"))


def since_spike(days: DataFrame, times: float = 1.2) -> DataFrame:
    """Days since a series was last above so many times its mean; null if it never was."""
    w = W.partitionBy("cluster")
    marked = days.select("cluster", "day", F.max("day").over(w).alias("last"), (F.col("mentions") > times * F.avg("mentions").over(w)).alias("high"))
    return marked.groupBy("cluster").agg(F.min(F.when(F.col("high"), F.datediff("last", "day"))).cast("bigint").alias("days"))


def _of(source, f):
    return lambda s, d: f(source(s, d))


def _overrides(s, d):
    grid = stored(dense_grid(_raw_slots(results(s, d))))  # read twice
    return override_slots(grid, grid.where("driver % 10 = 3").select(*RUN, (F.col("driver") * 7 % 30 - 2).alias("wanted")))


def _distances(s, d):
    races = results(s, d).select(*SESSION).distinct()
    return race_distance(races, races.where("round % 4 <> 0").select(*SESSION, (F.col("round") + 50).alias("race_laps")))


def _calendar(s, d):
    o = table(s, d, "orders")
    city = F.concat(F.lit("City"), (F.col("o_custkey") % 7).cast("string"))
    name = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" "), city, F.lit(" "))).otherwise(F.upper(city))
    return normal_calendar(o.select(F.year("o_orderdate").cast("bigint").alias("season"), F.to_date("o_orderdate").alias("day"), name.alias("circuit"), F.col("o_orderkey").alias("id")))


def _interval(s, d):
    f = feed(s, d)
    return points_in_laps(f.where("cluster = 'view'").select(F.col("guid").alias("point"), F.col("entity").alias("car"), F.col("published_at").alias("at")), f.where("cluster = 'click'").select(F.col("entity").alias("car"), F.col("published_at").alias("start")))


QUERIES = {
    "dense_grid": _of(results, lambda r: dense_grid(_raw_slots(r))),
    "grid_overrides": _overrides,
    "status_labels": _of(results, lambda r: status_of(_with_status(r))),
    "prediction_blend": _of(results, blend),
    "race_distance": _distances,
    "calendar_normal": _calendar,
    "strategy_table": _of(laps, strategies),
    "interval_join_laps": _interval,
    "career_rollup": _of(results, careers),
    "null_profile": _of(results, lambda r: null_profile(_raw_slots(r), ["grid", "slot", "finish", "points"])),
    "train_test_split": _of(results, split_figures),
    "points_concentration": _of(results, concentration),
    "lap_coordinates": _of(laps, scaled),
    "live_top_three": _of(laps, top_three),
    "race_windows": _of(laps, race_windows),
    "lap_labels": _of(laps, lambda lap: lap_labels(top_three(lap))),
    "days_since_spike": _of(daily, since_spike),
}

_SLOTS = """slots as (select *, case when round % 2 = 0 then grid when driver % 7 <> 0 then case when driver % 4 = 0 then greatest(grid - 1, 1) else grid end end as slot from results)"""
_DENSE = _SLOTS + """, shape as (select season, round, count(*) as n, count(distinct slot) = count(*) and count(slot) = count(*) and min(slot) = 1 and max(slot) = count(*) as sound from slots group by 1, 2),
dense as (select season, round, driver, slot, n, case when sound then slot else row_number() over (partition by season, round order by coalesce(slot, n + 1), finish, driver) end as place from slots join shape using (season, round))"""
_TOP = """b as (select season, round, driver, min(lap_ms) as best from laps group by 1, 2, 3), top as (select * from (select *, row_number() over (partition by season, round order by best, driver) as place from b) where place <= 3)"""
ORACLE_SQL = {
    "dense_grid": sql(f", {_DENSE} select * from dense", "results"),
    "grid_overrides": sql(f""", {_DENSE}, h as (select season, round, driver, least(greatest(driver * 7 % 30 - 2, 1), n) as new_place from dense where driver % 10 = 3),
f as (select season, round, new_place, row_number() over (partition by season, round order by new_place) as k from (select distinct season, round, unnest(range(1, n + 1)) as new_place from dense) e where not exists (select 1 from h where h.season = e.season and h.round = e.round and h.new_place = e.new_place)),
r as (select *, row_number() over (partition by season, round order by place) as k from dense where driver % 10 <> 3)
select * from h union all select season, round, driver, new_place from r join f using (season, round, k)""", "results"),
    "status_labels": sql(""", s as (select *, ['Finished', '+1 Lap', '+7 Laps', 'Did Not Start', 'Disqualified', 'Collision damage', 'Engine', ''][(driver + round) % 9 + 1] as status from results)
select season, round, driver, case when coalesce(status, '') = '' then 'UNKNOWN' when status in ('Finished', 'Lapped') or regexp_matches(status, '^\\+\\d') then 'FINISHED' when status = 'Did Not Start' then 'DNS' when status = 'Disqualified' then 'DSQ' else 'DNF' end as label,
 coalesce(status, '') in ('Disqualified', 'Collision damage', 'Engine') as is_dnf, case when status in ('Disqualified', 'Collision damage', 'Engine') then left(upper(status), 12) end as reason from s""", "results"),
    "prediction_blend": sql(""", a as (select *, greatest(cast(0.45 as double) - least(cast(round - 1 as double) / 10, cast(0.9 as double)) * cast(0.25 as double), cast(0.15 as double)) as w, 1000 // grid as g,
 least(cast(0.30 as double) + least(1, greatest(0, cast(round - 1 as double) / 24)) * cast(0.65 as double), cast(0.95 as double)) as confidence from results),
b as (select *, cast(g as double) / sum(g) over (partition by season, round) as win, cast(points + 1 as double) / sum(points + 1) over (partition by season, round) as prior from a),
c as (select *, (1 - w) * win + w * prior as mixed, least((1 - w) * least(3 * win, 1) + w * least(3 * prior, 1), 1) as podium from b),
d as (select *, mixed / greatest(cast(0.001 as double), 1 - (grid - 1) * cast(0.08 as double)) as upset, cast(case when grid <= 10 and mixed < cast(0.004 as double) then 0.004 when grid <= 5 and mixed < cast(0.008 as double) then 0.008 else round(mixed, 4) end as decimal(10,4)) as floored from c),
e as (select *, grid >= 5 and mixed >= cast(0.08 as double) and upset >= 2 as is_upset, round(cast(floored as double) / cast(sum(floored) over (partition by season, round) as double), 4) as win_probability, round(podium, 4) as podium_probability from d)
select season, round, driver, win_probability, podium_probability, round(confidence, 3) as confidence, is_upset, case when is_upset then round(upset - 1, 3) else 0 end as upset_score,
 row_number() over (partition by season, round order by points desc, podium_probability desc, win_probability desc, driver) as predicted_position from e""", "results"),
    "race_distance": sql("select distinct season, round, case when round % 4 <> 0 then round + 50 when round = 4 then 71 when round = 8 then 44 else 58 end as laps from results", "results"),
    "calendar_normal": """with c as (select year(o_orderdate) as season, cast(o_orderdate as date) as day, case when o_custkey % 2 = 0 then ' City' || (o_custkey % 7) || ' ' else 'CITY' || (o_custkey % 7) end as circuit, o_orderkey as id from orders)
select season, strftime(day, '%Y-%m-%d') as day, lower(trim(circuit)) as name, min(id) as id, arg_min(trim(circuit), id) as circuit, max(id) as newest from c group by 1, c.day, 3""",
    "strategy_table": sql(", p as (select season, round, driver, count(*) filter (where sector = 7) as seen, count(distinct compound) as compounds, min(lap) filter (where sector = 7) as first_stop, count(*) as laps from laps group by 1, 2, 3) select season, round, driver, nullif(case when seen > 0 then seen else compounds - 1 end, 0) as stops, first_stop, laps from p", "laps"),
    "interval_join_laps": sql(""", s as (select entity as car, published_at as start, row_number() over w as lap, least(coalesce(lead(published_at) over w, published_at + interval 6 hours), published_at + interval 6 hours) as stop from feed where cluster = 'click' window w as (partition by entity order by published_at))
select guid as point, entity as car, lap from feed join s on entity = car and published_at >= start and published_at < stop where cluster = 'view'""", "feed"),
    "career_rollup": sql(""", s as (select season, driver, count(*) as races, count(*) filter (where finish = 1) as wins, count(*) filter (where finish <= 3) as podiums, sum(points) as points from results group by 1, 2),
r as (select *, row_number() over (partition by season order by points desc, wins desc, driver) as place from s)
select driver, sum(races) as races, sum(wins) as wins, sum(podiums) as podiums, sum(points) as points, count(*) as seasons, count(*) filter (where place = 1) as titles, max(season) as last_season from r group by 1""", "results"),
    "null_profile": sql(f", {_SLOTS}, u as (" + " union all ".join(f"select '{c}' as feature, cast({c} as double) as v from slots" for c in ("grid", "slot", "finish", "points")) + ") select feature, count(*) as n, round(avg(case when v is null then 1.0 else 0.0 end), 6) as null_share, round(avg(v), 6) as mean, min(v) as low, max(v) as high from u group by 1", "results"),
    "train_test_split": sql("select case when season = (select max(season) from results) then 'test' else 'train' end as part, count(*) as n, count(distinct season * 100 + round) as races, count(distinct driver) as drivers, round(avg(finish), 4) as mean_finish from results group by 1", "results"),
    "points_concentration": sql(", p as (select season, team, sum(points) as p from results group by 1, 2) select season, round(cast(sum(p * p) as double) / nullif(sum(p) * sum(p), 0), 6) as index, case when max(p) > cast(0.45 as double) * sum(p) then cast(list(team order by p desc, team)[1] as varchar) else 'balanced' end as dominant from p group by 1", "results"),
    "lap_coordinates": sql("select season, round, driver, lap, round(coalesce((lap_ms - min(lap_ms) over w) / nullif(max(lap_ms) over w - min(lap_ms) over w, 0), 0), 5) as x, round(coalesce((tyre_life - min(tyre_life) over w) / nullif(max(tyre_life) over w - min(tyre_life) over w, 0), 0), 5) as y from laps window w as (partition by season, round)", "laps"),
    "live_top_three": sql(f", {_TOP} select * from top", "laps"),
    "race_windows": sql("select season, round, greatest(date_diff('day', cast(min(run_at) as date), cast(max(run_at) as date)) + 1, 4) as days from laps group by 1, 2", "laps"),
    "lap_labels": sql(f""", {_TOP}, m as (select *, cast(round(best) as bigint) as ms from top) select season, round, driver, (ms // 60000) || ':' || lpad(cast(ms % 60000 // 1000 as varchar), 2, '0') || '.' || lpad(cast(ms % 1000 as varchar), 3, '0') as lap_time,
 ms as read_back, 'P' || place as label, case when place = 2 then null else place end as safe from m""", "laps"),
    "days_since_spike": sql(", m as (select cluster, day, max(day) over (partition by cluster) as last, mentions > cast(1.2 as double) * avg(mentions) over (partition by cluster) as high from daily) select cluster, min(date_diff('day', day, last)) filter (where high) as days from m group by 1", "feed", "daily"),
}
