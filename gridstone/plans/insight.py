"""Signals of daily series: a row per cluster and day with mentions, tone and negative counts (sources.tables.daily)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expressions import cascade, clamp, ratio
from gridstone.sources.tables import daily, sql


def placed(days: DataFrame) -> DataFrame:
    """Days with `back`, 0 for a series' newest day, and n, its number of days."""
    w = W.partitionBy("cluster")
    return days.withColumn("back", F.row_number().over(w.orderBy(F.desc("day"))) - 1).withColumn("n", F.count("*").over(w))


def _mean(value: str, low: int, high: int) -> Column:
    return F.avg(F.when(F.col("back").between(low, high), F.col(value)))


def trend(days: DataFrame) -> DataFrame:
    """Slope of two weeks, exponential average (0.3), breakout of the last week against what came before, and phase.

    The recursive average is the closed sum of 0.3 * 0.7^back, the first day taking what is left.
    """
    p = placed(days).where("n >= 3")
    weight = F.when(F.col("back") == F.col("n") - 1, F.pow(F.lit(0.7), "back")).otherwise(0.3 * F.pow(F.lit(0.7), "back"))
    early = F.col("back") >= F.least(F.lit(7), F.col("n") - 1)
    two_weeks = F.col("back") <= 13
    s = p.groupBy("cluster").agg(
        F.regr_slope(F.when(two_weeks, F.col("mentions").cast("double")), F.when(two_weeks, -F.col("back").cast("double"))).alias("slope"),
        F.sum(weight * F.col("mentions")).alias("ewma"), _mean("mentions", 0, 6).alias("recent"), F.avg(F.when(early, F.col("mentions"))).alias("base"),
        F.stddev_pop(F.when(early, F.col("mentions"))).alias("spread"), _mean("mentions", 0, 2).alias("last3"), _mean("mentions", 3, 5).alias("prev3"),
    )
    size = F.coalesce(ratio(F.col("recent") - F.col("base"), F.col("spread")), F.lit(0.0))
    out = F.col("size") > 1.5
    phase = cascade([(out & (F.col("slope") > 0), "breakout"), (out, "peak"), (F.col("last3") < 0.7 * F.coalesce("prev3", F.lit(0)), "declining"), (F.col("last3") > 1.3 * F.coalesce("prev3", F.lit(0)), "emerging")], "stable")
    return s.withColumn("size", size).select("cluster", F.round("slope", 4).alias("slope"), F.round("ewma", 4).alias("ewma"), F.round("size", 4).alias("size"), phase.alias("phase"))


def profile(days: DataFrame) -> DataFrame:
    """Spread of the tone and how its change over the second half differs from that over the first."""
    p = placed(days).withColumn("k", F.col("n") - 1 - F.col("back")).withColumn("mid", F.floor(F.col("n") / 2))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("tone")))
    s = p.groupBy("cluster", "n").agg(F.stddev_pop("tone").alias("volatility"), at(0).alias("a"), at(F.col("mid") - 1).alias("b"), at(F.col("mid")).alias("c"), at(F.col("n") - 1).alias("d"), F.sum("negative").alias("negative"), F.sum("mentions").alias("mentions"))
    first = F.when(F.floor(F.col("n") / 2) > 1, F.col("b") - F.col("a")).otherwise(0.0)
    return s.select("cluster", F.round("volatility", 5).alias("volatility"), F.round(F.col("d") - F.col("c") - first, 5).alias("acceleration"), F.round(F.col("negative") / F.col("mentions"), 5).alias("negative_share"))


def anomalies(days: DataFrame, most: int = 12) -> DataFrame:
    """Spikes, drops, reversals and extremes of tone and silences: the strongest few of each series of five days or more."""
    whole, run = W.partitionBy("cluster"), W.partitionBy("cluster").orderBy("day")
    z = lambda v: F.coalesce(ratio(F.col(v) - F.avg(v).over(whole), F.stddev_pop(v).over(whole)), F.lit(0.0))
    p = days.select("cluster", "day", "mentions", "tone", z("mentions").alias("mz"), z("tone").alias("tz"), F.stddev_pop("tone").over(whole).alias("ts"), F.avg("mentions").over(whole).alias("mean"), F.lag("tone").over(run).alias("before"), F.count("*").over(whole).alias("n"))
    p = p.withColumn("quiet", (F.col("mentions") < 0.2 * F.col("mean")).cast("int")).withColumn("active", F.col("mentions") > F.col("mean"))
    p = p.withColumn("quiet3", F.sum("quiet").over(run.rowsBetween(-2, 0))).withColumn("active_before", F.lag("active", 3).over(run)).withColumn("followed", F.lead("day").over(run).isNotNull())
    swing = F.abs(F.col("tone") - F.col("before"))
    turned = (swing > 0.3) & (F.signum("tone") != F.signum("before"))
    tests = [
        (F.col("mz") > 2, "spike", F.col("mz")),
        ((F.col("mz") < -1.5) & (F.col("mentions") < 0.4 * F.col("mean")), "drop", -F.col("mz")),
        (turned, "sentiment_reversal", swing / F.greatest("ts", F.lit(0.01))),
        ((F.abs("tz") > 2.2) & ~turned, "sentiment_spike", F.abs("tz")),
        ((F.col("quiet3") == 3) & F.col("active_before") & F.col("followed"), "silence", F.lit(2.0)),
    ]
    kinds = F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), size.alias("size"))) for test, kind, size in tests])
    rows = p.where("n >= 5 and before is not null").select("cluster", "day", F.explode(F.array_compact(kinds)).alias("a")).select("cluster", F.date_format("day", "yyyy-MM-dd").alias("day"), "a.kind", F.round("a.size", 4).alias("size"))
    top = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("size"), "day", "kind"))
    return rows.withColumn("k", top).where(F.col("k") <= most).drop("k")


def predictive(days: DataFrame) -> DataFrame:
    """Ramp of the week, momentum of three days and tone build-up as one score of 0 to 100."""
    p = placed(days).where("n >= 5")
    five = F.col("back") <= 4
    s = p.groupBy("cluster").agg(
        (_mean("mentions", 0, 2) - F.coalesce(_mean("mentions", 3, 5), F.lit(0))).alias("momentum"), F.regr_slope(F.when(five, F.col("tone")), F.when(five, -F.col("back").cast("double"))).alias("slope"),
        F.max(F.when(F.col("back") == 0, F.col("tone"))).alias("tone"), _mean("mentions", 0, 6).alias("week"), F.coalesce(_mean("mentions", 7, 13), F.lit(0)).alias("last"),
    )
    ramp = F.when(F.col("last") > 0, (F.col("week") - F.col("last")) / F.nullif(F.col("last"), F.lit(0)) * 100).otherwise(0.0)
    build = F.abs("slope") * 10 + F.abs("tone") * 5
    score = F.floor(F.round(clamp(ramp / 2, 0, 40) + clamp(F.col("momentum") * 2, 0, 30) + clamp(build * 2, 0, 30), 6) + 0.5)
    way = cascade([((F.col("slope") > 0.02) & (F.col("momentum") > 0), "up"), ((F.col("slope") < -0.02) & (F.col("momentum") < 0), "down")], "neutral")
    return s.select("cluster", F.round(ramp, 3).alias("ramp"), F.round("momentum", 4).alias("momentum"), F.round("slope", 5).alias("slope"), score.cast("bigint").alias("score"), way.alias("direction"))


#: Series that are compared with each other: those with the most mentions.
FOREMOST = 200


def foremost(days: DataFrame, most: int = FOREMOST) -> DataFrame:
    """The rows of the series with the most mentions (ties: the first by name): pairs of series are bounded by it, whatever their number."""
    top = days.groupBy("cluster").agg(F.sum("mentions").alias("m")).orderBy(F.desc("m"), "cluster").limit(most).select("cluster")
    return days.join(F.broadcast(top), "cluster", "left_semi")


def correlations(days: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of the foremost series with enough common days: correlation of mentions and tone, combined, and what they are to each other.

    Series meet on the day; the sums of a pair are combined before they are shuffled.
    """
    days = foremost(days)
    a = days.select("day", F.col("cluster").alias("a"), F.col("mentions").alias("am"), F.col("tone").alias("at"))
    b = days.select("day", F.col("cluster").alias("b"), F.col("mentions").alias("bm"), F.col("tone").alias("bt"))
    c = a.join(b, "day").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("am", "bm").alias("m"), F.corr("at", "bt").alias("t")).where(F.col("n") >= least)
    c = c.select("a", "b", F.coalesce(F.nanvl("m", F.lit(0.0)), F.lit(0.0)).alias("m"), F.coalesce(F.nanvl("t", F.lit(0.0)), F.lit(0.0)).alias("t"))
    m, t = F.col("m"), F.col("t")
    kind = cascade([((m > 0.6) & (t < -0.3), "rivals"), ((m > 0.5) & (t > 0.4), "narrative-linked"), (m > 0.5, "co-trending"), (m < -0.3, "inverse")], "independent")
    both = m * 0.6 + t * 0.4
    return c.select("a", "b", F.round(m, 5).alias("mention_corr"), F.round(t, 5).alias("tone_corr"), F.round(both, 5).alias("combined"), kind.alias("relation"), cascade([(F.abs(both) > 0.6, "strong"), (F.abs(both) > 0.35, "moderate")], "weak").alias("strength"))


def influence(days: DataFrame) -> DataFrame:
    """Share of mentions, tone, heavy days and activity, each scaled to 0..1 over all series, weighted .45/.20/.20/.15."""
    s = days.groupBy("cluster").agg(F.sum("mentions").cast("double").alias("m"), F.avg("tone").alias("t"), F.sum("heavy").cast("double").alias("h"), F.count("*").cast("double").alias("d"))
    bounds = s.agg(*[f(c).alias(f"{k}_{c}") for c in "mthd" for k, f in (("lo", F.min), ("hi", F.max))])  # one row
    score = lambda c: F.coalesce(ratio(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.5))
    return s.crossJoin(F.broadcast(bounds)).select("cluster", F.round(100 * (0.45 * score("m") + 0.20 * score("t") + 0.20 * score("h") + 0.15 * score("d")), 3).alias("influence"))


def velocity(days: DataFrame) -> DataFrame:
    """Mentions of the last seven days of a series and of the seven before."""
    p = placed(days).groupBy("cluster").agg(F.sum(F.when(F.col("back") < 7, F.col("mentions"))).alias("week"), F.coalesce(F.sum(F.when(F.col("back").between(7, 13), F.col("mentions"))), F.lit(0)).alias("before"))
    return p.withColumn("change", F.round(ratio(100.0 * (F.col("week") - F.col("before")), F.col("before")), 3))


def _d(f):
    return lambda s, d: f(daily(s, d))


QUERIES = {"trend_signal": _d(trend), "sentiment_profile": _d(profile), "anomalies": _d(anomalies), "predictive_signal": _d(predictive), "correlation_matrix": _d(correlations), "influence": _d(influence), "velocity_7d": _d(velocity)}

_PLACED = ", p as (select *, row_number() over (partition by cluster order by day desc) - 1 as back, count(*) over (partition by cluster) as n from daily)"
ORACLE_SQL = {
    "trend_signal": sql(_PLACED + """, s as (select cluster, regr_slope(mentions, -back) filter (where back <= 13) as slope, sum(case when back = n - 1 then 1 else 0.3 end * pow(0.7, back) * mentions) as ewma, avg(mentions) filter (where back <= 6) as recent,
 avg(mentions) filter (where back >= least(7, n - 1)) as base, stddev_pop(mentions) filter (where back >= least(7, n - 1)) as spread, avg(mentions) filter (where back <= 2) as last3, coalesce(avg(mentions) filter (where back between 3 and 5), 0) as prev3 from p where n >= 3 group by cluster),
z as (select *, coalesce((recent - base) / nullif(spread, 0), 0) as size from s) select cluster, round(slope, 4) as slope, round(ewma, 4) as ewma, round(size, 4) as size,
 case when size > 1.5 and slope > 0 then 'breakout' when size > 1.5 then 'peak' when last3 < 0.7 * prev3 then 'declining' when last3 > 1.3 * prev3 then 'emerging' else 'stable' end as phase from z""", "feed", "daily"),
    "sentiment_profile": sql(_PLACED + """, k as (select *, n - 1 - back as k, n // 2 as mid from p),
s as (select cluster, n, stddev_pop(tone) as v, max(tone) filter (where k = 0) as a, max(tone) filter (where k = mid - 1) as b, max(tone) filter (where k = mid) as c, max(tone) filter (where k = n - 1) as d, sum(negative) as neg, sum(mentions) as m from k group by 1, 2)
select cluster, round(v, 5) as volatility, round(d - c - case when n // 2 > 1 then b - a else 0 end, 5) as acceleration, round(neg / m, 5) as negative_share from s""", "feed", "daily"),
    "anomalies": sql(""", p as (select *, avg(mentions) over w as mean, stddev_pop(mentions) over w as ms, avg(tone) over w as tm, stddev_pop(tone) over w as ts, lag(tone) over r as before, count(*) over w as n, lead(day) over r is not null as followed
 from daily window w as (partition by cluster), r as (partition by cluster order by day)),
q as (select *, coalesce((mentions - mean) / nullif(ms, 0), 0) as mz, coalesce((tone - tm) / nullif(ts, 0), 0) as tz, abs(tone - before) > 0.3 and sign(tone) <> sign(before) as turned,
 sum(case when mentions < 0.2 * mean then 1 else 0 end) over (partition by cluster order by day rows 2 preceding) = 3 and lag(mentions > mean, 3) over (partition by cluster order by day) and followed as silent from p),
a as (select cluster, day, 'spike' as kind, mz as size from q where n >= 5 and before is not null and mz > 2 union all select cluster, day, 'drop', -mz from q where n >= 5 and before is not null and mz < -1.5 and mentions < 0.4 * mean
 union all select cluster, day, 'sentiment_reversal', abs(tone - before) / greatest(ts, 0.01) from q where n >= 5 and turned union all select cluster, day, 'sentiment_spike', abs(tz) from q where n >= 5 and before is not null and abs(tz) > 2.2 and not turned
 union all select cluster, day, 'silence', 2.0 from q where n >= 5 and before is not null and silent), z as (select cluster, strftime(day, '%Y-%m-%d') as day, kind, round(size, 4) as size from a)
select * from z qualify row_number() over (partition by cluster order by size desc, day, kind) <= 12""", "feed", "daily"),
    "predictive_signal": sql(_PLACED + """, s as (select cluster, avg(mentions) filter (where back <= 2) - coalesce(avg(mentions) filter (where back between 3 and 5), 0) as momentum, regr_slope(tone, -back) filter (where back <= 4) as slope,
 max(tone) filter (where back = 0) as tone, avg(mentions) filter (where back <= 6) as week, coalesce(avg(mentions) filter (where back between 7 and 13), 0) as last from p where n >= 5 group by cluster),
r as (select *, case when last > 0 then (week - last) / last * 100 else 0 end as ramp from s)
select cluster, round(ramp, 3) as ramp, round(momentum, 4) as momentum, round(slope, 5) as slope,
 cast(floor(round(least(40, greatest(0, ramp / 2)) + least(30, greatest(0, momentum * 2)) + least(30, greatest(0, 2 * (abs(slope) * 10 + abs(tone) * 5))), 6) + 0.5) as bigint) as score,
 case when slope > 0.02 and momentum > 0 then 'up' when slope < -0.02 and momentum < 0 then 'down' else 'neutral' end as direction from r""", "feed", "daily"),
    "correlation_matrix": sql(""", c as (select a.cluster as a, b.cluster as b, coalesce(corr(a.mentions, b.mentions), 0) as m, coalesce(corr(a.tone, b.tone), 0) as t from daily a join daily b on a.day = b.day and a.cluster < b.cluster group by 1, 2 having count(*) >= 5), s as (select *, m * 0.6 + t * 0.4 as k from c)
select a, b, round(m, 5) as mention_corr, round(t, 5) as tone_corr, round(k, 5) as combined, case when m > 0.6 and t < -0.3 then 'rivals' when m > 0.5 and t > 0.4 then 'narrative-linked' when m > 0.5 then 'co-trending' when m < -0.3 then 'inverse' else 'independent' end as relation,
 case when abs(k) > 0.6 then 'strong' when abs(k) > 0.35 then 'moderate' else 'weak' end as strength from s""", "feed", "daily"),
    "influence": sql(""", s as (select cluster, sum(mentions) as m, avg(tone) as t, sum(heavy) as h, count(*) as d from daily group by cluster)
select cluster, round(100 * (cast(0.45 as double) * coalesce((m - min(m) over ()) / nullif(max(m) over () - min(m) over (), 0), 0.5) + cast(0.2 as double) * coalesce((t - min(t) over ()) / nullif(max(t) over () - min(t) over (), 0), 0.5)
 + cast(0.2 as double) * coalesce((h - min(h) over ()) / nullif(max(h) over () - min(h) over (), 0), 0.5) + cast(0.15 as double) * coalesce((d - min(d) over ()) / nullif(max(d) over () - min(d) over (), 0), 0.5)), 3) as influence from s""", "feed", "daily"),
    "velocity_7d": sql(_PLACED + """, s as (select cluster, cast(sum(mentions) filter (where back < 7) as bigint) as week, cast(coalesce(sum(mentions) filter (where back between 7 and 13), 0) as bigint) as before from p group by cluster)
select *, round(100.0 * (week - before) / nullif(before, 0), 3) as change from s""", "feed", "daily"),
}
