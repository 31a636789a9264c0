"""Concurrency curves and what is read from them.

The running sum starts at the beginning of history; a time range only ever filters its output, dimension filters go below
it.  It is a two-level prefix sum: days are summed, an offset runs over the (few) days of each slice, and the window runs
inside a day, so no slice is ordered in one task over its whole history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import CONTENT_ATTRIBUTES
from ..functions.numbers import rounded
from ..functions.times import DAY, HOUR, MINUTE_MS, div
from .quantiles import joined

GRAINS = {"minute": 1, "hour": HOUR, "day": DAY}


SHORT = 7 * DAY


def running_sum(steps: DataFrame, values: Sequence[str], by: Sequence[str] = (), short: bool = False) -> DataFrame:
    """Replace ``values`` (one row per slice and minute) by their sums since the beginning of the slice's history.

    ``short``: the steps of a slice span few days, so one window orders them."""
    if short:
        so_far = W.partitionBy(*by).orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
        return steps.select(*by, "minute", *[F.sum(v).over(so_far).cast("long").alias(v) for v in values])
    days = steps.withColumn("_day", div("minute", DAY))
    earlier = W.partitionBy(*by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    base = days.groupBy(*by, "_day").agg(*[F.sum(v).alias(v) for v in values]).select(*by, "_day", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values])
    inside = W.partitionBy(*by, "_day").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    local = days.withColumns({v: F.sum(v).over(inside) for v in values})
    return joined(local, base, [*by, "_day"]).select(*by, "minute", *[(F.col(v) + F.col(f"_base_{v}")).cast("long").alias(v) for v in values])


def dim_filter(deltas: DataFrame, content: DataFrame | None = None, **dims) -> DataFrame:
    """Q2: equality (or IN, for a list) on delta columns and, through the content dimension, on its attributes; a null
    argument is no filter."""
    test = lambda df, k, v: df.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    asked = {k: v for k, v in dims.items() if v is not None}
    for k, v in asked.items():
        if k not in CONTENT_ATTRIBUTES:
            deltas = test(deltas, k, v)
    of_content = {k: v for k, v in asked.items() if k in CONTENT_ATTRIBUTES}
    if of_content:
        chosen = deltas.select("content_id").distinct().join(content.select("content_id", *CONTENT_ATTRIBUTES), "content_id", "left").fillna("unknown", CONTENT_ATTRIBUTES)
        for k, v in of_content.items():
            chosen = test(chosen, k, v)
        deltas = deltas.join(chosen.select("content_id"), "content_id", "left_semi")
    return deltas


def with_attribute(deltas: DataFrame, content: DataFrame, *attributes: str) -> DataFrame:
    return deltas.join(content.select("content_id", *attributes), "content_id", "left").fillna("unknown", list(attributes))


def minute_steps(deltas: DataFrame, by: Sequence[str] = (), values: Sequence[str] = ("delta_sessions",)) -> DataFrame:
    return deltas.groupBy(*by, "minute").agg(*[F.sum(v).cast("long").alias(v) for v in values])


def filled_steps(steps: DataFrame, start: int, end: int, by: Sequence[str] = (), values: Sequence[str] = ("delta_sessions",)) -> DataFrame:
    """Q3: add a zero step for every minute of [start, end) to every slice."""
    spark = steps.sparkSession
    axis = steps.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("minute")) if by else spark.range(start, end).select(F.col("id").alias("minute"))
    zero = axis.select(*by, F.col("minute").cast("long"), *[F.lit(0).cast("long").alias(v) for v in values])
    return steps.unionByName(zero).groupBy(*by, "minute").agg(*[F.sum(v).alias(v) for v in values])


def dense_curve(deltas: DataFrame, start: int, end: int, by: Sequence[str] = (), values: Mapping[str, str] | None = None) -> DataFrame:
    """Running sums at every minute of [start, end): ``by, minute`` and the renamed ``values``."""
    values = values or {"delta_sessions": "concurrency"}
    steps = filled_steps(minute_steps(since(deltas, start, end), by, list(values)), start, end, by, list(values))
    return running_sum(steps, list(values), by, end - start <= SHORT).where(F.col("minute") >= start).select(*by, "minute", *[F.col(k).alias(v) for k, v in values.items()])


def since(deltas: DataFrame, start: int, end: int) -> DataFrame:
    """The deltas before ``end``, with all history before ``start`` dated to the minute before it."""
    return deltas.where(F.col("minute") < end).withColumn("minute", F.greatest("minute", F.lit(start - 1)))


def change_points(deltas: DataFrame, by: Sequence[str] = (), short: bool = False) -> DataFrame:
    """Running sums at the minutes that have a delta."""
    return running_sum(minute_steps(deltas, by), ["delta_sessions"], by, short).withColumnRenamed("delta_sessions", "cc")


def concurrency_curve(deltas: DataFrame, start: int, end: int, grain: str = "minute", by: Sequence[str] = ()) -> DataFrame:
    """Q1: ``bucket, concurrency``; an hour or day shows its maximum."""
    curve = dense_curve(deltas, start, end, by)
    size = GRAINS[grain]
    return curve.groupBy(*by, (div("minute", size) * size).alias("bucket")).agg(F.max("concurrency").alias("concurrency"))


def _peak_minute(value: str = "concurrency", minute: str = "minute") -> Column:
    """The earliest minute of the highest value."""
    return F.max_by(minute, F.struct(F.col(value), -F.col(minute)))


def _occupied_mean(value: str = "concurrency") -> Column:
    return rounded(F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)), 4)


def peak_summary(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Q4, Q5: peak, its earliest minute, mean over occupied minutes and their number."""
    return curve.groupBy(*by).agg(F.max("concurrency").alias("peak"), _peak_minute().alias("peak_minute"), _occupied_mean().alias("avg_occupied"), F.count_if(F.col("concurrency") > 0).alias("occupied_minutes"))


def active_vs_open(deltas: DataFrame, start: int, end: int) -> DataFrame:
    """Q7: active and open sessions and the share that watches."""
    curve = dense_curve(deltas, start, end, values={"delta_sessions": "active", "delta_open": "open"})
    return curve.withColumn("pct_watching", rounded(100.0 * F.col("active") / F.greatest(F.col("open"), F.lit(1)), 1))


def unique_active_users(deltas: DataFrame, start: int, end: int) -> DataFrame:
    """Q8: distinct users with a run start in the window and the number of starts."""
    starts = deltas.where((F.col("minute") >= start) & (F.col("minute") < end) & (F.col("delta_sessions") > 0))
    return starts.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("starts"))


def hourly_summary(curve: DataFrame) -> DataFrame:
    """Q9: peak and occupied mean by hour."""
    return curve.groupBy((div("minute", HOUR) * HOUR).alias("hour")).agg(F.max("concurrency").alias("peak"), _occupied_mean().alias("avg_occupied"))


def get_peak(buckets: DataFrame) -> DataFrame:
    """Q10: the highest bucket, the earliest on ties; 0 and null for an empty curve."""
    return buckets.agg(F.coalesce(F.max("concurrency"), F.lit(0)).alias("peak_value"), _peak_minute("concurrency", "bucket").alias("peak_minute"))


def active_users_at(deltas: DataFrame, content_id: int, minute: int) -> DataFrame:
    """Q11: distinct users and sessions whose deltas up to ``minute`` are above zero."""
    known = deltas.where((F.col("content_id") == content_id) & (F.col("minute") <= minute))
    open_now = known.groupBy("session").agg(F.sum("delta_sessions").alias("net"), F.max_by("user_id", "minute").alias("user_id")).where("net > 0")
    return open_now.agg(F.countDistinct("user_id").alias("active_users"), F.count("*").alias("active_sessions"))


def trend(deltas: DataFrame, end: int, lookback: int = 10, dense: bool = False) -> DataFrame:
    """Q12: the change points (or, ``dense``, all minutes) of [end - lookback, end] with the change from the one before,
    its share, and the direction of the newest: rising, falling, flat, or insufficient_data below two points."""
    points = dense_curve(deltas, end - lookback - 1, end + 1).withColumnRenamed("concurrency", "cc") if dense else change_points(since(deltas, end - lookback, end + 1), short=lookback <= SHORT)
    day = W.orderBy("minute")  # a point a minute of the lookback
    stepped = points.where(F.col("minute") <= end).withColumn("delta", F.col("cc") - F.lag("cc", 1, 0).over(day))
    shown = stepped.where(F.col("minute") >= end - lookback).withColumn("pct_change", rounded(F.col("delta") / F.nullif(F.col("cc") - F.col("delta"), F.lit(0)), 6))
    every = W.partitionBy()
    newest = F.max_by("delta", "minute").over(every)
    direction = F.when(F.count("*").over(every) < 2, "insufficient_data").when(newest > 0, "rising").when(newest < 0, "falling").otherwise("flat")
    return shown.withColumn("direction", direction)


def predict_load(points: DataFrame, horizon: int = 10) -> DataFrame:
    """Q13: a straight line through the newest trend point, and what it asks for at 20% growth or decline."""
    last = points.agg(F.max_by("cc", "minute").alias("current"), F.max_by("delta", "minute").alias("slope"), F.max("direction").alias("direction"))
    predicted = F.greatest(F.lit(0), F.col("current") + F.col("slope") * horizon)
    growth = F.when(F.col("current") != 0, rounded((F.col("predicted") - F.col("current")) / F.col("current"), 6))
    action = F.when(F.coalesce(F.col("direction"), F.lit("insufficient_data")) == "insufficient_data", "insufficient_data").when(F.col("growth") >= 0.2, "scale_up").when(F.col("growth") <= -0.2, "scale_down").otherwise("hold")
    return last.withColumn("predicted", predicted).withColumn("growth", growth).withColumn("action", action).drop("direction")


def range_peak_avg(deltas: DataFrame, start: int, end: int) -> DataFrame:
    """Q14: peak at the change points of the range and the time-weighted mean over [start, end)."""
    points = change_points(since(deltas, start, end), short=end - start <= SHORT).withColumn("next", F.lead("minute", 1, end).over(W.orderBy("minute")))
    width = F.greatest(F.least("next", F.lit(end)) - F.greatest("minute", F.lit(start)), F.lit(0))
    inside = (F.col("minute") >= start) & (F.col("minute") < end)
    return points.agg(F.max(F.when(inside, F.col("cc"))).alias("peak"), rounded(F.coalesce(F.sum(F.when(F.col("minute") < end, F.col("cc") * width)), F.lit(0)) / (end - start), 4).alias("avg_time_weighted"))


def range_matrix(deltas: DataFrame, ranges: dict[str, tuple[int, int]], filters: dict[str, Column]) -> DataFrame:
    """Q14 for every range under every filter at once: each delta is marked with the filters it passes, so there is one
    running sum for each filter, whatever the number of ranges."""
    passed = F.array_compact(F.array(*[F.when(test, name) for name, test in filters.items()]))
    points = change_points(deltas.withColumn("filter_name", F.explode(passed)), ["filter_name"])
    after = F.lead("minute").over(W.partitionBy("filter_name").orderBy("minute"))
    asked = F.array(*[F.struct(F.lit(name).alias("range_name"), F.lit(a).cast("long").alias("_lo"), F.lit(b).cast("long").alias("_hi")) for name, (a, b) in ranges.items()])
    each = points.withColumn("_next", after).select("*", F.inline(asked))
    minute, lo, hi = F.col("minute"), F.col("_lo"), F.col("_hi")
    width = F.greatest(F.least(F.coalesce("_next", hi), hi) - F.greatest(minute, lo), F.lit(0))
    mean = rounded(F.sum(F.when(minute < hi, F.col("cc") * width)) / (hi - lo), 4)
    return each.groupBy("range_name", "filter_name", "_lo", "_hi").agg(F.max(F.when((minute >= lo) & (minute < hi), F.col("cc"))).alias("peak"), mean.alias("avg_time_weighted")).drop("_lo", "_hi")


def interval_overlap(intervals: DataFrame, start: int, end: int) -> DataFrame:
    lo, hi = start * MINUTE_MS, end * MINUTE_MS
    return intervals.where((F.col("start_ms") < hi) & (F.col("end_ms") > lo)).withColumns({"start_ms": F.greatest("start_ms", F.lit(lo)), "end_ms": F.least("end_ms", F.lit(hi))})


def interval_steps(intervals: DataFrame) -> DataFrame:
    step = lambda at, d: F.struct(F.col(at).alias("at_ms"), F.lit(d).alias("d"))
    rows = intervals.select(F.explode(F.array(step("start_ms", 1), step("end_ms", -1))).alias("_s")).select("_s.*")
    return rows.groupBy("at_ms").agg(F.sum("d").alias("d"))


def range_metrics(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Q16: exact peak, time-weighted mean, sessions and users of the intervals in [start, end).

    At one instant ends come before starts, so half-open intervals that only touch never overlap.
    """
    inside = interval_overlap(intervals, start, end)
    steps = interval_steps(inside).withColumn("minute", div("at_ms", MINUTE_MS))
    by_minute = running_sum(steps.groupBy("minute").agg(F.sum("d").alias("step")), ["step"]).select("minute", F.col("step").alias("after"))
    total = steps.groupBy("minute").agg(F.sum("d").alias("own")).join(by_minute, "minute").select("minute", (F.col("after") - F.col("own")).alias("base"))
    within = W.partitionBy("minute").orderBy("at_ms").rowsBetween(W.unboundedPreceding, 0)
    levels = steps.withColumn("local", F.sum("d").over(within)).join(total, "minute")
    peak = levels.agg(F.coalesce(F.max(F.col("local") + F.col("base")), F.lit(0)).alias("peak"))
    rest = inside.agg(rounded(F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0)) / ((end - start) * MINUTE_MS), 3).alias("avg_time_weighted"), F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users"))
    return peak.join(rest)  # one row each


def stabbing_join(intervals: DataFrame, points: DataFrame, at_ms: str, bucket_ms: int = HOUR * MINUTE_MS) -> DataFrame:
    """Every pair of an interval [start_ms, end_ms) and a point in it: both meet in buckets of time by an equi-join.  A point
    lies in one bucket, so each pair comes once."""
    buckets = F.sequence(div("start_ms", bucket_ms), div(F.col("end_ms") - 1, bucket_ms))
    spread = intervals.where("end_ms > start_ms").withColumn("_bucket", F.explode(buckets))
    return spread.join(points.withColumn("_bucket", div(at_ms, bucket_ms)), "_bucket").where((F.col(at_ms) >= F.col("start_ms")) & (F.col(at_ms) < F.col("end_ms"))).drop("_bucket")


def overlap_join(intervals: DataFrame, ranges: DataFrame, lo_ms: str, hi_ms: str, bucket_ms: int = HOUR * MINUTE_MS) -> DataFrame:
    """Every pair of an interval and a range [lo_ms, hi_ms) that overlap.  Both are spread over the buckets of time that they
    touch; a pair counts in the first bucket that both touch."""
    left = intervals.where("end_ms > start_ms").withColumns({"_from": div("start_ms", bucket_ms)}).withColumn("_bucket", F.explode(F.sequence("_from", div(F.col("end_ms") - 1, bucket_ms))))
    right = ranges.where(F.col(hi_ms) > F.col(lo_ms)).withColumn("_begin", div(lo_ms, bucket_ms)).withColumn("_bucket", F.explode(F.sequence("_begin", div(F.col(hi_ms) - 1, bucket_ms))))
    first = F.col("_bucket") == F.greatest("_from", "_begin")
    return left.join(right, "_bucket").where(first & (F.col("start_ms") < F.col(hi_ms)) & (F.col("end_ms") > F.col(lo_ms))).drop("_bucket", "_from", "_begin")


def range_audience(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """Q16 for any number of ``ranges(range_name, start_minute, end_minute)``: time-weighted mean, sessions and users of each."""
    asked = ranges.select("range_name", (F.col("start_minute") * MINUTE_MS).alias("_lo"), (F.col("end_minute") * MINUTE_MS).alias("_hi"))
    met = overlap_join(intervals, asked, "_lo", "_hi").withColumn("_ms", F.least("end_ms", "_hi") - F.greatest("start_ms", "_lo"))
    found = met.groupBy("range_name").agg(F.sum("_ms").alias("_ms"), F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users"))
    mean = rounded(F.coalesce("_ms", F.lit(0)) / (F.col("_hi") - F.col("_lo")), 3).alias("avg_time_weighted")
    return asked.join(found, "range_name", "left").select("range_name", mean, F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("users", F.lit(0)).alias("users"))


def concurrency_at(deltas: DataFrame, intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """Q17: the prefix sum at each ``at_minute`` of ``asked`` beside the count of intervals that cover the minute's first
    instant.  The asked minutes are zero steps of the running sum, so there may be any number of them."""
    asked = asked.select(F.col("at_minute").cast("long").alias("at_minute")).distinct()
    steps = deltas.select("minute", "delta_sessions").unionByName(asked.select(F.col("at_minute").alias("minute"), F.lit(0).cast("long").alias("delta_sessions")))
    prefix = running_sum(minute_steps(steps), ["delta_sessions"]).select(F.col("minute").alias("at_minute"), F.col("delta_sessions").alias("prefix_sum"))
    stab = stabbing_join(intervals, asked.withColumn("_at_ms", F.col("at_minute") * MINUTE_MS), "_at_ms").groupBy("at_minute").agg(F.count("*").alias("covering"))
    return asked.join(prefix, "at_minute").join(stab, "at_minute", "left").fillna(0, ["covering"])


def local_peaks(curve: DataFrame, n: int = 6, spacing: int = 15) -> DataFrame:
    """Q18: greedily the ``n`` highest minutes at least ``spacing`` apart, the earlier first on ties, for each day.

    The greedy choice runs over one day's array of at most 1440 minutes.
    """
    day = curve.groupBy(div("minute", DAY).alias("_day")).agg(F.sort_array(F.collect_list(F.struct((-F.col("concurrency")).alias("c"), F.col("minute").alias("m")))).alias("ranked"))
    empty = F.array().cast("array<struct<c:bigint,m:bigint>>")
    take = lambda picked, x: F.when((F.size(picked) < n) & ~F.exists(picked, lambda p: F.abs(p["m"] - x["m"]) < spacing), F.concat(picked, F.array(x))).otherwise(picked)
    return day.select(F.explode(F.aggregate("ranked", empty, take)).alias("p")).select(F.col("p.m").alias("minute"), (-F.col("p.c")).alias("concurrency"))


def decline_alert(curve: DataFrame, back: int = 5, share: float = 0.2) -> DataFrame:
    """Q21: minutes whose value fell by more than ``share`` against ``back`` minutes before, by a self-join on the shifted minute."""
    before = curve.select((F.col("minute") + back).alias("minute"), F.col("concurrency").alias("before"))
    return curve.join(before, "minute").where(F.col("before") > 0).withColumn("drop_share", rounded((F.col("before") - F.col("concurrency")) / F.col("before"), 6)).where(F.col("drop_share") > share)


def hour_seeded_curve(cut: DataFrame) -> DataFrame:
    """Q20: the running sum of hour-cut deltas inside each hour, all hours in parallel."""
    steps = cut.groupBy("hour", "minute").agg(F.sum("delta_sessions").alias("d")).where(F.col("minute") < F.col("hour") + HOUR)
    return steps.select("hour", "minute", F.sum("d").over(W.partitionBy("hour").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)).alias("concurrency"))


def compare_curves(actual: DataFrame, computed: DataFrame, floor: int = 3, share: float = 0.03) -> DataFrame:
    """Q25: both values of each minute, difference, share, whether it is within max(floor, share), and whether the minute is
    the worst (the first of the greatest difference)."""
    both = actual.select("minute", F.col("concurrency").alias("actual")).join(computed.select("minute", F.col("concurrency").alias("computed")), "minute", "full_outer").fillna(0, ["actual", "computed"])
    diff = F.col("computed") - F.col("actual")
    worst = both.agg(F.min_by("minute", F.struct(-F.abs(diff), F.col("minute"))).alias("_worst"))  # one row
    rows = both.withColumns({"diff": diff, "pct": rounded(100.0 * diff / F.greatest(F.col("actual"), F.lit(1)), 4), "ok": F.abs(diff) <= F.greatest(F.lit(float(floor)), share * F.col("actual"))})
    return rows.join(worst).withColumn("worst", F.col("minute") == F.col("_worst")).drop("_worst")
