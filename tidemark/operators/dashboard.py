"""Dashboard, content, health and billing questions.

A session start is a run start: a current delta above zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import CONTENT_ATTRIBUTES
from ..functions.numbers import rounded
from ..functions.times import DAY, HOUR, MINUTE_MS, div
from .curves import SHORT, change_points, dense_curve, since, with_attribute

BUCKETS = {"minute": lambda: F.pmod("minute", F.lit(DAY)), "hour": lambda: div(F.pmod("minute", F.lit(DAY)), HOUR), "day": lambda: div("minute", DAY) * DAY}


def starts_in(deltas: DataFrame, start: int, end: int) -> DataFrame:
    return deltas.where((F.col("delta_sessions") > 0) & (F.col("minute") >= start) & (F.col("minute") < end))


def _list(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c)


def meta(deltas: DataFrame, content: DataFrame) -> DataFrame:
    """Minute bounds and the values of the filters, each list sorted and joined by '|'."""
    of_deltas = deltas.agg(F.min("minute").alias("min_minute"), F.max("minute").alias("max_minute"), _list("platform"), _list("country"))
    return of_deltas.join(content.agg(_list("video_type"), _list("category"), _list("show_name")))  # one row each


def dataset_info(events: DataFrame) -> DataFrame:
    """The newest event in whole seconds and the valid dimension values."""
    return events.agg((div(F.max("event_ms"), 1000) * 1000).alias("newest_ms"), *[_list(c) for c in ("platform", "country", "video_type", "category")])


def kpis(deltas: DataFrame, spans: DataFrame, start: int, end: int) -> DataFrame:
    """D3: peak, mean over all minutes, current, users with a start in the window, mean watch seconds of the sessions
    that began in it; negative concurrency counts as 0."""
    curve = dense_curve(deltas, start, end).withColumn("c", F.greatest("concurrency", F.lit(0)))
    level = curve.agg(F.max("c").alias("peak_concurrency"), rounded(F.avg("c"), 1).alias("avg_concurrency"), F.max_by("c", "minute").alias("current_concurrency"))
    users = starts_in(deltas, start, end).agg(F.countDistinct("user_id").alias("distinct_active_users"))
    spans = spans.where((F.col("first_ms") >= start * MINUTE_MS) & (F.col("first_ms") < end * MINUTE_MS))
    watch = spans.agg(rounded(F.coalesce(F.avg(div("last_ms", 1000) - div("first_ms", 1000)), F.lit(0.0)), 1).alias("avg_watch_seconds"))
    return level.join(users).join(watch)  # one row each


def traffic(deltas: DataFrame, start: int, end: int, grain: str = "hour") -> DataFrame:
    """Session starts by minute of day, hour of day or calendar day."""
    name = "bucket" if grain == "day" else "slot"
    return starts_in(deltas, start, end).groupBy(BUCKETS[grain]().alias(name)).agg(F.count("*").alias("value"))


def traffic_split(deltas: DataFrame, content: DataFrame, start: int, end: int, grain: str, split_by: str, top: int = 8) -> DataFrame:
    """D5 in long form: ``slot, series, value`` with the ``top`` series by total (ties by name) and the rest as 'Other';
    every slot has every series, 0 where nothing started."""
    starts = starts_in(deltas, start, end)
    rows = with_attribute(starts, content, split_by) if split_by in CONTENT_ATTRIBUTES else starts
    counted = rows.groupBy(BUCKETS[grain]().alias("slot"), F.col(split_by).alias("series")).agg(F.count("*").alias("n"))
    best = counted.groupBy("series").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "series").limit(top).select("series", F.lit(1).alias("_top"))
    named = counted.join(F.broadcast(best), "series", "left").withColumn("series", F.when(F.col("_top") == 1, F.col("series")).otherwise("Other"))
    cells = named.groupBy("slot", "series").agg(F.sum("n").alias("value"))
    # the series are top + 1 at most; every slot gets them as one small array
    names = cells.agg(F.array_sort(F.collect_set("series")).alias("names"))
    axis = cells.select("slot").distinct().join(F.broadcast(names)).select("slot", F.explode("names").alias("series"))
    return axis.join(cells, ["slot", "series"], "left").fillna(0, ["value"])


def traffic_wide(split: DataFrame, series: Sequence[str]) -> DataFrame:
    """D5 as the chart takes it: one column for each series."""
    return split.groupBy("slot").pivot("series", list(series)).agg(F.sum("value")).fillna(0)


def geo(deltas: DataFrame, start: int, end: int) -> DataFrame:
    """Starts, users and share of all starts by country."""
    rows = starts_in(deltas, start, end).groupBy("country").agg(F.count("*").alias("sessions"), F.countDistinct("user_id").alias("users"))
    return rows.withColumn("share_pct", rounded(100.0 * F.col("sessions") / F.sum("sessions").over(W.partitionBy()), 2))


def content_ranking(deltas: DataFrame, content: DataFrame, start: int, end: int, limit: int = 20) -> DataFrame:
    """The contents with most starts (ties by id) and their newest metadata."""
    top = starts_in(deltas, start, end).groupBy("content_id").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "content_id").limit(limit)
    names = content.select("content_id", "title", "video_type", "category").join(F.broadcast(top.select("content_id")), "content_id", "left_semi")
    named = top.join(F.broadcast(names), "content_id", "left")  # both have ``limit`` rows at most
    return named.withColumn("title", F.coalesce("title", F.concat(F.lit("Content "), F.col("content_id").cast("string")))).fillna("unknown", ["video_type", "category"])


def content_metadata(content: DataFrame, ends: DataFrame, content_id: int) -> DataFrame:
    """Newest attributes and estimated end of one content."""
    return content.where(F.col("content_id") == content_id).select("content_id", *CONTENT_ATTRIBUTES).join(ends, "content_id", "left")


def health_signals(events: DataFrame, start: int, end: int, by: Sequence[str] = ("content_id",)) -> DataFrame:
    """Error and buffering share of the events in the window, for one or (``by``) every content."""
    rows = events.where((F.col("event_ms") >= start * MINUTE_MS) & (F.col("event_ms") < end * MINUTE_MS))
    counts = rows.groupBy(*by).agg(F.count_if(F.col("event_type") == "VideoError").alias("errors"), F.count_if((F.col("event_type") == "VideoHeartbeat") & (F.col("event") == "BufferStart")).alias("buffers"), F.count("*").alias("total_events"))
    total = F.greatest("total_events", F.lit(1))
    return counts.select(*by, rounded(F.col("errors") / total, 6).alias("error_rate"), rounded(F.col("buffers") / total, 6).alias("buffer_rate"), "total_events")


def billable_impressions(deltas: DataFrame, advertisers: DataFrame, start: int, end: int) -> DataFrame:
    """D10 for every advertiser: the running concurrency of its contents at the last change minute in the window, 0
    without one.  Deltas are summed by content and minute before they meet the advertiser map."""
    steps = since(deltas, start, end).where(F.col("delta_sessions") != 0).groupBy("content_id", "minute").agg(F.sum("delta_sessions").alias("delta_sessions"))
    mapped = steps.join(advertisers, "content_id")
    points = change_points(mapped, ["advertiser_id"], end - start <= SHORT).where(F.col("minute") >= start)
    last = points.groupBy("advertiser_id").agg(F.max_by("cc", "minute").alias("impressions"))
    return advertisers.select("advertiser_id").distinct().join(last, "advertiser_id", "left").fillna(0, ["impressions"])


def billing_reconciliation(served: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Served against recomputed impressions and the drift in percent of the recomputed."""
    both = served.select("advertiser_id", F.col("impressions").alias("served")).join(recomputed.select("advertiser_id", F.col("impressions").alias("recomputed")), "advertiser_id", "full_outer").fillna(0)
    return both.withColumn("drift_pct", rounded(100.0 * (F.col("served") - F.col("recomputed")) / F.greatest("recomputed", F.lit(1)), 4))


def advertiser_content(advertisers: DataFrame) -> DataFrame:
    """Contents per advertiser; a content may have several."""
    return advertisers.groupBy("advertiser_id").agg(F.countDistinct("content_id").alias("contents"), F.min("content_id").alias("first_content"), F.max("content_id").alias("last_content"))
