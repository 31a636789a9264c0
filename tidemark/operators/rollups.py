"""Minute, hour and day statistics, presence, and representation sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import DIMENSIONS, classify_signal
from ..functions.numbers import rounded
from ..functions.times import DAY, HOUR, div, minute_of
from .curves import dense_curve, running_sum

SLICE = ["platform", "country", "video_resolution", "content_id"]


def narrow_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas without content."""
    return deltas.groupBy("minute", "platform", "country", "video_resolution").agg(F.sum("delta_sessions").alias("delta_sessions"), F.sum("delta_open").alias("delta_open"))


def open_minutes(spans: DataFrame) -> DataFrame:
    return spans.select("session", *DIMENSIONS, F.explode(F.sequence("first_minute", F.col("close_minute") - 1)).alias("minute"))


def _presence(active: DataFrame, opened: DataFrame) -> DataFrame:
    flag = lambda df, a: df.select("session", *DIMENSIONS, "minute", F.lit(a).alias("is_active"), F.lit(1 - a).alias("is_open"))
    return flag(active, 1).unionByName(flag(opened, 0))


def occupied_stats(presence: DataFrame, sketches: bool = False) -> DataFrame:
    """Sessions and users by minute and slice of rows ``session, dims, minute, is_active, is_open``, a flag at most once for
    each session and minute."""
    own = lambda flag, c: F.when(F.col(flag) == 1, F.col(c))
    users = (
        [F.hll_sketch_agg(own(f"is_{k}", "user_id"), F.lit(14)).alias(f"{k}_users_sketch") for k in ("active", "open")]
        if sketches
        else [F.countDistinct(own(f"is_{k}", "user_id")).alias(f"{k}_users") for k in ("active", "open")]
    )
    return presence.groupBy("minute", *SLICE).agg(*[F.sum(f"is_{k}").alias(f"{k}_sessions") for k in ("active", "open")], *users)


def minute_stats(active: DataFrame, opened: DataFrame, sketches: bool = False) -> DataFrame:
    """R2: sessions and users active and open in each minute and slice, from true run ends.

    With ``sketches`` the users are mergeable HLL sketches (columns ``*_sketch``) for rollups; otherwise exact counts.
    """
    return occupied_stats(_presence(active, opened), sketches)


def rolled_stats(stats: DataFrame, size: int) -> DataFrame:
    """Peak and mean sessions over the slice's present minutes, by hour (60) or day (1440), sketches merged."""
    merged = [F.hll_union_agg(c).alias(c) for c in stats.columns if c.endswith("_sketch")]
    values = [f(c).alias(f"{n}_{c}") for c in ("active_sessions", "open_sessions") for n, f in (("peak", F.max), ("avg", lambda x: rounded(F.avg(x), 4)))]
    return stats.groupBy((div("minute", size) * size).alias("bucket"), *SLICE).agg(*values, *merged)


def estimated_users(stats: DataFrame) -> DataFrame:
    """Sketch columns as distinct-count estimates."""
    return stats.select(*[F.hll_sketch_estimate(c).alias(c.replace("_sketch", "")) if c.endswith("_sketch") else F.col(c) for c in stats.columns])


def users_minute(active: DataFrame, content: DataFrame, sketches: bool = False) -> DataFrame:
    """Distinct people by minute, platform, country and video type."""
    typed = active.join(content.select("content_id", "video_type"), "content_id", "left").fillna("unknown", ["video_type"])
    users = F.hll_sketch_agg("user_id", F.lit(14)).alias("users_sketch") if sketches else F.countDistinct("user_id").alias("users")
    return typed.groupBy("minute", "platform", "country", "video_type").agg(users)


def present_events(events: DataFrame) -> DataFrame:
    """Events that show presence by themselves: no pause, download, backgrounding or session end."""
    return events.where(~F.lower("event").like("download%") & ~classify_signal().isin("PAUSE", "BG", "END"))


def presence_minute(events: DataFrame, by: Sequence[str] = ("content_id", "platform", "country", "video_type"), sketches: bool = False) -> DataFrame:
    """Sessions and users with a sign of presence in each minute and slice, without any state."""
    rows = present_events(events).groupBy(minute_of("event_ms").alias("minute"), *by)
    if sketches:
        return rows.agg(F.hll_sketch_agg("session", F.lit(14)).alias("sessions_sketch"), F.hll_sketch_agg("user_id", F.lit(14)).alias("users_sketch"))
    return rows.agg(F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users"))


def content_estimated_end(deltas: DataFrame, content: DataFrame) -> DataFrame:
    """Each content's last deactivation minute, flagged as an estimate; null and 0 where it was never active."""
    ends = deltas.where("delta_sessions < 0").groupBy("content_id").agg(F.max("minute").alias("scheduled_end_minute"))
    return content.select("content_id").join(ends, "content_id", "left").withColumn("end_is_estimated", F.when(F.col("scheduled_end_minute").isNotNull(), 1).otherwise(0))


def minute_serving(active: DataFrame, line: DataFrame, spans: DataFrame) -> DataFrame:
    """Active sessions and users, sessions with any event, first and last sessions, by minute, platform and country."""
    by = ["minute", "platform", "country"]
    fg = active.groupBy(*by).agg(F.count("*").alias("active_sessions"), F.countDistinct("user_id").alias("active_users"))
    naive = line.groupBy(minute_of("event_ms").alias("minute"), "platform", "country").agg(F.countDistinct("session").alias("naive_sessions"))
    new = spans.groupBy(F.col("first_minute").alias("minute"), "platform", "country").agg(F.count("*").alias("new_sessions"))
    ended = line.where("signal = 'END'").groupBy("session", "platform", "country").agg(F.min(minute_of("event_ms")).alias("minute")).groupBy(*by).agg(F.count("*").alias("ended_sessions"))
    out = fg
    for other in (naive, new, ended):
        out = out.join(other, by, "full_outer")
    return out.fillna(0)


def hour_anchors(deltas: DataFrame, start: int, end: int) -> DataFrame:
    """The absolute concurrency at each full hour, so that a reader needs one anchor and 60 minutes at most."""
    return dense_curve(deltas, start, end).where(F.col("minute") % HOUR == 0).select(F.col("minute").alias("hour"), "concurrency")


ANCHOR_SLICE = ["platform", "country", "video_resolution", "content_id"]


def slice_anchors(deltas: DataFrame, by: Sequence[str] = ANCHOR_SLICE) -> DataFrame:
    """R9 by slice: ``by, hour, delta_sessions, delta_open``, the sums of all deltas before each full hour, where they are not
    both zero.  A slice's changes are summed by hour first; between two changes its level is repeated."""
    values = ["delta_sessions", "delta_open"]
    hours = deltas.groupBy(*by, (div("minute", HOUR) * HOUR).alias("minute")).agg(*[F.sum(v).alias(v) for v in values])
    levels = running_sum(hours, values, by)
    following = F.lead("minute").over(W.partitionBy(*by).orderBy("minute"))  # hours of one slice, not its deltas
    held = levels.withColumn("_next", F.coalesce(following, F.col("minute") + HOUR)).where("delta_sessions <> 0 OR delta_open <> 0")
    return held.select(*by, F.explode(F.sequence(F.col("minute") + HOUR, "_next", F.lit(HOUR).cast("long"))).alias("hour"), *values)


def slice_members(deltas: DataFrame, dims: Sequence[str] = ANCHOR_SLICE) -> DataFrame:
    """``dimension, value, first_minute``: every value of each dimension and when it is first seen."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("m")
    return deltas.select("minute", each).groupBy("m.dimension", "m.value").agg(F.min("minute").alias("first_minute"))


def representation_row_counts(events: DataFrame, minutes: DataFrame, intervals: DataFrame, runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rows that each representation of the same history takes, deltas also by grouping set."""
    count = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("representation"), "rows")
    sets = deltas.where("delta_sessions <> 0").groupingSets([[F.col("minute")], [F.col("minute"), F.col("platform")], [F.col("minute"), F.col("platform"), F.col("content_id")]], F.col("minute"), F.col("platform"), F.col("content_id")).agg(F.grouping_id().alias("g"))
    named = sets.groupBy("g").agg(F.count("*").alias("rows")).select(F.when(F.col("g") == 3, "deltas_global").when(F.col("g") == 1, "deltas_platform").otherwise("deltas_platform_content").alias("representation"), "rows")
    out = named
    for df, name in ((events, "events"), (minutes, "session_minutes"), (intervals, "intervals"), (runs, "runs"), (deltas, "deltas")):
        out = out.unionByName(count(df, name))
    return out


def day_of(minute: str = "minute"):
    return div(minute, DAY)
