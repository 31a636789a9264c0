"""The registered queries: each applies one operator with default parameters to the whole model of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.numbers import rounded
from ..functions.times import DAY, HOUR, MINUTE_MS, div, minute_of, shown
from ..operators import audience as A
from ..operators import checks as V
from ..operators import curves as Q
from ..operators import dashboard as D
from ..operators import deltas as S
from ..operators import gates as G
from ..operators import rollups as R
from ..sources import tables as IO
from ..sources.adapter import SessionData
from ..sources.serving import DeltaStore
from ..sources.shared import shared_path
from ..streaming import live
from .config import DEFAULT
from .oracle import DIMS_FOR_BREAKDOWN, HOURLY_SPLITS, MARK_MS, MIDNIGHT_MS, RANGES, W0, W1, WHOLE

MAIN_CONTENT = 49
HOUR_MS = 3_600_000


class Model(SessionData):
    """The source tables and the states derived from them, as lazy DataFrames."""

    start, end = W0, W1  # the minutes of the curves

    @cached_property
    def bounds(self) -> tuple[int, int]:
        """[first, last + 1) of the minutes that have deltas."""
        lo, hi = self.deltas.agg(F.min("minute"), F.max("minute")).first()
        return (0, 0) if lo is None else (lo, hi + 1)

    @cached_property
    def line(self) -> DataFrame:
        return G.timeline(self.events)

    @cached_property
    def states(self) -> DataFrame:
        return G.gate_states(self.line)

    @cached_property
    def segments(self) -> DataFrame:
        return G.liveness_segments(self.states)

    @cached_property
    def active(self) -> DataFrame:
        return G.active_segments(self.segments)

    @cached_property
    def intervals(self) -> DataFrame:
        return G.merge_touching(self.active)

    @cached_property
    def minutes(self) -> DataFrame:
        return S.session_minutes(self.active)

    @cached_property
    def runs(self) -> DataFrame:
        return S.minute_runs(self.minutes)

    @cached_property
    def spans(self) -> DataFrame:
        return S.session_spans(self.line)

    @cached_property
    def open_minutes(self) -> DataFrame:
        return R.open_minutes(self.spans)

    @cached_property
    def computed_deltas(self) -> DataFrame:
        return S.merged_deltas(S.active_deltas(self.runs), S.open_deltas(self.spans))

    @cached_property
    def store(self) -> DeltaStore:
        """The stored tables, which the read queries start from."""
        inputs = [f"{self.sf_dir}/{name}.parquet" for name in ("events", "part", "nation")]
        return DeltaStore(self.spark, inputs, lambda: self.computed_deltas, lambda: self.spans.select("session", "first_ms", "last_ms"))

    @cached_property
    def deltas(self) -> DataFrame:
        """The current deltas of the whole history."""
        return self.store.by_day.drop("part_day")

    def near(self, dim: str | None = None) -> DataFrame:
        """Deltas for curves over [start, end), without the days before; see ``DeltaStore.near``."""
        return self.store.near(self.start, self.end, dim)

    def curve_by(self, dim: str) -> DataFrame:
        """The curve of every value of a delta column or a content attribute."""
        deltas = self.near(dim) if dim in G.KEYS else Q.with_attribute(self.near("content_id"), self.content, dim)
        return Q.dense_curve(deltas, self.start, self.end, [dim])

    @cached_property
    def curve(self) -> DataFrame:
        return Q.dense_curve(self.near(), self.start, self.end)

    @cached_property
    def bare_events(self) -> DataFrame:
        """Events without content attributes, for questions that don't need the dimension."""
        return self.raw_events

    def filtered(self, **dims) -> DataFrame:
        return Q.dense_curve(Q.dim_filter(self.near(), self.content, **dims), self.start, self.end)

    def typed(self, *attributes: str) -> DataFrame:
        return Q.with_attribute(self.deltas, self.content, *attributes)


class WholeModel(Model):
    """The model with curves over the whole history instead of the default window."""

    start = property(lambda self: self.bounds[0])
    end = property(lambda self: self.bounds[1])


def _hours(intervals: DataFrame):
    return rounded(F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0)) / HOUR_MS, 4).alias("active_hours")


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _by_variant(m: Model, name: str, variants, measured: DataFrame) -> DataFrame:
    """``measured`` with a row for each variant, also for those without any."""
    names = m.spark.createDataFrame([(v,) for v in variants], f"{name} string")
    return names.join(measured, name, "left").fillna(0, ["intervals", "active_hours"])


def error_policy(m: Model) -> DataFrame:
    """Intervals and hours under each reading of an error."""
    policies = ("liveness", "inactive", "terminal")
    whole = G.merge_touching(G.policy_segments(m.events, policies), ["policy"]).groupBy("policy").agg(F.count("*").alias("intervals"), _hours(None))
    return _by_variant(m, "policy", policies, whole)


def gate_ablation(m: Model) -> DataFrame:
    """The measure with its gates added one by one."""
    segments = G.ablation_segments(m.states)
    whole = G.merge_touching(segments, ["variant"]).groupBy("variant").agg(F.count("*").alias("intervals"), _hours(None))
    minutes = S.session_minutes(segments, ["variant"]).groupBy("variant", "minute").agg(F.count("*").alias("n"))
    level = minutes.groupBy("variant").agg(F.max("n").alias("peak"), F.count("*").alias("occupied_minutes"))
    return _by_variant(m, "variant", G.VARIANTS, level.join(whole, "variant", "left")).fillna(0, ["occupied_minutes"])


def open_session_policy(m: Model) -> DataFrame:
    """Intervals and hours under each reading of sessions that are still open."""
    intervals = G.merge_touching(G.open_session_segments(m.events, MARK_MS), ["policy"])
    whole = intervals.groupBy("policy").agg(F.count("*").alias("intervals"), F.countDistinct("session").alias("sessions"), _hours(None))
    return _by_variant(m, "policy", ("P1", "P2", "P3"), whole).fillna(0, ["sessions"])


def timeout_sweep(m: Model, caps=(45, 60, 90, 120, 300)) -> DataFrame:
    """The peak under several timeouts; the gates are folded once, only the segment ends differ."""
    after = F.lead("event_ms").over(G._in_order())
    rows = m.states.withColumn("after", after).where(G.is_counted())
    each = rows.select("session", "event_ms", "after", F.explode(F.array(*[F.lit(c) for c in caps])).alias("timeout_s"))
    stop = F.least("after", F.col("event_ms") + F.col("timeout_s") * 1000)
    minutes = each.select("session", "timeout_s", F.explode(F.sequence(minute_of("event_ms"), minute_of(stop))).alias("minute")).distinct()
    return minutes.groupBy("timeout_s", "minute").agg(F.count("*").alias("n")).groupBy("timeout_s").agg(F.max("n").alias("peak"))


def average_variants(m: Model) -> DataFrame:
    """Q15: three means that are all called average."""
    of_curve = m.curve.agg(rounded(F.coalesce(F.avg(F.when(F.col("concurrency") > 0, F.col("concurrency"))), F.lit(0.0)), 4).alias("avg_occupied"), rounded(F.avg("concurrency"), 4).alias("avg_all"))
    inside = Q.interval_overlap(m.intervals, W0, W1)
    weighted = inside.agg(rounded(F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0)) / ((W1 - W0) * MINUTE_MS), 4).alias("avg_time_weighted"))
    return of_curve.join(weighted)  # one row each


def union_peak_vs_sum(m: Model) -> DataFrame:
    """Q19: the peak of a union is not the sum of the peaks."""
    of = lambda name, *p: m.filtered(platform=list(p)).agg(F.max("concurrency").alias(name))
    both = of("union_peak", "android", "ios").join(of("a", "android")).join(of("b", "ios"))  # one row each
    return both.select("union_peak", (F.col("a") + F.col("b")).alias("sum_of_peaks"))


def interval_curve(m: Model) -> DataFrame:
    """Intervals that cover each minute's first instant."""
    lo, hi = W0 * MINUTE_MS, W1 * MINUTE_MS
    first = F.greatest(div(F.col("start_ms") + MINUTE_MS - 1, MINUTE_MS), F.lit(W0))
    last = F.least(div(F.col("end_ms") - 1, MINUTE_MS), F.lit(W1 - 1))
    inside = m.intervals.where((F.col("start_ms") < hi) & (F.col("end_ms") > lo)).withColumns({"a": first, "b": last}).where("a <= b")
    return inside.select(F.explode(F.sequence("a", "b")).alias("minute")).groupBy("minute").agg(F.count("*").alias("concurrency"))


def phantom_audience(m: Model) -> DataFrame:
    """Q22: minutes in which more sessions count as watching than showed any presence."""
    si = R.present_events(m.bare_events).groupBy(minute_of("event_ms").alias("minute")).agg(F.countDistinct("session").alias("si"))
    both = m.curve.withColumnRenamed("concurrency", "sa").join(si, "minute", "left").fillna(0, ["si"])
    return both.withColumns({"diff": F.col("si") - F.col("sa"), "alert": F.col("sa") > F.col("si") * F.lit(1.02)})


def peak_minute_shift(m: Model) -> DataFrame:
    """The peak of each platform and video type, and by how many minutes it is after the peak of all."""
    total = Q.peak_summary(m.curve).select(F.col("peak_minute").alias("_all"))  # one row
    def peaks(dim: str) -> DataFrame:
        rows = Q.peak_summary(m.curve_by(dim), [dim])
        return rows.select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), "peak", "peak_minute")

    both = peaks("platform").unionByName(peaks("video_type"))
    return both.join(F.broadcast(total)).withColumn("shift_minutes", F.col("peak_minute") - F.col("_all")).drop("_all")


def phantom_share_by(m: Model, dim: str = "platform") -> DataFrame:
    """Wall-clock against active hours of each slice, and the peaks of present and of active sessions."""
    naive = m.spans.groupBy(dim).agg(rounded(F.sum(F.col("last_ms") - F.col("first_ms")) / HOUR_MS, 4).alias("naive_hours"))
    active = m.intervals.groupBy(dim).agg(rounded(F.sum(F.col("end_ms") - F.col("start_ms")) / HOUR_MS, 4).alias("active_hours"))
    peak = lambda minutes, name: minutes.groupBy(dim, "minute").agg(F.count("*").alias("n")).groupBy(dim).agg(F.max("n").alias(name))
    peaks = peak(m.open_minutes, "naive_peak").join(peak(m.minutes, "active_peak"), dim, "left").fillna(0, ["active_peak"])
    return naive.join(active, dim, "left").join(peaks, dim, "left").withColumn("phantom_share", rounded((F.col("naive_hours") - F.col("active_hours")) / F.nullif("naive_hours", F.lit(0.0)), 4))


def stored_by_start(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Events stored by the day on which their session starts."""
    path = shared_path(spark, "by-start")
    IO.write_partitioned(IO.by_session_start(events.select("session", "event_ms"), "event_ms"), path, "start_minute", ["session"])
    return spark.read.parquet(path)


def midnight_layout(m: Model) -> DataFrame:
    """A5: the events of a table with sessions over midnight, by the partition that they are stored in."""
    rows = stored_by_start(m.spark, m.bare_events.withColumn("event_ms", F.col("event_ms") + MIDNIGHT_MS))
    later = div("event_ms", DAY * MINUTE_MS) > div("start_minute", DAY)
    return rows.groupBy(F.col("day").cast("string").alias("stored_day")).agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("events"), F.count_if(later).alias("after_midnight"))


def data_checks(m: Model) -> DataFrame:
    """V1-V25 as one table."""
    e, empty = m.events, (F.coalesce(F.col("platform"), F.lit("")) == "") | (F.coalesce(F.col("country"), F.lit("")) == "") | F.col("content_id").isNull()
    start, end = m.bounds
    curve, dense_by = Q.dense_curve(m.deltas, start, end), Q.dense_curve(m.deltas, start, end, ["platform"])
    points = Q.change_points(m.deltas)
    as_curve, ends, ledger = points.withColumnRenamed("cc", "concurrency"), V.session_ends(m.line), S.run_ledger(m.runs)
    by_event = [V.known_event_types(), V.count_events("resume_beats", F.col("event") == "resume", 1000), V.distinct_values("platforms", "platform", 1, 20), V.count_events("empty_dimensions", empty, 0, V.EQUAL), V.distinct_values("categories", "category", 20, 200)]
    return _union([
        V.has_columns(e, "raw_columns", [*G.KEYS, "event_type", "event", "event_ms", "app_version", "audio_language", "subtitle_language", "player_version"]),
        V.checked(e, by_event), V.one_content_per_session(e), V.arrival_order(e), V.keepalive_cadence(m.line), V.gap_p99(m.line), V.watched_has_metadata(e, m.content), V.active_after_error(ends),
        V.repeated_events(e), V.ties(m.line, 1000), V.curve_checks(curve, points, m.minutes, start, end), V.nets_to_zero(m.deltas), V.equals_occupancy(dense_by, m.minutes, start, end, ["platform"]),
        V.active_within_presence(m.minutes, m.open_minutes), V.ledger_is_sound(ledger), V.ledger_run_count(ledger, m.minutes), V.pinned_is_first(m.line, e), V.segments_end(ends, m.active),
        V.hour_cut_equals(as_curve, Q.hour_seeded_curve(S.hour_cut_deltas(m.runs))), V.one_partition_per_session(stored_by_start(m.spark, m.bare_events)), V.has_columns(m.deltas, "delta_columns", [*G.KEYS, "minute", "delta_sessions", "delta_open"]),
    ])


def read_events_csv(m: Model) -> DataFrame:
    """A1, A2: the events as landing rows in CSV files, read back."""
    path = shared_path(m.spark, "landing")
    IO.as_landing_rows(m.bare_events).write.option("header", True).csv(path)
    return IO.read_events_csv(m.spark, path)


def read_dim_csv(m: Model) -> DataFrame:
    """The content metadata in CSV files, read back."""
    path = shared_path(m.spark, "content")
    m.content.select(*IO.CONTENT).write.option("header", True).csv(path)
    return IO.read_dim_csv(m.spark, path)


def read_quoted_csv(m: Model) -> DataFrame:
    """Content metadata whose titles hold quotes, delimiters and line breaks, in CSV files, read back."""
    path = shared_path(m.spark, "quoted")
    title = F.concat(F.lit('He said "'), "title", F.lit('", '), "category", F.lit("\nand left"))
    m.content.select("content_id", title.alias("title"), "video_type", "category").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return IO.read_dim_csv(m.spark, path)


def write_partitioned(m: Model) -> DataFrame:
    """A5: the deltas stored by day, read back with the day of their partition."""
    path = shared_path(m.spark, "by-day")
    IO.write_partitioned(m.deltas, path, "minute", G.KEYS)
    return m.spark.read.parquet(path).select(*G.KEYS, "minute", "delta_sessions", "delta_open", F.col("day").cast("string").alias("stored_day"))


def replay_day(m: Model) -> DataFrame:
    """The events replayed ten times as fast, as a stream into a table."""
    out = shared_path(m.spark, "replayed")
    source = IO.replay_day(m.spark, m.bare_events.select("event_id", "session", "event_ms"), shared_path(m.spark, "replay"), 10, 60)
    IO.run_until_done(source.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(m.spark, "offsets")).start())
    return m.spark.read.parquet(out).select("event_id", "session", "event_ms")


def range_matrix(m: Model) -> DataFrame:
    platform = F.col("platform")
    return Q.range_matrix(m.typed("video_type"), RANGES, {"no_filter": F.lit(True), "android": platform == "android", "ios": platform == "ios", "live": F.col("video_type") == "live"})


def _dims(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*G.KEYS, *more)


#: name -> the operator over the model; time columns are shown as timestamps.
BUILD: dict[str, Callable[[Model], DataFrame]] = {
    "decode_events": lambda m: clean.decode_events(IO.as_landing_rows(m.raw_events), F.col("ingest_ms").cast("long"), keep=["event_id"]).select("event_id", "session", "user_id", "content_id", "event_type", "event", "event_ms", "platform", "country", "ingest_ms"),
    "read_events_csv": read_events_csv,
    "read_dim_csv": read_dim_csv,
    "read_quoted_csv": read_quoted_csv,
    "write_partitioned": write_partitioned,
    "midnight_layout": midnight_layout,
    "replay_day": replay_day,
    "normalize_dim": lambda m: m.bare_events.groupBy(clean.normalize_dim("audio_language").alias("audio"), clean.normalize_dim("subtitle_language").alias("subtitle")).agg(F.count("*").alias("events")),
    "latest_version": lambda m: clean.latest_version(m.content_versions, ["content_id"], "updated_ms"),
    "enrich_content": lambda m: clean.enrich_content(m.raw_events, m.content).select("event_id", "session", "content_id", *clean.CONTENT_ATTRIBUTES),
    "dedup_events": lambda m: clean.dedup_events(m.bare_events).select("session", "event_ms", "event_type", "event", "event_id"),
    "event_fingerprint": lambda m: m.bare_events.agg(F.count("*").alias("events"), F.countDistinct(clean.event_fingerprint()).alias("fingerprints")),
    "classify_signal": lambda m: m.bare_events.groupBy("event_type", "event", clean.classify_signal().alias("signal"), clean.event_role().alias("role")).agg(F.count("*").alias("events")).withColumn("tie_break", clean.tie_break("signal")),
    "pin_dimensions": lambda m: _dims(clean.pin_dimensions(m.bare_events)).distinct(),
    "changed_sessions": lambda m: clean.changed_sessions(m.bare_events, MARK_MS, MARK_MS + 600_000).groupBy("session").agg(F.count("*").alias("events")),
    "apply_retention": lambda m: IO.apply_retention(m.deltas, "minute", W0 + 30),
    "gate_states": lambda m: _dims(m.states, "event_ms", "tie_break", "signal", "event_id", "fg", "playing", "ended"),
    "liveness_segments": lambda m: _dims(m.segments, "event_ms", "signal", "event_id", "seg_end_ms", "is_active"),
    "chunked_segments": lambda m: G.chunked_segments(G.chunked_timeline(m.bare_events)).select(*G.KEYS, "event_ms", "signal", "event_id", "fg", "playing", "ended", "seg_end_ms", "is_active"),
    "active_segments": lambda m: m.active,
    "active_intervals": lambda m: G.active_intervals(m.events),
    "session_minutes": lambda m: m.minutes,
    "minute_runs": lambda m: m.runs,
    "active_deltas": lambda m: S.active_deltas(m.runs),
    "open_deltas": lambda m: S.open_deltas(m.spans),
    "merged_deltas": lambda m: m.computed_deltas,
    "full_range_deltas": lambda m: S.full_range_deltas(m.spans, m.deltas),
    "current_deltas": lambda m: S.current_deltas(m.deltas.withColumn("computed_ms", F.lit(2)).unionByName(m.deltas.withColumns({"computed_ms": F.lit(1), "delta_sessions": F.col("delta_sessions") + 1}))).drop("computed_ms"),
    "run_ledger": lambda m: S.run_ledger(m.runs),
    "hour_cut_deltas": lambda m: S.hour_cut_deltas(m.runs),
    "error_policy": error_policy,
    "transition_intervals": lambda m: G.transition_intervals(m.events),
    "soft_close_intervals": lambda m: G.soft_close_intervals(m.events),
    "gate_ablation": gate_ablation,
    "naive_delta_curve": lambda m: Q.running_sum(S.naive_steps(m.line), ["step"]).withColumnRenamed("step", "concurrency"),
    "interval_floor_deltas": lambda m: S.interval_floor_deltas(m.events, m.content),
    "open_session_policy": open_session_policy,
    "timeout_sweep_sensitivity": timeout_sweep,
    "narrow_deltas": lambda m: R.narrow_deltas(m.deltas),
    "minute_stats": lambda m: R.minute_stats(m.minutes, m.open_minutes),
    "minute_stats_sketch": lambda m: R.estimated_users(R.minute_stats(m.minutes, m.open_minutes, sketches=True)),
    "hourly_stats": lambda m: R.rolled_stats(R.minute_stats(m.minutes, m.open_minutes), HOUR),
    "hourly_stats_sketch": lambda m: R.estimated_users(R.rolled_stats(R.minute_stats(m.minutes, m.open_minutes, sketches=True), HOUR)),
    "daily_stats": lambda m: R.rolled_stats(R.minute_stats(m.minutes, m.open_minutes), DAY),
    "users_minute": lambda m: R.users_minute(m.minutes, m.content),
    "presence_minute": lambda m: R.presence_minute(m.events),
    "presence_minute_sketch": lambda m: R.estimated_users(R.presence_minute(m.events, sketches=True)),
    "content_estimated_end": lambda m: R.content_estimated_end(m.deltas, m.content),
    "minute_serving": lambda m: R.minute_serving(m.minutes, m.line, m.spans),
    "hour_anchors": lambda m: R.hour_anchors(m.deltas, m.start, m.end),
    "representation_row_counts": lambda m: R.representation_row_counts(m.events, m.minutes, m.intervals, m.runs, m.deltas),
    "concurrency_curve": lambda m: Q.concurrency_curve(m.near(), W0, W1),
    "concurrency_curve_hour": lambda m: Q.concurrency_curve(m.near(), W0, W1, "hour"),
    "dim_filter": lambda m: m.filtered(platform=["android", "ios"], video_type="live"),
    "minute_fill": lambda m: m.curve_by("platform"),
    "peak_summary": lambda m: Q.peak_summary(m.curve),
    "peak_by_platform": lambda m: Q.peak_summary(m.curve_by("platform"), ["platform"]),
    "peak_by_country": lambda m: Q.peak_summary(m.curve_by("country"), ["country"]),
    "peak_by_video_type": lambda m: Q.peak_summary(m.curve_by("video_type"), ["video_type"]),
    **{f"peak_by_{dim}": lambda m, dim=dim: Q.peak_summary(m.curve_by(dim), [dim]) for dim in ("category", "show_name")},
    "active_vs_open": lambda m: Q.active_vs_open(m.near(), W0, W1),
    "unique_active_users": lambda m: Q.unique_active_users(m.near(), W0, W1),
    "hourly_summary": lambda m: Q.hourly_summary(m.curve),
    "get_peak": lambda m: Q.get_peak(Q.concurrency_curve(m.near(), W0, W1)),
    "active_users_at": lambda m: Q.active_users_at(m.deltas, MAIN_CONTENT, W0 + 30),
    "trend": lambda m: Q.trend(m.store.near(W1 - 10, W1 + 1), W1),
    "predict_load": lambda m: Q.predict_load(Q.trend(m.store.near(W1 - 10, W1 + 1), W1)),
    "range_peak_avg": lambda m: Q.range_peak_avg(m.near(), W0, W1),
    "average_variants": average_variants,
    "range_matrix": range_matrix,
    "range_metrics": lambda m: Q.range_metrics(m.intervals, W0, W1),
    "range_audience": lambda m: Q.range_audience(m.intervals, m.spark.createDataFrame([(k, a, b) for k, (a, b) in RANGES.items()], "range_name string, start_minute long, end_minute long")),
    "concurrency_at": lambda m: Q.concurrency_at(m.deltas, m.intervals, m.spark.createDataFrame([(W0,), (W0 + 20,), (W0 + 45,)], "at_minute long")),
    "local_peaks": lambda m: Q.local_peaks(m.curve),
    "union_peak_vs_sum": union_peak_vs_sum,
    "hour_seeded_curve": lambda m: Q.hour_seeded_curve(S.hour_cut_deltas(m.runs)),
    "decline_alert": lambda m: Q.decline_alert(m.curve),
    "phantom_audience": phantom_audience,
    "peak_people": lambda m: m.minutes.groupBy("minute").agg(F.countDistinct("user_id").alias("users")).agg(F.max("users").alias("peak_users"), Q._peak_minute("users").alias("peak_minute")),
    "content_drilldown": lambda m: Q.concurrency_curve(Q.dim_filter(m.near(), content_id=MAIN_CONTENT), W0, W1),
    "compare_curves": lambda m: Q.compare_curves(m.curve, interval_curve(m)),
    "meta": lambda m: D.meta(m.deltas, m.content),
    "dataset_info": lambda m: D.dataset_info(m.events),
    "kpis": lambda m: D.kpis(m.near(), m.store.spans_between(W0, W1), W0, W1),
    "traffic": lambda m: D.traffic(m.near(), W0, W1, "hour"),
    "traffic_minute": lambda m: D.traffic(m.near(), W0, W1, "minute"),
    "traffic_day": lambda m: D.traffic(m.deltas, m.start, m.end, "day"),
    "traffic_split_by_category": lambda m: D.traffic_split(m.near(), m.content, W0, W1, "hour", "category"),
    "traffic_split_by_platform": lambda m: D.traffic_split(m.near(), m.content, W0, W1, "minute", "platform"),
    **{f"traffic_split_by_{dim}": lambda m, dim=dim: D.traffic_split(m.near(), m.content, W0, W1, "hour", dim) for dim in HOURLY_SPLITS},
    "traffic_wide_by_video_type": lambda m: D.traffic_wide(D.traffic_split(m.near(), m.content, W0, W1, "hour", "video_type"), ["live", "vod", "unknown"]),
    "geo": lambda m: D.geo(m.near(), W0, W1),
    "content_ranking": lambda m: D.content_ranking(m.near(), m.content, W0, W1),
    "content_metadata": lambda m: D.content_metadata(m.content, R.content_estimated_end(m.deltas, m.content), MAIN_CONTENT),
    "health_signals": lambda m: D.health_signals(m.bare_events, W0, W1),
    "billable_impressions": lambda m: D.billable_impressions(m.near(), m.advertisers, W0, W1),
    "billing_reconciliation": lambda m: D.billing_reconciliation(D.billable_impressions(m.deltas, m.advertisers, W0, W1), D.billable_impressions(S.active_deltas(m.runs), m.advertisers, W0, W1)),
    "advertiser_content": lambda m: D.advertiser_content(m.advertisers),
    "dataset_counts": lambda m: A.dataset_counts(m.bare_events),
    "events_by_date": lambda m: A.events_by_date(m.bare_events),
    "events_by_hour": lambda m: A.events_by_hour(m.bare_events),
    "naive_minute_concurrency": lambda m: A.naive_minute_concurrency(m.bare_events),
    "event_breakdown": lambda m: A.event_breakdown(m.bare_events),
    "session_duration_quantiles": lambda m: A.session_duration_quantiles(m.bare_events),
    "events_per_session_quantiles": lambda m: A.events_per_session_quantiles(m.bare_events),
    "session_content_cardinality": lambda m: A.session_content_cardinality(m.bare_events),
    "open_sessions": lambda m: A.open_sessions(m.bare_events),
    "heartbeat_gap_quantiles": lambda m: A.heartbeat_gap_quantiles(m.line),
    "event_gap_quantiles": lambda m: A.event_gap_quantiles(m.line),
    "gap_histogram": lambda m: A.gap_histogram(m.line),
    "background_durations": lambda m: A.background_durations(m.line),
    "after_background": lambda m: A.after_background(m.line),
    "pause_durations": lambda m: A.pause_durations(m.line),
    "buffer_durations": lambda m: A.buffer_durations(m.line),
    "startup_latency": lambda m: A.startup_latency(m.line),
    "qoe_by_platform": lambda m: A.qoe_by_platform(m.bare_events),
    "error_outcomes": lambda m: A.error_outcomes(m.line),
    "breakdown_by": lambda m: _union(A.breakdown_by(m.events, d) for d in DIMS_FOR_BREAKDOWN),
    "engagement_by_video_type": lambda m: A.engagement_by_video_type(m.line, m.content),
    "duration_by_type_platform": lambda m: A.duration_by_type_platform(m.line, m.content),
    "session_patterns": lambda m: A.session_patterns(m.line),
    "fg_vs_naive": lambda m: A.fg_vs_naive(m.curve, m.bare_events),
    "fg_share_at_minute": lambda m: A.fg_share_at_minute(m.minutes, m.bare_events, W0 + 30),
    "sessions_per_user": lambda m: A.sessions_per_user(m.bare_events),
    "heavy_users": lambda m: A.heavy_users(m.bare_events, 20),
    "overlapping_session_pairs": lambda m: A.overlapping_session_pairs(m.line),
    "multi_platform_users": lambda m: A.multi_platform_users(m.bare_events),
    "late_after_end": lambda m: A.late_after_end(m.line),
    "same_ms_ties": lambda m: A.same_ms_ties(m.line),
    "redundant_transitions": lambda m: A.redundant_transitions(m.line),
    "lifecycle_completeness": lambda m: A.lifecycle_completeness(m.line),
    "dimension_cardinality": lambda m: A.dimension_cardinality(m.events),
    "dimension_completeness": lambda m: A.dimension_completeness(m.events),
    "dimension_drift": lambda m: A.dimension_drift(m.bare_events),
    "bg_fg_balance": lambda m: A.bg_fg_balance(m.line),
    "liveness_family_coverage": lambda m: A.liveness_family_coverage(m.bare_events),
    "background_signal_share": lambda m: A.background_signal_share(m.states),
    "dim_join_coverage": lambda m: A.dim_join_coverage(m.bare_events, m.content),
    "peak_minute_shift": peak_minute_shift,
    "heartbeat_write_amplification": lambda m: A.heartbeat_write_amplification(m.line),
    "heartbeat_taxonomy": lambda m: A.heartbeat_taxonomy(m.states),
    "opening_closing_signatures": lambda m: A.opening_closing_signatures(m.line),
    "signal_trigrams": lambda m: A.signal_trigrams(m.line),
    "exclusion_reasons": lambda m: A.exclusion_reasons(m.states),
    "session_archetypes": lambda m: A.session_archetypes(m.states, m.intervals),
    "state_paths": lambda m: A.state_paths(m.line),
    "contradictory_transitions": lambda m: A.contradictory_transitions(m.line),
    "ux_while_background": lambda m: A.ux_while_background(m.states),
    "phantom_share_by": phantom_share_by,
    "without_heavy_users": lambda m: Q.concurrency_curve(S.deltas_of(A.without_heavy_users(m.bare_events, 14)), W0, W1),
    "data_checks": data_checks,
    "live_now": lambda m: _dims(live.live_now(m.events, MARK_MS)),
    "label_finality": lambda m: live.label_finality(m.curve, W0 + 30),
    "ingest_lag": lambda m: live.ingest_lag(m.bare_events, MARK_MS),
    "late_event_policy": lambda m: live.late_event_policy(m.states),
    "retract_and_refold": lambda m: live.retract_and_refold_demo(m.bare_events, MARK_MS),
    "advance_checkpoint": lambda m: live.advance_checkpoint(m.bare_events, MARK_MS),
    "publish_events": lambda m: IO.publish_events(m.bare_events.select("session", "event_type", "event", "event_ms"), None, "session"),
}

#: Structured Streaming runs over the model's events, replayed from files in the shared folder.
STREAMS: dict[str, Callable[[Model], DataFrame]] = {
    "recompute_changed": lambda m: live.run_recompute(m.bare_events),
    "live_from_state": lambda m: live.run_live_from_state(m.bare_events, MARK_MS),
    "finality_by_watermark": lambda m: live.run_finality(m.bare_events.where(F.col("event_ms") <= MARK_MS), m.curve),
    "session_fold": lambda m: live.run_session_fold(m.bare_events),
    "corrected_fold": lambda m: live.run_corrected_fold(m.bare_events),
    "presence_per_minute_stream": lambda m: live.run_presence(m.bare_events),
    "presence_rollup": lambda m: live.run_presence_rollup(m.bare_events),
    "stats_rollup": lambda m: live.run_stats_rollup(m.bare_events),
}


def _query(build: Callable[[Model], DataFrame], model: type[Model] = Model) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(build(model(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(build) for name, build in (BUILD | STREAMS).items()}
QUERIES |= {f"{name}_whole": _query(BUILD[name], WholeModel) for name in WHOLE}
