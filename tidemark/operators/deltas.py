"""From active segments to minute runs and +1/-1 deltas, their versions, ledger and hour cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import latest_version
from ..functions.times import HOUR, div, minute_of
from ..plans.config import DEFAULT, Rules
from .gates import KEYS, active_intervals, segments_of, timeline


def session_minutes(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every minute that an active segment touches, both ends included, once per session (and variant ``by``)."""
    return segments.select(*KEYS, *by, F.explode(F.sequence(minute_of("seg_start_ms"), minute_of("seg_stop_ms"))).alias("minute")).distinct()


def interval_minutes(intervals: DataFrame) -> DataFrame:
    return session_minutes(intervals.select(*KEYS, F.col("start_ms").alias("seg_start_ms"), F.col("end_ms").alias("seg_stop_ms")))


def minute_runs(minutes: DataFrame) -> DataFrame:
    """Contiguous minutes of a session as half-open ``[run_start, run_end)``."""
    island = F.col("minute") - F.row_number().over(W.partitionBy("session").orderBy("minute"))
    return minutes.withColumn("_g", island).groupBy(*KEYS, "_g").agg(F.min("minute").alias("run_start"), (F.max("minute") + 1).alias("run_end")).drop("_g")


def runs_of(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    return minute_runs(session_minutes(segments_of(events, rules)))


def _steps(frame: DataFrame, start: str, end: str, active: int) -> DataFrame:
    step = lambda m, d: F.struct(F.col(m).alias("minute"), F.lit(d * active).cast("long").alias("delta_sessions"), F.lit(d * (1 - active)).cast("long").alias("delta_open"))
    return frame.select(*KEYS, F.explode(F.array(step(start, 1), step(end, -1))).alias("_s")).select(*KEYS, "_s.*")


def active_deltas(runs: DataFrame) -> DataFrame:
    """+1 at each run's start, -1 at its end."""
    return _steps(runs, "run_start", "run_end", 1)


def session_spans(line: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``session, dims, first_minute, close_minute, first_ms, last_ms``; open from the first event to the last one's timeout."""
    spans = line.groupBy(*KEYS).agg(F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"))
    return spans.withColumns({"first_minute": minute_of("first_ms"), "close_minute": minute_of(F.col("last_ms") + rules.timeout_ms) + 1})


def open_deltas(spans: DataFrame) -> DataFrame:
    """+1 at the first event's minute, -1 after the minute of the last event's timeout."""
    return _steps(spans, "first_minute", "close_minute", 0)


def merged_deltas(active: DataFrame, opened: DataFrame) -> DataFrame:
    """One row per session and minute."""
    return active.unionByName(opened).groupBy(*KEYS, "minute").agg(F.sum("delta_sessions").alias("delta_sessions"), F.sum("delta_open").alias("delta_open"))


def deltas_of(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The delta table of whole session histories."""
    line = timeline(events, rules)
    return merged_deltas(active_deltas(runs_of(events, rules)), open_deltas(session_spans(line, rules)))


def full_range_deltas(spans: DataFrame, merged: DataFrame) -> DataFrame:
    """A row for every minute of a session's span, zero where nothing changes, for append-only tables."""
    every = spans.select(*KEYS, F.explode(F.sequence("first_minute", "close_minute")).alias("minute"))
    return every.join(merged.select("session", "minute", "delta_sessions", "delta_open"), ["session", "minute"], "left").fillna(0, ["delta_sessions", "delta_open"]).select(*KEYS, "minute", "delta_sessions", "delta_open")


def current_deltas(versions: DataFrame) -> DataFrame:
    """The newest ``computed_ms`` of each (minute, session)."""
    return latest_version(versions, ["session", "minute"], "computed_ms")


def run_ledger(runs: DataFrame, sign: int = 1) -> DataFrame:
    """Emitted runs; ``sign`` -1 takes them back."""
    return runs.withColumn("sign", F.lit(sign))


def hour_cut_runs(runs: DataFrame) -> DataFrame:
    hours = F.sequence(div("run_start", HOUR), div(F.col("run_end") - 1, HOUR))
    cut = runs.select(*KEYS, "run_start", "run_end", F.explode(hours).alias("_h"))
    return cut.select(*KEYS, F.greatest("run_start", F.col("_h") * HOUR).alias("run_start"), F.least("run_end", (F.col("_h") + 1) * HOUR).alias("run_end"))


def hour_cut_deltas(runs: DataFrame) -> DataFrame:
    """Deltas of runs cut at hour boundaries with their ``hour`` (epoch minutes): each hour sums from zero by itself."""
    pieces = hour_cut_runs(runs).withColumn("hour", div("run_start", HOUR) * HOUR)
    step = lambda m, d: F.struct(F.col(m).alias("minute"), F.lit(d).cast("long").alias("delta_sessions"))
    return pieces.select(*KEYS, "hour", F.explode(F.array(step("run_start", 1), step("run_end", -1))).alias("_s")).select(*KEYS, "hour", "_s.*")


def interval_floor_deltas(events: DataFrame, content: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The interval measure's deltas by slice: +1 at the start's minute, -1 at the end's, zero sums left out."""
    typed = active_intervals(events, rules).join(content.select("content_id", "video_type"), "content_id", "left").fillna("unknown", ["video_type"])
    step = lambda m, d: F.struct(minute_of(m).alias("minute"), F.lit(d).alias("d"))
    rows = typed.select("platform", "country", "content_id", "video_type", F.explode(F.array(step("start_ms", 1), step("end_ms", -1))).alias("_s"))
    return rows.groupBy("platform", "country", "content_id", "video_type", F.col("_s.minute").alias("minute")).agg(F.sum("_s.d").alias("delta")).where("delta <> 0")


def naive_steps(line: DataFrame) -> DataFrame:
    """S18, negative control: +1 for every PLAY or RESUME, -1 for every PAUSE, without any state."""
    d = F.when(F.col("signal").isin("PLAY", "RESUME"), 1).when(F.col("signal") == "PAUSE", -1)
    return line.withColumn("d", d).where("d IS NOT NULL").groupBy(minute_of("event_ms").alias("minute")).agg(F.sum("d").alias("step"))
