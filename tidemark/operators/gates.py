"""The active-interval state machine: gates, liveness segments, intervals, and the rule variants.

``active(t)`` = foreground, playing, not ended, and at most ``timeout_s`` since the last event.  Everything is a window
over one session ordered by time; the session key is shuffled once and all steps keep that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import DIMENSIONS, classify_signal, event_role, pin_dimensions, tie_break
from ..functions.times import div
from ..plans.config import DEFAULT, Rules

KEYS = ["session", *DIMENSIONS]
ORDER = ["event_ms", "tie_break", "event_id"]


def _in_order():
    return W.partitionBy("session").orderBy(*ORDER)


def timeline(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Deduplicated, classified events with pinned dimensions: ``session, dims, event_ms, tie_break, signal, event_id``."""
    if rules.ignore_downloads:
        events = events.where(event_role() != "ignore")
    pinned = pin_dimensions(events.select(*KEYS, "event_ms", "event_type", "event", "event_id"), rules.tie_order)
    signal = classify_signal()
    rows = pinned.withColumn("signal", signal).withColumn("tie_break", tie_break("signal", rules.tie_order))
    return rows.groupBy(*KEYS, "event_ms", "event_type", "event", "signal", "tie_break").agg(F.min("event_id").alias("event_id"))


def gate_columns(rules: Rules = DEFAULT) -> dict[str, Column]:
    """``fg``, ``playing`` carried forward and ``ended`` counted up, over a session in order."""
    s, so_far = F.col("signal"), _in_order().rowsBetween(W.unboundedPreceding, 0)
    stops = ("PAUSE", "ERR") if rules.error_policy == "inactive" else ("PAUSE",)
    ends = ("END", "ERR") if rules.error_policy == "terminal" else ("END",)
    carry = lambda on, off, default: F.coalesce(F.last(F.when(s.isin(*on), 1).when(s.isin(*off), 0), ignorenulls=True).over(so_far), F.lit(default))
    return {"fg": carry(("FG",), ("BG",), rules.fg_default), "playing": carry(("PLAY", "RESUME"), stops, rules.playing_default), "ended": F.sum(F.when(s.isin(*ends), 1).otherwise(0)).over(so_far).cast("int")}


def gate_states(line: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The gates after each event."""
    return line.withColumns(gate_columns(rules))


def is_counted(rules: Rules = DEFAULT, suffix: str = "") -> Column:
    test = F.col(f"ended{suffix}") == 0
    if rules.use_fg:
        test = test & (F.col(f"fg{suffix}") == 1)
    return test & (F.col(f"playing{suffix}") == 1) if rules.use_playing else test


def segment_end(after: Column, rules: Rules = DEFAULT) -> Column:
    """Where an event's segment ends if the next event is at ``after`` (null: none).

    Without the liveness gate a segment runs to the next event; the last one is ``timeout_s`` long in any case.
    """
    cap = F.col("event_ms") + rules.timeout_ms
    return F.least(after, cap) if rules.use_liveness else F.coalesce(after, cap)


def liveness_segments(states: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Each event opens a segment up to the next event, ``timeout_s`` long at most."""
    return states.withColumns({"seg_end_ms": segment_end(F.lead("event_ms").over(_in_order()), rules), "is_active": is_counted(rules)})


def chunked_timeline(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``timeline`` for sessions of any length: the first event's dimensions are an aggregate that meets the events by a join,
    which Spark splits where one session is hot."""
    if rules.ignore_downloads:
        events = events.where(event_role() != "ignore")
    signal = classify_signal()
    rows = events.withColumn("signal", signal).withColumn("tie_break", tie_break("signal", rules.tie_order))
    first = rows.groupBy("session").agg(F.min_by(F.struct(*DIMENSIONS), F.struct(*ORDER)).alias("_d")).select("session", "_d.*")
    once = rows.groupBy("session", "event_ms", "event_type", "event", "signal", "tie_break").agg(F.min("event_id").alias("event_id"))
    return once.join(first, "session").select(*KEYS, "event_ms", "event_type", "event", "signal", "tie_break", "event_id")


def chunked_segments(line: DataFrame, rules: Rules = DEFAULT, chunk_ms: int = 600_000) -> DataFrame:
    """S1, S2 by a prefix scan: the columns of ``liveness_segments(gate_states(line))``, with a session's events in many tasks.

    What a chunk of time does to the gates is a function: each gate is set to a value or left alone, ends are added, and
    such functions compose to one of the same kind.  Each (session, chunk) is summed up to its function and first event; a
    scan over a session's chunks gives the gates that a chunk starts with and the event that follows it; inside a chunk a
    window does the rest.
    """
    s, chunk = F.col("signal"), ["session", "_chunk"]
    stops = ("PAUSE", "ERR") if rules.error_policy == "inactive" else ("PAUSE",)
    ends = ("END", "ERR") if rules.error_policy == "terminal" else ("END",)
    marked = line.withColumns({
        "_chunk": div("event_ms", chunk_ms), "_fg": F.when(s == "FG", 1).when(s == "BG", 0),
        "_playing": F.when(s.isin("PLAY", "RESUME"), 1).when(s.isin(*stops), 0), "_ends": s.isin(*ends).cast("int"),
    })
    place = F.struct(*ORDER)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    done = marked.groupBy(*chunk).agg(last("_fg"), last("_playing"), F.sum("_ends").alias("_ends"), F.min("event_ms").alias("_first"))
    scan = W.partitionBy("session").orderBy("_chunk")
    before = scan.rowsBetween(W.unboundedPreceding, -1)
    opened = done.select(*chunk, F.coalesce(F.last("_fg", ignorenulls=True).over(before), F.lit(rules.fg_default)).alias("_fg0"), F.coalesce(F.last("_playing", ignorenulls=True).over(before), F.lit(rules.playing_default)).alias("_playing0"), F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_ends0"), F.lead("_first").over(scan).alias("_next"))
    inside = W.partitionBy(*chunk).orderBy(*ORDER)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumns({"_fg": F.last("_fg", ignorenulls=True).over(so_far), "_playing": F.last("_playing", ignorenulls=True).over(so_far), "_ends": F.sum("_ends").over(so_far), "_after": F.lead("event_ms").over(inside)})
    states = local.join(opened, chunk).withColumns({"fg": F.coalesce("_fg", "_fg0"), "playing": F.coalesce("_playing", "_playing0"), "ended": (F.col("_ends") + F.col("_ends0")).cast("int"), "_after": F.coalesce("_after", "_next")})
    return states.withColumns({"seg_end_ms": segment_end(F.col("_after"), rules), "is_active": is_counted(rules)}).select(*line.columns, "fg", "playing", "ended", "seg_end_ms", "is_active")


def active_segments(segments: DataFrame) -> DataFrame:
    """S3: the active segments as ``session, dims, seg_start_ms, seg_stop_ms``."""
    return segments.where("is_active").select(*KEYS, F.col("event_ms").alias("seg_start_ms"), F.col("seg_end_ms").alias("seg_stop_ms"))


def segments_of(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    return active_segments(liveness_segments(gate_states(timeline(events, rules), rules), rules))


def merge_touching(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half-open intervals from segments: those that touch or overlap become one, empty ones go.  ``by``: variants of the
    measure that are kept apart; a session's variants stay in its partition."""
    order = W.partitionBy("session", *by).orderBy("seg_start_ms", "seg_stop_ms")
    reach = F.max("seg_stop_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = segments.where("seg_stop_ms > seg_start_ms").withColumn("_new", F.when(F.col("seg_start_ms") <= reach, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*KEYS, *by, "_island").agg(F.min("seg_start_ms").alias("start_ms"), F.max("seg_stop_ms").alias("end_ms")).drop("_island")


def active_intervals(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``session, dims, start_ms, end_ms``; an interval ends at a state change, at END, or ``timeout_s`` after the
    last sign of life."""
    return merge_touching(segments_of(events, rules))


def transition_intervals(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Two-state model.  PLAY and RESUME activate; START, PAUSE, BG and ERR deactivate; END absorbs; repeated states
    are dropped; foregrounding alone never activates.  An interval still open at the end is ``timeout_s`` long."""
    s = F.col("signal")
    state = F.when(s.isin("PLAY", "RESUME"), "active").when(s == "END", "terminal").when(s.isin("START", "PAUSE", "BG", "ERR"), "inactive")
    rows = timeline(events, rules).withColumn("state", state).where("state IS NOT NULL").withColumn("before", F.lag("state").over(_in_order()))
    ended = F.max(F.when(F.col("state") == "terminal", 1).otherwise(0)).over(_in_order().rowsBetween(W.unboundedPreceding, -1))
    changes = rows.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0 AND NOT (state <=> before)")
    spans = changes.withColumn("end_ms", F.coalesce(F.lead("event_ms").over(_in_order()), F.col("event_ms") + rules.timeout_ms))
    return spans.where("state = 'active' AND end_ms > event_ms").select(*KEYS, F.col("event_ms").alias("start_ms"), "end_ms")


def soft_close_intervals(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Only events at which the session counts keep it alive; pausing or backgrounding closes nothing by itself.

    A run ends at END, or ``timeout_s`` after its last counted event when the next counted one is later than that.
    """
    states = gate_states(timeline(events, rules), rules)
    end_at = F.min(F.when(F.col("signal") == "END", F.col("event_ms"))).over(W.partitionBy("session"))
    counted = states.withColumn("_end", end_at).where(is_counted(rules))
    segments = counted.select(*KEYS, F.col("event_ms").alias("seg_start_ms"), F.least(F.col("event_ms") + rules.timeout_ms, F.col("_end")).alias("seg_stop_ms"))
    return merge_touching(segments)


VARIANTS = {
    "V0": replace(DEFAULT, use_fg=False, use_playing=False, use_liveness=False),
    "V1": replace(DEFAULT, use_playing=False, use_liveness=False),
    "V2": replace(DEFAULT, use_liveness=False),
    "V3": DEFAULT,
}


def variant_segments(states: DataFrame, name: str, variants: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The active segments of several readings of the same events in one pass, with the reading in the column ``name``.
    ``variants``: for each whether an event counts, and where its segment ends."""
    options = [F.when(counts, F.struct(F.lit(v).alias(name), end.alias("seg_stop_ms"))) for v, (counts, end) in variants.items()]
    each = states.select(*KEYS, F.col("event_ms").alias("seg_start_ms"), F.explode(F.array_compact(F.array(*options))).alias("_v"))
    return each.select(*KEYS, "seg_start_ms", "_v.*")


def _next_event() -> Column:
    return F.lead("event_ms").over(_in_order())


def policy_segments(events: DataFrame, policies: Sequence[str], rules: Rules = DEFAULT) -> DataFrame:
    """Active segments by ``policy``, the reading of an error; one order of a session serves all."""
    gates = {f"{c}_{p}": column for p in policies for c, column in gate_columns(replace(rules, error_policy=p)).items()}
    states = timeline(events, rules).withColumns(gates | {"_after": _next_event()})
    return variant_segments(states, "policy", {p: (is_counted(rules, f"_{p}"), segment_end(F.col("_after"), rules)) for p in policies})


def ablation_segments(states: DataFrame, variants: dict[str, Rules] = VARIANTS) -> DataFrame:
    """Active segments by ``variant``, with some of the gates each, from the gates of all."""
    rows = states.withColumn("_after", _next_event())
    return variant_segments(rows, "variant", {v: (is_counted(r), segment_end(F.col("_after"), r)) for v, r in variants.items()})


def open_session_segments(events: DataFrame, watermark_ms: int, rules: Rules = DEFAULT) -> DataFrame:
    """Active segments known at ``watermark_ms`` by ``policy``.  P1 drops sessions without END, P2 keeps them active until
    their last signal's timeout, P3 until the watermark if their last state counts."""
    known = events.where(F.col("event_ms") <= watermark_ms)
    closed = F.max(F.col("signal") == "END").over(W.partitionBy("session"))
    states = gate_states(timeline(known, rules), rules).withColumns({"_after": _next_event(), "_closed": closed})
    end = segment_end(F.col("_after"), rules)
    tail = F.when(F.col("_after").isNull() & (F.col("event_ms") < watermark_ms), F.greatest(end, F.lit(watermark_ms).cast("long")))
    counts = is_counted(rules)
    return variant_segments(states, "policy", {"P1": (counts & F.col("_closed"), end), "P2": (counts, end), "P3": (counts, F.coalesce(tail, end))})
