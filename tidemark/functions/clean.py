"""Decoding, normalising, enriching, deduplicating and classifying events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.config import TIE_ORDER

DIMENSIONS = ["user_id", "platform", "country", "video_resolution", "content_id"]
CONTENT_ATTRIBUTES = ["title", "video_type", "category", "show_name"]
#: Heartbeat events that move the playing gate.
PAUSES = ("pause", "speed-pause", "AdPause")
RESUMES = ("resume", "speed-resume", "AdResume")
#: Heartbeat events sent on a timer.
QUALITY = ("BufferStart", "BufferEnd", "downshift", "upshift", "dropped-frames", "network-change", "speed-change", "video_quality_change")
KEEPALIVE = ("buffer-health", "video-resize", "network-bandwidth", "network-activity")


def decode_events(raw: DataFrame, ingest_ms: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """All-string landing rows -> typed events; ``ingest_ms`` (default: now) is stamped on every row, columns in ``keep``
    come along as longs."""
    stamp = ingest_ms if ingest_ms is not None else F.unix_millis(F.current_timestamp())
    return raw.select(
        *[F.col(c).cast("long").alias(c) for c in keep],
        F.col("video_session_id").alias("session"),
        "user_id",
        F.col("content_id").cast("long").alias("content_id"),
        "event_type",
        "event",
        F.col("event_timestamp").cast("long").alias("event_ms"),
        *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("platform", "app_version", "country", "audio_language", "subtitle_language", "player_version", "video_resolution")],
        F.col("session_start_epoch").cast("long").alias("session_start_ms"),
        stamp.alias("ingest_ms"),
    )


def normalize_dim(column: Column | str) -> Column:
    """Lower-case up to the first '-'; null, '', 'unk' and 'off' are 'unknown'."""
    base = F.lower(F.split(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "-").getItem(0))
    return F.when(base.isin("", "unk", "off"), "unknown").otherwise(base)


def latest_version(df: DataFrame, keys: Sequence[str], version: str, *tiebreak: str) -> DataFrame:
    """One row per key: the highest version, ties by ``tiebreak`` descending."""
    newest = W.partitionBy(*keys).orderBy(F.col(version).desc(), *(F.col(c).desc() for c in tiebreak))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def enrich_content(events: DataFrame, content: DataFrame) -> DataFrame:
    """Add the newest content attributes; unmatched ids stay, as 'unknown'.  Spark broadcasts the dimension if it is small."""
    known = content.select("content_id", *CONTENT_ATTRIBUTES)
    return events.join(known, "content_id", "left").fillna("unknown", CONTENT_ATTRIBUTES)


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per (session, event_ms, event_type, event): the one with the smallest event_id."""
    keys = ["session", "event_ms", "event_type", "event"]
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), "event_id")
    return events.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*events.columns)


def event_fingerprint() -> Column:
    return F.xxhash64("session", "event_type", "event", "event_ms")


def classify_signal(event_type: Column | str = "event_type", event: Column | str = "event") -> Column:
    kind, name = (F.col(c) if isinstance(c, str) else c for c in (event_type, event))
    beat = kind == "VideoHeartbeat"
    return (
        F.when(kind == "VideoSessionStart", "START")
        .when(kind == "VideoSessionEnd", "END")
        .when(kind == "VideoPlay", "PLAY")
        .when(kind == "AppBackgrounded", "BG")
        .when(kind == "AppForegrounded", "FG")
        .when(kind == "VideoError", "ERR")
        .when(beat & name.isin(*PAUSES), "PAUSE")
        .when(beat & name.isin(*RESUMES), "RESUME")
        .otherwise("HB")
    )


def tie_break(signal: Column | str = "signal", order: Sequence[str] = TIE_ORDER) -> Column:
    c = F.col(signal) if isinstance(signal, str) else signal
    return F.array_position(F.array(*[F.lit(s) for s in order]), c).cast("int")


def event_role(event_type: Column | str = "event_type", event: Column | str = "event") -> Column:
    """'ignore' for downloads, 'trigger' for events that move a gate, 'liveness' for the rest."""
    name = F.col(event) if isinstance(event, str) else event
    return F.when(F.lower(name).like("download%"), "ignore").when(classify_signal(event_type, event).isin("HB", "START", "ERR"), "liveness").otherwise("trigger")


def pin_dimensions(events: DataFrame, order: Sequence[str] = TIE_ORDER) -> DataFrame:
    """Every event with its session's first event's dimensions, first by time, tie order and event id."""
    first = W.partitionBy("session").orderBy("event_ms", tie_break(classify_signal(), order), "event_id").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumns({d: F.first(d).over(first) for d in DIMENSIONS})


def changed_sessions(events: DataFrame, since_ms: int, now_ms: int, settle_ms: int = 5000) -> DataFrame:
    """Whole histories of the sessions with an arrival after ``since_ms``, up to ``settle_ms`` before ``now_ms``."""
    touched = events.where((F.col("ingest_ms") > since_ms) & (F.col("ingest_ms") <= now_ms - settle_ms)).select("session").distinct()
    return events.join(touched, "session", "left_semi")
