"""Data expectations and invariants.  Every check gives a row ``check, observed, bound, ok``; those of one frame are taken in
one pass over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import KEEPALIVE
from ..functions.numbers import rounded
from ..functions.times import div
from .quantiles import exact_quantiles

#: The seven event types.
EVENT_TYPES = ("VideoSessionStart", "VideoSessionEnd", "VideoPlay", "AppBackgrounded", "AppForegrounded", "VideoError", "VideoHeartbeat")


class Check(NamedTuple):
    """An aggregate of a frame, and how it compares with a bound; nothing observed counts as 0."""

    name: str
    observed: Column
    bound: float
    ok: Callable[[Column, Column], Column]


def checked(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row for each check, from one aggregation of ``df``."""
    seen = df.agg(*[F.coalesce(c.observed.cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(checks)])
    row = lambda i, c: F.struct(F.lit(c.name).alias("check"), rounded(f"_{i}", 4).alias("observed"), F.lit(float(c.bound)).alias("bound"), c.ok(F.col(f"_{i}"), F.lit(float(c.bound))).alias("ok"))
    return seen.select(F.explode(F.array(*[row(i, c) for i, c in enumerate(checks)])).alias("_c")).select("_c.*")


def _check(df: DataFrame, name: str, observed: Column, bound: float, ok) -> DataFrame:
    return checked(df, [Check(name, observed, bound, ok)])


AT_MOST, AT_LEAST, ABOVE, EQUAL = (lambda a, b: a <= b), (lambda a, b: a >= b), (lambda a, b: a > b), (lambda a, b: a == b)


def has_columns(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Number of expected columns that are absent."""
    absent = len(set(columns) - set(df.columns))
    return _check(df.sparkSession.range(1), name, F.max(F.lit(absent)), 0, EQUAL)


def known_event_types() -> Check:
    """V2: exactly the known types occur."""
    known = F.countDistinct(F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")))
    other = F.count_if(~F.col("event_type").isin(*EVENT_TYPES))
    return Check("event_types", known - other, len(EVENT_TYPES), EQUAL)


def one_content_per_session(e: DataFrame, most: int = 2) -> DataFrame:
    """V3."""
    return _check(e.groupBy("session").agg(F.countDistinct("content_id").alias("n")), "sessions_over_contents", F.count_if(F.col("n") > 1), most, AT_MOST)


def arrival_order(e: DataFrame) -> DataFrame:
    """V4: events of a session whose time is before that of an earlier arrival."""
    before = F.lag("event_ms").over(W.partitionBy("session").orderBy("ingest_ms", "event_ms", "event_id"))
    return _check(e.withColumn("b", before), "out_of_order", F.count_if(F.col("event_ms") < F.col("b")), 0, EQUAL)


def keepalive_cadence(line: DataFrame, low: float = 25, high: float = 45) -> DataFrame:
    """V5: the median gap of keepalive beats, in [low, high] seconds."""
    order = W.partitionBy("session", "event").orderBy("event_ms", "event_id")
    gaps = line.where(F.col("event").isin(*KEEPALIVE)).withColumn("g", (F.col("event_ms") - F.lag("event_ms").over(order)) / 1000)
    return _check(exact_quantiles(gaps, "g", [0.5]), "keepalive_median_s", F.max("p50"), high, lambda a, b: a.between(low, b))


def gap_p99(line: DataFrame, timeout_s: int = 90) -> DataFrame:
    """V6."""
    order = W.partitionBy("session").orderBy("event_ms", "tie_break", "event_id")
    gaps = line.withColumn("g", (F.col("event_ms") - F.lag("event_ms").over(order)) / 1000)
    return _check(exact_quantiles(gaps, "g", [0.99]), "gap_p99_s", F.max("p99"), timeout_s, lambda a, b: a < b)


def watched_has_metadata(e: DataFrame, content: DataFrame) -> DataFrame:
    """V7."""
    missing = e.select("content_id").distinct().join(content.select("content_id"), "content_id", "left_anti")
    return _check(missing, "contents_without_metadata", F.count("*"), 0, EQUAL)


def session_ends(line: DataFrame) -> DataFrame:
    """``session, end_ms, err, hi, errors``: the first END, last error, last event and number of errors of each session."""
    of = lambda signal: F.when(F.col("signal") == signal, F.col("event_ms"))
    return line.groupBy("session").agg(F.min(of("END")).alias("end_ms"), F.max(of("ERR")).alias("err"), F.max("event_ms").alias("hi"), F.count(of("ERR")).alias("errors"))


def active_after_error(ends: DataFrame, most: int = 20, after_s: int = 5) -> DataFrame:
    """V8: sessions with events more than ``after_s`` after their last error."""
    return _check(ends, "active_after_error", F.count_if(F.col("hi") > F.col("err") + after_s * 1000), most, AT_MOST)


def count_events(name: str, test: Column, bound: float, ok=ABOVE) -> Check:
    """How many events pass a test."""
    return Check(name, F.count_if(test), bound, ok)


def distinct_values(name: str, column: str, low: float, high: float) -> Check:
    """Number of distinct values within [low, high]."""
    return Check(name, F.countDistinct(column), high, lambda a, b: a.between(low, b))


def repeated_events(e: DataFrame) -> DataFrame:
    """Exact duplicates occur, so that deduplication is exercised."""
    twice = e.groupBy("session", "event_ms", "event_type", "event", "event_id").count().where("count > 1")
    return _check(twice, "exact_duplicates", F.count("*"), 0, ABOVE)


def ties(line: DataFrame, bound: float) -> DataFrame:
    """Instants of a session with several events."""
    return _check(line.groupBy("session", "event_ms").count().where("count > 1"), "same_ms_ties", F.count("*"), bound, ABOVE)


def nets_to_zero(deltas: DataFrame) -> DataFrame:
    """Sessions whose deltas do not sum to zero."""
    return _check(deltas.groupBy("session").agg(F.sum("delta_sessions").alias("a"), F.sum("delta_open").alias("o")), "sessions_not_netting", F.count_if((F.col("a") != 0) | (F.col("o") != 0)), 0, EQUAL)


def _against_occupancy(curve: DataFrame, active: DataFrame, start: int, end: int, by: Sequence[str]) -> tuple[DataFrame, Check]:
    counted = active.where((F.col("minute") >= start) & (F.col("minute") < end)).groupBy("minute", *by).agg(F.count("*").alias("n"))
    differs = F.coalesce("concurrency", F.lit(0)) != F.coalesce("n", F.lit(0))
    return curve.join(counted, ["minute", *by], "full_outer"), Check("curve_against_occupancy" + "".join(f"_{c}" for c in by), F.count_if(differs), 0, EQUAL)


def equals_occupancy(curve: DataFrame, active: DataFrame, start: int, end: int, by: Sequence[str] = ()) -> DataFrame:
    """Minutes at which the delta curve differs from counting occupied session-minutes."""
    both, check = _against_occupancy(curve, active, start, end, by)
    return checked(both, [check])


def curve_checks(curve: DataFrame, points: DataFrame, active: DataFrame, start: int, end: int) -> DataFrame:
    """V15, V17, V23 of the curve of all: minutes below zero, minutes that differ from occupancy, and minutes without a delta
    (not in ``points``) whose value differs from the minute before."""
    both, occupancy = _against_occupancy(curve, active, start, end, ())
    before = curve.select((F.col("minute") + 1).alias("minute"), F.col("concurrency").alias("b"))
    rows = both.join(points.select("minute", F.lit(True).alias("moved")), "minute", "left").join(before, "minute", "left")
    negative = Check("negative_minutes", F.count_if(F.col("concurrency") < 0), 0, EQUAL)
    changed = Check("gap_minutes_changed", F.count_if(F.col("moved").isNull() & (F.col("concurrency") != F.col("b"))), 0, EQUAL)
    return checked(rows, [negative, occupancy, changed])


def active_within_presence(active: DataFrame, opened: DataFrame) -> DataFrame:
    """Minutes with more active than present sessions."""
    a = active.groupBy("minute").agg(F.count("*").alias("a"))
    o = opened.groupBy("minute").agg(F.count("*").alias("o"))
    return _check(a.join(o, "minute", "left").fillna(0), "active_over_present", F.count_if(F.col("a") > F.col("o")), 0, EQUAL)


def ledger_is_sound(ledger: DataFrame) -> DataFrame:
    """Rows with a wrong sign, an empty run, or one that overlaps its session's run before."""
    reach = F.lag("run_end").over(W.partitionBy("session").orderBy("run_start"))
    bad = ~F.col("sign").isin(1, -1) | (F.col("run_start") >= F.col("run_end")) | (F.col("run_start") < F.col("reach"))
    return _check(ledger.withColumn("reach", reach), "ledger_faults", F.count_if(bad), 0, EQUAL)


def ledger_run_count(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """How far the number of runs is from that of active minutes without an active one before."""
    before = active.select("session", (F.col("minute") + 1).alias("minute"))
    islands = active.join(before, ["session", "minute"], "left_anti").agg(F.count("*").alias("islands"))
    return _check(ledger.agg(F.count("*").alias("runs")).join(islands), "ledger_run_count", F.max(F.abs(F.col("runs") - F.col("islands"))), 0, EQUAL)  # one row each


def pinned_is_first(line: DataFrame, e: DataFrame) -> DataFrame:
    """Sessions of which some pinned dimension isn't that of the first event."""
    from ..functions.clean import DIMENSIONS, classify_signal, tie_break

    first = e.groupBy("session").agg(F.min_by(F.struct(*DIMENSIONS), F.struct("event_ms", tie_break(classify_signal()), "event_id")).alias("p"))
    pinned = line.select("session", F.struct(*DIMENSIONS).alias("d")).distinct().join(first, "session")
    return _check(pinned, "pins_not_first", F.count_if(~F.col("d").eqNullSafe(F.col("p"))), 0, EQUAL)


def segments_end(ends: DataFrame, segments: DataFrame, timeout_ms: int = 90_000) -> DataFrame:
    """Active segments that begin after their session's END, and those of sessions with an error that outlast the
    timeout of the session's last event."""
    after = Check("active_after_end", F.count_if(F.col("seg_start_ms") > F.col("end_ms")), 0, EQUAL)
    beyond = Check("active_beyond_timeout", F.count_if((F.col("errors") > 0) & (F.col("seg_stop_ms") > F.col("hi") + timeout_ms)), 0, EQUAL)
    return checked(segments.join(ends, "session"), [after, beyond])


def hour_cut_equals(curve: DataFrame, seeded: DataFrame) -> DataFrame:
    """Change minutes at which the hour-cut sum differs from the full one."""
    both = seeded.join(curve.select("minute", F.col("concurrency").alias("full")), "minute")
    return _check(both, "hour_cut_differs", F.count_if(F.col("concurrency") != F.col("full")), 0, EQUAL)


def one_partition_per_session(stored: DataFrame) -> DataFrame:
    """Sessions of a stored table whose rows lie in several of its partition folders."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    return _check(stored.select("session", folder.alias("_folder")).groupBy("session").agg(F.countDistinct("_folder").alias("n")), "sessions_over_partitions", F.count_if(F.col("n") > 1), 0, EQUAL)
