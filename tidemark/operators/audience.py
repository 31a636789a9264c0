"""Audience analytics: batch jobs over events, sessions and states.

``e`` is the typed event table (duplicates included), ``line`` the deduplicated timeline with signals and pinned
dimensions, ``states`` the timeline with gates.  Quantiles are exact interpolated percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import KEEPALIVE, QUALITY
from ..functions.numbers import rounded
from ..functions.times import DAY, HOUR, MINUTE_MS, div, minute_of
from .quantiles import exact_quantiles, joined


HOUR_MS = 3_600_000
ORDER = ["event_ms", "tie_break", "event_id"]
STATE_SIGNALS = ("START", "PLAY", "PAUSE", "RESUME", "BG", "FG", "ERR", "END")


def _session_order():
    return W.partitionBy("session").orderBy(*ORDER)


def quantiles(rows: DataFrame, value: str, by: Sequence[str] = (), at: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    p = [rounded(name, 4).alias(name) for name in (f"p{round(q * 100)}" for q in at)]
    return exact_quantiles(rows, value, at, by).select(*by, "n", *p, "least", "most")


def dataset_counts(e: DataFrame) -> DataFrame:
    return e.agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users"), F.countDistinct("content_id").alias("contents"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"))


def events_by(e: DataFrame, minutes: int) -> DataFrame:
    """Events, sessions and users by day (1440) or hour (60)."""
    return e.groupBy((div(minute_of("event_ms"), minutes) * minutes).alias("bucket")).agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users"))


def events_by_date(e: DataFrame) -> DataFrame:
    return events_by(e, DAY)


def events_by_hour(e: DataFrame) -> DataFrame:
    return events_by(e, HOUR)


def naive_minutes(e: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return e.groupBy(minute_of("event_ms").alias("minute"), *by).agg(F.countDistinct("session").alias("naive"))


def naive_minute_concurrency(e: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` minutes by sessions with any event, earlier first on ties."""
    return naive_minutes(e).orderBy(F.desc("naive"), "minute").limit(top)


def event_breakdown(e: DataFrame) -> DataFrame:
    return e.groupBy("event_type", "event").agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"))


def session_spans(e: DataFrame) -> DataFrame:
    return e.groupBy("session").agg(F.min("event_ms").alias("lo"), F.max("event_ms").alias("hi"), F.count("*").alias("events")).withColumn("duration_s", (F.col("hi") - F.col("lo")) / 1000)


def session_duration_quantiles(e: DataFrame) -> DataFrame:
    return quantiles(session_spans(e), "duration_s")


def events_per_session_quantiles(e: DataFrame) -> DataFrame:
    return quantiles(session_spans(e), "events")


def session_content_cardinality(e: DataFrame) -> DataFrame:
    """Number of sessions by number of distinct contents."""
    return e.groupBy("session").agg(F.countDistinct("content_id").alias("contents")).groupBy("contents").agg(F.count("*").alias("sessions"))


def open_sessions(e: DataFrame) -> DataFrame:
    """Sessions without an END, with their last event."""
    ended = e.where(F.col("event_type") == "VideoSessionEnd").select("session").distinct()
    return e.join(ended, "session", "left_anti").groupBy("session").agg(F.max("event_ms").alias("last_ms"), F.count("*").alias("events"))


def _gaps(line: DataFrame) -> DataFrame:
    return line.withColumn("gap_s", (F.col("event_ms") - F.lag("event_ms").over(_session_order())) / 1000).where("gap_s IS NOT NULL")


def heartbeat_gap_quantiles(line: DataFrame) -> DataFrame:
    """Gaps between successive beats of one keepalive family in a session."""
    order = W.partitionBy("session", "event").orderBy("event_ms", "event_id")
    rows = line.where(F.col("event").isin(*KEEPALIVE)).withColumn("gap_s", (F.col("event_ms") - F.lag("event_ms").over(order)) / 1000).where("gap_s IS NOT NULL")
    return quantiles(rows, "gap_s", ["event"])


def event_gap_quantiles(line: DataFrame) -> DataFrame:
    return quantiles(_gaps(line), "gap_s")


def gap_histogram(line: DataFrame) -> DataFrame:
    g, edges = F.col("gap_s"), ((5, "0-5s"), (30, "5-30s"), (45, "30-45s"), (60, "45-60s"), (90, "60-90s"), (300, "90-300s"), (600, "5-10min"))
    bin_of = F.lit(">10min")
    for edge, name in reversed(edges):
        bin_of = F.when(g <= edge, name).otherwise(bin_of)
    return _gaps(line).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("gaps"))


def _until_next(line: DataFrame, kept: Column, opening: Column) -> DataFrame:
    """Rows of ``opening`` among the rows ``kept``, with the kept row that follows."""
    rows = line.where(kept).withColumns({"next_signal": F.lead("signal").over(_session_order()), "next_event": F.lead("event").over(_session_order()), "next_ms": F.lead("event_ms").over(_session_order())})
    return rows.where(opening).withColumn("gap_s", (F.col("next_ms") - F.col("event_ms")) / 1000)


def background_durations(line: DataFrame) -> DataFrame:
    s = F.col("signal")
    return quantiles(_until_next(line, s.isin("BG", "FG"), s == "BG").where("next_signal = 'FG'"), "gap_s")


def after_background(line: DataFrame) -> DataFrame:
    """The next state signal after a backgrounding, how often, and its mean delay."""
    rows = _until_next(line, F.col("signal").isin(*STATE_SIGNALS), F.col("signal") == "BG")
    return rows.groupBy(F.coalesce("next_signal", F.lit("none")).alias("next_signal")).agg(F.count("*").alias("n"), rounded(F.avg("gap_s"), 4).alias("mean_s"))


def pause_durations(line: DataFrame) -> DataFrame:
    s = F.col("signal")
    return quantiles(_until_next(line, s.isin("PAUSE", "RESUME"), s == "PAUSE").where("next_signal = 'RESUME'"), "gap_s")


def buffer_durations(line: DataFrame, closing: Sequence[str] = ("BufferEnd",)) -> DataFrame:
    """BufferStart to the next closing event of the buffer family."""
    e = F.col("event")
    return quantiles(_until_next(line, e.isin("BufferStart", *closing), e == "BufferStart").where(F.col("next_event").isin(*closing)), "gap_s")


def startup_latency(line: DataFrame) -> DataFrame:
    """START to the first PLAY not before it, by platform; an earlier PLAY does not hide a later one."""
    s = F.col("signal")
    start = F.min(F.when(s == "START", F.col("event_ms"))).over(W.partitionBy("session"))
    first = line.withColumn("a", start).where((s == "PLAY") & (F.col("event_ms") >= F.col("a"))).groupBy("session", "platform").agg(((F.min("event_ms") - F.min("a")) / 1000).alias("gap_s"))
    return quantiles(first, "gap_s", ["platform"], (0.5, 0.9, 0.99))


def qoe_by_platform(e: DataFrame) -> DataFrame:
    """Buffer starts, quality downshifts and dropped frames per session and the error rate, by platform."""
    n = F.countDistinct("session")
    per = lambda c, name: rounded(F.count_if(c) / n, 6).alias(name)
    event = F.col("event")
    return e.groupBy("platform").agg(n.alias("sessions"), per(event == "BufferStart", "buffers_per_session"), per(event == "downshift", "downshifts_per_session"), per(event == "dropped-frames", "dropped_frames_per_session"), rounded(F.count_if(F.col("event_type") == "VideoError") / F.count("*"), 6).alias("error_rate"))


def error_outcomes(line: DataFrame) -> DataFrame:
    """Sessions with an error: whether they ended, were the last event's, or went on to play."""
    s = F.col("signal")
    last_error = F.max(F.when(s == "ERR", F.col("event_ms"))).over(W.partitionBy("session"))
    rows = line.withColumn("err", last_error).where("err IS NOT NULL").groupBy("session").agg(F.max((s == "END").cast("int")).alias("ended"), F.max(((F.col("event_ms") > F.col("err")) & s.isin("PLAY", "RESUME", "FG")).cast("int")).alias("recovered"), F.max((F.col("event_ms") > F.col("err")).cast("int")).alias("went_on"))
    return rows.groupBy("ended", "recovered", "went_on").agg(F.count("*").alias("sessions"))


def breakdown_by(e: DataFrame, dim: str) -> DataFrame:
    return e.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users")).withColumn("dimension", F.lit(dim))


def _per_session(line: DataFrame, content: DataFrame) -> DataFrame:
    s = F.col("signal")
    rows = line.groupBy("session", "platform", "content_id").agg(((F.max("event_ms") - F.min("event_ms")) / 1000).alias("duration_s"), F.count_if(s == "BG").alias("bg"), F.count_if(s == "PAUSE").alias("pauses"))
    return rows.join(content.select("content_id", "video_type"), "content_id", "left").fillna("unknown", ["video_type"])


def engagement_by_video_type(line: DataFrame, content: DataFrame) -> DataFrame:
    rows = _per_session(line, content).groupBy("video_type").agg(F.count("*").alias("sessions"), rounded(F.avg("duration_s"), 4).alias("mean_duration_s"), rounded(F.avg("bg"), 6).alias("bg_per_session"), F.sum("pauses").alias("p"), F.sum("duration_s").alias("d"))
    return rows.select("video_type", "sessions", "mean_duration_s", "bg_per_session", rounded(F.col("p") * 60 / F.greatest("d", F.lit(1.0)), 6).alias("pauses_per_minute"))


def duration_by_type_platform(line: DataFrame, content: DataFrame) -> DataFrame:
    return _per_session(line, content).groupBy("video_type", "platform").agg(F.count("*").alias("sessions"), rounded(F.avg("duration_s"), 4).alias("mean_duration_s"))


def session_patterns(line: DataFrame) -> DataFrame:
    s = F.col("signal")
    flags = line.groupBy("session").agg((F.max("event_ms") - F.min("event_ms")).alias("ms"), F.max((s == "BG").cast("int")).alias("bg"), F.max((s == "PAUSE").cast("int")).alias("pause"))
    pattern = F.when(F.col("ms") < MINUTE_MS, "bounced").when((F.col("bg") == 1) & (F.col("pause") == 1), "mixed").when(F.col("bg") == 1, "background_only").when(F.col("pause") == 1, "pause_only").otherwise("uninterrupted")
    return flags.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("sessions"))


def fg_vs_naive(curve: DataFrame, e: DataFrame) -> DataFrame:
    """Active against any-event sessions in each minute, their ratio, and the ratios of the peaks and of the means."""
    both = curve.join(naive_minutes(e), "minute", "left").fillna(0, ["naive"])
    ratio = lambda f, name: rounded(f("naive") / F.nullif(f("concurrency"), F.lit(0)), 6).alias(name)
    whole = both.agg(ratio(F.max, "peak_overcount"), ratio(F.sum, "mean_overcount"))  # one row
    return both.withColumn("overcount", rounded(F.col("naive") / F.nullif("concurrency", F.lit(0)), 6)).join(whole)


def fg_share_at_minute(active: DataFrame, e: DataFrame, minute: int, dim: str = "platform") -> DataFrame:
    """Sessions present and active at one minute by a dimension, and the content that most of the active ones watch."""
    present = e.where(minute_of("event_ms") == minute).groupBy(dim).agg(F.countDistinct("session").alias("present"))
    now = active.where(F.col("minute") == minute)
    counted = now.groupBy(dim).agg(F.count("*").alias("active"))
    top = now.groupBy(dim, "content_id").agg(F.count("*").alias("n")).groupBy(dim).agg(F.min_by("content_id", F.struct(-F.col("n"), F.col("content_id"))).alias("top_content"))
    return present.join(counted, dim, "full_outer").fillna(0).join(top, dim, "left")


def sessions_per_user(e: DataFrame) -> DataFrame:
    """How many users have how many sessions."""
    return e.groupBy("user_id").agg(F.countDistinct("session").alias("sessions")).groupBy("sessions").agg(F.count("*").alias("users"))


def heavy_users(e: DataFrame, max_sessions: int) -> DataFrame:
    """Users with more than ``max_sessions`` sessions, with their events and the time from first to last."""
    rows = e.groupBy("user_id").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("events"), ((F.max("event_ms") - F.min("event_ms")) / 1000).alias("span_s"))
    return rows.where(F.col("sessions") > max_sessions)


def _user_spans(line: DataFrame) -> DataFrame:
    return line.groupBy("session", "user_id", "platform").agg(F.min("event_ms").alias("lo"), F.max("event_ms").alias("hi"))


def overlapping_session_pairs(line: DataFrame) -> DataFrame:
    """Per user, the number of pairs of sessions that overlap in time, counted without listing pairs.

    A pair overlaps if the later start is not after the earlier end.  With starts and ends as +1/-1 steps (starts first
    at one instant), each start overlaps exactly the sessions then open, so the pairs are a running sum's total.
    """
    step = lambda at, d: F.struct(F.col(at).alias("at"), F.lit(d).alias("d"))
    steps = _user_spans(line).select("user_id", F.explode(F.array(step("lo", 1), step("hi", -1))).alias("s")).select("user_id", "s.*")
    order = W.partitionBy("user_id").orderBy("at", F.desc("d")).rowsBetween(W.unboundedPreceding, -1)
    opened = steps.withColumn("open", F.coalesce(F.sum("d").over(order), F.lit(0))).where("d = 1")
    return opened.groupBy("user_id").agg(F.sum("open").alias("pairs")).where("pairs > 0")


def multi_platform_users(e: DataFrame) -> DataFrame:
    """Users seen on more than one platform within one minute, by combination."""
    rows = e.groupBy("user_id", minute_of("event_ms").alias("minute")).agg(F.array_join(F.array_sort(F.collect_set("platform")), "+").alias("platforms"), F.countDistinct("platform").alias("n")).where("n > 1")
    return rows.groupBy("platforms").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("minutes"))


def late_after_end(line: DataFrame) -> DataFrame:
    """Events after their session's first END, by kind: events, sessions, mean delay."""
    end = F.min(F.when(F.col("signal") == "END", F.col("event_ms"))).over(W.partitionBy("session"))
    late = line.withColumn("end_ms", end).where("event_ms > end_ms")
    return late.groupBy("event_type", "event").agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), rounded(F.avg((F.col("event_ms") - F.col("end_ms")) / 1000), 4).alias("mean_delay_s"))


def same_ms_ties(line: DataFrame) -> DataFrame:
    """Instants of a session with several events, and those among them with differing signals."""
    ties = line.groupBy("session", "event_ms").agg(F.count("*").alias("n"), F.countDistinct("signal").alias("signals")).where("n > 1")
    return ties.agg(F.count("*").alias("ties"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count_if(F.col("signals") > 1).alias("differing"))


def redundant_transitions(line: DataFrame) -> DataFrame:
    """State signals that repeat the state before them, by pair."""
    s = F.col("signal")
    rows = line.where(s.isin("PLAY", "RESUME", "PAUSE", "BG", "FG")).withColumn("on", s.isin("PLAY", "RESUME", "FG").cast("int"))
    rows = rows.withColumns({"before": F.lag("signal").over(_session_order()), "was_on": F.lag("on").over(_session_order())}).where("was_on = on")
    return rows.groupBy("before", "signal").agg(F.count("*").alias("n"))


def lifecycle_completeness(line: DataFrame) -> DataFrame:
    s = F.col("signal")
    has = lambda x: F.max((s == x).cast("int")).alias(f"has_{x.lower()}")
    rows = line.groupBy("session").agg(has("START"), has("PLAY"), has("END"), F.min_by("signal", F.struct(*ORDER)).alias("first_signal"), F.max_by("signal", F.struct(*ORDER)).alias("last_signal"))
    return rows.groupBy("has_start", "has_play", "has_end", "first_signal", "last_signal").agg(F.count("*").alias("sessions"))


PROFILED = ("platform", "app_version", "country", "audio_language", "subtitle_language", "player_version", "video_resolution", "title", "video_type", "category", "show_name")


def _unpivot(row: DataFrame, value: str) -> DataFrame:
    return row.unpivot([], list(row.columns), "dimension", value)


def dimension_cardinality(e: DataFrame) -> DataFrame:
    return _unpivot(e.agg(*[F.countDistinct(c).alias(c) for c in PROFILED]), "values")


def dimension_completeness(e: DataFrame) -> DataFrame:
    """Share of events whose dimension is given: not null, '', 'unknown', 'UNK' or 'off'."""
    given = lambda c: F.col(c).isNotNull() & ~F.lower(c).isin("", "unknown", "unk", "off")
    return _unpivot(e.agg(*[rounded(F.count_if(given(c)) / F.count("*"), 6).alias(c) for c in PROFILED]), "share")


def dimension_drift(e: DataFrame) -> DataFrame:
    """Sessions with more than one value of a dimension; ``user_id`` counts shared sessions."""
    dims = ["platform", "country", "video_resolution", "content_id", "user_id"]
    each = e.groupBy("session").agg(*[F.countDistinct(c).alias(c) for c in dims])
    return _unpivot(each.agg(*[F.count_if(F.col(c) > 1).alias(c) for c in dims]), "sessions")


def bg_fg_balance(line: DataFrame) -> DataFrame:
    s = F.col("signal")
    rows = line.groupBy("session").agg((F.count_if(s == "BG") - F.count_if(s == "FG")).alias("bg_minus_fg"), (F.count_if(s == "RESUME") - F.count_if(s == "PAUSE")).alias("resumes_minus_pauses"))
    return rows.groupBy("bg_minus_fg", "resumes_minus_pauses").agg(F.count("*").alias("sessions"))


def liveness_family_coverage(e: DataFrame) -> DataFrame:
    seen = lambda c: F.countDistinct(F.when(c, F.col("session")))
    row = e.agg(*[seen(F.col("event") == k).alias(k) for k in KEEPALIVE], seen(F.col("event").isin(*KEEPALIVE)).alias("any"), F.countDistinct("session").alias("all"))
    return row.unpivot([], [F.col(f"`{c}`") for c in row.columns], "family", "sessions")


def background_signal_share(states: DataFrame) -> DataFrame:
    beats = states.where(F.col("event_type") == "VideoHeartbeat")
    return beats.groupBy("event").agg(F.count("*").alias("n"), rounded(F.count_if(F.col("fg") == 0) / F.count("*"), 6).alias("background_share"))


def dim_join_coverage(e: DataFrame, content: DataFrame) -> DataFrame:
    """Watched contents, those without metadata, and their events."""
    watched = e.groupBy("content_id").agg(F.count("*").alias("events"))
    missing = watched.join(content.select("content_id"), "content_id", "left_anti").agg(F.count("*").alias("missing_contents"), F.coalesce(F.sum("events"), F.lit(0)).alias("missing_events"))
    return watched.agg(F.count("*").alias("watched_contents")).join(missing)  # one row each


def heartbeat_write_amplification(line: DataFrame) -> DataFrame:
    """Share of successive events that stay in the minute of the one before and so change no served row."""
    step = line.withColumn("before", F.lag("event_ms").over(_session_order())).where("before IS NOT NULL")
    moved = minute_of("event_ms") - minute_of("before")
    return step.agg(F.count("*").alias("steps"), F.count_if(moved == 0).alias("stayed"), F.count_if(moved == 1).alias("advanced"), rounded(F.count_if(moved == 0) / F.count("*"), 6).alias("same_share"))


def heartbeat_taxonomy(states: DataFrame) -> DataFrame:
    """Heartbeat events by measured class: count, gap spread over median, share sent in the background."""
    order = W.partitionBy("session", "event").orderBy("event_ms", "event_id")
    beats = states.where(F.col("event_type") == "VideoHeartbeat").withColumn("gap_s", (F.col("event_ms") - F.lag("event_ms").over(order)) / 1000)
    name, signal = F.col("event"), F.col("signal")
    kind = F.when(signal.isin("PAUSE", "RESUME"), "STATE").when(F.lower(name).like("download%"), "DOWNLOAD").when(F.lower(name).like("ad%"), "AD").when(name.isin(*KEEPALIVE), "KEEPALIVE").when(name.isin(*QUALITY), "QUALITY").otherwise("UX")
    named = beats.withColumn("class", kind)
    counted = named.groupBy("class", "event").agg(F.count("*").alias("n"), rounded(F.avg((F.col("fg") == 0).cast("int")), 6).alias("background_share"))
    spread = exact_quantiles(named, "gap_s", (0.25, 0.5, 0.75), ["class", "event"]).select("class", "event", rounded((F.col("p75") - F.col("p25")) / F.nullif("p50", F.lit(0.0)), 4).alias("iqr_over_median"))
    return joined(counted, spread, ["class", "event"], "left")


def opening_closing_signatures(line: DataFrame, length: int = 4) -> DataFrame:
    """The first and last ``length`` signals of sessions, counted."""
    def side(name: str, order) -> DataFrame:
        rows = line.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(*order))).where(F.col("n") <= length)
        chain = F.array_sort(F.collect_list(F.struct("n", "signal")))
        words = F.transform(chain if name == "opening" else F.reverse(chain), lambda x: x["signal"])
        return rows.groupBy("session").agg(F.array_join(words, ">").alias("signature")).groupBy("signature").agg(F.count("*").alias("sessions")).withColumn("side", F.lit(name))

    return side("opening", [F.col(c) for c in ORDER]).unionByName(side("closing", [F.col(c).desc() for c in ORDER]))


def signal_trigrams(line: DataFrame) -> DataFrame:
    w = _session_order()
    rows = line.where(F.col("signal") != "HB").select("signal", F.lead("signal", 1).over(w).alias("b"), F.lead("signal", 2).over(w).alias("c")).where("c IS NOT NULL")
    return rows.groupBy(F.concat_ws(">", "signal", "b", "c").alias("trigram")).agg(F.count("*").alias("n"))


def exclusion_reasons(states: DataFrame, timeout_ms: int = 90_000) -> DataFrame:
    """Wall-clock time between events by the gates that are closed in it; the time past the timeout is stale."""
    rows = states.withColumn("next_ms", F.lead("event_ms").over(_session_order())).where("next_ms IS NOT NULL AND ended = 0").withColumn("gap", F.col("next_ms") - F.col("event_ms"))
    part = lambda stale, ms: F.struct(F.lit(stale).alias("stale"), ms.alias("ms"))
    cut = rows.select("fg", "playing", F.explode(F.array(part(0, F.least("gap", F.lit(timeout_ms))), part(1, F.greatest(F.col("gap") - timeout_ms, F.lit(0))))).alias("p")).where("p.ms > 0 OR p.stale = 0")
    reason = F.concat_ws("+", F.when(F.col("fg") == 0, "background"), F.when(F.col("playing") == 0, "paused"), F.when(F.col("p.stale") == 1, "stale"))
    return cut.groupBy(F.when(reason == "", "active").otherwise(reason).alias("reason")).agg(F.count("*").alias("segments"), rounded(F.sum("p.ms") / HOUR_MS, 4).alias("hours"))


def session_archetypes(states: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sessions by shape: wall-clock and active hours, what share is kept, mean number of intervals."""
    s, order = F.col("signal"), F.struct(*ORDER)
    shape = states.groupBy("session").agg(((F.max("event_ms") - F.min("event_ms")) / HOUR_MS).alias("wall"), F.count_if(s == "BG").alias("bg"), F.max((s == "ERR").cast("int")).alias("err"), F.max_by("fg", order).alias("last_fg"))
    active = intervals.groupBy("session").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / HOUR_MS).alias("active"), F.count("*").alias("n"))
    name = F.when(F.col("wall") > 6, "marathon").when(F.col("err") == 1, "errored").when(F.col("last_fg") == 0, "ended_backgrounded").when(F.col("bg") >= 2, "multi_excursion").when(F.col("bg") == 1, "single_excursion").otherwise("never_backgrounded")
    rows = shape.join(active, "session", "left").fillna(0).groupBy(name.alias("archetype"))
    out = rows.agg(F.count("*").alias("sessions"), F.sum("wall").alias("w"), F.sum("active").alias("a"), rounded(F.avg("n"), 4).alias("mean_intervals"))
    return out.select("archetype", "sessions", rounded("w", 4).alias("wall_hours"), rounded("a", 4).alias("active_hours"), rounded(F.col("a") / F.nullif("w", F.lit(0.0)), 4).alias("retained"), "mean_intervals")


def state_paths(line: DataFrame, shown: int = 8) -> DataFrame:
    """Heartbeat-free signal paths: each path's length, its first ``shown`` signals, how many sessions take it, their share.

    A path is the hash chain of its (place, signal) pairs, so a session's signals are never gathered into one value.
    """
    rows = line.where(F.col("signal") != "HB").withColumn("n", F.row_number().over(_session_order()))
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "signal"))))
    paths = rows.groupBy("session").agg(F.sum(F.xxhash64("n", "signal").cast("decimal(38,0)")).alias("path"), F.count("*").alias("length"), F.array_join(first["signal"], ">").alias("opening"))
    counted = paths.groupBy("path", "length", "opening").agg(F.count("*").alias("sessions"))
    return counted.select("length", "opening", "sessions", rounded(F.col("sessions") / F.sum("sessions").over(W.partitionBy()), 6).alias("share"))


def contradictory_transitions(line: DataFrame) -> DataFrame:
    """Heartbeat-free signals that repeat the one before them or follow an END, by pair."""
    rows = line.where(F.col("signal") != "HB").withColumn("before", F.lag("signal").over(_session_order()))
    return rows.where((F.col("before") == F.col("signal")) | (F.col("before") == "END")).groupBy("before", "signal").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


def ux_while_background(states: DataFrame) -> DataFrame:
    """Signals of a user at the screen while the foreground gate is closed."""
    return states.where((F.col("fg") == 0) & F.col("signal").isin("PLAY", "PAUSE", "RESUME")).groupBy("signal", "event").agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"))


def without_heavy_users(e: DataFrame, max_sessions: int) -> DataFrame:
    """Events of users with at most ``max_sessions`` sessions."""
    heavy = e.groupBy("user_id").agg(F.countDistinct("session").alias("n")).where(F.col("n") > max_sessions).select("user_id")
    return e.join(heavy, "user_id", "left_anti")


