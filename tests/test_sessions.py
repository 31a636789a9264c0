"""Hand-made sessions with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audience as A
from tidemark.operators import curves as Q
from tidemark.operators import deltas as S
from tidemark.operators import gates as G
from tidemark.plans.config import DEFAULT, TIE_ORDER, Rules


def clock(minutes):
    return f"{minutes // 60:02d}:{minutes % 60:02d}"


def runs(events, rules=DEFAULT):
    return sorted((r["session"], clock(r["run_start"]), clock(r["run_end"])) for r in S.runs_of(events, rules).collect())


def beats(start, end, step=35):
    """Heartbeats every ``step`` seconds between two clocks."""
    sec = lambda c: sum(int(x) * f for x, f in zip(c.split(":"), (3600, 60, 1), strict=True))
    return [(f"{t // 3600}:{t % 3600 // 60}:{t % 60}", "HB") for t in range(sec(start) + step, sec(end), step)]


WORKED = [("10:02:01", "START"), ("10:02:03", "PLAY"), *beats("10:02:03", "10:05:30"), ("10:05:30", "PAUSE"), ("10:06:10", "BG"), ("10:09:00", "FG"), ("10:09:05", "RESUME"), *beats("10:09:05", "10:17:45"), ("10:17:45", "END")]


def test_worked_example(make_events):
    assert runs(make_events({"a": WORKED})) == [("a", "10:02", "10:06"), ("a", "10:09", "10:18")]


def test_open_and_missing_markers(make_events):
    events = make_events({
        "no_end": [("10:00:00", "START"), ("10:00:01", "PLAY")],
        "no_start": [("10:00:01", "PLAY"), ("10:00:31", "END")],
        "no_play": [("10:00:00", "START"), ("10:00:30", "HB")],
        "beats_only": [("10:00:00", "HB"), ("10:00:30", "HB")],
        "fg_alone": [("10:00:00", "FG"), ("10:00:30", "HB")],
        "bg_for_good": [("10:00:00", "PLAY"), ("10:00:40", "BG"), ("10:05:00", "HB")],
        "after_end": [("10:00:00", "PLAY"), ("10:00:30", "END"), ("10:02:00", "PLAY")],
        "bg_fg": [("10:00:00", "PLAY"), ("10:00:30", "BG"), ("10:03:00", "FG"), ("10:03:20", "END")],
        "silence": [("10:00:00", "PLAY"), ("10:04:10", "HB")],
        "end_first": [("10:00:00", "END"), ("10:01:00", "START"), ("10:01:01", "PLAY")],
    })
    assert runs(events) == [
        ("after_end", "10:00", "10:01"), ("bg_fg", "10:00", "10:01"), ("bg_fg", "10:03", "10:04"), ("bg_for_good", "10:00", "10:01"),
        ("no_end", "10:00", "10:02"), ("no_start", "10:00", "10:01"), ("silence", "10:00", "10:02"), ("silence", "10:04", "10:06"),
    ]


def test_flapping_counts_one_viewer(make_events):
    flips = [("10:00:00", "PLAY")] + [(f"10:00:{s:02d}", "BG" if s % 2 else "FG") for s in range(1, 21)]
    same_ms = [("10:00:00", "PLAY"), ("10:00:10", "BG"), ("10:00:10", "FG"), ("10:00:20", "END")]
    counted = {r["session"]: r["n"] for r in S.session_minutes(G.segments_of(make_events({"flips": flips, "same": same_ms}))).groupBy("session", "minute").count().groupBy("session").agg(F.max("count").alias("n")).collect()}
    assert counted == {"flips": 1, "same": 1}


def test_duplicates_and_order_do_not_matter(make_events):
    once = make_events({"a": WORKED})
    rows = once.collect() * 2
    random.Random(1).shuffle(rows)
    again = once.sparkSession.createDataFrame(rows, once.schema)
    assert runs(again) == runs(once)


def test_closed_end_minute_and_zero_length(make_events):
    assert runs(make_events({"edge": [("10:00:30", "PLAY"), ("10:01:00", "PAUSE")]})) == [("edge", "10:00", "10:02")]
    tied = make_events({"tied": [("10:00:30", "PLAY"), ("10:00:30", "PAUSE")]})
    assert runs(tied) == [("tied", "10:00", "10:01")]
    assert G.active_intervals(tied).count() == 0


def test_error_policies(make_events):
    events = make_events({"e": [("10:00:00", "PLAY"), ("10:00:30", "ERR"), ("10:01:30", "RESUME"), ("10:02:10", "END")]})
    assert runs(events) == [("e", "10:00", "10:03")]
    assert runs(events, Rules(error_policy="inactive")) == [("e", "10:00", "10:03")]
    assert runs(events, Rules(error_policy="terminal")) == [("e", "10:00", "10:01")]


def test_downloads_can_be_ignored(make_events):
    events = make_events({"d": [("10:00:00", "PLAY"), ("10:01:20", "DOWNLOAD"), ("10:02:40", "DOWNLOAD")]})
    assert runs(events) == [("d", "10:00", "10:05")]
    assert runs(events, Rules(ignore_downloads=True)) == [("d", "10:00", "10:02")]


def test_tie_order_is_a_parameter(make_events):
    events = make_events({"t": [("10:00:00", "PLAY"), ("10:00:30", "BG"), ("10:00:30", "FG"), ("10:01:10", "HB")]})
    other = Rules(tie_order=tuple(x for x in TIE_ORDER if x not in ("FG", "HB")) + ("FG", "HB"))
    assert runs(events) == [("t", "10:00", "10:01")]
    assert runs(events, other) == [("t", "10:00", "10:03")]


def test_running_sum_across_days(spark):
    steps = [(1, 1), (1439, 2), (1441, -1), (2885, -2), (2886, 5)]
    got = Q.running_sum(spark.createDataFrame(steps, "minute long, d long"), ["d"]).orderBy("minute").collect()
    assert [r["d"] for r in got] == [1, 3, 2, 0, 5]


def test_window_carries_history(spark):
    deltas = spark.createDataFrame([("s", 100, 50)], "platform string, minute long, delta_sessions long")
    assert [r["concurrency"] for r in Q.dense_curve(deltas, 200, 203).orderBy("minute").collect()] == [50, 50, 50]
    assert Q.dense_curve(deltas.limit(0), 200, 203).agg(F.sum("concurrency")).first()[0] == 0


def test_worked_deltas_run_1_2_1_2_1_0(spark):
    rows = [(602, 1), (606, -1), (609, 1), (618, -1), (603, 1), (612, -1)]
    deltas = spark.createDataFrame(rows, "minute long, delta_sessions long")
    assert [r["cc"] for r in Q.change_points(deltas).orderBy("minute").collect()] == [1, 2, 1, 2, 1, 0]


def test_union_peak_is_below_the_sum_of_peaks(spark):
    deltas = spark.createDataFrame([("a", 10, 5), ("a", 11, -5), ("b", 20, 4), ("b", 21, -4)], "platform string, minute long, delta_sessions long")
    peak = lambda d: Q.peak_summary(Q.dense_curve(d, 0, 30)).first()["peak"]
    assert peak(deltas) == 5 < peak(deltas.where("platform = 'a'")) + peak(deltas.where("platform = 'b'"))


def test_local_peaks_are_spaced(spark):
    curve = spark.createDataFrame([(m, v) for m, v in [(0, 5), (5, 9), (14, 8), (20, 7), (40, 9)]], "minute long, concurrency long")
    assert sorted((r["minute"], r["concurrency"]) for r in Q.local_peaks(curve, 3, 15).collect()) == [(5, 9), (20, 7), (40, 9)]


def test_trend_needs_two_points(spark):
    deltas = spark.createDataFrame([(100, 3)], "minute long, delta_sessions long")
    assert Q.trend(deltas, 105).first()["direction"] == "insufficient_data"
    assert Q.predict_load(Q.trend(deltas, 105)).first()["action"] == "insufficient_data"


def test_full_range_overwrites_stale_rows(make_events):
    events = make_events({"a": WORKED})
    line = G.timeline(events)
    spans = S.session_spans(line)
    merged = S.deltas_of(events)
    full = S.full_range_deltas(spans, merged)
    assert full.count() == full.select("minute").distinct().count() and full.agg(F.sum("delta_sessions")).first()[0] == 0
    old = merged.withColumns({"computed_ms": F.lit(1), "delta_sessions": F.col("delta_sessions") + 7})
    new = full.withColumn("computed_ms", F.lit(2))
    now = S.current_deltas(old.select(*new.columns).unionByName(new))
    assert sorted(now.where("delta_sessions <> 0").select("minute", "delta_sessions").collect()) == sorted(merged.where("delta_sessions <> 0").select("minute", "delta_sessions").collect())


@pytest.mark.parametrize("rules", [Rules(), Rules(error_policy="inactive", fg_default=0), Rules(error_policy="terminal", use_liveness=False, ignore_downloads=True)])
def test_gates_by_a_prefix_scan_equal_those_by_windows(make_events, rules):
    rng = random.Random(8)
    names = ["START", "PLAY", "BG", "FG", "PAUSE", "RESUME", "ERR", "HB", "HB", "DOWNLOAD"]
    clock = lambda i: f"{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}"
    hot = [(clock(rng.randrange(6 * 3600)), rng.choice(names)) for _ in range(600)] + [("05:50:00", "END")]
    sessions = {"hot": hot} | {f"s{i}": [(clock(rng.randrange(3600)), rng.choice([*names, "END"])) for _ in range(30)] for i in range(40)}
    events = make_events(sessions)
    want = G.liveness_segments(G.gate_states(G.timeline(events, rules), rules), rules)
    got = G.chunked_segments(G.chunked_timeline(events, rules), rules)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session" in plan and "_chunk" in plan.split("hashpartitioning(session", 1)[1][:40]


def test_intervals_meet_points_and_ranges_once(spark):
    rng = random.Random(3)
    hour = 3_600_000
    spans = [(f"s{i}", f"u{i % 7}", a := rng.randrange(9 * hour), a + rng.choice([0, 1, 60_000, hour, 4 * hour])) for i in range(80)]
    intervals = spark.createDataFrame(spans, "session string, user_id string, start_ms long, end_ms long")
    points = [rng.randrange(10 * hour) for _ in range(50)] + [spans[0][2], spans[0][3]]
    got = Q.stabbing_join(intervals, spark.createDataFrame([(p,) for p in points], "at_ms long"), "at_ms").select("session", "at_ms").collect()
    assert sorted(map(tuple, got)) == sorted((s, p) for s, _, a, b in spans for p in points if a <= p < b)
    ranges = [(f"r{i}", lo := rng.randrange(600), lo + rng.choice([0, 1, 30, 300])) for i in range(30)]
    frame = spark.createDataFrame(ranges, "range_name string, start_minute long, end_minute long")
    met = Q.overlap_join(intervals, frame.selectExpr("range_name", "start_minute * 60000 AS lo", "end_minute * 60000 AS hi"), "lo", "hi").select("session", "range_name").collect()
    assert sorted(map(tuple, met)) == sorted((s, r) for s, _, a, b in spans for r, lo, hi in ranges if a < hi * 60_000 and b > lo * 60_000 and a < b and lo < hi)
    named = {r["range_name"]: r for r in Q.range_audience(intervals, frame.where("start_minute < end_minute")).collect()}
    for r, lo, hi in ranges:
        inside = [(s, u, min(b, hi * 60_000) - max(a, lo * 60_000)) for s, u, a, b in spans if a < hi * 60_000 and b > lo * 60_000 and a < b]
        if lo < hi:
            assert (named[r]["sessions"], named[r]["users"]) == (len(inside), len({x[1] for x in inside})) and abs(named[r]["avg_time_weighted"] - sum(x[2] for x in inside) / ((hi - lo) * 60_000)) < 0.001


def test_concurrency_at_any_number_of_minutes(spark, make_events):
    events = make_events({"a": [("10:00:10", "PLAY"), ("10:01:00", "HB"), ("10:02:20", "END")], "b": [("10:01:30", "PLAY"), ("10:02:00", "PAUSE")]})
    deltas, intervals = S.deltas_of(events), G.active_intervals(events)
    asked = spark.range(598, 606).select(F.col("id").alias("at_minute"))
    got = {r["at_minute"]: (r["prefix_sum"], r["covering"]) for r in Q.concurrency_at(deltas, intervals, asked).collect()}
    level = lambda m: sum(r["delta_sessions"] for r in deltas.collect() if r["minute"] <= m)
    assert got == {m: (level(m), sum(r["start_ms"] <= m * 60_000 < r["end_ms"] for r in intervals.collect())) for m in range(598, 606)}


def test_overlapping_sessions_of_a_user(make_events):
    rng = random.Random(11)
    spans = {f"s{i}": (a := rng.randrange(3000), a + rng.choice([0, 10, 600])) for i in range(40)}
    clock = lambda i: f"{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}"
    events = make_events({s: [(clock(a), "PLAY"), (clock(b), "HB")] for s, (a, b) in spans.items()}).withColumn("user_id", F.concat(F.lit("u"), F.substring("session", -1, 1)))
    want = {}
    for s, (a, b) in spans.items():
        for t, (c, d) in spans.items():
            if s < t and s[-1] == t[-1] and a <= d and c <= b:
                want["u" + s[-1]] = want.get("u" + s[-1], 0) + 1
    assert {r["user_id"]: r["pairs"] for r in A.overlapping_session_pairs(G.timeline(events)).collect()} == want and want
