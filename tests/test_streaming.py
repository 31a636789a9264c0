"""The recompute's restart and retry, and the session fold beside the batch form under any order of arrival."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clean import DIMENSIONS, classify_signal, event_role, tie_break
from tidemark.operators import curves as Q
from tidemark.operators import deltas as S
from tidemark.operators import rollups as R
from tidemark.operators.gates import segments_of, timeline
from tidemark.plans.config import Rules
from tidemark.sources.shared import shared_path
from tidemark.streaming import live

FIRST = {"a": [("10:00:00", "PLAY"), ("10:00:50", "HB"), ("10:01:40", "PAUSE")], "b": [("10:02:00", "PLAY"), ("10:03:10", "END")]}
THEN = {"c": [("10:05:00", "PLAY"), ("10:05:30", "ERR"), ("10:06:20", "HB")], "a": [("10:01:00", "BG"), ("10:09:00", "FG"), ("10:09:10", "RESUME")]}


def rows(df):
    return sorted(map(tuple, df.select("session", "minute", "delta_sessions", "delta_open").collect()))


@pytest.fixture()
def batches(make_events):
    first, second = make_events(FIRST), make_events(THEN)
    return first, second, first.unionByName(second)


def test_a_restart_keeps_what_was_committed(spark, batches):
    first, second, every = batches
    root = shared_path(spark, "restart")
    live.DeltaTable(spark, root).apply(first, 0)
    live.DeltaTable(spark, root).apply(second, 1)
    assert rows(live.DeltaTable(spark, root).read()) == rows(S.deltas_of(every))


def test_a_repeated_batch_changes_nothing(spark, batches):
    first, second, every = batches
    table = live.DeltaTable(spark, shared_path(spark, "repeat"))
    for batch, i in ((first, 0), (second, 1), (second, 1), (first, 0)):
        table.apply(batch, i)
    assert rows(table.read()) == rows(S.deltas_of(every))
    again = live.DeltaTable(spark, table.root)
    again.apply(second, 1)
    assert rows(again.read()) == rows(S.deltas_of(every)) and len(again.history) == 2


def test_a_failed_attempt_leaves_no_trace(spark, batches, monkeypatch):
    first, second, every = batches
    table = live.DeltaTable(spark, shared_path(spark, "attempt"))
    table.apply(first, 0)
    monkeypatch.setattr(live, "full_range_deltas", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.apply(second, 1)
    monkeypatch.undo()
    assert rows(live.DeltaTable(spark, table.root).read()) == rows(S.deltas_of(first))
    table = live.DeltaTable(spark, table.root)
    table.apply(second, 1)
    assert rows(table.read()) == rows(S.deltas_of(every))


def test_only_touched_buckets_are_read(spark, batches):
    first, second, _ = batches
    table = live.DeltaTable(spark, shared_path(spark, "prune"))
    table.apply(first, 0)
    keys = second.select("session").distinct()
    plan = table.histories(first.select(*live.EVENT_COLUMNS).schema, keys, [3], table.history)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "= 3)" in plan
    empty = first.limit(0)
    table.apply(empty, 1)
    assert rows(table.read()) == rows(S.deltas_of(first)) and live.DeltaTable(spark, table.root).batch == 1


def test_a_batch_writes_rows_of_its_sessions_only(spark, make_events):
    table = live.DeltaTable(spark, shared_path(spark, "append"))
    day = {f"d{i}": [("08:00:00", "PLAY"), ("08:20:00", "HB"), ("08:21:00", "END")] for i in range(30)}
    table.apply(make_events(day), 0)
    late = make_events({"d3": [("08:10:00", "HB")], "new": [("09:00:00", "PLAY"), ("09:00:30", "END")]})
    table.apply(late, 1)
    written = [r["count"] for r in table._versions().groupBy("version").count().orderBy("version").collect()]
    assert written[1] < 30 and written[0] > 600
    every = make_events(day).unionByName(late)
    assert rows(table.read()) == rows(S.deltas_of(every))
    day_no = table._versions().select("part_day").first()["part_day"]
    plan = table.read([day_no])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_day" in plan and rows(table.read([day_no])) == rows(table.read()) and not table.read([day_no + 1]).count()


def test_retention_drops_rows_and_files_and_later_reads_hold(spark, make_events):
    night = {"old": [("10:00:00", "PLAY"), ("10:00:40", "END")], "over": [("23:58:30", "PLAY"), ("23:59:50", "HB"), ("24:00:40", "HB"), ("24:01:30", "END")], "new": [("30:00:00", "PLAY"), ("30:00:20", "END")]}
    first = make_events(night)
    table = live.DeltaTable(spark, shared_path(spark, "retention"))
    table.apply(first, 0)
    before = Q.dense_curve(table.read(), 1440, 1900, values={"delta_sessions": "a", "delta_open": "o"}).collect()
    table.expire(1)
    for t in (table, live.DeltaTable(spark, table.root)):
        assert Q.dense_curve(t.read(), 1440, 1900, values={"delta_sessions": "a", "delta_open": "o"}).collect() == before
        assert {r["session"] for r in t.read().select("session").collect()} == {"over", "new"}
    assert not table._folders(f"{table.root}/deltas/*/part_day=0") and not table._folders(f"{table.root}/history/*/*/day=0")
    assert len(table._folders(f"{table.root}/manifest/*")) == 1
    # a late event of a session over the cut still meets its whole history
    late = make_events({"over": [("24:01:00", "PAUSE")]})
    table = live.DeltaTable(spark, table.root)
    table.apply(late, 1)
    want = Q.dense_curve(S.deltas_of(first.unionByName(late)), 1440, 1900, values={"delta_sessions": "a", "delta_open": "o"}).collect()
    assert Q.dense_curve(table.read(), 1440, 1900, values={"delta_sessions": "a", "delta_open": "o"}).collect() == want
    table.expire(1)
    table.expire(2)
    assert table.read().count() == 0 and not table._folders(f"{table.root}/history/*/*/day=1")


class Held:
    """A state handle in memory."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, _):
        return Held.Value(self.values, name)

    getListState = getValueState

    class Value:
        def __init__(self, values, name):
            self.values, self.name = values, name

        def exists(self):
            return self.name in self.values

        def get(self):
            return self.values[self.name]

        def update(self, value):
            self.values[self.name] = value

        put = update

        def clear(self):
            self.values.pop(self.name, None)

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def fold(events, arrivals, rules=Rules(), evict_ms=86_400_000, until=10**9):
    """Drive one session's fold: ``arrivals`` are lists of (event row, watermark before it) batches."""
    fold = live.SessionFold(rules, evict_ms)
    handle, out, watermark = Held(), [], 0
    fold.init(handle)
    for batch in arrivals:
        frame = events[events["event_id"].isin(batch)]
        for part in fold.handleInputRows(("s",), iter([frame]), Clock(watermark)):
            out += part[["minute", "delta_sessions"]].values.tolist()
        watermark = max(watermark, int(frame["event_ms"].max()) - 200_000)
        while handle.timers and min(handle.timers) <= watermark:
            for part in fold.handleExpiredTimer(("s",), Clock(watermark), None):
                out += part[["minute", "delta_sessions"]].values.tolist()
    while handle.timers and min(handle.timers) <= until:
        for part in fold.handleExpiredTimer(("s",), Clock(min(handle.timers)), None):
            out += part[["minute", "delta_sessions"]].values.tolist()
    return sorted(map(tuple, out)), handle


def typed(df, rules):
    if rules.ignore_downloads:
        df = df.where(event_role() != "ignore")
    return df.withColumn("signal", classify_signal()).withColumn("tie_break", tie_break("signal", rules.tie_order)).select("event_ms", "tie_break", "event_id", "signal", *DIMENSIONS).toPandas()


@pytest.mark.parametrize("rules", [Rules(), Rules(error_policy="terminal"), Rules(error_policy="inactive"), Rules(ignore_downloads=True), Rules(use_fg=False), Rules(use_playing=False), Rules(timeout_s=30)], ids=str)
def test_fold_equals_batch_in_any_order_of_arrival(make_events, rules):
    rng = random.Random(6)
    names = ["PLAY", "PAUSE", "RESUME", "BG", "FG", "ERR", "HB", "HB", "HB", "DOWNLOAD"]
    for trial in range(3):
        clock, line = 36_000, []
        for _ in range(40):
            clock += rng.choice([0, 5, 20, 40, 100, 200])
            line.append((f"{clock // 3600}:{clock % 3600 // 60}:{clock % 60}", rng.choice(names)))
        line.append((line[-1][0], "END"))
        events = make_events({"s": line})
        want = sorted(map(tuple, S.active_deltas(S.runs_of(events, rules)).where("delta_sessions <> 0").select("minute", "delta_sessions").collect()))
        frame = typed(events, rules)
        ids = sorted(frame["event_id"], key=lambda i: (int(frame.set_index("event_id")["event_ms"][i]) + rng.randint(0, 190_000)))
        got, handle = fold(frame, [ids[at : at + 3] for at in range(0, len(ids), 3)], rules)
        assert got == want, (trial, rules)
        assert not handle.values and not handle.timers  # T8: forgotten in the end


def test_a_run_opens_at_once_and_a_silent_one_ends_by_its_timeout(make_events):
    frame = typed(make_events({"s": [("10:00:10", "PLAY"), ("10:04:00", "HB")]}), Rules())
    first, second = frame["event_id"].tolist()
    processor, handle = live.SessionFold(evict_ms=600_000), Held()
    processor.init(handle)
    step = lambda ids, at: [tuple(map(int, r)) for p in processor.handleInputRows(("s",), iter([frame[frame["event_id"].isin(ids)]]), Clock(at)) for r in p[["minute", "delta_sessions"]].values]
    tick = lambda at: [tuple(map(int, r)) for p in processor.handleExpiredTimer(("s",), Clock(at), None) for r in p[["minute", "delta_sessions"]].values]
    play = 36_010_000
    assert step([first], play - 1) == [] and tick(play) == [(600, 1)]  # +1 as soon as the watermark passes the event
    assert tick(play + 90_000) == []
    assert tick(603 * 60_000) == [(602, -1)]  # T4: 10:00:10 and 90 s is in 10:01, so the run ends with minute 601
    assert step([second], 36_240_000) == [(604, 1)]  # the gates are still known
    assert tick(607 * 60_000) == [(606, -1)] and handle.values
    assert tick(36_240_000 + 600_000) == [] and not handle.values and not handle.timers  # T8


def test_fold_refuses_rules_without_an_end():
    with pytest.raises(ValueError):
        live.SessionFold(replace(Rules(), use_liveness=False))


def test_stream_with_late_arrivals_equals_batch(make_events):
    rng = random.Random(11)
    sessions = {}
    for i in range(6):
        clock, line = 36_000 + rng.randint(0, 300), []
        for _ in range(15):
            clock += rng.choice([5, 30, 60, 120])
            line.append((f"{clock // 3600}:{clock % 3600 // 60}:{clock % 60}", rng.choice(["PLAY", "PAUSE", "HB", "HB", "BG", "FG", "RESUME"])))
        sessions[f"s{i}"] = line
    events = make_events(sessions).selectExpr("* except (ingest_ms)", "event_ms + pmod(event_id * 7919, 110) * 1000 as ingest_ms")
    got = live.run_session_fold(events, order="ingest_ms", delay="120 seconds")
    want = S.runs_of(events).select("session", "run_start", "run_end")
    assert sorted(map(tuple, got.select("session", "run_start", "run_end").collect())) == sorted(map(tuple, want.collect()))


def test_the_stream_tells_its_own_clock(spark, make_events, tmp_path):
    events = make_events({"a": [("10:00:00", "PLAY"), ("10:00:50", "HB"), ("10:04:10", "HB")]}).select(*live.EVENT_COLUMNS)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.presence_stream(source, "30 seconds").writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    clock = live.stream_clock(spark, query)
    query.stop()
    last = (10 * 3600 + 4 * 60 + 10) * 1000
    got = clock.collect()
    assert max(r["newest_ms"] or 0 for r in got) == last and max(r["watermark_ms"] for r in got) == last - 30_000 and sum(r["rows"] for r in got) == 3
    curve = spark.range(600, 606).select(F.col("id").alias("minute"))
    labels = {r["minute"]: r["finality"] for r in live.label_by_stream(curve, clock).collect()}
    assert [labels[m] for m in range(600, 606)] == ["final"] * 3 + ["provisional"] * 3
    assert set(live.label_by_stream(curve, clock.limit(0)).toPandas()["finality"]) == {"provisional"}


def test_live_sessions_are_read_from_the_state(spark, make_events):
    events = make_events({"a": [("10:00:00", "PLAY"), ("10:02:00", "HB")], "b": [("10:00:00", "PLAY"), ("10:01:00", "END")], "c": [("10:00:00", "PLAY")], "d": [("10:01:50", "PLAY"), ("10:02:10", "BG")], "e": [("10:01:59", "PLAY"), ("10:05:00", "PAUSE")]})
    as_of = (10 * 3600 + 2 * 60 + 30) * 1000
    got = {r["session"] for r in live.run_live_from_state(events, as_of).collect()}
    assert got == {r["session"] for r in live.live_now(events, as_of).collect()} == {"a", "e"}


def late_sessions(make_events, seed, spread):
    """Sessions whose events arrive up to ``spread`` seconds late; those of the last one arrive in order of their time."""
    rng = random.Random(seed)
    sessions = {}
    for i in range(8):
        clock, line = 36_000 + rng.randint(0, 300), []
        for _ in range(15):
            clock += rng.choice([0, 5, 30, 60, 120])
            line.append((f"{clock // 3600}:{clock % 3600 // 60}:{clock % 60}", rng.choice(["PLAY", "PAUSE", "HB", "HB", "BG", "FG", "RESUME", "END"])))
        sessions[f"s{i}"] = line
    late = f"CASE WHEN session = 's7' THEN 0 ELSE pmod(event_id * 7919, {spread}) * 1000 END"
    return make_events(sessions).selectExpr("* except (ingest_ms)", f"event_ms + {late} as ingest_ms")


def nets(df):
    return sorted(map(tuple, df.where("delta_sessions <> 0").select("session", "minute", "delta_sessions").collect()))


@pytest.mark.parametrize(("rules", "spread"), [(Rules(), 900), (Rules(error_policy="inactive", timeout_s=30), 4000), (Rules(ignore_downloads=True), 1)], ids=str)
def test_on_time_deltas_and_corrections_equal_batch(make_events, rules, spread):
    events = late_sessions(make_events, 5, spread)
    assert nets(live.run_corrected_fold(events, slots=5, rules=rules)) == nets(S.active_deltas(S.runs_of(events, rules)))


def test_only_late_sessions_are_corrected_and_a_repeated_batch_changes_nothing(spark, make_events):
    events = late_sessions(make_events, 9, 2000)
    said = S.active_deltas(S.runs_of(events.where("event_id % 3 > 0"))).select(*live.DELTA.names).withColumn("late", F.lit(False))
    ledger = live.FoldLedger(spark, shared_path(spark, "ledger"), lambda keys: events.join(keys, "session", "left_semi"))
    mark = lambda *names: spark.createDataFrame([(n, *[None] * 7, True) for n in names], live.SIDE)
    ledger.apply(said, 0)
    assert nets(ledger.read()) == nets(said)
    for _ in range(2):
        ledger.apply(mark("s1", "s4"), 1)
        want = S.active_deltas(S.runs_of(events.where("event_id % 3 > 0 OR session IN ('s1', 's4')")))
        assert nets(ledger.read()) == nets(want)
    assert {r["session"] for r in ledger.rows().where("kind = 'correction'").select("session").collect()} <= {"s1", "s4"}
    ledger.apply(said.limit(0), 2)
    ledger.apply(mark(*[f"s{i}" for i in range(8)]), 3)
    assert nets(ledger.read()) == nets(S.active_deltas(S.runs_of(events)))
    plan = ledger.rows().where("bucket IN (3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60]


def test_a_session_is_handed_over_once_and_forgotten(make_events):
    frame = typed(make_events({"s": [("10:00:10", "PLAY"), ("10:00:40", "PAUSE"), ("10:04:00", "HB")]}), Rules())
    play, pause, beat = frame["event_id"].tolist()
    processor, handle = live.WatchedFold(evict_ms=600_000), Held()
    processor.init(handle)
    step = lambda i, at: [(None if r[0] is None else int(r[0]), r[1]) for p in processor.handleInputRows(("s",), iter([frame[frame["event_id"] == i]]), Clock(at)) for r in p[["minute", "late"]].values]
    at = 36_010_000
    assert step(play, at) == [(None, True)]  # unknown, and not after the watermark
    assert step(beat, at) == [(None, True)] and list(handle.timers) == [36_240_000 + 600_000]
    assert not list(processor.handleExpiredTimer(("s",), Clock(36_840_000), None)) and not handle.values
    handle.timers.clear()
    assert step(play, at - 1) == [] and [int(m) for p in processor.handleExpiredTimer(("s",), Clock(at), None) for m in p["minute"]] == [600]
    assert step(pause, at + 60_000) == [] and handle.values["until"] == (at + 60_000, False)  # after what is folded, so on time
    assert step(play, at + 60_000) == [(None, True)] and set(handle.values) == {"until"}


def test_a_rollup_kept_up_to_date_equals_a_full_one_after_each_batch(spark, make_events):
    beats = lambda a, n: [(f"{a + k // 60}:{k % 60}:10", "HB") for k in range(0, n, 7)]
    batches = [make_events({f"a{i}": beats(22, 100) for i in range(9)}), make_events({"b": beats(23, 80), "c": [("23:10:00", "PAUSE")]}, platform="tv"), make_events({"a1": beats(22, 30), "d": beats(49, 20)}), make_events({"e": [("1:00:00", "BG")]})]
    rollup = live.PresenceRollup(spark, shared_path(spark, "rollup"))
    told = lambda df: sorted((r["bucket"], r["platform"], r["events"], r["s"], r["u"]) for r in df.select("*", F.hll_sketch_estimate("sessions_sketch").alias("s"), F.hll_sketch_estimate("users_sketch").alias("u")).collect())
    every = None
    for i, batch in enumerate(batches):
        rollup.apply(batch, i)
        rollup.apply(batch, i)  # a repeated batch changes nothing
        every = batch if every is None else every.unionByName(batch)
        for level, size in (("minute", 1), ("hour", 60), ("day", 1440)):
            at = (F.floor(F.col("event_ms") / (60_000 * size)) * size).alias("bucket")
            whole = live.present_events(every).groupBy(at, "platform").agg(F.count("*").alias("events"), F.countDistinct("session").alias("s"), F.countDistinct("user_id").alias("u"))
            assert told(rollup.read(level)) == sorted(map(tuple, whole.collect())), (i, level)
    assert {r["part"] for r in rollup._rows("minute").where("batch = 2").select("part").distinct().collect()} == {22 * 60, 49 * 60}
    assert {r["bucket"] for r in rollup._rows("hour").where("batch = 2").select("bucket").distinct().collect()} == {22 * 60, 49 * 60}  # others stay
    assert not rollup._rows("hour").where("batch = 3").count()
    plan = rollup._rows("minute", 2, [60])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1][:120]


def test_statistics_kept_up_to_date_equal_full_ones_after_each_batch(spark, make_events):
    beats = lambda a, n: [(f"{a + k // 60}:{k % 60}:10", "HB") for k in range(n)]
    on = lambda a, n: [(f"{a}:0:5", "START"), (f"{a}:0:6", "PLAY"), *beats(a, n)]
    batches = [
        make_events({"a": on(22, 130), "b": on(22, 20)}),
        make_events({"c": on(23, 90)}, platform="tv"),
        make_events({"a": [("24:11:00", "HB")]}),  # a beat at the end of a long session
        make_events({"a": [("22:30:30", "PAUSE")]}),  # late: what followed wasn't watched
        make_events({"b": [("22:0:1", "START")]}, platform="tv"),  # late first event: another slice
        make_events({"c": beats(23, 1)}, platform="tv"),  # nothing new
    ]
    rollup = live.StatsRollup(live.DeltaTable(spark, shared_path(spark, "recompute")), shared_path(spark, "stats"))
    told = lambda df: sorted(str(sorted(r.asDict().items())) for r in R.estimated_users(df).collect())
    touched, every = [], None
    for i, batch in enumerate(batches):
        rollup.apply(batch, i)
        rollup.apply(batch, i)  # a repeated batch changes nothing
        every = batch if every is None else every.unionByName(batch)
        opened = R.open_minutes(S.session_spans(timeline(every)))
        full = R.minute_stats(S.session_minutes(segments_of(every)), opened, sketches=True)
        assert told(rollup.read("minute")) == told(full.withColumnRenamed("minute", "bucket")), i
        for level, size in (("hour", 60), ("day", 1440)):
            assert told(rollup.read(level)) == told(R.rolled_stats(full, size)), (i, level)
        touched.append(sorted(r["part"] // 60 for r in rollup._rows("session").where(F.col("batch") == i).select("part").distinct().collect()))
    assert touched == [[22, 23, 24], [23, 24], [24], [22, 23, 24], [22], []]
    assert not rollup.read("minute").where("platform = 'web' AND open_sessions > 1").count()  # b has left the slice
    again = live.StatsRollup(live.DeltaTable(spark, rollup.table.root), rollup.root)  # a restart goes on
    again.apply(make_events({"n": on(1, 3)}), len(batches))
    assert again.read("hour").where("bucket = 60").count() == 1 and again.read("hour").where("bucket = 1320").count() == 2
