"""The fold over buckets of sessions beside the fold of one session, and the arrival of replayed shares."""

import glob
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_streaming import Clock, Held
from tidemark.functions.clean import DIMENSIONS
from tidemark.plans.config import Rules
from tidemark.streaming import folds, live


def arriving(rules, n=40, spread=900, seed=3):
    """Batches of events of ``n`` sessions in order of arrival, up to ``spread`` seconds late; some sessions have null dimensions."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        clock = 36_000 + rng.randint(0, 3000)
        for _ in range(rng.randint(1, 12)):
            clock += rng.choice([0, 5, 30, 60, 120, 700])
            signal, dims = rng.choice(rules.tie_order), [f"u{i}", rng.choice(["web", "tv"]), None if i % 5 == 0 else 'X "é"', "720p", None if i % 3 == 0 else 7 + i]
            late = rng.randint(0, spread) if i % 4 else 0
            rows.append((f"s{i}", *dims, clock * 1000, rules.tie_order.index(signal) + 1, len(rows), signal, json.dumps(dict(zip(DIMENSIONS, dims, strict=True))), clock + late))
    frame = pd.DataFrame(rows, columns=["session", *DIMENSIONS, "event_ms", "tie_break", "event_id", "signal", "dims", "arrival"]).astype({"content_id": object})
    frame = frame.sort_values(["arrival", "event_id"]).drop(columns="arrival").reset_index(drop=True)
    return [frame[at : at + 25] for at in range(0, len(frame), 25)]


def driven(make, key, batches, evict_ms):
    """What a processor says of ``batches``, one handle a key, batch by batch."""
    made, told, watermark = {}, [], 0
    far = max(int(b["event_ms"].max()) for b in batches) + 3 * evict_ms

    def take(parts):
        for part in parts:
            told.extend(tuple(None if pd.isna(x) else x if isinstance(x, (str, bool)) else int(x) for x in r) for r in part.itertuples(index=False))

    def expire(at):
        for k, (fold, handle) in made.items():
            while handle.timers and min(handle.timers) <= at:
                take(fold.handleExpiredTimer((k,), Clock(at), None))

    for batch in batches:
        for k, rows in batch.groupby(batch["session"].map(key), sort=False):
            if k not in made:
                made[k] = make(), Held()
                made[k][0].init(made[k][1])
            take(made[k][0].handleInputRows((k,), iter([rows[:9], rows[9:]] if len(rows) > 9 else [rows]), Clock(watermark)))
        expire(watermark)
        watermark = max(watermark, int(batch["event_ms"].max()))
        expire(watermark)
    for k, (fold, handle) in made.items():
        while handle.timers:
            at = min(handle.timers)
            assert at <= far
            take(fold.handleExpiredTimer((k,), Clock(at), None))
        assert not handle.values and not handle.timers  # T8: forgotten in the end
    return told


@pytest.mark.parametrize("evict_ms", [86_400_000, 400_000])
@pytest.mark.parametrize("rules", [Rules(), Rules(error_policy="terminal"), Rules(error_policy="inactive", timeout_s=30), Rules(use_fg=False), Rules(use_playing=False)], ids=str)
def test_a_bucket_says_what_its_sessions_say(rules, evict_ms):
    batches = arriving(rules)
    one = driven(lambda: live.WatchedFold(rules, evict_ms), lambda s: s, batches, evict_ms)
    want = [(s, None, None, None, late) if late else (s, json.dumps(dict(zip(DIMENSIONS, (u, p, c, v, i), strict=True))), m, d, late) for s, u, p, c, v, i, m, d, late in one]
    assert any(w[4] for w in want) and any(not w[4] for w in want)
    for buckets in (1, 3):
        got = driven(lambda: folds.BucketFold(rules, evict_ms, watched=True), lambda s: int(s[1:]) % buckets, batches, evict_ms)
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_bucket_without_a_ledger_drops_late_events():
    batches, on_time, watermark = arriving(Rules()), [], 0
    for batch in batches:
        on_time.append(batch[(batch["event_ms"] > watermark) & ~batch["session"].isin({s for b in batches for s in b["session"] if int(s[1:]) % 4})])
        watermark = max(watermark, int(batch["event_ms"].max()))
    on_time = [b for b in on_time if len(b)]
    want = driven(live.SessionFold, lambda s: s, on_time, 86_400_000)
    got = driven(folds.BucketFold, lambda s: 0, on_time, 86_400_000)
    told = sorted((s, m, d) for s, _, m, d, _ in got)
    assert told == sorted((r[0], *r[-2:]) for r in want) and told
    late = on_time[0].assign(event_id=lambda b: b["event_id"] + 10_000, event_ms=lambda b: b["event_ms"] + 1)
    assert sorted((s, m, d) for s, _, m, d, _ in driven(folds.BucketFold, lambda s: 0, [*on_time, late], 86_400_000)) == told


def test_a_bucket_takes_many_sessions_in_one_call():
    """A call a session is what took the time: 20,000 sessions need one row of state, not 20,000."""
    frame = pd.DataFrame({"session": [f"s{i}" for i in range(20_000)], "dims": "{}", "event_ms": 36_000_000, "tie_break": 2, "event_id": range(20_000)})
    fold, handle = folds.BucketFold(), Held()
    fold.init(handle)
    assert not list(fold.handleInputRows((0,), iter([frame]), Clock(0)))
    (said,) = fold.handleExpiredTimer((0,), Clock(36_000_000), None)
    assert len(said) == 20_000 and set(handle.values) == {"sessions"} and len(handle.timers) == 1


def test_late_sessions_of_a_bucket_are_handed_over_in_one_call():
    rows = lambda ms, first: pd.DataFrame({"session": [f"s{i}" for i in range(20_000)], "dims": "{}", "event_ms": ms, "tie_break": 2, "event_id": range(first, first + 20_000)})
    fold, handle = folds.BucketFold(watched=True, evict_ms=600_000), Held()
    fold.init(handle)
    assert not list(fold.handleInputRows((0,), iter([rows(36_000_000, 0)]), Clock(0)))
    list(fold.handleExpiredTimer((0,), Clock(36_000_000), None))
    late = rows(35_900_000, 20_000)[::2]
    (said,) = fold.handleInputRows((0,), iter([late, rows(36_010_000, 40_000)[1:2]]), Clock(36_000_000))
    assert said["late"].all() and set(said["session"]) == set(late["session"]) and said["minute"].isna().all()
    known = folds.unpacked(handle.values["sessions"][0]).to_pandas()
    assert (len(known), known["folded"].sum(), known["handed"].sum()) == (20_000, 10_000, 10_000) and len(handle.timers) == 1


def test_a_replayed_share_comes_in_by_one_rename(spark, tmp_path):
    """Files that come in one by one can be taken for two micro-batches, and then events are dropped as late."""
    events = spark.range(0, 900, 1, 12).select(F.col("id").alias("event_ms"))
    seen, folder = [], str(tmp_path / "in")

    class Query:
        def processAllAvailable(self):
            rows = [spark.read.parquet(share).count() for share in sorted(glob.glob(f"{folder}/*"))]
            seen.append(rows)

        def stop(self):
            pass

    live._replay(events, "event_ms", 3, lambda source: Query(), finish=50, folder=folder)
    assert seen == [[0, 300], [0, 300, 300], [0, 300, 300, 300], [0, 300, 300, 300, 1]]
    assert spark.read.parquet(live.arrivals(folder)).agg(F.max("event_ms")).first()[0] == 949


def test_live_sessions_come_from_a_row_of_state_a_bucket(spark, monkeypatch):
    """Reading and folding a row a session is what took the time."""
    rows = spark.range(900).selectExpr(
        "id as event_id", "concat('s', id div 2) as session", "concat('u', id div 6) as user_id", "'web' as platform", "IF(id % 3 = 0, NULL, 'X') as country", "'720p' as video_resolution", "id div 2 as content_id",
        "IF(id % 2 = 0, 'VideoPlay', IF(id % 5 = 0, 'VideoSessionEnd', 'VideoHeartbeat')) as event_type", "IF(id % 2 = 0, 'Play', 'buffer-health') as event", "36000000L + id * 200 as event_ms", "0L as ingest_ms",
    )
    state, read = [], live.live_from_state

    def spy(spark, checkpoint, *rest):
        state.append(spark.read.format("statestore").option("stateVarName", "sessions").load(checkpoint).count())
        return read(spark, checkpoint, *rest)

    monkeypatch.setattr(live, "live_from_state", spy)
    as_of = 36_000_000 + 800 * 200
    got = sorted(map(repr, live.run_live_from_state(rows, as_of, slots=2).select(*live.KEYS).collect()))
    assert got == sorted(map(repr, live.live_now(rows, as_of).select(*live.KEYS).collect())) and len(got) > 100
    assert state[0] <= live.BUCKETS < 401
