"""Presence with the numbers of distinct sessions and users, beyond the sizes up to which sketches are exact."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rollups import present_events
from tidemark.sources.shared import shared_path
from tidemark.streaming import live


def crowd(spark, first, last, minute, platform="web"):
    """Events of sessions ``first`` to ``last`` in one minute, two sessions a user and each seventh event twice."""
    rows = spark.range(first, last).selectExpr(
        "id as event_id", "concat('s', id) as session", "concat('u', id div 2) as user_id", f"'{platform}' as platform", "'X' as country", "'720p' as video_resolution", "1L as content_id",
        "IF(id % 11 = 0, 'AppBackgrounded', 'VideoHeartbeat') as event_type", "IF(id % 11 = 0, 'AppBackgrounded', 'buffer-health') as event", f"{minute} * 60000L + id % 60000 as event_ms", f"{minute} * 60000L + id % 60000 as ingest_ms",
    )
    return rows.unionByName(rows.where("event_id % 7 = 0"))


def counted(events, name, size):
    at = (F.floor(F.col("event_ms") / (60_000 * size)) * size).alias(name)
    rows = present_events(events).groupBy(at, "platform").agg(F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.countDistinct("user_id").alias("users"))
    return told(rows, name)


def told(rows, name):
    return sorted(map(tuple, rows.select(name, "platform", "events", "sessions", "users").collect()))


@pytest.fixture(scope="module")
def crowds(spark):
    return [crowd(spark, 0, 9000, 600).unionByName(crowd(spark, 0, 40, 1500)), crowd(spark, 5000, 14_000, 610), crowd(spark, 0, 9, 610, "tv")]


def test_a_stream_counts_a_crowd_exactly(crowds):
    events = crowds[0].unionByName(crowds[1])
    assert told(live.run_presence(events, slots=2), "minute") == counted(events, "minute", 1)


def test_counts_kept_up_to_date_equal_full_ones_after_each_batch(spark, crowds):
    rollup, every = live.PresenceCounts(spark, shared_path(spark, "counts")), None
    for i, batch in enumerate([*crowds, crowds[0].where("event = 'AppBackgrounded'")]):
        rollup.apply(batch, i)
        rollup.apply(batch, i)  # a repeated batch changes nothing
        every = batch if every is None else every.unionByName(batch)
        for level, size in (("minute", 1), ("hour", 60), ("day", 1440)):
            assert told(rollup.read(level), "bucket") == counted(every, "bucket", size), (i, level)
    assert {r["bucket"] for r in rollup._rows("hour").where("batch = 1").select("bucket").distinct().collect()} == {600}  # others stay
    assert not rollup._rows("hour").where("batch = 3").count()


def test_the_replayed_rollup_counts_a_crowd_exactly(crowds):
    events = crowds[0].unionByName(crowds[1])
    assert told(live.run_presence_rollup(events, slots=2), "bucket") == counted(events, "bucket", 60)
