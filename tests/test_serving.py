"""Reads that start at an anchor: the same rows as over the whole history, from the days of the range only."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, HOUR
from tidemark.operators import curves as Q
from tidemark.operators import dashboard as D
from tidemark.operators import rollups as R
from tidemark.sources import serving, shared

FIRST = 19_000 * DAY


def history(days=5, sessions=120, seed=6):
    """Deltas of runs over several days, some over midnight and some days long."""
    rng, rows = random.Random(seed), []
    for i in range(sessions):
        at = FIRST + rng.randrange(days * DAY)
        run = (f"s{i}", f"u{i % 40}", rng.choice(["web", "ios", None]), rng.choice(["X", "Y"]), "720p", rng.randrange(4))
        end = at + rng.choice([1, 7, 90, 2 * DAY])
        rows += [(*run, at, 1, 1), (*run, end, -1, -1)]
    return rows


@pytest.fixture(scope="module")
def deltas(spark):
    return spark.createDataFrame(history(), "session string, user_id string, platform string, country string, video_resolution string, content_id long, minute long, delta_sessions long, delta_open long")


@pytest.fixture(scope="module")
def store(spark, deltas, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("input"))
    spans = deltas.groupBy("session").agg((F.min("minute") * 60_000).alias("first_ms"), (F.max("minute") * 60_000).alias("last_ms"))
    return serving.DeltaStore(spark, [path], lambda: deltas, lambda: spans)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("start, end", [(FIRST + DAY + 615, FIRST + DAY + 680), (FIRST + 2 * DAY - 30, FIRST + 2 * DAY + 30), (FIRST + 3 * DAY, FIRST + 3 * DAY + 1), (FIRST - 50, FIRST + 20), (FIRST + 9 * DAY, FIRST + 9 * DAY + 5), (FIRST + 60, FIRST + 9 * DAY)])
def test_anchored_reads_equal_those_of_the_whole_history(deltas, store, start, end):
    near = store.near(start, end)
    assert rows(Q.dense_curve(near, start, end)) == rows(Q.dense_curve(deltas, start, end))
    assert rows(Q.active_vs_open(near, start, end)) == rows(Q.active_vs_open(deltas, start, end))
    assert rows(Q.range_peak_avg(near, start, end)) == rows(Q.range_peak_avg(deltas, start, end))
    assert rows(Q.trend(store.near(end - 10, end + 1), end)) == rows(Q.trend(deltas, end))
    assert rows(D.starts_in(near, start, end)) == rows(D.starts_in(deltas, start, end))
    for dim in ("platform", "content_id"):
        assert rows(Q.dense_curve(store.near(start, end, dim), start, end, [dim])) == rows(Q.dense_curve(deltas, start, end, [dim]))


def test_a_query_of_one_hour_reads_one_day(store):
    start = FIRST + DAY + 615
    near = store.near(start, start + HOUR)
    plan = Q.dense_curve(near, start, start + HOUR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(part_day") == 2
    days = store.by_day.where(F.col("part_day").between(start // DAY, (start + HOUR - 1) // DAY)).select("part_day").distinct().collect()
    assert [r["part_day"] for r in days] == [FIRST // DAY + 1]


def test_anchors_are_the_levels_before_each_full_hour(deltas):
    anchors = {}
    for r in R.slice_anchors(deltas, ["platform"]).collect():
        anchors[r["platform"], r["hour"]] = (r["delta_sessions"], r["delta_open"])
    every = deltas.collect()
    last = max(r["minute"] for r in every)
    for hour in range(FIRST // HOUR * HOUR, last + HOUR, HOUR):
        for p in ("web", "ios", None):
            level = sum(r["delta_sessions"] for r in every if r["platform"] == p and r["minute"] < hour)
            assert anchors.get((p, hour), (0, 0)) == (level, level)


def test_spans_are_those_that_start_in_the_range(store):
    start = FIRST + DAY
    found = store.spans_between(start, start + HOUR)
    assert rows(found) == rows(store.spans.where((F.col("first_ms") >= start * 60_000) & (F.col("first_ms") < (start + HOUR) * 60_000)).drop("part_day"))
    assert shared._STORED


def test_an_empty_history_reads_as_nothing(spark, deltas, tmp_path):
    empty = serving.DeltaStore(spark, [str(tmp_path)], lambda: deltas.limit(0), lambda: spark.createDataFrame([], "session string, first_ms long, last_ms long"))
    assert {r["concurrency"] for r in Q.dense_curve(empty.near(FIRST, FIRST + 5), FIRST, FIRST + 5).collect()} == {0}
    assert empty.spans_between(FIRST, FIRST + 5).count() == 0
