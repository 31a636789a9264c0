"""Readers, writers and message frames."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import checks as V
from tidemark.sources import tables as IO


def test_csv_is_trimmed_and_tolerant(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("﻿content_id, video_session_id ,event\n 1 , s1 ,Play\n\n2,s2\n", encoding="utf-8")
    rows = IO.read_events_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("1", "s1", "Play"), ("2", "s2", None)]
    assert rows[0].asDict().keys() == {"content_id", "video_session_id", "event"}
    assert IO.read_events_csv(spark, str(path), limit=1).count() == 1


def test_pointer_file_is_refused(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\n")
    with pytest.raises(ValueError, match="pointer"):
        IO.read_events_csv(spark, str(path))


def test_dim_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("content_id,title,video_type,category\n7,T,live,c\nx,U,vod,d\n")
    assert [tuple(r) for r in IO.read_dim_csv(spark, str(path)).collect()] == [(7, "T", "live", "c"), (None, "U", "vod", "d")]


def test_publish_is_a_key_and_value_frame(spark):
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "k string, v int")
    got = IO.publish_events(rows, None, "k").collect()
    assert [(r["key"], json.loads(r["value"]).get("v")) for r in got] == [("a", 1), (None, 2), (None, 3)]
    assert IO.publish_events(rows, None).first()["key"] is None


def test_partitioned_write_and_retention(spark, tmp_path):
    rows = spark.createDataFrame([("a", 10), ("b", 1500), ("c", 3000)], "session string, minute long")
    path = str(tmp_path / "t")
    IO.write_partitioned(rows, path, "minute", ["session"])
    back = spark.read.parquet(path)
    assert sorted(str(r["day"]) for r in back.select("day").distinct().collect()) == ["1970-01-01", "1970-01-02", "1970-01-03"]
    assert IO.apply_retention(rows, "minute", 1500).count() == 2


def test_landing_round_trip(spark, make_events):
    events = make_events({"a": [("10:00:00", "START"), ("10:00:05", "PLAY")]})
    wide = events.withColumns({c: F.lit(None).cast("string") for c in ("app_version", "audio_language", "subtitle_language", "player_version")})
    typed = clean.decode_events(IO.as_landing_rows(wide), F.lit(5))
    assert typed.select("session", "event_ms").collect() == events.select("session", "event_ms").collect()
    assert typed.first()["app_version"] == "unknown" and typed.first()["ingest_ms"] == 5


def test_stream_reads_json_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"content_id": "1", "event": "Play"}) + "\n")
    query = IO.read_events_stream(spark, path=str(tmp_path / "in")).writeStream.format("memory").queryName("landing").start()
    IO.run_until_done(query)
    assert spark.sql("SELECT content_id, event FROM landing").collect() == [("1", "Play")]


def test_replay_compresses_time(spark, make_events, tmp_path):
    events = make_events({"a": [("10:00:00", "START"), ("10:30:00", "END")]})
    query = IO.replay_day(spark, events, str(tmp_path / "slots"), 10).writeStream.format("memory").queryName("replayed").start()
    IO.run_until_done(query)
    times = sorted(r["event_ms"] for r in spark.sql("SELECT event_ms FROM replayed").collect())
    assert times[1] - times[0] == 180_000


def test_language_is_normalised(spark):
    rows = spark.createDataFrame([("en-US",), ("HI",), ("",), (None,), ("UNK",), ("off",)], "x string")
    assert [r[0] for r in rows.select(clean.normalize_dim("x")).collect()] == ["en", "hi", "unknown", "unknown", "unknown", "unknown"]


def test_roles(spark):
    rows = spark.createDataFrame([("VideoHeartbeat", "download-x"), ("VideoPlay", "Play"), ("VideoError", "VideoError")], "event_type string, event string")
    assert [r[0] for r in rows.select(clean.event_role()).collect()] == ["ignore", "trigger", "liveness"]


def test_quoted_fields_hold_delimiters_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('content_id,title,video_type,category\n7,"He said ""hi"", ok",live,c\n8,"two\nlines",vod,d\n9,"",vod,\n')
    assert [tuple(r) for r in IO.read_dim_csv(spark, str(path)).collect()] == [(7, 'He said "hi", ok', "live", "c"), (8, "two\nlines", "vod", "d"), (9, None, "vod", None)]


def test_rows_that_do_not_fit_are_rescued(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("content_id,title\n1,a\n2,b,too,many\n3\n")
    rows = IO.read_events_csv(spark, str(path), rescue="record").collect()
    assert [tuple(r) for r in rows] == [("1", "a", None), ("2", "b", "2,b,too,many"), ("3", None, "3")]


def test_a_pointer_among_the_files_of_a_folder_is_refused(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("content_id,title\n" + "1,a\n" * 500)
    assert IO.read_events_csv(spark, str(tmp_path)).count() == 1500
    (tmp_path / "z.csv").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\n")
    with pytest.raises(ValueError, match="pointer"):
        IO.read_events_csv(spark, str(tmp_path))


def test_sessions_over_midnight_lie_in_one_partition_by_start_day(spark, make_events, tmp_path):
    events = make_events({"night": [("23:59:00", "PLAY"), ("24:01:00", "END")], "day": [("10:00:00", "PLAY")], "next": [("24:30:00", "PLAY")]})
    IO.write_partitioned(IO.by_session_start(events, "event_ms"), str(tmp_path / "start"), "start_minute", ["session"])
    stored = spark.read.parquet(str(tmp_path / "start"))
    assert tuple(V.one_partition_per_session(stored).first())[1:] == (0.0, 0.0, True)
    assert {(r["session"], str(r["day"])) for r in stored.collect()} == {("night", "1970-01-01"), ("day", "1970-01-01"), ("next", "1970-01-02")}
    IO.write_partitioned(events.withColumn("at", F.expr("event_ms div 60000")), str(tmp_path / "event"), "at", ["session"])
    assert tuple(V.one_partition_per_session(spark.read.parquet(str(tmp_path / "event"))).first())[1:] == (1.0, 0.0, False)
