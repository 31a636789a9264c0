"""Readers and writers: CSV events and dimensions, message frames, day-partitioned tables, retention and replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import DAY, div, minute_of

#: The landing columns in file order, all strings, and the content metadata columns.
LANDING = ("content_id", "video_session_id", "user_id", "event_type", "event", "event_timestamp", "platform", "app_version", "country", "audio_language", "subtitle_language", "player_version", "session_start_epoch", "video_resolution")
CONTENT = ("content_id", "title", "video_type", "category")
LANDING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LANDING])
POINTER = "version https://git-lfs"


def reject_pointer_file(spark: SparkSession, path: str) -> None:
    """A2: refuse a large-file pointer in place of the data, or as any file of a folder; only tiny files are opened."""
    tiny = spark.read.format("binaryFile").load(path).where("length < 1024")
    found = tiny.where(F.col("content").cast("string").startswith(POINTER)).select("path").head(1)
    if found:
        raise ValueError(f"{found[0]['path']} is a large-file pointer, not the data; fetch it first")


def read_events_csv(spark: SparkSession, path: str, delimiter: str = ",", limit: int | None = None, rescue: str | None = None, multiline: bool = True) -> DataFrame:
    """A1: a header-named CSV; names and values trimmed, a byte order mark dropped, empty lines skipped, ragged rows kept,
    every column a string; an empty or missing cell is null.

    Quoted fields may hold the delimiter, doubled quotes and, with ``multiline``, line breaks; such files aren't split, so
    switch it off for large files known to have none.  ``rescue`` names a column that holds the whole record where a row
    doesn't fit the header, null elsewhere.
    """
    reject_pointer_file(spark, path)
    read = spark.read.option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    read = read.option("quote", '"').option("escape", '"').option("multiLine", multiline)
    header = read.csv(path)
    if rescue:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header.columns, rescue]])
        header = read.schema(schema).option("columnNameOfCorruptRecord", rescue).csv(path)
    rows = header.toDF(*[c.strip().lstrip("\ufeff").strip() for c in header.columns])
    return rows.limit(limit) if limit is not None else rows


def read_dim_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Content metadata; ids that are no numbers become null."""
    rows = read_events_csv(spark, path, delimiter)
    return rows.select(F.expr("try_cast(content_id AS bigint)").alias("content_id"), *[F.col(c) for c in CONTENT[1:]])


def as_landing_rows(events: DataFrame) -> DataFrame:
    """Typed events back as the all-string landing rows (with ``event_id`` and ``ingest_ms`` where given)."""
    names = {"session": "video_session_id", "event_ms": "event_timestamp"}
    first = F.col("session_start_ms") if "session_start_ms" in events.columns else F.col("event_ms")
    have = [c for c in ("content_id", "session", "user_id", "event_type", "event", "event_ms", "platform", "app_version", "country", "audio_language", "subtitle_language", "player_version", "video_resolution") if c in events.columns]
    extra = [F.col(c).cast("string").alias(c) for c in ("event_id", "ingest_ms") if c in events.columns]
    return events.select(*[F.col(c).cast("string").alias(names.get(c, c)) for c in have], first.cast("string").alias("session_start_epoch"), *extra)


def publish_events(df: DataFrame, topic: str | None, key_col: str | None = None, servers: str | None = None) -> DataFrame:
    """A3: each row as a JSON value with an optional key (null for an empty one).

    With ``topic`` and ``servers`` it is written to Kafka (LZ4, all acknowledgements; needs the connector); without, it is
    a dry run.  Either way the key and value frame is returned.
    """
    key = F.nullif(F.col(key_col).cast("string"), F.lit("")) if key_col else F.lit(None).cast("string")
    messages = df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    if topic and servers:
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.compression.type", "lz4").option("kafka.acks", "all").save()
    return messages


def read_events_stream(spark: SparkSession, *, servers: str | None = None, topic: str | None = None, path: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A4: landing rows as a stream, from Kafka JSON values or from JSON files."""
    if path:
        return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", 10_000).load()
    return source.select(F.from_json(F.col("value").cast("string"), LANDING_SCHEMA).alias("v")).select("v.*")


def write_partitioned(df: DataFrame, path: str, minute: str, keys: Sequence[str]) -> None:
    """A5: partitioned by the day of ``minute`` (epoch minutes) and sorted by ``keys`` in each file.

    Spark cuts a day into files of its advisory partition size, so a busy day is many tasks and a quiet one a single file.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), div(minute, DAY).cast("int"))
    df.withColumn("day", day).hint("rebalance", "day").sortWithinPartitions("day", *keys).write.partitionBy("day").parquet(path)


def by_session_start(df: DataFrame, at_ms: str) -> DataFrame:
    """Rows of sessions with ``start_minute``, the minute of the session's first row: partitioned by its day, a session lies
    in one partition, also over midnight."""
    first = df.groupBy("session").agg(minute_of(F.min(at_ms)).alias("start_minute"))
    return df.join(first, "session")


def apply_retention(df: DataFrame, minute: str, oldest_minute: int) -> DataFrame:
    """Rows not older than ``oldest_minute``; give the as-of time minus the retention, never the wall clock."""
    return df.where(F.col(minute) >= oldest_minute)


def replay_day(spark: SparkSession, events: DataFrame, folder: str, speedup: int, minutes_per_file: int = 10) -> DataFrame:
    """A stored day as a stream of ordered files, times compressed by ``speedup`` towards the first event.

    The files are written to ``folder`` (shared), one per ``minutes_per_file`` of event time, and read one a trigger.
    """
    first = events.agg(F.min("event_ms").alias("first_ms"))  # one row
    faster = events.join(F.broadcast(first)).withColumn("event_ms", F.col("first_ms") + div(F.col("event_ms") - F.col("first_ms"), speedup)).drop("first_ms")
    slot = div(minute_of("event_ms"), minutes_per_file)
    faster.withColumn("slot", slot).repartitionByRange("slot").sortWithinPartitions("slot", "event_ms").write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_until_done(query: StreamingQuery) -> None:
    try:
        query.processAllAvailable()
    finally:
        query.stop()
