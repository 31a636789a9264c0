"""The session model over the driver tables, by integer arithmetic only.

Thirty days of ``events`` become 144 minutes (time divided by 300); a signup starts a session; click, purchase and error
events become state signals by their number ``k``; ``part`` is the content dimension, ``lineitem`` the advertiser map.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.clean import enrich_content, latest_version
from ..functions.times import div

EPOCH_MS = 1_704_067_200_000  # 2024-01-01
#: Fixed values of the adapter.
PLATFORMS = ("android", "ios", "web", "mweb", "androidtv", "firetv", "appletv", "roku", "samsungtv", "lgtv")
RESOLUTIONS = ("480p", "720p", "1080p", "unknown")
AUDIO = ("en-US", "HI", "ta-IN", "UNK", "off", "")
BEATS = ("", "", "buffer-health", "network-activity", "", "", "downshift", "dropped-frames", "", "", "speed-change", "video_quality_change", "", "", "buffer-health", "network-activity")
SUBTITLES = ("off", "EN", "hi-in", "unk")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


class SessionData:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def content_versions(self) -> DataFrame:
        """Content metadata; each seventh part also has an older version, each twentieth is left out."""
        part = self.table("part").where("p_partkey % 20 <> 0")
        now = part.select(F.col("p_partkey").alias("content_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") <= 12, "live").otherwise("vod").alias("video_type"), F.col("p_brand").alias("category"), F.col("p_type").alias("show_name"), F.lit(EPOCH_MS).alias("updated_ms"))
        old = part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("content_id"), F.concat(F.lit("old "), "p_name").alias("title"), F.lit("vod").alias("video_type"), F.lit("old").alias("category"), F.lit("old").alias("show_name"), F.lit(EPOCH_MS - 86_400_000).alias("updated_ms"))
        return now.unionByName(old)

    @cached_property
    def content(self) -> DataFrame:
        return latest_version(self.content_versions, ["content_id"], "updated_ms")

    @cached_property
    def advertisers(self) -> DataFrame:
        """Distinct (advertiser_id, content_id) pairs, many to many."""
        return self.table("lineitem").select(F.col("l_suppkey").cast("long").alias("advertiser_id"), F.col("l_partkey").cast("long").alias("content_id")).distinct()

    @cached_property
    def raw_events(self) -> DataFrame:
        """Typed events before enrichment, exact duplicates included."""
        us = div(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp_ntz").cast("timestamp")), 300)
        k = F.get_json_object("props", "$.k").cast("int")
        base = self.table("events").select("event_id", "user_id", F.col("event_type").alias("kind"), us.alias("us"), k.alias("k"))
        so_far = W.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, 0)
        numbered = base.withColumn("session_no", F.sum(F.when(F.col("kind") == "signup", 1).otherwise(0)).over(so_far))
        kind, beat = F.col("kind"), F.lit("VideoHeartbeat")
        event_type = (
            F.when(kind == "signup", "VideoSessionStart").when(kind == "view", "VideoPlay")
            .when((kind == "click") & (F.col("k") % 4 == 0), "AppBackgrounded").when((kind == "click") & (F.col("k") % 4 == 1), "AppForegrounded")
            .when((kind == "error") & (F.col("k") % 2 == 0), "VideoSessionEnd").when(kind == "error", "VideoError").otherwise(beat)
        )
        event = (
            F.when(kind == "view", "Play").when((kind == "click") & (F.col("k") % 4 >= 2), _pick(BEATS, F.col("k")))
            .when(kind == "purchase", _pick(("pause", "resume", "BufferStart", "pause", "resume", "BufferEnd"), F.col("k"))).otherwise(event_type)
        )
        n_part = self.table("part").agg(F.count("*").alias("n_part"))  # one row
        nation = self.table("nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("country"))
        rows = numbered.join(F.broadcast(n_part)).withColumn("nation", F.col("user_id") % 25).join(F.broadcast(nation), "nation", "left")
        session = F.concat_ws("-", F.col("user_id").cast("string"), F.col("session_no").cast("string"))
        drift = F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
        event_ms = F.lit(EPOCH_MS) + div("us", 1000)
        typed = rows.select(
            "event_id", session.alias("session"), F.col("user_id").cast("string").alias("user_id"),
            (1 + (F.col("user_id") * 31 + F.col("session_no") * 17) % F.col("n_part")).cast("long").alias("content_id"),
            event_type.alias("event_type"), event.alias("event"), event_ms.alias("event_ms"),
            _pick(PLATFORMS, F.col("user_id") + drift).alias("platform"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("app_version"), F.coalesce("country", F.lit("unknown")).alias("country"),
            _pick(AUDIO, F.col("event_id")).alias("audio_language"), _pick(SUBTITLES, F.col("event_id")).alias("subtitle_language"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("player_version"),
            _pick(RESOLUTIONS, F.col("session_no")).alias("video_resolution"), (event_ms + (F.col("event_id") % 120) * 1000).alias("ingest_ms"),
            F.explode(F.when(F.col("event_id") % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        return typed.drop("copy")

    @cached_property
    def events(self) -> DataFrame:
        """Typed events enriched with the newest content attributes."""
        return enrich_content(self.raw_events, self.content)
