import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: event name -> (event_type, event) of hand-made sessions
EVENTS = {
    "START": ("VideoSessionStart", "VideoSessionStart"),
    "END": ("VideoSessionEnd", "VideoSessionEnd"),
    "PLAY": ("VideoPlay", "Play"),
    "BG": ("AppBackgrounded", "AppBackgrounded"),
    "FG": ("AppForegrounded", "AppForegrounded"),
    "ERR": ("VideoError", "VideoError"),
    "PAUSE": ("VideoHeartbeat", "pause"),
    "RESUME": ("VideoHeartbeat", "resume"),
    "HB": ("VideoHeartbeat", "buffer-health"),
    "DOWNLOAD": ("VideoHeartbeat", "download-progress"),
}


@pytest.fixture(scope="session")
def make_events(spark):
    """``[(clock, name), ...]`` by session -> typed events; a clock is 'HH:MM:SS' of one day."""

    def build(sessions, **dims):
        rows, n = [], 0
        for session, timeline in sessions.items():
            for clock, name in timeline:
                h, m, s = map(float, clock.split(":"))
                n += 1
                rows.append((n, session, "u-" + session, dims.get("platform", "web"), "X", "720p", 1, *EVENTS[name], int((h * 3600 + m * 60 + s) * 1000), int((h * 3600 + m * 60 + s) * 1000)))
        return spark.createDataFrame(rows, "event_id long, session string, user_id string, platform string, country string, video_resolution string, content_id long, event_type string, event string, event_ms long, ingest_ms long")

    return build
