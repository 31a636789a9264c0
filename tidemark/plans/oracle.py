"""DuckDB SQL for the registered queries: one shared chain of common table expressions and a body for each query."""

from __future__ import annotations

W0, W1 = 28_401_150, 28_401_210
LO_MS, HI_MS = W0 * 60_000, W1 * 60_000  # 2024-01-01 00:30 and 01:30 in minutes since the epoch
MIDNIGHT_MS = 23 * 3_600_000  # moves the session data over midnight
MARK_MS = 1_704_067_200_000 + 60 * 60_000  # the watermark of the open-session queries, 01:00
RANGES = {"before": (W0 - 90, W0 - 60), "ramp_up": (W0 - 30, W0 - 20), "sustained": (W0 - 10, W0 + 10), "one_minute": (W0 - 28, W0 - 27), "ramp_down": (W0 + 70, W0 + 90), "hour": (W0, W1), "day": (W0 - 30, W0 + 1410)}
K = "session, user_id, platform, country, video_resolution, content_id"
SLICE = "platform, country, video_resolution, content_id"


def t(column: str, name: str | None = None) -> str:
    return f"make_timestamp(({column}) * 60000000) AS {name or column}"


def ms(column: str, name: str) -> str:
    return f"make_timestamp(({column}) * 1000) AS {name}"


def quantile_columns(value: str, at=(0.25, 0.5, 0.75, 0.9, 0.99)) -> str:
    return f"count({value})::BIGINT AS n, " + ", ".join(f"round(quantile_cont({value}, {q}), 4) AS p{round(q * 100)}" for q in at)


def ends(value: str) -> str:
    return f"min({value}) AS least, max({value}) AS most"


PREFIX = """
WITH base AS (
  SELECT event_id, user_id, event_type AS kind, (epoch_us(ts) - 1704067200000000) // 300 AS us, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k FROM events),
num AS (
  SELECT *, (sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM base),
raw AS (
  SELECT event_id, user_id || '-' || session_no AS session, user_id::VARCHAR AS user_id,
    (1 + (user_id * 31 + session_no * 17) % (SELECT count(*) FROM part))::BIGINT AS content_id,
    CASE WHEN kind = 'signup' THEN 'VideoSessionStart' WHEN kind = 'view' THEN 'VideoPlay'
      WHEN kind = 'click' AND k % 4 = 0 THEN 'AppBackgrounded' WHEN kind = 'click' AND k % 4 = 1 THEN 'AppForegrounded'
      WHEN kind = 'error' AND k % 2 = 0 THEN 'VideoSessionEnd' WHEN kind = 'error' THEN 'VideoError' ELSE 'VideoHeartbeat' END AS event_type,
    CASE WHEN kind = 'view' THEN 'Play' WHEN kind = 'signup' THEN 'VideoSessionStart'
      WHEN kind = 'click' THEN ['AppBackgrounded', 'AppForegrounded', 'buffer-health', 'network-activity', 'AppBackgrounded', 'AppForegrounded', 'downshift', 'dropped-frames', 'AppBackgrounded', 'AppForegrounded', 'speed-change', 'video_quality_change', 'AppBackgrounded', 'AppForegrounded', 'buffer-health', 'network-activity'][k % 16 + 1]
      WHEN kind = 'purchase' THEN ['pause', 'resume', 'BufferStart', 'pause', 'resume', 'BufferEnd'][k % 6 + 1]
      WHEN k % 2 = 0 THEN 'VideoSessionEnd' ELSE 'VideoError' END AS event,
    1704067200000 + us // 1000 AS event_ms,
    ['android', 'ios', 'web', 'mweb', 'androidtv', 'firetv', 'appletv', 'roku', 'samsungtv', 'lgtv'][(user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) % 10 + 1] AS platform,
    'v' || event_id % 5 AS app_version, coalesce(n_name, 'unknown') AS country,
    ['en-US', 'HI', 'ta-IN', 'UNK', 'off', ''][event_id % 6 + 1] AS audio_language, ['off', 'EN', 'hi-in', 'unk'][event_id % 4 + 1] AS subtitle_language,
    'p' || event_id % 3 AS player_version, ['480p', '720p', '1080p', 'unknown'][session_no % 4 + 1] AS video_resolution,
    1704067200000 + us // 1000 + (event_id % 120) * 1000 AS ingest_ms
  FROM num LEFT JOIN nation ON n_nationkey = user_id % 25 JOIN (SELECT unnest(range(2)) AS copy) AS c ON copy = 0 OR event_id % 97 = 0),
content_versions AS (
  SELECT p_partkey AS content_id, p_name AS title, CASE WHEN p_size <= 12 THEN 'live' ELSE 'vod' END AS video_type, p_brand AS category, p_type AS show_name, 1704067200000 AS updated_ms FROM part WHERE p_partkey % 20 <> 0
  UNION ALL SELECT p_partkey, 'old ' || p_name, 'vod', 'old', 'old', 1704067200000 - 86400000 FROM part WHERE p_partkey % 20 <> 0 AND p_partkey % 7 = 0),
content AS (SELECT * FROM content_versions QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY updated_ms DESC) = 1),
advertisers AS (SELECT DISTINCT l_suppkey::BIGINT AS advertiser_id, l_partkey::BIGINT AS content_id FROM lineitem),
ev AS (
  SELECT raw.*, coalesce(title, 'unknown') AS title, coalesce(video_type, 'unknown') AS video_type, coalesce(category, 'unknown') AS category, coalesce(show_name, 'unknown') AS show_name
  FROM raw LEFT JOIN content USING (content_id)),
sig AS (
  SELECT *, list_position(['START', 'PLAY', 'FG', 'RESUME', 'PAUSE', 'BG', 'ERR', 'END', 'HB'], signal) AS tie_break FROM (
    SELECT *, CASE event_type WHEN 'VideoSessionStart' THEN 'START' WHEN 'VideoSessionEnd' THEN 'END' WHEN 'VideoPlay' THEN 'PLAY' WHEN 'AppBackgrounded' THEN 'BG'
      WHEN 'AppForegrounded' THEN 'FG' WHEN 'VideoError' THEN 'ERR' ELSE CASE WHEN event IN ('pause', 'speed-pause', 'AdPause') THEN 'PAUSE' WHEN event IN ('resume', 'speed-resume', 'AdResume') THEN 'RESUME' ELSE 'HB' END END AS signal FROM ev)),
pins AS (
  SELECT session, user_id, platform, country, video_resolution, content_id FROM sig QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_ms, tie_break, event_id) = 1),
tl AS (
  SELECT pins.*, s.event_ms, s.event_type, s.event, s.signal, s.tie_break, s.event_id
  FROM (SELECT session, event_ms, event_type, event, signal, tie_break, min(event_id) AS event_id FROM sig GROUP BY ALL) AS s JOIN pins USING (session)),
st AS (
  SELECT *, coalesce(last_value(CASE signal WHEN 'FG' THEN 1 WHEN 'BG' THEN 0 END IGNORE NULLS) OVER w, 1)::INTEGER AS fg,
    coalesce(last_value(CASE WHEN signal IN ('PLAY', 'RESUME') THEN 1 WHEN signal = 'PAUSE' THEN 0 END IGNORE NULLS) OVER w, 0)::INTEGER AS playing,
    (sum(CASE WHEN signal = 'END' THEN 1 ELSE 0 END) OVER w)::INTEGER AS ended
  FROM tl WINDOW w AS (PARTITION BY session ORDER BY event_ms, tie_break, event_id ROWS UNBOUNDED PRECEDING)),
seg AS (
  SELECT *, least(lead(event_ms) OVER (PARTITION BY session ORDER BY event_ms, tie_break, event_id), event_ms + 90000) AS seg_end_ms, fg = 1 AND playing = 1 AND ended = 0 AS is_active FROM st),
act AS (SELECT session, user_id, platform, country, video_resolution, content_id, event_ms AS seg_start_ms, seg_end_ms AS seg_stop_ms FROM seg WHERE is_active),
iv AS (
  SELECT session, user_id, platform, country, video_resolution, content_id, min(seg_start_ms) AS start_ms, max(seg_stop_ms) AS end_ms FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY seg_start_ms, seg_stop_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN seg_start_ms <= max(seg_stop_ms) OVER (PARTITION BY session ORDER BY seg_start_ms, seg_stop_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM act WHERE seg_stop_ms > seg_start_ms))
  GROUP BY session, user_id, platform, country, video_resolution, content_id, island),
mins AS (
  SELECT DISTINCT session, user_id, platform, country, video_resolution, content_id, unnest(range(seg_start_ms // 60000, seg_stop_ms // 60000 + 1)) AS minute FROM act),
runs AS (
  SELECT session, user_id, platform, country, video_resolution, content_id, min(minute) AS run_start, max(minute) + 1 AS run_end FROM (
    SELECT *, minute - row_number() OVER (PARTITION BY session ORDER BY minute) AS g FROM mins) GROUP BY session, user_id, platform, country, video_resolution, content_id, g),
spans AS (
  SELECT session, user_id, platform, country, video_resolution, content_id, min(event_ms) AS first_ms, max(event_ms) AS last_ms, min(event_ms) // 60000 AS first_minute, (max(event_ms) + 90000) // 60000 + 1 AS close_minute
  FROM tl GROUP BY ALL),
act_d AS (
  SELECT session, user_id, platform, country, video_resolution, content_id, run_start AS minute, 1 AS a, 0 AS o FROM runs
  UNION ALL SELECT session, user_id, platform, country, video_resolution, content_id, run_end, -1, 0 FROM runs),
open_d AS (
  SELECT session, user_id, platform, country, video_resolution, content_id, first_minute AS minute, 0 AS a, 1 AS o FROM spans
  UNION ALL SELECT session, user_id, platform, country, video_resolution, content_id, close_minute, 0, -1 FROM spans),
deltas AS (
  SELECT session, user_id, platform, country, video_resolution, content_id, minute, sum(a)::BIGINT AS delta_sessions, sum(o)::BIGINT AS delta_open
  FROM (SELECT * FROM act_d UNION ALL SELECT * FROM open_d) GROUP BY ALL),
typed AS (
  SELECT deltas.*, coalesce(title, 'unknown') AS title, coalesce(video_type, 'unknown') AS video_type, coalesce(category, 'unknown') AS category, coalesce(show_name, 'unknown') AS show_name FROM deltas LEFT JOIN content USING (content_id)),
axis AS (SELECT unnest(range(28401150, 28401210))::BIGINT AS minute),
curve AS (
  SELECT minute, coalesce((SELECT sum(delta_sessions) FROM deltas AS d WHERE d.minute <= axis.minute), 0)::BIGINT AS concurrency,
    coalesce((SELECT sum(delta_open) FROM deltas AS d WHERE d.minute <= axis.minute), 0)::BIGINT AS opened FROM axis),
points AS (SELECT minute, (sum(d) OVER (ORDER BY minute))::BIGINT AS cc FROM (SELECT minute, sum(delta_sessions) AS d FROM deltas GROUP BY minute)),
starts AS (SELECT * FROM typed WHERE delta_sessions > 0 AND minute >= 28401150 AND minute < 28401210)
"""

GAPS = "SELECT *, (event_ms - lag(event_ms) OVER (PARTITION BY session ORDER BY event_ms, tie_break, event_id)) / 1000 AS gap_s FROM tl"


def sliced_curve(dim: str) -> str:
    return f"(SELECT k.{dim}, axis.minute, coalesce(sum(d.delta_sessions), 0)::BIGINT AS concurrency FROM (SELECT DISTINCT {dim} FROM typed WHERE minute < {W1}) AS k CROSS JOIN axis LEFT JOIN typed AS d ON d.{dim} = k.{dim} AND d.minute <= axis.minute GROUP BY ALL)"


def filtered_curve(test: str) -> str:
    return f"(SELECT axis.minute, coalesce(sum(d.delta_sessions), 0)::BIGINT AS concurrency FROM axis LEFT JOIN (SELECT * FROM typed WHERE {test}) AS d ON d.minute <= axis.minute GROUP BY ALL)"


PEAK = "max(concurrency)::BIGINT AS peak, arg_max(minute, concurrency * 100000000 - minute) AS m, round(coalesce(avg(CASE WHEN concurrency > 0 THEN concurrency END), 0), 4) AS avg_occupied, count(*) FILTER (WHERE concurrency > 0) AS occupied_minutes"


def peak_of(curve: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"SELECT {head}peak, {t('m', 'peak_minute')}, avg_occupied, occupied_minutes FROM (SELECT {head}{PEAK} FROM {curve} {'GROUP BY ' + by if by else ''})"


def merged_islands(segments: str) -> str:
    """Touching non-empty segments as intervals."""
    return f"""SELECT {K}, min(seg_start_ms) AS start_ms, max(seg_stop_ms) AS end_ms FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY seg_start_ms, seg_stop_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN seg_start_ms <= max(seg_stop_ms) OVER (PARTITION BY session ORDER BY seg_start_ms, seg_stop_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({segments}) WHERE seg_stop_ms > seg_start_ms))
      GROUP BY {K}, island"""


def variant_segments(test: str, live: bool, timeout: int = 90_000) -> str:
    after = "lead(event_ms) OVER (PARTITION BY session ORDER BY event_ms, tie_break, event_id)"
    end = f"least({after}, event_ms + {timeout})" if live else f"coalesce({after}, event_ms + {timeout})"
    return f"SELECT {K}, event_ms AS seg_start_ms, seg_stop_ms FROM (SELECT *, {end} AS seg_stop_ms FROM st) WHERE {test}"


def minutes_of(segments: str) -> str:
    return f"SELECT DISTINCT {K}, unnest(range(seg_start_ms // 60000, seg_stop_ms // 60000 + 1)) AS minute FROM ({segments})"


def variant(name: str, test: str, live: bool) -> str:
    segments = variant_segments(test, live)
    return f"""SELECT '{name}' AS variant, (SELECT count(*) FROM ({merged_islands(segments)})) AS intervals,
      (SELECT round(coalesce(sum(end_ms - start_ms), 0) / 3600000.0, 4) FROM ({merged_islands(segments)})) AS active_hours,
      (SELECT max(n) FROM (SELECT minute, count(*) AS n FROM ({minutes_of(segments)}) GROUP BY minute)) AS peak,
      (SELECT count(DISTINCT minute) FROM ({minutes_of(segments)})) AS occupied_minutes"""


def until_next(kept: str, opening: str) -> str:
    w = "OVER (PARTITION BY session ORDER BY event_ms, tie_break, event_id)"
    return f"(SELECT *, (next_ms - event_ms) / 1000 AS gap_s FROM (SELECT *, lead(signal) {w} AS next_signal, lead(event) {w} AS next_event, lead(event_ms) {w} AS next_ms FROM tl WHERE {kept}) WHERE {opening})"


def open_policy(policy: str) -> str:
    """Intervals known at the watermark under one open-session policy."""
    keep = " AND session IN (SELECT session FROM tl WHERE signal = 'END' AND event_ms <= " + str(MARK_MS) + ")" if policy == "P1" else ""
    w = "(PARTITION BY session ORDER BY event_ms, tie_break, event_id)"
    known = f"SELECT *, least(lead(event_ms) OVER {w}, event_ms + 90000) AS seg_stop_ms, row_number() OVER (PARTITION BY session ORDER BY event_ms DESC, tie_break DESC, event_id DESC) AS back FROM st WHERE event_ms <= {MARK_MS}{keep}"
    test = "fg = 1 AND playing = 1 AND ended = 0"
    segments = f"SELECT {K}, event_ms AS seg_start_ms, seg_stop_ms FROM ({known}) WHERE {test}"
    if policy == "P3":
        segments += f" UNION ALL SELECT {K}, event_ms, {MARK_MS} FROM ({known}) WHERE back = 1 AND {test} AND event_ms < {MARK_MS}"
    return merged_islands(segments)


DIMS_FOR_BREAKDOWN = ("platform", "app_version", "audio_language", "category", "video_type")
PROFILED = ("platform", "app_version", "country", "audio_language", "subtitle_language", "player_version", "video_resolution", "title", "video_type", "category", "show_name")
KEEP = "('buffer-health', 'video-resize', 'network-bandwidth', 'network-activity')"
ORD = "event_ms, tie_break, event_id"
ORDW = f"(PARTITION BY session ORDER BY {ORD})"

_cap = "CASE WHEN gap_s <= 5 THEN '0-5s' WHEN gap_s <= 30 THEN '5-30s' WHEN gap_s <= 45 THEN '30-45s' WHEN gap_s <= 60 THEN '45-60s' WHEN gap_s <= 90 THEN '60-90s' WHEN gap_s <= 300 THEN '90-300s' WHEN gap_s <= 600 THEN '5-10min' ELSE '>10min' END"
_transition = f"""SELECT {K}, event_ms AS start_ms, coalesce(lead(event_ms) OVER {ORDW}, event_ms + 90000) AS end_ms, state FROM (
  SELECT *, lag(state) OVER {ORDW} AS before, coalesce(max(CASE WHEN state = 'terminal' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM (
    SELECT *, CASE WHEN signal IN ('PLAY', 'RESUME') THEN 'active' WHEN signal = 'END' THEN 'terminal' WHEN signal IN ('START', 'PAUSE', 'BG', 'ERR') THEN 'inactive' END AS state FROM tl) WHERE state IS NOT NULL)
  WHERE done = 0 AND state IS DISTINCT FROM before"""
_soft = f"SELECT {K}, event_ms AS seg_start_ms, least(event_ms + 90000, end_at) AS seg_stop_ms FROM (SELECT *, min(CASE WHEN signal = 'END' THEN event_ms END) OVER (PARTITION BY session) AS end_at FROM st) WHERE fg = 1 AND playing = 1 AND ended = 0"
_cut = f"""SELECT {K}, greatest(run_start, h * 60) AS run_start, least(run_end, (h + 1) * 60) AS run_end, h * 60 AS hour FROM (SELECT *, unnest(range(run_start // 60, (run_end - 1) // 60 + 1)) AS h FROM runs)"""
_cut_d = f"(SELECT {K}, hour, run_start AS minute, 1 AS d FROM ({_cut}) UNION ALL SELECT {K}, hour, run_end, -1 FROM ({_cut}))"
_trend = f"(SELECT *, cc - lag(cc, 1, 0) OVER (ORDER BY minute) AS delta FROM points WHERE minute <= {W1})"
_trend_in = f"(SELECT minute, cc, delta, round(delta / nullif(cc - delta, 0), 6) AS pct_change FROM {_trend} WHERE minute >= {W1} - 10)"
_last = f"(SELECT arg_max(cc, minute) AS current, arg_max(delta, minute) AS slope, count(*) AS n FROM {_trend_in})"
_presence = "(SELECT session, user_id, platform, country, video_resolution, content_id, minute, 1 AS a FROM mins UNION ALL SELECT session, user_id, platform, country, video_resolution, content_id, unnest(range(first_minute, close_minute)), 0 FROM spans)"
_stats = f"(SELECT minute, {SLICE}, sum(a)::BIGINT AS active_sessions, sum(1 - a)::BIGINT AS open_sessions, count(DISTINCT CASE WHEN a = 1 THEN user_id END) AS active_users, count(DISTINCT CASE WHEN a = 0 THEN user_id END) AS open_users FROM {_presence} GROUP BY minute, {SLICE})"
_rolled = lambda n: f"SELECT {t(f'minute // {n} * {n}', 'bucket')}, {SLICE}, max(active_sessions)::BIGINT AS peak_active_sessions, round(avg(active_sessions), 4) AS avg_active_sessions, max(open_sessions)::BIGINT AS peak_open_sessions, round(avg(open_sessions), 4) AS avg_open_sessions FROM {_stats} GROUP BY ALL"
_present = "(SELECT * FROM sig WHERE NOT lower(event) LIKE 'download%' AND signal NOT IN ('PAUSE', 'BG', 'END'))"
_naive = "(SELECT event_ms // 60000 AS minute, count(DISTINCT session) AS naive FROM ev GROUP BY 1)"
_bill = f"""SELECT advertiser_id, coalesce(arg_max(cc, minute), 0)::BIGINT AS impressions FROM (SELECT DISTINCT advertiser_id FROM advertisers) LEFT JOIN (
  SELECT * FROM (SELECT advertiser_id, minute, (sum(d) OVER (PARTITION BY advertiser_id ORDER BY minute))::BIGINT AS cc FROM (
    SELECT advertiser_id, minute, sum(delta_sessions) AS d FROM deltas JOIN advertisers USING (content_id) WHERE delta_sessions <> 0 AND minute < {W1} GROUP BY ALL)) WHERE minute >= {W0}) USING (advertiser_id) GROUP BY advertiser_id"""
_session_flags = "SELECT session, platform, content_id, (max(event_ms) - min(event_ms)) / 1000 AS duration_s, count(*) FILTER (WHERE signal = 'BG') AS bg, count(*) FILTER (WHERE signal = 'PAUSE') AS pauses FROM tl GROUP BY ALL"
_typed_sessions = f"(SELECT f.*, coalesce(video_type, 'unknown') AS video_type FROM ({_session_flags}) AS f LEFT JOIN content USING (content_id))"


HOURLY_SPLITS = ("country", "video_resolution", "video_type", "show_name", "title")


def traffic_split(slot: str, dim: str) -> str:
    counted = f"(SELECT {slot} AS slot, {dim} AS series, count(*) AS n FROM starts GROUP BY ALL)"
    best = f"(SELECT series FROM {counted} GROUP BY series ORDER BY sum(n) DESC, series LIMIT 8)"
    cells = f"(SELECT slot, CASE WHEN series IN {best} THEN series ELSE 'Other' END AS series, sum(n)::BIGINT AS value FROM {counted} GROUP BY ALL)"
    return f"SELECT s.slot, n.series, coalesce(c.value, 0)::BIGINT AS value FROM (SELECT DISTINCT slot FROM {cells}) AS s CROSS JOIN (SELECT DISTINCT series FROM {cells}) AS n LEFT JOIN {cells} AS c ON c.slot = s.slot AND c.series = n.series"


def check(name: str, observed: str, source: str, bound: float, test: str) -> str:
    return f"SELECT '{name}' AS \"check\", round(v, 4) AS observed, {float(bound)} AS bound, {test} AS ok FROM (SELECT coalesce(({observed})::DOUBLE, 0) AS v FROM {source})"


def _gap(source: str, part: str, order: str) -> str:
    return f"(SELECT *, (event_ms - lag(event_ms) OVER (PARTITION BY {part} ORDER BY {order})) / 1000 AS g FROM {source})"


CHECKS = [
    check("raw_columns", "13 - count(*)", "(DESCRIBE SELECT * FROM ev) WHERE column_name IN ('session', 'user_id', 'platform', 'country', 'video_resolution', 'content_id', 'event_type', 'event', 'event_ms', 'app_version', 'audio_language', 'subtitle_language', 'player_version')", 0, "v = 0"),
    check("event_types", "count(DISTINCT event_type)", "ev", 7, "v = 7"),
    check("sessions_over_contents", "count(*) FILTER (WHERE n > 1)", "(SELECT count(DISTINCT content_id) AS n FROM ev GROUP BY session)", 2, "v <= 2"),
    check("out_of_order", "count(*) FILTER (WHERE event_ms < b)", "(SELECT *, lag(event_ms) OVER (PARTITION BY session ORDER BY ingest_ms, event_ms, event_id) AS b FROM ev)", 0, "v = 0"),
    check("keepalive_median_s", "quantile_cont(g, 0.5)", _gap(f"(SELECT * FROM tl WHERE event IN {KEEP})", "session, event", "event_ms, event_id"), 45, "v BETWEEN 25 AND 45"),
    check("gap_p99_s", "quantile_cont(g, 0.99)", _gap("tl", "session", ORD), 90, "v < 90"),
    check("contents_without_metadata", "count(*)", "(SELECT DISTINCT content_id FROM ev WHERE content_id NOT IN (SELECT content_id FROM content))", 0, "v = 0"),
    check("active_after_error", "count(*) FILTER (WHERE hi > err + 5000)", "(SELECT max(CASE WHEN signal = 'ERR' THEN event_ms END) AS err, max(event_ms) AS hi FROM tl GROUP BY session)", 20, "v <= 20"),
    check("resume_beats", "count(*) FILTER (WHERE event = 'resume')", "ev", 1000, "v > 1000"),
    check("platforms", "count(DISTINCT platform)", "ev", 20, "v BETWEEN 1 AND 20"),
    check("empty_dimensions", "count(*) FILTER (WHERE coalesce(platform, '') = '' OR coalesce(country, '') = '' OR content_id IS NULL)", "ev", 0, "v = 0"),
    check("categories", "count(DISTINCT category)", "ev", 200, "v BETWEEN 20 AND 200"),
    check("exact_duplicates", "count(*)", "(SELECT 1 FROM ev GROUP BY session, event_ms, event_type, event, event_id HAVING count(*) > 1)", 0, "v > 0"),
    check("same_ms_ties", "count(*)", "(SELECT 1 FROM tl GROUP BY session, event_ms HAVING count(*) > 1)", 1000, "v > 1000"),
    check("negative_minutes", "count(*) FILTER (WHERE concurrency < 0)", "curve", 0, "v = 0"),
    check("sessions_not_netting", "count(*) FILTER (WHERE a <> 0 OR o <> 0)", "(SELECT sum(delta_sessions) AS a, sum(delta_open) AS o FROM deltas GROUP BY session)", 0, "v = 0"),
    check("curve_against_occupancy", "count(*) FILTER (WHERE concurrency <> n)", "(SELECT curve.minute, concurrency, count(mins.session) AS n FROM curve LEFT JOIN mins USING (minute) GROUP BY ALL)", 0, "v = 0"),
    check("curve_against_occupancy_platform", "count(*) FILTER (WHERE concurrency <> n)", f"(SELECT s.minute, s.platform, concurrency, count(mins.session) AS n FROM {sliced_curve('platform')} AS s LEFT JOIN mins ON mins.minute = s.minute AND mins.platform = s.platform GROUP BY ALL)", 0, "v = 0"),
    check("active_over_present", "count(*) FILTER (WHERE a > o)", f"(SELECT minute, sum(a) AS a, sum(1 - a) AS o FROM {_presence} GROUP BY minute)", 0, "v = 0"),
    check("ledger_run_count", "abs((SELECT count(*) FROM runs) - count(*))", "mins AS m ANTI JOIN (SELECT session, minute + 1 AS minute FROM mins) AS b ON b.session = m.session AND b.minute = m.minute", 0, "v = 0"),
    check("ledger_faults", "count(*) FILTER (WHERE sign NOT IN (1, -1) OR run_start >= run_end OR run_start < reach)", "(SELECT *, 1 AS sign, lag(run_end) OVER (PARTITION BY session ORDER BY run_start) AS reach FROM runs)", 0, "v = 0"),
    check("pins_not_first", "count(*) FILTER (WHERE p <> f)", "(SELECT DISTINCT session, row(user_id, platform, country, video_resolution, content_id) AS p FROM tl) JOIN (SELECT session, row(user_id, platform, country, video_resolution, content_id) AS f FROM sig QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_ms, tie_break, event_id) = 1) USING (session)", 0, "v = 0"),
    check("active_after_end", "count(*) FILTER (WHERE seg_start_ms > end_ms)", "act JOIN (SELECT session, min(event_ms) AS end_ms FROM tl WHERE signal = 'END' GROUP BY session) USING (session)", 0, "v = 0"),
    check("active_beyond_timeout", "count(*) FILTER (WHERE seg_stop_ms > hi + 90000)", "act JOIN (SELECT session, max(event_ms) AS hi FROM tl GROUP BY session HAVING count(*) FILTER (WHERE signal = 'ERR') > 0) USING (session)", 0, "v = 0"),
    check("hour_cut_differs", "count(*) FILTER (WHERE concurrency <> cc)", f"(SELECT minute, (sum(d) OVER (PARTITION BY hour ORDER BY minute))::BIGINT AS concurrency FROM (SELECT hour, minute, sum(d) AS d FROM {_cut_d} WHERE minute < hour + 60 GROUP BY ALL)) JOIN points USING (minute)", 0, "v = 0"),
    check("gap_minutes_changed", "count(*) FILTER (WHERE c.concurrency <> b.concurrency)", "curve AS c JOIN curve AS b ON b.minute = c.minute - 1 WHERE c.minute NOT IN (SELECT minute FROM deltas)", 0, "v = 0"),
    check("sessions_over_partitions", "count(*) FILTER (WHERE n > 1)", "(SELECT count(DISTINCT stored) AS n FROM (SELECT session, min(event_ms) OVER (PARTITION BY session) // 86400000 AS stored FROM ev) GROUP BY session)", 0, "v = 0"),
    check("delta_columns", "9 - count(*)", "(DESCRIBE SELECT * FROM deltas) WHERE column_name IN ('session', 'user_id', 'platform', 'country', 'video_resolution', 'content_id', 'minute', 'delta_sessions', 'delta_open')", 0, "v = 0"),
]

BODIES: dict[str, str] = {
    # cleaning
    "read_events_csv": "SELECT content_id::VARCHAR AS content_id, session::VARCHAR AS video_session_id, user_id::VARCHAR AS user_id, event_type::VARCHAR AS event_type, event::VARCHAR AS event, event_ms::VARCHAR AS event_timestamp, platform::VARCHAR AS platform, app_version::VARCHAR AS app_version, country::VARCHAR AS country, nullif(audio_language, '') AS audio_language, subtitle_language::VARCHAR AS subtitle_language, player_version::VARCHAR AS player_version, video_resolution::VARCHAR AS video_resolution, event_ms::VARCHAR AS session_start_epoch, event_id::VARCHAR AS event_id, ingest_ms::VARCHAR AS ingest_ms FROM raw",
    "read_dim_csv": "SELECT content_id, title, video_type, category FROM content",
    "write_partitioned": f"SELECT {K}, {t('minute')}, delta_sessions, delta_open, strftime(make_timestamp(minute * 60000000), '%Y-%m-%d') AS stored_day FROM deltas",
    "replay_day": f"SELECT event_id, session, {ms('lo + (event_ms - lo) // 10', 'event_ts')} FROM raw CROSS JOIN (SELECT min(event_ms) AS lo FROM raw)",
    "decode_events": f"SELECT event_id, session, user_id, content_id, event_type, event, {ms('event_ms', 'event_ts')}, platform, country, {ms('ingest_ms', 'ingest_ts')} FROM raw",
    "normalize_dim": "SELECT audio, subtitle, count(*) AS events FROM (SELECT CASE WHEN a IN ('', 'unk', 'off') THEN 'unknown' ELSE a END AS audio, CASE WHEN s IN ('', 'unk', 'off') THEN 'unknown' ELSE s END AS subtitle FROM (SELECT lower(split_part(audio_language, '-', 1)) AS a, lower(split_part(subtitle_language, '-', 1)) AS s FROM ev)) GROUP BY ALL",
    "latest_version": f"SELECT content_id, title, video_type, category, show_name, {ms('updated_ms', 'updated_ts')} FROM content",
    "enrich_content": "SELECT event_id, session, content_id, title, video_type, category, show_name FROM ev",
    "dedup_events": f"SELECT session, {ms('event_ms', 'event_ts')}, event_type, event, min(event_id) AS event_id FROM ev GROUP BY session, event_ms, event_type, event",
    "event_fingerprint": "SELECT count(*) AS events, (SELECT count(*) FROM (SELECT DISTINCT session, event_type, event, event_ms FROM ev)) AS fingerprints FROM ev",
    "classify_signal": "SELECT event_type, event, signal, tie_break, CASE WHEN lower(event) LIKE 'download%' THEN 'ignore' WHEN signal IN ('HB', 'START', 'ERR') THEN 'liveness' ELSE 'trigger' END AS role, count(*) AS events FROM sig GROUP BY ALL",
    "pin_dimensions": f"SELECT {K} FROM pins",
    "changed_sessions": f"SELECT session, count(*) AS events FROM ev WHERE session IN (SELECT session FROM ev WHERE ingest_ms > {MARK_MS} AND ingest_ms <= {MARK_MS} + 595000) GROUP BY session",
    "apply_retention": f"SELECT {K}, {t('minute')}, delta_sessions, delta_open FROM deltas WHERE minute >= {W0 + 30}",
    # state machine
    "read_quoted_csv": "SELECT content_id, 'He said \"' || title || '\", ' || category || chr(10) || 'and left' AS title, video_type, category FROM content",
    "midnight_layout": f"SELECT strftime(make_timestamp(lo * 1000), '%Y-%m-%d') AS stored_day, count(DISTINCT session) AS sessions, count(*) AS events, count(*) FILTER (WHERE moved // 86400000 > lo // 86400000) AS after_midnight FROM (SELECT *, min(moved) OVER (PARTITION BY session) AS lo FROM (SELECT session, event_ms + {MIDNIGHT_MS} AS moved FROM raw)) GROUP BY ALL",
    "chunked_segments": f"SELECT {K}, {ms('event_ms', 'event_ts')}, signal, event_id, fg, playing, ended, {ms('seg_end_ms', 'seg_end_ts')}, is_active FROM seg",
    "range_audience": "SELECT range_name, round(coalesce(sum(CASE WHEN session IS NOT NULL THEN least(end_ms, hi) - greatest(start_ms, lo) END), 0) / (hi - lo), 3) AS avg_time_weighted, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in RANGES) + "]) AS range_name, unnest([" + ", ".join(str(a * 60_000) for a, _ in RANGES.values()) + "]) AS lo, unnest([" + ", ".join(str(b * 60_000) for _, b in RANGES.values()) + "]) AS hi) AS r LEFT JOIN iv ON start_ms < hi AND end_ms > lo AND end_ms > start_ms GROUP BY range_name, lo, hi",
    "gate_states": f"SELECT {K}, {ms('event_ms', 'event_ts')}, tie_break, signal, event_id, fg, playing, ended FROM st",
    "liveness_segments": f"SELECT {K}, {ms('event_ms', 'event_ts')}, signal, event_id, {ms('seg_end_ms', 'seg_end_ts')}, is_active FROM seg",
    "active_segments": f"SELECT {K}, {ms('seg_start_ms', 'seg_start_ts')}, {ms('seg_stop_ms', 'seg_stop_ts')} FROM act",
    "active_intervals": f"SELECT {K}, {ms('start_ms', 'start_ts')}, {ms('end_ms', 'end_ts')} FROM iv",
    "session_minutes": f"SELECT {K}, {t('minute')} FROM mins",
    "minute_runs": f"SELECT {K}, {t('run_start')}, {t('run_end')} FROM runs",
    "active_deltas": f"SELECT {K}, {t('minute')}, a::BIGINT AS delta_sessions, o::BIGINT AS delta_open FROM act_d",
    "open_deltas": f"SELECT {K}, {t('minute')}, a::BIGINT AS delta_sessions, o::BIGINT AS delta_open FROM open_d",
    "merged_deltas": f"SELECT {K}, {t('minute')}, delta_sessions, delta_open FROM deltas",
    "full_range_deltas": f"SELECT f.session, f.user_id, f.platform, f.country, f.video_resolution, f.content_id, {t('f.minute', 'minute')}, coalesce(delta_sessions, 0) AS delta_sessions, coalesce(delta_open, 0) AS delta_open FROM (SELECT {K}, unnest(range(first_minute, close_minute + 1)) AS minute FROM spans) AS f LEFT JOIN deltas AS d ON d.session = f.session AND d.minute = f.minute",
    "current_deltas": f"SELECT {K}, {t('minute')}, delta_sessions, delta_open FROM deltas",
    "run_ledger": f"SELECT {K}, {t('run_start')}, {t('run_end')}, 1 AS sign FROM runs",
    "hour_cut_deltas": f"SELECT {K}, {t('hour')}, {t('minute')}, d::BIGINT AS delta_sessions FROM {_cut_d}",
    "error_policy": "SELECT policy, intervals, active_hours FROM (" + " UNION ALL ".join(
        f"SELECT '{p}' AS policy, count(*) AS intervals, round(coalesce(sum(end_ms - start_ms), 0) / 3600000.0, 4) AS active_hours FROM ({merged_islands(x)})" for p, x in (
            ("liveness", "SELECT * FROM act"),
            ("inactive", f"SELECT {K}, event_ms AS seg_start_ms, stop AS seg_stop_ms FROM (SELECT *, least(lead(event_ms) OVER {ORDW}, event_ms + 90000) AS stop, coalesce(last_value(CASE WHEN signal IN ('PLAY', 'RESUME') THEN 1 WHEN signal IN ('PAUSE', 'ERR') THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY {ORD} ROWS UNBOUNDED PRECEDING), 0) AS p FROM st) WHERE fg = 1 AND p = 1 AND ended = 0"),
            ("terminal", f"SELECT {K}, event_ms AS seg_start_ms, stop AS seg_stop_ms FROM (SELECT *, least(lead(event_ms) OVER {ORDW}, event_ms + 90000) AS stop, sum(CASE WHEN signal IN ('END', 'ERR') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS e FROM st) WHERE fg = 1 AND playing = 1 AND e = 0"),
        )) + ")",
    "transition_intervals": f"SELECT {K}, {ms('start_ms', 'start_ts')}, {ms('end_ms', 'end_ts')} FROM ({_transition}) WHERE state = 'active' AND end_ms > start_ms",
    "soft_close_intervals": f"SELECT {K}, {ms('start_ms', 'start_ts')}, {ms('end_ms', 'end_ts')} FROM ({merged_islands(_soft)})",
    "gate_ablation": " UNION ALL ".join([variant("V0", "ended = 0", False), variant("V1", "ended = 0 AND fg = 1", False), variant("V2", "ended = 0 AND fg = 1 AND playing = 1", False), variant("V3", "ended = 0 AND fg = 1 AND playing = 1", True)]),
    "naive_delta_curve": f"SELECT {t('minute')}, (sum(step) OVER (ORDER BY minute))::BIGINT AS concurrency FROM (SELECT event_ms // 60000 AS minute, sum(CASE WHEN signal = 'PAUSE' THEN -1 ELSE 1 END) AS step FROM tl WHERE signal IN ('PLAY', 'RESUME', 'PAUSE') GROUP BY 1)",
    "interval_floor_deltas": f"SELECT platform, country, content_id, video_type, {t('minute')}, sum(d)::BIGINT AS delta FROM (SELECT platform, country, content_id, coalesce(video_type, 'unknown') AS video_type, unnest([start_ms // 60000, end_ms // 60000]) AS minute, unnest([1, -1]) AS d FROM iv LEFT JOIN content USING (content_id)) GROUP BY ALL HAVING sum(d) <> 0",
    "open_session_policy": " UNION ALL ".join(f"SELECT '{p}' AS policy, count(*) AS intervals, count(DISTINCT session) AS sessions, round(coalesce(sum(end_ms - start_ms), 0) / 3600000.0, 4) AS active_hours FROM ({open_policy(p)})" for p in ("P1", "P2", "P3")),
    "timeout_sweep_sensitivity": " UNION ALL ".join(f"SELECT {s} AS timeout_s, (SELECT max(n) FROM (SELECT minute, count(*) AS n FROM ({minutes_of(variant_segments('fg = 1 AND playing = 1 AND ended = 0', True, s * 1000))}) GROUP BY minute)) AS peak" for s in (45, 60, 90, 120, 300)),
    # rollups
    "narrow_deltas": f"SELECT {t('minute')}, platform, country, video_resolution, sum(delta_sessions)::BIGINT AS delta_sessions, sum(delta_open)::BIGINT AS delta_open FROM deltas GROUP BY minute, platform, country, video_resolution",
    "minute_stats": f"SELECT {t('minute')}, {SLICE}, active_sessions, open_sessions, active_users, open_users FROM {_stats}",
    "hourly_stats": _rolled(60),
    "daily_stats": _rolled(1440),
    "users_minute": f"SELECT {t('minute')}, platform, country, coalesce(video_type, 'unknown') AS video_type, count(DISTINCT user_id) AS users FROM mins LEFT JOIN content USING (content_id) GROUP BY ALL",
    "presence_minute": f"SELECT {t('event_ms // 60000', 'minute')}, content_id, platform, country, video_type, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM {_present} GROUP BY ALL",
    "content_estimated_end": f"SELECT content_id, {t('m', 'scheduled_end_minute')}, CASE WHEN m IS NULL THEN 0 ELSE 1 END AS end_is_estimated FROM content LEFT JOIN (SELECT content_id, max(minute) AS m FROM deltas WHERE delta_sessions < 0 GROUP BY content_id) USING (content_id)",
    "minute_serving": f"""SELECT {t('minute')}, platform, country, sum(a)::BIGINT AS active_sessions, sum(u)::BIGINT AS active_users, sum(n)::BIGINT AS naive_sessions, sum(s)::BIGINT AS new_sessions, sum(e)::BIGINT AS ended_sessions FROM (
      SELECT minute, platform, country, count(*) AS a, count(DISTINCT user_id) AS u, 0 AS n, 0 AS s, 0 AS e FROM mins GROUP BY ALL
      UNION ALL SELECT event_ms // 60000, platform, country, 0, 0, count(DISTINCT session), 0, 0 FROM tl GROUP BY ALL
      UNION ALL SELECT first_minute, platform, country, 0, 0, 0, count(*), 0 FROM spans GROUP BY ALL
      UNION ALL SELECT m, platform, country, 0, 0, 0, 0, count(*) FROM (SELECT session, platform, country, min(event_ms) // 60000 AS m FROM tl WHERE signal = 'END' GROUP BY ALL) GROUP BY ALL) GROUP BY minute, platform, country""",
    "hour_anchors": f"SELECT {t('minute', 'hour')}, concurrency FROM curve WHERE minute % 60 = 0",
    "representation_row_counts": """SELECT 'events' AS representation, count(*) AS rows FROM ev UNION ALL SELECT 'session_minutes', count(*) FROM mins UNION ALL SELECT 'intervals', count(*) FROM iv UNION ALL SELECT 'runs', count(*) FROM runs UNION ALL SELECT 'deltas', count(*) FROM deltas
      UNION ALL SELECT 'deltas_global', count(DISTINCT minute) FROM deltas WHERE delta_sessions <> 0 UNION ALL SELECT 'deltas_platform', count(*) FROM (SELECT DISTINCT minute, platform FROM deltas WHERE delta_sessions <> 0)
      UNION ALL SELECT 'deltas_platform_content', count(*) FROM (SELECT DISTINCT minute, platform, content_id FROM deltas WHERE delta_sessions <> 0)""",
    # curves
    "concurrency_curve": f"SELECT {t('minute', 'bucket')}, concurrency FROM curve",
    "concurrency_curve_hour": f"SELECT {t('minute // 60 * 60', 'bucket')}, max(concurrency) AS concurrency FROM curve GROUP BY ALL",
    "dim_filter": f"SELECT {t('minute')}, concurrency FROM " + filtered_curve("platform IN ('android', 'ios') AND video_type = 'live'"),
    "minute_fill": f"SELECT platform, {t('minute')}, concurrency FROM " + sliced_curve("platform"),
    "peak_summary": peak_of("curve"),
    "peak_by_platform": peak_of(sliced_curve("platform"), "platform"),
    "peak_by_country": peak_of(sliced_curve("country"), "country"),
    "peak_by_category": peak_of(sliced_curve("category"), "category"),
    "peak_by_show_name": peak_of(sliced_curve("show_name"), "show_name"),
    "peak_by_video_type": peak_of(sliced_curve("video_type"), "video_type"),
    "active_vs_open": f"SELECT {t('minute')}, concurrency AS active, opened AS open, round(100.0 * concurrency / greatest(opened, 1), 1) AS pct_watching FROM curve",
    "unique_active_users": "SELECT count(DISTINCT user_id) AS users, count(*) AS starts FROM starts",
    "local_peaks": f"""SELECT {t('minute')}, concurrency FROM (
        WITH RECURSIVE ranked AS MATERIALIZED (SELECT minute, minute // 1440 AS d, row_number() OVER (PARTITION BY minute // 1440 ORDER BY concurrency DESC, minute) AS place FROM curve),
        greedy AS (
          SELECT DISTINCT d, 0::BIGINT AS place, []::BIGINT[] AS taken FROM ranked
          UNION ALL SELECT r.d, r.place, CASE WHEN len(taken) < 6 AND coalesce(list_min([abs(x - r.minute) for x in taken]), 15) >= 15 THEN list_append(taken, r.minute) ELSE taken END
          FROM greedy JOIN ranked AS r ON r.d = greedy.d AND r.place = greedy.place + 1)
        SELECT unnest(taken) AS minute FROM greedy QUALIFY row_number() OVER (PARTITION BY d ORDER BY place DESC) = 1) JOIN curve USING (minute)""",
    "publish_events": "SELECT session AS key, to_json(struct_pack(session := session, event_type := event_type, event := event, event_ms := event_ms))::VARCHAR AS value FROM raw",
    "hourly_summary": f"SELECT {t('minute // 60 * 60', 'hour')}, max(concurrency) AS peak, round(coalesce(avg(CASE WHEN concurrency > 0 THEN concurrency END), 0), 4) AS avg_occupied FROM curve GROUP BY ALL",
    "get_peak": f"SELECT v AS peak_value, {t('m', 'peak_minute')} FROM (SELECT max(concurrency) AS v, arg_max(minute, concurrency * 100000000 - minute) AS m FROM curve)",
    "active_users_at": f"SELECT count(DISTINCT user_id) AS active_users, count(*) AS active_sessions FROM (SELECT session, any_value(user_id) AS user_id FROM deltas WHERE content_id = 49 AND minute <= {W0 + 30} GROUP BY session HAVING sum(delta_sessions) > 0)",
    "trend": f"SELECT {t('minute')}, cc, delta, pct_change, CASE WHEN count(*) OVER () < 2 THEN 'insufficient_data' WHEN first_value(delta) OVER (ORDER BY minute DESC) > 0 THEN 'rising' WHEN first_value(delta) OVER (ORDER BY minute DESC) < 0 THEN 'falling' ELSE 'flat' END AS direction FROM {_trend_in}",
    "predict_load": f"SELECT current, slope, predicted, growth, CASE WHEN n < 2 THEN 'insufficient_data' WHEN growth >= 0.2 THEN 'scale_up' WHEN growth <= -0.2 THEN 'scale_down' ELSE 'hold' END AS action FROM (SELECT *, CASE WHEN current <> 0 THEN round((predicted - current) / current, 6) END AS growth FROM (SELECT *, greatest(0, current + slope * 10) AS predicted FROM {_last}))",
    "range_peak_avg": f"SELECT max(CASE WHEN minute >= {W0} AND minute < {W1} THEN cc END) AS peak, round(sum(CASE WHEN minute < {W1} THEN cc * greatest(least(nxt, {W1}) - greatest(minute, {W0}), 0) END) / ({W1} - {W0}), 4) AS avg_time_weighted FROM (SELECT *, lead(minute, 1, {W1}) OVER (ORDER BY minute) AS nxt FROM points)",
    "average_variants": f"SELECT (SELECT round(coalesce(avg(CASE WHEN concurrency > 0 THEN concurrency END), 0), 4) FROM curve) AS avg_occupied, (SELECT round(avg(concurrency), 4) FROM curve) AS avg_all, (SELECT round(coalesce(sum(least(end_ms, {HI_MS}) - greatest(start_ms, {LO_MS})), 0) / ({HI_MS} - {LO_MS}), 4) FROM iv WHERE start_ms < {HI_MS} AND end_ms > {LO_MS}) AS avg_time_weighted",
    "range_matrix": f"""SELECT range_name, filter_name, max(CASE WHEN minute >= lo AND minute < hi THEN cc END)::BIGINT AS peak,
        round(sum(CASE WHEN minute < hi THEN cc * greatest(least(coalesce(nxt, hi), hi) - greatest(minute, lo), 0) END) / (hi - lo), 4) AS avg_time_weighted
      FROM (SELECT *, lead(minute) OVER (PARTITION BY filter_name ORDER BY minute) AS nxt FROM (
        SELECT filter_name, minute, sum(sum(delta_sessions)) OVER (PARTITION BY filter_name ORDER BY minute) AS cc FROM (
          SELECT 'no_filter' AS filter_name, * FROM typed UNION ALL SELECT 'android', * FROM typed WHERE platform = 'android'
          UNION ALL SELECT 'ios', * FROM typed WHERE platform = 'ios' UNION ALL SELECT 'live', * FROM typed WHERE video_type = 'live') GROUP BY filter_name, minute))
      CROSS JOIN (VALUES {', '.join(f"('{name}', {a}, {b})" for name, (a, b) in RANGES.items())}) AS r(range_name, lo, hi) GROUP BY range_name, filter_name, lo, hi""",
    "range_metrics": f"""SELECT (SELECT max(c) FROM (SELECT sum(d) OVER (ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT unnest([greatest(start_ms, {LO_MS}), least(end_ms, {HI_MS})]) AS moment, unnest([1, -1]) AS d FROM iv WHERE start_ms < {HI_MS} AND end_ms > {LO_MS})))::BIGINT AS peak,
      round(sum(least(end_ms, {HI_MS}) - greatest(start_ms, {LO_MS})) / ({HI_MS} - {LO_MS}), 3) AS avg_time_weighted, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM iv WHERE start_ms < {HI_MS} AND end_ms > {LO_MS}""",
    "concurrency_at": f"SELECT {t('m', 'at_minute')}, (SELECT sum(delta_sessions) FROM deltas WHERE minute <= m)::BIGINT AS prefix_sum, (SELECT count(*) FROM iv WHERE start_ms <= m * 60000::BIGINT AND end_ms > m * 60000::BIGINT) AS covering FROM (SELECT unnest([{W0}, {W0 + 20}, {W0 + 45}])::BIGINT AS m)",
    "union_peak_vs_sum": "SELECT (SELECT max(concurrency) FROM " + filtered_curve("platform IN ('android', 'ios')") + ") AS union_peak, (SELECT max(concurrency) FROM " + filtered_curve("platform = 'android'") + ") + (SELECT max(concurrency) FROM " + filtered_curve("platform = 'ios'") + ") AS sum_of_peaks",
    "hour_seeded_curve": f"SELECT {t('hour')}, {t('minute')}, (sum(d) OVER (PARTITION BY hour ORDER BY minute))::BIGINT AS concurrency FROM (SELECT hour, minute, sum(d) AS d FROM {_cut_d} WHERE minute < hour + 60 GROUP BY ALL)",
    "decline_alert": f"SELECT {t('a.minute', 'minute')}, a.concurrency, b.concurrency AS before, round((b.concurrency - a.concurrency) / b.concurrency, 6) AS drop_share FROM curve AS a JOIN curve AS b ON b.minute + 5 = a.minute WHERE b.concurrency > 0 AND round((b.concurrency - a.concurrency) / b.concurrency, 6) > 0.2",
    "phantom_audience": f"SELECT {t('minute')}, concurrency AS sa, coalesce(si, 0) AS si, coalesce(si, 0) - concurrency AS diff, concurrency > 1.02 * coalesce(si, 0) AS alert FROM curve LEFT JOIN (SELECT event_ms // 60000 AS minute, count(DISTINCT session) AS si FROM {_present} GROUP BY 1) USING (minute)",
    "peak_people": f"SELECT users AS peak_users, {t('m', 'peak_minute')} FROM (SELECT max(users) AS users, arg_max(minute, users * 100000000 - minute) AS m FROM (SELECT minute, count(DISTINCT user_id) AS users FROM mins GROUP BY minute))",
    "content_drilldown": f"SELECT {t('minute', 'bucket')}, concurrency FROM " + filtered_curve("content_id = 49"),
    "compare_curves": f"""SELECT {t('minute')}, actual, computed, computed - actual AS diff, round(100.0 * (computed - actual) / greatest(actual, 1), 4) AS pct, abs(computed - actual) <= greatest(3.0, 0.03 * actual) AS ok, row_number() OVER (ORDER BY abs(computed - actual) DESC, minute) = 1 AS worst FROM (
      SELECT curve.minute, concurrency AS actual, count(iv.session) AS computed FROM curve LEFT JOIN iv ON iv.start_ms <= curve.minute * 60000 AND iv.end_ms > curve.minute * 60000 GROUP BY ALL)""",
    # dashboard
    "meta": f"SELECT {t('lo', 'min_minute')}, {t('hi', 'max_minute')}, platform, country, video_type, category, show_name FROM (SELECT min(minute) AS lo, max(minute) AS hi, string_agg(DISTINCT platform, '|' ORDER BY platform) AS platform, string_agg(DISTINCT country, '|' ORDER BY country) AS country FROM deltas), (SELECT string_agg(DISTINCT video_type, '|' ORDER BY video_type) AS video_type, string_agg(DISTINCT category, '|' ORDER BY category) AS category, string_agg(DISTINCT show_name, '|' ORDER BY show_name) AS show_name FROM content)",
    "dataset_info": f"SELECT {ms('max(event_ms) // 1000 * 1000', 'newest_ts')}, " + ", ".join(f"string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS {c}" for c in ("platform", "country", "video_type", "category")) + " FROM ev",
    "kpis": f"""SELECT (SELECT max(greatest(concurrency, 0)) FROM curve) AS peak_concurrency, (SELECT round(avg(greatest(concurrency, 0)), 1) FROM curve) AS avg_concurrency, (SELECT arg_max(greatest(concurrency, 0), minute) FROM curve) AS current_concurrency,
      (SELECT count(DISTINCT user_id) FROM starts) AS distinct_active_users, (SELECT round(coalesce(avg(hi // 1000 - lo // 1000), 0), 1) FROM (SELECT min(event_ms) AS lo, max(event_ms) AS hi FROM ev GROUP BY session) WHERE lo >= {LO_MS} AND lo < {HI_MS}) AS avg_watch_seconds""",
    "traffic": "SELECT minute % 1440 // 60 AS slot, count(*) AS value FROM starts GROUP BY ALL",
    "traffic_minute": "SELECT minute % 1440 AS slot, count(*) AS value FROM starts GROUP BY ALL",
    "traffic_day": f"SELECT {t('minute // 1440 * 1440', 'bucket')}, count(*) AS value FROM starts GROUP BY ALL",
    "traffic_split_by_category": traffic_split("minute % 1440 // 60", "category"),
    **{f"traffic_split_by_{dim}": traffic_split("minute % 1440 // 60", dim) for dim in HOURLY_SPLITS},
    "traffic_wide_by_video_type": "SELECT minute % 1440 // 60 AS slot, count(*) FILTER (WHERE video_type = 'live') AS live, count(*) FILTER (WHERE video_type = 'vod') AS vod, count(*) FILTER (WHERE video_type = 'unknown') AS unknown FROM starts GROUP BY 1",
    "traffic_split_by_platform": traffic_split("minute % 1440", "platform"),
    "geo": "SELECT country, count(*) AS sessions, count(DISTINCT user_id) AS users, round(100.0 * count(*) / (SELECT count(*) FROM starts), 2) AS share_pct FROM starts GROUP BY country",
    "content_ranking": "SELECT s.content_id, sessions, coalesce(c.title, 'Content ' || s.content_id) AS title, coalesce(c.video_type, 'unknown') AS video_type, coalesce(c.category, 'unknown') AS category FROM (SELECT content_id, count(*) AS sessions FROM starts GROUP BY content_id ORDER BY sessions DESC, content_id LIMIT 20) AS s LEFT JOIN content AS c USING (content_id)",
    "content_metadata": f"SELECT content_id, title, video_type, category, show_name, {t('m', 'scheduled_end_minute')}, CASE WHEN m IS NULL THEN 0 ELSE 1 END AS end_is_estimated FROM content LEFT JOIN (SELECT content_id, max(minute) AS m FROM deltas WHERE delta_sessions < 0 GROUP BY content_id) USING (content_id) WHERE content_id = 49",
    "health_signals": f"SELECT content_id, round(count(*) FILTER (WHERE event_type = 'VideoError') / count(*), 6) AS error_rate, round(count(*) FILTER (WHERE event_type = 'VideoHeartbeat' AND event = 'BufferStart') / count(*), 6) AS buffer_rate, count(*) AS total_events FROM ev WHERE event_ms >= {LO_MS} AND event_ms < {HI_MS} GROUP BY content_id",
    "billable_impressions": _bill,
    "billing_reconciliation": f"SELECT advertiser_id, impressions AS served, impressions AS recomputed, round(100.0 * 0 / greatest(impressions, 1), 4) AS drift_pct FROM ({_bill})",
    "advertiser_content": "SELECT advertiser_id, count(DISTINCT content_id) AS contents, min(content_id) AS first_content, max(content_id) AS last_content FROM advertisers GROUP BY advertiser_id",
    # audience
    "dataset_counts": f"SELECT count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users, count(DISTINCT content_id) AS contents, {ms('min(event_ms)', 'first_ts')}, {ms('max(event_ms)', 'last_ts')} FROM ev",
    "events_by_date": f"SELECT {t('event_ms // 60000 // 1440 * 1440', 'bucket')}, count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL",
    "events_by_hour": f"SELECT {t('event_ms // 60000 // 60 * 60', 'bucket')}, count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL",
    "naive_minute_concurrency": f"SELECT {t('minute')}, naive FROM (SELECT * FROM {_naive} ORDER BY naive DESC, minute LIMIT 10)",
    "event_breakdown": "SELECT event_type, event, count(*) AS events, count(DISTINCT session) AS sessions FROM ev GROUP BY ALL",
    "session_duration_quantiles": f"SELECT {quantile_columns('x')}, {ends('x')} FROM (SELECT (max(event_ms) - min(event_ms)) / 1000 AS x FROM ev GROUP BY session)",
    "events_per_session_quantiles": f"SELECT {quantile_columns('x')}, {ends('x')} FROM (SELECT count(*) AS x FROM ev GROUP BY session)",
    "session_content_cardinality": "SELECT contents, count(*) AS sessions FROM (SELECT count(DISTINCT content_id) AS contents FROM ev GROUP BY session) GROUP BY contents",
    "open_sessions": f"SELECT session, {ms('max(event_ms)', 'last_ts')}, count(*) AS events FROM ev WHERE session NOT IN (SELECT session FROM ev WHERE event_type = 'VideoSessionEnd') GROUP BY session",
    "heartbeat_gap_quantiles": f"SELECT event, {quantile_columns('g')}, {ends('g')} FROM {_gap(f'(SELECT * FROM tl WHERE event IN {KEEP})', 'session, event', 'event_ms, event_id')} WHERE g IS NOT NULL GROUP BY event",
    "event_gap_quantiles": f"SELECT {quantile_columns('gap_s')}, {ends('gap_s')} FROM ({GAPS}) WHERE gap_s IS NOT NULL",
    "gap_histogram": f"SELECT {_cap} AS bin, count(*) AS gaps FROM ({GAPS}) WHERE gap_s IS NOT NULL GROUP BY ALL",
    "background_durations": f"SELECT {quantile_columns('gap_s')}, {ends('gap_s')} FROM " + until_next("signal IN ('BG', 'FG')", "signal = 'BG'") + " WHERE next_signal = 'FG'",
    "after_background": "SELECT coalesce(next_signal, 'none') AS next_signal, count(*) AS n, round(avg(gap_s), 4) AS mean_s FROM " + until_next("signal <> 'HB'", "signal = 'BG'") + " GROUP BY ALL",
    "pause_durations": f"SELECT {quantile_columns('gap_s')}, {ends('gap_s')} FROM " + until_next("signal IN ('PAUSE', 'RESUME')", "signal = 'PAUSE'") + " WHERE next_signal = 'RESUME'",
    "buffer_durations": f"SELECT {quantile_columns('gap_s')}, {ends('gap_s')} FROM " + until_next("event IN ('BufferStart', 'BufferEnd')", "event = 'BufferStart'") + " WHERE next_event = 'BufferEnd'",
    "startup_latency": f"SELECT platform, {quantile_columns('g', (0.5, 0.9, 0.99))}, {ends('g')} FROM (SELECT p.platform, (min(p.event_ms) - min(s.a)) / 1000 AS g FROM tl AS p JOIN (SELECT session, min(event_ms) AS a FROM tl WHERE signal = 'START' GROUP BY session) AS s ON s.session = p.session AND p.event_ms >= s.a WHERE p.signal = 'PLAY' GROUP BY p.session, p.platform) GROUP BY platform",
    "qoe_by_platform": "SELECT platform, count(DISTINCT session) AS sessions, round(count(*) FILTER (WHERE event = 'BufferStart') / count(DISTINCT session), 6) AS buffers_per_session, round(count(*) FILTER (WHERE event = 'downshift') / count(DISTINCT session), 6) AS downshifts_per_session, round(count(*) FILTER (WHERE event = 'dropped-frames') / count(DISTINCT session), 6) AS dropped_frames_per_session, round(count(*) FILTER (WHERE event_type = 'VideoError') / count(*), 6) AS error_rate FROM ev GROUP BY platform",
    "error_outcomes": "SELECT ended, recovered, went_on, count(*) AS sessions FROM (SELECT session, max(CASE WHEN signal = 'END' THEN 1 ELSE 0 END) AS ended, max(CASE WHEN event_ms > err AND signal IN ('PLAY', 'RESUME', 'FG') THEN 1 ELSE 0 END) AS recovered, max(CASE WHEN event_ms > err THEN 1 ELSE 0 END) AS went_on FROM tl JOIN (SELECT session, max(event_ms) AS err FROM tl WHERE signal = 'ERR' GROUP BY session) USING (session) GROUP BY session) GROUP BY ALL",
    "breakdown_by": " UNION ALL ".join(f"SELECT {d} AS value, count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users, '{d}' AS dimension FROM ev GROUP BY {d}" for d in DIMS_FOR_BREAKDOWN),
    "engagement_by_video_type": f"SELECT video_type, count(*) AS sessions, round(avg(duration_s), 4) AS mean_duration_s, round(avg(bg), 6) AS bg_per_session, round(sum(pauses) * 60 / greatest(sum(duration_s), 1.0), 6) AS pauses_per_minute FROM {_typed_sessions} GROUP BY video_type",
    "duration_by_type_platform": f"SELECT video_type, platform, count(*) AS sessions, round(avg(duration_s), 4) AS mean_duration_s FROM {_typed_sessions} GROUP BY ALL",
    "session_patterns": "SELECT CASE WHEN ms < 60000 THEN 'bounced' WHEN bg > 0 AND pause > 0 THEN 'mixed' WHEN bg > 0 THEN 'background_only' WHEN pause > 0 THEN 'pause_only' ELSE 'uninterrupted' END AS pattern, count(*) AS sessions FROM (SELECT max(event_ms) - min(event_ms) AS ms, count(*) FILTER (WHERE signal = 'BG') AS bg, count(*) FILTER (WHERE signal = 'PAUSE') AS pause FROM tl GROUP BY session) GROUP BY ALL",
    "fg_vs_naive": f"SELECT {t('minute')}, concurrency, coalesce(naive, 0) AS naive, round(coalesce(naive, 0) / nullif(concurrency, 0), 6) AS overcount, round(max(coalesce(naive, 0)) OVER () / nullif(max(concurrency) OVER (), 0), 6) AS peak_overcount, round(sum(coalesce(naive, 0)) OVER () / nullif(sum(concurrency) OVER (), 0), 6) AS mean_overcount FROM curve LEFT JOIN {_naive} USING (minute)",
    "fg_share_at_minute": f"SELECT * FROM (SELECT platform, sum(p)::BIGINT AS present, sum(a)::BIGINT AS active FROM (SELECT platform, count(DISTINCT session) AS p, 0 AS a FROM ev WHERE event_ms // 60000 = {W0 + 30} GROUP BY platform UNION ALL SELECT platform, 0, count(*) FROM mins WHERE minute = {W0 + 30} GROUP BY platform) GROUP BY platform) LEFT JOIN (SELECT platform, content_id AS top_content FROM (SELECT platform, content_id, count(*) AS n FROM mins WHERE minute = {W0 + 30} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, content_id) = 1) USING (platform)",
    "heavy_users": "SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS events, (max(event_ms) - min(event_ms)) / 1000 AS span_s FROM ev GROUP BY user_id HAVING count(DISTINCT session) > 20",
    "sessions_per_user": "SELECT sessions, count(*) AS users FROM (SELECT count(DISTINCT session) AS sessions FROM ev GROUP BY user_id) GROUP BY sessions",
    "overlapping_session_pairs": "SELECT user_id, count(*) AS pairs FROM (SELECT a.user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session) AS i FROM spans) AS a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session) AS i FROM spans) AS b ON a.user_id = b.user_id AND a.i < b.i AND a.first_ms <= b.last_ms AND b.first_ms <= a.last_ms) GROUP BY user_id",
    "multi_platform_users": "SELECT platforms, count(DISTINCT user_id) AS users, count(*) AS minutes FROM (SELECT user_id, event_ms // 60000 AS m, string_agg(DISTINCT platform, '+' ORDER BY platform) AS platforms FROM ev GROUP BY ALL HAVING count(DISTINCT platform) > 1) GROUP BY platforms",
    "late_after_end": "SELECT event_type, event, count(*) AS events, count(DISTINCT session) AS sessions, round(avg((event_ms - e) / 1000), 4) AS mean_delay_s FROM tl JOIN (SELECT session, min(event_ms) AS e FROM tl WHERE signal = 'END' GROUP BY session) USING (session) WHERE event_ms > e GROUP BY ALL",
    "same_ms_ties": "SELECT count(*) AS ties, coalesce(sum(n), 0)::BIGINT AS events, count(*) FILTER (WHERE s > 1) AS differing FROM (SELECT count(*) AS n, count(DISTINCT signal) AS s FROM tl GROUP BY session, event_ms HAVING count(*) > 1)",
    "redundant_transitions": f"SELECT before, signal, count(*) AS n FROM (SELECT signal, o, lag(signal) OVER {ORDW} AS before, lag(o) OVER {ORDW} AS was FROM (SELECT *, CASE WHEN signal IN ('PLAY', 'RESUME', 'FG') THEN 1 ELSE 0 END AS o FROM tl WHERE signal IN ('PLAY', 'RESUME', 'PAUSE', 'BG', 'FG'))) WHERE was = o GROUP BY ALL",
    "lifecycle_completeness": f"SELECT has_start, has_play, has_end, first_signal, last_signal, count(*) AS sessions FROM (SELECT session, max(CASE WHEN signal = 'START' THEN 1 ELSE 0 END) AS has_start, max(CASE WHEN signal = 'PLAY' THEN 1 ELSE 0 END) AS has_play, max(CASE WHEN signal = 'END' THEN 1 ELSE 0 END) AS has_end, first(signal ORDER BY {ORD}) AS first_signal, last(signal ORDER BY {ORD}) AS last_signal FROM tl GROUP BY session) GROUP BY ALL",
    "dimension_cardinality": " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(DISTINCT {d}) AS values FROM ev" for d in PROFILED),
    "dimension_completeness": " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(count(*) FILTER (WHERE lower({d}) NOT IN ('', 'unknown', 'unk', 'off')) / count(*), 6) AS share FROM ev" for d in PROFILED),
    "dimension_drift": " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(*) AS sessions FROM (SELECT 1 FROM ev GROUP BY session HAVING count(DISTINCT {d}) > 1)" for d in ("platform", "country", "video_resolution", "content_id", "user_id")),
    "bg_fg_balance": "SELECT b AS bg_minus_fg, r AS resumes_minus_pauses, count(*) AS sessions FROM (SELECT count(*) FILTER (WHERE signal = 'BG') - count(*) FILTER (WHERE signal = 'FG') AS b, count(*) FILTER (WHERE signal = 'RESUME') - count(*) FILTER (WHERE signal = 'PAUSE') AS r FROM tl GROUP BY session) GROUP BY ALL",
    "liveness_family_coverage": " UNION ALL ".join(f"SELECT '{k}' AS family, count(DISTINCT CASE WHEN event = '{k}' THEN session END) AS sessions FROM ev" for k in ("buffer-health", "video-resize", "network-bandwidth", "network-activity")) + f" UNION ALL SELECT 'any', count(DISTINCT CASE WHEN event IN {KEEP} THEN session END) FROM ev UNION ALL SELECT 'all', count(DISTINCT session) FROM ev",
    "background_signal_share": "SELECT event, count(*) AS n, round(count(*) FILTER (WHERE fg = 0) / count(*), 6) AS background_share FROM st WHERE event_type = 'VideoHeartbeat' GROUP BY event",
    "dim_join_coverage": "SELECT (SELECT count(DISTINCT content_id) FROM ev) AS watched_contents, count(DISTINCT content_id) AS missing_contents, count(*) AS missing_events FROM ev WHERE content_id NOT IN (SELECT content_id FROM content)",
    "peak_minute_shift": " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, peak, {t('m', 'peak_minute')}, m - (SELECT m FROM (SELECT {PEAK} FROM curve)) AS shift_minutes FROM (SELECT {d}, {PEAK} FROM {sliced_curve(d)} GROUP BY {d})" for d in ("platform", "video_type")),
    "heartbeat_write_amplification": "SELECT count(*) AS steps, count(*) FILTER (WHERE m = 0) AS stayed, count(*) FILTER (WHERE m = 1) AS advanced, round(count(*) FILTER (WHERE m = 0) / count(*), 6) AS same_share FROM (SELECT event_ms // 60000 - lag(event_ms // 60000) OVER " + ORDW + " AS m FROM tl) WHERE m IS NOT NULL",
    "heartbeat_taxonomy": f"SELECT class, event, count(*) AS n, round((quantile_cont(g, 0.75) - quantile_cont(g, 0.25)) / nullif(quantile_cont(g, 0.5), 0), 4) AS iqr_over_median, round(avg(CASE WHEN fg = 0 THEN 1 ELSE 0 END), 6) AS background_share FROM (SELECT *, CASE WHEN signal IN ('PAUSE', 'RESUME') THEN 'STATE' WHEN lower(event) LIKE 'download%' THEN 'DOWNLOAD' WHEN lower(event) LIKE 'ad%' THEN 'AD' WHEN event IN {KEEP} THEN 'KEEPALIVE' WHEN event IN ('BufferStart', 'BufferEnd', 'downshift', 'upshift', 'dropped-frames', 'network-change', 'speed-change', 'video_quality_change') THEN 'QUALITY' ELSE 'UX' END AS class FROM " + _gap("(SELECT * FROM st WHERE event_type = 'VideoHeartbeat')", "session, event", "event_ms, event_id") + ") GROUP BY ALL",
    "opening_closing_signatures": f"SELECT signature, count(*) AS sessions, 'opening' AS side FROM (SELECT string_agg(signal, '>' ORDER BY n) AS signature FROM (SELECT session, signal, row_number() OVER {ORDW} AS n FROM tl) WHERE n <= 4 GROUP BY session) GROUP BY signature UNION ALL SELECT signature, count(*), 'closing' FROM (SELECT string_agg(signal, '>' ORDER BY n DESC) AS signature FROM (SELECT session, signal, row_number() OVER (PARTITION BY session ORDER BY event_ms DESC, tie_break DESC, event_id DESC) AS n FROM tl) WHERE n <= 4 GROUP BY session) GROUP BY signature",
    "signal_trigrams": f"SELECT signal || '>' || b || '>' || c AS trigram, count(*) AS n FROM (SELECT signal, lead(signal, 1) OVER {ORDW} AS b, lead(signal, 2) OVER {ORDW} AS c FROM tl WHERE signal <> 'HB') WHERE c IS NOT NULL GROUP BY ALL",
    "exclusion_reasons": f"""SELECT CASE WHEN r = '' THEN 'active' ELSE r END AS reason, count(*) AS segments, round(sum(ms) / 3600000, 4) AS hours FROM (SELECT concat_ws('+', CASE WHEN fg = 0 THEN 'background' END, CASE WHEN playing = 0 THEN 'paused' END, CASE WHEN stale = 1 THEN 'stale' END) AS r, ms FROM (
      SELECT fg, playing, unnest([0, 1]) AS stale, unnest([least(gap, 90000), greatest(gap - 90000, 0)]) AS ms FROM (SELECT *, lead(event_ms) OVER {ORDW} - event_ms AS gap FROM st) WHERE gap IS NOT NULL AND ended = 0) WHERE ms > 0 OR stale = 0) GROUP BY ALL""",
    "session_archetypes": f"""SELECT archetype, count(*) AS sessions, round(sum(wall), 4) AS wall_hours, round(sum(coalesce(active, 0)), 4) AS active_hours, round(sum(coalesce(active, 0)) / nullif(sum(wall), 0), 4) AS retained, round(avg(coalesce(n, 0)), 4) AS mean_intervals FROM (
      SELECT session, wall, CASE WHEN wall > 6 THEN 'marathon' WHEN err = 1 THEN 'errored' WHEN last_fg = 0 THEN 'ended_backgrounded' WHEN bg >= 2 THEN 'multi_excursion' WHEN bg = 1 THEN 'single_excursion' ELSE 'never_backgrounded' END AS archetype FROM (
        SELECT session, (max(event_ms) - min(event_ms)) / 3600000 AS wall, count(*) FILTER (WHERE signal = 'BG') AS bg, max(CASE WHEN signal = 'ERR' THEN 1 ELSE 0 END) AS err, last(fg ORDER BY {ORD}) AS last_fg FROM st GROUP BY session))
      LEFT JOIN (SELECT session, sum(end_ms - start_ms) / 3600000 AS active, count(*) AS n FROM iv GROUP BY session) USING (session) GROUP BY archetype""",
    "state_paths": f"SELECT length, opening, sessions, round(sessions / sum(sessions) OVER (), 6) AS share FROM (SELECT path, array_to_string(string_split(path, '>')[1:8], '>') AS opening, length, count(*) AS sessions FROM (SELECT string_agg(signal, '>' ORDER BY {ORD}) AS path, count(*) AS length FROM tl WHERE signal <> 'HB' GROUP BY session) GROUP BY ALL)",
    "contradictory_transitions": f"SELECT before, signal, count(*) AS n, count(DISTINCT session) AS sessions FROM (SELECT session, signal, lag(signal) OVER {ORDW} AS before FROM tl WHERE signal <> 'HB') WHERE before = signal OR before = 'END' GROUP BY ALL",
    "ux_while_background": "SELECT signal, event, count(*) AS events, count(DISTINCT session) AS sessions FROM st WHERE fg = 0 AND signal IN ('PLAY', 'PAUSE', 'RESUME') GROUP BY ALL",
    "phantom_share_by": "SELECT platform, naive_hours, active_hours, naive_peak, coalesce(active_peak, 0) AS active_peak, round((naive_hours - active_hours) / nullif(naive_hours, 0), 4) AS phantom_share FROM (SELECT platform, round(sum(w) / 3600000.0, 4) AS naive_hours FROM (SELECT platform, last_ms - first_ms AS w FROM spans) GROUP BY platform) LEFT JOIN (SELECT platform, round(sum(end_ms - start_ms) / 3600000.0, 4) AS active_hours FROM iv GROUP BY platform) USING (platform) LEFT JOIN (SELECT platform, max(n) AS naive_peak FROM (SELECT platform, minute, count(*) AS n FROM (SELECT platform, unnest(range(first_minute, close_minute)) AS minute FROM spans) GROUP BY ALL) GROUP BY platform) USING (platform) LEFT JOIN (SELECT platform, max(n) AS active_peak FROM (SELECT platform, minute, count(*) AS n FROM mins GROUP BY ALL) GROUP BY platform) USING (platform)",
    "without_heavy_users": f"SELECT {t('minute', 'bucket')}, concurrency FROM " + filtered_curve("user_id NOT IN (SELECT user_id FROM ev GROUP BY user_id HAVING count(DISTINCT session) > 14)"),
    "data_checks": " UNION ALL ".join(CHECKS),
    # incremental
    "live_from_state": f"SELECT {K} FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_ms DESC, tie_break DESC, event_id DESC) AS back FROM st WHERE event_ms <= {MARK_MS}) WHERE back = 1 AND fg = 1 AND playing = 1 AND ended = 0 AND event_ms >= {MARK_MS} - 90000",
    "finality_by_watermark": f"SELECT {t('minute')}, concurrency, CASE WHEN (minute + 1) * 60000 <= (SELECT max(event_ms) FROM ev WHERE event_ms <= {MARK_MS}) THEN 'final' ELSE 'provisional' END AS finality FROM curve",
    "live_now": f"SELECT {K} FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_ms DESC, tie_break DESC, event_id DESC) AS back FROM st WHERE event_ms <= {MARK_MS}) WHERE back = 1 AND fg = 1 AND playing = 1 AND ended = 0 AND event_ms >= {MARK_MS} - 90000",
    "label_finality": f"SELECT {t('minute')}, concurrency, CASE WHEN minute > {W0 + 30} THEN 'provisional' ELSE 'final' END AS finality FROM curve",
    "ingest_lag": "SELECT max(ingest_ms - event_ms) / 1000 AS max_lag_s, round(avg(ingest_ms - event_ms) / 1000, 4) AS mean_lag_s, count(*) FILTER (WHERE ingest_ms - event_ms > 60000) AS over_60s, " f"({MARK_MS} - max(ingest_ms) FILTER (WHERE ingest_ms <= {MARK_MS})) / 1000 AS cursor_lag_s, {MARK_MS} - max(ingest_ms) FILTER (WHERE ingest_ms <= {MARK_MS}) > 60000 AS cursor_alert FROM ev",
    "late_event_policy": "SELECT (SELECT count(*) FROM tl) AS kept_for_recompute, (SELECT count(*) FROM st WHERE ended > 0 AND signal <> 'END') AS after_end",
    "retract_and_refold": f"SELECT {K}, {t('minute')}, a::BIGINT AS delta_sessions FROM act_d",
    "corrected_fold": f"SELECT {K}, {t('minute')}, a::BIGINT AS delta_sessions FROM act_d",
    "advance_checkpoint": f"SELECT {ms('max(ingest_ms)', 'checkpoint_ts')} FROM ev WHERE ingest_ms <= {MARK_MS} - 5000",
    "recompute_changed": f"SELECT {K}, {t('minute')}, delta_sessions, delta_open FROM deltas",
    "session_fold": f"SELECT {K}, {t('run_start')}, {t('run_end')} FROM runs",
    "presence_per_minute_stream": f"SELECT {t('event_ms // 60000', 'minute')}, platform, count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM {_present} GROUP BY ALL",
    "presence_rollup": f"SELECT {t('event_ms // 3600000 * 60', 'bucket')}, platform, count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT user_id) AS users FROM {_present} GROUP BY ALL",
    "stats_rollup": f"SELECT * FROM ({_rolled(60)}) JOIN (SELECT {t('minute // 60 * 60', 'bucket')}, {SLICE}, count(DISTINCT CASE WHEN a = 1 THEN user_id END) AS active_users, count(DISTINCT CASE WHEN a = 0 THEN user_id END) AS open_users FROM {_presence} GROUP BY ALL) USING (bucket, {SLICE})",
}

ORACLE_SQL = {name: PREFIX + body.replace("round(", "round(1e-9 + ") for name, body in BODIES.items()}

#: Questions about no given range, asked of the whole history too, under the name with ``_whole``.
WHOLE = ("peak_summary", "peak_by_platform", "peak_by_country", "peak_by_video_type", "peak_minute_shift", "local_peaks", "hour_anchors", "hourly_summary", "decline_alert", "phantom_audience", "fg_vs_naive", "traffic_day")


def over_history(sql: str) -> str:
    """The same SQL with the axis from the first to the last delta minute."""
    axis = "SELECT unnest(range(lo, hi + 1))::BIGINT AS minute FROM (SELECT min(minute) AS lo, max(minute) AS hi FROM deltas)"
    return sql.replace(f"SELECT unnest(range({W0}, {W1}))::BIGINT AS minute", axis).replace(f" AND minute >= {W0} AND minute < {W1}", "").replace(f" WHERE minute < {W1}", "")


ORACLE_SQL |= {f"{name}_whole": over_history(ORACLE_SQL[name]) for name in WHOLE if name in ORACLE_SQL}
