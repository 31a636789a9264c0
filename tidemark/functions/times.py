"""Time columns.  Inside the engine an instant is epoch milliseconds and a minute is whole minutes since the epoch (both
UTC longs), so that all interval arithmetic is exact integer arithmetic; results show ``TIMESTAMP_NTZ``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR, DAY = 60, 1440


def div(column: Column | str, by: int) -> Column:
    """Whole division of longs."""
    return F.call_function("div", F.col(column) if isinstance(column, str) else column, F.lit(by))


def minute_of(ms: Column | str) -> Column:
    return div(ms, MINUTE_MS)


def minute_ts(minute: Column | str) -> Column:
    """Epoch minutes -> TIMESTAMP_NTZ, whatever the session's time zone."""
    c = F.col(minute) if isinstance(minute, str) else minute
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), c.cast("int"))


def ms_ts(ms: Column | str) -> Column:
    """Epoch milliseconds -> TIMESTAMP_NTZ."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c.cast("decimal(24,6)") / 1000).cast("decimal(18,6)"))


def shown(df: DataFrame) -> DataFrame:
    """``df`` with its engine time columns (names ending in ``minute``, ``run_start``, ``run_end``, ``bucket`` or ``_ms``)
    as timestamps, ``_ms`` becoming ``_ts``."""
    out = []
    for c, kind in df.dtypes:
        if kind == "bigint" and (c.endswith("minute") or c in ("run_start", "run_end", "bucket", "hour", "day")):
            out.append(minute_ts(c).alias(c))
        elif kind == "bigint" and c.endswith("_ms") and not c.startswith("n_"):
            out.append(ms_ts(c).alias(c[:-3] + "_ts"))
        else:
            out.append(F.col(c))
    return df.select(*out)
