"""The stored tables that read queries start from: deltas, hour anchors, slice members and session spans, by day.

A reader of [start, end) takes the anchors of the hour that ``start`` lies in and the deltas from that hour on, so it reads
the days of its range only, whatever history lies before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, MINUTE_MS
from ..operators.rollups import ANCHOR_SLICE, slice_anchors, slice_members
from .shared import stored


class DeltaStore:
    """Built once a session for as long as the ``inputs`` (paths) stay as they are; ``deltas`` and ``spans`` give the frames
    to store."""

    def __init__(self, spark: SparkSession, inputs: Sequence[str], deltas: Callable[[], DataFrame], spans: Callable[[], DataFrame]):
        self.spark, self.inputs, self._deltas, self._spans = spark, list(inputs), deltas, spans

    @cached_property
    def by_day(self) -> DataFrame:
        """The current deltas with their ``part_day``, sorted by minute in each file."""
        return stored(self.spark, "deltas", self.inputs, self._deltas, f"minute div {DAY}", ["minute"])

    @cached_property
    def anchors(self) -> DataFrame:
        return stored(self.spark, "anchors", self.inputs, lambda: slice_anchors(self.by_day), f"hour div {DAY}", ["hour"])

    @cached_property
    def members(self) -> DataFrame:
        return stored(self.spark, "members", self.inputs, lambda: slice_members(self.by_day), "0", ["dimension"])

    @cached_property
    def spans(self) -> DataFrame:
        """``session, first_ms, last_ms`` by the day on which the session starts."""
        return stored(self.spark, "spans", self.inputs, self._spans, f"first_ms div {DAY * MINUTE_MS}", ["first_ms"])

    def near(self, start: int, end: int, dim: str | None = None) -> DataFrame:
        """Deltas whose running sums in [start, end) are those of the whole history: the levels before the hour of ``start``,
        dated to its last minute, and the deltas from then on.  With ``dim`` every value of it that was ever seen before ``end``
        has a row, be it 0."""
        hour = start // HOUR * HOUR
        values = ["delta_sessions", "delta_open"]
        columns = [c for c in self.by_day.columns if c != "part_day"]
        later = self.by_day.where(F.col("part_day").between(hour // DAY, (end - 1) // DAY) & (F.col("minute") >= hour) & (F.col("minute") < end)).select(*columns)
        level = self.anchors.where((F.col("part_day") == hour // DAY) & (F.col("hour") == hour)).select(*ANCHOR_SLICE, F.lit(hour - 1).cast("long").alias("minute"), *values)
        out = later.unionByName(level, allowMissingColumns=True)
        if dim:
            kind = self.by_day.schema[dim].dataType
            seen = self.members.where((F.col("dimension") == dim) & (F.col("first_minute") < end))
            none = seen.select(F.col("value").cast(kind).alias(dim), F.lit(hour - 1).cast("long").alias("minute"), *[F.lit(0).cast("long").alias(v) for v in values])
            out = out.unionByName(none, allowMissingColumns=True)
        return out

    def spans_between(self, start: int, end: int) -> DataFrame:
        """Sessions that start in [start, end)."""
        days = F.col("part_day").between(start // DAY, (end - 1) // DAY)
        return self.spans.where(days & (F.col("first_ms") >= start * MINUTE_MS) & (F.col("first_ms") < end * MINUTE_MS)).drop("part_day")
