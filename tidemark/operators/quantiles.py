"""Exact interpolated quantiles whose memory does not grow with the number of distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET = 64  # width of a bucket in units of the value


def joined(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined to ``b`` where ``by`` is equal or null in both; without ``by`` both have one row."""
    if not by:
        return a.join(b)
    other = b.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return a.join(other, same, how).drop(*[f"_{c}" for c in by])


def exact_quantiles(rows: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n`` (values that aren't null), the ``least`` and ``most``, and ``p50`` and the like for each of ``at``.

    Values are counted, then their counts by buckets of ``BUCKET`` units; these tell which bucket holds each wanted rank, and
    only the values of such buckets are put in order.  So a task orders one row for each occupied bucket of a group, or the
    distinct values of one bucket.  A group without values has no row; without ``by`` there is always one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_bucket", F.floor(F.col("_v") / BUCKET))
    held = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ends = held.groupBy(*by).agg(F.coalesce(F.sum("_in"), F.lit(0)).alias("n"), F.min("_low").alias("least"), F.max("_high").alias("most"))

    def place(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_total") - 1)

    def spans(low: Column, high: Column) -> list[tuple[Column, Column]]:
        """For each of ``at``: whether ranks low to high - 1 hold the rank below its place, and the one above."""
        return [tuple((low <= side(place(q))) & (side(place(q)) < high) for side in (F.floor, F.ceil)) for q in at]

    in_order = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    placed = held.withColumns({"_before": F.sum("_in").over(in_order) - F.col("_in"), "_total": F.sum("_in").over(W.partitionBy(*by))})
    hit = reduce(lambda x, y: x | y, [c for pair in spans(F.col("_before"), F.col("_before") + F.col("_in")) for c in pair])
    wanted = placed.where(hit).select(*by, "_bucket", "_before", "_total")
    inside = W.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    fine = joined(counts, wanted, [*by, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    found = []
    for q, (below, above) in zip(at, spans(F.col("_upto") - F.col("_n"), F.col("_upto")), strict=True):
        low, high, part = F.max(F.when(below, F.col("_v"))), F.max(F.when(above, F.col("_v"))), F.max(place(q) - F.floor(place(q)))
        found.append((low + (high - low) * part).alias(f"p{round(q * 100)}"))
    return joined(ends, fine.groupBy(*by).agg(*found), by)
