"""Contiguous shards of near equal byte size from global prefix sums.

Documents stand in ``doc_id`` order.  They are range-partitioned, each partition sums its bytes and rows, a running sum
over those per-partition totals gives every partition its global offset, and each document's place is cut at equal
targets.  Only ``(doc_id, size, crc32)`` is shuffled, never a text, and no step orders the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import durable


def prefix_sums(rows: DataFrame, *, part: str, order: list[str], measure: str) -> DataFrame:
    """Add ``before`` (sum of ``measure`` in all earlier rows) and ``row_before`` (their number), exact and distributed.

    ``part`` numbers contiguous parts of the order.  The window over parts holds one row for each part.
    """
    totals = rows.groupBy(part).agg(F.sum(measure).alias("part_sum"), F.count("*").alias("part_rows"))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum("part_sum").over(earlier), F.lit(0)).alias("sum_base"), F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("row_base"))
    inside = W.partitionBy(part).orderBy(*order)
    local = rows.select("*", (F.sum(measure).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(measure)).alias("_sum"), (F.row_number().over(inside) - 1).alias("_row"))
    joined = local.join(offsets, part)
    return joined.select(*rows.columns, (F.col("_sum") + F.col("sum_base")).alias("before"), (F.col("_row") + F.col("row_base")).alias("row_before"))


def balanced_shards(docs: DataFrame, *, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Put every row into one of ``n_shards`` contiguous shards whose byte sizes differ by no more than one document.

    A document's size is its UTF-8 bytes (null: none) plus 1.  It goes to the shard in whose equal byte range its middle
    lies.  Returns ``doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)``; ``slot`` counts from 0
    without gaps inside a shard.

    Null ids come first in the order; equal ids are ordered by size and checksum; a null text is empty (size 1,
    checksum 0); a text larger than a shard's share leaves a neighbouring shard short or empty; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "size", "text_crc32"]
    ranged = durable(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    placed = prefix_sums(ranged, part="part", order=order, measure="size")
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total"))
    cut = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"cast((before * 2 + size) * {n_shards} div (total * 2) AS int)")))
    starts = cut.groupBy("shard").agg(F.min("row_before").alias("first_row"))  # one row for each shard
    return cut.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_before") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The reflected CRC-32 polynomial's byte table is built in SQL from the bit rule.
ORACLE_SQL = """
WITH RECURSIVE step(n, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE i < 8),
bytes AS (SELECT list(v ORDER BY n) AS t FROM step WHERE i = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, (strlen(text) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INTEGER])), 4294967295)::BIGINT AS text_crc32
  FROM d, bytes),
placed AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM sized
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least(15, ((before * 2 + size) * 16) // (total * 2))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
