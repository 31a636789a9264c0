"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector becomes a binary code (bit i is 1 if component i is above zero).  The code is cut into ``m`` segments of about
log2(number of distinct codes) bits, and every segment value is an index key.  In round r each open query probes, in all
m indexes, the keys at Hamming distance exactly r from its own segment.  After round r every code within distance
``m * (r + 1) - 1`` has been met (pigeonhole), so a query is finished once its k-th distance is not above that bound.
A candidate is taken only by the first segment that attains its smallest segment distance, so it is met once, and only
if it is no farther than the query's k-th so far.

All steps are DataFrame joins, windows and aggregations; nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, log2
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import durable

OUT = "query_id long, rank int, vec_id long, distance int"


def _segment_bounds(bits: int, m: int) -> list[tuple[int, int]]:
    cuts = [bits * j // m for j in range(m + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _code_columns(vector: str, bounds: list[tuple[int, int]]) -> list[Column]:
    bit = lambda i, at: F.when(F.get(F.col(vector), F.lit(i)) > 0, F.lit(1 << at)).otherwise(F.lit(0))
    return [reduce(add, (bit(i, i - lo) for i in range(lo, hi))).cast("int").alias(f"c{j}") for j, (lo, hi) in enumerate(bounds)]


def _masks(width: int, weight: int) -> Column:
    """A folded constant array of all ``width``-bit masks with ``weight`` ones."""
    values = (sum(1 << i for i in ones) for ones in combinations(range(width), weight))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def exact_topk(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_when: Column | None = None, bits: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to every query row in Hamming distance of sign codes, ties to the smaller id.

    ``query_when`` chooses the query rows (default: id divisible by 20); all rows, the query itself included, are
    candidates.  Returns ``query_id, rank (from 1), vec_id, distance``.

    Rows with a null id or a null vector are neither queries nor candidates; null, absent and NaN-free non-positive
    components are 0 bits; an empty table gives an empty result; repeated rows each count; fewer than ``k`` rows give
    shorter answers; other columns of any name are ignored.
    """
    spark = vectors.sparkSession
    query = F.coalesce(query_when if query_when is not None else F.col(id_col) % 20 == 0, F.lit(False))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), query.alias("is_query"))
    size = rows.agg(F.max(F.size("v")).alias("d"), F.approx_count_distinct("v", 0.02).alias("n")).first()
    bits = bits or size["d"] or 0
    if not bits:
        return spark.createDataFrame([], OUT)
    m = max(1, ceil(bits / min(18, max(8, log2(size["n"] + 1)))))
    bounds = _segment_bounds(bits, m)
    code = [f"c{j}" for j in range(m)]
    rows = durable(rows.select("id", "is_query", *_code_columns("v", bounds)))

    # the k smallest ids of each code are enough for any answer; row_number <= k is limited before its shuffle
    held = rows.withColumn("n", F.row_number().over(W.partitionBy(*code).orderBy("id"))).where(F.col("n") <= k)
    codes = durable(held.groupBy(*code).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = durable(rows.where("is_query").select(*code).distinct().withColumn("q", F.concat_ws(".", *code)))
    index = codes.select(*code, F.concat_ws(".", *code).alias("code"), F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("copies")).select("*", F.posexplode(F.array(*code)).alias("segment", "key"))

    spread = lambda name: [F.col(c).alias(f"{name}{c}") for c in code]
    open_queries, best, radius = queries.select("q", *spread("q"), F.lit(bits).alias("limit")), None, 0
    while True:
        widths = {hi - lo for lo, hi in bounds}
        probes = [open_queries.select("*", F.lit(j).alias("segment"), F.explode(_masks(hi - lo, radius)).alias("mask")).withColumn("key", F.col("mask").bitwiseXOR(F.col(f"qc{j}"))).drop("mask") for j, (lo, hi) in enumerate(bounds) if radius <= hi - lo]
        near = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in code]
        first = reduce(lambda a, b: a & b, ((F.col("segment") <= i) | (d > radius) for i, d in enumerate(near))) & reduce(lambda a, b: a & b, (d >= radius for d in near))
        close = reduce(add, near) <= F.col("limit")  # farther than the k-th so far can't be an answer
        found = reduce(DataFrame.unionAll, probes).join(index.hint("shuffle_hash"), ["segment", "key"]).where(first & close).select("q", "code", "first_id", "copies", reduce(add, near).alias("distance"))
        every = found if best is None else best.select("q", "code", "first_id", "copies", "distance").unionAll(found)
        order = W.partitionBy("q").orderBy("distance", "first_id", "code")
        ranked = every.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
        best = durable(ranked.withColumn("have", F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, 0))))
        covered = m * (radius + 1) - 1
        kth = best.where(F.col("have") >= k).groupBy("q").agg(F.min("distance").alias("kth"))
        radius += 1
        if radius > max(widths):
            break
        still = open_queries.drop("limit").join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > covered))
        open_queries = durable(still.select("q", *(f"q{c}" for c in code), F.coalesce("kth", F.lit(bits)).alias("limit")))
        if open_queries.isEmpty():
            break

    answers = best.join(codes.select(F.concat_ws(".", *code).alias("code"), "ids"), "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    answers = answers.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    asked = rows.where("is_query").join(queries, code).select(F.col("id").alias("query_id"), "q")
    return asked.join(answers, "q").select("query_id", F.col("rank").cast(T.IntegerType()), "vec_id", F.col("distance").cast("int"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, len(list_filter(range(1, len(q.code) + 1), lambda i: q.code[i] <> v.code[i]))::INTEGER AS distance
  FROM v AS q JOIN v ON TRUE WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INTEGER AS rank, vec_id, distance FROM pairs) WHERE rank <= 10
"""
