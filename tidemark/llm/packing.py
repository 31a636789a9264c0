"""Packing along a space-filling curve.

Every document's ids are counted into hashed buckets, the unit vector is projected to three dimensions, and the point's
Hilbert index orders the corpus so that neighbours on the curve are alike.  A distributed prefix sum of token counts in
that order gives each document its place in one long token line, which is cut every ``length`` tokens; only the last
sequence needs padding.

Texts are tokenized once, into a table in the shared folder.  The range sort and the prefix sums move a few numbers a
document; the ids are shuffled once, when they meet their document's place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, regrouped, small_batches
from .sharding import prefix_sums
from .tokens import coded_words

BUCKETS, DIMENSIONS, BITS = 64, 3, 10
END_ID = 1
_PROJECTION = np.random.RandomState(7).normal(size=(BUCKETS, DIMENSIONS))
_TOKENS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("curve", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (n, d) with ``bits`` bits a coordinate, by Skilling's transform."""
    x = points.T.astype(np.int64).copy()
    d = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as id arrays."""
    counts = np.zeros((len(documents), BUCKETS))
    for row, ids in zip(counts, documents, strict=True):
        row += np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26), minlength=BUCKETS)
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    spread = 1 / (1 + np.exp(-2.0 * (counts @ _PROJECTION)))
    return hilbert_index(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in regrouped(batches, "text", 4 << 20):
            coded, ends = coded_words(batch.column("text"), path)
            ids = np.split(np.insert(coded, ends, END_ID), ends + np.arange(1, len(ends) + 1))[:-1]
            columns = [pa.array(np.arange(row, row + len(ids))), batch.column("doc_id"), pa.array(curve_keys(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ids"):
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for doc, before, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "before", "n", "ids")), strict=True):
                ids = np.frombuffer(data, "<u2").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(before + at, length)
                    size = min(n - at, length - offset)
                    piece = ids[at : at + size].tobytes()
                    for name, value in zip(out, (doc, at, size, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        out[name].append(value)
                    at += size
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    return run


def pack(docs: DataFrame, path: str, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit.  Every document ends with id 1, so a null or empty text is that id alone;
    ties on the curve are ordered by a hash of the id and the row's place in its file; repeated rows are packed each; an
    empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = durable(rows.mapInArrow(_tokenize(path), "row long, doc_id long, curve long, n long, ids binary"))
    order = ["curve", "tie", "row"]
    slim = tokens.select("row", "curve", "n", F.xxhash64("doc_id").alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    places = prefix_sums(ranged, part="part", order=order, measure="n").select("row", "before")
    placed = tokens.select("row", "doc_id", "n", "ids").join(places.hint("shuffle_hash"), "row").select("doc_id", "before", "n", "ids")
    return placed.mapInArrow(_cut(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
