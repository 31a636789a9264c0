"""Line deduplication with a sharded minimal perfect hash.

Every distinct line key has a 128-bit hash.  The hashes are dealt into shards of about ``SHARD_KEYS`` keys by their bits;
each shard becomes a minimal perfect hash (levels of bit arrays, ranked by their running popcount) that indexes three
compact arrays: a fingerprint, the number of documents (cut at 255) and the largest id.  The documents' hashes then travel
to the shards and probe the arrays; lines and texts don't travel, and no line is joined to a line.

A shard's array row comes first in its partition and its probes stream past it, so a task holds one shard.  Keys that make
up at least a 4096th of all lines (so at most 4096 of them) probe the arrays once each and their answers are broadcast, so
no shard is hot.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, durable, regrouped, strings

SHARD_KEYS = 1 << 16
HOT = 4096
SPACES = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a null id, smaller than any other
INDEX = "shard long, levels binary, prints binary, counts binary, last binary"


def key_of(line: bytes) -> bytes:
    """A line stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()  # lower() of bytes changes A-Z only


def is_long(key: bytes, length: int) -> bool:
    return len(key) >= length and (len(key) >= 4 * length or len(key.decode()) >= length)


def line_hashes(text: str, length: int) -> set[bytes]:
    """The 128-bit hashes of a text's distinct keys of at least ``length`` code points."""
    return {xxhash.xxh3_128_digest(k) for k in map(key_of, text.encode().split(b"\n")) if is_long(k, length)}


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash: in each level the keys that are alone in their bit stay, the others go on to the next."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        seen = 0
        for bits in levels:
            self.ranks.append(seen + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            seen += int(bits.sum())

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """Of distinct pairs (a, b)."""
        levels: list[np.ndarray] = []
        while len(a):
            size = max(64, int(gamma * len(a)))
            at = (_mix(a, b, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key, from 0 without gaps; a pair that isn't a key has some place, or -1."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(a[left], b[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, levels = 8 + 8 * n, []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels)


def prints_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a ^ (b * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _hash_lines(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, "text", 4 << 20):
            ids, texts, rows = batch.column("doc_id").to_pylist(), strings(batch, "text"), []
            for doc, key, text in zip(ids, batch.column("text_key").to_pylist(), texts, strict=True):
                rows += [(doc, key, h) for h in line_hashes(text or "", length)]
            both = np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(-1, 2)
            out = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text_key": pa.array([r[1] for r in rows], pa.int64()), "a": both[:, 0], "b": both[:, 1]})
            yield from out.to_batches(max_chunksize=50_000)

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of equal ``shard`` inside sorted batches."""
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi > lo:
                yield int(shard[lo]), batch.slice(lo, hi - lo)


def _index_row(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    a, b = _unsigned(rows, "a"), _unsigned(rows, "b")
    found = PerfectHash.build(a, b)
    order = np.argsort(found.index(a, b))
    counts = np.minimum(rows.column("n").to_numpy(), 255).astype(np.uint8)
    last = rows.column("last").to_numpy()
    values = {"shard": pa.array([shard], pa.int64()), "levels": [found.to_bytes()], "prints": [prints_of(a, b)[order].tobytes()], "counts": [counts[order].tobytes()], "last": [last[order].tobytes()]}
    return pa.RecordBatch.from_pydict(values, schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("levels", "prints", "counts", "last")]]))


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, parts = None, []
    for shard, rows in _by_shard(batches):
        if shard != now and parts:
            yield _index_row(now, parts)
            parts = []
        now = shard
        parts.append(rows)
    if parts:
        yield _index_row(now, parts)


def _probe(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for shard, rows in _by_shard(batches):
            if rows.column("levels")[0].is_valid:  # the shard's arrays come before its probes
                row = {c: rows.column(c)[0].as_py() for c in ("levels", "prints", "counts", "last")}
                now, found = shard, PerfectHash.from_bytes(row["levels"])
                prints, counts, last = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["last"], np.int64)
                rows = rows.slice(1)
            if now != shard or not rows.num_rows:
                continue
            a, b = _unsigned(rows, "a"), _unsigned(rows, "b")
            at = found.index(a, b)
            known = (at >= 0) & (prints[at] == prints_of(a, b)) & (counts[at] >= least)
            out = pa.table({**{c: rows.column(c) for c in ("doc_id", "text_key", "a", "b")}, "last": last[at]})
            yield from out.filter(pa.array(known)).to_batches()

    return run


def probe(index: DataFrame, asked: DataFrame, parts: int, least: int) -> DataFrame:
    """``asked(shard, doc_id, text_key, a, b)`` met with the arrays: the rows whose key has ``least`` documents, and its
    largest id as ``last``."""
    none = lambda names, kind: [F.lit(None).cast(kind).alias(c) for c in names]
    values = ["levels", "prints", "counts", "last"]
    rows = index.select("shard", *none(["doc_id", "text_key", "a", "b"], "long"), *values).unionByName(asked.select("*", *none(values, "binary")))
    met = rows.repartition(parts, "shard").sortWithinPartitions("shard", F.col("levels").isNull())
    return met.mapInArrow(_probe(least), "doc_id long, text_key long, a long, b long, last long")


def line_index(held: DataFrame, shards: int) -> DataFrame:
    """``held(shard, a, b, n, last)``, one row for each distinct hash -> one row of arrays for each shard (``INDEX``)."""
    return held.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_build_shards, INDEX)


@F.pandas_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]))
def drop_lines(texts: pd.Series, dropped: pd.Series, length: pd.Series) -> pd.DataFrame:
    """Cut the lines whose hashes are in ``dropped`` out of each text."""
    out = []
    for text, gone, size in zip(texts, dropped, length, strict=True):
        lines = (text or "").encode().split(b"\n")
        kept = lines
        if gone is not None and len(gone):
            bad = set(gone)
            kept = [x for x in lines if not (is_long(k := key_of(x), size) and "{:X}:{:X}".format(*struct.unpack("<QQ", xxhash.xxh3_128_digest(k))) in bad)]
        out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


def dropped_lines(docs: DataFrame, *, least: int = 3, length: int = 20, shard_keys: int = SHARD_KEYS, hot_rows: int = 1024) -> DataFrame:
    """``docs(doc_id, text, text_key)`` -> ``doc_id, text_key, hashes``: the lines that each document loses."""
    spark = docs.sparkSession
    lines = durable(docs.mapInArrow(_hash_lines(length), "doc_id long, text_key long, a long, b long"))
    held = durable(lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("last")))
    distinct, asked = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-max(distinct, 1) // shard_keys)
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.col("a"), F.lit(shards)).alias("shard")
    index = durable(line_index(held.select("*", shard), shards))
    hot = held.where((F.col("n") * HOT >= asked) & (F.col("n") >= hot_rows)).select("a", "b")  # at most HOT rows
    no = F.lit(None).cast("long")
    answers = durable(probe(index, hot.select(shard, no.alias("doc_id"), no.alias("text_key"), "a", "b"), parts, least)).select("a", "b", "last")
    cold = lines.join(F.broadcast(hot), ["a", "b"], "left_anti").select(shard, "doc_id", "text_key", "a", "b")
    met = probe(index, cold, parts, least).unionByName(lines.join(F.broadcast(answers), ["a", "b"]))
    gone = met.where(F.coalesce("doc_id", F.lit(NO_ID)) != F.col("last"))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.concat_ws(":", F.hex("a"), F.hex("b"))).alias("hashes"))


def dedup_lines(docs: DataFrame, *, least: int = 3, length: int = 20, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, hot_rows: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept`` (its remaining text).

    A key of at least ``length`` code points found in ``least`` documents loses all its lines except in the documents with
    the largest id holding it.  Every row is a document, so repeated rows count each and share their fate.  A null id is
    smaller than any other.  A null or empty text is one empty line; an empty table gives an empty result; other columns
    are ignored.  A text is held whole in one task.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("text_key", F.xxhash64("text"))
    gone = dropped_lines(slim, least=least, length=length, shard_keys=shard_keys, hot_rows=hot_rows).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    both = slim.join(gone.hint("shuffle_hash"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return both.select("doc_id", drop_lines("text", "hashes", F.lit(length)).alias("c")).select("doc_id", "c.*")


ORACLE_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
held AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, held.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
