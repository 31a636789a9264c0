"""Near-duplicates by 64-bit SimHash fingerprints and BK-trees.

The distinct fingerprints are dealt to shards, each shard becomes a BK-tree (children keyed by their integer Hamming
distance to the parent), and the fingerprints search the trees, following only edges within the radius.

No tree could be broadcast: all trees together are all fingerprints, which may not pass through the driver and have no
size bound.  So fingerprints are routed to the trees that can hold their neighbours: two fingerprints that differ in at
most three bits agree on one of four blocks of 16 bits whole (and, for very many fingerprints, on two of five blocks), so
a shard holds the fingerprints that agree in the first bits of one block, and each fingerprint goes to one shard for each
block.  The number of routing bits follows from the number of fingerprints, so that a tree has about ``TREE`` nodes at any
size.  A shard of more than ``SHARD`` fingerprints is cut further; each pair of its parts is one tree in a task of its own.
A tree returns a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, durable
from .graph import components

RADIUS = 3
TREE, SHARD, HOT_CODES = 1024, 8192, 1024
_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, words_in_shingle: int = 3, slab: int = 1 << 16) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    shingles = max(1, len(words) - words_in_shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, shingles, slab):
        part = words[at : at + slab + words_in_shingle - 1]
        grams = zip(*(part[i:] for i in range(words_in_shingle)), strict=False) if len(words) >= words_in_shingle else [part]
        hashes = np.fromiter(map(_digest, map(b" ".join, grams)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > shingles, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def bk_tree(codes: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Nodes ``(index of the code, {distance: child node})``; node 0 is the root."""
    nodes: list[tuple[int, dict[int, int]]] = []
    waiting = [(None, 0, np.arange(len(codes)))]
    while waiting:
        parent, edge, members = waiting.pop()
        node = len(nodes)
        nodes.append((int(members[0]), {}))
        if parent is not None:
            nodes[parent][1][edge] = node
        rest = members[1:]
        if len(rest):
            distance = np.bitwise_count(codes[rest] ^ codes[members[0]])
            waiting += [(node, int(d), rest[distance == d]) for d in np.unique(distance)]
    return nodes


def linked_roots(codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each code the index of the smallest code that links of at most ``radius`` bits lead to within ``codes``."""
    parent = np.arange(len(codes))

    def roots(of: np.ndarray) -> np.ndarray:
        top = parent[of]
        while not np.array_equal(top, above := parent[top]):
            top = above
        parent[of] = top
        return top

    order = np.argsort(codes)
    codes = codes[order]
    for node, hits in search_all(bk_tree(codes), codes, radius):
        if len(hits) > 1:
            tops = roots(np.append(hits, node))
            parent[tops] = tops.min()
    top = roots(np.arange(len(codes)))
    out = np.empty(len(codes), np.int64)
    out[order] = order[top]
    return out


def search_all(tree: list[tuple[int, dict[int, int]]], codes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """All codes search the tree at once: at each node those that reach it, as (code of the node, codes within radius)."""
    waiting = [(0, np.arange(len(codes)))]
    while waiting:
        node, asking = waiting.pop()
        own, children = tree[node]
        distance = np.bitwise_count(codes[asking] ^ codes[own]).astype(np.int16)
        yield own, asking[distance <= radius]
        for edge, child in children.items():
            follow = asking[np.abs(distance - edge) <= radius]
            if len(follow):
                waiting.append((child, follow))


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by shard -> links ``(a, b)`` to each code's root; one shard at most is held over."""
    held: list[np.ndarray] = []
    names = ("route", "shard", "low", "high", "code")

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
        starts, ends = np.append(0, change), np.append(change, len(rows))
        many = ends - starts > 1
        a, b = [], []
        for s, e in zip(starts[many], ends[many], strict=True):
            codes = rows[s:e, 4]
            root = linked_roots(codes.view(np.uint64))
            moved = np.flatnonzero(root != np.arange(len(codes)))
            a.append(codes[moved])
            b.append(codes[root[moved]])
        join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([join(a), join(b)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.stack([batch.column(n).to_numpy() for n in names], 1)
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
        cut = last[-1] + 1 if len(last) else 0  # the last shard may go on in the next batch
        if cut or (held and (held[-1][-1, :4] != rows[0, :4]).any()):
            yield links(np.concatenate([*held, rows[:cut]]))
            held = []
        held.append(rows[cut:])
    if held:
        yield links(np.concatenate(held))


def routes(codes: int, tree: int = TREE) -> list[int]:
    """Bit masks: two codes within the radius agree on all bits of at least one; a mask's shards have about ``tree`` codes."""
    bits = max(0, (codes // tree).bit_length())
    if not bits:
        return [0]
    first = lambda at, width, n: ((1 << n) - 1) << (at + width - n)
    if bits <= 16:
        return [first(16 * i, 16, bits) for i in range(4)]
    edges = [0, 13, 26, 39, 52, 64]
    spans = list(zip(edges, np.diff(edges).tolist(), strict=False))
    return [first(*a, min(a[1], -(-bits // 2))) | first(*b, min(b[1], bits // 2)) for a, b in combinations(spans, 2)]


def fingerprint_links(codes: DataFrame, shard: int = SHARD, tree: int = TREE) -> DataFrame:
    """Distinct ``codes(code)`` -> links ``(a, b)`` whose components are those of all pairs within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in routes(codes.count(), tree)]
    keys = F.array(*[F.struct(F.lit(t).cast("long").alias("route"), F.col("code").bitwiseAND(F.lit(m).cast("long")).alias("shard")) for t, m in enumerate(signed)])
    rows = codes.select("code", F.explode(keys).alias("k")).select("k.route", "k.shard", "code")
    large = durable(rows.groupBy("route", "shard").count().where(F.col("count") > shard))
    zero = F.lit(0).cast("long")
    plain = rows.select("route", "shard", zero.alias("low"), zero.alias("high"), "code")
    if not large.isEmpty():
        plain = plain.join(large, ["route", "shard"], "left_anti")
        cut = rows.join(large, ["route", "shard"]).withColumn("n", F.ceil(F.col("count") / shard)).withColumn("own", F.pmod(F.xxhash64("code"), "n"))
        other = cut.select("route", "shard", "own", "code", F.explode(F.sequence(zero, F.col("n") - 1)).alias("other"))
        plain = plain.unionAll(other.select("route", "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "code"))
    key = ["route", "shard", "low", "high"]
    return plain.repartition(*key).sortWithinPartitions(*key).mapInArrow(_shard_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id``: the smallest doc_id that links of 3 or fewer bits reach.

    A null or empty text has fingerprint zero and is linked like any other; texts of one or two words are one shingle;
    repeated rows come back each; null ids never name a component unless all its ids are null; an empty table gives an
    empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    prints = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col)).alias("code")))
    kinds = rooted(prints.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    names = kinds.groupBy("root").agg(F.min("first").alias("component_id"))
    found = durable(kinds.join(names, "root").select("code", "component_id", "n"))
    # a code of over a thousandth of all rows would fill one task; there are at most a thousand of them
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(found.where(F.col("n") * HOT_CODES > total).drop("n"))
    joined = prints.join(hot, "code").unionByName(prints.join(hot.select("code"), "code", "left_anti").join(found.drop("n"), "code"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(kinds: DataFrame) -> DataFrame:
    """One row for each ``code`` -> the same with ``root``, the smallest code of its component."""
    kinds = durable(kinds)
    star = components(fingerprint_links(kinds.select("code")))
    return kinds.join(star, F.col("code") == F.col("node"), "left").select(*kinds.columns, F.coalesce("root", "code").alias("root"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; all columns unchanged.

    Every text is fingerprinted once, into a table in the shared folder beside its row.  Null ids come last; of rows with
    equal ids the first of that table stays.  Null and empty texts are one component; an empty table gives an empty
    result; columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    row = "_tidemark_row"
    whole = durable(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), F.monotonically_increasing_id().alias("_n"), fingerprint_column(docs[text_col]).alias("_code")))
    doc_id = F.col(row).getField(id_col).cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_n").alias("n"))
    kept = rooted(whole.groupBy(F.col("_code").alias("code")).agg(F.min(order).alias("first"))).groupBy("root").agg(F.min("first").alias("first"))
    return whole.join(kept.select(F.col("first.n").alias("_n")).hint("shuffle_hash"), "_n", "left_semi").select(f"{row}.*")
