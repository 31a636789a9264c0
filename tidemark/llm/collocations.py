"""Phrase collocations by top-order marginalisation.

Every word opens one window of at most five words, padded where its piece ends; only these longest windows are counted.
Spark's ROLLUP over the window columns then sums the counts of all shorter phrases as prefixes, so no n-gram of another
length is ever exploded.  The counts of a phrase's parts come from the same table by equi-joins.

A phrase can only reach the least count if all phrases inside it do.  Two passes before the windows add up the words and
pairs, then the longer phrases whose pairs may be frequent, of all documents in tables of a fixed number of slots (a
parameter).  A slot can only overstate, so a window may be padded from where its phrase's slot is below the least count on,
without changing a count that matters.  With more text than the slots can tell apart (16 million of them do for some 10 GB)
less is padded early: the windows grow, the results stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches, durable, regrouped, strings

ORDER = 5
SLOTS = 1 << 24
BLOCK = 1 << 16
PIECE = 0xFF  # no byte of UTF-8: stands for an end of a piece
SPLITS = b".,;:!?\n\x0b\x0c\r"
BYTES = bytes(PIECE if c in SPLITS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
COLUMNS = [f"w{k}" for k in range(1, ORDER + 1)]
BATCH_BYTES = 8 << 20
HELD_ROWS = 1 << 20  # windows that a task holds to add up equal ones of its batches
TASK_BYTES = 1 << 28  # text of a task at least, where the tasks exceed the cores: each sends a table of slots and its windows once


def slices(texts: list[str | None], size: int = BATCH_BYTES) -> Iterator[bytes]:
    """The texts as lower-cased bytes with marked piece ends, in slices of about ``size`` that end where a piece ends."""
    data = bytes([PIECE]).join((t or "").encode() for t in texts).translate(BYTES)
    start = 0
    while len(data) - start > size:
        cut = data.rfind(PIECE, start, start + size)
        cut = cut if cut > start else data.find(PIECE, start + size)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]


def word_ids(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a slice, and its words as indexes into them, with -1 where a piece ends."""
    mark = bytes([PIECE])
    tokens = data.replace(mark, b" " + mark + b" ").split()
    kinds = list(dict.fromkeys(tokens))
    if mark in kinds:
        kinds.remove(mark)
    index = {w: i for i, w in enumerate(kinds)} | {mark: -1}
    return kinds, np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def grams(kinds: list[bytes], ids: np.ndarray, lang: str, slots: int, known: list[np.ndarray], upto: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size from 1: the positions at which a phrase of this size may be frequent, and their slots.

    ``known`` has the frequent slots of words and pairs, and of longer phrases, as far as they are counted."""
    seed, mask = xxhash.xxh32_intdigest(lang.encode()), np.uint64(slots - 1)
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in kinds), np.uint64, len(kinds))
    at = np.flatnonzero(ids >= 0)
    code = h[ids[at]]
    for size in range(1, upto + 1):
        if size > 1:  # a phrase stands where the shorter ones at its first and its second word do
            both = np.flatnonzero(np.diff(at) == 1)
            at = at[both]
            code = (code[both] ^ (code[both] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[ids[at + size - 1]]
        mixed = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = ((mixed >> np.uint64(32)) & mask).astype(np.int64)
        table = 0 if size <= 2 else 1
        if table < len(known):
            hit = _bit(known[table], slot)
            at, code, slot = at[hit], code[hit], slot[hit]
        yield size, at, slot


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in regrouped(batches, "text", BATCH_BYTES):
        held: dict[str, list] = {}
        for lang, text in zip(strings(batch, "lang"), strings(batch, "text"), strict=True):
            held.setdefault(lang, []).append(text)
        for lang, texts in held.items():
            for data in slices(texts):
                yield lang, data


def _count_slots(slots: int, least: int, known: list[np.ndarray]):
    sizes = range(3, ORDER + 1) if known else (1, 2)

    def run(batches):
        counts = np.zeros(slots, np.int32)
        for lang, data in _by_lang(batches):
            kinds, ids = word_ids(data)
            for size, _, slot in grams(kinds, ids, lang, slots, known, max(sizes)):
                if size in sizes:
                    np.add.at(counts, slot, 1)
            np.minimum(counts, least, out=counts)  # a sum of cut counts reaches ``least`` exactly where the true sum does
        for b in range(0, slots, BLOCK):
            part = counts[b : b + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b // BLOCK], pa.int32()), "counts": pa.array([part.astype(np.min_scalar_type(least)).tobytes()], pa.binary())})

    return run


def _add_slots(least: int):
    kind = np.min_scalar_type(least)

    def run(batches):
        block, total = None, None
        bits = lambda: pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if b != block:
                    if block is not None:
                        yield bits()
                    block, total = b, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(data, kind)
        if block is not None:
            yield bits()

    return run


def frequent_slots(docs: DataFrame, least: int, slots: int, known: list[np.ndarray]) -> np.ndarray:
    """A bit for each slot: whether its phrases come to ``least``.  Words and pairs are counted first, then, with these
    ``known``, longer phrases.  ``slots / 8`` bytes reach the driver."""
    rows = docs.mapInArrow(_count_slots(slots, least, known), "block int, counts binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros(slots, np.uint8)
    for r in rows.mapInArrow(_add_slots(least), "block int, bits binary").toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return np.packbits(out)


def windows(ids: np.ndarray, vocab: int, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows at all word positions (rows of ``ORDER`` indexes, -1 for padding) and their counts.

    ``phrases``: for each size the positions at which a phrase of that size may be frequent; these shrink with the size.
    """
    none = int((ids >= 0).sum()) - len(phrases[0])
    rows, times = [np.full((1, ORDER), -1)], [np.array([none])]
    longer = [*phrases[1:], np.zeros(0, np.int64)]
    for size, (at, next_) in enumerate(zip(phrases, longer, strict=True), 1):
        at = at[~np.isin(at, next_, assume_unique=True, kind="table")] if len(next_) else at  # windows of exactly this size
        if not len(at):
            continue
        leads = [ids[at + k] for k in range(size)]  # the lead columns
        group = leads[0]
        for lead in leads[1:]:
            _, group = np.unique(group * vocab + lead, return_inverse=True)
        _, where, n = np.unique(group, return_index=True, return_counts=True)
        rows.append(np.column_stack([*[c[where] for c in leads], np.full((len(where), ORDER - size), -1)]))
        times.append(n)
    return np.vstack(rows), np.concatenate(times)


def combined(tables: Iterator[pa.Table], limit: int) -> Iterator[pa.Table]:
    """Equal windows of several tables as one row.  About ``limit`` rows are held; where that many differ they leave."""
    held: list[pa.Table] = []
    size = 0
    for table in tables:
        held.append(table)
        size += len(table)
        if size > limit:
            held = [_summed(held)]
            size = len(held[0])
            if size > limit // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _summed(held)


def _summed(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", *COLUMNS]
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select([*keys, "c"])


def _window_rows(slots: int, known: list[np.ndarray], limit: int = HELD_ROWS):
    def tables(batches):
        for lang, data in _by_lang(batches):
            kinds, ids = word_ids(data)
            if not kinds:
                continue
            rows, times = windows(ids, len(kinds), [at for _, at, _ in grams(kinds, ids, lang, slots, known)])
            names = pa.array(kinds, pa.binary()).cast(pa.string())
            columns = {c: names.take(pa.array(rows[:, k], mask=rows[:, k] < 0)) for k, c in enumerate(COLUMNS)}
            yield pa.table({"lang": pa.array([lang] * len(rows), pa.string()), **columns, "c": pa.array(times.astype(np.int64))})

    def run(batches):
        for table in combined(tables(batches), limit):
            yield from table.to_batches(max_chunksize=50_000)

    return run


def phrase_counts(docs: DataFrame, least: int = 100, slots: int = SLOTS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``docs(lang, text)`` -> ``lang, size, phrase, f``: all phrases of up to five words found ``least`` times, and a row of
    size 0 and phrase ``''`` for each language with the number of all its words.  Small input partitions are read by one task
    up to ``task_bytes`` of text, as far as each core still has a task, so that a phrase leaves fewer tasks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    docs = docs.coalesce(int(max(docs.sparkSession.sparkContext.defaultParallelism, size // task_bytes)))
    known: list[np.ndarray] = []
    for _ in range(2):
        known = [*known, frequent_slots(docs, least, slots, known)]
    rows = docs.mapInArrow(_window_rows(slots, known), ", ".join(["lang string", *[f"{c} string" for c in COLUMNS], "c long"]))
    longest = rows.groupBy("lang", *COLUMNS).agg(F.sum("c").alias("c"))
    rolled = longest.rollup("lang", *COLUMNS).agg(F.sum("c").alias("f"), F.grouping_id().alias("_g"))
    size = F.lit(ORDER) - F.bit_count("_g")
    whole = F.when(F.col("size") == 0, True)  # a prefix that ends in padding is no phrase
    for k, c in enumerate(COLUMNS, 1):
        whole = whole.when(F.col("size") == k, F.col(c).isNotNull() & (F.col("f") >= least))
    return rolled.withColumn("size", size).where((F.col("size") >= 0) & whole).select("lang", "size", F.concat_ws(" ", *COLUMNS).alias("phrase"), "f")


def _part(first, length):
    return F.array_join(F.slice("words", first, length), " ")


def collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS) -> DataFrame:
    """Each language's ``top`` phrases by their lowest-scoring cut: ``lang, rank, phrase, a, l, r, n, score``.

    A null text is empty, a null language is ``und``; repeated rows count each; an empty table, or one without a frequent
    phrase, gives an empty result; other columns are ignored.  A piece without any end mark is held whole in one task.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text")).where("text IS NOT NULL")
    found = durable(phrase_counts(slim, least, slots))
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    phrases = found.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    # phrases inside a longer one that is found as often
    inner = phrases.where("size >= 3").select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"), "size")
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: _part(i, F.col("k")))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(inner, (phrases["lang"] == inner["lang"]) & (phrases["phrase"] == inner["phrase"]) & (100 * inner["longer"] >= 100 * phrases["a"]), "left_anti")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size")).alias("right"))
    part = lambda side, name: found.where("size >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumns({"_up": (big("a") * big("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "_down": big("l") * big("r")})
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("_up div _down").alias("score"), "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = lowest.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's phrases are first ranked in shares
    near = share.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*best))).where(F.col("_n") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (SELECT lang, words, i, unnest(range(1, 6)) AS size FROM starts),
f AS (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM grams WHERE i + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size >= 2),
inner_k AS (SELECT lang, a, words, size, unnest(range(2, size)) AS k FROM c WHERE size >= 3),
inner_i AS (SELECT lang, a, words, k, unnest(range(1, size - k + 2)) AS i FROM inner_k),
inside AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, max(a) AS longer FROM inner_i GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN n USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(words[1 : k], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(words[k + 1 : cuts.size], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
