"""Spelling variants: near words by dynamic programming over sorted lists.

Two words at one edit share all but a stretch around the edit.  So a word's shorter length is cut into ``SEGMENTS`` stretches
and, for each stretch, words meet in a block by what lies before and after it; a pair is counted in the one block whose
stretch holds its first difference.  Inside a block the words are a sorted list that is scanned once for each of its words:
the rows of the edit matrix, three cells wide, are kept for the part that a word shares with the one before it in the
list, and where a row has no cell within one edit the scan jumps over all words that share the prefix up to there.

A block of more than ``BLOCK_WORDS`` words isn't scanned: its words meet again in blocks around every single position,
which hold at most the words that differ in one or two code points there.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, regrouped

SEGMENTS = 4
BLOCK_WORDS = 4096
FAR = 2  # stands for any distance beyond one edit
TYPO = 31
LOWER = {c: c + 32 for c in range(65, 91)}
PAIRS = "a string, b string, n_a long, n_b long, m int, lo int, hi int"


def words_of(doc: int | None, text: str | None, run: re.Pattern, length: int, typo: int = TYPO) -> dict[str, int]:
    """A text's words of at least ``length`` code points with their numbers; one run in ``typo`` loses a code point."""
    counts: dict[str, int] = {}
    for w in run.findall((text or "").translate(LOWER)):
        counts[w] = counts.get(w, 0) + 1
    out: dict[str, int] = {}
    base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for w, n in counts.items():
        h = zlib.crc32(w.encode(), base)
        if h % typo == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        if len(w) >= length:
            out[w] = out.get(w, 0) + n
    return out


def _count_words(length: int, typo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("[A-Za-z\\u00C0-\\u00FF]{%d,}" % length)  # shorter runs can't give a word of this length
        for batch in regrouped(batches, "text", 8 << 20):
            total: dict[str, int] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for w, n in words_of(doc, text.as_py(), pattern, length, typo).items():
                    total[w] = total.get(w, 0) + n
            yield from pa.table({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())}).to_batches(max_chunksize=50_000)

    return run


def vocabulary(docs: DataFrame, *, length: int = 7, least: int = 2, typo: int = TYPO) -> DataFrame:
    """``docs(doc_id, text)`` -> ``word, n`` of the words of ``length`` code points found ``least`` times."""
    return docs.mapInArrow(_count_words(length, typo), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_in_list(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list of words of ``m`` and ``m + 1`` code points that are one edit apart and differ first at
    ``lo`` or later but before ``hi`` (an edit at the very end counts to the last stretch); one of the pair has ``m``."""
    size = len(words)
    lcp = [0] * size  # with the word before
    for j in range(1, size):
        x, y, k = words[j - 1], words[j], 0
        while k < len(x) and k < len(y) and x[k] == y[k]:
            k += 1
        lcp[j] = k
    for i in range(size - 1):
        word = words[i]
        n = len(word)
        # rows[d]: cells d-1, d, d+1 of the edit matrix between the first d code points of a list word and of ``word``
        rows = [(FAR, 0, 1)]
        j = i + 1
        while j < size:
            other = words[j]
            del rows[lcp[j] + 1 :]  # rows up to the shared prefix still hold
            dead = False
            while len(rows) <= len(other):
                d = len(rows)
                c = other[d - 1]
                before = rows[-1]
                left = FAR if d > n + 1 else min(before[0] + (d >= 2 and word[d - 2] != c), before[1] + 1)
                here = FAR if d > n else min(before[1] + (word[d - 1] != c), before[2] + 1, left + 1)
                right = FAR if d + 1 > n else min(before[2] + (word[d] != c), here + 1)
                rows.append((min(left, FAR), min(here, FAR), min(right, FAR)))
                if left > 1 and here > 1 and right > 1:
                    dead = True
                    break
            if dead:  # no word with this prefix is within one edit
                prefix = other[: len(rows) - 1]
                rows.pop()
                j = bisect_left(words, prefix[:-1] + chr(ord(prefix[-1]) + 1), j + 1)
                continue
            k = len(other)
            cell = rows[k][n - k + 1] if -1 <= n - k <= 1 else FAR
            if cell == 1 and min(n, k) == m:
                p = 0
                while p < n and p < k and word[p] == other[p]:
                    p += 1
                if lo <= p < hi or (p == m and hi == m):
                    yield i, j
            j += 1


def _scan(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts, over = None, [], [], False
        out: list[tuple] = []

        def finish() -> None:
            if now is None or over:
                return
            m, lo, hi, _ = now
            for i, j in near_in_list(words, m, lo, hi):
                out.append((words[i], words[j], counts[i], counts[j], None, None, None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "n_a", "n_b", "m", "lo", "hi"])
            out.clear()
            return batch

        for batch in batches:
            for m, lo, hi, key, word, n in zip(*[batch.column(c).to_pylist() for c in ("m", "lo", "hi", "key", "word", "n")], strict=True):
                if (m, lo, hi, key) != now:
                    finish()
                    now, words, counts, over = (m, lo, hi, key), [], [], False
                if not over:
                    words.append(word)
                    counts.append(n)
                    if limit is not None and len(words) > limit:  # too large a block: its words go on to finer ones
                        over = True
                        out += [(w, None, c, None, m, lo, hi) for w, c in zip(words, counts, strict=True)]
                        words, counts = [], []
                else:
                    out.append((word, None, n, None, m, lo, hi))
                if len(out) >= 20_000:
                    yield flush()
        finish()
        yield flush()

    return run


def _blocks(words: DataFrame) -> DataFrame:
    """``word, n, m, lo, hi`` -> the same with ``key``: what the word has before and after the stretch."""
    tail = F.col("m") - F.col("hi")
    key = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("\n"), F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise(""))
    return words.withColumn("key", key)


def _scanned(blocks: DataFrame, limit: int | None) -> DataFrame:
    keys = ["m", "lo", "hi", "key"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "word").mapInArrow(_scan(limit), PAIRS)


def near_pairs(vocab: DataFrame, *, length: int = 7, segments: int = SEGMENTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``vocab(word, n)`` of words of at least ``length`` -> ``a, b, n_a, n_b``: every pair of words one edit apart, once."""
    lengths = vocab.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).where(F.col("m") >= length)
    stretch = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("j")
    cut = lengths.select("word", "n", "m", stretch).selectExpr("word", "n", "m", f"cast(m * j div {segments} AS int) AS lo", f"cast(m * (j + 1) div {segments} AS int) AS hi")
    first = durable(_scanned(_blocks(cut.where("lo < hi")), block_words))
    single = F.explode(F.sequence("lo", F.col("hi") - 1)).alias("lo")
    fine = first.where("b IS NULL").select(F.col("a").alias("word"), F.col("n_a").alias("n"), "m", single).withColumn("hi", F.col("lo") + 1)
    return first.where("b IS NOT NULL").unionByName(_scanned(_blocks(fine), None)).select("a", "b", "n_a", "n_b")


def roots_of(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` -> ``word, root``: forms followed to the last, by doubling the steps."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = durable(now.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variant_groups(docs: DataFrame, *, length: int = 7, least: int = 2, factor: int = 10, typo: int = TYPO, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest n (ties: the smallest) if that is at least ``factor`` times the word's n.  A null
    text has no words, a null id counts as an empty one, repeated rows count each; an empty table gives an empty result;
    other columns are ignored.  ``length`` must be at least 2.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where("text IS NOT NULL")
    vocab = durable(vocabulary(slim, length=length, least=least, typo=typo))
    pairs = durable(near_pairs(vocab, length=length, segments=segments, block_words=block_words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    known = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("_form"), (-F.col("best.minus")).alias("_n"))
    holds = F.col("_n") >= factor * F.col("n")
    formed = durable(known.select("word", "n", "n_near", F.when(holds, F.col("_form")).alias("form"), F.when(holds, F.col("_n")).alias("form_n")))
    roots = roots_of(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 from the bit rule, as bytes of ``<doc_id>:<run>``; near words by what is left after one deletion.
ORACLE_SQL = """
WITH RECURSIVE step(n, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE i < 8),
bytes AS (SELECT list(v ORDER BY n) AS t FROM step WHERE i = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INTEGER])), 4294967295)::BIGINT AS h
  FROM counted, bytes),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.rest
  UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM pairs GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN (SELECT min(other) FROM pairs p WHERE p.word = v.word AND p.m = top) END AS form
  FROM v LEFT JOIN best ON best.word = v.word),
walk(word, place, steps) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT walk.word, form, steps + 1 FROM walk JOIN formed ON formed.word = walk.place WHERE form IS NOT NULL),
root AS (SELECT word, arg_max(place, steps) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, root.root, f.n, f.n_near, g.n AS form_n
FROM formed f JOIN root ON root.word = f.word LEFT JOIN v g ON g.word = f.form
"""
