"""Collocations, line deduplication and spelling variants beside brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, clash

from tidemark.llm import collocations, linededup, variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- op11 --------------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        inside = Counter()
        for p, c in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], c)
        rows_ = []
        for p, a in frequent.items():
            if inside[p] and 100 * inside[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def spoken(n=60, seed=5):
    rng = random.Random(seed)
    words = "a b c d e ü ö Aa the of and in to".split()
    fixed = ["of the a b c d e", "in\tto  the", "ü ö, a; b\x0bc d e", "the the the the the the"]
    rows = [(i, " ".join(rng.choice([*words, *fixed, ". x", "\n"]) for _ in range(rng.randint(0, 60))), ("en", "de", None)[i % 3], "s", 0) for i in range(n)]
    return rows + [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, " \t\n.,", "en", "s", 0), (903, "a b " * 3000, "en", "s", 0), *rows[:3], (904, "only once here", "und", "s", 0)]


@pytest.mark.parametrize("slots", [1 << 16, 1 << 20])
def test_collocations_equal_brute_force_whatever_the_slots(spark, slots):
    rows = spoken()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for least, top in ((20, 15), (300, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top, slots=slots).collect())
        assert got == brute_collocations(rows, least, top) and got


def test_a_long_text_is_counted_in_slices_and_an_empty_table_gives_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0
    texts = ["a b. c d. " * 50, "e f g " * 40, None, ""]
    assert [w for d in collocations.slices(texts, 64) for w in collocations.word_ids(d)[0] if w] and b" ".join(collocations.slices(texts, 64)).replace(b"\xff", b" ").split() == " ".join(t.replace(".", " ") for t in texts if t).encode().split()
    rows = spoken(12)
    docs = clash(spark.createDataFrame(rows, DOCS))
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=10).collect()) == brute_collocations(rows, 10, 2000)


# -- op12 --------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=3, length=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held, last = Counter(), {}
    number = lambda i: -(1 << 63) if i is None else i
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, -(1 << 63)), number(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= length and held[key(x)] >= least and last[key(x)] != number(i))]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def lined(n=70, seed=9):
    rng = random.Random(seed)
    shared = ["This line is in many documents", "  this LINE is in many documents\t", "ünïcödé line of twenty", "exactly twenty chars", "nineteen characters", "another very common licence line"]
    rows = [(i, "\n".join(rng.choice([*shared, f"own line number {i} of this document", ""]) for _ in range(rng.randint(0, 9))), "en", "s", 0) for i in range(n)]
    hot = [(1000 + i, "a line that every document of a third of the table holds\nown " + str(i), "en", "s", 0) for i in range(60)]
    return rows + hot + [(None, None, None, None, 0), (5000, "", None, None, 0), (None, rows[3][1], None, None, 0), rows[4], rows[4], (5001, "\n".join(f"a very long text has this line {i}" for i in range(20_000)), "en", "s", 0)]


@pytest.mark.parametrize("hot_rows", [10, 1024])
def test_lines_equal_brute_force_with_and_without_hot_keys(spark, hot_rows):
    rows = lined()
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(4))
    found = linededup.dedup_lines(docs, shard_keys=500, hot_rows=hot_rows).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == brute_lines(rows)


def test_lines_of_an_empty_table_and_of_null_ids(spark, empty):
    assert linededup.dedup_lines(empty).count() == 0
    rows = [(None, "the same line of twenty characters", None, None, 0)] * 4
    assert {(r["n_dropped"], r["kept"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()} == {(0, rows[0][1])}


def test_the_perfect_hash_is_minimal_and_survives_its_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a[: n // 2] = 5  # halves that are alike in one word
        found = linededup.PerfectHash.from_bytes(linededup.PerfectHash.build(a, b).to_bytes())
        assert sorted(found.index(a, b).tolist()) == list(range(n))


# -- op13 --------------------------------------------------------------------------------------------------------------


def one_edit(x, y):
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def misspelt(n=80, seed=4):
    rng = random.Random(seed)
    words = ["concurrency", "Straßenbahn", "aaaaaaaa", "aaaaaaa", "abababab", "fünfundzwanzig", "weather", "whether", "leather", "Éléphant", "x" * 400]
    rows = []
    for i in range(n):
        text = []
        for _ in range(60):
            w = rng.choice(words)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", "ß", w[at] * 2]) + w[at + 1 :]
            text.append(w)
        rows.append((i, " ".join(text), "en", "s", 0))
    return rows + [(None, "Weather weather whether", None, None, 0), (900, None, None, None, 0), (901, "", None, None, 0), rows[0], rows[0], (902, "weather " * 5000, "en", "s", 0)]


@pytest.mark.parametrize("block_words", [3, 4096])
def test_variants_equal_brute_force_with_and_without_large_blocks(spark, block_words):
    rows = misspelt()
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(4))
    got = sorted((tuple(r) for r in variants.variant_groups(docs, block_words=block_words).collect()), key=str)
    assert got == brute_variants(rows) and any(r[1] != r[2] and r[1] for r in got)


def test_variants_of_an_empty_table(empty):
    assert variants.variant_groups(empty).count() == 0


def test_scanning_a_sorted_list_finds_every_near_pair_once():
    rng = random.Random(2)
    for size in (1, 2, 40, 300):
        words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(7, 9))) for _ in range(size)})
        got = []
        for m in range(7, 10):
            mine = [w for w in words if len(w) in (m, m + 1)]
            for j in range(4):
                got += [(mine[a], mine[b]) for a, b in variants.near_in_list(mine, m, m * j // 4, m * (j + 1) // 4)]
        assert sorted(got) == [(x, y) for i, x in enumerate(words) for y in words[i + 1 :] if one_edit(x, y)]


def test_a_task_adds_up_equal_windows_of_its_batches():
    rng = random.Random(5)
    table = lambda rows: pa.table({"lang": [r[0] for r in rows], **{c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(collocations.COLUMNS, 1)}, "c": pa.array([r[6] for r in rows], pa.int64())})
    rows = [[(rng.choice("de"), *(rng.choice(["a", "b", None]) for _ in range(5)), rng.randint(1, 9)) for _ in range(100)] for _ in range(20)]
    want = Counter()
    for *key, n in (r for part in rows for r in part):
        want[tuple(key)] += n
    for limit, once in ((10_000, True), (150, False)):  # with a low limit the same windows may leave more than once
        got = [tuple(r.values()) for t in collocations.combined(map(table, rows), limit) for r in t.to_pylist()]
        total = Counter()
        for *key, n in got:
            total[tuple(key)] += n
        assert total == want and (len(got) == len(want)) == once


def test_a_phrase_leaves_one_task_for_each_core_and_not_one_for_each_small_partition(spark):
    rows = [(i, "the same few words in every text", "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).select("lang", "text")
    made = lambda task_bytes: [int(n) for n in re.findall(r"partitions=(\d+)|Coalesce (\d+)", collocations.phrase_counts(docs.repartition(40), 100, 1 << 16, task_bytes)._jdf.queryExecution().executedPlan().toString()) for n in n if n]
    assert spark.sparkContext.defaultParallelism in made(collocations.TASK_BYTES) and 400 * 32 // 1024 in made(1024)
    few, many = ({(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs.repartition(40), 100, 1 << 16, n).collect()} for n in (collocations.TASK_BYTES, 1))
    assert few == many and few["en", "the same few words in"] == 400
