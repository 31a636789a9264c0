"""The training-data operators beside brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, graph, html, langid, lm, packing, quality, queries, sharding, simhash, topk
from tidemark.llm import tokens as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the and of thing house water with this that from over under people work".split(),
    "de": "der die das und nicht für über schön straße größe wasser haus mit auf".split(),
    "fr": "le la les été où être garçon forêt avec dans pour maison eau élève".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(n=90, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(25, 120)), lang, f"s{i % 4}", 0))
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "word"), (1004, "a b"), (1005, "1234 5678 !!"), (None, "no id here"), (7, rows[7][1]), (7, rows[7][1]), (1006, "x" * 3000), (1007, rows[8][1]), (1008, "same " * 400)]
    return rows + [(i, t, None, None, 0) for i, t in odd]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """The same table with extra columns of names that operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("n_words", "code", "row", "n", "shard", "curve", "score", "word", "p", "c", "ids", "kept", "part")})


# -- op1 ---------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k, query):
    rows = [(i, [x is not None and x > 0 for x in v]) for i, v in rows if i is not None and v is not None]
    out = []
    for q, a in rows:
        if query(q):
            near = sorted((sum(x != y for x, y in zip(a, b, strict=True)), i) for i, b in rows)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    base = rng.normal(size=(6, 24))
    rows = [(i, [float(x) for x in base[i % 6] + rng.normal(size=24) * (0 if i % 7 == 0 else 0.8)]) for i in range(160)] + [(None, [1.0] * 24), (500, None), (20, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    for k in (3, 10):
        got = sorted(tuple(r) for r in topk.exact_topk(df, k=k).collect())
        assert got == brute_topk(rows, k, lambda i: i % 20 == 0)
    few = df.where("vec_id < 4")
    assert sorted(tuple(r) for r in topk.exact_topk(few, k=10).collect()) == brute_topk(rows[:4], 10, lambda i: i % 20 == 0)
    assert topk.exact_topk(df.limit(0)).count() == 0


# -- op2 ---------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    marked = {i + j for i, g in enumerate(grams) if g in twice for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_quality_counts_and_verdicts(spark, docs, empty):
    rng = random.Random(9)
    junk = [(2000 + i, " ".join(w + "%%%" for w in prose(rng, "en", 60).split()), None, None, 0) for i in range(20)]
    rows = corpus() + junk + [(3000, "a b c d e f g h\n" * 9, None, None, 0), (3001, "x\ny\nx\n\n \nx", None, None, 0)]
    df = clash(spark.createDataFrame(rows, DOCS))
    got = quality.judge_quality(df).collect()
    text_of = {i: t for i, t, *_ in rows}
    for r in got:
        counts = brute_counts(text_of[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(90)) and not any(kept[2000 + i] for i in range(20))
    assert len(got) == len(rows)
    stay = quality.keep_good(df)
    assert stay.columns == df.columns and sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.judge_quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_em_equals_a_plain_em():
    patterns, n = np.array([[1, 1], [1, 0], [-1, 0], [-1, -1]]), np.array([50.0, 30.0, 10.0, 5.0])
    bias, odds = quality.fit_votes(patterns, n, rounds=40)
    good = [1 / (1 + math.exp(-(1 + 0.5 * sum(v > 0 for v in p) - 5 * sum(v < 0 for v in p)))) for p in patterns]
    lean = {1: (0.55, 0.10), 0: (0.35, 0.35), -1: (0.10, 0.55)}
    for _ in range(40):
        table = [[[20 * lean[v][c] + sum(w * (g if c == 0 else 1 - g) for p, w, g in zip(patterns, n, good, strict=True) if p[j] == v) for v in (-1, 0, 1)] for j in range(2)] for c in range(2)]
        table = [[[x / sum(row) for x in row] for row in side] for side in table]
        for j in range(2):
            excess = max(0, table[0][j][0] - quality.DOUBT * table[1][j][0])
            table[0][j][0] -= excess
            table[0][j][1] += excess
        prior = (sum(w * g for w, g in zip(n, good, strict=True)) + 2) / (n.sum() + 4)
        good = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(math.log(table[0][j][p[j] + 1] / table[1][j][p[j] + 1]) for j in range(2))))) for p in patterns]
    assert abs(bias - math.log(prior / (1 - prior))) < 1e-9
    assert np.allclose(odds, np.log(table[0]) - np.log(table[1]))


# -- op3 ---------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(spark, empty):
    rng = random.Random(5)
    base = [prose(rng, "en", 400) for _ in range(4)]
    rows = corpus(60)
    for i in range(60):
        words = base[i % 4].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(400)] = "changed"
        rows.append((5000 + i, " ".join(words), None, None, 0))
    df = clash(spark.createDataFrame(rows, DOCS).repartition(5))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    prints = [brute_print(t) for _, t, *_ in rows]
    group = brute_components(prints)
    smallest = {}
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    assert got == sorted((str(r[0]), f"{p:016x}", smallest.get(g)) for r, p, g in zip(rows, prints, group, strict=True))
    stay = simhash.keep_one_of_each(df)
    assert stay.columns == df.columns and stay.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


def test_bk_tree_roots_and_sharded_buckets(spark):
    rng = np.random.RandomState(2)
    center = rng.randint(0, 2**63, 3).astype(np.uint64)
    codes = np.unique(np.array([center[i % 3] ^ np.uint64(sum(1 << int(b) for b in rng.randint(0, 40, rng.randint(0, 6)))) for i in range(300)], np.uint64))
    want = brute_components([int(c) for c in codes])
    got = simhash.linked_roots(codes)
    assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))
    df = spark.createDataFrame([(int(c.astype(np.int64)),) for c in codes], "code long")
    for shard, tree in ((10_000, 1000), (10_000, 8), (40, 1000), (10, 64)):  # one tree, routed trees, and shards cut further
        linked = {r["node"]: r["root"] for r in graph.components(simhash.fingerprint_links(df, shard, tree)).collect()}
        groups = {}
        for c, g in zip(codes.view(np.int64).tolist(), want, strict=True):
            groups.setdefault(g, set()).add(linked.get(c, c))
        assert all(len(roots) == 1 for roots in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_search_follows_only_edges_within_the_radius():
    rng = np.random.RandomState(4)
    codes = np.unique(rng.randint(0, 2**63, 900).astype(np.uint64))
    codes = np.unique(np.concatenate([codes, codes[:90] ^ np.uint64(5)]))
    tree, visited, hits = simhash.bk_tree(codes), np.zeros(len(codes), int), set()
    for node, (_, children) in enumerate(tree):
        assert all((int(codes[tree[node][0]]) ^ int(codes[tree[c][0]])).bit_count() == d for d, c in children.items())
    waiting = [(0, i) for i in range(len(codes))]
    while waiting:  # one code at a time, as a plain search does
        node, i = waiting.pop()
        visited[i] += 1
        d = (int(codes[i]) ^ int(codes[tree[node][0]])).bit_count()
        hits |= {(tree[node][0], i)} if d <= 3 else set()
        waiting += [(child, i) for edge, child in tree[node][1].items() if abs(edge - d) <= 3]
    together = [(own, int(i)) for own, found in simhash.search_all(tree, codes, 3) for i in found]
    assert set(together) == hits and len(together) == len(hits)
    assert hits == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}
    assert visited.mean() < 0.75 * len(codes)


def test_routes_lose_no_link_and_follow_the_number_of_codes():
    rng = random.Random(8)
    for n, masks, bits in ((10, 1, 0), (5000, 4, 3), (60_000_000, 4, 16), (10**9, 10, 20)):
        found = simhash.routes(n)
        assert len(found) == masks and {m.bit_count() for m in found} == {bits}
        for _ in range(300):
            change = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not change & m for m in found)


def test_one_row_stays_of_repeated_ids_and_null_ids(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = next(t for i in range(300) if 0 < (brute_print(t := base.replace(f"word{i} ", "changed ")) ^ brute_print(base)).bit_count() <= 3)
    other = " ".join(f"other{i}" for i in range(50))
    df = spark.createDataFrame([(1, base, "a"), (1, near, "b"), (2, base, "c"), (None, base, "d"), (None, other, "e"), (None, other, "f")], "doc_id long, text string, _n string")
    stay = simhash.keep_one_of_each(df.coalesce(1)).collect()
    assert sorted((r["doc_id"] is None, r["_n"]) for r in stay) == [(False, "a"), (True, "e")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(links).collect()} == {(i, 0) for i in range(1, 61)} | {(201, 200)}


# -- op4 ---------------------------------------------------------------------------------------------------------------

HARD = ["", " ", "\\", "\\\\", "\\[", "\\<s>", "</s>[INST] ok [/INST]", "[[INST]]", "<<SYS>> a <</SYS>>", "x \\\\[/INST]", " </s>", "<s> ", "[/TEXT]\\", "é [ROLE] ü [/ROLE][TEXT] z [/TEXT]", "plain", "a < b [c] \\d"]


def test_every_turn_round_trips():
    rng = random.Random(4)
    alphabet = ["\\", "<", "[", "s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[TEXT]", " ", "a", "]"]
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    turns = [(rng.choice(["user", "assistant", "system", "tool", "", "\\[INST]"]), t) for t in texts]
    rendered = [chat.render_turn(r, t) for r, t in turns]
    assert chat.parse("".join(x[0] for x in rendered)) == turns
    for (role, text), (piece, start, length, _) in zip(turns, rendered, strict=True):
        assert chat.unescape(piece[start : start + length]) == (text if role == "assistant" else "")


def test_parser_refuses_what_is_not_of_the_grammar():
    for bad in ("x", "[INST] a", "[INST] a </s>", "[INST] a [/INST] ", "[ROLE] r [/ROLE]", "[TEXT] t [/TEXT]", "[INST][/INST]", "<s> a [INST] </s>"):
        assert chat.parse(bad) is None


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", HARD[6]), (1, 0, "user", HARD[6]), (2, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 5, "user", "no id"), (3, None, "tool", "[INST]"), (3, 1, "assistant", "é")] + [(4, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit(1), "rendered": F.lit("?")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render_turn(a, b)[0]) for _, a, b in own)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_a_conversation_with_most_of_the_rows_is_rendered_and_parsed_before_the_shuffle(spark):
    rows = [(None if i % 3 else 1, i, "assistant" if i % 2 else "user", "[INST] " * (i % 5) + f"turn {i} " + "very long " * (20_000 if i == 7 else 1)) for i in range(400)]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert "Exchange" not in formatted._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    plan = chat.read_back(formatted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_digest") < plan.index("RepartitionByExpression [conv_id") < plan.index("_parse_pieces") < plan.index("_format")
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in (None, 1):
        own = [r for r in rows if r[0] == conv]
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
    pieces = [r["rendered"] for r in chat.in_order(formatted).where("conv_id = 1").collect()]
    assert chat.parse("".join(pieces)) == [(r, t) for c, _, r, t in rows if c == 1]


# -- op5 ---------------------------------------------------------------------------------------------------------------


def test_language_model_counts_and_gain(spark, empty):
    rng = random.Random(8)
    rows = corpus(12) + [(100 + i, prose(rng, ("en", "de", "fr")[i % 3], 150), None, None, 0) for i in range(150)]
    got = sorted(lm.score_documents(clash(spark.createDataFrame(rows, DOCS).repartition(4))).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t, *_ in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), len(ws), out(i), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens), key=lambda x: x[:2])
    for r, (i, size, held, known, base) in zip(got, want, strict=True):
        assert (str(r["doc_id"]), r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"]) == (i, size, held, known, n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(empty).count() == 0


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_form(w):
    return zlib.crc32(w.rstrip(b".,")[-2:] if len(w) > 3 else w)


def plain_path(w):
    form, other = plain_mix(plain_form(w) + 1), plain_mix(zlib.crc32(w) + 2)
    first = 15 if not w else form % 7 if len(w) <= 3 else 7 + form % 8
    return first, (other >> 8) % 16, (other >> 16) % 16


def plain_rows(left, path, number):
    """The rows of a token of that path after the words ``left`` (nearest first; None: no word there), one level at a time."""
    whole = lambda n: 0 if left[n] is None else plain_mix(zlib.crc32(left[n]) * 2 + 1)
    form = lambda n: 0 if left[n] is None else plain_mix(plain_form(left[n]) * 2 + 9)
    history = [whole(0) + 1 & MASK, whole(1) ^ 1 << 40, form(0) * 3 + form(1) * 7 + 2 & MASK, form(2) * 3 + form(3) * 7 + 3 & MASK]
    prefix = 0
    for level in range(3):
        rows = [plain_mix(h ^ plain_mix(prefix + 1000 * level + 11)) % (number // 4 if level == 0 else number) for h in history]
        yield [r // 16 * 16 + path[1] for r in rows] if level == 2 else rows, prefix
        prefix = prefix * 16 + path[level]


def random_model(rows=64, seed=0):
    rng = np.random.RandomState(seed)
    return lm.Model([rng.normal(size=(n, 16)).astype(np.float32) for n in (rows // 4, rows, rows)], [np.log(rng.dirichlet(np.ones(16), 16**k)).astype(np.float32) for k in range(3)])


def plain_log10(model, left, path):
    total = 0.0
    for level, (rows, prefix) in enumerate(plain_rows(left, path, model.rows)):
        logits = model.bias[level][prefix].astype(float) + sum(model.weights[level][r].astype(float) for r in rows)
        total += math.log10(math.exp(logits[path[level]]) / np.exp(logits).sum())
    return total


def test_history_scores_equal_brute_force():
    model = random_model()
    texts = ["The house, and thé house over there", None, "x", "a bb ccc dddd " * 30, "Ending. of ending"]
    got = lm.history_scores(model, lm.Tokens(texts), slab=7)
    for text, score in zip(texts, got, strict=True):
        words = (text or "").encode().lower().split() + [b""]
        left = lambda i: [words[i - n] if i >= n else None for n in (1, 2, 3, 4)]  # noqa: B023, E731
        assert abs(score - sum(plain_log10(model, left(i), plain_path(w)) for i, w in enumerate(words))) < 1e-3


def test_all_words_sum_to_one_after_a_history():
    model = random_model(seed=3)
    paths = [(a, b, c) for a in range(16) for b in range(16) for c in range(16)]
    assert abs(sum(10 ** plain_log10(model, [b"the", b"house", None, None], p) for p in paths) - 1) < 1e-6
    words = [w.encode() for ws in WORDS.values() for w in ws]
    c = Counter({w: i for i, w in enumerate(words)})
    path = lm.paths_of(words)
    assert path.tolist() == [(p[0] * 16 + p[1]) * 16 + p[2] for p in map(plain_path, words)]
    total = np.bincount(path, [c[w] for w in words], minlength=lm.PATHS) + np.bincount(path, [c[w] > 0 for w in words], minlength=lm.PATHS) + 1
    known = {w: p for w, p in zip(words, path, strict=True) if c[w]}
    for p in set(path.tolist()):  # the known words and one unit for all unseen ones
        assert abs(sum((c[w] + 1) / total[p] for w in known if known[w] == p) + 1 / total[p] - 1) < 1e-9


def test_sums_of_the_updates_equal_brute_force():
    texts = ["the house and the thing, and the house", "and over", "", "x yy zzz wwww " * 9]
    tokens, number = lm.Tokens(texts), 64
    starts = lm.level_starts(number)
    model = random_model(number, 5)
    want, met = np.zeros((starts[-1], 32)), Counter()
    for text in texts:
        words = text.encode().split() + [b""]
        for i, w in enumerate(words):
            path = plain_path(w)
            met[path] += 1
            for level, (rows, prefix) in enumerate(plain_rows([words[i - n] if i >= n else None for n in (1, 2, 3, 4)], path, number)):
                logits = model.bias[level][prefix].astype(float) + sum(model.weights[level][r].astype(float) for r in rows)
                for r in rows:
                    want[starts[level] + r, path[level]] += 1
                    want[starts[level] + r, 16:] += np.exp(logits) / np.exp(logits).sum()
    got = np.zeros_like(want)
    lm.later_sums(model, tokens, got, slab=10)
    assert np.allclose(got, want, atol=1e-3)
    first, paths = np.zeros_like(want), np.zeros(lm.PATHS, np.int64)
    lm.first_sums(tokens, number, first, paths)
    assert {p: paths[(p[0] * 16 + p[1]) * 16 + p[2]] for p in met} == dict(met) and paths.sum() == len(tokens.ids)
    start, blank = np.zeros_like(want), lm.Model([np.zeros_like(w) for w in model.weights], lm.bias_of(paths))
    lm.later_sums(blank, tokens, start)  # the first update needs no softmax: the same as one with weights of zero
    for level in range(3):
        here = slice(starts[level], starts[level + 1])
        assert np.allclose(first[here, :16], start[here, :16])
        assert np.allclose(lm.first_expected(level, first[here, 16:], first[here, :16], blank.bias[level]), start[here, 16:], atol=1e-3)


def test_history_chooses_the_word_within_its_class(spark):
    """Words of one first digit and equal frequency, told apart by the word before them alone."""
    made = [f"{a}{b}zzing" for a in "abcdefgh" for b in "abcdefgh"]
    twins = list({plain_path(w.encode()): w for w in made}.values())[:8]
    assert len({plain_path(w.encode())[0] for w in twins}) == 1
    rng = random.Random(3)
    draw = lambda right: " ".join(f"left{(i + (0 if right else 1)) % 8} {twins[i]}" for i in (rng.randrange(8) for _ in range(20)))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, draw(i not in held or held.index(i) % 2 == 0)) for i in range(400)]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    right, wrong = (np.mean([got[i]["score"] for i in held[k::2]]) for k in (0, 1))
    assert right > wrong + 20 * 0.5


def test_scores_do_not_depend_on_blocks_and_ranges(spark, monkeypatch):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, "en", 60)) for i in range(80)], "doc_id long, text string")
    score = lambda parts: {r["doc_id"]: r["score"] for r in lm.score_documents(docs.repartition(parts)).collect()}
    want = score(1)
    monkeypatch.setattr(lm, "BUCKET_WORDS", 20)
    got = score(3)
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_many_tasks_add_up_as_few(spark):
    rng = np.random.RandomState(1)
    sums = rng.randint(0, 50, (70, lm.level_starts(64)[-1], 32)).astype(float)
    rows = [(part, t % 64, sums[t, at : at + lm.GROUP].astype("<f4").tobytes()) for t in range(70) for part, at in enumerate(range(0, sums.shape[1], lm.GROUP))]
    df = spark.createDataFrame(rows, lm._SUMS).repartition(5)
    for tasks in (3, 70):
        total, _ = lm._gather(df, tasks, 64)
        assert np.allclose(total, sums.sum(0))


def test_later_updates_read_every_training_document(spark, docs, monkeypatch):
    sums, gather = [], lm._gather
    monkeypatch.setattr(lm, "_gather", lambda *a: sums.append(gather(*a)) or sums[-1])
    training = docs.where(~lm.held_out(F.col("doc_id")))
    lm.train(training)
    tokens = sum(len((r["text"] or "").encode().split()) + 1 for r in training.collect())
    first, *later = (total[:, : lm.DIGITS].sum() for total, _ in sums)
    assert len(later) == len(lm.STEPS) - 1
    assert first == sum(later) == tokens * lm.USED * lm.LEVELS


def test_model_grows_with_its_training_bytes():
    assert lm.rows_for(0) == lm.LEAST_ROWS and lm.rows_for(300_000_000) > lm.LEAST_ROWS and lm.rows_for(1 << 45) == lm.MOST_ROWS


def test_no_share_is_empty_where_ids_are_equal(spark):
    rows = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert {r["share"] for r in rows.select(lm.share(lm.ROUNDS).alias("share")).distinct().collect()} == set(range(lm.ROUNDS))


# -- op6 ---------------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(spark, docs, empty):
    got = sharding.balanced_shards(clash(docs), n_shards=5, parts=3).collect()
    assert len(got) == docs.count() and {r["law"] for r in got} == {"bytes"}
    assert sorted(zlib.crc32((t or "").encode()) for _, t, *_ in corpus()) == sorted(r["text_crc32"] for r in got)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])
    last = None
    for s in sorted(by_shard):
        rows = sorted(by_shard[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert rows == sorted(rows, key=lambda r: (*order(r), r["slot"]))
        assert last is None or order(last) <= order(rows[0])
        last = rows[-1]
    sizes = [sum(r["size"] for r in x) for x in by_shard.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert sharding.balanced_shards(empty).count() == 0


# -- op7, op8 ------------------------------------------------------------------------------------------------------------

BYTE, WORD = K.vocabulary_path("byte_bpe_50k.json"), K.vocabulary_path("word_bpe_49k.json")
PARTS = ["A.", "the,", "É.", "é.", "…", "!#", ".", "a", "b", "the", "'s", "'", "'re", " ", "  ", "\n", "\t", "\xa0", "\x1c", " ", "é", "ß", "1", "23", "!!", "<|endoftext|>", "<|endof", "日本", "🎉", "Σ", "İ", "AAAA", "-", "="]


def test_special_strings_in_other_cases_are_the_librarys():
    path = K.vocabulary_path("word_bpe_49k.json")
    parts = ["<|STARTOFTEXT|>", "<|startoftext|>", "<|EndOfText|>", "x", "É", "İ", "ẞ", "\u212a", "'S", "don't", "12", "...", "|", "<|", "|>", "日本", " ", "\xa0", "ΣΑΣ", "\x85", "µ"]
    rng = random.Random(1)
    texts = ["<|STARTOFTEXT|>x", "<|ENDOFTEXT|>x", None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    for text, ids in zip(texts, K.word_ids(texts, path), strict=True):
        assert ids.tolist() == K.tokenizer(path).encode(text or "", add_special_tokens=False).ids, text


def test_full_caches_change_nothing(monkeypatch):
    path = K.vocabulary_path("word_bpe_49k.json")
    monkeypatch.setattr(K, "CACHE", 40)
    held = K.WordCache(path)
    monkeypatch.setattr(K, "word_cache", lambda _: held)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcdé") * rng.randint(1, 9) + rng.choice(["", ".", "!?"]) for _ in range(30)) for _ in range(3)]
        assert [x.tolist() for x in K.word_ids(texts, path)] == [K.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
        assert len(held.known) <= 40 + 90 and len(held.stems) <= 20 + 90


def test_words_met_again_after_a_full_cache_are_not_merged_anew(monkeypatch):
    path = K.vocabulary_path("word_bpe_49k.json")
    monkeypatch.setattr(K, "CACHE", 40)
    held, merged = K.WordCache(path), []
    model = held.held.model
    monkeypatch.setattr(held.held, "model", type("Counting", (), {"tokenize": lambda _, stem: merged.append(stem) or model.tokenize(stem)})())
    monkeypatch.setattr(K, "word_cache", lambda _: held)
    first, second = (" ".join(f"{c}{d}{e}" for d in "abcde" for e in "fghijk") for c in "xy")
    for text in (first, second, first):
        assert K.word_ids([text], path)[0].tolist() == K.tokenizer(path).encode(text, add_special_tokens=False).ids
    assert len(merged) == len(set(merged)) == 60


def test_chunked_ids_are_the_librarys():
    rng = random.Random(2)
    for _ in range(1200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50)))
        want = K.tokenizer(BYTE).encode(text, add_special_tokens=False).ids
        assert K.byte_ids(text, BYTE).tolist() == want == K.Encoded.of(text, BYTE).ids.tolist()
        assert K.decode_ids(want, BYTE) == K.tokenizer(BYTE).decode(want, skip_special_tokens=False)
        assert K.word_ids([text], WORD)[0].tolist() == K.tokenizer(WORD).encode(text, add_special_tokens=False).ids
        at = rng.randint(0, len(text))
        joined = K.Encoded.of(text[:at], BYTE).join(K.Encoded.of(text[at:], BYTE), BYTE)
        assert joined.ids.tolist() == want and joined.text == text and joined.counts.sum() == len(want)


def test_long_units_join_exactly(monkeypatch):
    monkeypatch.setattr(K, "LONG_UNIT", 20)
    rng = random.Random(3)
    for _ in range(400):
        base = rng.choice(["abcdefghij", "aab", "=", "the", "éß日", "lyerthingtion"])
        text = "".join(rng.choice(base) if rng.random() < 0.5 else base for _ in range(rng.randint(50, 300)))
        want = K.tokenizer(BYTE).encode(text, add_special_tokens=False).ids
        at = rng.randint(0, len(text))
        assert K.Encoded.of(text, BYTE).ids.tolist() == want
        assert K.Encoded.of(text[:at], BYTE).join(K.Encoded.of(text[at:], BYTE), BYTE).ids.tolist() == want


def test_encode_and_decode(spark, docs, empty):
    want = sorted((str(i), K.tokenizer(BYTE).encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in corpus())
    for piece in (100, 1 << 15):
        coded = bpe.encode(clash(docs), BYTE, piece=piece).withColumn("back", bpe.decode_column(BYTE)(F.col("ids")))
        assert sorted((str(r["doc_id"]), r["ids"], r["back"]) for r in coded.collect()) == want
    assert bpe.encode(empty, BYTE).count() == 0


@pytest.mark.parametrize("piece", [64, bpe.PIECE])
def test_the_worker_that_encodes_also_decodes(spark, docs, empty, piece):
    rows = docs.unionByName(spark.createDataFrame([(2000, "ends <|endoftext|> " * 30, None, None, 0), (2001, "\U0001f468\u200d\U0001f469 é\u0301\x00 " * 40, None, None, 0)], DOCS))
    coded = bpe.encode(clash(rows), BYTE, piece=piece, decoded=True)
    tokenizer, texts = K.tokenizer(BYTE), sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=str)
    expected = [(i, ids := tokenizer.encode(t, add_special_tokens=False).ids, tokenizer.decode(ids, skip_special_tokens=False)) for i, t in texts]
    assert sorted((tuple(r) for r in coded.collect()), key=str) == sorted(expected, key=str)
    assert bpe.encode(empty, BYTE, decoded=True).count() == 0


def test_no_task_of_bpe_feeds_one_python_worker_from_another(spark):
    plan = queries.op8_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    index = packing.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_packing_holds_every_token_once(docs, empty):
    pieces = packing.pack(clash(docs), WORD, length=64).collect()
    ids = {}
    for i, t, *_ in corpus():
        ids.setdefault(i, []).append(K.tokenizer(WORD).encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(p["length"] for p in pieces) == sum(len(x) for many in ids.values() for x in many)
    for p in pieces:
        own = np.frombuffer(p["ids"], "<u4")
        assert len(own) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        assert any(len(x) == p["doc_tokens"] and x[p["start"] : p["start"] + p["length"]] == own.tolist() for x in ids[p["doc_id"]])
    last = max(p["sequence_id"] for p in pieces)
    for s in range(last + 1):
        row = sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == s)
        assert all(a + b == c for (a, b), (c, _) in zip(row, row[1:], strict=False)) and row[0][0] == 0
        assert sum(n for _, n in row) == 64 or s == last
    assert packing.pack(empty, WORD).count() == 0


# -- op9 ---------------------------------------------------------------------------------------------------------------


def test_languages_are_learned(spark, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3], 60), ("en", "de", "fr")[i % 3], "s", 0) for i in range(240)] + [(900 + i, t, None, None, 0) for i, t in enumerate([None, "", "12 34 !!", "日", prose(rng, "de", 9000)])]
    got = {r["doc_id"]: r for r in langid.identify(clash(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(i, lang) for i, _, lang, *_ in rows if got[i]["held_out"] and lang]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.9 * len(held)
    assert [got[900 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[904]["lang_pred"] == "de"
    assert langid.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, None, 0)], DOCS)
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"
    kept = langid.keep_identified(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.where("doc_id IN (900, 901, 902)").count() == 0


def test_recurrent_gradients_are_right():
    rng = np.random.RandomState(0)
    net = langid.Network.fresh(["a", "b", "c"])
    for name in ("table", "state", "label", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, target = rng.randint(0, 256, (5, 7)).astype(np.int16), rng.randint(0, 3, 5)
    windows[0, 5:] = langid.PAD
    for lead in (0, 2):
        _, grads = langid.gradients(net, windows, target, lead)
        for value, grad, at in ((net.table, grads[0], (1, windows[2, 3], 20)), (net.table, grads[0], (0, windows[3, 0], 20)), (net.state, grads[1], (0, 2, 4)), (net.label, grads[2], (1, 2, 0)), (net.bias, grads[3], (1,))):
            old, e = value[at], 1e-4
            value[at] = old + e
            up = langid.gradients(net, windows, target, lead)[0]
            value[at] = old - e
            down = langid.gradients(net, windows, target, lead)[0]
            value[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-4


def test_windows_read_over_their_edges():
    texts = [bytes(range(1, 30)), b"", b"x", bytes(range(40, 60))]
    view, starts, owner = langid.byte_windows(texts, 10, 4)
    windows = view[starts]
    assert windows.shape == (6, 18) and owner.tolist() == [0, 0, 0, 2, 3, 3]
    for i, text in enumerate(texts):
        middle = windows[owner == i][:, 4:-4].ravel()
        assert bytes(middle[middle != langid.PAD].astype(np.uint8)) == text  # each byte once
    assert windows[1].tolist() == list(range(7, 25)) and windows[0, :4].tolist() == windows[3, :4].tolist() == [langid.PAD] * 4
    assert langid.byte_windows([], 10, 4)[1].size == langid.byte_windows([b""], 10, 4)[1].size == 0
    net = langid.Network.fresh(["a", "b"])
    changed = windows.copy()
    changed[1, 3] = changed[1, 14] = 200  # one byte beyond either edge
    seen = np.abs(net.run(windows[1:2], 4) - net.run(changed[1:2], 4)).max((1, 2))
    assert seen.shape == (10,) and seen[0] > 0 and seen[-1] > 0
    long = bytes(np.random.RandomState(1).randint(97, 123, 5000, dtype=np.uint8))
    whole = langid.softmax(net.run(np.frombuffer(long, np.uint8).astype(np.int16)[None]))[:, 0].mean(0)
    assert np.abs(langid.document_probabilities(net, [long])[0] - whole).max() < 1e-3  # as if read in one piece


# -- op10 --------------------------------------------------------------------------------------------------------------


def page(i, rng, title, paragraphs):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose(rng, "en", 5).split())
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- x --><div class="ad">{prose(rng, "de", 6)}</div><article><h1>{title}</h1>{body}</article><footer>&copy; site {i}</footer></body></html>'


def test_main_text(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(80):
        title, paragraphs = prose(rng, "en", 5), [prose(rng, "en", rng.randint(10, 60)) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"u{i}", page(i, rng, title, [p.replace(",", " &amp;\n") for p in paragraphs])))
        want[i] = "\n".join([title, *[" ".join(p.replace(",", " & ").split()) for p in paragraphs]])
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p"), (103, "u", "<<<>>> < a"), (104, "u", "<nav>only a menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("?"), "n_chars": F.lit(1)})
    got = {r["page_id"]: r for r in html.extract_main_text(df).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert [i for i in want if got[i]["text"] != want[i]] == []
    assert got[100]["text"] == got[101]["text"] == ""
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_blocks_of_hard_markup():
    text = lambda page: [b.text for b in html.page_blocks(page)]
    assert text("<p>a<b>b<br>c<p>d &lt;&#233;&gt; \xa0 e<!-- <p>x -->f") == ["ab c", "d <é> ef"]
    assert text('<a title="x > y">q</a> 1 < 2<script>"<p>no</p>"</script><style>p{}</style>') == ["q 1 < 2"]
    assert text("<ul><li>a<li>b</ul>tail<title>t<b></title>") == ["a", "b", "tail", "t<b>"]
    assert text("a &l<b>t;</b> b") == ["a &lt; b"]  # references end where their text does


STORY = ["The river was high in the spring, and the people of the town came down to look at it.", "Nobody had seen so much water before. Some of them took pictures; others just stood there.", "By the evening it had fallen again, and the road to the mill was open."]
ANSWERS = ["I was there too and it was scary!", "Great article, thanks for sharing this with us all.", "We had the same thing in our village last year."]
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOTER = "<footer><p>&copy; 2024 The Daily Page. All rights reserved.</p></footer>"


def whole(x):
    return f"<!DOCTYPE html><html><head><title>High water</title></head><body>{x}</body></html>"


#: markup that no given page has
TEMPLATES = {
    "lists and subheadings": (whole(f"{MENU}<article><h1>High water</h1><p>{STORY[0]}</p><h2>What happened</h2><p>{STORY[1]}</p><ul><li>The mill road</li><li>The old bridge</li><li>The school</li></ul><p>{STORY[2]}</p></article>{FOOTER}"),
        ["High water", STORY[0], "What happened", STORY[1], "The mill road", "The old bridge", "The school", STORY[2]]),
    "table and linked paragraph": (whole(f'{MENU}<article><h1>High water</h1><p>{STORY[0]}</p><p><a href="/map">See the map of the river and all its bridges</a></p><table><tr><th>Place</th><th>Level</th></tr><tr><td>Mill</td><td>3 m</td></tr><tr><td>Bridge</td><td>4 m</td></tr></table><p>{STORY[1]}</p></article>{FOOTER}'),
        ["High water", STORY[0], "See the map of the river and all its bridges", "Place", "Level", "Mill", "3 m", "Bridge", "4 m", STORY[1]]),
    "header inside article": (whole(f"{MENU}<article><header><h1>High water</h1></header><p>{STORY[0]}</p><p>{STORY[1]}</p></article>{FOOTER}"), ["High water", STORY[0], STORY[1]]),
    "comments under responses": (whole(f'{MENU}<article><h1>High water</h1><p>{STORY[0]}</p><p>{STORY[1]}</p></article><div class="responses"><h3>3 responses</h3>' + "".join(f"<div><b>Ann</b><p>{c}</p></div>" for c in ANSWERS) + f"</div>{FOOTER}"), ["High water", STORY[0], STORY[1]]),
    "comments under a made-up name": (whole(f'<header><a href="/">The Daily Page</a></header>{MENU}<main><h1>High water</h1><p>{STORY[0]}</p><p>{STORY[1]}</p><p>{STORY[2]}</p></main><section class="xq-talk"><h2>3 voices</h2>' + "".join(f'<div class="xq-one"><p>{c}</p></div>' for c in ANSWERS) + f"</section>{FOOTER}"), ["High water", *STORY]),
    "content div with sidebar": (whole(f'<div class="wrap"><div class="header"><h1>The Daily Page</h1></div><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="content"><h2>High water</h2><p>{STORY[0]}</p><blockquote>{STORY[1]}</blockquote><p>{STORY[2]}</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">The new mayor</a></li><li><a href="/2">A day at sea</a></li></ul></div><div class="footer">&copy; The Daily Page</div></div>'), ["High water", *STORY]),
    "newsletter inside article": (whole(f'{MENU}<article class="post"><h1>High water</h1><p>{STORY[0]}</p><div class="newsletter"><p>Get our news by mail</p><form><label>Mail</label><input><button>Send</button></form></div><p>{STORY[1]}</p><aside><p>Related: a day at sea</p></aside><p>{STORY[2]}</p></article>{FOOTER}'), ["High water", *STORY]),
    "cookie notice and form": (whole(f'<div class="cookie-banner"><p>We use cookies to make this page better for you and for us.</p><button>Accept</button></div>{MENU}<main><article><h1>High water</h1><p>{STORY[0]}</p><figure><img src="a.jpg"><figcaption>The mill at noon, seen from the bridge.</figcaption></figure><p>{STORY[1]}</p></article></main><form><label>Search</label><input><button>Go</button></form>{FOOTER}'), ["High water", STORY[0], "The mill at noon, seen from the bridge.", STORY[1]]),
    "layout table": (whole(f'<table><tr><td class="menu"><a href="/">Home</a><br><a href="/n">News</a></td><td class="content"><h1>High water</h1><p>{STORY[0]}</p><p>{STORY[1]}</p><p>{STORY[2]}</p></td></tr></table><div class="copyright">&copy; 1999 The Daily Page</div>'), ["High water", *STORY]),
    "ordered list and quote": (whole(f'{MENU}<div class="promo"><p>Buy our calendar now</p></div><main><h1>High water</h1><p>{STORY[0]}</p><ol><li>Stay away from the river.</li><li>Listen to the radio.</li></ol><blockquote><p>{STORY[1]}</p></blockquote><pre>level = 4</pre><p>{STORY[2]}</p></main><div class="share"><a href="/f">Share</a> <a href="/t">Post</a></div>{FOOTER}'), ["High water", STORY[0], "Stay away from the river.", "Listen to the radio.", STORY[1], "level = 4", STORY[2]]),
}


def test_templates_that_no_page_has(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = html.fit(pages)
    wrong = {}
    for (name, (page, want)), got in zip(TEMPLATES.items(), html.main_texts(net, [p for p, _ in TEMPLATES.values()]), strict=True):
        if got != "\n".join(want):
            wrong[name] = got
    assert not wrong
    long = TEMPLATES["lists and subheadings"][0].replace("</article>", "".join(f"<p>Line {i} of many.</p>" for i in range(9000)) + "</article>")
    text = html.main_texts(net, [long, "<p>x"])[0]
    assert text.count("\n") >= 9000 and text.endswith("Line 8999 of many.") and "All rights" not in text


def test_a_long_page_is_labelled_by_slabs_alike(monkeypatch):
    rng = random.Random(4)
    blocks = html.page_blocks(page(1, rng, "a title", [prose(rng, "en", 9) for _ in range(40)]))
    net = html.Labeller.fresh()
    want = net.run(*html.padded([html.block_vectors(blocks)]))[:, 0]
    for slab in (4096, 7):
        monkeypatch.setattr(html, "SLAB", slab)
        assert np.allclose(net.label(blocks), want, atol=1e-4)
    groups = list(html.together([5, 100, 3, 50, 9000, 50], pages=3, blocks=200))
    assert sorted(i for g in groups for i in g) == list(range(6)) and all(len(g) <= 3 for g in groups) and [4] in groups


def test_rebuilt_pages_hold_labels_of_both_kinds():
    rng, r = random.Random(4), np.random.RandomState(1)
    blocks = html.page_blocks(page(1, rng, "a title", [prose(rng, "en", 9) for _ in range(4)]))
    for b, y in zip(blocks, html.markup_label(blocks), strict=True):
        b.label = y
    seen = [html.rebuilt(blocks, r) for _ in range(60)]
    assert all(any(b.label for b in v) and not all(b.label for b in v) for v in seen)
    main = {tag for v in seen for b in v if b.label for tag, _ in b.path}
    assert {"li", "h2", "td", "blockquote", "figcaption", "a", "header", "pre"} <= main


def test_lstm_gradients_are_right():
    rng = np.random.RandomState(0)
    net = html.Labeller.fresh()
    for name in "wubvc":
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, mask, y = rng.rand(5, 3, net.w.shape[1]), np.ones((5, 3)), (rng.rand(5, 3) > 0.5) * 1.0
    mask[3:, 1] = 0
    _, grads = html.gradients(net, x, mask, y)
    for value, grad, at in ((net.w, grads[0], (0, 3, 5)), (net.u, grads[1], (0, 2, 60)), (net.b, grads[2], (1, 0, 33)), (net.v, grads[3], (1, 2)), (net.c, grads[4], (0,))):
        old, e = value[at], 1e-3
        value[at] = old + e
        up = html.gradients(net, x, mask, y)[0]
        value[at] = old - e
        down = html.gradients(net, x, mask, y)[0]
        value[at] = old
        assert abs((up - down) / (2 * e) - grad[at]) < 1e-4
