"""A hashed maximum-entropy language model with a class-factored softmax.

A word's class is a path of three digits of base 16.  The first comes from the word's form (short words by hash, longer ones
by a hash of their ending; the end of a text has a digit of its own), the others from a hash of the word.  So
P(word | history) = P(d1 | history) * P(d2 | d1, history) * P(d3 | d1, d2, history) * P(word | path), and history features
choose not only among kinds of words but, for all frequent words, the word itself.

Each of the three is a softmax over sums of hashed feature weights: the word before, the word at distance 2 (a skip), the
endings of the last two words, and those of the two before them (a skip).  A feature's row is hashed from its value and the
digits chosen so far.  P(word | path) is the word's share (c + 1) / (N_path + V_path + 1), with c, N and V counted over all
training tokens, one unit of mass a path standing for unseen words; so the factors sum to 1 over all words.

Training is by synchronous gradient updates.  The first is from all training documents: against the digit distributions
without history (the bias), what the model expects of a row needs no softmax, only how often the row was met under each
prefix.  Each later one takes a hash share of the training documents, sums what its tokens show and what the present
weights expect of each (row, digit), and moves the weights by the exponentiated-gradient step.  There are as many shares as
later updates, so every training document is learned from twice: in the first update and in one later.  Spark adds the
tasks' sums up in groups of rows.  The number of rows follows from the training bytes.

Scoring runs over blocks of documents in sparse numpy batches.  The blocks' distinct words are dealt by hash range, counted
there over the whole corpus, and their counts sent back, so no task holds the whole vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, regrouped, small_batches

DIGITS, LEVELS, USED = 16, 3, 4
PATHS = DIGITS**LEVELS
END = DIGITS - 1  # the first digit of the end of a text
LEAST_ROWS, MOST_ROWS, BYTES_A_ROW = 1 << 15, 1 << 17, 4096  # a task holds 2 * 16 sums for each row of 3 levels: 100 MB at most
TASK_BYTES = 1024  # training bytes of a task for each row, since each task sends all its sums
STEPS, CALM = (0.45, 0.25, 0.2), 1.0
ROUNDS = len(STEPS) - 1  # a share for each later update
GROUP = 512  # rows whose sums travel together
BLOCK_BYTES, BUCKET_WORDS = 8 << 20, 500_000


def rows_for(training_bytes: int) -> int:
    """Rows of the second and third level; the first has a quarter."""
    rows = LEAST_ROWS
    while rows < MOST_ROWS and rows * BYTES_A_ROW < training_bytes:
        rows *= 2
    return rows


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and one of its form: its ending if it is long, itself if it is short."""
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    given = pa.array(words, pa.binary())
    ends = pc.binary_slice(pc.ascii_rtrim(given.view(pa.string()), ".,").view(pa.binary()), -2)
    forms = pc.if_else(pc.greater(pc.binary_length(given), 3), ends, given).dictionary_encode()
    form = np.array([zlib.crc32(w) for w in forms.dictionary.to_pylist()], np.uint64)[forms.indices.to_numpy()]
    return whole, form


def word_paths(words: list[bytes], whole: np.ndarray, form: np.ndarray) -> np.ndarray:
    """(words, LEVELS) digits."""
    half = END // 2
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    mixed = _mixed(form + np.uint64(1))
    first = np.where(lengths <= 3, mixed % np.uint64(half), np.uint64(half) + mixed % np.uint64(END - half)).astype(np.int64)
    first[lengths == 0] = END
    other = _mixed(whole + np.uint64(2))
    return np.stack([first, (other >> np.uint64(8)).astype(np.int64) % DIGITS, (other >> np.uint64(16)).astype(np.int64) % DIGITS], 1)


def paths_of(words: list[bytes]) -> np.ndarray:
    """Each word's path as one number."""
    digits = word_paths(words, *word_hashes(words))
    return (digits[:, 0] * DIGITS + digits[:, 1]) * DIGITS + digits[:, 2]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Tokens:
    """The tokens of some documents: distinct words, and for each token its word, its document, and its history."""

    def __init__(self, texts: list[str | None] | pa.Array):
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        given = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(given, "")))
        closed = pc.binary_join_element_wise(given, pc.if_else(pc.equal(given, ""), "", " "), "")  # the blank makes the end: an empty last word
        split = pc.ascii_split_whitespace(closed)
        numbered = split.flatten().dictionary_encode()
        self.words = numbered.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.ids = numbered.indices.to_numpy().astype(np.int64)
        self.lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
        self.document = np.repeat(np.arange(len(texts)), self.lengths)
        self.whole, self.form = word_hashes(self.words)
        self.digits = word_paths(self.words, self.whole, self.form)
        self._place = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def _back(self, values: np.ndarray, n: int) -> np.ndarray:
        """For each token the value ``n`` places to its left in its document, or 0."""
        out = np.zeros_like(values)
        out[n:] = values[:-n]
        out[self._place < n] = 0
        return out

    def history(self) -> list[np.ndarray]:
        """The USED feature values of each token."""
        whole, form = _mixed(self.whole * np.uint64(2) + np.uint64(1))[self.ids], _mixed(self.form * np.uint64(2) + np.uint64(9))[self.ids]
        b = [self._back(form, n) for n in (1, 2, 3, 4)]
        three, seven = np.uint64(3), np.uint64(7)
        return [self._back(whole, 1) + np.uint64(1), self._back(whole, 2) ^ np.uint64(1 << 40), b[0] * three + b[1] * seven + np.uint64(2), b[2] * three + b[3] * seven + np.uint64(3)]

    def level_rows(self, number: int, part: slice | None = None, history: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level the tokens' rows (USED, tokens) within it, their digits and their prefixes.  At the last level the
        row's last digit is the second one of the path, so a row and the first digit tell the whole prefix."""
        part = part or slice(None)
        history = history or self.history()
        digits = self.digits[self.ids[part]]
        prefix = np.zeros(len(digits), np.int64)
        for level in range(LEVELS):
            salt = _mixed(prefix.astype(np.uint64) + np.uint64(1000 * level + 11))
            size = number // 4 if level == 0 else number
            rows = np.stack([(_mixed(h[part] ^ salt) & np.uint64(size - 1)).astype(np.int64) for h in history])
            if level == LEVELS - 1:
                rows = rows // DIGITS * DIGITS + digits[:, 1]
            yield rows, digits[:, level], prefix
            prefix = prefix * DIGITS + digits[:, level]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, as many as the greatest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes() + bytes([width])


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8)[:-1].reshape(data[-1], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


@dataclass
class Model:
    """``weights``: for each level (rows, DIGITS); ``bias``: for each level the log distributions (prefixes, DIGITS)."""

    weights: list[np.ndarray]
    bias: list[np.ndarray]

    def _logits(self, level: int, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        weights = self.weights[level]
        logits = self.bias[level][prefix]
        for own in rows:
            logits += weights.take(own, 0)
        return logits

    def exponentials(self, level: int, rows: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, DIGITS) proportional to the probabilities, and each token's sum.  One shift serves all tokens; those whose
        sum it leaves too small to be exact get their own."""
        powers = self._logits(level, rows, prefix)
        powers -= powers.max(initial=0.0)
        np.exp(powers, out=powers)
        ones = np.ones(DIGITS, np.float32)
        total = powers @ ones
        weak = np.flatnonzero(total < 1e-8)  # from here on a digit's 1e-30 share would be lost
        if len(weak):
            again = self._logits(level, rows[:, weak], prefix[weak])
            powers[weak] = np.exp(again - again.max(1, keepdims=True))
            total[weak] = powers[weak] @ ones
        return powers, total

    def probabilities(self, level: int, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        powers, total = self.exponentials(level, rows, prefix)
        powers /= total[:, None]
        return powers

    @property
    def rows(self) -> int:
        return len(self.weights[-1])


def level_starts(number: int) -> list[int]:
    """Where each level's rows start among all, and their number."""
    return [0, number // 4, number // 4 + number, number // 4 + 2 * number]


def first_sums(tokens: Tokens, number: int, sums: np.ndarray, paths: np.ndarray, slab: int = 65_536) -> None:
    """Add to ``sums`` (all rows, 2 * DIGITS) how often each row was met with each digit and under each first digit, and to
    ``paths`` the tokens of each path."""
    starts, history = level_starts(number), tokens.history()
    digits = tokens.digits[tokens.ids]
    paths += np.bincount((digits[:, 0] * DIGITS + digits[:, 1]) * DIGITS + digits[:, 2], minlength=PATHS)
    for at in range(0, len(tokens.ids), slab):
        first = digits[at : at + slab, 0] + DIGITS
        for level, (rows, digit, _) in enumerate(tokens.level_rows(number, slice(at, at + slab), history)):
            here = sums[starts[level] : starts[level + 1]].reshape(-1)
            rows = rows * (2 * DIGITS)
            np.add.at(here, (rows + digit).ravel(), 1.0)
            if level:
                np.add.at(here, (rows + first).ravel(), 1.0)


def later_sums(model: Model, tokens: Tokens, sums: np.ndarray, slab: int = 16_384) -> None:
    """Add to ``sums`` (all rows, 2 * DIGITS) what the tokens show and what the model expects of each (row, digit).

    Two digits' probabilities are added up as one complex number, single for a batch, which halves the additions."""
    number, history = model.rows, tokens.history()
    starts = level_starts(number)
    expected = np.zeros((starts[-1], DIGITS), np.float32)
    for at in range(0, len(tokens.ids), slab):
        for level, (rows, digit, prefix) in enumerate(tokens.level_rows(number, slice(at, at + slab), history)):
            here = slice(starts[level], starts[level + 1])
            np.add.at(sums[here].reshape(-1), (rows * (2 * DIGITS) + digit).ravel(), 1.0)
            p, total = model.probabilities(level, rows, prefix).view(np.complex64), expected[here].view(np.complex64)
            for own in rows:
                for pair in range(DIGITS // 2):
                    np.add.at(total[:, pair], own, p[:, pair])
    sums[:, DIGITS:] += expected


def bias_of(paths: np.ndarray) -> list[np.ndarray]:
    """Log distributions of each level's digit under each prefix from the token counts of all paths."""
    out = []
    for level in range(LEVELS):
        n = paths.reshape(DIGITS**level, DIGITS, -1).sum(2) + 0.1
        out.append(np.log(n / n.sum(1, keepdims=True)).astype(np.float32))
    return out


def first_expected(level: int, under: np.ndarray, shown: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What the bias alone expects of each (row, digit), from how often rows were met ``under`` each first digit."""
    p = np.exp(bias)
    if level == 0:
        return shown.sum(1, keepdims=True) * p
    if level == 1:
        return under @ p
    out = np.empty_like(shown)
    for second in range(DIGITS):
        out[second::DIGITS] = under[second::DIGITS] @ p[second::DIGITS]
    return out


_SUMS = "part int, salt int, sums binary"


def _sum_rows(sums: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    for part, at in enumerate(range(0, len(sums), GROUP)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([sums[at : at + GROUP].astype("<f4").tobytes()], pa.binary())], names=["part", "salt", "sums"])


def _first(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, paths = np.zeros((level_starts(number)[-1], 2 * DIGITS)), np.zeros(PATHS, np.int64)
        for batch in small_batches(batches, "text"):
            first_sums(Tokens(batch.column("text")), number, sums, paths)
        if paths.any():
            yield from _sum_rows(sums, TaskContext.get().partitionId() % 64)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([paths.astype("<f4").tobytes()], pa.binary())], names=["part", "salt", "sums"])

    return run


def _later(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        sums = np.zeros((level_starts(model.rows)[-1], 2 * DIGITS))
        for batch in small_batches(batches, "text"):
            later_sums(model, Tokens(batch.column("text")), sums)
        if sums.any():
            yield from _sum_rows(sums, TaskContext.get().partitionId() % 64)

    return run


def _add_up(kind: str):
    """Sums of equal (part, salt) in a partition whose rows are sorted by them; one sum at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part", "salt", "sums"])

        for batch in batches:
            for part, salt, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "sums")), strict=True):
                if key is not None and key != (part, salt):
                    yield out()
                    total = None
                key = (part, salt)
                now = np.frombuffer(sums, kind).astype(np.float64)
                total = now if total is None else total + now
        if key is not None:
            yield out()

    return run


def share(rounds: int) -> Column:
    """The share of a training document: a hash of id and text, since many ids may be null or equal."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))


def _gather(sums: DataFrame, tasks: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """All tasks' sums: (all rows, 2 * DIGITS), a size that ``MOST_ROWS`` bounds, and the tokens of each path."""
    total, paths = np.zeros((level_starts(number)[-1], 2 * DIGITS)), np.zeros(PATHS)
    kind = "<f4"
    if tasks > 64:  # first by 64 salts, then together
        sums, kind = sums.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_add_up(kind), _SUMS), "<f8"
    else:
        sums = sums.withColumn("salt", F.lit(0))
    for row in sums.repartition("part").sortWithinPartitions("part", "salt").mapInArrow(_add_up(kind), _SUMS).toLocalIterator():
        now = np.frombuffer(row["sums"], "<f8")
        if row["part"] < 0:
            paths += now
        else:
            total[row["part"] * GROUP : (row["part"] + 1) * GROUP] += now.reshape(-1, 2 * DIGITS)
    return total, paths


def _moved(weights: np.ndarray, step: float, shown: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The exponentiated-gradient step; what is seen a few times moves little."""
    return (weights + step * np.log((shown + CALM) / (expected + CALM))).astype(np.float32)


def train(training: DataFrame, steps: tuple[float, ...] = STEPS) -> Model:
    """The bias and the first update from all ``training(doc_id, text)``, each later update from one of as many hash
    shares of it; together the later updates read all of it once more."""
    spark, rounds = training.sparkSession, len(steps) - 1
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = rows_for(size)
    starts = level_starts(number)
    tasks = lambda part: int(max(spark.sparkContext.defaultParallelism, size // part // (number * TASK_BYTES)))
    sums, paths = _gather(training.select("text").coalesce(tasks(1)).mapInArrow(_first(number), _SUMS), tasks(1), number)
    bias, weights = bias_of(paths), []
    for level in range(LEVELS):
        here = sums[starts[level] : starts[level + 1]]
        shown = here[:, :DIGITS]
        weights.append(_moved(np.float32(0), steps[0], shown, first_expected(level, here[:, DIGITS:], shown, bias[level])))
    model = Model(weights, bias)
    for r, step in enumerate(steps[1:]):
        shared = spark.sparkContext.broadcast(model)  # at most 2.25 * MOST_ROWS * DIGITS floats, 19 MB
        own = training.where(share(rounds) == r).select("text").coalesce(tasks(rounds)).mapInArrow(_later(shared), _SUMS)
        sums, _ = _gather(own, tasks(rounds), number)
        parts = [sums[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        model = Model([_moved(w, step, x[:, :DIGITS], x[:, DIGITS:]) for w, x in zip(model.weights, parts, strict=True)], bias)
        shared.unpersist()
    return model


def history_scores(model: Model, tokens: Tokens, slab: int = 16384) -> np.ndarray:
    """Each document's sum of log10 P(path | history)."""
    n, history = len(tokens.lengths), tokens.history()
    out = np.zeros(n)
    for at in range(0, len(tokens.ids), slab):
        part = slice(at, at + slab)
        total = np.zeros(len(tokens.ids[part]))
        for level, (rows, digit, prefix) in enumerate(tokens.level_rows(model.rows, part, history)):
            powers, sums = model.exponentials(level, rows, prefix)
            total += np.log10(np.maximum(powers[np.arange(len(digit)), digit] / sums, 1e-30))
        out += np.bincount(tokens.document[part], total, minlength=n)
    return out


_BLOCK = "block long, doc_ids array<long>, held array<boolean>, n_tokens array<long>, history array<double>, n_words long, words binary, trained binary, times binary, ranks binary"


def _ranks(times: np.ndarray) -> np.ndarray:
    """Each word's place by falling ``times``."""
    ranks = np.empty(len(times), np.int64)
    ranks[np.argsort(-times, kind="stable")] = np.arange(len(times))
    return ranks


def _tokens_of(words: bytes, times: bytes, ranks: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a block and its tokens as places among them."""
    return words.split(b"\n"), np.argsort(_ranks(_unpacked(times).astype(np.int64)))[_unpacked(ranks).astype(np.int64)]


def _score(shared):
    """Blocks of documents -> one row a block.

    ``history`` is each document's sum of log10 P(path | history).  ``words`` are the block's distinct words in the
    order of their hash, ``trained`` how often each stands in the block's training documents, ``times`` how often in all.
    ``ranks`` are the tokens in their order, each as its word's place among the words by falling ``times``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, block = shared.value, TaskContext.get().partitionId() << 33
        for batch in regrouped(batches, "text", BLOCK_BYTES):
            tokens, held = Tokens(batch.column("text")), batch.column("held_out").to_pylist()
            history = history_scores(model, tokens)
            order = np.argsort(tokens.whole, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ids = place[tokens.ids]
            times = np.bincount(ids, minlength=len(order))
            trained = np.bincount(ids[~np.array(held)[tokens.document]], minlength=len(order)).astype("<u4")
            row = (block, batch.column("doc_id").to_pylist(), held, tokens.lengths.tolist(), history.tolist(), len(order), b"\n".join([tokens.words[i] for i in order]), trained.tobytes(), _packed(times), _packed(_ranks(times)[ids]))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])
            block += 1

    return run


def _deal_words(buckets: int):
    """A block's words -> a row for each range of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, trained in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "trained")), strict=True):
                words = words.split(b"\n")
                of = np.array([zlib.crc32(w) for w in words], np.int64) * buckets >> 32
                edges = np.searchsorted(of, np.arange(buckets + 1))
                some = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([b"\n".join(words[edges[b] : edges[b + 1]]) for b in some], pa.binary()), pa.array([trained[4 * edges[b] : 4 * edges[b + 1]] for b in some], pa.binary())],
                    names=["bucket", "block", "words", "trained"],
                )

    return run


def _count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """All blocks' words of one hash range -> each block's corpus counts, and (block -1) the sums of each path."""
    known: dict[bytes, int] = {}
    places = [np.array([known.setdefault(w, len(known)) for w in words.split(b"\n")], np.int64) for words in rows["words"]]
    total = np.bincount(np.concatenate(places), np.frombuffer(b"".join(rows["trained"]), "<u4"), minlength=len(known)).astype(np.int64)
    path = paths_of(list(known))
    n = np.bincount(path, total, minlength=PATHS).astype(np.int64)
    v = np.bincount(path, total > 0, minlength=PATHS).astype(np.int64)
    return pd.DataFrame({"block": [*rows["block"], -1], "bucket": int(rows["bucket"].iloc[0]), "counts": [*(_packed(total[p]) for p in places), None], "path_n": [*[None] * len(places), n.tolist()], "path_v": [*[None] * len(places), v.tolist()]})


def _finish(n_train: int, log_total: float, path_total: np.ndarray):
    def run(blocks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        row = blocks.iloc[0]
        words, ids = _tokens_of(row["words"], row["times"], row["ranks"])
        tokens = np.array(row["n_tokens"], np.int64)
        document, n = np.repeat(np.arange(len(tokens)), tokens), len(tokens)
        c = np.concatenate([_unpacked(x) for x in counted.sort_values("bucket")["counts"]]).astype(np.float64)
        own = lambda x: np.bincount(document, x[ids], minlength=n)
        score = own(np.log10((c + 1) / path_total[paths_of(words)])) + np.array(row["history"])
        base = own(np.log10(c + 1)) - tokens * log_total
        return pd.DataFrame({"doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": list(row["held"]), "n_tokens": tokens, "n_known": own((c > 0).astype(float)).astype(np.int64), "train_tokens": n_train, "base_score": base, "score": score})

    return run


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    The model learns from documents whose crc32 of the id as text is not 2 mod 7; such a document's score includes its own
    counts.  A null text is empty: one end token; a null id is a training document; repeated rows count and come back each;
    where nothing is left to learn from, all digits are equally likely; an empty table gives an empty result; other columns
    are ignored.  A text of any length is read whole, in one task.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    blocks = durable(rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), _BLOCK))
    words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    dealt = blocks.select("block", "words", "trained").mapInArrow(_deal_words(max(1, -(-words // BUCKET_WORDS))), "bucket int, block long, words binary, trained binary")
    counted = durable(dealt.groupBy("bucket").applyInPandas(_count_bucket, "block long, bucket int, counts binary, path_n array<long>, path_v array<long>"))
    sums = counted.where("block = -1").select(F.posexplode(F.arrays_zip("path_n", "path_v")).alias("path", "s")).groupBy("path").agg(F.sum("s.path_n").alias("n"), F.sum("s.path_v").alias("v"))
    n_path, v_path = np.zeros(PATHS), np.zeros(PATHS)
    for r in sums.collect():  # a row for each path
        n_path[r["path"]], v_path[r["path"]] = r["n"], r["v"]
    n_train = int(n_path.sum())
    finish = _finish(n_train, math.log10(n_train + v_path.sum() + 1), n_path + v_path + 1)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = counted.where("block >= 0").select(F.col("block").alias("of_block"), "bucket", "counts")
    return blocks.select("block", "doc_ids", "held", "n_tokens", "history", "words", "times", "ranks").groupBy("block").cogroup(parts.groupBy("of_block")).applyInPandas(finish, out)
