"""Quality rules as weak supervision.

Each rule votes good, bad or abstains from a few counts of a document.  Expectation-maximisation over all documents'
vote patterns estimates, without labels, how often each rule votes each way on good and on bad documents; a document's
posterior probability of being good replaces a filter in which every rule must pass.

The counts are taken in one pass over the texts.  The patterns are counted by Spark; with ten rules of three outcomes
there are at most 3**10 patterns, so the EM runs on a table of proven size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, durable

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_stops", "n_top_word"]
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
WINDOW = 8
DOUBT = 0.02


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside ``width``-word windows (a power of two) that occur twice or more, first occurrences included."""
    if len(ids) <= width:
        return 0
    key, step = ids, 1
    while step < width:  # the identity of a window of 2 * step words from its two halves
        pair = key[:-step] * (int(key.max()) + 1) + key[step:]
        kinds, key = np.unique(pair, return_inverse=True)
        if len(kinds) == len(pair):
            return 0
        step *= 2
    again = np.flatnonzero(np.bincount(key)[key] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``; a null text counts as empty."""
    data = (text or "").encode()
    words = data.split()  # ASCII white space only, as the contract's word pattern
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n_space = len(data) - len(data.translate(None, SPACES))
    return (
        len(words),
        len(text or "") - n_space,
        sum(data.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(data) - len(data.translate(None, UPPER)),
        len(data) - len(data.translate(None, LETTERS)),
        data.count(b"!") + data.count(b"?"),
        data.count(b".") + data.count(b"!") + data.count(b"?"),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def count_text(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS)


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (votes bad, votes good); neither: abstains."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    never = F.lit(False)
    return {
        "length": (c("n_words") < 20, c("n_words") >= 60),
        "symbols": (c("n_symbols") * 10 > words, never),
        "capitals": (c("n_upper") * 10 > c("n_letters") * 4, c("n_upper") * 10 < c("n_letters")),
        "marks": (c("n_marks") * 8 > words, never),
        "symbol_share": (c("n_symbols") * 20 > c("word_chars"), never),
        "dup_lines": (c("n_dup_lines") * 10 > c("n_lines") * 6, never),
        "repetition": (c("n_repeat_words") * 4 > words, never),
        "sentences": ((c("n_stops") == 0) & (words >= 150), c("n_stops") * 40 >= words),
        "word_length": ((c("word_chars") < words * 2) | (c("word_chars") > words * 14), never),
        "top_word": (c("n_top_word") * 4 > words, never),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"vote_{k}": F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in rules().items()})


def fit_votes(patterns: np.ndarray, n: np.ndarray, rounds: int = 60, strength: float = 20.0) -> tuple[float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) seen ``n`` times: (log prior odds, log odds by rule and vote).

    Each rule has a probability of each vote given a good and given a bad document.  ``strength`` pseudo-documents say
    that a rule votes on the right side more often than on the wrong one; they settle tables of few rows and keep the
    two classes from changing places.  The first guess doubts any document that some rule calls bad: such rules abstain
    on what they do not know, so a single bad vote says more than several good ones, which tend to come together.  For the
    same reason no rule may vote bad on good documents more than ``DOUBT`` times as often as on bad ones.
    """
    rules_n = patterns.shape[1]
    lean = np.array([[0.10, 0.35, 0.55], [0.55, 0.35, 0.10]])[:, None, :] * strength  # [good, bad] x vote -1, 0, 1
    chosen = patterns.astype(int) + 1
    good = 1 / (1 + np.exp(-(1 + 0.5 * (patterns > 0).sum(1) - 5 * (patterns < 0).sum(1))))
    prior, table = 0.5, np.zeros((2, rules_n, 3))
    for _ in range(rounds):
        weight = np.stack([n * good, n * (1 - good)])
        for v in range(3):
            table[:, :, v] = weight @ (chosen == v)
        table = table + lean
        table /= table.sum(2, keepdims=True)
        excess = np.maximum(table[0, :, 0] - DOUBT * table[1, :, 0], 0)  # a rule that says bad is at least this sure of it
        table[0, :, 0] -= excess
        table[0, :, 1] += excess
        prior = (weight[0].sum() + 2) / (n.sum() + 4)
        odds = np.log(table[0]) - np.log(table[1])
        score = math.log(prior / (1 - prior)) + odds[np.arange(rules_n), chosen].sum(1)
        good = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    return math.log(prior / (1 - prior)), odds


def quality_model(votes: DataFrame) -> Column:
    """The posterior probability of a good document, as an expression over the vote columns."""
    names = [f"vote_{k}" for k in rules()]
    seen = votes.groupBy(*names).count().toPandas()  # at most 3**10 rows
    if seen.empty:
        return F.lit(0.5)
    bias, odds = fit_votes(seen[names].to_numpy(), seen["count"].to_numpy(float))
    score = F.lit(bias)
    for name, (bad, none, good) in zip(names, odds.tolist(), strict=True):
        score = score + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-score))


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: its counts, votes, ``quality`` (posterior of being good), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30% of the words in repeated 8-word windows; such a document is not
    kept.  The others are kept if ``quality >= threshold``.  A null or empty text has zero counts and fails; repeated
    rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col(id_col).alias("doc_id"), count_text(F.col(text_col)).alias("c")).select("doc_id", "c.*")
    votes = durable(with_votes(counted))
    judged = votes.withColumns({"quality": quality_model(votes), "base_failed": base_failed()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``judge_quality`` would not keep, all columns unchanged.

    Every text is counted once: whole rows and their counts go to a table in the shared folder, the rules are fitted to
    its counts alone, and its rows are filtered by them.  A null or empty text goes; repeated rows are judged alike; an
    empty table gives an empty result; columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    inner = "_tidemark_row"
    counted = durable(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(inner), count_text(docs[text_col]).alias("_c")))
    quality = quality_model(with_votes(counted.select("_c.*")))
    return with_votes(counted.select(inner, "_c.*")).where(~base_failed() & (quality >= threshold)).select(f"{inner}.*")
