"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Text is read in windows of bytes, many windows at once.  Each direction keeps a small gated recurrent state (piecewise
linear gates, so that a step is a table lookup, a small matrix product and clips); both states label every byte, and a
document's probabilities are the mean over its bytes.  A window labels 192 bytes, in training and prediction alike, and
reads 32 more on either side, so that the states of both directions come into it from the text around.  Training is backpropagation through time in numpy on the whole texts of a bounded sample of labelled
documents; prediction runs over whole texts inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import bounded_batches

HIDDEN, PAD = 8, 256
WINDOW = 192  # bytes labelled by one window
LEAD = 32  # bytes read before and after them
PER_LANGUAGE = 120  # labelled documents of each language that the network is trained on


@dataclass
class Network:
    """``table`` (2, 257, 3H): each byte's input to update gate, reset gate and candidate, biases and gate scale folded
    in; ``state`` (2, H, 3H); ``label`` (2, H, L) and ``bias`` (L).  Direction 1 reads backwards."""

    languages: list[str]
    table: np.ndarray
    state: np.ndarray
    label: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 5) -> Network:
        rng, h = np.random.RandomState(seed), HIDDEN
        table = rng.normal(0, 0.5, (2, PAD + 1, 3 * h))
        table[:, :, : 2 * h] = table[:, :, : 2 * h] * 0.25 + 0.5
        return cls(languages, *(x.astype(np.float32) for x in (table, rng.normal(0, 0.3, (2, h, 3 * h)), rng.normal(0, 0.3, (2, h, len(languages))), np.zeros(len(languages)))))

    def run(self, windows: np.ndarray, lead: int = 0, keep: bool = False):
        """``windows`` (B, T) of byte codes -> logits (T - 2 lead, B, L) of all but the ``lead`` first and last; with ``keep``
        also what backpropagation needs."""
        b, t = windows.shape
        h = HIDDEN
        both = np.stack([windows.T, windows.T[::-1]])  # (2, T, B)
        states = np.zeros((t + 1, 2, b, h), np.float32)
        held = []
        for i in range(t):
            x = np.stack([self.table[0].take(both[0, i], 0), self.table[1].take(both[1, i], 0)])
            before = states[i]
            u = before @ self.state
            gates = np.clip(x[..., : 2 * h] + u[..., : 2 * h], 0, 1)
            raw = x[..., 2 * h :] + gates[..., h:] * u[..., 2 * h :]
            new = np.clip(raw, -1, 1)
            states[i + 1] = new + gates[..., :h] * (before - new)
            if keep:
                held.append((x, u, gates, raw, new))
        forward, backward = (s[lead : t - lead] for s in (states[1:, 0], states[1:, 1][::-1]))
        logits = forward @ self.label[0] + backward @ self.label[1] + self.bias
        return (logits, both, states, held) if keep else logits


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, target: np.ndarray, lead: int = 0) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of the label of every byte but padding and the ``lead`` first and last, and its gradient by
    backpropagation through time."""
    logits, both, states, held = net.run(windows, lead, keep=True)
    h, t = HIDDEN, windows.shape[1]
    own = slice(lead, t - lead)
    real = (windows.T[own] != PAD)[..., None]
    real = real / max(1, real.sum())
    p = softmax(logits)
    rows = np.arange(len(target))
    loss = float(-(np.log(p[:, rows, target] + 1e-9) * real[..., 0]).sum())
    d = p.copy()
    d[:, rows, target] -= 1
    d = (d * real).astype(np.float32)
    seen = np.stack([states[1:, 0], states[1:, 1][::-1]])[:, own]  # (2, T - 2 lead, B, H)
    d_label = np.stack([np.tensordot(s, d, ((0, 1), (0, 1))) for s in seen])
    d_bias = d.sum((0, 1))
    d_states = np.zeros_like(states[1:])  # (T, 2, B, H) in reading order
    d_states[own, 0], d_states[own, 1] = d @ net.label[0].T, (d @ net.label[1].T)[::-1]
    d_table, d_state = np.zeros_like(net.table), np.zeros_like(net.state)
    carry = np.zeros_like(states[0])
    for i in range(t - 1, -1, -1):
        _, u, gates, raw, new = held[i]
        before, g = states[i], d_states[i] + carry
        z, r = gates[..., :h], gates[..., h:]
        d_raw = g * (1 - z) * (np.abs(raw) < 1)
        d_z = g * (before - new) * ((z > 0) & (z < 1))
        d_r = d_raw * u[..., 2 * h :] * ((r > 0) & (r < 1))
        d_x = np.concatenate([d_z, d_r, d_raw], -1)
        d_u = np.concatenate([d_z, d_r, d_raw * r], -1)
        d_state += before.transpose(0, 2, 1) @ d_u
        carry = g * z + d_u @ net.state.transpose(0, 2, 1)
        for k in range(2):
            np.add.at(d_table[k], both[k, i], d_x[k])
    return loss, [d_table, d_state, d_label, d_bias]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], *, lead: int = 0, epochs: int = 5, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over shuffled batches of windows."""
    net = Network.fresh(languages, seed)
    values = [net.table, net.state, net.label, net.bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    rng, step = np.random.RandomState(seed), 0
    total = epochs * -(-len(target) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            _, grads = gradients(net, windows[pick], target[pick], lead)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            now = rate * (1 - step / (total + 1))
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def byte_windows(texts: list[bytes], size: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A view of all stretches of ``size + 2 lead`` bytes, the places in it of the windows, and the text that each is of.

    The middles of a text's windows are its bytes, each once; what lies beyond the text is ``PAD``.
    """
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(counts * size + 2 * lead)]).astype(np.int64)
    flat = np.full(max(int(begins[-1]), size + 2 * lead), PAD, np.int16)
    for text, at in zip(texts, begins, strict=False):
        flat[at + lead : at + lead + len(text)] = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.lib.stride_tricks.sliding_window_view(flat, size + 2 * lead), begins[owner] + place * size, owner


def document_probabilities(net: Network, texts: list[bytes], block: int = 1024) -> np.ndarray:
    """(documents, languages): the mean of the label probabilities of every byte."""
    total = np.zeros((len(texts), len(net.languages)))
    view, starts, owner = byte_windows(texts, WINDOW, LEAD)
    for at in range(0, len(starts), block):
        part = view[starts[at : at + block]]
        p = softmax(net.run(part, LEAD)) * (part.T[LEAD:-LEAD] != PAD)[..., None]
        np.add.at(total, owner[at : at + block], p.sum(0))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_documents(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> pd.DataFrame:
    """``lang`` and ``data`` (UTF-8) of at most ``per_language`` different labelled documents of each language outside the
    held-out part: those with the least hashes of id and text.

    The number of different documents of each language gives a hash threshold that about three times the sample passes, so
    a language with any share of the rows moves no more than that.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("data"))
    share = 3.0 * per_language / F.approx_count_distinct("h", 0.02)
    most = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    limits = rows.groupBy("lang").agg(most.alias("most"))  # one row for each language, as the network has outputs
    few = rows.join(F.broadcast(limits), "lang").where(F.col("h") <= F.col("most"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = few.select("lang", "h").distinct().withColumn("n", place).where(F.col("n") <= per_language).drop("n")
    return few.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("data").alias("data")).orderBy("lang", "h").toPandas()


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """A network trained on the sample, or None if nothing is labelled."""
    bounded_batches(docs.sparkSession)
    seen = sample_documents(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language)
    if seen.empty:
        return None
    languages = sorted(seen["lang"].unique())
    view, starts, owner = byte_windows([bytes(w) for w in seen["data"]], WINDOW, LEAD)
    target = seen["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()[owner]
    return train(view[starts], target, languages, lead=LEAD)


def predict_column(net: Network | None):
    """text -> struct(lang_pred, score); ``und`` and 0 for a null text, a text without a letter, or no network."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if net and t is not None and any(map(str.isalpha, t))]
            at = 0
            while at < len(known):  # a few megabytes of text at once
                part, held = [], 0
                while at < len(known) and held < 2 << 20:
                    part.append(known[at])
                    held += len(texts.iloc[known[at]])
                    at += 1
                p = document_probabilities(net, [texts.iloc[i].encode() for i in part])
                for i, best, row in zip(part, p.argmax(1), p, strict=True):
                    lang[i], score[i] = net.languages[best], float(min(1.0, row[best]))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return run


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``.  The network learns from text and language of documents not held out.

    A null or letterless text is ``und`` with score 0; without any label all are; a null id is not held out; repeated
    rows come back each; an empty table gives an empty result; other columns are ignored.
    """
    net = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    p = predict_column(net)(F.col(text_col)).alias("p")
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), p).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, *, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those whose language is ``und`` or scores below ``least``; all columns unchanged, whatever their names.

    Null and letterless texts go; repeated rows and rows of null id are judged by their text each; without any label all go;
    an empty table stays empty.
    """
    net = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    row = "_tidemark_row"
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), predict_column(net)(docs[text_col]).alias("p"))
    return whole.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= least)).select(f"{row}.*")
