"""Byte-level BPE over a corpus: encode by tree concatenation, decode.

Short texts are encoded where they are read.  A text above ``PIECE`` code points is cut into pieces that are dealt to all
tasks and encoded in parallel; its pieces then meet in one task and are joined pairwise, as a tree, each join encoding
only a growing window again (see ``tokens``).  Only long texts are shuffled.  Ids are decoded, if asked for, by the worker that
made them, so that no task feeds one Python worker from another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, small_batches
from .tokens import Encoded, byte_ids, decode_ids

PIECE = 32_768
_IDS, _DECODED = "doc_id long, ids array<int>", ", decoded string"
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string())])
_CODED = pa.schema([*_PIECES, ("ends", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))


def _coded(docs: list[int | None], ids: list[np.ndarray], path: str, decoded: bool) -> pa.RecordBatch:
    columns = {"doc_id": pa.array(docs, pa.int64()), "ids": _lists(ids)}
    return pa.RecordBatch.from_pydict(columns | ({"decoded": pa.array([decode_ids(x.tolist(), path) for x in ids], pa.string())} if decoded else {}))


def _encode_short(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids = [byte_ids(t or "", path) for t in batch.column("text").to_pylist()]
            yield _coded(batch.column("doc_id").to_pylist(), ids, path, decoded)

    return run


def _cut(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, "text", 1):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, at in enumerate(range(0, len(text), piece)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "piece": n, "text": text[at : at + piece]}], schema=_PIECES)
                row += 1

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            coded = [Encoded.of(t, path) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECES.names), *(pa.array([getattr(c, k).tobytes() for c in coded], pa.binary()) for k in ("ends", "counts", "ids"))], schema=_CODED)

    return run


def _join_pieces(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc, stack = None, None, []  # of (height, encoding): a binary counter makes the joins a balanced tree

        def done() -> pa.RecordBatch:
            whole = stack.pop()[1]
            while stack:
                whole = stack.pop()[1].join(whole, path)
            return _coded([doc], [whole.ids], path, decoded)

        for batch in small_batches(batches, "text"):
            for x in batch.to_pylist():
                if stack and x["row"] != last:
                    yield done()
                last, doc = x["row"], x["doc_id"]
                height, now = 0, Encoded(x["text"], np.frombuffer(x["ends"], np.int64), np.frombuffer(x["counts"], np.int64), np.frombuffer(x["ids"], "<u2"))
                while stack and stack[-1][0] == height:
                    height, now = height + 1, stack.pop()[1].join(now, path)
                stack.append((height, now))
        if stack:
            yield done()

    return run


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, decoded: bool = False) -> DataFrame:
    """``doc_id, ids array<int>``: the library's ids of every whole text, without added special tokens.  With ``decoded``, also
    ``decoded string``: the text that these ids stand for.

    A special token's string in a text is that token, as the library has it.  A null text is empty (no ids); repeated
    rows come back each; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.char_length("text") > piece
    out = _IDS + _DECODED * decoded
    short = rows.where(~long).mapInArrow(_encode_short(path, decoded), out)
    fields = "row long, doc_id long, piece int, text string"
    pieces = rows.where(long).mapInArrow(_cut(piece), fields).repartition("row", "piece").mapInArrow(_encode_pieces(path), f"{fields}, ends binary, counts binary, ids binary")
    joined = pieces.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(_join_pieces(path, decoded), out)
    return short.unionAll(joined)


def decode_column(path: str):
    """A column function: ids array<int> -> text."""

    @F.pandas_udf(T.StringType())
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(x.tolist(), path) for x in ids], dtype=object)

    return run
