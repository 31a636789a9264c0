r"""Chat formatting with a grammar round trip.

Grammar (one space stands inside every marker pair):

    turn      := "<<SYS>> " body " <</SYS>>"          role system
               | "[INST] " body " [/INST]"            role user
               | "<s> " body " </s>"                  role assistant
               | "[ROLE] " body " [/ROLE][TEXT] " body " [/TEXT]"     any other role
    body      := any characters; an unescaped marker is an error; "\" before "\", "<" or "[" stands for that character

Each turn is rendered, parsed again by the deterministic parser and compared with its source.  It starts unescaped; while
the comparison fails, more is escaped: first the markers and the backslashes that would be read as escapes, then every
"\", "<" and "[".  The last level always comes back identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_out

PAIRS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "role": ("[ROLE] ", " [/ROLE]"), "text": ("[TEXT] ", " [/TEXT]")}
_MARKS = "|".join(re.escape(m.strip()) for pair in PAIRS.values() for m in pair)
_CONFLICT = re.compile(rf"{_MARKS}|\\(?=[\\<\[])")
_ANY = re.compile(r"[\\<\[]")
_TOKEN = re.compile(rf"\\[\\<\[]|{_MARKS}")
_UNESCAPE = re.compile(r"\\([\\<\[])")
ESCAPES = (lambda text: text, lambda text: _CONFLICT.sub(r"\\\g<0>", text), lambda text: _ANY.sub(r"\\\g<0>", text))


def unescape(body: str) -> str:
    return _UNESCAPE.sub(r"\1", body)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The (role, text) turns of a rendered conversation, or None if it isn't of the grammar."""
    openers = {pair[0].strip(): kind for kind, pair in PAIRS.items()}
    turns, at, role, open_kind, start = [], 0, None, None, 0
    for found in _TOKEN.finditer(rendered):
        mark = found[0]
        if mark[0] == "\\":
            if open_kind is None:
                return None
            continue
        if open_kind is None:
            open_kind = openers.get(mark)
            if open_kind is None or found.start() != at or (open_kind == "text") != (role is not None):
                return None
            start = at + len(PAIRS[open_kind][0])
        else:
            end = found.start() - 1
            if mark != PAIRS[open_kind][1].strip() or end < start or rendered[end] != " " or rendered[start - 1] != " ":
                return None
            body = unescape(rendered[start:end])
            if open_kind == "role":
                role = body
            else:
                turns.append((open_kind if role is None else role, body))
                role = None
            open_kind, at = None, found.end()
    return turns if open_kind is None and role is None and at == len(rendered) else None


def render_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, start and length of its loss span, escape level); the loss span is an assistant's body."""
    for level, escape in enumerate(ESCAPES):
        body = escape(text)
        if role in ("system", "user", "assistant"):
            before, after = PAIRS[role]
        else:
            before, after = f"{PAIRS['role'][0]}{escape(role)}{PAIRS['role'][1]}{PAIRS['text'][0]}", PAIRS["text"][1]
        rendered = f"{before}{body}{after}"
        if parse(rendered) == [(role, text)]:
            return rendered, len(before), len(body) if role == "assistant" else 0, level
    raise AssertionError("escaping every marker character always parses back")


FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64()), ("escape_level", pa.int32())])
PARSED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("in_loss", pa.bool_()), ("chars", pa.int64())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in FORMATTED}
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            for name, value in zip(out, (conv, turn, *render_turn(role or "", text or "")), strict=True):
                out[name].append(value)
        yield rows_out(FORMATTED, out)


def _parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece parsed, and what its loss span shows compared with the parsed text."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in PARSED}
        for conv, turn, rendered, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "rendered", "loss_start", "loss_length")), strict=True):
            turns = parse(rendered)
            if turns is None or len(turns) != 1:
                raise ValueError("a formatted piece is not of the grammar")
            role, text = turns[0]
            in_loss = role == "assistant"
            if unescape(rendered[start : start + length]) != (text if in_loss else ""):
                raise ValueError("a loss span is not the assistant's text")
            for name, value in zip(out, (conv, turn, role, text, in_loss, len(rendered)), strict=True):
                out[name].append(value)
        yield rows_out(PARSED, out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed turns in order -> one digest for each conversation; only running hashes and sums are held."""

    def row(conv, n, turns, loss_n, loss, chars):
        return rows_out(DIGEST, dict(zip(DIGEST.names, ([conv], [n], [turns.hexdigest()], [loss_n], [loss.hexdigest()], [chars]), strict=True)))

    state = None
    for batch in batches:
        for conv, role, text, in_loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "in_loss", "chars")), strict=True):
            if state is None or state[0] != conv:
                if state:
                    yield row(*state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[2].update(f"{role}\n{text}\n".encode())
            if in_loss:
                state[4].update(text.encode())
                state[3] += len(text)
            state[1] += 1
            state[5] += chars
    if state:
        yield row(*state)


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> one row per turn with its rendered piece and loss span, in the input's order.

    A conversation's formatted text is its pieces joined by turn (``in_order``); ``loss_start`` and ``loss_length`` are code
    points of the piece.  Turns are rendered where they lie, so a huge conversation is many tasks' work.  A null text or role
    is empty; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text"))
    return rows.mapInArrow(_format, "conv_id long, turn long, rendered string, loss_start long, loss_length long, escape_level int")


def in_order(formatted: DataFrame) -> DataFrame:
    """The pieces of each conversation behind each other in one partition, by turn (null first), ties by the piece."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask read from ``format_chat``'s rows, one row per conversation.

    Pieces are parsed where they lie; the digests alone need the order: by turn (null first), then role and text; repeated
    rows stay, null ids form one conversation.  A conversation streams through one task, which holds running hashes only.
    """
    parsed = formatted.mapInArrow(_parse_pieces, "conv_id long, turn long, role string, text string, in_loss boolean, chars long")
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
measured AS (
  SELECT *, [len(regexp_extract_all(x, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[TEXT\]|\[/TEXT\]'))
      + len(list_filter(range(1, length(x)), lambda i: substr(x, i, 1) = '\' AND substr(x, i + 1, 1) IN ('\', '<', '['))) FOR x IN [role, text]] AS escapes
  FROM c),
sized AS (
  SELECT *, length(text) + escapes[2] + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
    ELSE 30 + length(role) + CASE WHEN escapes[1] + escapes[2] = 0 THEN 0 ELSE escapes[1] END END AS chars
  FROM measured)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
