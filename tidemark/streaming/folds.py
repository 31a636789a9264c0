"""The session fold over buckets of sessions: what ``live.SessionFold`` and ``live.WatchedFold`` do for one session a call, done
for all sessions of a bucket at once in columns, since a call, its timers and its state cost far more than an event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import MINUTE_MS
from ..plans.config import DEFAULT, Rules

NONE = -1
BLOB = T.StructType([T.StructField("rows", T.BinaryType())])  # rows in Arrow's IPC format
_LONGS = ("fg", "playing", "ended", "last_ms", "seen_ms", "run_last", "until", "folded", "handed")
#: a row a session: its dimensions as JSON, gates, last event and open run (valid if ``folded``), the time up to which it is
#: folded, and whether it was handed over
KNOWN = pa.schema([("session", pa.string()), ("dims", pa.string()), *((c, pa.int64()) for c in _LONGS)])
#: a row an event that the watermark has not passed
WAITING = pa.schema([("session", pa.string()), ("dims", pa.string()), ("event_ms", pa.int64()), ("tie_break", pa.int64()), ("event_id", pa.int64())])
#: ``minute`` and ``delta_sessions`` are null in the row of a late session
SAID = "session string, dims string, minute long, delta_sessions long, late boolean"


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as rows:
        return rows.read_all()


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    return {c: rows[c].to_numpy() for c in rows.column_names}


def _carried(told: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last value told (-1: none) so far in each stretch that begins at ``first``, ``before`` where none was."""
    known = np.where(first & (told < 0), before, told)
    return known[np.maximum.accumulate(np.where(known >= 0, np.arange(len(known)), 0))]


class BucketFold(StatefulProcessor):
    """T3, T4, T5, T8 for a bucket of sessions; a timer stands for whatever is due next in the bucket.

    ``watched``: late events hand their session over (``late``); otherwise they are dropped.  An event is late if it isn't
    after the time up to which its session is folded, or, for a session that isn't known, after the watermark.
    """

    def __init__(self, rules: Rules = DEFAULT, evict_ms: int = 86_400_000, watched: bool = False):
        if not rules.use_liveness:
            raise ValueError("without the liveness gate a run has no end that a watermark could show")
        self.rules, self.evict_ms, self.watched = rules, evict_ms, watched
        self.code = {signal: n for n, signal in enumerate(rules.tie_order, 1)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("sessions", BLOB)
        self.pending = handle.getValueState("pending", BLOB)

    def close(self) -> None:
        pass

    # -- state ---------------------------------------------------------------------------------------------------------

    def _held(self, state, schema: pa.Schema) -> pa.Table:
        return unpacked(bytes(state.get()[0])) if state.exists() else schema.empty_table()

    def _keep(self, state, rows: pa.Table, before: bool) -> None:
        if rows.num_rows:
            state.update((packed(rows),))
        elif before:
            state.clear()

    # -- folding -------------------------------------------------------------------------------------------------------

    def _is(self, tie: np.ndarray, *signals: str) -> np.ndarray:
        return np.isin(tie, [self.code[s] for s in signals])

    def _counted(self, fg: np.ndarray, playing: np.ndarray, ended: np.ndarray) -> np.ndarray:
        counted = ended == 0
        if self.rules.use_fg:
            counted = counted & (fg == 1)
        return counted & (playing == 1) if self.rules.use_playing else counted

    def _fold(self, s: dict, at: np.ndarray, ms: np.ndarray, tie: np.ndarray, out: list) -> None:
        """Fold events in order; ``at`` is the session of each, and those of a session lie together."""
        n = len(at)
        first = np.r_[True, at[1:] != at[:-1]]
        last = np.r_[first[1:], True]
        policy = self.rules.error_policy
        stops = ("PAUSE", "ERR") if policy == "inactive" else ("PAUSE",)
        ends = self._is(tie, "END", "ERR") if policy == "terminal" else self._is(tie, "END")
        fg = _carried(np.where(self._is(tie, "FG"), 1, np.where(self._is(tie, "BG"), 0, -1)), first, s["fg"][at])
        playing = _carried(np.where(self._is(tie, "PLAY", "RESUME"), 1, np.where(self._is(tie, *stops), 0, -1)), first, s["playing"][at])
        began = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        so_far = np.cumsum(ends)
        ended = s["ended"][at] + so_far - (so_far - ends)[began]
        counted = self._counted(fg, playing, ended)
        # the minutes since the event before, and the event's own, in order: two stretches an event
        was = np.where(first, self._counted(s["fg"], s["playing"], s["ended"])[at], np.r_[False, counted[:-1]])
        was_ms = np.where(first, s["last_ms"][at], np.r_[NONE, ms[:-1]])
        valid = np.column_stack([was & (was_ms != NONE), counted]).ravel()
        starts = np.column_stack([was_ms, ms]).ravel()[valid] // MINUTE_MS
        stops_at = np.column_stack([np.minimum(ms, was_ms + self.rules.timeout_ms), ms]).ravel()[valid] // MINUTE_MS
        self._occupy(s, np.repeat(at, 2)[valid], starts, stops_at, out)
        here = at[last]
        s["fg"][here], s["playing"][here], s["ended"][here] = fg[last], playing[last], ended[last]
        s["last_ms"][here] = s["seen_ms"][here] = ms[last]
        s["folded"][here] = 1

    def _occupy(self, s: dict, at: np.ndarray, starts: np.ndarray, stops: np.ndarray, out: list) -> None:
        """These minutes are active: extend the sessions' open runs, or close them and open others."""
        if not len(at):
            return
        first = np.r_[True, at[1:] != at[:-1]]
        last = np.r_[first[1:], True]
        opened = s["run_last"][at]
        # sessions and minutes in one number, so that the maximum starts anew with each session
        base = at.astype(np.int64) << 40
        upto = np.maximum.accumulate(base + np.where(first, np.maximum(stops, opened), stops)) - base
        before = np.where(first, opened, np.r_[NONE, upto[:-1]])
        fresh = (before == NONE) | (starts > before + 1)
        closed = fresh & (before != NONE)
        out += [(at[closed], before[closed] + 1, -1), (at[fresh], starts[fresh], 1)]
        s["run_last"][at[last]] = upto[last]

    def _due(self, s: dict) -> np.ndarray:
        """When the open runs are final, or else when the sessions are forgotten."""
        silent = np.where((s["last_ms"] != NONE) & self._counted(s["fg"], s["playing"], s["ended"]), (s["last_ms"] + self.rules.timeout_ms) // MINUTE_MS, NONE)
        s["silent"] = silent
        return np.where(s["run_last"] == NONE, s["seen_ms"] + self.evict_ms, (np.maximum(silent, s["run_last"]) + 2) * MINUTE_MS)

    def _advance(self, rows: list[pa.Table], watermark: int) -> Iterator[pd.DataFrame]:
        """Take ``rows`` in, fold what the watermark has passed, close what is final, and set the timer for what is next."""
        known, pending = self._held(self.known, KNOWN), self._held(self.pending, WAITING)
        held = known.num_rows, pending.num_rows
        w = _columns(pa.concat_tables([pending, *rows]))
        fresh = np.arange(len(w["event_ms"])) >= held[1]
        s = _columns(known)
        code, names = pd.factorize(np.concatenate([s["session"], w["session"]]), use_na_sentinel=False)
        at, more = code[held[0] :], len(names) - held[0]  # known sessions come first, each once
        new = {"fg": self.rules.fg_default, "playing": self.rules.playing_default, "last_ms": NONE, "seen_ms": NONE, "run_last": NONE, "until": watermark}
        s = {c: np.concatenate([s[c], np.full(more, new.get(c, 0), np.int64)]) for c in _LONGS}
        s["dims"] = np.concatenate([_columns(known)["dims"], np.full(more, None, object)])
        out: list[tuple] = []
        touched = np.zeros(len(names), bool)
        touched[at[fresh]] = True
        late = self._late(s, w, at, fresh, touched, watermark)
        keep = s["handed"][at] == 0
        if not self.watched:
            keep &= ~fresh | (w["event_ms"] > s["until"][at])
        order = np.flatnonzero(keep)
        order = order[np.lexsort((w["event_id"][order], w["tie_break"][order], w["event_ms"][order], at[order]))]
        ready = w["event_ms"][order] <= watermark
        now, rest = order[ready], order[~ready]
        if len(now):
            touched[at[now]] = True
            begun = now[np.r_[True, at[now][1:] != at[now][:-1]]]  # the first events of those that aren't folded pin their dimensions
            begun = begun[s["folded"][at[begun]] == 0]
            s["dims"][at[begun]] = w["dims"][begun]
            self._fold(s, at[now], w["event_ms"][now], w["tie_break"][now], out)
        final = (s["folded"] == 1) & (s["run_last"] != NONE) & (watermark >= self._due(s))
        ended = np.flatnonzero(final)
        out.append((ended, np.maximum(s["run_last"], s["silent"])[ended] + 1, -1))
        s["run_last"][ended] = s["last_ms"][ended] = NONE  # the gates stay until the session is forgotten
        due = self._due(s)
        forgotten = (s["folded"] == 1) & (s["run_last"] == NONE) & (watermark >= due)
        yield from self._said(s, names, late, out)
        for c, value in {**new, "ended": 0, "folded": 0}.items():
            if c != "until":
                s[c][forgotten] = value
        s["until"][(touched | final | forgotten) & (s["handed"] == 0)] = watermark
        self._store(s, names, w, at, rest, due, watermark, held)

    def _late(self, s: dict, w: dict, at: np.ndarray, fresh: np.ndarray, touched: np.ndarray, watermark: int) -> np.ndarray:
        """Hand the sessions of late events over; they stay so until ``evict_ms`` after their last event."""
        if not self.watched:
            return np.zeros(0, np.int64)
        ms, own = w["event_ms"][fresh], at[fresh]
        oldest, newest = np.full(len(touched), np.iinfo(np.int64).max), np.full(len(touched), watermark)
        np.minimum.at(oldest, own, ms)
        np.maximum.at(newest, own, ms)
        late = touched & ((s["handed"] == 1) | (oldest <= s["until"]))
        s["until"][late] = np.maximum(newest + self.evict_ms, np.where(s["handed"] == 1, s["until"], NONE))[late]
        s["handed"][late], s["folded"][late] = 1, 0
        s["handed"][(s["handed"] == 1) & ~touched & (s["until"] <= watermark)] = 2  # their time is over
        return np.flatnonzero(late)

    def _said(self, s: dict, names: np.ndarray, late: np.ndarray, out: list[tuple]) -> Iterator[pd.DataFrame]:
        at = np.concatenate([late, *[a for a, _, _ in out]]).astype(np.int64)
        if not len(at):
            return
        minute = np.concatenate([np.zeros(len(late), np.int64), *[m for _, m, _ in out]])
        delta = np.concatenate([np.zeros(len(late), np.int64), *[np.full(len(a), d, np.int64) for a, _, d in out]])
        marked = np.arange(len(at)) < len(late)
        dims = s["dims"][at]
        dims[marked] = None
        yield pd.DataFrame({"session": names[at], "dims": dims, "minute": pd.arrays.IntegerArray(minute, marked), "delta_sessions": pd.arrays.IntegerArray(delta, marked), "late": marked})

    def _store(self, s: dict, names: np.ndarray, w: dict, at: np.ndarray, rest: np.ndarray, due: np.ndarray, watermark: int, held: tuple[int, int]) -> None:
        waits = np.zeros(len(names), bool)
        waits[at[rest]] = True
        folded, handed = s["folded"] == 1, s["handed"] == 1
        stay = np.flatnonzero(folded | handed | waits)
        rows = {"session": pa.array(names[stay], pa.string()), "dims": pa.array(s["dims"][stay], pa.string()), **{c: s[c][stay] for c in _LONGS}}
        self._keep(self.known, pa.table(rows, KNOWN), held[0] > 0)
        self._keep(self.pending, pa.table({f.name: pa.array(w[f.name][rest], f.type) for f in WAITING}, WAITING), held[1] > 0)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        next_at = [part.min() for part in (w["event_ms"][rest], due[folded], s["until"][handed]) if len(part)]
        if next_at:
            self.handle.registerTimer(int(max(min(next_at), watermark + 1)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pa.table({f.name: pa.array(part[f.name], f.type, from_pandas=True) for f in WAITING}, WAITING) for part in rows]
        yield from self._advance(parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())
