"""What streams remember per key, in Spark's own keyed state.

Each function makes the step for one key in one micro-batch: the rows in, the state that Spark
keeps, restores from its checkpoint and expires, and the rows out.  Steps decide only what
needs memory; ranking, counting and joining stay with the DataFrames before and after them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd

from textorbit.operators.replay import Rules

Step = Callable[[Any, Iterator[pd.DataFrame], Any], Iterator[pd.DataFrame]]

HEALTH = "status string, failures long, last_ok_seq long, seq long"
HEALTH_OUT = (
    "seq long, healthy boolean, check_failed boolean, restarted boolean, restart_failed boolean,"
    " failures long, status string, last_ok_seq long, late boolean"
)


def _frame(key: tuple, name: str, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})
    frame.insert(0, name, [key[0]] * len(rows))
    return frame


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of the key in this batch, sorted; the trigger bounds how many they are."""
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(by, kind="stable", ignore_index=True)


def _sorted_rows(frames: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> list[tuple]:
    """The ``columns`` of ``_ordered`` rows.

    A key has few rows in a batch and there are many keys, so putting pandas frames together would take longer than
    the step itself.  Only columns with nulls, which pandas holds otherwise, need its order.
    """
    frames = list(frames)
    names = [*by, *(c for c in columns if c not in by)]
    lists = [[frame[c] for c in names] for frame in frames]
    plain = all(c.dtype.kind in "ib" or (c.dtype.kind not in "fM" and None not in (v := c.tolist()) and all(isinstance(x, str) for x in v)) for f in lists for c in f)
    if not plain:
        rows = _ordered(iter(frames), by)
        return list(zip(*(rows[c].tolist() for c in columns), strict=True))
    rows = [row for f in lists for row in zip(*(c.tolist() for c in f), strict=True)]
    rows.sort(key=lambda row: row[: len(by)])
    at = [names.index(c) for c in columns]
    return [tuple(row[i] for i in at) for row in rows]


def health(instance: str, rules: Rules) -> Step:
    """Replays health checks (instance, seq, healthy, restart_ok, start_status) from the last one's state.

    A check whose number isn't above the last one's is late: it is given out with ``late`` and
    the state that holds, and changes nothing.
    """
    columns = [c.split()[0] for c in HEALTH_OUT.split(", ")]

    def step(key, frames, state):
        rows = _ordered(frames, ["seq", "healthy", "restart_ok"])
        known = state.get if state.exists else (rows["start_status"].iloc[0], 0, None, None)
        status, failures, last_ok, last = known
        out = []
        for seq, healthy, restart_ok in zip(rows["seq"].tolist(), rows["healthy"], rows["restart_ok"], strict=True):
            event, late = 0, last is not None and seq <= last
            if not late:
                last, last_ok = seq, seq if healthy else last_ok
                status, failures, event = rules.after(status, failures, bool(healthy), bool(restart_ok))
            out.append((seq, healthy, event > 0, event == 2, event == 3, failures, status, last_ok, late))
        state.update((status, failures, last_ok, last))
        yield _frame(key, instance, out, columns)

    return step


MEMBERSHIP = "seq long, member boolean"


def membership(remember_ms: int | None) -> Step:
    """Keeps the members by name, and the last number of a name that left, for ``remember_ms`` if given.

    Gives out (name, seq) for each leave of a member.  Events (name, seq, kind) are taken by number; one
    that isn't above the last known number of its name changes nothing.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, member = state.get if state.exists else (None, False)
        left = []
        for seq, kind in _sorted_rows(frames, ["seq", "kind"], ["seq", "kind"]):
            if last is not None and seq <= last:
                continue
            if member and kind != "added":
                left.append((seq,))
            last, member = seq, kind == "added"
        state.update((last, member))
        if not member and remember_ms is not None:
            state.setTimeoutDuration(remember_ms)
        if left:
            yield pd.DataFrame({"name": [key[0]] * len(left), "seq": [seq for (seq,) in left]})

    return step


TARGET = "target string, until long"


def first_target(remember_ms: int | None) -> Step:
    """The first message's target holds for all of a stream; after ``remember_ms``, if given, it is forgotten.

    Messages are (stream_id, seq, target, message); gives out (stream_id, message, bound_target).
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            target, until = state.get
        else:
            rows = _ordered(frames, ["seq", "target"])
            frames = [rows]
            target = rows["target"].iloc[0]
            until = None if remember_ms is None else state.getCurrentProcessingTimeMs() + remember_ms
            state.update((target, until))
        if until is not None:
            state.update((target, until))
            state.setTimeoutDuration(max(1, until - state.getCurrentProcessingTimeMs()))
        for frame in frames:
            yield pd.DataFrame({"stream_id": key[0], "message": frame["message"], "bound_target": target})

    return step


STARTING = "started long, due long"


def start_timeout(instance: str, event_time: bool) -> Step:
    """Gives out starts that nothing ended within their limit: (instance, started, failed).

    Rows are (instance, at, limit, starts, ends), in microseconds.  An event that comes after the limit
    doesn't undo the timeout, whichever of event and timer is handled first.
    """

    def step(key, frames, state):
        pending, out = state.get if state.exists else None, []
        if state.hasTimedOut:
            state.remove()
            yield _frame(key, instance, [pending], ["started", "failed"])
            return
        for at, limit, starts, ends in _sorted_rows(frames, ["at", "ends", "starts"], ["at", "limit", "starts", "ends"]):
            if pending and at > pending[1]:
                out.append(pending)
                pending = None
            if starts:
                pending = at, at + limit
            elif ends:
                pending = None
        if pending:
            state.update(pending)
            if event_time:  # whole milliseconds, past the limit, and past the watermark as Spark asks
                state.setTimeoutTimestamp(max(pending[1] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
            else:
                state.setTimeoutDuration(max(1, limit // 1000))
        elif state.exists:
            state.remove()
        if out:
            yield _frame(key, instance, out, ["started", "failed"])

    return step


TEXT_COLUMNS = ["seq", "text", "score", "raw_scores", "return_text"]
TEXTS = (
    "seq array<long>, text array<string>, score array<double>, raw_scores array<boolean>,"
    " return_text array<boolean>, until long, ended boolean"
)


def open_texts(delay_ms: int, idle_ms: int | None, remember_ms: int | None) -> Step:
    """Holds the texts of a query until it ends, then gives them out; later ones are given out as ``late``.

    A query ends ``delay_ms`` after its last message, at once if that is 0, or after ``idle_ms``
    without a message.  That it has ended is remembered, for ``remember_ms`` if given.
    """
    columns = [*TEXT_COLUMNS, "late"]
    forget = lambda now: None if remember_ms is None else now + remember_ms

    def step(key, frames, state):
        now = state.getCurrentProcessingTimeMs()
        held = list(zip(*(list(c) for c in state.get[:5]), strict=True)) if state.exists else []
        until, ended = state.get[5:] if state.exists else (None, False)
        out = []
        if state.hasTimedOut and ended:
            state.remove()
            return
        if state.hasTimedOut:
            out, held, ended, until = [(*r, False) for r in held], [], True, forget(now)
        else:
            rows = _ordered(frames, ["seq"])
            texts = list(zip(*(rows[c].tolist() for c in TEXT_COLUMNS), strict=True))
            if ended:
                out = [(*r, True) for r in texts]
            else:
                held += texts
                if rows["is_last"].any() and not delay_ms:
                    out, held, ended, until = [(*r, False) for r in held], [], True, forget(now)
                elif rows["is_last"].any():
                    until = now + delay_ms if until is None or until <= 0 else until
                elif idle_ms is not None and (until is None or until <= 0):
                    until = -(now + idle_ms)  # moved by the next message, unlike the end after the last one
        lists = [list(c) for c in zip(*held, strict=True)] if held else [[] for _ in TEXT_COLUMNS]
        state.update((*lists, until, ended))
        if until is not None:
            state.setTimeoutDuration(max(1, abs(until) - now))
        if out:
            yield _frame(key, "query_id", out, columns)

    return step

