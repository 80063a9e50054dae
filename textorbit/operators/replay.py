"""The restart rules of health checks, one check after another, and their sums over chunks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa

#: Stands for the status before a chunk, where the chunk leaves it as it was.
SAME = ""


@dataclass(frozen=True)
class Rules:
    """What a check does to (status, failures).

    A success zeroes the counter and turns starting into running.  A failure while starting is
    ignored; otherwise it counts, and from ``max_failures`` on it leads to starting, if the
    restart works, or to failed.
    """

    max_failures: int
    auto_restart: bool

    def after(self, status: str, failures: int, healthy: bool, restart_ok: bool) -> tuple[str, int, int]:
        """New status and counter, and what happened: 0 nothing, 1 a failure, 2 a restart, 3 a failed restart."""
        if healthy:
            return "running" if status == "starting" else status, 0, 0
        if status == "starting":
            return status, failures, 0
        if not self.auto_restart or failures + 1 < self.max_failures:
            return status, failures + 1, 1
        return ("starting", failures + 1, 2) if restart_ok else ("failed", failures + 1, 3)

    def _cases(self) -> list[tuple[str, int]]:
        """States that differ in what a chunk makes of them: starting, and failures missing to a restart."""
        return [("starting", 0), *((SAME, self.max_failures - missing) for missing in range(1, self.max_failures + 1))]

    def _case(self, status: str, failures: int) -> int:
        return 0 if status == "starting" else min(max(self.max_failures - failures, 1), self.max_failures)

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by chunk, a row for each: its first state, what becomes of each case, its last success.

        Rows are (instance, chunk, seq, healthy, restart_ok, start_status, start_failures).
        """
        now, row, states, success, last_ok = None, None, [], False, None
        schema = None
        for batch in batches:
            out = []
            schema = schema or batch.schema
            for instance, chunk, seq, healthy, restart_ok, status, failures in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (instance, chunk) != now:
                    if row is not None:
                        out.append((*row, self._ends(states, success), last_ok))
                    now, row = (instance, chunk), (instance, chunk, status, failures)
                    states, success, last_ok = self._cases(), False, None
                states = [self.after(s, n, bool(healthy), bool(restart_ok))[:2] for s, n in states]
                if healthy:
                    success, last_ok = True, seq
            if out:
                yield self._summary(out, schema)
        if row is not None:
            yield self._summary([(*row, self._ends(states, success), last_ok)], schema)

    def _ends(self, states: list[tuple[str, int]], success: bool) -> str:
        """Status, and counter or what is added to it, of each case."""
        added = [n if success else n - before for (_, n), (_, before) in zip(states, self._cases(), strict=True)]
        return json.dumps([[s, n, success] for (s, _), n in zip(states, added, strict=True)])

    @staticmethod
    def _summary(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), schema.field(2).type]
        names = [schema.names[0], schema.names[1], "start_status", "start_failures", "ends", "last_ok"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compose(self, instance: str, chunk: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """State before each chunk of an instance, from the summaries of all its chunks."""

        def states(chunks: pd.DataFrame) -> pd.DataFrame:
            chunks = chunks.sort_values(chunk)
            status, failures, ok, out = chunks["start_status"].iloc[0], int(chunks["start_failures"].iloc[0]), None, []
            for ends, last_ok in zip(chunks["ends"], chunks["last_ok"], strict=True):
                out.append((status, failures, ok))
                end, number, success = json.loads(ends)[self._case(status, failures)]
                status = status if end == SAME else end
                failures = number if success else failures + number
                ok = ok if pd.isna(last_ok) else last_ok
            found = pd.DataFrame(out, columns=["_status", "_failures", "_ok"], dtype=object)
            found["_ok"] = pd.Series([None if pd.isna(x) else x for x in found["_ok"]], dtype=object)
            return pd.concat([chunks[[instance, chunk]].reset_index(drop=True), found], axis=1)

        return states

    def replay(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State after each check of rows sorted by chunk, from the first state that each chunk's rows carry.

        Rows are (instance, chunk, seq, healthy, restart_ok, start_status, start_failures, last success before).
        """
        now, status, failures, last_ok = None, None, 0, None
        for batch in batches:
            shown, counts, events, oks = [], [], [], []
            columns = (c.to_pylist() for c in batch.columns)
            for instance, chunk, seq, healthy, restart_ok, start, given, before in zip(*columns, strict=True):
                if (instance, chunk) != now:
                    now, status, failures, last_ok = (instance, chunk), start, given, before
                status, failures, event = self.after(status, failures, bool(healthy), bool(restart_ok))
                if healthy:
                    last_ok = seq
                shown.append(status)
                counts.append(failures)
                events.append(event)
                oks.append(last_ok)
            flags = [pa.array([e > 0 for e in events], pa.bool_()), *(pa.array([e == k for e in events], pa.bool_()) for k in (2, 3))]
            names = [batch.schema.names[0], batch.schema.names[2], "healthy", "check_failed", "restarted", "restart_failed"]
            ends = [pa.array(counts, pa.int64()), pa.array(shown, pa.string()), pa.array(oks, batch.schema.field(2).type)]
            arrays = [batch.column(0), batch.column(2), batch.column(3), *flags, *ends]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "failures", "status", "last_ok_seq"])
