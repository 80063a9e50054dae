"""Small helpers for functions that run over Arrow batches inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """Rows of equal binary cells as one array of ``width`` columns."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def whole_runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Regroup a stream sorted by column ``key`` into tables that cut no run of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        differs = np.flatnonzero(keys != keys[-1])
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != keys[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
