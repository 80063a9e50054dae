"""Periodic runs in texts: a difference cover answers common extensions, a harmonic grid asks for them.

A run of period q that repeats at least ``exponent`` times has a stretch of (exponent - 1) * q
words that equal the word q further on, so every multiple of that length is a grid point of q,
and one grid point lies in the run.  The extensions to the right and left of the pairs
(i, i + q) give its ends.  Most pairs differ within a few words.  For the rest, the suffixes
that start in a difference cover are sorted: any two positions have both a sampled one at
the same small distance, the words before it are compared, and what follows is the least
common prefix between two ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.llm import words
from textorbit.llm.arrow import raw_texts

EXPONENT = 4
LEAST = 6
#: A perfect difference set: each residue mod 13 is a difference of two of its members.
COVER = (0, 1, 3, 9)
MODULUS = 13
#: Texts are handled together until they have so many words; a longer text is alone.
BATCH_WORDS = 400_000
#: Grid points looked at in one step.
STEP = 2_000_000

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: For two residues, the least distance at which both positions are sampled.
_DISTANCE = np.array(
    [
        [next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)]
        for a in range(MODULUS)
    ]
)


def agree(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many words are the same from i and j on, ``most`` at most; ``step`` -1 goes to the left."""
    count = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        at = count[live] * step
        live = live[x[i[live] + at] == x[j[live] + at]]
        count[live] += 1
        live = live[count[live] < most[live]]
    return count


class Extensions:
    """Longest common extensions to the right of any two positions, from the sampled suffixes only."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        padded = np.concatenate([x, np.zeros(MODULUS, x.dtype)])
        classes = [np.arange(c, n, MODULUS) for c in COVER]
        self.first = np.full(MODULUS, -1, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *map(len, classes[:-1])])
        places = np.concatenate(classes)
        self.m = m = len(places)
        blocks = padded[places[:, None] + np.arange(MODULUS)]
        order = np.lexsort(blocks.T[::-1])
        new = (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1)
        rank = np.empty(m, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        ranks, width = [rank], 1
        while width < m and rank.max() < m - 1:
            after = np.zeros(m, np.int64)
            after[: m - width] = rank[width:] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1].reshape(-1)
            ranks.append(rank)
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in reversed(range(len(ranks))):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            for array in (a, b, common):
                array[same] += 1 << k
        self.common = common * MODULUS
        inside = np.flatnonzero((a < m) & (b < m))
        self.common[inside] += agree(padded, places[a[inside]], places[b[inside]], np.full(len(inside), MODULUS))

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of ``common`` over [low, high), by the levels of a sparse table, one held at a time."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        table = self.common
        for k in range(int(level.max(initial=-1)) + 1):
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k)])
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return out

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common words from i and j on, i < j, ``most`` at most, which ends within the text."""
        near = _DISTANCE[i % MODULUS, j % MODULUS]
        count = agree(self.x, i, j, np.minimum(near, most))
        far = np.flatnonzero((count == near) & (near < most))
        p, q = i[far] + near[far], j[far] + near[far]
        s, t = (self.rank[self.first[u % MODULUS] + u // MODULUS] for u in (p, q))
        count[far] += self._least(np.minimum(s, t), np.maximum(s, t))
        return np.minimum(count, most)


def _grid(sizes: np.ndarray, starts: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, position and period of the grid points, about ``STEP`` at a time."""
    longest = sizes // exponent
    total = int(longest.sum())
    ends = np.cumsum(longest)
    at = 0
    while at < total:
        pairs = np.arange(at, min(at + STEP, total))
        text = np.searchsorted(ends, pairs, side="right")
        period = pairs - ends[text] + longest[text] + 1
        points = -(-(sizes[text] - period) // ((exponent - 1) * period))
        held = max(1, int(np.searchsorted(np.cumsum(points), STEP, side="right")))
        text, period, points = text[:held], period[:held], points[:held]
        place = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        text, period = np.repeat(text, points), np.repeat(period, points)
        yield text, starts[text] + place * (exponent - 1) * period, period
        at += held


def find(x: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``x`` are the words' hashes of texts that lie one after another, ``sizes`` words each.
    """
    starts = np.cumsum(sizes) - sizes
    held: list[tuple[np.ndarray, ...]] = []
    late: list[tuple[np.ndarray, ...]] = []
    for text, i, q in _grid(sizes, starts, exponent):
        same = np.flatnonzero(x[i] == x[i + q])
        text, i, q = text[same], i[same], q[same]
        need = np.maximum(least - q, (exponent - 1) * q)
        most, before = starts[text] + sizes[text] - i - q, i - starts[text]
        right = agree(x, i, i + q, np.minimum(most, MODULUS))
        left = agree(x, i - 1, i + q - 1, np.minimum(before, MODULUS), -1)
        more = ((right == MODULUS) & (most > MODULUS)) | ((left == MODULUS) & (before > MODULUS))
        fits = (right + left >= need) & ~more
        held.append((text[fits], i[fits] - left[fits], right[fits] + left[fits] + q[fits], q[fits]))
        late.append((text[more], i[more], q[more]))
    if any(len(part[0]) for part in late):
        held.append(_extended(x, sizes, starts, *map(np.concatenate, zip(*late, strict=True)), exponent, least))
    if not held:
        return np.empty((0, 4), np.int64)
    text, start, length, period = map(np.concatenate, zip(*held, strict=True))
    # A repeated stretch is also found with multiples of its period, with the same ends.
    order = np.lexsort((period, length, start))
    first = np.ones(len(order), bool)
    first[1:] = (start[order[1:]] != start[order[:-1]]) | (length[order[1:]] != length[order[:-1]])
    order = order[first]
    order = order[np.lexsort((period[order], start[order]))]
    return np.stack([text[order], start[order] - starts[text[order]], length[order], period[order]], axis=1)


def _extended(x, sizes, starts, text, i, q, exponent: int, least: int) -> tuple[np.ndarray, ...]:
    """Runs through the pairs that are the same over many words; only their texts are indexed."""
    some, own = np.unique(text, return_inverse=True)
    size = sizes[some]
    at = np.cumsum(size) - size
    take = np.arange(size.sum()) + np.repeat(starts[some] - at, size)
    y = x[take]
    here = i - starts[text] + at[own]
    ends = at[own] + size[own]
    right, left = np.empty_like(here), np.empty_like(here)
    parts = [slice(k, k + STEP) for k in range(0, len(here), STEP)]
    forward = Extensions(y)
    for p in parts:
        right[p] = forward.right(here[p], here[p] + q[p], (ends - here - q)[p])
    del forward
    # To the left is to the right in the reversed words, where i + q comes first.
    backward, back = Extensions(y[::-1].copy()), len(y) - here
    for p in parts:
        left[p] = backward.right(back[p] - q[p], back[p], (here - at[own])[p])
    fits = right + left >= np.maximum(least - q, (exponent - 1) * q)
    return text[fits], i[fits] - left[fits], (right + left + q)[fits], q[fits]


def _collapsed(data: bytes, kept: np.ndarray | None) -> str:
    """Digest of the kept words joined by one space; ``kept`` None keeps all."""
    digest, at, gap = hashlib.sha256(), 0, b""
    for piece in words.pieces(data):
        parts = piece.split()
        if kept is not None:
            mask = kept[at : at + len(parts)]
            at += len(parts)
            parts = list(compress(parts, mask.tolist()))
        if parts:
            digest.update(gap + b" ".join(parts))
            gap = b" "
    return digest.hexdigest()


_OUT = pa.schema(
    [
        *[(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")],
        ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()),
    ]
)


def _report(ids: list, texts: list[bytes], hashes: list[np.ndarray], exponent: int, least: int) -> pa.RecordBatch:
    sizes = np.array([len(h) for h in hashes], np.int64)
    found = find(np.concatenate(hashes), sizes, exponent, least)
    at = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
    rows = []
    for k, (doc_id, data) in enumerate(zip(ids, texts, strict=True)):
        own = found[at[k] : at[k + 1], 1:]
        best, kept = (None, None, None, None), None
        if len(own):
            start, length, period = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
            best = start, length, period, 1000 * length // period
            marks = np.zeros(sizes[k] + 1, np.int64)
            np.add.at(marks, own[:, 0] + own[:, 2], 1)
            np.add.at(marks, own[:, 0] + own[:, 1], -1)
            kept = np.cumsum(marks[:-1]) == 0
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in own.tolist())
        rows.append((doc_id, len(own), *best, hashlib.sha256(lines.encode()).hexdigest(), _collapsed(data, kept)))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _reports(batches: Iterator[pa.RecordBatch], exponent: int, least: int) -> Iterator[pa.RecordBatch]:
    ids, texts, hashes, held = [], [], [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            own = words.word_hashes(data)
            if ids and held + len(own) > BATCH_WORDS:
                yield _report(ids, texts, hashes, exponent, least)
                ids, texts, hashes, held = [], [], [], 0
            ids.append(doc_id)
            texts.append(data)
            hashes.append(own)
            held += len(own)
    if ids:
        yield _report(ids, texts, hashes, exponent, least)


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST
) -> DataFrame:
    """Runs of each text, its longest run, and a digest of the text without the repeats.

    Words are runs of other than ASCII white space, numbered from 0.  A run is a stretch of
    words with smallest period q, as long as ``least`` words and ``exponent`` (2 or more)
    periods at least, that neither neighbour extends.  The repeats are the words of a run after
    its first q.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_runs``; ``start``, ``length``,
    ``period`` and ``exponent_milli`` (1000 * length / period, rounded down) of the longest run,
    the first and then the one of the smallest period among equals, null without runs;
    ``runs_sha256`` of a line ``start,length,period`` for each run, by start and period;
    ``collapsed_sha256`` of the other words, joined by one space.

    A null, empty or blank text has no words and no run; its digests are those of nothing.  A
    row without an id, and each repeated row, has its own result.  A text of any length is
    looked at whole, in one task.  Other columns don't matter; an empty table gives an empty one.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
        " runs_sha256 string, collapsed_sha256 string"
    )
    return docs.mapInArrow(partial(_reports, exponent=exponent, least=least), schema)
