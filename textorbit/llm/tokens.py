"""Token counts by rank-synchronous merging over ragged arrays.

The vocabulary is a byte-pair model with scores and byte fallback.  A text is cut where
no piece of the vocabulary can reach across, so the cuts change no count.  All pre-tokens
that a batch has not seen yet lie one after another in flat arrays.  In every round each
sequence finds its pair of lowest rank and merges it, all sequences at once; sequences
without a pair leave the arrays.  What survives is counted, an unknown character as its
UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.llm.arrow import texts

SPACE = "▁"
#: Counts of pre-tokens are remembered by a worker until those have so many characters, each with
#: ``ENTRY`` more for its place in the table; then it starts afresh.  Longer ones than ``WORD`` are
#: never remembered: a text without spaces is one.
REMEMBERED = 60_000_000
ENTRY = 100
WORD = 64
#: So many characters are merged at a time, and texts counted together.
CHARACTERS = 1_000_000
_NONE = np.int32(np.iinfo(np.int32).max)


class PairModel:
    """Merge ranks of a byte-pair vocabulary, as sorted arrays.

    A symbol is a piece of the vocabulary, or a single character that occurs in one.
    ``keys`` holds left symbol * ``size`` + right symbol, ``ranks`` and ``merged`` what the
    pair gives.  ``early`` marks symbols that can be part of a piece of lower rank; their
    pairs are merged one at a time, as the order within a text then matters.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        ids = [i for i in range(model.vocab_size()) if not any(is_kind(i) for is_kind in special)]
        ids.sort(key=lambda i: -model.get_score(i))
        pieces = [model.id_to_piece(i) for i in ids]
        if any(a != SPACE == b for p in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a space after another character")
        rank_of = {p: r for r, p in reversed(list(enumerate(pieces)))}
        loose = sorted({c for p in pieces for c in p} - rank_of.keys())
        symbol = {p: i for i, p in enumerate([*rank_of, *loose])}
        self.size = len(symbol)
        self.known = np.array([p in rank_of for p in symbol])
        rank = np.array([rank_of.get(p, -1) for p in symbol], np.int64)
        found = {}
        for p in rank_of:
            for i in range(1, len(p)):
                left, right = symbol.get(p[:i]), symbol.get(p[i:])
                if left is not None and right is not None:
                    found[left * self.size + right] = symbol[p]
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.ranks = rank[self.merged].astype(np.int32)
        self.early = np.zeros(self.size, bool)
        for side in (self.keys // self.size, self.keys % self.size):
            self.early[side[self.ranks < rank[side]]] = True
        codes = sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1)
        self.codes = np.array([c for c, _ in codes], np.uint32)
        self.of_code = np.array([i for _, i in codes], np.int32)
        near = {(ord(a) << 21) | ord(b) for p in rank_of for a, b in zip(p, p[1:], strict=False)}
        self.near = np.array(sorted(near), np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``_NONE`` where it makes no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], _NONE), self.merged[at]

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), lengths)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == code
        symbols = np.where(known, self.of_code[at], np.int32(-1))
        key = (code[:-1].astype(np.int64) << 21) | code[1:]
        place = np.searchsorted(self.near, key)
        place[place == len(self.near)] = 0
        opens = np.ones(len(code), bool)
        opens[1:] = (unit[1:] != unit[:-1]) | (self.near[place] != key)
        lone = np.flatnonzero((symbols < 0) | ~np.append(self.known, False)[symbols])
        width = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in code[lone]], np.int64)
        tokens = np.bincount(unit, minlength=len(units)).astype(np.int64)
        spare = np.zeros(len(code), np.int64)  # bytes beyond the first of a character that is no piece
        spare[lone] = width - 1
        merges, extra = self._merge(symbols, np.flatnonzero(opens), unit, spare)
        return tokens - np.bincount(merges, minlength=len(units)) + extra

    def _merge(self, symbols, starts, unit, spare) -> tuple[np.ndarray, np.ndarray]:
        """Unit of every merge, and by unit the further bytes of characters that stay alone."""
        total = int(unit[-1]) + 1 if len(unit) else 0
        extra = np.zeros(total, np.int64)
        done = []
        sequence = np.zeros(len(symbols), np.int64)
        sequence[starts[1:]] = 1
        sequence = np.cumsum(sequence)
        ranks, merged = self.pairs(symbols[:-1], symbols[1:])
        ranks = np.append(ranks, _NONE) if len(symbols) else ranks
        merged = np.append(merged, np.int32(0)) if len(symbols) else merged
        if len(symbols):
            ranks[:-1][sequence[1:] != sequence[:-1]] = _NONE
        while len(symbols):
            starts = np.concatenate([[0], np.flatnonzero(sequence[1:] != sequence[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            live = lowest != _NONE
            if not live.all():
                extra += np.bincount(unit[~live], spare[~live], total).astype(np.int64)
                symbols, sequence, unit, spare, ranks, merged, lowest = (
                    a[live] for a in (symbols, sequence, unit, spare, ranks, merged, lowest)
                )
                if not len(symbols):
                    break
            hit = ranks == lowest
            hit = self._apart(hit, sequence, merged)
            where = np.flatnonzero(hit)
            done.append(unit[where])
            symbols[where] = merged[where]
            spare[where] = 0
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            fresh = hit.copy()
            fresh[:-1] |= hit[1:]
            symbols, sequence, unit, spare, ranks, merged, fresh = (
                a[keep] for a in (symbols, sequence, unit, spare, ranks, merged, fresh)
            )
            new = np.flatnonzero(fresh)
            last = new[-1:] == len(symbols) - 1
            inner = new[:-1] if last.any() else new
            ranks[inner], merged[inner] = self.pairs(symbols[inner], symbols[inner + 1])
            ranks[inner[sequence[inner] != sequence[inner + 1]]] = _NONE
            if last.any():
                ranks[-1] = _NONE
        return (np.concatenate(done) if done else np.zeros(0, np.int64)), extra

    def _apart(self, hit: np.ndarray, sequence: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Hits that don't overlap, from the left; one alone where the order matters."""
        where = np.flatnonzero(hit)
        run = np.ones(len(where), bool)
        run[1:] = where[1:] != where[:-1] + 1
        first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        keep = (np.arange(len(where)) - first) % 2 == 0
        own = sequence[where]
        leading = np.ones(len(where), bool)
        leading[1:] = own[1:] != own[:-1]
        keep &= leading | ~self.early[merged[where]]
        hit = np.zeros_like(hit)
        hit[where[keep]] = True
        return hit


@lru_cache(maxsize=4)
def load(path: str) -> PairModel:
    return PairModel(path)


class Memory(dict):
    """Counts by pre-token, and what they take."""

    size = 0

    def learn(self, counts: dict[str, int]) -> None:
        short = {u: n for u, n in counts.items() if len(u) <= WORD}
        self.update(short)
        self.size += sum(map(len, short)) + ENTRY * len(short)

    def make_room(self) -> None:
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0


@lru_cache(maxsize=4)
def _memory(path: str) -> Memory:
    return Memory()


def units(text: str) -> list[str]:
    """Pre-tokens: runs of spaces, each with what follows up to the next space.

    Every text opens with one more space, and one space of a run is left unsaid.
    """
    if not text:
        return []
    found = text.replace(SPACE, " ").split(" ")
    if "" not in found:
        return found
    out, spaces = [], 0
    for part in found[:-1]:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return [*out, " " * spaces + found[-1]]


def _slices(column: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in column:
        part.append(text)
        size += len(text)
        if size > CHARACTERS:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_tokens(column: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    model, memory = load(path), _memory(path)
    out: list[int] = []
    for part in _slices(column):
        cut = [units(t) for t in part]
        memory.make_room()
        distinct = set().union(*cut)
        new = list(distinct.difference(memory))
        found = {}
        for some in _slices(new):
            whole = [SPACE + u.replace(" ", SPACE) for u in some]
            found.update(zip(some, model.counts(whole).tolist(), strict=True))
        memory.learn(found)
        if any(len(u) > WORD for u in new):
            here = {u: memory[u] for u in distinct if u in memory} | found
            out += [sum(map(here.__getitem__, u)) for u in cut]
        else:
            out += [sum(map(memory.__getitem__, u)) for u in cut]
    return out


def token_counts(
    docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; no shuffle.

    ``model`` is the path of a sentencepiece byte-pair model without normalisation, with a
    leading space and byte fallback; every executor must have the file.  Counts are those
    of its library without begin, end or other special tokens, for whole texts.

    A null or empty text has 0 bytes and tokens.  A null id stays null, repeated rows are
    counted one by one, other columns don't matter, and an empty table gives no row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(1))
            sizes = [len(t.encode()) for t in column]
            found = count_tokens(column, model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.int64()),
                    pa.array([n > limit for n in found], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
