"""Packing documents into windows by best-fit decreasing.

Best fit decreasing looks only at lengths, and a length is at most the window.  So the
number of pieces of each length decides everything: a segment tree over remaining
capacities, with the open windows of each capacity, finds the tightest one that holds
the next piece, and places equal pieces by the thousand at once.  Its result is a list
of moves, whose number is bounded by the window and not by the data; each piece finds
its move by its length and its number among the pieces of that length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textorbit.llm.arrow import texts
from textorbit.llm.vocabulary import load
from textorbit.session import cut

WINDOW = 2_048
#: Pieces are numbered in buckets of about so many.
BUCKET_ROWS = 200_000


class CapacityTree:
    """Segment tree over capacities 0..window: which have an open window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def put(self, capacity: int, there: bool) -> None:
        at = self.leaves + capacity
        self.tree[at] = there
        while at > 1:
            at >>= 1
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of ``length`` or more that has an open window."""
        at = self.leaves + length
        if self.tree[at]:
            return length
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


@dataclass(frozen=True)
class Move:
    """Pieces ``first`` to ``first + count - 1`` of a length go to windows from ``window``
    on, ``each`` to a window, one after another from ``offset``."""

    length: int
    first: int
    count: int
    window: int
    each: int
    offset: int


def best_fit_moves(counts: dict[int, int], window: int) -> list[Move]:
    """Best-fit-decreasing placement of ``counts[length]`` pieces of each length.

    Windows of one capacity are used in the order in which they came to have it.
    """
    tree = CapacityTree(window)
    free: dict[int, deque[tuple[int, int]]] = {}
    moves, windows = [], 0

    def release(capacity: int, first: int, number: int) -> None:
        if capacity and number:
            free.setdefault(capacity, deque()).append((first, number))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"length {length} is outside 1..{window}")
        first, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, each = window, window // length
                start, number = windows, -(-left // each)
                windows += number
            else:
                each = capacity // length
                start, number = free[capacity].popleft()
                if not free[capacity]:
                    tree.put(capacity, False)
            placed = min(left, number * each)
            full, rest = divmod(placed, each)
            moves.append(Move(length, first, placed, start, each, window - capacity))
            release(capacity - each * length, start, full)
            if rest:
                release(capacity - rest * length, start + full, 1)
            untouched = full + bool(rest)
            if untouched < number:
                free.setdefault(capacity, deque()).appendleft((start + untouched, number - untouched))
                tree.put(capacity, True)
            first, left = first + placed, left - placed
    return moves


def numbered(rows: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """Number rows of equal length from 0 (column ``number``), by hash bucket and then key.

    No bucket of a length holds more than its share of the rows, however common the
    length is; the first number of each comes from a sum over bucket counts.
    """
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = rows.groupBy(length, "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(length).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(length, "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(length, "bucket").orderBy(*keys)) - 1
    rows = rows.withColumn("own", own).join(counts, [length, "bucket"])
    return rows.withColumn("number", F.col("before") + F.col("own")).drop("bucket", "own", "before")


def pack(pieces: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``window``.

    Best fit decreasing over all pieces; ``keys`` order pieces of equal length, and rows
    equal in them are interchangeable.  Sequence numbers are gapless from 0, and so are
    the offsets in each.  An empty table gives an empty result; a null key counts as a
    value.  A length that is null or out of range is an error.
    """
    pieces = cut(pieces)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = best_fit_moves(counts, window)
    spark = pieces.sparkSession
    schema = "length long, first long, count long, window long, each long, at long"
    table = spark.createDataFrame([(m.length, m.first, m.count, m.window, m.each, m.offset) for m in moves], schema)
    rows = numbered(pieces, keys).join(F.broadcast(table), "length")
    turn = F.col("number") - F.col("first")
    rows = rows.where((turn >= 0) & (turn < F.col("count")))
    sequence = F.col("window") + F.expr("(number - first) div each")
    offset = F.col("at") + (turn % F.col("each")) * F.col("length")
    return rows.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Ids of every document and ``end_id``, cut into full windows and a rest; no shuffle.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor has.
    Returns a row per piece: ``doc_id``, ``start`` (the document's ids before it),
    ``length``, ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit).  A null or
    empty text is the end id alone.  A null id stays null, repeated rows give pieces each,
    other columns don't matter.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(tokenizer)
        last = end_id.to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                docs, starts, lengths, totals, ids = [], [], [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    data = vocabulary.encode(text) + last
                    total = len(data) // 4
                    for start in range(0, total, window):
                        part = data[4 * start : 4 * (start + window)]
                        docs.append(doc)
                        starts.append(start)
                        lengths.append(len(part) // 4)
                        totals.append(total)
                        ids.append(part)
                numbers = [pa.array(c, pa.int64()) for c in (docs, starts, lengths, totals)]
                yield pa.RecordBatch.from_arrays(
                    [*numbers, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"]
                )

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(tokenize, PIECES)
