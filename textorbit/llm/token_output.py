"""Packed id matrices with segment lengths and position resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textorbit.llm.arrow import bounds, texts
from textorbit.llm.packing import CapacityTree
from textorbit.llm.vocabulary import load

WINDOW = 2_048
#: A shard packs about so many documents; the rest of each is at most a window.
SHARD_DOCS = 8_192
#: Rests that a shard holds at most.
RESTS = 4 * SHARD_DOCS

SCHEMA = (
    "shard long, row long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<long>, doc_starts array<long>"
)
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_KINDS += [pa.list_(pa.int64()), pa.list_(pa.int64())]


def _best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Indexes of ``lengths`` by window: longest first, each into the tightest that holds it."""
    tree, open_, out = CapacityTree(window), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity = tree.tightest(lengths[i])
        if capacity is None:
            capacity, place = window, len(out)
            out.append([])
        else:
            place = open_[capacity].pop()
            if not open_[capacity]:
                tree.put(capacity, False)
        out[place].append(i)
        if left := capacity - lengths[i]:
            open_.setdefault(left, []).append(place)
            tree.put(left, True)
    return out


class _Shard:
    """Rows of one shard: full windows at once, the rests when it ends."""

    def __init__(self, number: int, window: int, pad: bytes, width: int):
        self.number, self.window, self.pad, self.width = number, window, pad, width
        self.rows = 0
        self.rests: list[tuple[int | None, int, bytes]] = []

    def _row(self, parts: list[tuple[int | None, int, bytes]]) -> tuple:
        ends = np.cumsum([0, *(len(p[2]) // self.width for p in parts)]).tolist()
        used = ends[-1]
        data = b"".join(p[2] for p in parts) + self.pad * (self.window - used)
        resets = ends[:-1] + [used] * (used < self.window)
        self.rows += 1
        return self.number, self.rows - 1, data, used, ends, resets, [p[0] for p in parts], [p[1] for p in parts]

    def add(self, doc: int | None, data: bytes) -> Iterator[tuple]:
        size = self.window * self.width
        full = len(data) // size * size
        for at in range(0, full, size):
            yield self._row([(doc, at // self.width, data[at : at + size])])
        if full < len(data):
            self.rests.append((doc, full // self.width, data[full:]))
        if len(self.rests) >= RESTS:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        for indexes in _best_fit([len(p[2]) // self.width for p in self.rests], self.window):
            yield self._row([self.rests[i] for i in indexes])
        self.rests = []


def packed_matrices(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    pad_id: int = 0,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token matrices of all documents: a row per packed window.

    Documents are dealt to shards by hash, about ``SHARD_DOCS`` to each.  A shard's
    documents are tokenized one by one; full windows of long ones leave at once, the rests
    (shorter than a window) are packed best-fit-decreasing when the shard ends, with a
    segment tree over remaining capacities, and as often before as ``RESTS`` of them wait, as
    rows equal in id and text are in one shard however many they are.  One shuffle of texts, no
    second copy of ids.

    ``ids`` is a matrix row of ``window`` little-endian ids (16 bits wide if the vocabulary
    allows, else 32), padded by ``pad_id``; ``cu_seqlens`` are the cumulative segment lengths
    from 0; at each of ``position_resets`` positions begin at 0 again (each segment, and the
    padding); ``doc_ids`` and ``doc_starts`` say whose segment it is and how many of its ids
    came before.  Every id of every document, its end id included, is in one place.

    A null or empty text is the end id alone; a null id stays null; repeated rows are
    packed each; other columns don't matter; an empty table gives no row.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    width = id_width(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(tokenizer)
        kind = f"<u{width}"
        end, pad = (np.array([i], kind).tobytes() for i in (end_id, pad_id))
        shard, rows = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            ids, column = batch.column(1).to_pylist(), batch.column(2)
            for start, stop in zip(bounds(keys)[:-1].tolist(), bounds(keys)[1:].tolist(), strict=True):
                if shard is None or shard.number != keys[start]:
                    if shard:
                        rows += shard.close()
                    shard = _Shard(int(keys[start]), window, pad, width)
                for i, words in zip(range(start, stop), texts(column.slice(start, stop - start)), strict=True):
                    data = np.frombuffer(vocabulary.encode(words), "<u4").astype(kind).tobytes()
                    rows += shard.add(ids[i], data + end)
                    if len(rows) >= 2_000:
                        yield _batch(rows)
                        rows = []
        if shard:
            rows += shard.close()
        for at in range(0, len(rows), 2_000):
            yield _batch(rows[at : at + 2_000])

    rows = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).select("shard", "doc_id", "text")
    return rows.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(write, SCHEMA)


def id_width(tokenizer: str) -> int:
    return 2 if load(tokenizer).size <= 1 << 16 else 4


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed windows as a table of binary matrix rows, in order within each file."""
    rows.sortWithinPartitions("shard", "row").write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def segments(rows: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces again: ``doc_id, start, length, ids`` (a slice of the matrix row)."""
    width = id_width(tokenizer)
    part = F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("i", "s")
    rows = rows.select("ids", "cu_seqlens", part)
    rows = rows.withColumn("at", F.col("cu_seqlens")[F.col("i")]).withColumn("end", F.col("cu_seqlens")[F.col("i") + 1])
    length = (F.col("end") - F.col("at")).cast("long")
    ids = F.substring(F.col("ids"), F.col("at") * width + 1, length.cast("int") * width)
    return rows.select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("start"), length.alias("length"), ids.alias("ids")
    )
