"""Hard negatives by exact integer scores: products modulo small primes in float32, put together again.

Integer vectors are reduced modulo a few primes below 1,024, centred around 0.  A product of
64 such components stays below 2**24, so float32 holds it exactly, and the fast matrix
product of floats gives the scores modulo each prime.  The Chinese remainder theorem, with
centred digits of a mixed radix, turns them into the signed score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.session import cut

# The largest primes below 1,024.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
#: Components summed in float32 at once: 64 * 510 * 510 is below 2**24.
SLICE = 64
#: Scores beyond it are an error; six primes reach further.
MOST = 1 << 58
#: Vectors of a block, which one task holds; it reads all anchors past them.
SMALLEST, LARGEST = 2_048, 65_536
#: Anchors of a pack, and scores held at once.
PACK = 1_024
SCORES = 1 << 21


def primes_for(bound: int) -> tuple[int, ...]:
    """As few primes as tell the numbers from -bound to bound apart."""
    product = 1
    for k, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[: k + 1]
    raise ValueError("scores beyond 2**58")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of smallest size; ``p`` is odd."""
    r = np.remainder(x, p)
    return r - p * (r > p // 2)


class Residues:
    """The rows of an integer matrix modulo each prime, in slices of the columns."""

    def __init__(self, matrix: np.ndarray, primes: tuple[int, ...]):
        self.primes, self.rows = primes, len(matrix)
        width = matrix.shape[1]
        self.parts = []
        for p in primes:
            r = centred(matrix, p).astype(np.float32)
            self.parts.append([np.ascontiguousarray(r[:, k : k + SLICE]) for k in range(0, width, SLICE)])

    def times(self, other: Residues, rows: slice) -> np.ndarray:
        """Exact scores of some of the rows with all rows of ``other``."""
        total, weight = None, 1
        for k, p in enumerate(self.primes):
            r = np.zeros((len(range(*rows.indices(self.rows))), other.rows), np.int64)
            for a, b in zip(self.parts[k], other.parts[k], strict=True):
                r += (a[rows] @ b.T).astype(np.int64)
            if total is None:
                total = centred(r, p)
            else:
                # The next digit makes the sum so far agree with this prime too.
                total += weight * centred(centred(r - total, p) * pow(weight, -1, p), p)
            weight *= p
        return total


def first_by_score(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, equal ones in their order."""
    places = np.arange(len(score))
    if len(score) > k:
        places = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return places[np.argsort(-score[places], kind="stable")[:k]]


def _integer(bound: int) -> str:
    return next(t for t in ("<i1", "<i2", "<i4", "<i8") if bound <= np.iinfo(t).max)


_PACKED = "block int, kind int, ids binary, labels binary, data binary, windows binary"


def _packs(kind: int) -> Callable:
    """Rows (vec_id, label, data, block, windows) put together by block and batch, ``PACK`` at most."""
    names = [c.split()[0] for c in _PACKED.split(",")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, where = (batch.column(c).to_numpy() for c in ("vec_id", "label", "block"))
            cells = [batch.column(c).to_pylist() for c in ("data", "windows")]
            out = []
            for block in np.unique(where):
                mine = np.flatnonzero(where == block)
                for at in range(0, len(mine), PACK):
                    some = mine[at : at + PACK]
                    data, windows = (b"".join(c[k] for k in some) for c in cells)
                    out.append((int(block), kind, ids[some].tobytes(), labels[some].tobytes(), data, windows))
            if out:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return pack


def _compare(width: int, dtype: str, primes: tuple[int, ...], choose: Callable, names: list[str]) -> Callable:
    """Scores of a stream sorted by block, its vectors before its anchors; ``choose`` picks from a row of scores."""

    def matrix(pack: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (np.frombuffer(pack[c], np.int64) for c in ("ids", "labels"))
        return ids, labels, np.frombuffer(pack["data"], dtype).reshape(len(ids), width).astype(np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                pack = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if pack["block"] != now:
                    now, parts, block = pack["block"], [], None
                if pack["kind"] == 0:
                    parts.append(matrix(pack))
                    continue
                if not parts and block is None:
                    continue  # a block without vectors
                if block is None:
                    ids, labels, data = map(np.concatenate, zip(*parts, strict=True))
                    order, parts = np.argsort(ids, kind="stable"), []
                    ids, labels, block = ids[order], labels[order], Residues(data[order], primes)
                own, own_labels, data = matrix(pack)
                asked = Residues(data, primes)
                windows = np.frombuffer(pack["windows"], np.int64).reshape(len(own), -1)
                rows = max(1, SCORES // len(ids))
                out = []
                for at in range(0, len(own), rows):
                    some = slice(at, at + rows)
                    for r, score in enumerate(asked.times(block, some), at):
                        out += choose(own[r], own_labels[r], windows[r], ids, labels, score)
                if out:
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return compare


def _positives(k: int) -> Callable:
    def choose(anchor, label, _, ids, labels, score):
        same = np.flatnonzero((labels == label) & (ids != anchor))
        best = same[first_by_score(score[same], k)]
        return [(np.full(len(best), anchor), ids[best], score[best])]

    return choose


def _negatives(k: int, low: int, high: int) -> Callable:
    def choose(anchor, label, windows, ids, labels, score):
        """``windows``: how many positives the anchor has, then their ids and scores in turn."""
        out = []
        known = windows[1 : 1 + 2 * windows[0]].reshape(-1, 2).tolist()
        bounds = [(-(-low * s // 100), high * s // 100) for _, s in known]
        other = labels != label
        if bounds:
            other &= (score >= min(b[0] for b in bounds)) & (score <= max(b[1] for b in bounds))
        other = np.flatnonzero(other)
        if len(other):
            other = other[np.argsort(-score[other], kind="stable")]
            falling = -score[other]
            for (positive, s), (least, most) in zip(known, bounds, strict=True):
                at = int(np.searchsorted(falling, -most, side="left"))
                end = int(np.searchsorted(falling, -least, side="right"))
                best = other[at : min(end, at + k)]
                if len(best):
                    fixed = [np.full(len(best), c) for c in (anchor, positive, s)]
                    out.append((*fixed, ids[best], score[best]))
        return out

    return choose


def mine_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
) -> DataFrame:
    """Negatives of each anchor that score within a window below each of its positives.

    ``embedding`` holds whole numbers, ``label`` is one; ``anchors`` is a condition on ``vec_id``.
    A score is the inner product with the anchor, exactly; higher ones come first, then the
    smaller id.  An anchor's positives are its first ``positives`` other rows of the same label.
    Its negatives for one of them are the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, 0 <= low <= high.

    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and
    ``negative_score``.  Anchors without a positive, and positives without a negative, have no row.

    A row with a null id, label, vector or component takes no part.  Rows that repeat an id
    count once, the one with the least label (among those, always the same vector).  Zero and empty vectors
    score 0.  Vectors of two widths, and scores that may exceed 2**58, are an error.  Other
    columns don't matter; an empty table gives an empty one.

    A task holds one block of vectors, and the anchors are read past it in packs, once to
    find the positives and once for the negatives; each gives a few rows per block.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.col(embedding).cast("array<bigint>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~F.exists("v", F.isnull))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    top = F.max(F.aggregate("v", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double")))))
    facts = rows.agg(
        F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(squares).alias("squares"), top.alias("top")
    ).first()
    if facts.low is None:
        return spark.createDataFrame([], result)
    if facts.low != facts.high:
        raise ValueError("vectors of different widths")
    if facts.squares >= MOST * 0.999:
        raise ValueError("scores beyond 2**58")
    width, dtype = int(facts.low), _integer(int(facts.top) + 1)
    primes = primes_for(int(facts.squares * 1.001) + 1)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, width)
                cells = pa.array([x.tobytes() for x in data], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["vec_id", "label", "data"])

    narrowed = rows.mapInArrow(narrow, "vec_id long, label long, data binary")
    single = narrowed.groupBy("vec_id").agg(F.min(F.struct("label", "data")).alias("x")).select("vec_id", "x.*")
    single = cut(single)
    n = single.count()
    blocks = max(-(-n // LARGEST), min(-(-n // SMALLEST), 2 * spark.sparkContext.defaultParallelism))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(b"").alias("windows")
    columns = ["vec_id", "label", "data", "block", "windows"]
    vectors = single.select("vec_id", "label", "data", block, none).mapInArrow(_packs(0), _PACKED)

    def past_blocks(asked: DataFrame, choose: Callable, names: list[str]) -> DataFrame:
        packs = asked.withColumn("block", F.lit(0)).select(columns).mapInArrow(_packs(1), _PACKED)
        packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = vectors.unionByName(packs).repartition(blocks, "block").sortWithinPartitions("block", "kind")
        return met.mapInArrow(_compare(width, dtype, primes, choose, names), ", ".join(f"{c} long" for c in names))

    asked = single.where(anchors)
    names = ["anchor_id", "positive_id", "positive_score"]
    found = past_blocks(asked.withColumn("windows", F.lit(b"")), _positives(positives), names)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pair = F.struct("place", F.col("positive_id").alias("i"), F.col("positive_score").alias("s"))
    known = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(pair)).alias("known"))
    known = known.select(F.col("anchor_id").alias("vec_id"), F.flatten(F.transform("known", lambda p: F.array(p.i, p.s))).alias("known"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(3).to_pylist()
            filled = [np.array([len(x) // 2, *x, *[0] * (2 * positives - len(x))], np.int64) for x in known]
            cells = pa.array([x.tobytes() for x in filled], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], cells], ["vec_id", "label", "data", "windows"])

    asked = asked.join(known, "vec_id").select("vec_id", "label", "data", "known")
    asked = cut(asked.mapInArrow(windows, "vec_id long, label long, data binary, windows binary"))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    met = past_blocks(asked, _negatives(negatives, low, high), names)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
