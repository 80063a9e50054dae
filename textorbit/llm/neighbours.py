"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half is given the nearest of ``CODES`` centroids;
the pair is the vector's cell.  A query walks the pairs by the sum of its two distances,
with a heap, until the cells passed hold a share of all vectors; those vectors are then
ranked by their true distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textorbit.session import cut

CODES = 32
#: Centroids are fitted on so many vectors, those with the least hash of their id.
SAMPLE = 10_000
ROUNDS = 12
#: Part of all vectors that a query is compared with.  Where vectors show no clusters,
#: as in random directions, fewer lose neighbours; where they do, a few hundredths will do.
SHARE = 0.6
#: Vectors of a block, which one task holds while the queries are read past it.
BLOCK = 16_384


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def fit(points: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by k-means from a fixed start; fewer points than codes are their own."""
    points = np.unique(points, axis=0)
    if len(points) <= codes:
        return points
    rng = np.random.default_rng(11)
    centres = points[rng.choice(len(points), codes, replace=False)]
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(1)
        count = np.bincount(nearest, minlength=codes)
        for j in np.flatnonzero(count):
            centres[j] = points[nearest == j].mean(0)
    return centres


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs by ascending ``left[i] + right[j]`` until their cells hold ``wanted`` vectors."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, held, out = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if here := int(counts[a[i], b[j]]):
            out.append((int(a[i]), int(b[j])))
            held += here
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))
    return out


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of rows with equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(new))


def _best(ids: np.ndarray, other: np.ndarray, vectors: np.ndarray, q: int, others: list[int], point: np.ndarray, k: int):
    """Ids and distances of the ``k`` nearest vectors of a block in the wanted cells, each id once."""
    mine = np.flatnonzero(np.isin(other, others) & (ids != q))
    gap = vectors[mine] - point
    score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    order = np.lexsort((ids[mine], score))
    _, first = np.unique(ids[mine][order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[mine][order], score[order]


def _usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    vector = F.col(embedding).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    rows = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    return rows.where(~F.coalesce(odd, F.lit(True))).where(some).select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("v"))


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    share: float = SHARE,
    codes: int = CODES,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query, by Euclidean distance in doubles.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, nearest first and equal
    ones by id.  A row with the query's own id is no answer.  Vectors that are null, zero,
    or hold null or non-finite components, and rows without an id, take no part; rows
    that repeat an id count once, with their nearest vector, and a query id on several vectors
    asks with each of them: the least distance to any counts.  Vectors of two widths are an
    error.  Other columns don't matter; no queries or no vectors give no row.

    Every vector is indexed.  Centroids come from a bounded sample; the counts of cells
    (codes x codes) and the centroids go to the tasks.  A block of vectors holds part of
    the cells of one left centroid, split by hash where it has many.  A vector is shuffled
    once, to its block, which one task holds; each query is sent to the blocks it walks
    through and read past them.  Each query and block give at most ``k`` rows.
    """
    rows = _usable(index, vec_id, embedding)
    asked = _usable(queries, vec_id, embedding).distinct()
    widths = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths.low is None:
        return index.sparkSession.createDataFrame([], schema)
    if widths.low != widths.high or asked.where(F.size("v") != widths.low).limit(1).count():
        raise ValueError("vectors of different widths")
    width = int(widths.low)
    half = max(1, width // 2)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    points = np.array(sample.column("v").to_pylist(), np.float64).reshape(-1, width)
    books = fit(points[:, :half], codes), fit(points[:, half:], codes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                left = _squares(points[:, :half], books[0]).argmin(1)
                right = _squares(points[:, half:], books[1]).argmin(1)
                vectors = [p.tobytes() for p in np.ascontiguousarray(points, "<f8")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(vectors, pa.binary())],
                    ["vec_id", "cell", "other", "v"],
                )

    placed = cut(rows.mapInArrow(place, "vec_id long, cell int, other int, v binary"))
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in placed.groupBy("cell", "other").count().collect():
        counts[r.cell, r.other] = r["count"]
    wanted = max(int(np.ceil(share * counts.sum())), k + 1)
    parts = [max(1, int(n) // BLOCK) for n in counts.sum(1)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            near = _squares(points[:, :half], books[0]), _squares(points[:, half:], books[1])
            for q, point, left, right in zip(batch.column(0).to_pylist(), points, *near, strict=True):
                cells: dict[int, list[int]] = {}
                for i, j in walk(left, right, counts, wanted):
                    cells.setdefault(i, []).append(j)
                data = np.ascontiguousarray(point, "<f8").tobytes()
                out += [(q, i, p, js, data) for i, js in cells.items() for p in range(parts[i])]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "cell", "part", "others", "q"])

    probes = asked.mapInArrow(probe, "query_id long, cell int, part int, others array<int>, q binary")
    split = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("cell") + 1)
    blocks = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), split).cast("int"))
    none = F.lit(None).cast("array<int>").alias("others")
    vectors = blocks.select("cell", "part", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "other", none, F.col("v").alias("data"))
    queries = probes.select(
        "cell", "part", F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.lit(0).alias("other"), "others", F.col("q").alias("data")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by block, the vectors of a block are gathered before its queries come."""
        now, parts, held = None, [], None
        for batch in batches:
            out = []
            cells, pieces, kinds, ids, other = (batch.column(c).to_numpy() for c in range(5))
            for start, end in zip(*_runs(cells, pieces, kinds), strict=True):
                some = batch.slice(start, end - start)
                if (cells[start], pieces[start]) != now:
                    now, parts, held = (cells[start], pieces[start]), [], None
                if kinds[start] == 0:
                    parts.append((ids[start:end], other[start:end], _vectors(some.column(6), width)))
                    continue
                if not parts:
                    continue  # no vector in this block
                held = held or [np.concatenate(c) for c in zip(*parts, strict=True)]
                for q, others, point in zip(ids[start:end], some.column(5).to_pylist(), _vectors(some.column(6), width), strict=True):
                    out.append((q, *_best(*held, q, others, point, k)))
            if out:
                counts = [len(x[1]) for x in out]
                query = np.repeat(np.array([x[0] for x in out], np.int64), counts)
                found = [np.concatenate([x[c] for x in out]) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(query), *map(pa.array, found)], ["query_id", "vec_id", "score"])

    met = vectors.unionByName(queries).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    best = met.mapInArrow(compare, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
