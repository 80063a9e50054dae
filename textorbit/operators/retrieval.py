"""Vector retrieval: width check, similarity, top-k, votes, exact similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textorbit.functions import vectors as vec
from textorbit.functions.formats import round6
from textorbit.operators.cells import FANOUT, SENT_BYTES, WIDE, blocks, metric_cells
from textorbit.operators.cells import angles as _angles
from textorbit.operators.cells import matrix as _matrix
from textorbit.session import cut

# Queries up to this many bytes (rows x width x 8) are sent to every task.
QUERY_BYTES = 16 << 20
# Scores of queries x corpus rows that a task holds at once.
TILE_CELLS = 4 << 20
# Dot products of two blocks that a task of the similarity join holds at once.
MET_CELLS = 1 << 20
# Rows per block where blocks replace the sent queries, and in J6.
BLOCK_ROWS = 4096
# Cells that queries are compared with.
PIVOTS = 256
# Corpus rows of neighbouring cells that a task holds, and tasks that there should be at least: a query is
# sent to each held set of rows once, a corpus row to each share of the queries.
HELD_ROWS, TASKS = 1 << 16, 64


def check_width(df: DataFrame, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(width summary, rows whose width differs from the most common one's).

    The first vector sets the width in a sequential reader; a table has no
    first row, so the width with the most rows (smallest on ties) is expected.
    """
    sizes = df.filter(F.col(col).isNotNull()).groupBy(F.size(col).alias("width")).agg(
        F.count("*").alias("n_rows")
    )
    summary = sizes.agg(
        F.min("width").alias("min_width"),
        F.max("width").alias("max_width"),
        F.sum("n_rows").alias("n_rows"),
    ).withColumn("uniform", F.col("min_width") == F.col("max_width"))
    common = F.max_by("width", F.struct("n_rows", (-F.col("width")).alias("low")))
    odd = sizes.agg(common.alias("_common"), F.collect_list("width").alias("_all")).select(
        F.explode(F.array_remove("_all", F.col("_common"))).alias("width")
    )
    violators = df.join(odd, F.size(col) == F.col("width"), "left_semi")
    return summary, violators


def pair_similarity(
    pairs: DataFrame, a: DataFrame, b: DataFrame, id_col: str, vector_col: str, out: str = "score"
) -> DataFrame:
    """Cosine of listed pairs (id_a, id_b): two equi-joins, no pair is invented."""
    left = a.select(F.col(id_col).alias("id_a"), F.col(vector_col).alias("_a"))
    right = b.select(F.col(id_col).alias("id_b"), F.col(vector_col).alias("_b"))
    return (
        pairs.join(left, "id_a")
        .join(right, "id_b")
        .withColumn(out, round6(vec.cosine(F.col("_a"), F.col("_b"))))
        .drop("_a", "_b")
    )


def sparse_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, id_col: str, sparse_col: str = "sparse") -> DataFrame:
    """Dot product and index overlap of listed pairs of sparse vectors.

    A frequent term costs nothing extra: vectors meet by id, never by term.
    """
    left = a.select(F.col(id_col).alias("id_a"), F.col(sparse_col).alias("_a"))
    right = b.select(F.col(id_col).alias("id_b"), F.col(sparse_col).alias("_b"))
    return (
        pairs.join(left, "id_a")
        .join(right, "id_b")
        .withColumn("_m", F.explode_outer(F.array(vec.sparse_meeting(F.col("_a"), F.col("_b")))))
        .withColumns({"dot": round6(F.col("_m.dot")), "overlap": F.col("_m.overlap")})
        .drop("_a", "_b", "_m")
    )


def _present(rows: pa.RecordBatch | pa.Table, dim: int) -> pa.RecordBatch | pa.Table:
    """Rows with a vector; a vector of another width than ``dim`` is an error."""
    rows = rows.filter(pc.is_valid(rows["vec"]))
    odd = pc.sum(pc.not_equal(pc.list_value_length(rows["vec"]), dim)).as_py()
    if odd:
        raise ValueError(f"{odd} of {rows.num_rows} vectors are not {dim} wide; check_width lists them")
    return rows


def _scores(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Cosines, six decimals, queries x corpus; zero vectors score -inf."""
    qn, cn = (queries**2).sum(1), (corpus**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        raw = (queries @ corpus.T) / np.sqrt(np.outer(qn, cn))
    scores = np.floor(raw * 1e6 + 0.5) / 1e6
    scores[~np.isfinite(scores)] = -np.inf
    return scores


def _leading(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties by id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    keep = np.arange(q.size) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], scores[keep]


def _best(queries: np.ndarray, corpus: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best corpus rows per query, tile by tile."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    tile = max(1, TILE_CELLS // max(len(corpus), 1))
    for at in range(0, len(queries), tile):
        scores = _scores(queries[at : at + tile], corpus)
        if scores.shape[1] > k:  # everything at or above the k-th score, ties included
            floor = np.partition(scores, -k, axis=1)[:, -k]
        else:
            floor = np.full(len(scores), -np.inf)
        rows, cols = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        found.append(_leading(rows + at, ids[cols], scores[rows, cols], k))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    dim: int,
    query_id: str = "query_id",
    corpus_id: str = "corpus_id",
    vector_col: str = "embedding",
    query_bytes: int = QUERY_BYTES,
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` corpus rows most similar to each query by cosine, exactly.

    Ids are integers; null and zero vectors take no part, a vector of another
    width than ``dim`` ends the job with an error (see ``check_width``).  With
    ``exclude_self`` a corpus row with the query's own id is no answer.  Out:
    (query_id, corpus_id, score, rank), ties by corpus id.  Each task keeps its
    own k best per query, so only k rows per query and task are shuffled, and
    scores a tile of fixed size at a time.  Queries are counted first: above
    ``query_bytes`` they are not sent to the tasks; corpus rows then lie in blocks of
    bounded size, and each query is sent to the blocks that may hold one of its k best.
    """
    # Width is tested in the tasks: a filter here would be pushed below a
    # computed vector column and compute it a second time.
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector_col).alias("vec"))
    c = corpus.select(F.col(corpus_id).cast("long").alias("cid"), F.col(vector_col).alias("vec"))
    wanted = k + 1 if exclude_self else k
    n_queries = queries.count()
    if n_queries * 8 * dim <= query_bytes:
        partial = _top_k_sent(q.toArrow(), c, wanted, dim)
    else:
        partial = _top_k_blocks(q, c, wanted, dim)
    if exclude_self:
        partial = partial.filter("qid != cid")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("cid"))
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("qid").alias(query_id), F.col("cid").alias(corpus_id), "score", "rank")
    )


_HITS = "qid long, cid long, score double"


def _top_k_sent(queries: pa.Table, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    queries = _present(queries, dim)
    if queries.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], _HITS)
    qids = queries["qid"].to_numpy()
    matrix = _matrix(queries["vec"], dim)
    sent = corpus.sparkSession.sparkContext.broadcast((qids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = sent.value
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            batch = _present(batch, dim)
            if batch.num_rows == 0:
                continue
            found = _best(matrix, _matrix(batch.column("vec"), dim), batch.column("cid").to_numpy(), k)
            best = _leading(*(np.append(a, b) for a, b in zip(best, found, strict=True)), k)
        yield pa.RecordBatch.from_pydict({"qid": qids[best[0]], "cid": best[1], "score": best[2]})

    return corpus.mapInArrow(search, _HITS)


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors**2).sum(1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _past_blocks(blocks: DataFrame, asked: DataFrame, k: int, dim: int, n_cells: int) -> DataFrame:
    """The k best of each block for the queries (bin, share, id, vec, mask, floor) that were sent to it.

    One task holds a block (bin, share, id, vec, cell) and reads its queries past it, in the batches
    that they come in.  A query meets the cells in its ``mask``, or more if most queries
    want most of the block, and answers below its ``floor`` are left out.
    """
    keys, none = ["bin", "share", "kind"], F.lit(None)
    columns = [*keys, "id", "vec", "cell", "mask", "floor"]
    rows = blocks.withColumns({"kind": F.lit(0), "mask": none.cast("binary"), "floor": none.cast("double")})
    both = rows.select(columns).unionByName(asked.withColumns({"kind": F.lit(1), "cell": none.cast("int")}).select(columns))

    def met(vectors: np.ndarray, masks: list[bytes], held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, corpus, cells, starts = held
        bits = np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(len(masks), -1), axis=1)[:, :n_cells]
        wanted, sizes = bits[:, cells].astype(bool), np.diff(starts)
        if wanted @ sizes @ np.ones(len(masks)) > 0.5 * len(masks) * len(ids):
            return _best(vectors, corpus, ids, k)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for n, (start, end) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            some = np.flatnonzero(wanted[:, n])
            if some.size:
                q, i, score = _best(vectors[some], corpus[start:end], ids[start:end], k)
                best = _leading(*(np.append(a, b) for a, b in zip(best, (some[q], i, score), strict=True)), k)
        return best

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in range(3)]
            starts = np.flatnonzero(np.append(True, np.any([m[1:] != m[:-1] for m in marks], axis=0)))
            for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                some = batch.slice(start, end - start)
                if (marks[0][start], marks[1][start]) != now:
                    now, parts, held = (marks[0][start], marks[1][start]), [], None
                ids, vectors = some["id"].to_numpy(), _matrix(some["vec"], dim)
                if marks[2][start] == 0:
                    parts.append((ids, vectors, some["cell"].to_numpy()))
                elif parts or held:
                    if held is None:
                        i, v, c = (np.concatenate(x) for x in zip(*parts, strict=True))
                        order, parts = np.argsort(c, kind="stable"), []
                        cells, first = np.unique(c[order], return_index=True)
                        held = i[order], v[order], cells, np.append(first, len(c))
                    q, i, score = met(vectors, some["mask"].to_pylist(), held)
                    floor = some["floor"].to_numpy(zero_copy_only=False)[q]
                    near = np.isnan(floor) | (score >= floor)
                    yield pa.RecordBatch.from_pydict({"qid": ids[q[near]], "cid": i[near], "score": score[near]})

    return both.repartition("bin", "share").sortWithinPartitions(*keys).mapInArrow(compare, _HITS)


def _bins(sizes: list[int], most: int) -> tuple[list[int], list[int]]:
    """First bin of each cell, and the bins it takes: small cells share one of up to ``most`` rows, large ones are cut."""
    firsts, parts, used, filled = [], [], -1, most
    for n in sizes:
        wanted = -(-n // most)
        if wanted == 1 and filled + n <= most:
            filled += n
        elif wanted:
            used, filled = used + 1, n if wanted == 1 else most
        firsts.append(max(used, 0))
        parts.append(wanted)
        used += max(wanted - 1, 0)
    return firsts, parts


def _top_k_blocks(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """Top k through cells around pivots; a corpus row is shuffled to its block once a round.

    A query is first compared with the cell of its nearest pivot.  Its k-th best score there
    bounds what it still needs: by the triangle inequality of angles a cell whose pivot is farther
    than its radius allows can't hold a better row, and the query isn't sent there.
    """
    spark = corpus.sparkSession
    found = corpus.filter(F.col("vec").isNotNull()).orderBy(F.xxhash64("cid"), "cid").limit(PIVOTS).toArrow()
    pivots = _units(_matrix(_present(found, dim)["vec"], dim)) if found.num_rows else np.empty((0, dim))
    pivots = pivots[pivots.any(axis=1)]
    if not len(pivots):
        check = lambda batches: (_present(b, dim).slice(0, 0).select(["qid"]) for b in batches)
        none = F.lit(None)
        return queries.mapInArrow(check, "qid long").select("qid", none.cast("long").alias("cid"), none.cast("double").alias("score"))
    kind = corpus.schema["vec"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _present(batch, dim)
            if batch.num_rows:
                angles = _angles(_units(_matrix(batch["vec"], dim)), pivots)
                cell = angles.argmin(1)
                near = angles[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(near)], [*batch.schema.names, "cell", "angle"])

    placed = cut(corpus.mapInArrow(place, f"cid long, vec {kind}, cell int, angle double"))
    radius, sizes = np.full(len(pivots), -1.0), [0] * len(pivots)
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # PIVOTS at most
        radius[row.cell], sizes[row.cell] = row.r, row.n
    lived = np.flatnonzero(radius >= 0)
    # About as many bins of cells as shares of the queries, as long as a task can hold the bin.
    firsts, parts = _bins(sizes, min(HELD_ROWS, max(BLOCK_ROWS, math.ceil(sum(sizes) / math.sqrt(TASKS)))))
    shares = max(1, -(-TASKS // (max(a + n for a, n in zip(firsts, parts, strict=True)))))
    of = lambda held: F.element_at(F.array(*[F.lit(n) for n in held]), F.col("cell") + 1)
    blocks = placed.select(
        (of(firsts) + F.pmod(F.xxhash64("cid"), of(parts))).cast("int").alias("bin"), "cell", F.col("cid").alias("id"), "vec"
    )
    shared = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    vec_kind = queries.schema["vec"].dataType.simpleString()
    reached = [np.arange(a, a + n) for a, n in zip(firsts, parts, strict=True)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells that a query may have hits in, and their bins: the nearest without a ``floor``, else all within reach."""
        for batch in batches:
            batch = _present(batch, dim)
            if not batch.num_rows:
                continue
            angles = _angles(_units(_matrix(batch["vec"], dim)), pivots[lived])
            nearest = angles.argmin(1)
            floor = batch["floor"].to_numpy(zero_copy_only=False)
            best = np.cos(np.maximum(angles - radius[lived], 0))
            first = np.arange(len(lived)) == nearest[:, None]
            with np.errstate(invalid="ignore"):
                wanted = np.where(np.isnan(floor)[:, None], first, best >= floor[:, None] - 2e-6)
            mask = np.zeros((batch.num_rows, len(pivots)), np.uint8)
            mask[:, lived] = wanted
            bins = [np.unique(np.concatenate([reached[c] for c in lived[w]])).tolist() if w.any() else [] for w in wanted]
            bits = pa.array([m.tobytes() for m in np.packbits(mask, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["qid"], batch["vec"], batch["floor"], bits, pa.array(bins, pa.list_(pa.int32()))], ["qid", "vec", "floor", "mask", "bins"]
            )

    def sent(rows: DataFrame, shares: int) -> DataFrame:
        rows = rows.select("qid", "vec", "floor").mapInArrow(cells, f"qid long, vec {vec_kind}, floor double, mask binary, bins array<int>")
        share = F.pmod(F.xxhash64("qid"), F.lit(shares)).cast("int").alias("share")
        return rows.select(F.col("qid").alias("id"), "vec", "floor", "mask", share, F.explode("bins").alias("bin"))

    queries = queries.filter(F.col("vec").isNotNull())
    first = sent(queries.withColumn("floor", F.lit(float("nan"))), 1)
    near = _past_blocks(blocks.withColumn("share", F.lit(0)), first, k, dim, len(pivots))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    kth = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == k).select("qid", F.col("score").alias("floor"))
    rest = queries.join(kth, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    return _past_blocks(shared, sent(rest, shares), k, dim, len(pivots))


def nearest_labelled(
    queries: DataFrame,
    labelled: DataFrame,
    k: int,
    dim: int,
    query_id: str = "query_id",
    corpus_id: str = "corpus_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    exclude_self: bool = False,
) -> DataFrame:
    """Majority label among the k nearest labelled vectors; score = its share, ties by label.

    ``exclude_self``: a labelled row with the query's own id has no vote.
    """
    hits = top_k(queries, labelled, k, dim, query_id, corpus_id, vector_col, exclude_self=exclude_self)
    votes = (
        hits.join(labelled.select(corpus_id, label_col), corpus_id)
        .groupBy(query_id, label_col)
        .agg(F.count("*").alias("votes"))
    )
    return (
        votes.groupBy(query_id)
        .agg(
            F.max_by(label_col, F.struct("votes", (-F.col(label_col)).alias("low"))).alias("label"),
            F.max("votes").alias("votes"),
            F.sum("votes").alias("_all"),
        )
        .withColumn("score", round6(F.col("votes") / F.col("_all")))
        .drop("_all")
    )


def vector_groups(df: DataFrame, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """Distinct vectors: (smallest id, vector, number of copies)."""
    return df.groupBy(F.col(vector_col).alias("vec")).agg(
        F.min(id_col).alias("id"), F.count("*").alias("copies")
    )


_PAIRS = "id_a long, id_b long, copies_a long, copies_b long, score double"
_LINKS = "id long, copies long, links long, linked_copies long, score double, best_id long"
_CHOSEN = 1 << 14
# Rows of the one and the other side of a tile, which then stays in a core's cache.
_SIDE = 512
# Centres that the rows of a block are dealt to, and rows for each that there are at least.
_CENTRES = 64


def _to_blocks(rows: DataFrame, keys: list[str], lone: str, others: str) -> DataFrame:
    """Rows with their ``block`` once for each pair of blocks (lo, hi) that they are part of.

    Of the blocks of a cell the first ``lone`` meet themselves and each other, and each of the ``others`` after them.
    """
    meets = f"transform(sequence(0, if(block < {lone}, {lone} + {others}, {lone}) - 1), k -> struct(least(k, block) AS lo, greatest(k, block) AS hi))"
    return rows.withColumn("met", F.explode(F.expr(meets))).select(*keys, "met.lo", "met.hi", "block", *[c for c in rows.columns if c not in (*keys, "block", lone, others)])


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, bool]:
    """Rows of the one and the other block of a pair, and whether it is the same."""
    rows = pa.Table.from_batches(list(batches))
    lo, hi, block = rows["lo"][0].as_py(), rows["hi"][0].as_py(), rows["block"]
    rows = rows.drop_columns(["lo", "hi", "block"])
    if lo == hi:
        return rows, rows, True
    return rows.filter(pc.equal(block, lo)), rows.filter(pc.equal(block, hi)), False


def _reached(ours: np.ndarray, theirs: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shares of our rows, each with the rows of theirs that may have a dot product >= ``threshold`` with one of them.

    Such rows are apart by sqrt(|a|^2 + |b|^2 - 2 * threshold) at most.  A share's rows are nearer to its centre than to
    any other, so a row of theirs that lies farther than that beyond the plane between two centres is left out.
    """
    count = min(_CENTRES, len(ours) // _CENTRES)
    if count < 2:
        yield np.arange(len(ours)), np.arange(len(theirs))
        return
    centres = ours[np.linspace(0, len(ours) - 1, count).astype(np.int64)]
    apart = np.array([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])
    half, (square, squares) = (centres**2).sum(1) / 2, [(v**2).sum(1) for v in (ours, theirs)]
    home, near = (ours @ centres.T - half).argmax(1), theirs @ centres.T - half
    nearest, best = near.argmax(1), near.max(1)
    slack = 1e-12 * (1 + square.max() + squares.max())
    for centre in np.unique(home):
        some = np.flatnonzero(home == centre)
        reach = np.sqrt(np.maximum(square[some].max() + squares - 2 * threshold, 0) + slack)
        beyond = best - near[:, centre] > reach * apart[centre, nearest] + slack
        yield some, np.flatnonzero(~beyond)


def _met(left: pa.Table, right: pa.Table, same: bool, dim: int, threshold: float, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of left, row of right, score) of the pairs with dot product >= ``threshold``, a square tile at a time.

    In single precision most pairs are clearly too far apart; the others are decided in double precision,
    after ``keep`` if given.  Two rows of the same block meet twice; the ordered meeting counts.
    """
    if not left.num_rows or not right.num_rows:
        return
    ours, theirs = _matrix(left["vec"], dim), _matrix(right["vec"], dim)
    ids, others = left["id"].to_numpy(), right["id"].to_numpy()
    lengths = [math.sqrt((v**2).sum(1).max()) for v in (ours, theirs)]
    floor = np.float32(threshold - (dim + 4) * 2.0**-23 * lengths[0] * lengths[1] - 1e-7 * abs(threshold))
    single, across = ours.astype(np.float32), theirs.astype(np.float32)
    side = max(1, min(_SIDE, math.isqrt(MET_CELLS)))

    def decided(chosen: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b = (np.concatenate(c) for c in zip(*chosen, strict=True))
        if same:
            ordered = ids[a] < others[b]
            a, b = a[ordered], b[ordered]
        if keep is not None:
            kept = keep(a, b)
            a, b = a[kept], b[kept]
        dots = np.einsum("nd,nd->n", ours[a], theirs[b])
        hit = dots >= threshold
        if hit.any():
            yield a[hit], b[hit], np.floor(dots[hit] * 1e6 + 0.5) / 1e6

    held, chosen = 0, []
    for mine, reached in _reached(ours, theirs, threshold):
        some, met = single[mine], across[reached]
        for low in range(0, len(reached), side):
            tile = met[low : low + side].T
            for at in range(0, len(mine), side):
                near = np.flatnonzero(some[at : at + side] @ tile >= floor)  # several times faster than nonzero of two axes
                for start in range(0, len(near), _CHOSEN):
                    a, b = np.divmod(near[start : start + _CHOSEN], tile.shape[1])
                    chosen.append((mine[at + a], reached[low + b]))
                    held += len(a)
                    if held >= _CHOSEN:
                        yield from decided(chosen)
                        held, chosen = 0, []
    if chosen:
        yield from decided(chosen)


def _pairs(left: pa.Table, right: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    ids, copies = [[t[c].to_numpy() for t in (left, right)] for c in ("id", "copies")]
    for i, j, score in found:
        a, b, ca, cb = ids[0][i], ids[1][j], copies[0][i], copies[1][j]
        swap = a > b
        columns = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, cb, ca), np.where(swap, ca, cb)
        numbers = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array(score, pa.float64())], ["id_a", "id_b", "copies_a", "copies_b", "score"])


def _counts(left: pa.Table, right: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What a pair of blocks says of the links of its rows, a row for each that has one."""
    sides = [(t["id"].to_numpy(), t["copies"].to_numpy()) for t in (left, right)]
    totals = [[np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)] for ids, _ in sides]
    for i, j, score in found:
        for at, to, (links, linked, high, best), (ids, copies) in ((i, j, totals[0], sides[1]), (j, i, totals[1], sides[0])):
            np.add.at(links, at, 1)
            np.add.at(linked, at, copies[to])
            order = np.lexsort((ids[to], -score, at))
            rows, first = np.unique(at[order], return_index=True)
            top, who = score[order[first]], ids[to][order[first]]
            better = (top > high[rows]) | ((top == high[rows]) & (who < best[rows]))
            high[rows[better]], best[rows[better]] = top[better], who[better]
    for (ids, copies), (links, linked, high, best) in zip(sides, totals, strict=True):
        some = np.flatnonzero(links)
        numbers = [pa.array(c[some], pa.int64()) for c in (ids, copies, links, linked)]
        last = [pa.array(high[some], pa.float64()), pa.array(best[some], pa.int64())]
        yield pa.RecordBatch.from_arrays([*numbers, *last], ["id", "copies", "links", "linked_copies", "score", "best_id"])


def _meetings(
    df: DataFrame, threshold: float, id_col: str, vector_col: str, pivots: int, block_rows: int, sent_bytes: int, links: bool
) -> DataFrame:
    """Pairs of distinct vectors with dot product >= ``threshold``, or what each pair of blocks says of its rows' links."""
    distinct = cut(vector_groups(df.filter(F.col(vector_col).isNotNull()), id_col, vector_col))
    distinct = distinct.select(F.col("id").cast("long").alias("id"), "vec", "copies")
    one = distinct.select(F.size("vec").alias("dim")).first()
    if one is None:
        return df.sparkSession.createDataFrame([], _LINKS if links else _PAIRS)
    dim, angle = one["dim"], math.acos(max(-1.0, min(1.0, threshold)))
    placed = metric_cells(distinct, dim, angle, block_rows, pivots, sent_bytes)
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_all"))
    own, others = blocks(F.col("n_home"), F.col("n_all"), block_rows)
    sizes = cut(sizes.filter("n_home > 0").select("cell", own.cast("int").alias("own"), others.cast("int").alias("others")))
    member = F.xxhash64("id")
    block = F.when(F.col("home"), F.pmod(member, "own")).otherwise(F.col("own") + F.pmod(member, "others"))
    blocked = placed.join(sizes, "cell").withColumn("block", block.cast("int")).drop("home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _sides(batches)
        yield from (_counts if links else _pairs)(left, right, _met(left, right, same, dim, threshold))

    met = _to_blocks(blocked, ["cell"], "own", "others").groupBy("cell", "lo", "hi")
    return met.applyInArrow(compare, _LINKS if links else _PAIRS)


def similarity_join(
    df: DataFrame,
    threshold: float,
    id_col: str,
    vector_col: str = "embedding",
    pivots: int = FANOUT,
    block_rows: int = BLOCK_ROWS,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """All pairs of distinct unit vectors with dot product >= ``threshold``, exactly.

    Copies are folded first and counted, so a large group of copies gives one
    row, not all its pairs: (id_a, id_b, copies_a, copies_b, score), id_a < id_b.

    Vectors are dealt to cells around pivots (``metric_cells``), which are split ``pivots`` ways as
    long as they have more than ``block_rows`` rows and a split saves comparisons.  What is
    left is cut into blocks (``cells.blocks``); a task compares two blocks, however large the cell, and
    two blocks meet in one task, so a row is sent out once for each block that its own one meets.
    """
    return _meetings(df, threshold, id_col, vector_col, pivots, block_rows, sent_bytes, links=False)


def similarity_links(
    df: DataFrame,
    threshold: float,
    id_col: str,
    vector_col: str = "embedding",
    pivots: int = FANOUT,
    block_rows: int = BLOCK_ROWS,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Each distinct unit vector that has a partner in ``similarity_join``, without the pairs.

    Out: (id, copies, links, linked_copies, best_id, score): the number of other distinct vectors
    at ``threshold`` or more, the rows they stand for, and the best of them, ties by the smallest id.
    A class of n near copies costs n rows here, where the join has n * n / 2.
    """
    found = _meetings(df, threshold, id_col, vector_col, pivots, block_rows, sent_bytes, links=True)
    best = F.max_by(F.struct("best_id", "score"), F.struct("score", (-F.col("best_id")).alias("low")))
    return (
        found.groupBy("id", "copies")
        .agg(F.sum("links").alias("links"), F.sum("linked_copies").alias("linked_copies"), best.alias("best"))
        .select("id", "copies", "links", "linked_copies", "best.best_id", "best.score")
    )


def similarity_candidates(
    df: DataFrame,
    threshold: float,
    id_col: str,
    vector_col: str = "embedding",
    tables: int = 24,
    bucket_rows: int = 64,
    block_rows: int = BLOCK_ROWS,
    seed: int = 5,
) -> DataFrame:
    """Pairs of ``similarity_join`` that meet in a random-hyperplane bucket, re-checked exactly.

    Copies are folded first.  Each vector is listed in ``tables`` buckets by the sides of
    random planes, as many as give about ``bucket_rows`` vectors a bucket if directions
    are even.  Vectors of a bucket are compared in blocks, so a crowded bucket of more than ``WIDE`` times
    ``block_rows`` is spread over tasks.  A vector carries its place in all tables, and a pair counts in the first table
    that it meets in, so no pair is given out twice.  At angle a one table keeps a pair with (1 - a / pi) ** planes.
    """
    distinct = cut(vector_groups(df.filter(F.col(vector_col).isNotNull()), id_col, vector_col))
    found = distinct.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not found["n"]:
        return df.sparkSession.createDataFrame([], _PAIRS)
    dim, planes = found["dim"], max(1, math.ceil(math.log2(max(found["n"] / bucket_rows, 2))))
    normals = np.random.default_rng(seed).normal(size=(dim, tables * planes))
    powers = 1 << np.arange(planes, dtype=np.int64)
    mark = np.uint16 if planes <= 16 else np.uint32
    kind = distinct.schema["vec"].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = _present(whole.slice(at, 2048), dim)
                if batch.num_rows:
                    yield batch, (_matrix(batch.column("vec"), dim) @ normals > 0).reshape(-1, tables, planes) @ powers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sides in places(batches):
            marks = batch.append_column("marks", pa.array([m.tobytes() for m in sides.astype(mark)], pa.binary()))
            out = marks.take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
            yield out.append_column("bucket", pa.array((sides * tables + np.arange(tables)).ravel(), pa.int64()))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides in places(batches):
            bucket, n = np.unique(sides * tables + np.arange(tables), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    rows = distinct.select("id", "vec", "copies")
    sizes = rows.mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    crowded = cut(sizes.filter(F.col("n") > WIDE * block_rows).select("bucket", F.ceil(F.col("n") / (WIDE * block_rows)).cast("int").alias("own")))
    placed = rows.mapInArrow(place, f"id long, vec {kind}, copies long, marks binary, bucket long")
    # A crowded bucket has thousands of rows, so they are few.
    placed = placed.join(F.broadcast(crowded), "bucket", "left").withColumns({"own": F.coalesce("own", F.lit(1)), "others": F.lit(0)})
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("id"), "own").cast("int"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, same = _sides(batches)
        table = left["bucket"][0].as_py() % tables if left.num_rows else 0
        a, b = (np.frombuffer(b"".join(t["marks"].to_pylist()), mark).reshape(-1, tables) for t in (left, right))
        first = lambda i, j: ~(a[i, :table] == b[j, :table]).any(1)
        yield from _pairs(left, right, _met(left, right, same, dim, threshold, first))

    return _to_blocks(blocked, ["bucket"], "own", "others").groupBy("bucket", "lo", "hi").applyInArrow(compare, _PAIRS)
