"""Cells of unit vectors around pivots: a partition by angle that is refined where it pays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textorbit.session import cut

#: Cells that a cell is split into.
FANOUT = 64
#: Pivots of a level up to this many bytes are sent to every task, more are shuffled to their cells.
SENT_BYTES = 16 << 20
#: Rows of a cell on which a split is tried.
TRIED_ROWS = 1024
#: A cell is split if that leaves at most this share of its work.
GAIN = 0.5
#: Blocks that a cell is cut into, as long as one has at least ``leaf_rows`` rows and at most ``WIDE`` times as many.
SHARES, WIDE = 8, 8
_SLICE = 1024


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def blocks(h: Column, a: Column, leaf_rows: int) -> tuple[Column, Column]:
    """Blocks of a cell's ``h`` own rows and blocks of its visitors, ``a`` rows in all."""
    rows = F.greatest(F.lit(leaf_rows), F.least(F.lit(WIDE * leaf_rows), F.ceil(a / SHARES)))
    return F.ceil(h / rows), F.ceil((a - h) / rows)


def _work(h: Column, a: Column, leaf_rows: int) -> Column:
    """Comparisons of ``h`` own rows with each other and all visitors of a cell; a row sent to a block counts as half a leaf's."""
    own, others = blocks(h, a, leaf_rows)
    copies = h * (own + others) + (a - h) * own
    return h * (a - h / 2) + copies * (leaf_rows / 2)


def _pivots(rows: DataFrame, level: int, fanout: int) -> DataFrame:
    """``cell, slot, vec``: of each cell's own rows the one with the least hash in each of ``fanout`` slots."""
    mark = F.xxhash64("id", F.lit(level))
    homes = rows.where("home").select("cell", F.pmod(mark, F.lit(fanout)).alias("slot"), F.xxhash64(mark).alias("turn"), "vec")
    least = homes.groupBy("cell", "slot").agg(F.min("turn").alias("turn"))
    return cut(homes.join(least, ["cell", "slot", "turn"]).select("cell", "slot", "vec").dropDuplicates(["cell", "slot"]))


class _Splitter:
    """Deals rows to the cells below theirs.

    A row's own cell is that of its nearest pivot.  Rows within ``angle`` of a member of another cell
    are at most twice ``angle`` farther from its pivot than from their nearest one, and within ``angle``
    of the half of the sphere that is nearer to its pivot; they go
    there as visitors.  Of two cells' own rows only those of the later cell visit, so a pair meets once.
    """

    def __init__(self, kind: str, dim: int, angle: float, fanout: int):
        self.schema = f"id long, vec {kind}, copies long, cell long, home boolean, angle double"
        self.dim, self.reach, self.fanout = dim, 2 * angle + 1e-6, fanout
        self.sine = math.sin(angle) if angle < math.pi / 2 else math.inf

    def below(self, rows: pa.RecordBatch, cell: int, slots: np.ndarray, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        squares = (centres**2).sum(1)
        apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * centres @ centres.T, 1e-12))
        for at in range(0, rows.num_rows, _SLICE):
            some = rows.slice(at, _SLICE)
            far = angles(matrix(some["vec"], self.dim), centres)
            nearest, number = far.argmin(1)[:, None], np.arange(len(centres))
            home = some["home"].to_numpy(zero_copy_only=False).astype(bool)
            near = far <= far.min(1, keepdims=True) + self.reach
            near &= np.cos(far.min(1, keepdims=True)) - np.cos(far) <= self.sine * apart[nearest[:, 0]] + 1e-6
            near &= ~home[:, None] | (number <= nearest)
            row, col = np.nonzero(near)
            out = some.select(["id", "vec", "copies"]).take(pa.array(row))
            own = home[row] & (col == nearest[row, 0])
            added = [pa.array(cell * self.fanout + slots[col], pa.int64()), pa.array(own), pa.array(far[row, col])]
            yield pa.RecordBatch.from_arrays([*out.columns, *added], ["id", "vec", "copies", "cell", "home", "angle"])

    def sent(self, rows: DataFrame, pivots: pa.Table) -> DataFrame:
        """With all pivots in every task."""
        pivots = pivots.sort_by([("cell", "ascending"), ("slot", "ascending")])
        cells, starts = np.unique(pivots["cell"].to_numpy(), return_index=True)
        slots, centres = pivots["slot"].to_numpy(), matrix(pivots["vec"], self.dim)
        ends = np.append(starts[1:], len(slots))
        known = {int(c): (slots[a:b], centres[a:b]) for c, a, b in zip(cells, starts, ends, strict=True)}
        held = rows.sparkSession.sparkContext.broadcast(known)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = batch.column("cell").to_numpy()
                for cell in np.unique(of).tolist():
                    yield from self.below(batch.filter(pa.array(of == cell)), cell, *held.value[cell])

        return rows.mapInArrow(place, self.schema)

    def shuffled(self, rows: DataFrame, pivots: DataFrame, sizes: DataFrame, part_rows: int) -> DataFrame:
        """With each cell's pivots before the rows of each of its parts."""
        parts = sizes.select("cell", F.ceil(F.col("n_all") / part_rows).alias("parts"))
        part = F.pmod(F.xxhash64("id"), "parts")
        dealt = rows.join(parts, "cell").select("cell", part.alias("part"), F.lit(-1).cast("long").alias("slot"), "id", "vec", "copies", "home")
        heads = pivots.join(parts, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "slot",
            F.lit(None).cast("long").alias("id"), "vec", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("boolean").alias("home"),
        )
        keys = ["cell", "part"]
        both = dealt.unionByName(heads).repartition(*keys).sortWithinPartitions(*keys, F.desc(F.col("slot") >= 0), "slot")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, slots, centres = None, np.empty(0, np.int64), np.empty((0, self.dim))
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells, numbers = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
                heads = batch.column("slot").to_numpy() >= 0
                new = (cells[1:] != cells[:-1]) | (numbers[1:] != numbers[:-1]) | (heads[1:] != heads[:-1])
                starts = np.flatnonzero(np.append(True, new))
                for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                    some = batch.slice(start, end - start)
                    if (cells[start], numbers[start]) != now:
                        now, slots, centres = (cells[start], numbers[start]), slots[:0], centres[:0]
                    if heads[start]:
                        slots = np.append(slots, some["slot"].to_numpy())
                        centres = np.append(centres, matrix(some["vec"], self.dim), axis=0)
                    else:
                        yield from self.below(some, int(cells[start]), slots, centres)

        return both.mapInArrow(place, self.schema)


def metric_cells(
    rows: DataFrame, dim: int, angle: float, leaf_rows: int, fanout: int = FANOUT, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """Deal unit vectors (id, vec, copies) to cells so that all pairs within ``angle`` meet in one.

    Out: id, vec, copies, cell, home.  A row is at home in one cell and visits others; two rows
    within ``angle`` are together in exactly one cell in which at least one is at home, counting
    each pair of rows at home in it once.  Cells with more comparisons than ``leaf_rows`` rows at home
    have are split around ``fanout`` of their own rows, and so on, level by level, as long as there
    is something to gain: a split is tried on about ``TRIED_ROWS`` rows of a cell and made if it
    leaves at most ``GAIN`` of the work, copies of rows included.  Rows that lie within each other's reach stay one cell,
    which its reader cuts into blocks.  The trial steers the work, never the pairs.

    The number of cells grows with the rows; ``blocks`` says how its reader cuts one.  Visitors farther from a cell's pivot than its
    farthest own row and ``angle`` are left out.  A level is written, so the next one starts from a table.
    """
    kind = rows.schema["vec"].dataType.simpleString()
    splitter = _Splitter(kind, dim, angle, fanout)
    state = rows.select("id", "vec", "copies", F.lit(1).cast("long").alias("cell"), F.lit(True).alias("home"))
    leaves = []
    for level in range(int(62 / math.log2(max(fanout, 2)))):
        sizes = state.groupBy("cell").agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_all"))
        large = cut(sizes.where(F.col("n_home") * F.col("n_all") > leaf_rows**2))
        if large.isEmpty():
            break
        inside = state.join(large.select("cell"), "cell", "left_semi")
        pivots = _pivots(inside, level, fanout)
        if pivots.count() * dim * 8 <= sent_bytes:
            found = pivots.toArrow()
            place = lambda r, s: splitter.sent(r, found)  # noqa: B023, E731
        else:
            place = lambda r, s: splitter.shuffled(r, pivots, s, leaf_rows)  # noqa: B023, E731
        scale = F.ceil(F.col("n_all") / TRIED_ROWS)
        turn = F.pmod(F.xxhash64("id", F.lit(-1 - level)), scale)
        tried = cut(state.join(large, "cell").where(turn == 0).select(state.columns))
        tally = place(tried, large).groupBy(F.expr(f"cell div {fanout}L").alias("parent"), "cell")
        tally = tally.agg(F.count_if("home").alias("h"), F.count("*").alias("a"))
        tally = tally.join(large.select(F.col("cell").alias("parent"), scale.alias("s")), "parent")
        after = tally.groupBy(F.col("parent").alias("cell")).agg(
            F.sum(_work(F.col("h") * F.col("s"), F.col("a") * F.col("s"), leaf_rows)).alias("work")
        )
        before = _work(F.col("n_home"), F.col("n_all"), leaf_rows)
        split = cut(large.join(after, "cell").where(F.col("work") <= GAIN * before).select("cell"))
        if split.isEmpty():
            break
        leaves.append(state.join(split, "cell", "left_anti"))
        placed = cut(place(state.join(split, "cell", "left_semi").select(state.columns), large))
        widest = cut(placed.where("home").groupBy("cell").agg(F.max("angle").alias("widest")))
        within = F.col("home") | (F.col("angle") <= F.col("widest") + angle + 1e-6)
        state = placed.join(widest, "cell").where(within).select(state.columns)
    return reduce(DataFrame.unionByName, [*leaves, state])
