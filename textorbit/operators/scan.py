"""Ordered scans that survive a hot key.

A plain ``sum(...).over(partition by key order by seq)`` puts every row of one
key into one task.  The scans here work on ``(key, chunk)`` groups instead,
where ``chunk`` cuts the order of a key into bounded pieces:

1. inside each ``(key, chunk)`` group an ordinary window computes the local part;
2. one summary row per ``(key, chunk)`` is scanned over the chunks of a key (with
   no key at all: one row per chunk of a million rows, in one task);
3. what the earlier chunks contribute is joined back on ``(key, chunk)``, a
   partitioning the rows already have.

Keys and orders must not be null.  Chunks are ranges of a known step of the order
column (``step_chunks``: no extra job), ranges with about as many rows each
(``even_chunks``: one aggregation, and a few where keys are hot; any integer or time order), or pieces of a range
partitioning (``range_chunks``: any order).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.functions.formats import micros
from textorbit.session import cut

CHUNK = "_chunk"
#: Rows of one key that a chunk should hold.
CHUNK_ROWS = 1 << 20
#: Cells into which a range of too many rows is cut to count them.
CELLS = 256


def step_chunks(df: DataFrame, column: str, step: int = 1 << 20) -> DataFrame:
    """Cut an integer order column into ranges of ``step`` consecutive values."""
    return df.withColumn(CHUNK, F.expr(f"`{column}` div {step}"))


def even_chunks(df: DataFrame, column: str, keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Cut an integer or time order into ranges with at most twice ``rows`` rows of a key each.

    A key of no more than ``rows`` rows is one chunk.  The range of another is cut into ``CELLS``
    equal cells whose rows are counted; a cell that holds too many is cut and counted again, so
    bunched values are looked at as finely as they need.  Cells in order, ``rows`` rows
    together, make a chunk.  Only rows of equal order are never parted.
    """
    most, names = rows or CHUNK_ROWS, list(keys)
    timed = df.schema[column].dataType.typeName().startswith("timestamp")
    at = micros(column) if timed else F.col(column).cast("long")
    spans = df.groupBy(*names).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.count("*").alias("_rows"))
    hot = cut(spans.filter(F.col("_rows") > most).select(*names, "_low", (F.col("_high") - F.col("_low") + 1).alias("_w0")))
    kept = [F.col(f"`{c}`") for c in df.columns]
    if hot.isEmpty():
        return df.withColumn(CHUNK, F.lit(0).cast("long"))

    def placed(how: str) -> DataFrame:
        """Rows with the place ``_r0`` in their key's range."""
        known = df.join(hot, names, how) if names else df.crossJoin(F.broadcast(hot))  # without a key, one row
        return known.withColumn("_r0", at - F.col("_low"))

    def cells(level: int, rows: DataFrame) -> DataFrame:
        """Width ``_w``, start ``_s`` and place within, ``_r``, of a row's cell at a level."""
        w, r = f"_w{level - 1}", f"_r{level - 1}"
        rows = rows.withColumn(f"_w{level}", F.expr(f"({w} + {CELLS - 1}) div {CELLS}"))
        rows = rows.withColumn(f"_r{level}", F.expr(f"{r} % _w{level}"))
        return rows.withColumn(f"_s{level}", F.expr(f"_r0 - _r{level}"))

    counted, inside, level, fine = [], placed("inner"), 1, False
    while not fine:
        inside = cells(level, inside)
        found = inside.groupBy(*names, f"_s{level}").agg(F.count("*").alias("_n"), F.first(f"_w{level}").alias("_w"))
        found = cut(found.withColumn("_more", (F.col("_n") > most) & (F.col("_w") > 1)))
        counted.append(found.filter(~F.col("_more")).select(*names, F.col(f"_s{level}").alias("_s"), "_n", F.lit(level).alias("_level")))
        wide = found.filter("_more").select(*names, f"_s{level}")
        fine = wide.isEmpty()
        if not fine:
            inside = inside.join(wide, [*names, f"_s{level}"], "left_semi")
            level += 1
    leaves = counted[0]
    for more in counted[1:]:
        leaves = leaves.unionByName(more)
    before = Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    leaves = cut(leaves.withColumn(CHUNK, F.expr(f"_before div {most}")).select(*names, "_s", "_level", CHUNK))
    out = placed("left")
    for n in range(1, level + 1):
        own = leaves.filter(F.col("_level") == n).select(*names, F.col("_s").alias(f"_s{n}"), F.col(CHUNK).alias(f"_c{n}"))
        out = cells(n, out).join(own, [*names, f"_s{n}"], "left")
    chunk = F.coalesce(*[F.col(f"_c{n}") for n in range(1, level + 1)], F.lit(0))
    return out.select(*kept, chunk.cast("long").alias(CHUNK))


def chunks(df: DataFrame, column: str, keys: Sequence[str], step: int | None) -> DataFrame:
    """Ranges of ``step`` values, or without a step as wide as each key needs."""
    return even_chunks(df, column, keys) if step is None else step_chunks(df, column, step)


def range_chunks(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Cut any order into about equal pieces by sampled range partitioning.

    The partition number becomes the chunk.  There are as many as the session has
    shuffle partitions, or more where a piece would exceed ``CHUNK_ROWS``.  The rows are
    written out because the sampled bounds must be the same for all later uses.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(least, -(-df.count() // CHUNK_ROWS))
    ranged = df.repartitionByRange(n, *keys, *order)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id().cast("long")))


def _group(keys: Sequence[str]) -> list[str]:
    return [*keys, CHUNK]


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(carry, _group(keys), "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    since: Mapping[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Running values per key over chunked rows, by ascending ``order`` columns.

    ``sums``   name -> value: sum of value up to and with this row.
    ``lasts``  name -> value: latest non-null value up to and with this row.
    ``since``  name -> (reset, value): sum of value over the rows after the
    latest reset row, up to and with this row; ``value`` must be 0 on resets.
    """
    sums, lasts, since = dict(sums or {}), dict(lasts or {}), dict(since or {})
    for name, (_, value) in since.items():
        sums[f"_all_{name}"] = value
    here = Window.partitionBy(*_group(keys)).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = df.withColumns({f"_l_{n}": F.sum(v).over(upto) for n, v in sums.items()})
    marks = {n: v for n, v in lasts.items()}
    for name, (reset, _) in since.items():
        marks[f"_at_{name}"] = F.when(reset, F.col(f"_l__all_{name}"))
    if marks:
        local = local.withColumns(
            {f"_l_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in marks.items()}
        )

    # One row per (key, chunk), without a window or a shuffle of the rows: sums
    # and last values are aggregations; the sum after a chunk's last reset takes
    # a second one, once that reset is known.
    stamp = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    source = df
    if since:
        resets = df.groupBy(*_group(keys)).agg(
            *[F.max(F.when(reset, stamp)).alias(f"_r_{n}") for n, (reset, _) in since.items()]
        )
        source = df.join(resets, _group(keys))
    after = {
        n: F.sum(F.when(stamp > F.col(f"_r_{n}"), value).otherwise(F.lit(0))) for n, (_, value) in since.items()
    }
    tails = source.groupBy(*_group(keys)).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), stamp)).alias(f"_t_{n}") for n, v in lasts.items()],
        *[
            F.when(F.max(f"_r_{n}").isNotNull(), F.sum(sums[f"_all_{n}"]) - tail).alias(f"_t__at_{n}")
            for n, tail in after.items()
        ],
    )
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.withColumns(
        {f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums}
    )
    if since:  # a chunk's last reset, as a total counted from the key's start
        carried = carried.withColumns(
            {f"_t__at_{n}": F.col(f"_t__at_{n}") + F.col(f"_c__all_{n}") for n in since}
        )
    if marks:
        carried = carried.withColumns(
            {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True).over(before) for n in marks}
        )
    carried = carried.select(*_group(keys), *[f"_c_{n}" for n in [*sums, *marks]])

    joined = _attach(local, carried, keys)
    out = {n: F.col(f"_c_{n}") + F.col(f"_l_{n}") for n in sums if not n.startswith("_all_")}
    out |= {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts}
    for n in since:
        total = F.col(f"_c__all_{n}") + F.col(f"_l__all_{n}")
        reset_at = F.coalesce(
            F.col(f"_l__at_{n}") + F.col(f"_c__all_{n}"), F.col(f"_c__at_{n}"), F.lit(0)
        )
        out[n] = total - reset_at
    kept = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, *[v.alias(n) for n, v in out.items()])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position", together: int = 1
) -> DataFrame:
    """0-based position of each chunked row inside its key, in ``order``.

    The counts of ``together`` neighbouring chunks are added up first, so chunks may be small
    without their counts being many rows of one window.
    """
    here = Window.partitionBy(*_group(keys)).orderBy(*order)
    ahead = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda by, at: F.coalesce(F.sum("_rows").over(ahead(by, at)), F.lit(0))
    counts = df.groupBy(*_group(keys)).agg(F.count("*").alias("_rows"))
    if together == 1:
        offsets = counts.withColumn("_offset", before(keys, CHUNK)).drop("_rows")
    else:
        counts = counts.withColumn("_range", F.expr(f"{CHUNK} div {together}"))
        whole = counts.groupBy(*keys, "_range").agg(F.sum("_rows").alias("_rows"))
        whole = whole.withColumn("_first", before(keys, "_range")).drop("_rows")
        inside = counts.withColumn("_inside", before([*keys, "_range"], CHUNK))
        offsets = inside.join(whole, [*keys, "_range"]).select(
            *_group(keys), (F.col("_first") + F.col("_inside")).alias("_offset")
        )
    placed = df.withColumn("_local", F.row_number().over(here))
    joined = _attach(placed, offsets, keys)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, (F.col("_offset") + F.col("_local") - 1).alias(name))


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """0-based position inside each key for any order, hot keys included."""
    return positions(range_chunks(df, order, keys), keys, order, name).drop(CHUNK)
