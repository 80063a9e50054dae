"""Batching: numbering, outcomes, token budgets, offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.operators.scan import CHUNK, positions, range_chunks, step_chunks

#: Values of a range whose rows one task numbers: rows may be wide, and the pieces of a range are counted apart.
PIECE = 1 << 12


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    partition_by: Sequence[str] = (),
    step: int | None = None,
    name: str = "position",
) -> DataFrame:
    """0-based position in ``order``, global or per key.

    With ``step`` the first order column must be an integer; pieces of its ranges of
    ``step`` values are numbered independently and shifted by the rows before
    them, without a sort across the table.  Otherwise a range partitioning
    does the cutting.  No window ever spans more than one piece.
    """
    cols = [F.col(c) for c in order]
    if step is not None:
        pieces = max(1, step // PIECE)
        return positions(step_chunks(df, order[0], -(-step // pieces)), partition_by, cols, name, pieces).drop(CHUNK)
    return positions(range_chunks(df, cols, partition_by), partition_by, cols, name).drop(CHUNK)


def assign_batches(
    df: DataFrame,
    order: Sequence[str],
    batch_size: int,
    partition_by: Sequence[str] = (),
    step: int | None = None,
) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows; the last one may be short."""
    placed = number_rows(df, order, partition_by, step)
    return placed.withColumns(
        {
            "batch_id": F.floor(F.col("position") / batch_size).cast("long"),
            "batch_pos": (F.col("position") % batch_size).cast("long"),
        }
    ).drop("position")


def batch_outcomes(batches: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: rows returned by good batches, whole size of the failed ones."""
    ok = F.col("rows_returned").isNotNull()
    return batches.groupBy(run).agg(
        F.coalesce(F.sum(F.when(ok, F.col("rows_returned"))), F.lit(0)).alias("successful"),
        F.coalesce(F.sum(F.when(~ok, F.col("batch_rows"))), F.lit(0)).alias("failed"),
        F.count("*").alias("num_requests"),
    )


def pack_by_tokens(
    df: DataFrame,
    max_batch_tokens: int = 16384,
    length_col: str = "n_tokens",
    key: str = "doc_id",
    buckets: int | None = None,
) -> DataFrame:
    """Greedy token-budget packs, longest rows first, ties by ``key``.

    Rows are dealt to ``buckets`` (default: one for 100,000 rows) by the hash of their
    key, and each bucket is packed for itself, so the packs depend on the rows
    only.  Adds ``pack_id`` ("bucket-number") and ``pack_tokens`` (running total).  A row
    above the budget gets a pack of its own; a null length counts as 0.
    """
    if buckets is None:
        buckets = max(1, df.count() // 100_000)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    bucket = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % F.lit(buckets)
    length = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    rows = df.withColumns({"_bucket": bucket, "_length": length}).repartition("_bucket")
    rows = rows.sortWithinPartitions("_bucket", F.desc("_length"), key)
    schema = df.select("*", F.lit("").alias("pack_id"), F.lit(0).cast("long").alias("pack_tokens")).schema
    width = len(df.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pack_no, used = None, 0, 0
        for batch in batches:
            ids, totals = [], []
            for bucket, n in zip(*(batch.column(width + i).to_pylist() for i in (0, 1)), strict=True):
                if bucket != current:
                    current, pack_no, used = bucket, 0, 0
                if used and used + n > max_batch_tokens:
                    pack_no, used = pack_no + 1, 0
                used += n
                ids.append(f"{bucket}-{pack_no}")
                totals.append(used)
            added = [pa.array(ids, pa.string()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], schema.fieldNames())

    return rows.mapInArrow(pack, schema)


def sparse_offsets(df: DataFrame, sizes: Column, batch: str = "batch_id", order: str = "batch_pos") -> DataFrame:
    """Start and end offset of each row's values inside its batch.

    A batch has at most the batch size rows, so a window per batch is bounded.
    """
    upto = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("stop_offset", F.sum(sizes).over(upto).cast("long")).withColumn(
        "start_offset", F.col("stop_offset") - sizes
    )
