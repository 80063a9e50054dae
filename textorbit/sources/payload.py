"""Arrow IPC payloads: batches of rows as LZ4 stream bytes, and back.

Three kinds: ``text`` (one string column), ``dense`` (fixed-size lists of
32-bit floats) and ``sparse`` (lists of (unsigned index, float) pairs).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textorbit import schemas
from textorbit.operators.batch import assign_batches

# Column names and the width of an empty dense payload.
COLUMN = {"text": "text", "dense": "embeddings", "sparse": "sparse_embeddings"}
EMPTY_WIDTH = 384

_VALUE = {"text": T.StringType(), "dense": schemas.DENSE, "sparse": schemas.SPARSE}
_PAIR = pa.struct([pa.field("index", pa.uint32(), False), pa.field("value", pa.float32(), False)])
_OUT = "batch_id long, payload binary, n_rows long, error string"


def _column(values: pa.Array, kind: str) -> pa.Array:
    """A Spark column as the payload's Arrow type; raises on uneven widths."""
    if kind == "text":
        return values.cast(pa.string())
    if kind == "sparse":
        item = values.values  # all pairs; offsets keep the rows apart
        pairs = pa.StructArray.from_arrays(
            [item.field("index").cast(pa.uint32()), item.field("value").cast(pa.float32())], fields=list(_PAIR)
        )
        return pa.ListArray.from_arrays(values.offsets, pairs)
    lengths = np.diff(values.offsets.to_numpy())
    width = int(lengths[0]) if len(lengths) else EMPTY_WIDTH
    if (lengths != width).any():
        raise ValueError(f"vectors of {lengths.min()} to {lengths.max()} entries in one batch")
    flat = values.flatten().cast(pa.float32())
    return pa.FixedSizeListArray.from_arrays(flat, type=pa.list_(pa.field("item", pa.float32(), False), width))


def encode(values: pa.Array | pa.ChunkedArray, kind: str) -> bytes:
    """One record batch as LZ4-compressed IPC stream bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.offset:  # offsets of a sliced list start inside its child
        values = pa.concat_arrays([values])
    column = _column(values, kind)
    batch = pa.RecordBatch.from_arrays([column], schema=pa.schema([pa.field(COLUMN[kind], column.type, False)]))
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _row(batch_id: int, values, kind: str) -> dict:
    try:
        if values.null_count:
            raise ValueError("null values in a batch")
        return {"batch_id": batch_id, "payload": encode(values, kind), "n_rows": len(values), "error": None}
    except (ValueError, pa.ArrowInvalid) as exc:
        return {"batch_id": batch_id, "payload": None, "n_rows": len(values), "error": f"INTERNAL: {exc}"}


_OUT_ARROW = pa.schema(
    [("batch_id", pa.int64()), ("payload", pa.binary()), ("n_rows", pa.int64()), ("error", pa.string())]
)


def write_payloads(
    df: DataFrame,
    kind: str,
    value_col: str,
    batch_size: int,
    order: Sequence[str] | None = None,
    step: int | None = None,
) -> DataFrame:
    """(batch_id, payload, n_rows, error): rows packed ``batch_size`` at a time.

    With ``order``, batches are consecutive over the whole table.  Without it
    each partition packs its own rows and nothing is shuffled; only the last
    payload of a partition is short.  A batch that cannot be encoded (uneven
    widths, nulls) becomes a row with its error.
    """
    if order is not None:
        placed = assign_batches(df, order, batch_size, step=step)

        def group(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("batch_pos")
            return pa.Table.from_pylist([_row(rows["batch_id"][0].as_py(), rows["value"], kind)], _OUT_ARROW)

        packed = placed.select("batch_id", "batch_pos", F.col(value_col).alias("value"))
        return packed.groupBy("batch_id").applyInArrow(group, _OUT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        held, number, part = 0, 0, 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pending, held, number
            if not held:
                return
            table = pa.Table.from_batches(pending)
            at = 0
            while held - at >= batch_size or (final and at < held):
                values = table["value"].slice(at, batch_size)
                yield pa.RecordBatch.from_pylist([_row((part << 33) + number, values, kind)], _OUT_ARROW)
                number, at = number + 1, at + len(values)
            pending, held = table.slice(at).to_batches(), held - at

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                pending.append(batch)
                held += batch.num_rows
                yield from flush(final=False)
        yield from flush(final=True)

    rows = df.select(F.col(value_col).alias("value"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(pack, _OUT)


def write_dense_payloads(df: DataFrame, batch_size: int, value_col: str = "embedding", **order) -> DataFrame:
    return write_payloads(df, "dense", value_col, batch_size, **order)


def write_sparse_payloads(df: DataFrame, batch_size: int, value_col: str = "sparse", **order) -> DataFrame:
    return write_payloads(df, "sparse", value_col, batch_size, **order)


def text_payloads(df: DataFrame, batch_size: int, value_col: str = "text", **order) -> DataFrame:
    return write_payloads(df, "text", value_col, batch_size, **order)


def _check(column: pa.Array, kind: str) -> None:
    t = column.type
    fits = {
        "text": pa.types.is_string(t) or pa.types.is_large_string(t),
        "dense": pa.types.is_fixed_size_list(t) or pa.types.is_list(t),
        "sparse": pa.types.is_list(t) and pa.types.is_struct(t.value_type),
    }[kind]
    if not fits:
        raise ValueError("first column must be a string column" if kind == "text" else f"not a {kind} column")


def _decode(payload: bytes | None, kind: str, all_batches: bool) -> Iterator[pa.Array]:
    """First columns of a payload's record batches, as Spark's Arrow types."""
    if payload is None:
        raise ValueError("no payload")
    reader = pa.ipc.open_stream(payload)
    target = {
        "text": pa.string(),
        "dense": pa.list_(pa.float32()),
        "sparse": pa.list_(pa.struct([("index", pa.int64()), ("value", pa.float32())])),
    }[kind]
    seen = False
    for batch in reader:
        seen = True
        column = batch.column(0)
        _check(column, kind)
        yield column.cast(target)
        if not all_batches:
            return
    if not seen:
        raise ValueError("no record batch in stream")


def read_arrow_payloads(
    df: DataFrame,
    key: str,
    payload_col: str = "payload",
    kind: str = "text",
    all_batches: bool = True,
    out: str = "value",
) -> DataFrame:
    """(key, position, value, _error): one row per payload entry.

    A payload that cannot be read gives one row with its error.  A sequential
    reader takes only the first record batch: ``all_batches=False``.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("position", T.LongType()),
            T.StructField(out, _VALUE[kind]),
            T.StructField("_error", T.StringType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, payload in enumerate(batch.column(1)):
                at = 0

                def rows(values: pa.Array | None, n: int, error: str | None, start: int) -> pa.RecordBatch:
                    value = values if values is not None else pa.nulls(n, pa.string())
                    return pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array([i] * n, pa.int32())),
                            pa.array(range(start, start + n), pa.int64()) if error is None else pa.nulls(n, pa.int64()),
                            value,
                            pa.array([error] * n, pa.string()),
                        ],
                        [key, "position", out, "_error"],
                    )

                try:
                    for column in _decode(payload.as_py(), kind, all_batches):
                        yield rows(column, len(column), None, at)
                        at += len(column)
                except (ValueError, OSError, pa.ArrowException) as exc:
                    empty = {
                        "text": pa.nulls(1, pa.string()),
                        "dense": pa.nulls(1, pa.list_(pa.float32())),
                        "sparse": pa.nulls(1, pa.list_(pa.struct([("index", pa.int64()), ("value", pa.float32())]))),
                    }[kind]
                    yield rows(empty, 1, f"INVALID_ARGUMENT: {exc}", at)

    return df.select(key, payload_col).mapInArrow(read, schema)


class ExplodePayload:
    """SQL table function: ``explode_payload(payload)`` -> (position, text)."""

    def eval(self, payload: bytes):
        at = 0
        for column in _decode(payload, "text", True):
            for value in column.to_pylist():
                yield at, value
                at += 1


def register_udtf(spark: SparkSession) -> None:
    spark.udtf.register("explode_payload", F.udtf(ExplodePayload, returnType="position int, text string"))
