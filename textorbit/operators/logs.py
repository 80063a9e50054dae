"""Log lines per instance: slices and start-up verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that decide a start-up, tested in this order.
STARTED = ["Started HTTP server", "Starting HTTP server", "Starting gRPC server"]
ERROR = ["Error", "error:", "CUDA error"]
OUT_OF_MEMORY = ["out of memory", "CUDA_OUT_OF_MEMORY"]
INVALID_MODEL = ["not a valid", "Unsupported model"]
NOT_FOUND = ["404", "not found"]  # both on one line
CONTEXT_LINES = 5


def _bound(value: int | None, total: Column, otherwise: Column) -> Column:
    if value is None:
        return otherwise
    if value < 0:
        return F.greatest(total + value, F.lit(0).cast("long"))
    return F.least(F.lit(value).cast("long"), total)


def log_bounds(logs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Per instance: resolved start, end and number of lines."""
    total = F.col("total_lines")
    return (
        logs.groupBy("instance")
        .agg((F.max("line_no") + 1).alias("total_lines"))
        .withColumn("start", _bound(start, total, F.lit(0).cast("long")))
        .withColumn("end", _bound(end, total, total))
    )


def log_slice(logs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines [start, end) of every instance's log; negative bounds count from the end.

    Rows carry the resolved bounds and the total; an empty slice has no rows
    (``log_bounds`` still reports it).
    """
    bounds = log_bounds(logs, start, end)
    inside = (F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("end"))
    return logs.join(bounds, "instance").filter(inside)


def _any(line: Column, texts: list[str]) -> Column:
    found = F.lit(False)
    for t in texts:
        found = found | line.contains(t)
    return found


def line_verdict(line: Column) -> Column:
    """What a line decides, or null."""
    return (
        F.when(_any(line, STARTED), "ok")
        .when(_any(line, ERROR), "error")
        .when(_any(line, OUT_OF_MEMORY), "out_of_memory")
        .when(line.contains(NOT_FOUND[0]) & line.contains(NOT_FOUND[1]), "model_not_found")
        .when(_any(line, INVALID_MODEL), "invalid_model")
    )


def log_verdict(logs: DataFrame) -> DataFrame:
    """First decisive line per instance: (instance, verdict, line_no, detail).

    The detail of an error is its line and the next five.  Without a decisive
    line the process ended unexpectedly.  One ``min_by`` per instance finds the
    line; the at most six detail lines are joined back.
    """
    verdict = line_verdict(F.col("line"))
    first = logs.groupBy("instance").agg(
        F.min_by(verdict, F.when(verdict.isNotNull(), F.col("line_no"))).alias("verdict"),
        F.min(F.when(verdict.isNotNull(), F.col("line_no"))).alias("first_no"),
    )
    last = F.col("first_no") + F.when(F.col("verdict") == "error", CONTEXT_LINES).otherwise(0)
    near = logs.join(first, "instance").filter(F.col("line_no").between(F.col("first_no"), last))
    detail = near.groupBy("instance").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"
        ).alias("detail")
    )
    return first.join(detail, "instance", "left").select(
        "instance",
        F.coalesce("verdict", F.lit("unexpected_exit")).alias("verdict"),
        F.col("first_no").alias("line_no"),
        "detail",
    )
