"""Report sinks.  Reports have one row per configuration, small after aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textorbit import schemas
from textorbit.functions.formats import humanize_params
from textorbit.operators import latency as lt
from textorbit.session import cut


def write_report_csv(comparison: DataFrame, path: str) -> None:
    """The seventeen-column CSV, one file in report order."""
    ordered = lt.report_order(comparison).orderBy("size_ord", "query_ord", "model").coalesce(1)
    lt.format_comparison(ordered).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def _section(df: DataFrame, order: list[str], fields: list[Column], name: str) -> DataFrame:
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row"))
    listed = F.array_sort(F.collect_list(entry))
    return df.agg(F.transform(listed, lambda e: e["row"]).alias(name))


def report_document(comparison: DataFrame, hardware: dict, config: dict, run: dict) -> DataFrame:
    """One row: run facts, hardware, config, comparison[] and the two summaries."""
    comparison = cut(comparison)  # read by three sections
    rows = lt.report_order(comparison)
    stats = [F.col(f"{d}_{s}") for d in ("cpu", "gpu") for s in lt.STATS]
    compared = [
        F.col("model"), F.col("size"), F.col("num_parameters").alias("params"),
        humanize_params(F.col("num_parameters")).alias("params_str"), F.col("embedding_dim"),
        F.col("max_seq_length"), F.col("model_type"), F.col("cpu_load_time_ms"), F.col("gpu_load_time_ms"),
        F.col("query_length"), *stats, F.col("speedup"),
    ]
    sides = [F.col(f"{d}_{s}") for d in ("cpu", "gpu") for s in lt.STATS[:3]] + [F.col("avg_speedup")]
    by_query, by_size = lt.agg_by_query(comparison), lt.agg_by_model(comparison)
    literal = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    names = ["comparison", "aggregations_by_query_size", "aggregations_by_model_size"]
    sections = [
        _section(rows, ["size_ord", "query_ord", "model"], compared, names[0]),
        _section(by_query, ["ord"], [F.col("query_length"), *sides], names[1]),
        _section(by_size, ["ord"], [F.col("size").alias("model_size"), *sides], names[2]),
    ]
    rows_of_one = sections[0]
    for section in sections[1:]:
        rows_of_one = rows_of_one.unionByName(section, allowMissingColumns=True)
    return rows_of_one.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names]).select(
        *[F.lit(v).alias(k) for k, v in run.items()],
        literal(hardware).alias("hardware"),
        literal(config).alias("config"),
        *names,
    )


def write_report_json(comparison: DataFrame, hardware: dict, config: dict, run: dict, path: str) -> None:
    """The report document as one JSON object, nulls kept."""
    report_document(comparison, hardware, config, run).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def report_table_lines(comparison: DataFrame, gpu: bool = True) -> DataFrame:
    """(section, size_ord, query_ord, model, line): all table rows of a report.

    Sections: 0 models, 1 comparison, 2 by query length, 3 by size label.
    """
    comparison = cut(comparison)  # read by four sections
    none = F.lit("")
    by_query = lt.summary_lines(lt.agg_by_query(comparison), "query_length", gpu)
    by_size = lt.summary_lines(lt.agg_by_model(comparison), "size", gpu)
    flat = lambda n, df: df.select(F.lit(n).alias("section"), "size_ord", "query_ord", "model", "line")
    summed = lambda n, df: flat(
        n, df.select(F.col("ord").alias("size_ord"), F.lit(0).alias("query_ord"), none.alias("model"), "line")
    )
    return (
        flat(0, lt.model_lines(comparison))
        .unionByName(flat(1, lt.comparison_lines(comparison, gpu)))
        .unionByName(summed(2, by_query))
        .unionByName(summed(3, by_size))
    )


def write_report_text(comparison: DataFrame, path: str, gpu: bool = True) -> None:
    lines = report_table_lines(comparison, gpu).orderBy("section", "size_ord", "query_ord", "model")
    lines.coalesce(1).select("line").write.mode("overwrite").text(path)


def append_run_records(runs: DataFrame, path: str, mode: str, instance_name: str, batch_size: int) -> None:
    """Append throughput rows as nine-field JSON run records."""
    rows = runs.select(
        F.lit(mode).alias("mode"),
        F.lit(instance_name).alias("instance_name"),
        "num_texts",
        F.lit(batch_size).cast("long").alias("batch_size"),
        "num_requests",
        "total_duration_secs",
        "throughput_per_sec",
        "successful",
        "failed",
    )
    rows.select(*schemas.RUN_RECORD.names).write.mode("append").json(path)
