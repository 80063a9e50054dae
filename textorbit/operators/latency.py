"""Latency analytics: exact timing statistics, device comparison, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.functions.formats import fixed, humanize_ms, humanize_params, micros, number_or, round6, short_name
from textorbit.session import cut

CONFIG = ["model", "size", "query_length"]

# Report position of a size label; unknown labels get 99.
SIZE_ORDER = {
    "tiny-minilm-l6": 1,
    "tiny-minilm-l3": 2,
    "small": 10,
    "small-minilm-l12": 11,
    "small-bge": 12,
    "medium": 20,
    "medium-mpnet": 21,
    "medium-bge": 22,
    "medium-gte": 23,
    "medium-e5": 24,
    "large": 30,
    "large-bge": 31,
    "large-gte": 32,
    "large-e5": 33,
    "multi-minilm": 40,
    "multi-e5": 41,
    "code-jina": 50,
    "long-jina": 51,
    "matryoshka-nomic": 52,
    "sparse-small": 100,
    "sparse-large": 101,
}
# Report position of a query length; unknown lengths get 99.
QUERY_ORDER = {"short": 0, "medium": 1, "long": 2}
# Order of the labels in the per-size summary.
SIZE_SUMMARY_ORDER = [
    "small", "medium", "large", "tiny-minilm-l6", "tiny-minilm-l3", "small-minilm-l12", "small-bge",
    "medium-mpnet", "medium-bge", "medium-gte", "medium-e5", "large-bge", "large-gte", "large-e5",
    "multi-minilm", "multi-e5", "code-jina", "long-jina", "matryoshka-nomic", "sparse-small", "sparse-large",
]
UNKNOWN_ORDER = 99


def _ordinal(label: Column, table: dict[str, int], otherwise: int | None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(lookup, label)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


# --- exact order statistics -------------------------------------------------

_EPS = 2e-4  # half width of a split around a wanted probability
_ACCURACY = 10000


def _marks(probabilities: Sequence[float]) -> list[float]:
    return sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-_EPS, _EPS)})


def splits_of(value: str, probabilities: Sequence[float]) -> Column:
    """Aggregate: approximate quantiles just below and above each probability."""
    return F.percentile_approx(value, _marks(probabilities), _ACCURACY)


def rank_values(
    samples: DataFrame, plan: DataFrame, keys: Sequence[str], value: str, splits: int
) -> DataFrame:
    """Exact values at given ranks, as (keys, rank, value); rank 1 is the smallest.

    ``plan`` has one row per group: keys, ``_splits`` (``splits_of``) and
    ``_ranks``, the wanted ranks.  No group is ever sorted whole.  The splits
    cut each group's value range; exact counts per piece tell which piece holds
    a rank and at which place; only those pieces are counted by value and
    scanned.  The splits steer the work, not the result: bad ones make a larger
    piece, never a wrong value.
    """
    v = F.col(value)
    # Values equal to a split form a piece of their own: a mass of ties stays one value.
    bounds = [F.get("_splits", F.lit(i)) for i in range(splits)]
    piece = sum((v > x).cast("int") + (v >= x).cast("int") for x in bounds)
    parted = samples.select(*keys, value).join(plan.select(*keys, "_splits"), list(keys)).select(
        *keys, value, piece.alias("_piece")
    )
    upto_piece = Window.partitionBy(*keys).orderBy("_piece")  # at most 2 * splits + 1 rows
    ends = (
        parted.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto_piece))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    inside = F.filter("_ranks", lambda r: (r > F.col("_start")) & (r <= F.col("_end")))
    wanted = cut(
        ends.join(plan.select(*keys, "_ranks"), list(keys))
        .select(*keys, "_piece", "_start", inside.alias("_in"))
        .filter(F.size("_in") > 0)
    )
    counted = (
        parted.join(wanted, [*keys, "_piece"])
        .groupBy(*keys, "_piece", "_start", "_in", value)
        .agg(F.count("*").alias("_n"))
    )
    upto_value = Window.partitionBy(*keys, "_piece").orderBy(value)
    placed = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(upto_value))
    found = F.filter("_in", lambda r: (r > F.col("_end") - F.col("_n")) & (r <= F.col("_end")))
    return placed.select(*keys, F.explode(found).alias("rank"), F.col(value).alias("value"))


def _by_rank(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _at): the few found ranks of a group as a map."""
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))


def _at(rank: Column) -> Column:
    return F.try_element_at(F.col("_at"), rank)


def _exclusive_rank(n: Column, i: int, q: int) -> Column:
    """Lower rank of the i-th of q exclusive quantiles, kept inside the data."""
    return F.greatest(F.lit(1).cast("long"), F.least(F.floor((n + 1) * i / q).cast("long"), n - 1))


def _between(n: Column, j: Column, i: int, q: int) -> Column:
    delta = (n + 1) * i - j * q
    return (_at(j) * (q - delta) + _at(j + 1) * delta) / q


def percentile_exclusive(
    samples: DataFrame, keys: Sequence[str], value: str, i: int, q: int, out: str = "value"
) -> DataFrame:
    """Exact i-th of q exclusive quantiles per group, linear between two ranks.

    Groups with one sample have no such quantile and give null.
    """
    rows = samples.filter(F.col(value).isNotNull())
    n, j = F.col("n"), F.col("_j")
    plan = rows.groupBy(*keys).agg(F.count(value).alias("n"), splits_of(value, [i / q]).alias("_splits"))
    plan = cut(
        plan.withColumn("_j", _exclusive_rank(n, i, q)).withColumn("_ranks", F.when(n > 1, F.array(j, j + 1)))
    )
    at = _by_rank(rank_values(rows, plan, keys, value, 2), keys)
    return plan.join(at, list(keys), "left").select(*keys, "n", _between(n, j, i, q).alias(out))


def timing_stats(samples: DataFrame, keys: Sequence[str], value: str = "ms") -> DataFrame:
    """Mean, sample deviation (0 for one sample), median, p95 and p99 per group.

    p95 is the 19th of 20 exclusive quantiles from 20 samples on, p99 the 99th
    of 100 from 100 samples on; below that both are the maximum.  Keys must not
    be null, null samples are left out.  Three scans
    of the samples, each combined map-side; shuffled are group rows and the
    values next to the wanted ranks.
    """
    rows = samples.filter(F.col(value).isNotNull())
    targets = [0.5, 0.95, 0.99]
    n = F.col("n")
    none = F.array().cast("array<bigint>")
    low, high, j95, j99 = F.col("_low"), F.col("_high"), F.col("_j95"), F.col("_j99")
    plan = cut(
        rows.groupBy(*keys)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean_ms"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_ms"),
            F.max(value).alias("max_ms"),
            splits_of(value, targets).alias("_splits"),
        )
        .withColumns(
            {
                "_low": F.floor((n + 1) / 2).cast("long"),
                "_high": F.floor(n / 2).cast("long") + 1,
                "_j95": _exclusive_rank(n, 19, 20),
                "_j99": _exclusive_rank(n, 99, 100),
            }
        )
        .withColumn(
            "_ranks",
            F.array_distinct(
                F.concat(
                    F.array(low, high),
                    F.when(n >= 20, F.array(j95, j95 + 1)).otherwise(none),
                    F.when(n >= 100, F.array(j99, j99 + 1)).otherwise(none),
                )
            ),
        )
    )
    at = _by_rank(rank_values(rows, plan, keys, value, 2 * len(targets)), keys)
    return plan.join(at, list(keys)).select(
        *keys,
        "n",
        "mean_ms",
        "std_ms",
        ((_at(low) + _at(high)) / 2).alias("p50_ms"),
        F.when(n >= 20, _between(n, j95, 19, 20)).otherwise(F.col("max_ms")).alias("p95_ms"),
        F.when(n >= 100, _between(n, j99, 99, 100)).otherwise(F.col("max_ms")).alias("p99_ms"),
    )


# --- comparison and summaries ------------------------------------------------

STATS = ["mean_ms", "p50_ms", "p95_ms", "p99_ms"]
INFO = ["embedding_dim", "num_parameters", "max_seq_length", "model_type"]


def speedup(cpu: Column, gpu: Column) -> Column:
    return F.when(gpu > 0, cpu / gpu)


def compare_devices(stats: DataFrame, run_order: str = "run_order") -> DataFrame:
    """CPU rows with their GPU side; every device that is not ``cpu`` is a GPU.

    A configuration measured twice keeps its last run, of two devices in one run
    the last by name.  Model facts come from
    the CPU side; configurations without a CPU row vanish.  Both sides come out
    of one aggregation per configuration instead of a self-join.
    """
    columns = [*STATS, "load_time_ms", *INFO]
    for c in columns:
        if c not in stats.columns:
            stats = stats.withColumn(c, F.lit(None).cast("string" if c == "model_type" else "double"))

    def side(condition: Column, wanted: list[str]) -> Column:
        return F.max_by(F.when(condition, F.struct(*wanted)), F.when(condition, F.struct(run_order, "device")))

    on_cpu = F.col("device") == "cpu"
    timed = [*STATS, "load_time_ms"]
    sides = stats.groupBy(*CONFIG).agg(side(on_cpu, columns).alias("_c"), side(~on_cpu, timed).alias("_g"))
    return (
        sides.filter(F.col("_c").isNotNull())
        .select(
            *CONFIG,
            *[F.col(f"_c.{c}").alias(f"cpu_{c}") for c in timed],
            *[F.col(f"_c.{c}").alias(c) for c in INFO],
            *[F.col(f"_g.{c}").alias(f"gpu_{c}") for c in timed],
        )
        .withColumn("speedup", speedup(F.col("cpu_mean_ms"), F.col("gpu_mean_ms")))
    )


def report_order(comparison: DataFrame) -> DataFrame:
    """Add the report's sort keys; sort by (size_ord, query_ord, model)."""
    return comparison.withColumns(
        {
            "size_ord": _ordinal(F.col("size"), SIZE_ORDER, UNKNOWN_ORDER),
            "query_ord": _ordinal(F.col("query_length"), QUERY_ORDER, UNKNOWN_ORDER),
        }
    )


def _summary(comparison: DataFrame, key: str, table: dict[str, int]) -> DataFrame:
    """Means to six decimals: which task ends first then never shows in a printed digit."""
    sides = [f"{side}_{s}" for side in ("cpu", "gpu") for s in ("mean_ms", "p50_ms", "p95_ms")]
    return (
        comparison.withColumn("ord", _ordinal(F.col(key), table, None))
        .filter(F.col("ord").isNotNull())
        .groupBy(key, "ord")
        .agg(*[round6(F.avg(c)).alias(c) for c in sides])
        .withColumn("avg_speedup", speedup(F.col("cpu_mean_ms"), F.col("gpu_mean_ms")))
    )


def agg_by_query(comparison: DataFrame) -> DataFrame:
    """Unweighted means per query length; only the three known lengths."""
    return _summary(comparison, "query_length", QUERY_ORDER)


def agg_by_model(comparison: DataFrame) -> DataFrame:
    """Unweighted means per size label; only the known labels."""
    return _summary(comparison, "size", {s: i for i, s in enumerate(SIZE_SUMMARY_ORDER)})


def dedupe_models(comparison: DataFrame) -> DataFrame:
    """First row per model in report order, by ``min_by`` instead of a window."""
    ordered = report_order(comparison)
    rest = [c for c in ordered.columns if c != "model"]
    first = ordered.groupBy("model").agg(
        F.min_by(F.struct(*rest), F.struct("size_ord", "query_ord", "size", "query_length")).alias("_r")
    )
    return first.select("model", "_r.*")


def run_matrix(models: DataFrame, devices: Sequence[str], queries: Sequence[str], iterations: int) -> DataFrame:
    """One row per model x device x query x iteration, by exploding short literals."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (
        models.withColumn("device", F.explode(lits(devices)))
        .withColumn("query_length", F.explode(lits(queries)))
        .withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    )


def throughput(requests: DataFrame, run: str = "run_id", unit: str = "texts") -> DataFrame:
    """Per run: good texts per elapsed second, and the run's counts.

    ``unit`` tells what one request is: a text, or a batch of texts.
    """
    ok = F.col("ok")
    texts = F.col("n_texts") if unit == "batches" else F.lit(1)
    elapsed = F.max(micros("end_ts")) - F.min(micros("start_ts"))
    runs = requests.groupBy(run).agg(
        F.count("*").alias("num_requests"),
        F.coalesce(F.sum(texts), F.lit(0)).cast("long").alias("num_texts"),
        F.coalesce(F.sum(F.when(ok, texts)), F.lit(0)).cast("long").alias("successful"),
        F.coalesce(F.sum(F.when(~ok, texts)), F.lit(0)).cast("long").alias("failed"),
        (elapsed / 1e6).alias("total_duration_secs"),
    )
    secs = F.col("total_duration_secs")
    return runs.withColumn("throughput_per_sec", F.when(secs > 0, F.col("successful") / secs))


def compare_runs(runs: DataFrame, baseline: str, key: str = "workload", mode: str = "mode") -> DataFrame:
    """Every other mode against the baseline mode: whole-number difference and percent."""
    rate = F.bround("throughput_per_sec", 0).cast("long")
    base = runs.filter(F.col(mode) == baseline).select(key, rate.alias("baseline_rate"))
    other = runs.filter(F.col(mode) != baseline).select(key, mode, rate.alias("rate"))
    return other.join(base, key).withColumn("diff", F.col("baseline_rate") - F.col("rate")).withColumn(
        "percent",
        F.when(F.col("baseline_rate") > 0, fixed(F.col("diff") / F.col("baseline_rate") * 100, 1)).otherwise("0.0"),
    )


def overhead(direct: DataFrame, routed: DataFrame, keys: Sequence[str] = ("workload", "size")) -> DataFrame:
    """Absolute and percent overhead of routed over direct latency."""
    d = direct.select(*keys, F.col("us").alias("direct_us"))
    r = routed.select(*keys, F.col("us").alias("routed_us"))
    return d.join(r, list(keys)).withColumn("overhead_us", F.col("routed_us") - F.col("direct_us")).withColumn(
        "overhead_pct", F.when(F.col("direct_us") > 0, F.col("overhead_us") / F.col("direct_us") * 100)
    )


# --- report texts --------------------------------------------------------------

# Columns of the report.
CSV_COLUMNS = [
    "model", "size", "params", "embedding_dim", "max_seq_length", "cpu_load_time_ms", "gpu_load_time_ms",
    "query_length", "cpu_mean_ms", "cpu_p50_ms", "cpu_p95_ms", "cpu_p99_ms",
    "gpu_mean_ms", "gpu_p50_ms", "gpu_p95_ms", "gpu_p99_ms", "speedup",
]


def _whole(name: str, missing: str) -> Column:
    c = F.col(name)
    return F.when(c.isNotNull() & (c != 0), c.cast("long").cast("string")).otherwise(missing)


def format_comparison(comparison: DataFrame) -> DataFrame:
    """The seventeen report columns as text; null and zero are empty on optional ones.

    Numbers are taken to six decimals before they are printed with fewer: a mean of
    doubles changes in its last digits with the order of its rows, and must not
    fall on either side of a printed half.
    """
    out = {
        "model": F.col("model"),
        "size": F.col("size"),
        "params": _whole("num_parameters", ""),
        "embedding_dim": _whole("embedding_dim", ""),
        "max_seq_length": _whole("max_seq_length", ""),
        "cpu_load_time_ms": number_or(F.col("cpu_load_time_ms"), 1, ""),
        "gpu_load_time_ms": number_or(F.col("gpu_load_time_ms"), 1, ""),
        "query_length": F.col("query_length"),
        **{f"cpu_{s}": fixed(round6(F.col(f"cpu_{s}")), 4) for s in STATS},
        **{f"gpu_{s}": number_or(round6(F.col(f"gpu_{s}")), 4, "") for s in STATS},
        "speedup": number_or(round6(F.col("speedup")), 2, ""),
    }
    return comparison.select(*[out[c].alias(c) for c in CSV_COLUMNS])


def table_line(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _timing_cells(gpu: bool, rate: str) -> list[Column]:
    stats = STATS[:3]
    cells = [fixed(round6(F.col(f"cpu_{s}")), 2) for s in stats]
    if gpu:
        cells += [number_or(round6(F.col(f"gpu_{s}")), 2, "N/A") for s in stats]
        cells.append(number_or(round6(F.col(rate)), 1, "N/A", "x"))
    return cells


def comparison_lines(comparison: DataFrame, gpu: bool = True, name_length: int | None = None) -> DataFrame:
    """(size_ord, query_ord, model, line): one table row per configuration."""
    cells = [
        short_name(F.col("model"), name_length),
        F.col("size"),
        humanize_params(F.col("num_parameters")),
        _whole("embedding_dim", "?"),
        F.col("query_length"),
        *_timing_cells(gpu, "speedup"),
    ]
    return report_order(comparison).select("size_ord", "query_ord", "model", table_line(cells).alias("line"))


def summary_lines(summary: DataFrame, key: str, gpu: bool = True) -> DataFrame:
    """(ord, line): one table row per summary row."""
    return summary.select("ord", table_line([F.col(key), *_timing_cells(gpu, "avg_speedup")]).alias("line"))


def model_lines(comparison: DataFrame) -> DataFrame:
    """(size_ord, query_ord, model, line): one model-facts row per model."""
    cells = [
        short_name(F.col("model")),
        F.col("size"),
        humanize_params(F.col("num_parameters")),
        _whole("embedding_dim", "?"),
        _whole("max_seq_length", "?"),
        humanize_ms(F.col("cpu_load_time_ms")),
        F.coalesce(F.when(F.col("model_type") != "", F.col("model_type")), F.lit("?")),
    ]
    return dedupe_models(comparison).select("size_ord", "query_ord", "model", table_line(cells).alias("line"))
