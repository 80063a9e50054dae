"""Queries on latency samples derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textorbit.functions import formats as fm
from textorbit.functions.formats import micros, round6
from textorbit.operators import latency as lt
from textorbit.plans.registry import Tables, query
from textorbit.plans.text import r6

# Event types stand for models; one of the five size labels is unknown to the report.
MODELS = {
    "click": ("org/click-base", "small", 22713216, 384, 256, 707.0, "bert"),
    "view": ("org/view-large", "large", 335141888, 1024, 512, 1350.0, "bert"),
    "purchase": ("acme/purchase-mini", "tiny-minilm-l6", 1500000000, 384, 128, 65.4, None),
    "signup": ("acme/signup-splade", "sparse-small", None, 30522, 0, None, "splade"),
    "error": ("solo-error", "unlisted", 4416698, None, 512, 2.5, ""),
}


def _sql_value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_MODEL_ROWS = ", ".join(f"({', '.join(_sql_value(x) for x in (k, *v))})" for k, v in MODELS.items())
_MODELS_SQL = f"""
    models(event_type, model, size, num_parameters, embedding_dim, max_seq_length, load_time_ms, model_type) AS (
      SELECT a, b, c, d::BIGINT, e::INTEGER, f::INTEGER, g::DOUBLE, h
      FROM (VALUES {_MODEL_ROWS}) v(a, b, c, d, e, f, g, h))
"""
_SAMPLES_SQL = f"""
    {_MODELS_SQL},
    samples AS (
      SELECT model, size, CASE event_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' ELSE 'huge' END AS query_length,
             CASE WHEN event_type = 'signup' THEN 'cpu' WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'cuda'
                  WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device, user_id, event_id, value AS ms
      FROM events JOIN models USING (event_type))
"""


def models_table(t: Tables):
    return t.spark.createDataFrame(
        [(k, *v) for k, v in MODELS.items()],
        "event_type string, model string, size string, num_parameters long, embedding_dim int,"
        " max_seq_length int, load_time_ms double, model_type string",
    )


def samples(t: Tables):
    """Timing samples: two devices, four query lengths.

    One model was never run on the GPU, one length of another never on the CPU.
    """
    names = F.create_map(*[x for k, v in MODELS.items() for x in (F.lit(k), F.struct(F.lit(v[0]), F.lit(v[1])))])
    m = F.try_element_at(names, F.col("event_type"))
    lengths = F.array(*[F.lit(x) for x in ("short", "medium", "long", "huge")])
    device = (
        F.when(F.col("event_type") == "signup", "cpu")
        .when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 2), "cuda")
        .when(F.col("user_id") % 2 == 1, "cuda")
        .otherwise("cpu")
    )
    return t.events.select(
        m["col1"].alias("model"),
        m["col2"].alias("size"),
        F.get(lengths, (F.col("event_id") % 4).cast("int")).alias("query_length"),
        device.alias("device"),
        "user_id",
        "event_id",
        F.col("value").alias("ms"),
    )


def stats_sql(source: str, keys: str, out: str = "stats", rounded: bool = False) -> str:
    """CTE text of exact timing statistics, by ranking every sample."""
    f = r6 if rounded else (lambda x: x)
    j95, j99 = "(19 * (n + 1) // 20)", "(99 * (n + 1) // 100)"
    at = lambda r: f"max(CASE WHEN i = {r} THEN ms END)"

    def between(j: str, i: int, q: int) -> str:
        d = f"({i} * (n + 1) - {q} * {j})"
        return f"({at(j)} * ({q} - {d}) + {at(j + ' + 1')} * {d}) / {q}.0::DOUBLE"

    return f"""
    {out}_r AS (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms) AS i, count(*) OVER (PARTITION BY {keys}) AS n
      FROM {source}),
    {out} AS (
      SELECT {keys}, n, {f("avg(ms)")} AS mean_ms, {f("coalesce(stddev_samp(ms), 0)")} AS std_ms,
             {f(f"({at('(n + 1) // 2')} + {at('n // 2 + 1')}) / 2")} AS p50_ms,
             {f(f"CASE WHEN n >= 20 THEN {between(j95, 19, 20)} ELSE max(ms) END")} AS p95_ms,
             {f(f"CASE WHEN n >= 100 THEN {between(j99, 99, 100)} ELSE max(ms) END")} AS p99_ms
      FROM {out}_r GROUP BY {keys}, n)
    """


def _rounded(df, names):
    return df.withColumns({n: round6(F.col(n)) for n in names})


_STAT_COLUMNS = ["mean_ms", "std_ms", "p50_ms", "p95_ms", "p99_ms"]
_ALL_KEYS = "model, size, query_length, device"


@query(f"WITH {_SAMPLES_SQL}, {stats_sql('samples', _ALL_KEYS, rounded=True)} SELECT * FROM stats")
def timing_stats(t: Tables):
    return _rounded(lt.timing_stats(samples(t), [*lt.CONFIG, "device"]), _STAT_COLUMNS)


@query(f"WITH {_SAMPLES_SQL}, {stats_sql('samples', 'user_id, model', rounded=True)} SELECT * FROM stats")
def timing_stats_small_groups(t: Tables):
    return _rounded(lt.timing_stats(samples(t), ["user_id", "model"]), _STAT_COLUMNS)


@query(
    f"""
    WITH r AS (
      SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n
      FROM events),
    j AS (SELECT *, greatest(1, least(3 * (n + 1) // 4, n - 1)) AS j FROM r),
    p AS (SELECT user_id, n, j, max(CASE WHEN i = j THEN value END) AS lo, max(CASE WHEN i = j + 1 THEN value END) AS hi FROM j GROUP BY 1, 2, 3)
    SELECT user_id, n, {r6("(lo * (4 - (3 * (n + 1) - 4 * j)) + hi * (3 * (n + 1) - 4 * j)) / 4.0::DOUBLE")} AS q3
    FROM p
    """
)
def percentile_exclusive(t: Tables):
    return lt.percentile_exclusive(t.events, ["user_id"], "value", 3, 4, "q3").withColumn("q3", round6(F.col("q3")))


_COMPARE_SQL = f"""
    {_SAMPLES_SQL}, {stats_sql("samples", _ALL_KEYS)},
    cmp AS (
      SELECT c.model, c.size, c.query_length,
             c.mean_ms AS cpu_mean_ms, c.p50_ms AS cpu_p50_ms, c.p95_ms AS cpu_p95_ms, c.p99_ms AS cpu_p99_ms,
             m.load_time_ms AS cpu_load_time_ms, m.embedding_dim, m.num_parameters, m.max_seq_length, m.model_type,
             g.mean_ms AS gpu_mean_ms, g.p50_ms AS gpu_p50_ms, g.p95_ms AS gpu_p95_ms, g.p99_ms AS gpu_p99_ms,
             CASE WHEN g.model IS NOT NULL THEN m.load_time_ms END AS gpu_load_time_ms,
             CASE WHEN g.mean_ms > 0 THEN c.mean_ms / g.mean_ms END AS speedup
      FROM stats c JOIN models m USING (model)
      LEFT JOIN stats g ON g.model = c.model AND g.size = c.size AND g.query_length = c.query_length AND g.device = 'cuda'
      WHERE c.device = 'cpu')
"""
_NUMBERS = [f"{d}_{s}" for d in ("cpu", "gpu") for s in lt.STATS]


def comparison(t: Tables):
    stats = lt.timing_stats(samples(t), [*lt.CONFIG, "device"])
    facts = models_table(t).drop("event_type", "size")
    return lt.compare_devices(stats.join(F.broadcast(facts), "model").withColumn("run_order", F.lit(1)))  # 5 rows


@query(
    f"""
    WITH {_COMPARE_SQL}
    SELECT * REPLACE ({", ".join(f"{r6(c)} AS {c}" for c in [*_NUMBERS, "speedup"])}) FROM cmp
    """
)
def compare_devices(t: Tables):
    return _rounded(comparison(t), [*_NUMBERS, "speedup"])


@query(
    """
    WITH d AS (
      SELECT event_type AS model, 'small' AS size, 'short' AS query_length, user_id % 3 AS dev, value, event_id,
             row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id DESC) AS r,
             row_number() OVER (PARTITION BY event_type, user_id % 3 > 0 ORDER BY event_id DESC) AS g
      FROM events)
    SELECT c.model, c.value AS cpu_mean_ms, g.value AS gpu_mean_ms
    FROM d c LEFT JOIN d g ON g.model = c.model AND g.dev > 0 AND g.g = 1
    WHERE c.dev = 0 AND c.r = 1
    """
)
def compare_devices_last_run(t: Tables):
    """Every event is one measured run; the last one per side counts, any other device is a GPU."""
    devices = F.array(F.lit("cpu"), F.lit("cuda"), F.lit("mps"))
    runs = t.events.select(
        F.col("event_type").alias("model"), F.lit("small").alias("size"), F.lit("short").alias("query_length"),
        F.get(devices, (F.col("user_id") % 3).cast("int")).alias("device"), F.col("event_id").alias("run_order"),
        *[F.col("value").alias(s) for s in lt.STATS],
    )
    return lt.compare_devices(runs).select("model", "cpu_mean_ms", "gpu_mean_ms")


# Written out, so that a wrong entry of the operator's tables shows.
_SIZE_ORD = """CASE size WHEN 'tiny-minilm-l6' THEN 1 WHEN 'tiny-minilm-l3' THEN 2 WHEN 'small' THEN 10
  WHEN 'small-minilm-l12' THEN 11 WHEN 'small-bge' THEN 12 WHEN 'medium' THEN 20 WHEN 'medium-mpnet' THEN 21
  WHEN 'medium-bge' THEN 22 WHEN 'medium-gte' THEN 23 WHEN 'medium-e5' THEN 24 WHEN 'large' THEN 30
  WHEN 'large-bge' THEN 31 WHEN 'large-gte' THEN 32 WHEN 'large-e5' THEN 33 WHEN 'multi-minilm' THEN 40
  WHEN 'multi-e5' THEN 41 WHEN 'code-jina' THEN 50 WHEN 'long-jina' THEN 51 WHEN 'matryoshka-nomic' THEN 52
  WHEN 'sparse-small' THEN 100 WHEN 'sparse-large' THEN 101 ELSE 99 END"""
_QUERY_ORD = "CASE query_length WHEN 'short' THEN 0 WHEN 'medium' THEN 1 WHEN 'long' THEN 2 ELSE 99 END"


@query(
    f"""
    WITH {_COMPARE_SQL}
    SELECT model, size, query_length, {_SIZE_ORD}::INTEGER AS size_ord, {_QUERY_ORD}::INTEGER AS query_ord
    FROM cmp ORDER BY 4, 5, 1
    """
)
def report_order(t: Tables):
    ordered = lt.report_order(comparison(t)).orderBy("size_ord", "query_ord", "model")
    return ordered.select("model", "size", "query_length", "size_ord", "query_ord")


_SIDES = [f"{d}_{s}" for d in ("cpu", "gpu") for s in lt.STATS[:3]]
_SIDE_MEANS = ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in _SIDES)


def _summary_sql(key: str, where: str, ord_sql: str) -> str:
    return f"""
    {_COMPARE_SQL},
    a AS (SELECT {key}, {_SIDE_MEANS} FROM cmp WHERE {where} GROUP BY 1),
    summary AS (
      SELECT *, ({ord_sql})::INTEGER AS ord, CASE WHEN gpu_mean_ms > 0 THEN cpu_mean_ms / gpu_mean_ms END AS avg_speedup FROM a)
    """


_BY_QUERY = _summary_sql("query_length", "query_length IN ('short', 'medium', 'long')", _QUERY_ORD)
_SUMMARY_POS = """CASE size WHEN 'small' THEN 0 WHEN 'medium' THEN 1 WHEN 'large' THEN 2 WHEN 'tiny-minilm-l6' THEN 3
  WHEN 'tiny-minilm-l3' THEN 4 WHEN 'small-minilm-l12' THEN 5 WHEN 'small-bge' THEN 6 WHEN 'medium-mpnet' THEN 7
  WHEN 'medium-bge' THEN 8 WHEN 'medium-gte' THEN 9 WHEN 'medium-e5' THEN 10 WHEN 'large-bge' THEN 11
  WHEN 'large-gte' THEN 12 WHEN 'large-e5' THEN 13 WHEN 'multi-minilm' THEN 14 WHEN 'multi-e5' THEN 15
  WHEN 'code-jina' THEN 16 WHEN 'long-jina' THEN 17 WHEN 'matryoshka-nomic' THEN 18 WHEN 'sparse-small' THEN 19
  WHEN 'sparse-large' THEN 20 END"""
_BY_SIZE = _summary_sql("size", f"{_SUMMARY_POS} IS NOT NULL", _SUMMARY_POS)
_REPLACE = ", ".join(f"{r6(c)} AS {c}" for c in [*_SIDES, "avg_speedup"])


@query(f"WITH {_BY_QUERY} SELECT * REPLACE ({_REPLACE}) FROM summary")
def agg_by_query(t: Tables):
    return _rounded(lt.agg_by_query(comparison(t)), [*_SIDES, "avg_speedup"])


@query(f"WITH {_BY_SIZE} SELECT * REPLACE ({_REPLACE}) FROM summary")
def agg_by_model(t: Tables):
    return _rounded(lt.agg_by_model(comparison(t)), [*_SIDES, "avg_speedup"])


@query(
    f"""
    WITH {_COMPARE_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_SIZE_ORD}, {_QUERY_ORD}) AS r FROM cmp)
    SELECT model, size, query_length, {r6("cpu_mean_ms")} AS cpu_mean_ms FROM o WHERE r = 1
    """
)
def dedupe_models(t: Tables):
    return lt.dedupe_models(comparison(t)).select(
        "model", "size", "query_length", round6(F.col("cpu_mean_ms")).alias("cpu_mean_ms")
    )


@query(
    """
    SELECT p_partkey, device, query_length, iteration::INTEGER AS iteration
    FROM part CROSS JOIN (VALUES ('cpu'), ('cuda')) d(device)
    CROSS JOIN (VALUES ('short'), ('medium'), ('long')) q(query_length)
    CROSS JOIN (SELECT unnest(range(2)) AS iteration)
    """
)
def run_matrix(t: Tables):
    return lt.run_matrix(t.part.select("p_partkey"), ["cpu", "cuda"], ["short", "medium", "long"], 2)


_THROUGHPUT = """
    SELECT user_id AS run_id, count(*) AS num_requests, sum({n})::BIGINT AS num_texts,
           sum(CASE WHEN event_type <> 'error' THEN {n} ELSE 0 END)::BIGINT AS successful,
           sum(CASE WHEN event_type = 'error' THEN {n} ELSE 0 END)::BIGINT AS failed,
           (epoch_us(max(ts)) + 1000 - epoch_us(min(ts))) / 1e6 AS total_duration_secs
    FROM events GROUP BY 1
"""


def request_log(t: Tables):
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("ts").alias("start_ts"),
        F.timestamp_micros(micros("ts") + 1000).alias("end_ts"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 32 + 1).alias("n_texts"),
    )


@query(
    f"""
    WITH a AS ({_THROUGHPUT.format(n="1")})
    SELECT *, {r6("successful / total_duration_secs")} AS throughput_per_sec FROM a
    """
)
def throughput_texts(t: Tables):
    return _rounded(lt.throughput(request_log(t)), ["throughput_per_sec"])


@query(
    f"""
    WITH a AS ({_THROUGHPUT.format(n="(event_id % 32 + 1)")})
    SELECT *, {r6("successful / total_duration_secs")} AS throughput_per_sec FROM a
    """
)
def throughput_batches(t: Tables):
    return _rounded(lt.throughput(request_log(t), unit="batches"), ["throughput_per_sec"])


@query(
    """
    WITH r AS (
      SELECT user_id AS workload, event_type AS mode, sum((value * 100)::BIGINT)::BIGINT / 8.0::DOUBLE AS rate
      FROM events GROUP BY 1, 2),
    b AS (SELECT workload, round_even(rate, 0)::BIGINT AS baseline_rate FROM r WHERE mode = 'view')
    SELECT workload, mode, round_even(rate, 0)::BIGINT AS rate, baseline_rate,
           baseline_rate - round_even(rate, 0)::BIGINT AS diff,
           CASE WHEN baseline_rate > 0 THEN printf('%.1f', (baseline_rate - round_even(rate, 0)::BIGINT) / baseline_rate::DOUBLE * 100) ELSE '0.0' END AS percent
    FROM r JOIN b USING (workload) WHERE mode <> 'view'
    """
)
def compare_runs(t: Tables):
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    runs = t.events.groupBy(F.col("user_id").alias("workload"), F.col("event_type").alias("mode")).agg(
        (cents / 8).alias("throughput_per_sec")
    )
    return lt.compare_runs(runs, "view")


@query(
    f"""
    WITH a AS (SELECT user_id AS workload, event_type AS size, user_id % 2 AS x, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2)
    SELECT workload, size, lo AS direct_us, hi AS routed_us, {r6("hi - lo")} AS overhead_us,
           {r6("CASE WHEN lo > 0 THEN (hi - lo) / lo * 100 END")} AS overhead_pct
    FROM a
    """
)
def overhead(t: Tables):
    groups = t.events.groupBy(F.col("user_id").alias("workload"), F.col("event_type").alias("size"))
    out = lt.overhead(groups.agg(F.min("value").alias("us")), groups.agg(F.max("value").alias("us")))
    return _rounded(out, ["overhead_us", "overhead_pct"])


_OPT = "CASE WHEN {0} IS NULL OR {0} = 0 THEN '{2}' ELSE printf('%.{1}f', {0}) END"
_WHOLE = "CASE WHEN {0} IS NULL OR {0} = 0 THEN '{1}' ELSE {0}::BIGINT::VARCHAR END"


def _f(column: str, digits: int, missing: str = "") -> str:
    return _OPT.format(column, digits, missing)


@query(
    f"""
    WITH {_COMPARE_SQL}
    SELECT model, size, {_WHOLE.format("num_parameters", "")} AS params, {_WHOLE.format("embedding_dim", "")} AS embedding_dim,
           {_WHOLE.format("max_seq_length", "")} AS max_seq_length, {_f("cpu_load_time_ms", 1)} AS cpu_load_time_ms,
           {_f("gpu_load_time_ms", 1)} AS gpu_load_time_ms, query_length,
           {", ".join(f"printf('%.4f', {r6(f'cpu_{s}')}) AS cpu_{s}" for s in lt.STATS)},
           {", ".join(f"{_f(r6(f'gpu_{s}'), 4)} AS gpu_{s}" for s in lt.STATS)}, {_f(r6("speedup"), 2)} AS speedup
    FROM cmp
    """
)
def report_csv_rows(t: Tables):
    return lt.format_comparison(comparison(t))


_PARAMS = """CASE WHEN {0} IS NULL THEN '?' WHEN {0} >= 1000000000 THEN printf('%.1f', {0} / 1e9) || 'B'
             ELSE printf('%.0f', {0} / 1e6) || 'M' END"""
_MS = """CASE WHEN {0} IS NULL THEN '?' WHEN {0} >= 1000 THEN printf('%.1f', {0} / 1000) || 's'
         ELSE printf('%.0f', {0}::DOUBLE) || 'ms' END"""


def _cells(rate: str) -> str:
    parts = [f"printf('%.2f', {r6(f'cpu_{s}')})" for s in lt.STATS[:3]] + [_f(r6(f"gpu_{s}"), 2, "N/A") for s in lt.STATS[:3]]
    parts.append(f"CASE WHEN {rate} IS NULL OR {r6(rate)} = 0 THEN 'N/A' ELSE printf('%.1f', {r6(rate)}) || 'x' END")
    return ", ".join(f"({p})" for p in parts)


@query(
    f"""
    WITH {_COMPARE_SQL}
    SELECT {_SIZE_ORD}::INTEGER AS size_ord, {_QUERY_ORD}::INTEGER AS query_ord, model,
           '| ' || concat_ws(' | ', list_last(string_split(model, '/')), size, {_PARAMS.format("num_parameters")},
             {_WHOLE.format("embedding_dim", "?")}, query_length, {_cells("speedup")}) || ' |' AS line
    FROM cmp
    """
)
def report_comparison_lines(t: Tables):
    return lt.comparison_lines(comparison(t))


@query(
    f"""
    WITH {_BY_QUERY}
    SELECT ord, '| ' || concat_ws(' | ', query_length, {_cells("avg_speedup")}) || ' |' AS line FROM summary
    """
)
def report_summary_lines(t: Tables):
    return lt.summary_lines(lt.agg_by_query(comparison(t)), "query_length")


@query(
    f"""
    WITH {_COMPARE_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_SIZE_ORD}, {_QUERY_ORD}) AS r FROM cmp)
    SELECT {_SIZE_ORD}::INTEGER AS size_ord, {_QUERY_ORD}::INTEGER AS query_ord, model,
           '| ' || concat_ws(' | ', list_last(string_split(model, '/')), size, {_PARAMS.format("num_parameters")},
             {_WHOLE.format("embedding_dim", "?")}, {_WHOLE.format("max_seq_length", "?")}, {_MS.format("cpu_load_time_ms")},
             CASE WHEN model_type IS NULL OR model_type = '' THEN '?' ELSE model_type END) || ' |' AS line
    FROM o WHERE r = 1
    """
)
def report_model_lines(t: Tables):
    return lt.model_lines(comparison(t))


@query(
    f"""
    SELECT p_partkey, {_PARAMS.format("n")} AS params, {_MS.format("ms")} AS load_time
    FROM (SELECT p_partkey, (p_partkey * 1234567 + p_size)::BIGINT AS n, p_retailprice * 1.15::DOUBLE AS ms FROM part)
    """
)
def humanize(t: Tables):
    n = F.col("p_partkey") * 1234567 + F.col("p_size")
    return t.part.select(
        "p_partkey",
        fm.humanize_params(n).alias("params"),
        fm.humanize_ms(F.col("p_retailprice") * F.lit(1.15)).alias("load_time"),
    )


@query(
    """
    SELECT p_partkey, p_name AS short, left(p_name, 4) AS short4 FROM part
    """
)
def short_name(t: Tables):
    model = F.concat(F.lit("a/b/"), F.col("p_name"))
    return t.part.select("p_partkey", fm.short_name(model).alias("short"), fm.short_name(model, 4).alias("short4"))
