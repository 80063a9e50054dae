"""Queries on fleet state, metrics and logs derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textorbit.functions import text as tx
from textorbit.functions.formats import round6
from textorbit.operators import batch, fleet, logs, metrics, requests
from textorbit.plans.registry import ORACLE, Tables, query
from textorbit.plans.text import ROUTED, r6, routed_requests

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def instances(t: Tables):
    """One instance per user; its last event is when it was started."""
    return t.events.groupBy("user_id").agg(F.max("ts").alias("started_at"), F.count("*").alias("n")).select(
        F.concat(F.lit("inst-"), F.col("user_id").cast("string")).alias("name"),
        "user_id",
        (F.lit(8080) + F.col("user_id") % 100).cast("int").alias("port"),
        F.when(F.col("user_id") % 4 != 0, F.col("started_at")).alias("started_at"),
        F.when(F.col("user_id") % 3 == 0, "starting").otherwise("running").alias("status"),
    )


_INSTANCES = """
    instances AS (
      SELECT 'inst-' || user_id AS name, user_id, (8080 + user_id % 100)::INTEGER AS port,
             CASE WHEN user_id % 4 <> 0 THEN max(ts) END AS started_at,
             CASE WHEN user_id % 3 = 0 THEN 'starting' ELSE 'running' END AS status
      FROM events GROUP BY user_id)
"""


@query(
    f"""
    WITH {_INSTANCES}
    SELECT *, CASE WHEN started_at IS NOT NULL THEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) // 1000000 END AS uptime_secs
    FROM instances
    """
)
def instance_info(t: Tables):
    return fleet.instance_info(instances(t), now())


@query(
    f"""
    WITH {ROUTED}, {_INSTANCES},
    r AS (SELECT event_id, error_code, CASE WHEN error_code IS NULL THEN wanted END AS instance FROM routed)
    SELECT event_id, instance, CASE WHEN error_code IS NULL THEN port END AS port,
           coalesce(error_code, CASE WHEN name IS NULL THEN 'NOT_FOUND' WHEN user_id % 11 = 0 THEN 'UNAVAILABLE' END) AS error_code
    FROM (SELECT r.*, i.name, i.user_id, CASE WHEN i.user_id % 11 <> 0 THEN i.port END AS port FROM r LEFT JOIN instances i ON i.name = r.instance)
    """
)
def route(t: Tables):
    reachable = instances(t).withColumn("reachable", F.col("user_id") % 11 != 0)
    resolved = requests.resolve_target(routed_requests(t)).drop("target", "user_id", "ts")
    return requests.route(resolved, reachable)


@query(
    """
    WITH f AS (SELECT conv_id, arg_min(role || length(text), turn) AS bound FROM conversations GROUP BY 1)
    SELECT conv_id, turn, bound AS bound_target FROM conversations JOIN f USING (conv_id)
    """
)
def stream_target(t: Tables):
    rows = t.conversations.select(
        "conv_id", "turn", F.concat("role", F.length("text").cast("string")).alias("target")
    )
    return requests.stream_target(rows, "conv_id", "turn").drop("target")


# --- health ----------------------------------------------------------------------


def checks(t: Tables, seq: str = "event_id"):
    return t.events.select(
        F.col("user_id").alias("instance"),
        F.col(seq).alias("seq"),
        F.col("event_type").isin("click", "view").alias("healthy"),
        F.when(F.col("event_id") < 400, "starting").otherwise("running").alias("status"),
    )


_CHECKS = """
    checks AS (
      SELECT user_id AS instance, event_id AS seq, event_type IN ('click', 'view') AS healthy,
             CASE WHEN event_id < 400 THEN 'starting' ELSE 'running' END AS status FROM events)
"""


@query(
    f"""
    WITH {_CHECKS},
    c AS (SELECT *, sum(healthy::INT) OVER (PARTITION BY instance ORDER BY seq) AS island FROM checks WHERE healthy OR status <> 'starting')
    SELECT instance, seq, healthy, status,
           (sum((NOT healthy)::INT) OVER (PARTITION BY instance, island ORDER BY seq))::BIGINT AS failures
    FROM c
    """
)
def failure_streaks(t: Tables):
    return fleet.failure_streaks(checks(t), step=4096)


@query(
    """
    WITH h AS (SELECT user_id AS instance, event_id AS seq, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
    SELECT instance, seq, p AS from_status, s AS to_status FROM h WHERE p <> s
    """
)
def status_transitions(t: Tables):
    history = t.events.select(
        F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")
    )
    return fleet.status_transitions(history, step=4096)


@query(ORACLE["failure_streaks"].replace("event_id AS seq", "ts AS seq"))
def failure_streaks_by_time(t: Tables):
    """Ordered by time stamps in microseconds; chunks are as wide as each instance needs."""
    return fleet.failure_streaks(checks(t, "ts"))


@query(ORACLE["status_transitions"].replace("event_id", "ts"))
def status_transitions_by_time(t: Tables):
    history = t.events.select(
        F.col("user_id").alias("instance"), F.col("ts").alias("seq"), F.col("event_type").alias("status")
    )
    return fleet.status_transitions(history)


START = ["stopped", "starting", "running", "failed"]


def replayed(t: Tables, step: int | None = 4096):
    start = F.array(*[F.lit(s) for s in START])
    rows = checks(t).drop("status").withColumns(
        {
            "restart_ok": F.col("seq") % 3 != 0,
            "start_status": F.get(start, (F.col("instance") % 4).cast("int")),
            "start_failures": F.col("instance") % 3,
        }
    )
    return fleet.health_reduce(rows, max_failures=3, step=step)


_REPLAY = f"""
    WITH RECURSIVE {_CHECKS},
    c AS (
      SELECT instance, seq, healthy, seq % 3 <> 0 AS restart_ok, row_number() OVER (PARTITION BY instance ORDER BY seq) AS rn FROM checks),
    st AS (
      SELECT DISTINCT instance, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BOOLEAN AS healthy,
             false AS check_failed, false AS restarted, false AS restart_failed, (instance % 3)::BIGINT AS failures,
             list_extract(['stopped', 'starting', 'running', 'failed'], (instance % 4 + 1)::INT) AS status, NULL::BIGINT AS last_ok_seq
      FROM checks
      UNION ALL
      SELECT c.instance, c.rn, c.seq, c.healthy,
             NOT c.healthy AND st.status <> 'starting',
             NOT c.healthy AND st.status <> 'starting' AND st.failures + 1 >= 3 AND c.restart_ok,
             NOT c.healthy AND st.status <> 'starting' AND st.failures + 1 >= 3 AND NOT c.restart_ok,
             CASE WHEN c.healthy THEN 0 WHEN st.status = 'starting' THEN st.failures ELSE st.failures + 1 END,
             CASE WHEN c.healthy THEN CASE WHEN st.status = 'starting' THEN 'running' ELSE st.status END
                  WHEN st.status = 'starting' OR st.failures + 1 < 3 THEN st.status
                  WHEN c.restart_ok THEN 'starting' ELSE 'failed' END,
             CASE WHEN c.healthy THEN c.seq ELSE st.last_ok_seq END
      FROM st JOIN c ON c.instance = st.instance AND c.rn = st.rn + 1)
"""


@query(f"{_REPLAY} SELECT * EXCLUDE (rn) FROM st WHERE rn > 0")
def health_reduce(t: Tables):
    """Chunks as the rows need them; the queries below put many small chunks together."""
    return replayed(t, None)


@query(
    f"""
    {_REPLAY},
    e AS (
      SELECT instance, seq, failures, unnest([
        {{'o': 0, 't': 'check_started', 'y': true}}, {{'o': 1, 't': 'check_succeeded', 'y': healthy}},
        {{'o': 2, 't': 'check_failed', 'y': check_failed}}, {{'o': 3, 't': 'restart_triggered', 'y': restarted OR restart_failed}},
        {{'o': 4, 't': 'restart_succeeded', 'y': restarted}}, {{'o': 5, 't': 'restart_failed', 'y': restart_failed}}]) AS e
      FROM st WHERE rn > 0)
    SELECT instance, seq, e.o::INTEGER AS ordinal, e.t AS event_type,
           CASE WHEN e.o IN (2, 3) THEN failures END AS failures
    FROM e WHERE e.y
    """
)
def health_events(t: Tables):
    return fleet.health_events(replayed(t))


@query(
    f"""
    {_REPLAY}
    SELECT instance, arg_max(status, seq) AS status, arg_max(failures, seq) AS failures, max(last_ok_seq) AS last_ok_seq,
           sum(restarted::INT)::BIGINT AS restarts, sum(restart_failed::INT)::BIGINT AS failed_restarts
    FROM st WHERE rn > 0 GROUP BY 1
    """
)
def final_health(t: Tables):
    return fleet.final_health(replayed(t))


KINDS = ["check_ok", "start", "check_ok", "stop", "stopped", "check_failed", "restart", "restart_failed", "start_timeout"]


@query(
    f"""
    WITH e AS (SELECT user_id AS instance, event_id AS seq, list_extract({KINDS}, ((value * 100)::BIGINT % 9 + 1)::INT) AS kind FROM events),
    s AS (SELECT instance, arg_max(kind, seq) AS k, max(seq) AS set_at FROM e WHERE kind NOT IN ('check_ok', 'check_failed') GROUP BY 1),
    o AS (SELECT instance, max(seq) AS ok FROM e WHERE kind = 'check_ok' GROUP BY 1),
    n AS (SELECT instance, count(*) FILTER (kind = 'restart') AS restarts, max(seq) FILTER (kind IN ('start', 'restart')) AS started_seq FROM e GROUP BY 1)
    SELECT n.instance, restarts, started_seq,
           CASE WHEN k IN ('start', 'restart') THEN CASE WHEN ok > set_at THEN 'running' ELSE 'starting' END
                WHEN k = 'stop' THEN 'stopping' WHEN k = 'stopped' OR k IS NULL THEN 'stopped' ELSE 'failed' END AS status
    FROM n LEFT JOIN s USING (instance) LEFT JOIN o USING (instance)
    """
)
def instance_status(t: Tables):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    events = t.events.select(
        F.col("user_id").alias("instance"),
        F.col("event_id").alias("seq"),
        F.get(kinds, (F.round(F.col("value") * 100).cast("long") % 9).cast("int")).alias("kind"),
    )
    return fleet.instance_status(events)


@query(
    f"""
    WITH {_INSTANCES}
    SELECT name, user_id, port, started_at,
           coalesce(status = 'starting' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at) > 200000000000, false) AS timed_out,
           CASE WHEN status = 'starting' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at) > 200000000000 THEN 'failed' ELSE status END AS status
    FROM instances
    """
)
def start_timeout(t: Tables):
    return fleet.start_timeout(instances(t), now(), 200_000)


@query(
    """
    SELECT name, since_seq FROM (
      SELECT user_id || '/' || (event_id % 3) AS name, arg_max(event_type, event_id) AS k, max(event_id) AS since_seq
      FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1)
    WHERE k = 'signup'
    """
)
def fleet_state(t: Tables):
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("started")
    events = t.events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("name"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
    )
    return fleet.fleet_state(events)


def connections(t: Tables):
    return t.events.groupBy((F.col("user_id") * 2).alias("u")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_used")
    ).select(F.concat(F.lit("inst-"), F.col("u").cast("string")).alias("instance"), "created_at", "last_used")


_CONNS = """
    conns AS (
      SELECT 'inst-' || (user_id * 2) AS instance, min(ts) AS created_at, max(ts) AS last_used FROM events GROUP BY user_id)
"""


@query(
    f"""
    WITH {_CONNS}
    SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_used)) // 1000000 AS idle_secs
    FROM conns WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_used) > 120000000000
    """
)
def idle_connections(t: Tables):
    return fleet.idle(connections(t), now(), 120_000)


@query(
    f"""
    WITH {_CONNS}, {_INSTANCES}
    SELECT * FROM conns WHERE instance NOT IN (SELECT name FROM instances)
    """
)
def orphans(t: Tables):
    return fleet.orphans(connections(t), instances(t))


# --- validation and admission --------------------------------------------------------


def configured(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("ord"),
        F.when(k % 50 == 0, "").when(k % 51 == 0, "a/b").when(k % 53 == 0, "a\\b").otherwise(
            F.concat(F.lit("inst-"), (k % 1500).cast("string"))
        ).alias("name"),
        (1000 + k * 3 % 4000).cast("int").alias("port"),
    )


_CONFIGURED = """
    cfg AS (
      SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 51 = 0 THEN 'a/b'
             WHEN p_partkey % 53 = 0 THEN 'a\\b' ELSE 'inst-' || (p_partkey % 1500) END AS name,
             (1000 + p_partkey * 3 % 4000)::INTEGER AS port FROM part)
"""


@query(
    f"""
    WITH {_CONFIGURED},
    n AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY ord) AS np, row_number() OVER (PARTITION BY name ORDER BY ord) AS nn FROM cfg),
    v AS (
      SELECT ord, name, port, unnest([
        {{'o': 0, 't': 'port_too_low', 'y': port < 1024}}, {{'o': 1, 't': 'api_conflict', 'y': port = 3001}},
        {{'o': 2, 't': 'rpc_conflict', 'y': port = 4000}}, {{'o': 3, 't': 'duplicate_port', 'y': np > 1}},
        {{'o': 4, 't': 'empty_name', 'y': name = ''}}, {{'o': 5, 't': 'path_separator', 'y': name IN ('a/b', 'a\\b')}},
        {{'o': 6, 't': 'duplicate_name', 'y': nn > 1}}]) AS v
      FROM n)
    SELECT ord, name, port, v.o::INTEGER AS ordinal, v.t AS violation FROM v WHERE v.y
    """
)
def validate_instances(t: Tables):
    return fleet.validate_instances(configured(t), "ord", 3001, 4000)


@query(
    f"""
    WITH {_CONFIGURED}
    SELECT *, row_number() OVER (PARTITION BY port ORDER BY ord) > 1 AS duplicate FROM cfg
    """
)
def duplicate_ports(t: Tables):
    return fleet.duplicate_keys(configured(t), "port", "ord")


@query(
    """
    SELECT p_partkey, CASE WHEN p_size * 100 < 1024 THEN 'api_port_too_low'
           WHEN p_partkey % 3000 < 1024 THEN 'range_too_low'
           WHEN p_size % 10 * 10 - 10 <= 0 THEN 'range_empty'
           WHEN p_size % 10 * 10 - 10 < p_size THEN 'range_too_small' END AS violation
    FROM part
    """
)
def validate_limits(t: Tables):
    rows = t.part.select(
        "p_partkey",
        (F.col("p_size") * 100).alias("api_port"),
        (F.col("p_partkey") % 3000).alias("port_start"),
        (F.col("p_partkey") % 3000 + F.col("p_size") % 10 * 10 - 10).alias("port_end"),
        F.col("p_size").alias("max_instances"),
    )
    return fleet.validate_limits(rows).select("p_partkey", "violation")


@query(
    """
    WITH RECURSIVE req AS (
      SELECT user_id % 5 AS fleet, event_id AS seq, 'n' || ((value * 100)::BIGINT % 60) AS name, (8000 + event_id * 7 % 45)::INTEGER AS port,
             row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS rn FROM events),
    st AS (
      SELECT DISTINCT fleet, NULL::BIGINT AS seq, NULL::VARCHAR AS name, NULL::INTEGER AS port, 0::BIGINT AS rn,
             []::VARCHAR[] AS names, []::INTEGER[] AS ports, NULL::VARCHAR AS verdict FROM req
      UNION ALL
      SELECT r.fleet, r.seq, r.name, r.port, r.rn,
             CASE WHEN list_contains(names, r.name) OR list_contains(ports, r.port) OR len(names) >= 14 THEN names ELSE list_append(names, r.name) END,
             CASE WHEN list_contains(names, r.name) OR list_contains(ports, r.port) OR len(names) >= 14 THEN ports ELSE list_append(ports, r.port) END,
             CASE WHEN list_contains(names, r.name) THEN 'duplicate_name' WHEN list_contains(ports, r.port) THEN 'port_conflict'
                  WHEN len(names) >= 14 THEN 'capacity' ELSE 'accepted' END
      FROM st JOIN req r ON r.fleet = st.fleet AND r.rn = st.rn + 1)
    SELECT fleet, seq, name, port, verdict FROM st WHERE rn > 0
    """
)
def admit(t: Tables):
    rows = t.events.select(
        (F.col("user_id") % 5).alias("fleet"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("n"), (F.round(F.col("value") * 100).cast("long") % 60).cast("string")).alias("name"),
        (8000 + F.col("event_id") * 7 % 45).cast("int").alias("port"),
    )
    return fleet.admit(rows, 14)


# --- metrics -----------------------------------------------------------------------------


def metric_events(t: Tables):
    s = lambda c: c.cast("string")
    labels = F.when(F.col("event_id") % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(
            F.lit("instance"), s(F.col("user_id") % 20), F.lit("kind"), s(F.col("event_id") % 3),
            F.lit("extra"), s(F.col("event_id")),
        )
    )
    return t.events.select(
        "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("metric"), labels.alias("labels"), "value"
    )


_SERIES = """
    series AS (
      SELECT event_type AS metric, CASE WHEN event_id % 10 <> 0 THEN 'instance=' || (user_id % 20) END AS l1,
             CASE WHEN event_id % 10 <> 0 THEN 'kind=' || (event_id % 3) END AS l2, value AS ms FROM events)
"""


@query(f"WITH {_SERIES} SELECT metric, l1, l2, {r6('sum(ms)')} AS total FROM series GROUP BY 1, 2, 3")
def counters(t: Tables):
    return metrics.counters(metric_events(t)).withColumn("total", round6(F.col("total")))


@query("SELECT event_type AS metric, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def gauges(t: Tables):
    return metrics.gauges(metric_events(t))


def _histogram_sql() -> str:
    from textorbit.plans.latency import stats_sql

    return f"""
    WITH {_SERIES}, s AS (SELECT metric, coalesce(l1, '') AS l1, coalesce(l2, '') AS l2, ms FROM series),
    {stats_sql("s", "metric, l1, l2", rounded=True)},
    m AS (SELECT metric, l1, l2, {r6("sum(ms)")} AS total, min(ms) AS min, max(ms) AS max FROM s GROUP BY 1, 2, 3)
    SELECT metric, l1, l2, total, min, max, n, p50_ms AS p50, p95_ms AS p95, p99_ms AS p99 FROM m JOIN stats USING (metric, l1, l2)
    """


@query(_histogram_sql())
def histograms(t: Tables):
    out = metrics.histograms(metric_events(t))
    return out.withColumns({c: round6(F.col(c)) for c in ("total", "p50", "p95", "p99")})


@query(
    f"""
    SELECT event_type AS metric, count(*) AS n, {r6("sum(value)")} AS total, min(value) AS min, max(value) AS max,
           true AS p50_near, true AS p95_near, true AS p99_near
    FROM events WHERE value IS NOT NULL GROUP BY 1
    """
)
def histogram_sketches(t: Tables):
    """Hourly sketches merged per metric; whether each percentile's rank is within two per cent of the rows."""
    rows = metric_events(t)
    hours = metrics.sketches(rows, ["metric", F.date_trunc("hour", "ts").alias("hour")])
    found = metrics.sketch_percentiles(metrics.merge_sketches(hours, ["metric"]))
    stats = ["metric", "n", "total", "min", "max", "p50", "p95", "p99"]
    met = rows.join(found.select(*stats), "metric").groupBy(*stats)  # a row per metric beside the events
    marks = {p: F.col(f"p{p}") for p in (50, 95, 99)}
    ranks = met.agg(*[F.struct(F.count_if(F.col("value") < x).alias("below"), F.count_if(F.col("value") <= x).alias("upto")).alias(f"_{p}") for p, x in marks.items()])
    near = [((F.col(f"_{p}.below") <= (p / 100 + 0.02) * F.col("n")) & (F.col(f"_{p}.upto") >= (p / 100 - 0.02) * F.col("n"))).alias(f"p{p}_near") for p in marks]
    return ranks.select("metric", "n", round6(F.col("total")).alias("total"), "min", "max", *near)


@query(
    f"""
    WITH w AS (
      SELECT user_id AS instance, date_trunc('minute', ts) - to_minutes(unnest(range(5))::INTEGER) AS window_start
      FROM events WHERE event_type = 'error')
    SELECT instance, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS failures, {r6("count(*) / 300.0::DOUBLE")} AS rate
    FROM w GROUP BY 1, 2
    """
)
def failure_rate(t: Tables):
    failures = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("instance"), "ts")
    return metrics.failure_rate(failures).withColumn("rate", round6(F.col("rate")))


@query("SELECT count(DISTINCT user_id) AS instances, count(DISTINCT user_id) < 200 AS below_expected FROM events")
def fleet_count(t: Tables):
    return metrics.fleet_count(instances(t), 200)


@query(
    f"""
    WITH {_CONNS}
    SELECT count(*) AS active_connections, max((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) // 1000000) AS oldest_connection_age_secs,
           max((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_used)) // 1000000) AS max_idle_secs,
           300::BIGINT AS prune_interval_secs, 600::BIGINT AS max_idle_threshold_secs FROM conns
    """
)
def connection_stats(t: Tables):
    return metrics.connection_stats(connections(t), now())


# --- logs ------------------------------------------------------------------------------------


def document_lines(t: Tables):
    """Documents as logs: one row per line, 0-based."""
    return tx.unroll(
        t.documents, [F.col("doc_id").alias("instance")], F.split("text", "\n"), "line", "line_no"
    )


_LINES = """
    lines AS (
      SELECT doc_id AS instance, unnest(range(len(l))) AS line_no, unnest(l) AS line, len(l)::BIGINT AS total_lines
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
"""


@query(
    f"""
    WITH {_LINES}, b AS (SELECT *, greatest(total_lines - 3, 0) AS start, greatest(total_lines - 1, 0) AS "end" FROM lines)
    SELECT * FROM b WHERE line_no >= start AND line_no < "end"
    """
)
def log_slice(t: Tables):
    return logs.log_slice(document_lines(t), -3, -1)


@query(
    f"""
    WITH {_LINES}
    SELECT DISTINCT instance, total_lines, least(2, total_lines) AS start, total_lines AS "end" FROM lines
    """
)
def log_bounds(t: Tables):
    return logs.log_bounds(document_lines(t), 2)


LOG_TEXTS = [
    "loading", "Started HTTP server", "error: x", "cuda out of memory", "HTTP 404 model not found",
    "Unsupported model x", "CUDA error 2", "Error: out of memory", "404", "retry", "not a valid model",
]


def start_logs(t: Tables):
    texts = F.array(*[F.lit(x) for x in LOG_TEXTS])
    pick = F.when(F.col("event_id") % 5 == 0, F.round(F.col("value") * 100).cast("long") % 11).otherwise(F.lit(0))
    rows = t.events.select(
        F.col("user_id").alias("instance"),
        "event_id",
        F.concat(F.get(texts, pick.cast("int")), F.lit(" "), F.col("event_id").cast("string")).alias("line"),
    )
    return batch.number_rows(rows, ["event_id"], ["instance"], step=1 << 20, name="line_no").drop("event_id")


@query(
    f"""
    WITH l AS (
      SELECT user_id AS instance, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no,
             list_extract({LOG_TEXTS}, (CASE WHEN event_id % 5 = 0 THEN (value * 100)::BIGINT % 11 ELSE 0 END + 1)::INT) || ' ' || event_id AS line
      FROM events),
    v AS (
      SELECT *, CASE WHEN line LIKE '%Started HTTP server%' THEN 'ok'
               WHEN line LIKE '%Error%' OR line LIKE '%error:%' OR line LIKE '%CUDA error%' THEN 'error'
               WHEN line LIKE '%out of memory%' THEN 'out_of_memory'
               WHEN line LIKE '%404%' AND line LIKE '%not found%' THEN 'model_not_found'
               WHEN line LIKE '%not a valid%' OR line LIKE '%Unsupported model%' THEN 'invalid_model' END AS verdict FROM l),
    f AS (SELECT instance, arg_min(verdict, line_no) FILTER (verdict IS NOT NULL) AS verdict, min(line_no) FILTER (verdict IS NOT NULL) AS line_no FROM v GROUP BY 1)
    SELECT f.instance, coalesce(f.verdict, 'unexpected_exit') AS verdict, f.line_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS detail
    FROM f LEFT JOIN l ON l.instance = f.instance AND l.line_no BETWEEN f.line_no AND f.line_no + CASE WHEN f.verdict = 'error' THEN 5 ELSE 0 END
    GROUP BY ALL
    """
)
def log_verdict(t: Tables):
    return logs.log_verdict(start_logs(t))
