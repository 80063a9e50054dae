"""The given tables read as streams, run to the end and compared as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textorbit.functions import text as tx
from textorbit.functions import vectors as vec
from textorbit.functions.formats import round6
from textorbit.operators import encode, metrics
from textorbit.plans import fleet as fleet_queries
from textorbit.plans import text as text_queries
from textorbit.plans.registry import ORACLE, Tables, query
from textorbit.plans.text import exploded, label_weights, r6, weights
from textorbit.session import fresh_dir, is_folder
from textorbit.streaming import flows


def stream(t: Tables, name: str):
    """A given table, one file or a folder of them, as a stream; the schema is the table's own."""
    path, schema = f"{t.dir}/{name}.parquet", getattr(t, name).schema
    if is_folder(t.spark, path):
        return flows.file_stream(t.spark, path, schema)
    return flows.file_stream(t.spark, t.dir, schema, f"{name}.parquet")  # a stream's path is a folder


def documents(t: Tables):
    """Documents as a stream, one small file spread over the cores."""
    return stream(t, "documents").select("doc_id", "text").repartition(t.spark.sparkContext.defaultParallelism)


#: Runs of the flows with memory: each gets a part of a table and goes on from the last one's checkpoint.
RUNS = 5


def in_runs(t: Tables, rows, part: Column, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Add the rows of one ``part`` after the other to a folder, and run the flow over what is new."""
    folder = fresh_dir(t.spark, "input")
    rows = rows.withColumn("_part", part)
    for n in range(RUNS):
        rows.filter(F.col("_part") == n).drop("_part").write.mode("append").parquet(folder)
        run(flows.file_stream(t.spark, folder, rows.drop("_part").schema)).awaitTermination()


def _event_part(t: Tables) -> Column:
    """Events in order of their numbers, but for each 97th, which comes a run late."""
    width = t.events.agg(F.max("event_id")).first()[0] // RUNS + 1
    return F.least(F.lit(RUNS - 1), F.expr(f"event_id div {width}") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0))


_EVENT_PARTS = f"""
    parted AS (
      SELECT *, least({RUNS - 1}, event_id // ((SELECT max(event_id) FROM events) // {RUNS} + 1)
        + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS part FROM events),
    placed AS (
      SELECT *, coalesce(event_id < max(event_id) OVER (PARTITION BY user_id ORDER BY part
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM parted)
"""


def table(t: Tables, rows):
    return t.spark.read.parquet(flows.run_to_table(rows))


@query(ORACLE["embed"])
def stream_embed(t: Tables):
    return exploded(table(t, encode.embed(documents(t))), "doc_id", "embedding")


@query(ORACLE["embed_sparse"])
def stream_embed_sparse(t: Tables):
    rows = table(t, encode.embed_sparse(documents(t)).drop("text"))
    return tx.unroll(rows, ["doc_id"], "sparse", "s").select(
        "doc_id", "s.index", round6(F.col("s.value").cast("double")).alias("value")
    )


@query(ORACLE["embed_all_mean_pool"])
def stream_embed_all(t: Tables):
    """Pooled as they stream: a table of token vectors is read thousands of texts at once, too large for a task."""
    rows = encode.embed_all(documents(t)).drop("text")
    pooled = rows.select(
        "doc_id",
        F.size("token_embeddings").cast("long").alias("n_tokens"),
        vec.mean_pool(F.col("token_embeddings")).alias("v"),
    )
    return tx.unroll(table(t, pooled), ["doc_id", "n_tokens"], "v", "x", "d").withColumn("x", round6(F.col("x")))


@query(ORACLE["predict"])
def stream_predict(t: Tables):
    model = encode.LinearClassifier(label_weights())
    return text_queries._labelled(table(t, encode.predict(documents(t), model).drop("text")))


@query(
    text_queries._softmax_sql(
        f"""
    pairs AS (SELECT doc_id, text AS ta, lang || ' ' || source AS tb FROM documents),
    wa AS ({weights("pairs", "doc_id", "ta")}), wb AS ({weights("pairs", "doc_id", "tb")}),
    na AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM wa GROUP BY 1),
    nb AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM wb GROUP BY 1), {text_queries._LABELS},
    prod AS (
      SELECT doc_id, d, ((wa.w / na.n)::FLOAT * (wb.w / nb.n)::FLOAT)::FLOAT::DOUBLE AS x
      FROM wa JOIN wb USING (doc_id, d) JOIN na USING (doc_id) JOIN nb USING (doc_id)),
    raw AS (
      SELECT pairs.doc_id AS key, k, coalesce(sum(x * ((d * (k + 2)) % 7 - 3) / 10), 0) AS raw
      FROM pairs CROSS JOIN lab LEFT JOIN prod USING (doc_id) GROUP BY ALL)
    """
    )
)
def stream_predict_pair(t: Tables):
    pairs = stream(t, "documents").select("doc_id", F.array("text", F.concat_ws(" ", "lang", "source")).alias("texts"))
    rows = encode.predict_pair(pairs, encode.LinearClassifier(label_weights())).drop("texts")
    return text_queries._labelled(table(t, rows))


@query(ORACLE["tokenize"])
def stream_tokenize(t: Tables):
    rows = table(t, encode.tokenize(documents(t)).drop("text"))
    return tx.unroll(rows, ["doc_id"], "tokens", "t", "position").select(
        "doc_id", "position", "t.id", F.col("t.text").alias("token"), "t.special", "t.start", "t.stop"
    )


@query(ORACLE["decode"])
def stream_decode(t: Tables):
    vocab = encode.vocabulary(t.spread("documents").select("doc_id", "text"))
    ids = encode.tokenize(documents(t), offsets=False).select("doc_id", F.transform("tokens", lambda x: x["id"]).alias("ids"))
    return table(t, encode.decode(ids, vocab, out="decoded").drop("ids"))


def _rerank_texts(t: Tables):
    """Texts of each query with the run that they come in: three turns a run, and of each fifth query
    the last but one text after all others."""
    c = t.conversations
    first = c.filter("turn = 0").select("conv_id", F.col("text").alias("query"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = c.filter("turn > 0").join(first, "conv_id").join(last, "conv_id").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), "query", "text",
        # Only the first message's options count.
        F.when(F.col("turn") == 1, F.col("conv_id") % 2 == 0).otherwise(F.col("conv_id") % 2 != 0).alias("raw_scores"),
        F.when(F.col("turn") == 1, F.col("conv_id") % 3 == 0).otherwise(F.col("conv_id") % 3 != 0).alias("return_text"),
        (F.col("turn") == F.col("_last")).alias("is_last"), "_last",
    )
    behind = (F.col("query_id") % 5 == 0) & (F.col("seq") == F.col("_last") - 1)
    return rows, F.when(behind, RUNS - 1).otherwise(F.least(F.lit(RUNS - 2), F.expr("seq div 3")))


_RERANK_PARTS = f"""
    lasts AS (SELECT conv_id, max(turn) - 1 AS final FROM conversations GROUP BY 1),
    req AS (
      SELECT a.conv_id, a.text AS query, b.turn - 1 AS index, b.text,
             CASE WHEN a.conv_id % 5 = 0 AND b.turn = final THEN {RUNS - 1} ELSE least({RUNS - 2}, b.turn // 3) END AS part,
             least({RUNS - 2}, (final + 1) // 3) AS final_part
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn > 0
      JOIN lasts ON lasts.conv_id = a.conv_id)
"""


@query(
    f"""
    WITH {_RERANK_PARTS},
    k AS (
      SELECT conv_id || '/' || index AS key, conv_id, query, text, index AS turn,
             row_number() OVER (PARTITION BY conv_id ORDER BY index) - 1 AS index
      FROM req WHERE part <= final_part),
    opt AS (
      SELECT conv_id, min(turn) = 0 AS own FROM k GROUP BY 1),
    q AS ({weights("k", "key", "query")}), c AS ({weights("k", "key", "text")}),
    qn AS (SELECT key, sum(w * w) AS n FROM q GROUP BY 1), cn AS (SELECT key, sum(w * w) AS n FROM c GROUP BY 1),
    dots AS (SELECT key, sum(q.w * c.w) AS s FROM q JOIN c USING (key, d) GROUP BY 1),
    scored AS (
      SELECT conv_id, index, text, coalesce({r6("s::DOUBLE / sqrt(qn.n::DOUBLE * cn.n::DOUBLE)")}, 0) AS score
      FROM k LEFT JOIN qn USING (key) LEFT JOIN cn USING (key) LEFT JOIN dots USING (key))
    SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, index) AS rank, index,
           {r6("CASE WHEN (conv_id % 2 = 0) = own THEN score ELSE (score + 1) / 2 END")} AS score,
           CASE WHEN (conv_id % 3 = 0) = own THEN text END AS text
    FROM scored JOIN opt USING (conv_id)
    """
)
def stream_rerank(t: Tables):
    """Ranks of the texts that came before their query had ended."""
    rows, part = _rerank_texts(t)
    root = fresh_dir(t.spark, "rerank")
    in_runs(t, rows, part, lambda stream: flows.rerank_stream(stream.drop("_last"), root))
    out = flows.read_batches(t.spark, root, flows.RANKS).drop("batch")
    return out.withColumn("score", round6(F.col("score")))


@query(f"WITH {_RERANK_PARTS} SELECT conv_id AS query_id, index + 1 AS seq, text FROM req WHERE part > final_part")
def stream_rerank_late(t: Tables):
    """Texts that came after their query had ended."""
    rows, part = _rerank_texts(t)
    root = fresh_dir(t.spark, "rerank")
    in_runs(t, rows, part, lambda stream: flows.rerank_stream(stream.drop("_last"), root))
    return flows.read_batches(t.spark, root, flows.LATE_TEXTS, "errors").drop("batch")


_ON_TIME = (
    ORACLE["health_reduce"]
    .replace("(instance % 3)::BIGINT AS failures", "0::BIGINT AS failures")
    .replace("FROM events", "FROM placed WHERE NOT late")
    .replace("WITH RECURSIVE", f"WITH RECURSIVE {_EVENT_PARTS},")
)


@query(
    f"""
    {_ON_TIME.replace("SELECT * EXCLUDE (rn) FROM st", "SELECT * EXCLUDE (rn), false AS late FROM st")}
    UNION ALL BY NAME
    SELECT user_id AS instance, event_id AS seq, event_type IN ('click', 'view') AS healthy,
           false AS check_failed, false AS restarted, false AS restart_failed, true AS late
    FROM placed WHERE late
    """
)
def stream_health(t: Tables):
    """State after each check that came in order; late checks, which change nothing, without a state."""
    rows = t.events.select(
        "event_id",
        F.col("user_id").alias("instance"),
        F.col("event_id").alias("seq"),
        F.col("event_type").isin("click", "view").alias("healthy"),
        (F.col("event_id") % 3 != 0).alias("restart_ok"),
    )
    start = F.get(F.array(*[F.lit(s) for s in fleet_queries.START]), (F.col("instance") % 4).cast("int"))
    root = fresh_dir(t.spark, "health")
    in_runs(t, rows, _event_part(t), lambda stream: flows.health_monitor(stream, root, initial_status=start))
    out = flows.read_batches(t.spark, root, flows.HEALTH_STATE).drop("batch")
    return out.withColumns({c: F.when(~F.col("late"), F.col(c)) for c in ("failures", "status", "last_ok_seq")})


#: Kinds of events of a fleet's starts, by the events of the given table.
_START_KINDS = {"signup": "start", "error": "restart", "click": "check_ok", "purchase": "stop"}
_START_LIMIT = 3600 * 24


@query(
    f"""
    WITH kinds AS (
      SELECT user_id AS instance, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'start'
        WHEN 'click' THEN 'end' WHEN 'purchase' THEN 'end' END AS kind
      FROM events),
    relevant AS (SELECT * FROM kinds WHERE kind IS NOT NULL),
    nexts AS (SELECT *, lead(ts) OVER (PARTITION BY instance ORDER BY ts, event_id) AS next FROM relevant)
    SELECT instance, ts AS started_at, ts + INTERVAL {_START_LIMIT} SECOND AS failed_at FROM nexts
    WHERE kind = 'start' AND (epoch_us(next) > epoch_us(ts) + {_START_LIMIT}000000 OR (next IS NULL
      AND (epoch_us(ts) + {_START_LIMIT}000000) // 1000 + 1
        <= (SELECT epoch_ms(max(ts)) FROM relevant) - 600000))
    """
)
def stream_start_timeout(t: Tables):
    """Starts that nothing ended within a day, as far as the watermark tells when the input ends."""
    pairs = [F.lit(x) for pair in _START_KINDS.items() for x in pair]
    rows = t.events.select(
        "event_id",
        F.col("user_id").alias("instance"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("kind"),
    )
    width = t.events.agg(F.max("event_id")).first()[0] // RUNS + 1
    root = fresh_dir(t.spark, "starts")
    in_runs(t, rows, F.expr(f"event_id div {width}"), lambda stream: flows.start_timeouts(stream, root, _START_LIMIT))
    out = flows.read_batches(t.spark, root, "instance long, started_at timestamp, failed_at timestamp").drop("batch")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "failed_at")})


@query(ORACLE["counters"])
def stream_counters(t: Tables):
    events = stream(t, "events")
    labels = F.when(F.col("event_id") % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(
            F.lit("instance"), (F.col("user_id") % 20).cast("string"), F.lit("kind"), (F.col("event_id") % 3).cast("string")
        )
    )
    root = fresh_dir(t.spark, "counters")
    flows.metric_stream(
        events.select(F.col("event_type").alias("metric"), labels.alias("labels"), "value"), root
    ).awaitTermination()
    return flows.latest_totals(t.spark, root).withColumn("total", round6(F.col("total")))


_SESSIONS = """
    WITH e AS (SELECT user_id AS instance, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT instance, ts, sum((p IS NULL OR epoch_us(ts) - epoch_us(p) > 36000000000)::INT) OVER (PARTITION BY instance ORDER BY ts) AS n FROM e)
    SELECT instance, min(ts) AS session_start, max(ts) + INTERVAL 36000 SECOND AS session_end, count(*) AS uses FROM s GROUP BY instance, n
"""


@query(_SESSIONS)
def idle_sessions(t: Tables):
    rows = t.events.select(F.col("user_id").alias("instance"), "ts")
    return flows.idle_sessions(rows, gap_secs=36000)


def _closed(sql: str, end: str, newest: str) -> str:
    """Rows whose end is not after the newest time, in whole milliseconds, less ten minutes."""
    return f"SELECT * FROM ({sql}) WHERE epoch_us({end}) <= (SELECT epoch_ms(max(ts)) FROM {newest}) * 1000 - 600000000"


@query(_closed(_SESSIONS, "session_end", "events"))
def stream_idle_sessions(t: Tables):
    """Sessions the watermark has closed when the input ends; the open ones stay in the state."""
    rows = stream(t, "events").select(F.col("user_id").alias("instance"), F.col("ts").cast("timestamp").alias("ts"))
    return table(t, flows.idle_sessions(rows, gap_secs=36000))


@query(_closed(ORACLE["failure_rate"], "window_end", "(SELECT ts FROM events WHERE event_type = 'error')"))
def stream_failure_rate(t: Tables):
    """Windows the watermark has closed when the input ends."""
    failures = stream(t, "events").filter("event_type = 'error'")
    rows = failures.select(F.col("user_id").alias("instance"), F.col("ts").cast("timestamp").alias("ts"))
    return table(t, flows.failure_rate_stream(rows)).withColumn("rate", round6(F.col("rate")))


_DAYS = """
    WITH r AS (
      SELECT event_type AS metric, date_trunc('day', ts)::TIMESTAMP AS window_start, value,
             row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY value) AS i,
             count(*) OVER (PARTITION BY event_type, date_trunc('day', ts)) AS n
      FROM events WHERE value IS NOT NULL)
    SELECT metric, window_start, window_start + INTERVAL 1 DAY AS window_end, max(n) AS n,
           min(CASE WHEN i >= 0.5::DOUBLE * n THEN value END) AS p50,
           min(CASE WHEN i >= 0.95::DOUBLE * n THEN value END) AS p95,
           min(CASE WHEN i >= 0.99::DOUBLE * n THEN value END) AS p99
    FROM r GROUP BY 1, 2
"""


@query(_closed(_DAYS, "window_end", "events"))
def stream_sketches(t: Tables):
    """Percentiles of the days that the watermark has closed; a day has fewer rows than the sketch size, so they are exact."""
    rows = stream(t, "events").select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value")
    days = table(t, flows.sketch_stream(rows, ["metric"], "1 day", k=32768))
    return metrics.sketch_percentiles(days).select("metric", "window_start", "window_end", "n", "p50", "p95", "p99")


@query(ORACLE["fleet_state"].replace("SELECT name, since_seq", "SELECT name, since_seq AS seq"))
def stream_lifecycle(t: Tables):
    """Members after all runs; events that come late change nothing if a later one of the name is known."""
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("started")
    events = t.events.select(
        "event_id",
        F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("name"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
    )
    root = fresh_dir(t.spark, "lifecycle")
    in_runs(t, events, _event_part(t), lambda stream: flows.lifecycle_apply(stream, root))
    return flows.read_members(t.spark, root)


@query(
    f"""
    WITH rows AS (
      SELECT conv_id AS stream_id, turn AS seq, role || length(text) AS target,
             CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN {RUNS - 1} ELSE least({RUNS - 1}, turn // 2) END AS part
      FROM conversations),
    f AS (SELECT stream_id, min(part) AS part FROM rows GROUP BY 1),
    b AS (SELECT stream_id, arg_min(target, seq) AS bound_target FROM rows JOIN f USING (stream_id, part) GROUP BY 1)
    SELECT stream_id, seq, bound_target FROM rows JOIN b USING (stream_id)
    """
)
def stream_bound_target(t: Tables):
    """Targets by the first run that has a message of the stream; of each seventh its first message comes last."""
    rows = t.conversations.select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"),
        F.concat("role", F.length("text").cast("string")).alias("target"),
    )
    behind = (F.col("stream_id") % 7 == 0) & (F.col("seq") == 0)
    part = F.when(behind, RUNS - 1).otherwise(F.least(F.lit(RUNS - 1), F.expr("seq div 2")))
    root = fresh_dir(t.spark, "targets")
    in_runs(t, rows, part, lambda stream: flows.bind_targets(stream, root))
    out = flows.read_batches(t.spark, root, "stream_id long, seq long, bound_target string")
    return out.select("stream_id", "seq", "bound_target")


@query(
    """
    SELECT event_id, event_type <> 'error' AS good FROM events
    """
)
def stream_split_errors(t: Tables):
    rows = stream(t, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("request"))
    root = fresh_dir(t.spark, "split")
    flows.split_errors(rows, root, F.col("request").isNotNull()).awaitTermination()
    schema = "event_id long, request string"
    good = flows.read_batches(t.spark, root, schema).select("event_id", F.lit(True).alias("good"))
    bad = flows.read_batches(t.spark, root, schema, "errors").select("event_id", F.lit(False).alias("good"))
    return good.unionByName(bad)
