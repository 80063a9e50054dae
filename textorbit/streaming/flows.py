"""Structured Streaming forms of the operators.

The narrow encoders (embed, embed_sparse, embed_all, predict, predict_pair,
tokenize, decode) take a streaming DataFrame as they are.  What needs memory
between micro-batches keeps it in Spark's keyed state (``streaming.state``), checkpointed
with the stream.  Every batch writes its output below its batch id, so a repeated batch
replaces its first attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textorbit.functions.formats import micros
from textorbit.operators import encode
from textorbit.operators.metrics import LABELS, SKETCH_K, failure_rate, series, sketches
from textorbit.operators.replay import Rules
from textorbit.session import fresh_dir, passing_cuts, remove
from textorbit.streaming import state


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, max_files: int = 1000
) -> DataFrame:
    """Parquet files as a stream, oldest first; ``max_files`` per trigger is the back-pressure."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def run_to_table(stream: DataFrame, out: str | None = None, checkpoint: str | None = None, trigger: dict | None = None) -> str:
    """Append a stream's rows to a Parquet table until the input is used up; its path."""
    spark = stream.sparkSession
    out = out or fresh_dir(spark, "stream-out")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or fresh_dir(spark, "stream-state"))
        .trigger(**(trigger or {"availableNow": True}))
        .start(out)
    )
    query.awaitTermination()
    return out


def _each_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(fn)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_batches(spark: SparkSession, root: str, schema: T.StructType | str, name: str = "out") -> DataFrame:
    """Rows all batches of a flow wrote, with their batch id."""
    try:
        found = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch=*")
    except Exception as exc:  # no batch has written yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        parsed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], parsed.add("batch", T.IntegerType()))
    return found


# --- flows with memory ---------------------------------------------------------------

HEALTH_STATE = "instance long, status string, failures long, last_ok_seq long"


def _write_batches(rows: DataFrame, root: str, trigger: dict | None) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    return _each_batch(rows, each, f"{root}/checkpoint", trigger)


def _field(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def _stepped(rows: DataFrame, key: str, step: state.Step, out: str, kept: str, timeout: str = "NoTimeout") -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(step, out, kept, "append", timeout)


def health_monitor(
    checks: DataFrame,
    root: str,
    max_failures: int = 3,
    auto_restart: bool = True,
    initial_status: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Health replay over a stream of (instance, seq, healthy, restart_ok), a row for each check.

    An instance's state after its last check is kept: status, failures, last success and number.
    A check that comes after one with the same or a higher number is ``late``: it is given out
    with the state that holds, and changes nothing.  Within a batch an instance's checks are
    sorted by number; the trigger bounds how many they are.
    """
    start = initial_status if initial_status is not None else F.lit("stopped")
    rows = checks.select("instance", "seq", "healthy", "restart_ok", start.alias("start_status"))
    replay = state.health("instance", Rules(max_failures, auto_restart))
    schema = f"{_field(checks, 'instance')}, {state.HEALTH_OUT}"
    return _write_batches(_stepped(rows, "instance", replay, schema, state.HEALTH), root, trigger)


def _clock(*seconds: int | None) -> str:
    """Whether timeouts by the clock are wanted.  Spark then goes on making batches until it is stopped."""
    return "ProcessingTimeTimeout" if any(seconds) else "NoTimeout"


def _millis(seconds: int | None) -> int | None:
    return None if seconds is None else seconds * 1000


def lifecycle_apply(
    events: DataFrame, root: str, trigger: dict | None = None, remember_secs: int | None = None
) -> StreamingQuery:
    """Keep the current membership from added / removed / stopped events (name, seq, kind).

    The checkpointed source replays what a crash interrupted, so no event is lost.
    A name that left is remembered, so an older ``added`` that comes late does not bring it
    back; with ``remember_secs`` it is forgotten after that, and the query runs until it is stopped.
    Out: each leave of a member, (name, seq); ``read_members`` has the members.
    """
    rows = events.filter(F.col("kind").isin("added", "removed", "stopped")).select("name", "seq", "kind")
    keep = state.membership(_millis(remember_secs))
    applied = _stepped(rows, "name", keep, "name string, seq long", state.MEMBERSHIP, _clock(remember_secs))
    return _write_batches(applied, root, trigger)


def read_members(spark: SparkSession, root: str) -> DataFrame:
    """(name, seq) of the members that ``lifecycle_apply`` knows after its last batch."""
    known = spark.read.format("statestore").load(f"{root}/checkpoint")
    known = known.select("key.*", "value.groupState.*")
    return known.filter("member").select("name", "seq")


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def bind_targets(
    messages: DataFrame, root: str, trigger: dict | None = None, remember_secs: int | None = None
) -> StreamingQuery:
    """Give every message of a stream the target of the stream's first message.

    Messages are (stream_id, seq, target string, ...).  The first batch that has a message of a
    stream settles its target, by the lowest seq; ``remember_secs`` after that it is forgotten
    (the query then runs until it is stopped), without it never.
    """
    # As JSON a message passes through Python as it is; pandas would make floats of nullable numbers.
    rows = messages.select("stream_id", "seq", "target", F.to_json(F.struct("*"), _EXACT).alias("message"))
    schema = f"{_field(messages, 'stream_id')}, message string, bound_target string"
    memory = state.first_target(_millis(remember_secs))
    bound = _stepped(rows, "stream_id", memory, schema, state.TARGET, _clock(remember_secs))
    message = F.from_json("message", messages.schema, _EXACT).alias("message")
    return _write_batches(bound.select(message, "bound_target").select("message.*", "bound_target"), root, trigger)


def start_timeouts(
    events: DataFrame,
    root: str,
    default_secs: int = 300,
    watermark: str | None = "10 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Instances that were still starting after their timeout, from a stream of (instance, ts, kind).

    Kinds ``start`` and ``restart`` begin to wait, ``check_ok``, ``stop``, ``stopped`` and
    ``restart_failed`` end it; others don't matter.  ``startup_timeout_secs``, if there, is an
    instance's own limit.  Out: (instance, started_at, failed_at).

    A timer fires when the watermark has passed the limit; without a ``watermark``, when the
    clock has, counted from the batch that has the start, and the query runs until it is stopped.  What comes more than the limit
    after the start never undoes the timeout.
    """
    limit = F.lit(default_secs)
    if "startup_timeout_secs" in events.columns:
        limit = F.coalesce("startup_timeout_secs", limit)
    starts = F.col("kind").isin("start", "restart")
    ends = F.col("kind").isin("check_ok", "stop", "stopped", "restart_failed")
    rows = events.filter(starts | ends)
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    rows = rows.select(
        "instance", "ts", micros("ts").alias("at"), (limit.cast("long") * 1_000_000).alias("limit"),
        starts.alias("starts"), ends.alias("ends"),
    )
    late = _stepped(
        rows,
        "instance",
        state.start_timeout("instance", watermark is not None),
        f"{_field(events, 'instance')}, started long, failed long",
        state.STARTING,
        "EventTimeTimeout" if watermark else "ProcessingTimeTimeout",
    )
    late = late.select(
        "instance", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("failed").alias("failed_at")
    )
    return _write_batches(late, root, trigger)


RANKS = "query_id long, rank long, index long, score double, text string"
LATE_TEXTS = "query_id long, seq long, text string"


def _ranks(texts: DataFrame) -> DataFrame:
    """Ranks of the texts of each query, by the options of its first one."""
    if texts.isEmpty():
        return texts.sparkSession.createDataFrame([], RANKS)
    options = texts.groupBy("query_id").agg(F.min_by(F.struct("raw_scores", "return_text"), "seq").alias("_o"))
    placed = encode.ranked(texts.select("query_id", "seq", "text", "score"), ["query_id"], [F.col("seq")], "index")
    placed = placed.withColumn("_down", -F.col("score"))
    ranked = encode.ranked(placed, ["query_id"], [F.col("_down"), F.col("index")], "rank")
    return ranked.join(options, "query_id").select(
        "query_id",
        (F.col("rank") + 1).alias("rank"),
        "index",
        F.when(F.col("_o.raw_scores"), F.col("score")).otherwise((F.col("score") + 1) / 2).alias("score"),
        F.when(F.col("_o.return_text"), F.col("text")).alias("text"),
    )


def rerank_stream(
    rows: DataFrame,
    root: str,
    raw_scores_column: str = "raw_scores",
    trigger: dict | None = None,
    delay_secs: int = 0,
    idle_secs: int | None = None,
    remember_secs: int | None = None,
) -> StreamingQuery:
    """One ranking per query, once its stream of texts has ended.

    In: (query_id, seq, query, text, raw_scores, return_text, is_last).  The
    options of the first message (lowest seq) hold for the whole query.  Scores
    that are not raw are moved from [-1, 1] to [0, 1].

    A query ends ``delay_secs`` after the message that is its last, or with its batch if that is
    0, and after ``idle_secs`` without a message, if given; texts that come until then are ranked.
    Those that come later are written to ``errors``; with ``remember_secs`` an id may be used again
    after that.  With any of the three, the query runs until it is stopped.  Texts wait in Spark's
    state, those of one query in one value; the ranking of what has ended in a batch is spread
    over the tasks.
    """
    score = F.floor(encode.pair_score(F.col("query"), F.col("text")) * 1e6 + 0.5) / F.lit(1e6)
    scored = rows.select(
        "query_id", "seq", "text", score.alias("score"), F.col(raw_scores_column).alias("raw_scores"), "return_text", "is_last"
    )
    schema = (
        f"{_field(rows, 'query_id')}, seq long, text string, score double, raw_scores boolean, return_text boolean,"
        " late boolean"
    )
    wait = state.open_texts(delay_secs * 1000, _millis(idle_secs), _millis(remember_secs))
    given = _stepped(scored, "query_id", wait, schema, state.TEXTS, _clock(delay_secs, idle_secs, remember_secs))

    def each(batch: DataFrame, batch_id: int) -> None:
        found = f"{root}/ended/batch={batch_id}"
        batch.write.mode("overwrite").parquet(found)
        ended = batch.sparkSession.read.schema(schema).parquet(found)
        late = ended.filter("late").select("query_id", "seq", "text")
        late.write.mode("overwrite").parquet(f"{root}/errors/batch={batch_id}")
        with passing_cuts(batch.sparkSession):
            _ranks(ended.filter("not late")).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        remove(batch.sparkSession, found)

    return _each_batch(given, each, f"{root}/checkpoint", trigger)


# --- Spark's own streaming aggregations --------------------------------------------------


def metric_stream(events: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Counters that accumulate for ever: changed series per batch, in update mode."""
    totals = series(events).groupBy("metric", *LABELS).agg(F.sum("value").alias("total"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    return _each_batch(totals, each, f"{root}/checkpoint", trigger, "update")


def latest_totals(spark: SparkSession, root: str) -> DataFrame:
    """Current counter per series from the batches of ``metric_stream``."""
    rows = read_batches(spark, root, "metric string, l1 string, l2 string, total double")
    return rows.groupBy("metric", *LABELS).agg(F.max_by("total", "batch").alias("total"))


def failure_rate_stream(events: DataFrame, watermark: str = "10 minutes", **window) -> DataFrame:
    """Sliding failure rates; rows later than the watermark are dropped by Spark's rule."""
    return failure_rate(events.withWatermark("ts", watermark), **window)


def sketch_stream(
    events: DataFrame, keys: list[str], width: str, watermark: str = "10 minutes", value: str = "value", ts: str = "ts", k: int = SKETCH_K
) -> DataFrame:
    """Quantile sketches per key and window, given out when the watermark closes the window.

    The state holds one sketch per key and open window.  Written to a table, windows can be merged
    to longer ones by ``metrics.merge_sketches``, also those of several runs.
    """
    rows = sketches(events.withWatermark(ts, watermark), [*keys, F.window(ts, width).alias("w")], value, k)
    return rows.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def idle_sessions(
    events: DataFrame, key: str = "instance", gap_secs: int = 600, watermark: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Sessions of use per key, ended by a gap, on tables and streams.

    A session closes after a gap strictly longer than ``gap_secs``, as an entry
    idle for strictly longer than that is pruned.

    On tables, uses within one gap-wide slot belong to one session whatever
    lies around them, so each slot is folded first (map-side) to its first and
    last use.  Merging then sees at most one row per key and slot, however
    busy the key; the slot's own length rides along in the session's gap.  On
    streams Spark folds sessions before the shuffle if the caller's session sets
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``.
    """
    if events.isStreaming:
        window = F.session_window(ts, f"{gap_secs} seconds")
        sessions = events.withWatermark(ts, watermark).groupBy(key, window.alias("s")).agg(F.count("*").alias("uses"))
    else:
        slot = F.floor(micros(ts) / (gap_secs * 1_000_000))
        slots = events.groupBy(key, slot.alias("_slot")).agg(
            F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_uses")
        )
        span = F.make_interval(secs=((micros("_last") - micros("_first")) / 1_000_000 + gap_secs).cast("decimal(18,6)"))
        sessions = slots.groupBy(key, F.session_window("_first", span).alias("s")).agg(F.sum("_uses").alias("uses"))
    return sessions.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "uses")


def split_errors(messages: DataFrame, root: str, valid: Column, trigger: dict | None = None) -> StreamingQuery:
    """Valid rows to ``out``, malformed rows to ``errors``; one bad row ends nothing."""
    good = F.coalesce(valid, F.lit(False))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.filter(good).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        batch.filter(~good).write.mode("overwrite").parquet(f"{root}/errors/batch={batch_id}")

    return _each_batch(messages, each, f"{root}/checkpoint", trigger)
