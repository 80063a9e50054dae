"""Fleet state: health, streaks, transitions, membership, admission, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.functions.formats import micros
from textorbit.operators.replay import Rules
from textorbit.operators.scan import CHUNK, chunks, running
from textorbit.session import cut

STATUSES = ["starting", "running", "stopping", "stopped", "failed"]


def instance_info(instances: DataFrame, now: Column) -> DataFrame:
    """Public view of an instance; uptime in whole seconds, null if never started."""
    age = micros(now) - micros("started_at")
    return instances.withColumn("uptime_secs", F.floor(age / 1_000_000).cast("long"))


def failure_streaks(
    checks: DataFrame, instance: str = "instance", seq: str = "seq", step: int | None = None
) -> DataFrame:
    """Consecutive failures after every check; rows while starting do not count.

    A failure adds one, a success sets zero.  ``checks`` has (instance, seq,
    healthy, status); successes while starting do reset.  ``seq`` is an integer or a
    time; ``step``, if given, is the number of its values that make one chunk.
    """
    counted = checks.filter(F.col("healthy") | (F.col("status") != "starting"))
    failed = F.when(F.col("healthy"), 0).otherwise(1)
    return running(
        chunks(counted, seq, [instance], step), [instance], [seq], since={"failures": (F.col("healthy"), failed)}
    ).drop(CHUNK)


def status_transitions(
    history: DataFrame, instance: str = "instance", seq: str = "seq", step: int | None = None
) -> DataFrame:
    """Rows where the status differs from the previous one: (instance, seq, from, to).

    Inside a chunk this is ``lag``; a chunk's first row looks at the last
    status of the chunks before it.
    """
    chunked = chunks(history.select(instance, seq, "status"), seq, [instance], step)
    here = Window.partitionBy(instance, CHUNK).orderBy(seq)
    tails = chunked.groupBy(instance, CHUNK).agg(F.max_by("status", seq).alias("_tail"))
    before = Window.partitionBy(instance).orderBy(CHUNK)
    carried = tails.withColumn("_carry", F.lag("_tail").over(before)).drop("_tail")
    rows = chunked.withColumn("_lag", F.lag("status").over(here)).join(carried, [instance, CHUNK], "left")
    previous = F.coalesce("_lag", "_carry")
    return rows.filter(previous != F.col("status")).select(
        instance, seq, previous.alias("from_status"), F.col("status").alias("to_status")
    )


def health_reduce(
    checks: DataFrame,
    max_failures: int = 3,
    auto_restart: bool = True,
    instance: str = "instance",
    seq: str = "seq",
    step: int | None = None,
) -> DataFrame:
    """Replay health checks through the restart rules, state after every check.

    In: (instance, seq, healthy, restart_ok, start_status, start_failures); the
    last two are the same on all rows of an instance.  ``restart_ok`` says how a
    restart triggered by this row ends.  Out, per check: ``status``,
    ``failures``, and the booleans ``check_failed``, ``restarted``,
    ``restart_failed``, ``became_running``.

    Rules: a success zeroes the counter and turns starting into running.  A
    failure while starting is ignored; otherwise it counts, and from
    ``max_failures`` on it triggers a restart, which leads to starting or to
    failed and keeps the counter.

    A chunk of an instance's checks acts on the state before it like a small table: what
    becomes of ``starting``, and of any other status for each number of failures that are
    missing to a restart.  Such tables can be put together, so an instance of many chunks
    is summed up chunk by chunk first, and then all chunks are replayed at once, each from
    its own first state.  An instance of one chunk is replayed in one pass.
    """
    if max_failures < 1:
        raise ValueError("max_failures must be 1 or more")
    rules = Rules(max_failures, auto_restart)
    rows = chunks(
        checks.select(instance, seq, "healthy", "restart_ok", "start_status", F.col("start_failures").cast("long")),
        seq, [instance], step,
    )
    rows = rows.select(instance, CHUNK, seq, "healthy", "restart_ok", "start_status", "start_failures")
    kind = {c: checks.schema[c].dataType.simpleString() for c in (instance, seq)}
    here = f"`{instance}` {kind[instance]}, {CHUNK} long"

    def sorted_by_chunk(df: DataFrame) -> DataFrame:
        return df.repartition(instance, CHUNK).sortWithinPartitions(instance, CHUNK, seq)

    spans = rows.groupBy(instance).agg(F.min(CHUNK).alias("_first"), F.max(CHUNK).alias("_last")).filter("_first < _last")
    several = cut(spans.select(instance))
    begin = None
    if not several.isEmpty():
        split = sorted_by_chunk(rows.join(several, instance, "left_semi"))
        summed = split.mapInArrow(
            rules.summarise, f"{here}, start_status string, start_failures long, ends string, last_ok {kind[seq]}"
        )
        begin = summed.groupBy(instance).applyInPandas(
            rules.compose(instance, CHUNK), f"{here}, _status string, _failures long, _ok {kind[seq]}"
        )
    if begin is None:
        none = F.lit(None)
        started = rows.withColumns({"_status": none.cast("string"), "_failures": none.cast("long"), "_ok": none.cast(kind[seq])})
    else:
        started = rows.join(cut(begin), [instance, CHUNK], "left")
    started = started.select(
        instance, CHUNK, seq, "healthy", "restart_ok",
        F.coalesce("_status", "start_status").alias("start_status"),
        F.coalesce("_failures", "start_failures").alias("start_failures"), "_ok",
    )
    return sorted_by_chunk(started).mapInArrow(
        rules.replay,
        f"`{instance}` {kind[instance]}, `{seq}` {kind[seq]}, healthy boolean, check_failed boolean, restarted boolean,"
        f" restart_failed boolean, failures long, status string, last_ok_seq {kind[seq]}",
    )


def health_events(reduced: DataFrame, instance: str = "instance", seq: str = "seq") -> DataFrame:
    """Events of a replay, in order of (instance, seq, ordinal)."""
    event = lambda n, name, on: F.when(on, F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("event_type")))
    listed = F.array_compact(
        F.array(
            event(0, "check_started", F.lit(True)),
            event(1, "check_succeeded", F.col("healthy")),
            event(2, "check_failed", F.col("check_failed")),
            event(3, "restart_triggered", F.col("restarted") | F.col("restart_failed")),
            event(4, "restart_succeeded", F.col("restarted")),
            event(5, "restart_failed", F.col("restart_failed")),
        )
    )
    return reduced.select(instance, seq, "failures", F.explode(listed).alias("e")).select(
        instance, seq, "e.ordinal", "e.event_type",
        F.when(F.col("e.event_type").isin("check_failed", "restart_triggered"), F.col("failures")).alias("failures"),
    )


def final_health(reduced: DataFrame, instance: str = "instance", seq: str = "seq") -> DataFrame:
    """State of each instance after its last check."""
    return reduced.groupBy(instance).agg(
        F.max_by(F.struct("status", "failures", "last_ok_seq"), seq).alias("_s"),
        F.count_if("restarted").alias("restarts"),
        F.count_if("restart_failed").alias("failed_restarts"),
    ).select(instance, "_s.*", "restarts", "failed_restarts")


def instance_status(events: DataFrame, instance: str = "instance", seq: str = "seq") -> DataFrame:
    """Status, restart count and start of each instance from its lifecycle events.

    Kinds: start, check_ok, stop, stopped, restart, restart_failed,
    start_timeout.  An instance without a status event is stopped.  Only the
    last status event and whether a check passed after it matter, so this is
    one aggregation without an ordered fold.
    """
    kind = F.col("kind")
    started = kind.isin("start", "restart")
    target = (
        F.when(started, "starting")
        .when(kind == "stop", "stopping")
        .when(kind == "stopped", "stopped")
        .when(kind.isin("restart_failed", "start_timeout"), "failed")
    )
    state = events.groupBy(instance).agg(
        F.max_by(F.when(target.isNotNull(), F.struct(target.alias("to"), F.col(seq).alias("at"))),
                 F.when(target.isNotNull(), F.col(seq))).alias("_s"),
        F.max(F.when(kind == "check_ok", F.col(seq))).alias("_ok"),
        F.count_if(kind == "restart").alias("restarts"),
        F.max(F.when(started, F.col(seq))).alias("started_seq"),
    )
    live = (F.col("_s.to") == "starting") & (F.col("_ok") > F.col("_s.at"))
    return state.select(
        instance,
        F.when(live, "running").otherwise(F.coalesce("_s.to", F.lit("stopped"))).alias("status"),
        "restarts",
        "started_seq",
    )


def start_timeout(instances: DataFrame, now: Column, default_secs: int = 300) -> DataFrame:
    """Instances still starting after their timeout become failed."""
    age = (micros(now) - micros("started_at")) / 1_000_000
    limit = F.coalesce(F.col("startup_timeout_secs"), F.lit(default_secs)) if (
        "startup_timeout_secs" in instances.columns
    ) else F.lit(default_secs)
    late = (F.col("status") == "starting") & (age > limit)
    return instances.withColumn("timed_out", F.coalesce(late, F.lit(False))).withColumn(
        "status", F.when(F.col("timed_out"), "failed").otherwise(F.col("status"))
    )


def fleet_state(events: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Current members: names whose last added / removed event is an addition."""
    last = events.filter(F.col("kind").isin("added", "removed")).groupBy(name).agg(
        F.max_by("kind", seq).alias("kind"), F.max(seq).alias("since_seq")
    )
    return last.filter(F.col("kind") == "added").drop("kind")


def idle(conns: DataFrame, now: Column, max_idle: int = 600) -> DataFrame:
    """Connections unused for strictly more than ``max_idle`` seconds."""
    gap = micros(now) - micros("last_used")
    return conns.filter(gap > max_idle * 1_000_000).withColumn(
        "idle_secs", F.floor(gap / 1_000_000).cast("long")
    )


def orphans(conns: DataFrame, instances: DataFrame, name: str = "instance") -> DataFrame:
    """Connections whose instance is gone."""
    return conns.join(instances.select(F.col("name").alias(name)), name, "left_anti")


def duplicate_keys(instances: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``duplicate``: true for every use of ``key`` after its first by ``order``.

    The first use is a map-side combined minimum, so a key that most rows
    share is not gathered or sorted in one task.
    """
    first = instances.groupBy(key).agg(F.min(order).alias("_first"))
    return (
        instances.join(first, instances[key].eqNullSafe(first[key]))
        .drop(first[key])
        .withColumn("duplicate", F.col(order) > F.col("_first"))
        .drop("_first")
    )


def validate_instances(
    instances: DataFrame, order: str, api_port: int, rpc_port: int | None = None, min_port: int = 1024
) -> DataFrame:
    """All rule violations: (order, name, port, ordinal, violation).

    Ordinals follow the order in which a sequential validator tests one
    instance; the row with the smallest (order, ordinal) is where it would stop.
    """
    port, name = F.col("port"), F.col("name")
    # Only a row that passes the tests before it enters the set of seen values.
    first_port = instances.groupBy("port").agg(F.min(order).alias("_first_port"))
    first_name = instances.groupBy("name").agg(F.min(order).alias("_first_name"))
    rows = instances.join(first_port, "port", "left").join(first_name, "name", "left")
    rule = lambda n, text, broken: F.when(broken, F.struct(F.lit(n).alias("ordinal"), F.lit(text).alias("violation")))
    rules = [
        rule(0, "port_too_low", port < min_port),
        rule(1, "api_conflict", port == api_port),
        rule(2, "rpc_conflict", (port == rpc_port) if rpc_port is not None else F.lit(False)),
        rule(3, "duplicate_port", F.col(order) > F.col("_first_port")),
        rule(4, "empty_name", name == ""),
        rule(5, "path_separator", name.contains("/") | name.contains("\\")),
        rule(6, "duplicate_name", F.col(order) > F.col("_first_name")),
    ]
    broken = rows.select(order, "name", "port", F.explode(F.array_compact(F.array(*rules))).alias("v"))
    return broken.select(order, "name", "port", "v.ordinal", "v.violation")


def validate_limits(limits: DataFrame) -> DataFrame:
    """Port-range rules of a manager configuration: rows gain ``violation`` (first broken rule)."""
    size = F.col("port_end") - F.col("port_start")
    return limits.withColumn(
        "violation",
        F.when(F.col("api_port") < 1024, "api_port_too_low")
        .when(F.col("port_start") < 1024, "range_too_low")
        .when(F.col("port_end") <= F.col("port_start"), "range_empty")
        .when(size < F.col("max_instances"), "range_too_small"),
    )


def admit(
    requests: DataFrame, max_instances: int | None = None, fleet: str = "fleet", seq: str = "seq"
) -> DataFrame:
    """Admission of (fleet, seq, name, port) requests in order, with a verdict each.

    A name in use, then a port in use, then a full fleet rejects; a rejected
    request uses nothing.  In: explicit ports.

    A request that is the earliest candidate for both its name and its port is
    certainly accepted (as long as the fleet has room), and takes the other
    candidates for that name or port out.  One with a single earlier rival is accepted if
    that is not, so along a chain of rivals verdicts alternate, and a chain is settled
    by doubling the distance to its head.  Rounds of this reach the sequential result;
    a fleet's requests are never folded in one task.  Only the first request of each
    (name, port) can be accepted.
    """
    keys = [fleet, "name", "port"]
    left = cut(requests.groupBy(*keys).agg(F.min(seq).alias(seq)))
    accepted = None
    while not left.isEmpty():
        won = cut(_settled(left, keys, seq))
        accepted = won if accepted is None else accepted.unionByName(won)
        # Later requests for a won name or port are out; earlier ones stay candidates.
        names, ports = won.select(fleet, "name"), won.select(fleet, "port")
        left = cut(left.join(names, [fleet, "name"], "left_anti").join(ports, [fleet, "port"], "left_anti"))
    if accepted is None:
        return requests.withColumn("verdict", F.lit(None).cast("string"))
    if max_instances is not None:
        accepted = _first_per_fleet(accepted, max_instances, fleet, seq)
        full = accepted.groupBy(fleet).agg(F.count("*").alias("_size"), F.max(seq).alias("_last"))
        requests_in = requests.join(full, fleet, "left")
        is_full = (F.col("_size") >= max_instances) & (F.col(seq) > F.col("_last"))
        if max_instances <= 0:
            is_full = F.lit(True)
    else:
        requests_in, is_full = requests, F.lit(False)
    names = accepted.select(fleet, "name", F.col(seq).alias("_ns"))
    ports = accepted.select(fleet, "port", F.col(seq).alias("_ps"))
    joined = requests_in.join(names, [fleet, "name"], "left").join(ports, [fleet, "port"], "left")
    verdict = (
        F.when(F.col("_ns") < F.col(seq), "duplicate_name")
        .when(F.col("_ps") < F.col(seq), "port_conflict")
        .when(is_full, "capacity")
        .otherwise("accepted")
    )
    return joined.select(*requests.columns, verdict.alias("verdict"))


def _settled(left: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Accepted ones of the candidates at the head of a chain of single rivals, or on it."""
    fleet = keys[0]
    marked = left
    for column, first in (("name", "_n1"), ("port", "_p1")):
        marked = marked.join(left.groupBy(fleet, column).agg(F.min(seq).alias(first)), [fleet, column])
    marked = cut(marked)
    rivals = marked
    for column, first, second in (("name", "_n1", "_n2"), ("port", "_p1", "_p2")):
        later = marked.filter(F.col(seq) > F.col(first)).groupBy(fleet, column).agg(F.min(seq).alias(second))
        rivals = rivals.join(later, [fleet, column], "left")
    at = F.col(seq)
    first_name, first_port = at == F.col("_n1"), at == F.col("_p1")
    up = (
        F.when(first_name & first_port, at)
        .when((at == F.col("_n2")) & first_port, F.col("_n1"))
        .when(first_name & (at == F.col("_p2")), F.col("_p1"))
    )
    # Requests with more rivals, and those behind them, wait for the next round.
    chain = rivals.select(*keys, seq, up.alias("_up"), (up != at).cast("int").alias("_odd")).filter(F.col("_up").isNotNull())
    moving = True
    while moving:
        chain = cut(chain)
        ahead = chain.select(fleet, F.col(seq).alias("_up"), F.col("_up").alias("_next"), F.col("_odd").alias("_more"))
        step = chain.join(ahead, [fleet, "_up"])
        moving = not step.filter(F.col("_next") != F.col("_up")).isEmpty()
        odd = (F.col("_odd") + F.col("_more")) % 2
        chain = step.select(*keys, seq, F.col("_next").alias("_up"), odd.alias("_odd"))
    return chain.filter(F.col("_odd") == 0).select(*keys, seq)


def _first_per_fleet(accepted: DataFrame, n: int, fleet: str, seq: str) -> DataFrame:
    """The first ``n`` accepted rows of each fleet, ports bound a fleet to 65,536 rows."""
    place = F.row_number().over(Window.partitionBy(fleet).orderBy(seq))
    return accepted.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k")
