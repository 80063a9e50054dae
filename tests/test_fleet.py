import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textorbit.operators import fleet, logs
from textorbit.streaming import flows, state

CHECK = "instance long, seq long, healthy boolean, restart_ok boolean, start_status string, start_failures long"


def fold(rows, max_failures, auto_restart):
    """The state machine as a plain loop: rows of one instance in order."""
    out, status, failures = [], None, None
    for _, seq, healthy, restart_ok, start, n in rows:
        if status is None:
            status, failures = start, n
        failed = restarted = broke = False
        if healthy:
            failures = 0
            status = "running" if status == "starting" else status
        elif status != "starting":
            failures += 1
            failed = True
            if auto_restart and failures >= max_failures:
                restarted, broke = restart_ok, not restart_ok
                status = "starting" if restart_ok else "failed"
        out.append((seq, failed, restarted, broke, failures, status))
    return out


def replay(spark, rows, step=1 << 20, **rules):
    df = fleet.health_reduce(spark.createDataFrame(rows, CHECK), step=step, **rules)
    got = {}
    for r in df.orderBy("instance", "seq").collect():
        got.setdefault(r["instance"], []).append(
            (r["seq"], r["check_failed"], r["restarted"], r["restart_failed"], r["failures"], r["status"])
        )
    return got


def trace(text, start="stopped", restart_ok=True):
    return [(1, i, c == "S", restart_ok, start, 0) for i, c in enumerate(text)]


@pytest.mark.parametrize(
    "text, start, rules, restart_ok, failures, status, restarts",
    [
        ("SFFF", "stopped", {}, True, 3, "starting", 1),
        ("FFFFF", "running", {"auto_restart": False}, True, 5, "running", 0),
        ("FFFS", "stopped", {"max_failures": 5}, True, 0, "stopped", 0),
        ("FFFFFFFFFF", "starting", {}, True, 0, "starting", 0),
        ("S", "starting", {}, True, 0, "running", 0),
        ("FFFF", "running", {}, False, 4, "failed", 2),
        ("S", "failed", {}, True, 0, "failed", 0),
        ("FFFFS", "running", {}, True, 0, "running", 1),
    ],
)
def test_health_traces(spark, text, start, rules, restart_ok, failures, status, restarts):
    got = replay(spark, trace(text, start, restart_ok), **rules)[1]
    assert got[-1][4:] == (failures, status)
    assert sum(r[2] or r[3] for r in got) == restarts


@pytest.mark.parametrize("step", [1, 13, 1 << 20])
def test_health_against_a_loop_with_a_hot_instance(spark, step):
    rng = random.Random(5)
    start = {i: (rng.choice(fleet.STATUSES), rng.randrange(5)) for i in range(6)}
    rows = []
    for seq in range(800):
        i = 0 if rng.random() < 0.5 else rng.randrange(6)
        rows.append((i, seq, rng.random() < 0.3, rng.random() < 0.5, *start[i]))
    got = replay(spark, rows, step=step)
    for i in range(6):
        assert got[i] == fold([r for r in rows if r[0] == i], 3, True)


def test_starting_failures_have_no_check_failed_event(spark):
    df = fleet.health_reduce(spark.createDataFrame(trace("FFS", "starting"), CHECK))
    kinds = [r["event_type"] for r in fleet.health_events(df).orderBy("seq", "ordinal").collect()]
    assert kinds == ["check_started", "check_started", "check_started", "check_succeeded"]


def stream_dir(spark, tmp_path, rows, schema, files):
    """Rows cut into files in order, one file per micro-batch."""
    size = -(-len(rows) // files)
    for n in range(files):
        part = spark.createDataFrame(rows[n * size : (n + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return flows.file_stream(spark, str(tmp_path / "in"), schema, max_files=1)


def test_health_monitor_carries_state_between_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(3), seq, rng.random() < 0.35, rng.random() < 0.5) for seq in range(120)]
    schema = "instance long, seq long, healthy boolean, restart_ok boolean"
    stream = stream_dir(spark, tmp_path, rows, schema, 4)
    flows.health_monitor(stream, str(tmp_path / "run")).awaitTermination()
    out = flows.read_batches(spark, str(tmp_path / "run"), flows.HEALTH_STATE)
    assert out.select("batch").distinct().count() == 4
    got = {r["seq"]: (r["failures"], r["status"]) for r in out.collect()}
    for i in range(3):
        for seq, *_, failures, status in fold([(*r, "stopped", 0) for r in rows if r[0] == i], 3, True):
            assert got[seq] == (failures, status)


def test_lifecycle_over_batches(spark, tmp_path):
    rows = [("a", 1, "added"), ("b", 2, "added"), ("a", 3, "removed"), ("c", 4, "added"), ("b", 5, "stopped"), ("a", 6, "added")]
    rows.append(("b", 4, "added"))  # late: b has left since
    stream = stream_dir(spark, tmp_path, rows, "name string, seq long, kind string", 4)
    root = str(tmp_path / "run")
    flows.lifecycle_apply(stream, root).awaitTermination()
    left = flows.read_batches(spark, root, "name string, seq long")
    assert sorted(r["name"] for r in left.collect()) == ["a", "b"]
    assert sorted(tuple(r) for r in flows.read_members(spark, root).collect()) == [("a", 6), ("c", 4)]


def until(query, done, seconds=60):
    """Wait for a query that runs until it is stopped, then stop it."""
    end = time.time() + seconds

    def settled():
        try:
            return done()
        except Exception:  # a table that is being written
            return False

    while not settled() and time.time() < end:
        assert query.exception() is None
        time.sleep(0.3)
    query.stop()
    assert done()


def test_late_checks_end_as_the_table_does(spark, tmp_path):
    """Ten is known when five to seven come; they are given out as late and change nothing."""
    rows = [(1, n, True, True) for n in (1, 2, 10)] + [(1, n, False, True) for n in (5, 6, 7)] + [(1, 11, False, True)] * 3
    schema = "instance long, seq long, healthy boolean, restart_ok boolean"
    stream = stream_dir(spark, tmp_path, rows, schema, 3)
    flows.health_monitor(stream, str(tmp_path / "run"), initial_status=F.lit("starting")).awaitTermination()
    out = flows.read_batches(spark, str(tmp_path / "run"), flows.HEALTH_STATE).collect()
    late = sorted((r["seq"], r["status"], r["failures"], r["restarted"]) for r in out if r["late"])
    assert late == [(5, "running", 0, False), (6, "running", 0, False), (7, "running", 0, False)] + [(11, "running", 1, False)] * 2
    last = max((r["seq"], not r["late"], r["status"], r["failures"], r["last_ok_seq"]) for r in out)
    assert last == (11, True, "running", 1, 10)


def test_names_that_left_are_forgotten_in_time(spark, tmp_path):
    schema = "name string, seq long, kind string"
    root, folder = str(tmp_path / "run"), str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add(("a", 1, "added"), ("a", 5, "removed"), ("b", 2, "added"))
    query = flows.lifecycle_apply(flows.file_stream(spark, folder, schema), root, {"processingTime": "1 second"}, remember_secs=4)
    forgotten = lambda: query.lastProgress and query.lastProgress["stateOperators"][0]["numRowsRemoved"] == 1
    end = time.time() + 60
    while not forgotten() and time.time() < end:
        time.sleep(0.3)
    add(("a", 3, "added"))
    members = lambda: sorted(r["name"] for r in flows.read_members(spark, root).collect()) == ["a", "b"]
    until(query, members)


def test_targets_may_be_forgotten(spark, tmp_path):
    schema = "stream_id long, seq long, target string"
    root, folder = str(tmp_path / "run"), str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add((1, 0, "a"))
    query = flows.bind_targets(flows.file_stream(spark, folder, schema), root, {"processingTime": "1 second"}, remember_secs=3)
    end = time.time() + 60
    seen = lambda: query.lastProgress and query.lastProgress["stateOperators"][0]["numRowsRemoved"] > 0
    while not seen() and time.time() < end:
        time.sleep(0.2)
    add((1, 1, "b"))
    got = lambda: flows.read_batches(spark, root, f"{schema}, bound_target string").filter("bound_target = 'b'").count() == 1
    until(query, got)


def test_bound_messages_keep_their_values(spark, tmp_path):
    big = 9007199254740993
    stamp = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    rows = [(big, 0, "a", None, big, stamp), (big, 1, None, 0.1, None, None), (big, 2, "c", float("inf"), big + 1, stamp)]
    schema = "stream_id long, seq long, target string, weight double, number long, ts timestamp_ntz"
    root = str(tmp_path / "run")
    flows.bind_targets(stream_dir(spark, tmp_path, rows, schema, 2), root).awaitTermination()
    out = flows.read_batches(spark, root, f"{schema}, bound_target string").drop("batch")
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [(*r, "a") for r in rows]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_start_timeouts(spark, tmp_path):
    rows = [
        ("quick", at(0), "start"), ("slow", at(0), "start"), ("quick", at(200), "check_ok"), ("again", at(10), "start"),
        ("slow", at(301), "check_ok"), ("again", at(250), "restart"), ("other", at(20), "check_failed"),
        ("again", at(551), "stop"), ("open", at(400), "start"), ("edge", at(100), "start"), ("edge", at(400), "check_ok"),
        ("clock", at(4200), "check_ok"),
    ]
    stream = stream_dir(spark, tmp_path, rows, "instance string, ts timestamp, kind string", 4)
    root = str(tmp_path / "run")
    flows.start_timeouts(stream, root, 300, "1 hour").awaitTermination()
    out = flows.read_batches(spark, root, "instance string, started_at timestamp, failed_at timestamp")
    got = sorted((r["instance"], r["started_at"], r["failed_at"]) for r in out.collect())
    # "again" was stopped one second past its limit, "open" and its timer lie beyond the watermark
    assert got == [("again", at(250), at(550)), ("slow", at(0), at(300))]


def test_start_timeouts_by_the_clock(spark, tmp_path):
    schema = "instance string, ts timestamp, kind string, startup_timeout_secs int"
    rows = [("a", at(0), "start", 2), ("b", at(0), "start", None), ("b", at(5), "check_ok", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "run")
    stream = flows.file_stream(spark, str(tmp_path / "in"), schema)
    query = flows.start_timeouts(stream, root, 300, None, {"processingTime": "1 second"})
    out = lambda: [
        (r["instance"], r["failed_at"])
        for r in flows.read_batches(spark, root, "instance string, started_at timestamp, failed_at timestamp").collect()
    ]
    until(query, lambda: out() == [("a", at(2))])


def test_first_target_binds_across_batches(spark, tmp_path):
    rows = [(1, 0, "a"), (2, 0, None), (1, 1, "b"), (2, 1, "x"), (1, 2, None)]
    stream = stream_dir(spark, tmp_path, rows, "stream_id long, seq long, target string", 3)
    root = str(tmp_path / "run")
    flows.bind_targets(stream, root).awaitTermination()
    out = flows.read_batches(spark, root, "stream_id long, seq long, target string, bound_target string")
    got = {(r["stream_id"], r["seq"]): r["bound_target"] for r in out.collect()}
    assert got == {(1, 0): "a", (1, 1): "a", (1, 2): "a", (2, 0): None, (2, 1): None}


def test_rerank_stream_waits_for_the_end_and_uses_first_options(spark, tmp_path):
    rows = [
        (7, 0, "red boat", "blue car", True, True, False),
        (8, 0, "red boat", "red boat", True, False, False),
        (7, 1, "red boat", "red boat", False, False, False),
        (7, 2, "red boat", "red car", False, False, True),
    ]
    schema = "query_id long, seq long, query string, text string, raw_scores boolean, return_text boolean, is_last boolean"
    stream = stream_dir(spark, tmp_path, rows, schema, 2)
    root = str(tmp_path / "run")
    flows.rerank_stream(stream, root).awaitTermination()
    out = flows.read_batches(spark, root, flows.RANKS).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["index"], r["text"]) for r in out][0] == (7, 1, 1, "red boat")
    assert len(out) == 3 and all(r["text"] is not None for r in out)


TEXTS = "query_id long, seq long, query string, text string, raw_scores boolean, return_text boolean, is_last boolean"


def test_texts_after_the_end_are_reported(spark, tmp_path):
    rows = [
        (1, 0, "red boat", "boat", True, True, False), (1, 2, "red boat", "red", True, True, True),
        (1, 1, "red boat", "red boat", True, True, False), (2, 0, "x", "y", True, True, False),
    ]
    root = str(tmp_path / "run")
    flows.rerank_stream(stream_dir(spark, tmp_path, rows, TEXTS, 2), root).awaitTermination()
    assert {(r["query_id"], r["index"]) for r in flows.read_batches(spark, root, flows.RANKS).collect()} == {(1, 0), (1, 1)}
    late = flows.read_batches(spark, root, flows.LATE_TEXTS, "errors").drop("batch")
    assert [tuple(r) for r in late.collect()] == [(1, 1, "red boat")]


def test_texts_within_the_delay_are_ranked_and_idle_queries_end(spark, tmp_path):
    root, folder = str(tmp_path / "run"), str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(folder)
    add((1, 0, "a", "a", True, True, False), (1, 2, "a", "b", True, True, True), (2, 0, "a", "a", True, True, False))
    query = flows.rerank_stream(
        flows.file_stream(spark, folder, TEXTS), root, trigger={"processingTime": "1 second"}, delay_secs=12, idle_secs=8
    )
    end = time.time() + 60
    while not query.recentProgress and time.time() < end:
        time.sleep(0.2)
    add((1, 1, "a", "a b", True, True, False))
    ranks = lambda: sorted((r["query_id"], r["index"]) for r in flows.read_batches(spark, root, flows.RANKS).collect())
    until(query, lambda: ranks() == [(1, 0), (1, 1), (1, 2), (2, 0)])


def test_empty_stream_gives_nothing(spark, tmp_path):
    spark.createDataFrame([], "event_id long, request string").write.parquet(str(tmp_path / "in"))
    stream = flows.file_stream(spark, str(tmp_path / "in"), "event_id long, request string")
    flows.split_errors(stream, str(tmp_path / "run"), F.col("request").isNotNull()).awaitTermination()
    assert flows.read_batches(spark, str(tmp_path / "run"), "event_id long, request string").count() == 0


def test_admit(spark):
    rows = [(0, 1, "a", 1), (0, 2, "a", 2), (0, 3, "b", 1), (0, 4, "b", 2), (0, 5, "c", 3)]
    df = spark.createDataFrame(rows, "fleet long, seq long, name string, port int")
    got = [r["verdict"] for r in fleet.admit(df, 2).orderBy("seq").collect()]
    assert got == ["accepted", "duplicate_name", "port_conflict", "accepted", "capacity"]


def test_a_chain_of_requests_takes_few_rounds(spark, monkeypatch):
    """Each request shares its name or its port with the one before."""
    rows = [(0, n, f"n{(n + 1) // 2}", n // 2) for n in range(1_000)]
    rounds = []
    settled = fleet._settled
    monkeypatch.setattr(fleet, "_settled", lambda *args: rounds.append(1) or settled(*args))
    got = fleet.admit(spark.createDataFrame(rows, "fleet long, seq long, name string, port int")).collect()
    assert {r["seq"]: r["verdict"] == "accepted" for r in got} == {n: n % 2 == 0 for n in range(1_000)}
    assert len(rounds) <= 2


@pytest.mark.parametrize("step", [1, 3, 7, 50])
def test_chunks_put_together_replay_as_one(spark, step):
    """Every start, rule and number of failures, cut into chunks of few checks."""
    rng = random.Random(step)
    for rules in ((1, True), (3, True), (5, True), (2, False)):
        rows = []
        for i in range(24):
            start, failures, luck = rng.choice(["starting", "running", "stopped", "failed"]), rng.randrange(7), rng.random()
            rows += [(i, n, rng.random() < luck / 2, rng.random() < 0.5, start, failures) for n in sorted(rng.sample(range(60), 40))]
        got = replay(spark, rows, step=step, max_failures=rules[0], auto_restart=rules[1])
        for i in range(24):
            want = fold([r for r in rows if r[0] == i], *rules)
            assert [(n, f, s) for n, *_, f, s in got[i]] == [(n, f, s) for n, *_, f, s in want]


def test_admit_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), seq, f"n{rng.randrange(40)}", rng.randrange(30)) for seq in range(400)]
    for limit in (None, 9):
        df = fleet.admit(spark.createDataFrame(rows, "fleet long, seq long, name string, port int"), limit)
        got = {r["seq"]: r["verdict"] for r in df.collect()}
        names, ports = {0: set(), 1: set()}, {0: set(), 1: set()}
        for f, seq, name, port in rows:
            want = (
                "duplicate_name" if name in names[f]
                else "port_conflict" if port in ports[f]
                else "capacity" if limit is not None and len(names[f]) >= limit
                else "accepted"
            )
            if want == "accepted":
                names[f].add(name)
                ports[f].add(port)
            assert got[seq] == want


def test_validation_rules(spark):
    rows = [(0, "x", 80), (1, "y", 9000), (2, "z", 9001), (3, "p", 5000), (4, "q", 5000), (5, "", 5001), (6, "a/b", 5002), (7, "a\\b", 5003), (8, "x", 5004)]
    df = spark.createDataFrame(rows, "ord int, name string, port int")
    got = {r["ord"]: r["violation"] for r in fleet.validate_instances(df, "ord", 9000, 9001).collect()}
    assert got == {
        0: "port_too_low", 1: "api_conflict", 2: "rpc_conflict", 4: "duplicate_port",
        5: "empty_name", 6: "path_separator", 7: "path_separator", 8: "duplicate_name",
    }
    assert "rpc_conflict" not in {r["violation"] for r in fleet.validate_instances(df, "ord", 9000).collect()}


def test_idle_is_strict(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    df = spark.createDataFrame([(n,) for n in (599, 600, 601)], "age int").withColumn(
        "last_used", F.timestamp_seconds(F.unix_seconds(now) - F.col("age"))
    )
    assert [r["age"] for r in fleet.idle(df, now).collect()] == [601]


def test_sessions_close_after_the_gap(spark):
    for offsets, uses in (([0, 599, 1199, 1799], [4]), ([0, 600, 1201, 1801, 5000], [2, 2, 1])):
        df = spark.createDataFrame([("i", s) for s in offsets], "instance string, s long")
        rows = df.select("instance", F.timestamp_seconds("s").alias("ts"))
        ours = flows.idle_sessions(rows).orderBy("session_start").collect()
        assert [r["uses"] for r in ours] == uses
        plain = rows.groupBy("instance", F.session_window("ts", "600 seconds").alias("s")).count().select("s.*", "count")
        assert sorted(tuple(r)[1:] for r in ours) == sorted(tuple(r) for r in plain.collect())


@pytest.mark.parametrize(
    "start, end, count, bounds",
    [
        (None, None, 5, (0, 5)), (0, 2, 2, (0, 2)), (-2, None, 2, (3, 5)), (-99, None, 5, (0, 5)),
        (None, -1, 4, (0, 4)), (99, None, 0, (5, 5)), (4, 2, 0, (4, 2)),
    ],
)
def test_log_slices(spark, start, end, count, bounds):
    df = spark.range(5).select(F.lit("i").alias("instance"), F.col("id").alias("line_no"), F.lit("x").alias("line"))
    assert logs.log_slice(df, start, end).count() == count
    b = logs.log_bounds(df, start, end).first()
    assert (b["start"], b["end"], b["total_lines"]) == (*bounds, 5)


@pytest.mark.parametrize(
    "lines, verdict, detail",
    [
        (["loading", "Starting gRPC server"], "ok", "Starting gRPC server"),
        (["Error: out of memory", *"1234567"], "error", "Error: out of memory\n1\n2\n3\n4\n5"),
        (["cuda out of memory"], "out_of_memory", "cuda out of memory"),
        (["HTTP 404 model not found"], "model_not_found", "HTTP 404 model not found"),
        (["Unsupported model x"], "invalid_model", "Unsupported model x"),
        (["loading"], "unexpected_exit", None),
        (["error: x", "Started HTTP server"], "error", "error: x\nStarted HTTP server"),
    ],
)
def test_log_verdicts(spark, lines, verdict, detail):
    df = spark.createDataFrame([("i", n, line) for n, line in enumerate(lines)], "instance string, line_no long, line string")
    r = logs.log_verdict(df).first()
    assert (r["verdict"], r["detail"]) == (verdict, detail)


class _Memory:
    """The state of a key as a step sees it."""

    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, at):
        self.at = at

    def getCurrentWatermarkMs(self):
        return 0


def test_steps_of_many_keys_put_no_pandas_frames_together(monkeypatch):
    """A key's rows may come in several frames, in any order; rows with nulls are sorted as pandas does."""
    frames = [pd.DataFrame({"name": "a", "seq": s, "kind": k}) for s, k in (([5, 2], ["removed", "added"]), ([2, 9], ["removed", "added"]))]
    timed = [pd.DataFrame({"at": [30, 0], "limit": 10, "starts": [False, True], "ends": [True, False]}), pd.DataFrame({"at": [50], "limit": 10, "starts": [True], "ends": [False]})]
    odd = [pd.DataFrame({"seq": [None, 3.0], "kind": ["added", "added"]}), pd.DataFrame({"seq": [1], "kind": ["removed"]})]
    assert [r[0] for r in state._sorted_rows(odd, ["seq", "kind"], ["seq", "kind"])][:2] == [1, 3]

    def refused(*_, **__):
        raise AssertionError("frames put together for one key")

    monkeypatch.setattr(state.pd, "concat", refused)
    known, waiting = _Memory(), _Memory()
    left = list(state.membership(None)(("a",), iter(frames), known))
    assert left[0].to_dict("list") == {"name": ["a"], "seq": [5]} and known.get == (9, True)
    left = list(state.membership(None)(("a",), iter([pd.DataFrame({"seq": [11, 10], "kind": ["stopped", "added"]})]), known))
    assert left[0].to_dict("list") == {"name": ["a"], "seq": [11]} and known.get == (11, False)
    late = list(state.start_timeout("instance", True)(("i",), iter(timed), waiting))
    assert late[0].to_dict("list") == {"instance": ["i"], "started": [0], "failed": [10]} and waiting.get == (50, 60)
