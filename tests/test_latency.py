import random
import statistics

import pytest
from pyspark.sql import functions as F

from textorbit.functions.formats import round6
from textorbit.operators import latency as lt
from textorbit.operators import metrics


def stats(spark, groups):
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, ms double")
    return {r["g"]: r for r in lt.timing_stats(df, ["g"]).collect()}


def test_hand_computed(spark):
    got = stats(spark, {"one": [5], "n19": range(1, 20), "n20": range(1, 21), "n100": range(1, 101)})
    want = {
        "one": (5, 0, 5, 5, 5),
        "n19": (10, 5.627314, 10, 19, 19),
        "n20": (10.5, 5.916080, 10.5, 19.95, 20),
        "n100": (50.5, 29.011492, 50.5, 95.95, 99.99),
    }
    for g, values in want.items():
        r = got[g]
        assert (r["mean_ms"], r["std_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"]) == pytest.approx(values, abs=1e-6)


def test_against_statistics_module_with_a_hot_group_and_ties(spark):
    rng = random.Random(11)
    groups = {
        "hot": [round(rng.expovariate(0.01), 3) for _ in range(30_000)],
        "ties": [7.0] * 5000 + [rng.random() for _ in range(300)] + [9.0] * 100,
        "small": [rng.random() for _ in range(13)],
        "two": [1.0, 2.0],
    }
    got = stats(spark, groups)
    for g, vs in groups.items():
        r = got[g]
        p95 = statistics.quantiles(vs, n=20)[18] if len(vs) >= 20 else max(vs)
        p99 = statistics.quantiles(vs, n=100)[98] if len(vs) >= 100 else max(vs)
        assert r["n"] == len(vs)
        assert (r["p50_ms"], r["p95_ms"], r["p99_ms"]) == pytest.approx((statistics.median(vs), p95, p99))


@pytest.mark.parametrize("i, q", [(1, 4), (3, 4), (1, 100), (99, 100)])
def test_percentile_exclusive(spark, i, q):
    rng = random.Random(i * q)
    groups = {n: [rng.random() for _ in range(n)] for n in (1, 2, 3, 10, 101)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "g int, v double")
    got = {r["g"]: r["value"] for r in lt.percentile_exclusive(df, ["g"], "v", i, q).collect()}
    assert got[1] is None
    for n in (2, 3, 10, 101):
        assert got[n] == pytest.approx(statistics.quantiles(groups[n], n=q)[i - 1])


def comparison(spark, rows):
    cols = "model string, size string, query_length string, device string, run_order int, mean_ms double, p50_ms double, p95_ms double, p99_ms double"
    return lt.compare_devices(spark.createDataFrame([(*r, r[-1], r[-1], r[-1]) for r in rows], cols))


def test_compare_devices(spark):
    rows = [
        ("m", "small", "short", "cpu", 1, 9.0), ("m", "small", "short", "cpu", 2, 10.0),
        ("m", "small", "short", "cuda", 3, 1.0), ("m", "small", "short", "mps", 4, 2.0),
        ("c", "small", "short", "cpu", 5, 2.0), ("g", "small", "short", "cuda", 6, 2.0),
    ]
    got = {r["model"]: r for r in comparison(spark, rows).collect()}
    assert set(got) == {"m", "c"}
    assert (got["m"]["cpu_mean_ms"], got["m"]["gpu_mean_ms"], got["m"]["speedup"]) == (10, 2, 5)
    assert got["c"]["gpu_mean_ms"] is None and got["c"]["speedup"] is None


def test_speedup_of_means_is_ratio_of_means(spark):
    rows = [
        ("a", "small", "short", "cpu", 1, 10.0), ("a", "small", "short", "gpu", 1, 1.0),
        ("b", "small", "short", "cpu", 1, 2.0), ("b", "small", "short", "gpu", 1, 2.0),
        ("b", "small", "odd", "cpu", 1, 2.0),
    ]
    cmp = comparison(spark, rows)
    (row,) = lt.agg_by_query(cmp).collect()
    assert row["query_length"] == "short" and row["avg_speedup"] == 4
    zero = spark.createDataFrame([(10.0, 0.0), (10.0, None)], "c double, g double")
    assert [r[0] for r in zero.select(lt.speedup(F.col("c"), F.col("g"))).collect()] == [None, None]


def test_compare_runs(spark):
    runs = spark.createDataFrame(
        [("w", "raw", 10000.0), ("w", "arrow", 8104.0), ("z", "raw", 0.0), ("z", "arrow", 5.0)],
        "workload string, mode string, throughput_per_sec double",
    )
    got = {r["workload"]: (r["diff"], r["percent"]) for r in lt.compare_runs(runs, "raw").collect()}
    assert got == {"w": (1896, "19.0"), "z": (-5, "0.0")}


def test_counters_drop_a_third_label(spark):
    df = spark.createDataFrame(
        [("m", {"a": "1", "b": "2", "c": "3"}, 1.0), ("m", {"a": "1", "b": "2", "c": "4"}, 2.0), ("m", {}, 5.0)],
        "metric string, labels map<string,string>, value double",
    )
    got = {(r["l1"], r["l2"]): r["total"] for r in metrics.counters(df).collect()}
    assert got == {("a=1", "b=2"): 3.0, (None, None): 5.0}


def test_connection_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "instance string, created_at timestamp, last_used timestamp")
    r = metrics.connection_stats(empty, F.lit("2024-01-01").cast("timestamp")).first()
    assert (r["active_connections"], r["oldest_connection_age_secs"], r["max_idle_secs"]) == (0, None, 0)


def test_round6(spark):
    assert spark.range(1).select(round6(F.lit(1 / 3))).first()[0] == 0.333333


def test_mean_of_tiny_and_huge_samples(spark):
    df = spark.createDataFrame([("a", 1e-11), ("a", 3e-11), ("b", 1e20), ("b", 3e20)], "k string, ms double")
    got = {r["k"]: (r["mean_ms"], r["p50_ms"]) for r in lt.timing_stats(df, ["k"]).collect()}
    assert got["a"] == pytest.approx((2e-11, 2e-11)) and got["b"] == pytest.approx((2e20, 2e20))


def test_two_devices_of_one_run(spark):
    rows = [("m", "small", "short", d, 1, v) for d, v in (("cpu", 9.0), ("cuda", 1.0), ("mps", 2.0))]
    for some in (rows, rows[::-1]):
        assert comparison(spark, some).first()["gpu_mean_ms"] == 2.0


def test_sketches_merge_and_leave_nulls_out(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("part"),
        F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("value"),
    )
    kept = sorted(i for i in range(3000) if i % 10 > 1)
    parts = metrics.sketches(rows, ["part"])
    whole = metrics.sketch_percentiles(metrics.merge_sketches(parts, [])).first()
    assert (whole["n"], whole["total"], whole["min"], whole["max"]) == (2400, float(sum(kept)), 2.0, 2999.0)
    for p in (50, 95, 99):
        assert abs(kept.index(int(whole[f"p{p}"])) + 1 - p / 100 * 2400) <= 0.02 * 2400
    exact = metrics.sketch_percentiles(metrics.sketches(rows.where("value < 200"), [], k=4096)).first()
    few = [v for v in kept if v < 200]
    assert [exact[f"p{p}"] for p in (50, 95, 99)] == [few[-(-p * len(few) // 100) - 1] for p in (50, 95, 99)]
    assert metrics.merge_sketches(metrics.sketches(rows.limit(0), ["part"]), ["part"]).count() == 0
    nulls = metrics.sketches(spark.range(2).select("id", F.lit(None).cast("double").alias("value")), ["id"])
    assert nulls.count() == 0
