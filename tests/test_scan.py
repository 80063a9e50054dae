"""Segmented scans against plain Python folds, with chunks far smaller than the keys."""

import random

import pytest
from pyspark.sql import functions as F

from textorbit.operators import batch, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for seq in range(600):
        key = "hot" if rng.random() < 0.5 else rng.choice("abcde")
        data.append((key, seq, rng.random() < 0.15, rng.randrange(5), rng.choice([None, None, "x", "y"])))
    return data, spark.createDataFrame(data, "k string, seq long, reset boolean, v long, mark string")


@pytest.mark.parametrize("step", [1, 7, 100, 10_000])
def test_running(rows, step):
    data, df = rows
    value = F.when(F.col("reset"), 0).otherwise(F.col("v"))
    got = {
        r["seq"]: (r["total"], r["latest"], r["since"])
        for r in scan.running(
            scan.step_chunks(df, "seq", step), ["k"], ["seq"],
            sums={"total": F.col("v")}, lasts={"latest": F.col("mark")}, since={"since": (F.col("reset"), value)},
        ).collect()
    }
    state = {}
    for k, seq, reset, v, mark in data:
        total, latest, since = state.get(k, (0, None, 0))
        state[k] = (total + v, mark or latest, 0 if reset else since + v)
        assert got[seq] == state[k], (seq, k)


@pytest.mark.parametrize("timed", [True, False])
@pytest.mark.parametrize("keys", [["k"], []])
def test_even_chunks_hold_few_rows_of_any_order(rows, monkeypatch, timed, keys):
    """Minutes as microseconds neither make a chunk a row nor one chunk of all."""
    data, df = rows
    at = F.timestamp_micros(F.col("seq") * 60_000_000) if timed else F.col("seq") * 1000
    cut = scan.even_chunks(df.withColumn("at", at), "at", keys, rows=50)
    assert cut.columns == [*df.columns, "at", scan.CHUNK]
    sizes = [r["count"] for r in cut.groupBy(*keys, scan.CHUNK).count().collect()]
    assert max(sizes) <= 100 and len(sizes) <= 2 * len(data) / 50 + 6
    got = {r["seq"]: r["total"] for r in scan.running(cut, keys, ["at"], sums={"total": F.col("v")}).collect()}
    totals = {}
    for k, seq, _, v, _ in data:
        name = k if keys else ""
        totals[name] = totals.get(name, 0) + v
        assert got[seq] == totals[name]


@pytest.mark.parametrize("keys", [["k"], []])
def test_bunched_values_are_cut_by_their_rows(spark, keys):
    """A burst of values beside one far away, and many rows of one value."""
    values = [*range(2_000), 10**15, *(10**9 + 7 * i for i in range(500))]
    data = [("hot", v) for v in values] + [("few", v) for v in range(0, 10**12, 10**11)]
    df = spark.createDataFrame(data, "k string, at long").repartition(4)
    cut = scan.even_chunks(df, "at", keys, rows=100)
    sizes = {tuple(r[c] for c in (*keys, scan.CHUNK)): r["count"] for r in cut.groupBy(*keys, scan.CHUNK).count().collect()}
    assert max(sizes.values()) <= 200 and len(sizes) <= 2 * len(data) / 100 + 2
    got = cut.groupBy(*keys, scan.CHUNK).agg(F.min("at").alias("a"), F.max("at").alias("b")).orderBy(*keys, scan.CHUNK).collect()
    for one, two in zip(got, got[1:]):
        assert one["b"] <= two["a"] or (keys and one["k"] != two["k"])
    same = spark.createDataFrame([("hot", 5)] * 300 + [("hot", 6)] * 300 + [("hot", 7)], "k string, at long")
    parts = scan.even_chunks(same, "at", keys, rows=100).groupBy(scan.CHUNK).agg(F.count_distinct("at"), F.count("*")).collect()
    assert sorted(r[2] for r in parts) == [1, 300, 300]


def test_positions_by_any_order(rows):
    data, df = rows
    got = {r["seq"]: r["position"] for r in scan.ranked(df, ["k"], [F.col("v"), F.col("seq")]).collect()}
    for key in {r[0] for r in data}:
        mine = sorted((v, seq) for k, seq, _, v, _ in data if k == key)
        assert [got[seq] for _, seq in mine] == list(range(len(mine)))


def test_hot_key_is_split_over_partitions(rows):
    _, df = rows
    chunks = scan.range_chunks(df, [F.col("seq")], ["k"], 8).filter("k = 'hot'")
    assert chunks.select(scan.CHUNK).distinct().count() >= 3


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_pieces_of_a_range_are_numbered_apart(spark, keys):
    rows = spark.range(-9000, 30_000, 2).withColumn("k", F.col("id") % 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = batch.number_rows(rows, ["id"], keys, step=1 << 20)
        tasks = got.groupBy(F.spark_partition_id()).count().count()
        found = {r["id"]: r["position"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    seen, want = {}, {}
    for i in range(-9000, 30_000, 2):
        k = i % 3 - (3 if i % 3 and i < 0 else 0) if keys else 0
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert found == want
    assert tasks > (3 if keys else 1)
