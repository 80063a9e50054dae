import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from textorbit.llm import negatives, plans

SCHEMA = "vec_id long, label int, embedding array<bigint>"


def plain(rows, every=50, positives=5, kept=3, low=50, high=95):
    """All inner products in Python's own integers."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in rows if i != a]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [(i, -t) for t, i, lab in scored if lab != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(fits[:kept], 1)]
    return sorted(out)


def mined(spark, rows, anchors="vec_id % 50 = 0", **options):
    return sorted(map(tuple, negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.expr(anchors), **options).collect()))


@pytest.mark.parametrize("name", ["op12_hard_negatives"])
def test_query(spark, name):
    ok, note = check.compare(spark, check.duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name)
    assert ok, note


@pytest.mark.parametrize("largest", [1, 100, 60_000, 2**20, 2**24])
def test_scores_are_exact(largest):
    rng = np.random.default_rng(largest)
    width = 130
    a, b = (rng.integers(-largest, largest + 1, (n, width)) for n in (5, 7))
    a[0], b[0], b[1] = largest, largest, -largest
    bound = width * largest * largest
    primes = negatives.primes_for(bound)
    got = negatives.Residues(a, primes).times(negatives.Residues(b, primes), slice(0, 5))
    assert got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_no_primes_reach_further():
    assert len(negatives.primes_for(negatives.MOST)) == 6
    with pytest.raises(ValueError):
        negatives.primes_for(1 << 62)


@pytest.mark.parametrize("width, largest, labels", [(1, 3, 2), (3, 2, 3), (7, 300, 4), (70, 2**25, 5)])
def test_ties_and_blocks(spark, monkeypatch, width, largest, labels):
    monkeypatch.setattr(negatives, "SMALLEST", 40)
    monkeypatch.setattr(negatives, "PACK", 3)
    monkeypatch.setattr(negatives, "SCORES", 64)
    rng = random.Random(width)
    ids = rng.sample(range(-100, 900), 300)
    rows = [(i, rng.randrange(labels), [rng.randint(-largest, largest) for _ in range(width)]) for i in ids]
    rows += [(1000, 0, [0] * width), (1001, 0, [1] * width)]
    assert mined(spark, rows) == plain(rows)
    options = {"positives": 2, "negatives": 1, "low": 0, "high": 100}
    assert mined(spark, rows, **options) == plain(rows, 50, 2, 1, 0, 100)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [5, 5]), (2, 2, [3, 3]), (3, 2, [4, 3]), (50, 3, [1, 1])]
    odd = [(None, 1, [9, 9]), (4, None, [6, 6]), (5, 2, None), (6, 2, [None, 3]), (1, 1, [5, 5]), (3, 2, [4, 3])]
    want = plain(rows)
    assert [r[3] for r in want] == [3, 2]
    wide = spark.createDataFrame(rows + odd, SCHEMA)
    wide = wide.selectExpr("*", *[f"'c' as {c}" for c in ("block", "kind", "rank", "data", "v", "anchor_id", "windows")])
    assert sorted(map(tuple, negatives.mine_negatives(wide, F.expr("vec_id % 50 = 0")).collect())) == want
    twice = [(0, 1, [3, 4]), (1, 1, [6, 8]), (2, 2, [3, 3]), (2, 1, [5, 5]), (3, 2, [4, 3])]
    assert mined(spark, twice) == mined(spark, twice[::-1]) == plain([r for r in twice if r != (2, 2, [3, 3])])
    assert mined(spark, []) == []
    assert mined(spark, rows, "vec_id = 7") == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError):
        mined(spark, rows + [(7, 1, [1])])
    with pytest.raises(ValueError):
        mined(spark, rows + [(7, 1, [2**40, 0])])


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SMALLEST", 100)
    rng = random.Random(2)
    rows = [(i, i % 3, [5, 5, 5] if i % 3 == 0 or i % 7 == 0 else [rng.randint(0, 9) for _ in range(3)]) for i in range(700)]
    assert mined(spark, rows) == plain(rows)


def test_query_leaves_odd_vectors_out(spark, tmp_path):
    rows = [(i, i % 3, [0.01 * (i % 17), -0.5, 0.25 * (i % 5)]) for i in range(120)]
    rows += [(200, 1, None), (201, None, [1.0, 1.0, 1.0]), (202, 1, [float("nan"), 1.0, 1.0]), (203, 1, [None, 1.0, 1.0])]
    rows += [(204, 1, [float("inf"), 1.0, 1.0]), (205, 2, [0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, plans.op12_hard_negatives(spark, str(tmp_path)).collect()))
    used = [
        (i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v])
        for i, lab, v in rows
        if i < 200 or i == 205
    ]
    assert got == plain(used) and got
