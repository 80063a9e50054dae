import numpy as np
import pytest

from textorbit.llm import neighbours, plans


def nearest(ids, vectors, query, k):
    score = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(1))
    order = np.lexsort((ids, score))
    return [(int(ids[i]), float(score[i])) for i in order if ids[i] != query][:k]


def by_query(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], np.float64)
    got = by_query(plans.op8_neighbours(spark, f"/root/testdata/{sf}"))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    found = 0
    for q, hits in got.items():
        assert len(hits) == 10
        true = dict(nearest(ids, vectors, q, len(ids)))
        assert all(score == pytest.approx(true[i], rel=1e-12) for i, score in hits)
        found += len({i for i, _ in hits} & {i for i, _ in nearest(ids, vectors, q, 10)})
    assert found >= 0.9 * 10 * len(got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(100, rows[1][1]), (101, rows[1][1]), (5, rows[5][1])]
    bad = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan"), 1.0, 1.0, 1.0])]
    bad += [(600, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (700, [])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    table = table.selectExpr("*", "1 as cell", "2 as part", "3 as v", "4 as rank").repartition(3)
    got = by_query(neighbours.search(table, table.where("vec_id % 100 = 0 or vec_id is null or vec_id < 6"), k=7, share=1.0))
    clean = dict(rows)
    ids, vectors = np.array(sorted(clean)), np.array([clean[i] for i in sorted(clean)])
    assert set(got) == {0, 1, 2, 3, 4, 5, 100}
    for q, hits in got.items():
        want = nearest(ids, vectors, q, 7)
        assert [i for i, _ in hits] == [i for i, _ in want]
        assert [s for _, s in hits] == pytest.approx([s for _, s in want])
    assert [i for i, _ in got[1]][:2] == [100, 101]


def test_few_and_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert by_query(neighbours.search(rows, rows)) == {1: [(2, 2**0.5)], 2: [(1, 2**0.5)]}
    assert neighbours.search(rows.where("false"), rows).count() == 0
    assert neighbours.search(rows, rows.where("false")).count() == 0
    two = rows.unionByName(spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        neighbours.search(two, two)


def test_walk_is_in_order_and_stops():
    rng = np.random.default_rng(4)
    left, right, counts = rng.random(6), rng.random(5), rng.integers(0, 3, (6, 5))
    cells = neighbours.walk(left, right, counts, int(counts.sum()))
    sums = [left[i] + right[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()
    assert sum(counts[c] for c in neighbours.walk(left, right, counts, 4)) in (4, 5)


@pytest.mark.parametrize("block", [neighbours.BLOCK, 5])
def test_an_id_on_two_vectors_asks_with_both(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)] + [(0, [9.0, 9.0, 9.0, 9.0]), (0, [-9.0, -9.0, -9.0, -9.0])]
    rows += [(70, [9.0, 9.0, 9.0, 8.9]), (71, [-9.0, -9.0, -9.0, -8.8])] * 2
    for turn in (rows, rows[::-1]):
        table = spark.createDataFrame(turn, "vec_id long, embedding array<double>").repartition(3)
        hits = by_query(neighbours.search(table, table.where("vec_id = 0"), k=60, share=1.0))[0]
        assert [i for i, _ in hits[:2]] == [70, 71]
        assert [s for _, s in hits[:2]] == pytest.approx([0.1, 0.2])
        far = {i: min(np.linalg.norm(np.array(v) - np.array(w)) for j, w in rows if j == 0) for i, v in rows if i}
        assert [i for i, _ in hits] == sorted(far, key=lambda i: (far[i], i))[:60]
        assert [s for _, s in hits] == pytest.approx(sorted(far.values())[:60])
