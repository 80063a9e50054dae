import hashlib
import random
import re

import numpy as np
import pytest

import check
from textorbit.llm import factors, plans

from .conftest import ODD_ROWS

SCHEMA = "doc_id long, text string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, window=50):
    """Every window's smallest document, one window after another."""
    texts = [(i, split(t)) for i, t in rows]
    least = {}
    for i, w in texts:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def dropped(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, factors.drop_repeats(df).collect()), key=repr)


def passage(rng, n, kinds=5000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def test_query(spark):
    ok, note = check.compare(spark, check.duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", "op11_substring_dedup")
    assert ok, note


def test_query_drops_something(spark):
    assert plans.op11_substring_dedup(spark, "/root/testdata/sf0.001").where("n_removed > 0").count() > 10


def test_windows_of_a_block():
    rng = random.Random(3)
    for _ in range(120):
        kinds, n = rng.choice([1, 2, 3, 30]), rng.randint(0, 150)
        block = np.array([rng.randrange(kinds) * 7919 + 11 for _ in range(n)], np.uint64)
        h = []
        while len(h) < rng.randint(1, 260):
            a = rng.randrange(n) if n else 0
            some = block[a : a + rng.randint(1, 90)].tolist() if rng.random() < 0.7 else []
            h += some or [rng.randrange(kinds + 1) * 7919 + 11 for _ in range(5)]
        h = np.array(h, np.uint64)
        have = {tuple(block[i : i + 50].tolist()) for i in range(n - 49)}
        reference = factors.Reference(block)
        assert reference.known(h).tolist() == [tuple(h[i : i + 50].tolist()) in have for i in range(len(h) - 49)]
        for i, length in reference.factors(h):
            runs = [next((c for c in range(len(h) - i + 1) if c + j >= n or c + i >= len(h) or block[j + c] != h[i + c])) for j in range(n)]
            assert length == max(runs)


@pytest.mark.parametrize("kinds", [1, 2, 9, 1000])
def test_each_window_has_its_least_seed(kinds):
    rng = np.random.default_rng(kinds)
    h = (rng.integers(0, kinds, 700) * 2654435761 + 5).astype(np.uint64)
    values, places = factors.seeds(h)
    all_seeds = factors.rolling(h, factors.SEED)
    assert (all_seeds[places] == values).all()
    for s in range(len(h) - factors.WINDOW + 1):
        own = values[(places >= s) & (places <= s + factors.BEFORE)]
        assert len(own) and own.min() == all_seeds[s : s + factors.BEFORE + 1].min()


def test_passages_of_many_documents(spark):
    """Shared passages whose owner holds a part only, edits, chains, and repeats within a text."""
    rng = random.Random(11)
    shared = [passage(rng, n) for n in (49, 50, 51, 75, 120, 2300)]
    rows = []
    for i in rng.sample(range(1000), 120):
        words = passage(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p)) if rng.random() < 0.6 else 0
            p = list(p[a : a + rng.randint(20, 2400)])
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            words += p + passage(rng, rng.choice([0, 0, 1, 30]))
        rows.append((i, " ".join(words)))
    got = dropped(spark, rows)
    assert got == plain(rows)
    assert sum(r[2] > 0 for r in got) > 40


def test_repeating_texts(spark):
    rng = random.Random(4)
    rows = [(0, "a " * 30), (1, "a " * 49), (2, "a " * 200), (3, "a " * 50 + "b"), (4, "a b " * 200), (5, "b a " * 40)]
    base = passage(rng, 37)
    rows += [(6, " ".join(base * 6)), (7, " ".join(base[5:] + base * 2 + ["x"] + base * 3)), (8, "a " * 1500 + "c " * 1500)]
    rows += [(9, "c " * 70 + "a " * 70), (10, " ".join((passage(rng, 60) + base * 2) * 2))]
    assert dropped(spark, rows) == plain(rows)


def test_copies_and_repeated_ids(spark):
    rng = random.Random(5)
    text, other, short = (" ".join(passage(rng, n)) for n in (90, 80, 20))
    rows = [(5, text), (5, text), (7, text), (9, text.replace(" ", "\n")), (5, other + " " + text), (3, other), (4, short), (6, short)]
    rows += [(7, other), (None, text), (None, None), (-1, None), (-(2**40), other + " x")]
    assert dropped(spark, rows) == plain(rows)


def test_a_third_of_all_rows_share_a_passage(spark):
    rng = random.Random(6)
    common = " ".join(passage(rng, 70))
    rows = [(i, " ".join(passage(rng, 10)) + " " + common + " " + " ".join(passage(rng, 10))) for i in range(300)]
    rows += [(1000 + i, " ".join(passage(rng, 60))) for i in range(300)]
    rows += [(2000 + i, common) for i in range(300)]
    assert dropped(spark, rows) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs, documents):
    got = sorted(map(tuple, factors.drop_repeats(odd_docs).collect()), key=repr)
    assert got == plain(ODD_ROWS)
    assert factors.drop_repeats(no_docs).count() == 0
    names = {"doc_id": "digest", "text": "row"}
    other = factors.drop_repeats(documents.withColumnsRenamed(names), "digest", "row")
    assert other.select("doc_id", "kept_sha256").exceptAll(factors.drop_repeats(documents).select("doc_id", "kept_sha256")).isEmpty()
