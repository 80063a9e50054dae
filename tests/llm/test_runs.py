import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from textorbit.llm import plans, runs

from .conftest import ODD_ROWS

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(words, exponent=4, least=6):
    """Longest stretches of words equal to the one q further on, for each q."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def report(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


def planted(doc_id, text):
    """The words of the query's documents, one by one."""
    words = split(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("step", [7, runs.STEP])
def test_runs_against_every_period(monkeypatch, step):
    monkeypatch.setattr(runs, "STEP", step)
    rng = random.Random(13)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.randint(0, 120), rng.choice([1, 2, 3, 40])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 1 + n // 3)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        exponent, least = rng.choice([(4, 6), (2, 2), (3, 1)])
        x = np.array([w for t in texts for w in t], np.uint64)
        got = runs.find(x, np.array([len(t) for t in texts], np.int64), exponent, least)
        want = [(k, *r) for k, t in enumerate(texts) for r in sorted(plain_runs(t, exponent, least), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in got.tolist()] == want


def test_extensions_of_all_pairs():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2, 90), np.tile(rng.integers(0, 2, 11), 8), np.zeros(40, int)]).astype(np.uint64)
    i, j = np.triu_indices(len(x), 1)
    most = len(x) - j
    assert (runs.Extensions(x).right(i, j, most) == runs.agree(x, i, j, most)).all()


def test_query_against_every_period(spark, documents):
    got = plans.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    want = {}
    for doc_id, text in documents.select("doc_id", "text").collect():
        words = planted(doc_id, text)
        want[doc_id] = (doc_id, *report(words, plain_runs(words)))
    assert len(got) == len(want)
    assert {r.doc_id: tuple(r) for r in got} == want
    assert sum(r.n_runs > 0 for r in got) >= 5


def test_long_periods_and_very_long_texts(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(7_001)]
    texts = [
        " ".join((base * 5)[:30_000]),
        "same " * 60_000,
        "x" * 400_000,
        " ".join(base) + " end",
        " ".join(["a", "b", "c"] * 4),
        " ".join(["a", "b", "c"] * 4)[:-2],
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(rows).collect()}
    assert (got[0].start, got[0].length, got[0].period, got[0].exponent_milli) == (0, 30_000, 7_001, 4_285)
    assert got[0].collapsed_sha256 == hashlib.sha256(" ".join(base).encode()).hexdigest()
    assert (got[1].n_runs, got[1].length, got[1].period) == (1, 60_000, 1)
    assert got[1].collapsed_sha256 == hashlib.sha256(b"same").hexdigest()
    assert [got[k].n_runs for k in (2, 3, 4, 5)] == [0, 0, 1, 0]


def test_odd_rows(odd_docs, no_docs, documents):
    got = runs.periodic_runs(odd_docs).collect()
    short = [(i, t) for i, t in ODD_ROWS if len(t or "") < 10_000]
    for doc_id, text in short:
        words = split(text)
        assert (doc_id, *report(words, plain_runs(words))) in [tuple(r) for r in got]
    assert len(got) == len(ODD_ROWS)
    assert runs.periodic_runs(no_docs).count() == 0
    blank = [r for r in got if r.doc_id in (3, 4, 5)]
    assert [(r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in blank] == [(0, EMPTY, EMPTY)] * 3
    other = documents.withColumnsRenamed({"doc_id": "n_runs", "text": "start"})
    assert runs.periodic_runs(other, "n_runs", "start").count() == documents.count()


def test_batches_cut_anywhere_give_the_same(monkeypatch, documents):
    whole = sorted(map(tuple, runs.periodic_runs(documents.coalesce(1)).collect()))
    parts = sorted(map(tuple, runs.periodic_runs(documents.repartition(50)).collect()))
    assert whole == parts
