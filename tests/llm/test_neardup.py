import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from textorbit.llm import neardup, words
from textorbit.llm.arrow import whole_runs
from textorbit.llm.components import components


def plain_sets(rows):
    """Shingle sets by their definition, without hashes."""
    out = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def plain_components(rows):
    """Least id that links reach, for each row with an id."""
    sets = plain_sets(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(sets[j]) + len(s) - n):
                parent[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [None if doc is None else least[root(i)] if sets[i] else doc for i, (doc, _) in enumerate(rows)], sets


def as_rows(result):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in result.collect()), key=repr)


def wanted(rows):
    found, sets = plain_components(rows)
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, found, strict=True)), key=repr)


def test_documents_against_plain_sets(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert as_rows(neardup.near_duplicates(documents)) == wanted(rows)


def test_odd_rows(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = as_rows(neardup.near_duplicates(odd_docs))
    assert got == wanted(rows)
    assert {r[0]: r[2] for r in got}[9] == 8  # the long texts differ in one word


def test_empty_table(no_docs):
    result = neardup.near_duplicates(no_docs)
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result.count() == 0


def chain(n, step=3, size=100, start=0):
    """Texts that each share most of their shingles with the next one only."""
    return [(start + i, " ".join(f"t{start}w{k}" for k in range(i * step, i * step + size))) for i in range(n)]


def test_groups_too_large_for_one_task(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_DOCS", 8)
    rows = chain(60) + chain(12, step=5, start=1000) + chain(20, step=8, start=2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_rows(neardup.near_duplicates(docs))
    assert got == wanted(rows)
    assert sum(r[3] for r in got) == 2 + 20  # 8 new words in 100 leave 88 of 104 shingles, too few


def test_lists_reach_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    for distance in (0, 1, 12, neardup.DISTANCE):
        a = rng.integers(0, 1 << 16, neardup.SLOTS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(neardup.SLOTS, distance, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays(
            [pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["id", "mark"]
        )
        (out,) = neardup._lists(iter([batch]))
        keys = out.column(0).to_numpy().reshape(2, -1)
        assert set(keys[0]) & set(keys[1])


def test_signature_misses_are_rare():
    """The chance that two sets at the threshold differ in more slots than allowed."""
    from math import comb

    p = 1 - neardup.PERCENT / 100
    n = neardup.SLOTS
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(neardup.DISTANCE + 1, n + 1)) < 1e-5


def test_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_ROWS", 2)
    rows = chain(30) + chain(1, start=100) + [(200 + i, f"{chain(1, start=200)[0][1]} end{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(neardup.near_duplicates(docs)) == wanted(rows)


def test_whole_runs_cut_no_run():
    keys = [1, 1, 2, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2])], ["k"]) for i in range(0, 8, 2)]
    seen = [t.column(0).to_pylist() for t in whole_runs(iter(batches), 0)]
    assert [k for part in seen for k in part] == keys
    assert not any(set(a) & set(b) for a, b in zip(seen, seen[1:], strict=False))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7), (None, 3), (900, 500)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    want = {i: 0 for i in range(201)} | {500: 500, 501: 500, 900: 500}
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = (b"Some words\n and\tmore " * 50) + b"end"
    whole = words.word_hashes(text, lower=True)
    monkeypatch.setattr(words, "PIECE", 16)
    assert (words.word_hashes(text, lower=True) == whole).all()
    assert len(words.word_hashes(b"x" * 100)) == 1


def test_percent_sets_the_links_and_how_they_are_found(spark):
    from math import comb

    import pytest

    for percent, distance in ((85, 23), (80, None)):
        links = neardup.Links(percent)
        assert distance in (None, links.distance)
        assert links.distance // links.chunks <= 1
        p, n = 1 - percent / 100, neardup.SLOTS
        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(links.distance + 1, n + 1)) < 1e-5
    with pytest.raises(ValueError):
        neardup.Links(40)
    # 8 new words in 100 leave 88 of 104 shingles (0.846), 11 leave 85 of 107 (0.794)
    docs = spark.createDataFrame(chain(2, step=8) + chain(2, step=11, start=100), "doc_id long, text string")
    at = {p: {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=p).collect()} for p in (85, 80)}
    assert at == {85: {0: 0, 1: 1, 100: 100, 101: 101}, 80: {0: 0, 1: 0, 100: 100, 101: 101}}


def test_lists_reach_every_pair_at_80():
    links = neardup.Links(80)
    rng = np.random.default_rng(2)
    for distance in (1, 24, links.distance):
        a = rng.integers(0, 1 << 16, neardup.SLOTS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(neardup.SLOTS, distance, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays(
            [pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["id", "mark"]
        )
        (out,) = neardup._lists(iter([batch]), links)
        keys = out.column(0).to_numpy().reshape(2, -1)
        assert set(keys[0]) & set(keys[1])
