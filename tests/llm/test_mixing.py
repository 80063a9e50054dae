import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from textorbit.llm import mixing, plans


def shares(children, budget):
    """children: name -> (weight, capacity).  Whole tokens, siblings make up for shortages."""
    out, left = {}, dict(children)
    while left:
        heavy = sum(w for w, _ in left.values())
        full = {n for n, (w, c) in left.items() if c * heavy <= budget * w}
        if not full:
            out |= {n: budget * w // heavy for n, (w, _) in left.items()}
            break
        first = min(full, key=lambda n: (left[n][1] / left[n][0], n))
        out[first] = left.pop(first)[1]
        budget -= out[first]
    return out


def plain(rows, weights, budget, epochs, seed=7):
    """Copies by row: rows of (doc_id, (domain, lang, source), tokens)."""
    total = defaultdict(int)
    for _, leaf, tokens in rows:
        total[leaf] += tokens

    def weight(path):
        return weights.get("/".join(path), weights.get("*/" + path[-1], 1))

    granted = {(): budget}
    alive = {leaf: tokens for leaf, tokens in total.items() if all(weight(leaf[:d]) > 0 for d in range(1, 4))}
    for depth in range(1, 4):
        below = defaultdict(dict)
        for leaf, tokens in alive.items():
            path = leaf[:depth]
            w, c = below[path[:-1]].get(path, (weight(path), 0))
            below[path[:-1]][path] = (w, c + tokens * epochs)
        for parent, children in below.items():
            granted |= shares(children, granted.get(parent, 0))
    out = []
    for leaf in total:
        own = [(d, t) for d, place, t in rows if place == leaf]
        whole = granted.get(leaf, 0) // total[leaf] if total[leaf] else 0
        rest = granted.get(leaf, 0) - whole * total[leaf]
        rank = lambda d: hashlib.md5(f"{seed}:{whole}{'' if d is None else f':{d}'}".encode()).hexdigest()
        reached = 0
        for d, t in sorted(own, key=lambda x: (rank(x[0]), x[0] or 0, x[1])):
            reached += t
            out.append((d, leaf, t, whole + (rest > 0 and reached <= rest)))
    return sorted(out, key=repr)


def got(result):
    return sorted(((r.doc_id, (r.domain, r.lang, r.source), r.tokens, r.copies) for r in result.collect()), key=repr)


def test_documents(documents):
    leaves = plans.with_leaves(documents)
    rows = [(r.doc_id, (r.domain, r.lang, r.source), r.tokens) for r in leaves.collect()]
    budget = sum(t for *_, t in rows) * 3 // 5
    result = mixing.mix(leaves, plans.TREE, budget=F.expr("sum(total) * 3 div 5"))
    assert got(result) == plain(rows, plans.TREE, budget, 2)


def test_many_buckets_choose_the_same(documents, monkeypatch):
    leaves = plans.with_leaves(documents).withColumn("source", F.lit("one"))
    rows = [(r.doc_id, (r.domain, r.lang, r.source), r.tokens) for r in leaves.collect()]
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    result = mixing.mix(leaves, {"web": 3}, budget=F.expr("sum(total) div 3"), epochs=1)
    assert got(result) == plain(rows, {"web": 3}, sum(t for *_, t in rows) // 3, 1)


def test_siblings_before_ancestors(spark):
    rows = [(i, "a", "x", "s", 10) for i in range(2)]  # a/x has 20 of the 40 it should give
    rows += [(10 + i, "a", "y", "s", 10) for i in range(20)]
    rows += [(100 + i, "b", "x", "s", 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    result = mixing.mix(docs, {}, budget=F.lit(160), epochs=1)
    taken = defaultdict(int)
    for _, leaf, tokens, copies in got(result):
        taken[leaf[:2]] += tokens * copies
    assert taken == {("a", "x"): 20, ("a", "y"): 60, ("b", "x"): 80}


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (1, None, None, None, 5), (None, "a", "", "s", None), (2, "a", "x", "s", -3)]
    rows += [(3, "a", "x", "t", 0), (4, "out", "x", "s", 9), (5, "a", "x", "t", 1 << 40)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    docs = docs.selectExpr("*", "1 as copies", "2 as total", "3 as budget", "4 as bucket", "5 as rest")
    plain_rows = [(d, tuple(x or "" for x in leaf), max(t or 0, 0)) for d, *leaf, t in rows]
    result = mixing.mix(docs, {"out": 0}, epochs=3)
    assert got(result) == plain(plain_rows, {"out": 0}, sum(t for *_, t in plain_rows), 3)
    assert mixing.mix(docs.where("false"), {}).count() == 0


def test_nothing_is_granted_for_what_is_left_out(spark):
    """Web has 100 live tokens and 900 that weigh nothing; forum makes up for what web lacks."""
    leaves = {"web/en": 100, "web/de": 900, "forum/en": 1_000}
    rows = [(i, *place.split("/"), "s", 10) for i, place in enumerate(p for p, n in leaves.items() for _ in range(n // 10))]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    weights = {"web/de": 0}
    taken = mixing.mix(docs, weights, budget=F.lit(1_000), epochs=1)
    by_leaf = {(r.domain, r.lang): r.n for r in taken.groupBy("domain", "lang").agg(F.sum(F.expr("tokens * copies")).alias("n")).collect()}
    assert by_leaf == {("web", "en"): 100, ("web", "de"): 0, ("forum", "en"): 900}
    plain_rows = [(i, (d, lang, s), t) for i, d, lang, s, t in rows]
    assert got(taken) == plain(plain_rows, weights, 1_000, 1)
    for left_out in ({"web": 0}, {"*/de": 0, "forum": 3}, {"web/de/s": 0}, {"*/s": 0}):
        assert got(mixing.mix(docs, left_out, budget=F.lit(1_500), epochs=1)) == plain(plain_rows, left_out, 1_500, 1)
