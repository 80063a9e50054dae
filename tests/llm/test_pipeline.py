"""All stages against plain Python, and the queries against their SQL."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from textorbit.llm import plans

from .conftest import PROSE
from .test_mixing import plain as plain_mix
from .test_neardup import plain_components
from .test_quality import plain_kept

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert "pipeline" in names


def test_stages_one_by_one(spark, documents, tmp_path):
    docs, columns = documents, documents.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept.append([tuple(r) for r in docs.select("doc_id", "text").collect()])
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    good = [r for r in rows if plain_kept(r[1])]
    assert Counter(kept[0]) == Counter(good)
    found, _ = plain_components(good)
    alone = [r for r, c in zip(good, found, strict=True) if r[0] == c]
    assert Counter(kept[1]) == Counter(alone)
    ids = {r[0] for r in alone}
    leaves = [r for r in plans.with_leaves(documents).collect() if r.doc_id in ids]
    leaves = [(r.doc_id, (r.domain, r.lang, r.source), r.tokens) for r in leaves]
    copies = {d: n for d, _, _, n in plain_mix(leaves, plans.TREE, sum(x[2] for x in leaves), 2)}
    assert Counter(d for d, _ in kept[2]) == Counter({d: n for d, n in copies.items() if n})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(d for d, _ in kept[2])
    whole = {d for d, *_ in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert whole == {r.doc_id for r in pieces}


@pytest.mark.parametrize("name", ["op2_packing", "op5_quality", "op6_token_counts", "op7_token_output", "op13_periodic_runs"])
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_stages_take_odd_rows(spark, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "null as lang", "'s' as source", "0L as n_chars", "kept", "copies")
    docs = docs.withColumn("lang", docs.lang.cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        last = stage(spark, docs, SF)
        assert last.count() > 0
        docs = last if last.columns == docs.columns else docs


def words_from(at, n=100):
    return " ".join(f"w{k}" for k in range(at, at + n))


def test_near_dedup_decides_by_row(spark):
    rows = [(1, words_from(0)), (1, words_from(0)), (None, words_from(0))]  # a repeat, and a copy without an id
    rows += [(2, words_from(1000)), (3, words_from(2000, 101)), (3, words_from(1000, 101)), (0, words_from(3000))]
    rows += [(None, words_from(4000)), (None, words_from(4000)), (None, words_from(5000))]
    rows += [(7, None), (7, None), (7, ""), (8, None), (None, " "), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    want = [rows[i] for i in (0, 3, 4, 6, 7, 9, 10, 12, 13, 14)]
    assert kept == Counter(want)


def test_mixing_decides_by_row(spark):
    rows = [(i, words_from(i), "en", "src0") for i in range(3)]
    rows += [(7, words_from(100 + i, 80 + i), "en", "src5") for i in range(20)]
    rows += [(None, words_from(900 + i), "en", "src5") for i in range(20)] + [(None, words_from(0), None, "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    assert set(got) <= set(rows)
    assert Counter(got)[rows[-1]] == 2
    size = lambda some: sum(-(-len(r[1]) // 4) for r in some)
    forum = [r for r in rows if r[3] == "src5"]
    taken = [r for r in got if r[3] == "src5"]
    assert {r[0] for r in taken} == {7, None}
    budget = size(rows) - 2 * size(rows[:3] + rows[-1:])
    assert budget - max(size([r]) for r in forum) < size(taken) <= budget < size(forum)


def test_rows_without_ids_reach_the_windows(spark):
    rows = [(None, PROSE), (4, " ".join(PROSE.split()[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "'en' as lang", "'src0' as source")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {None, 4}


def test_stages_keep_columns_named_like_their_own(spark):
    rows = [(i, words_from(200 * i), "en", "src0") for i in range(4)] + [(9, words_from(0), "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["pipeline_row", "Mixed_Copies", "mixed_copy", "mixed_copies_", "tokens", "domain", "copies", "row"]
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        columns, docs = docs.columns, stage(spark, docs, SF)
        assert docs.columns == columns
    for r in docs.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert {r.doc_id for r in docs.collect()} == {0, 1, 2, 3}


def test_near_dedup_at_another_similarity(spark):
    """Of 96 shingles each, two documents share 88 (of 104 in all: 84.6 per cent)."""
    rows = [(1, words_from(0)), (2, words_from(8)), (3, words_from(500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda **k: sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF, **k).collect())
    assert kept() == [1, 2, 3]
    assert kept(percent=80) == [1, 3]


@pytest.mark.parametrize("missing", ["sentencepiece", "public_tokenizers", "corpus_pipeline", "textorbit.llm"])
def test_the_rest_imports_without_this_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print('embed' in e.queries(), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert done.stdout.split() == ["True", "False"], done.stderr
