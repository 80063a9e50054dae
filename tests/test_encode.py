import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textorbit.operators import calls, cells, encode, retrieval


def test_noop(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "text string")
    assert [len(r["embedding"]) for r in encode.embed(df, noop=True).collect()] == [384] * 3
    empty = encode.embed(df.limit(0), noop=True)
    assert empty.count() == 0 and empty.columns == ["text", "embedding"]
    rows = spark.range(8).withColumn("text", F.lit("x"))
    for step in (None, 3):
        got = encode.embed_sparse(rows, noop_order=["id"], noop_step=step).orderBy("id").collect()
        assert [tuple(s) for s in got[0]["sparse"]] == [(0, 1.0), (100, 0.5), (200, 0.25)]
        assert [tuple(s) for s in got[7]["sparse"]] == [(7, 1.0), (107, 0.5), (207, 0.25)]


def test_null_policies(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, text string")
    for encoder in (None, encode.CallableEncoder("ones", 3, "dense", lambda: lambda texts: [[1.0, 0.0, 0.0]] * len(texts))):
        kept = {r["id"]: r["embedding"] for r in encode.embed(df, encoder=encoder).collect()}
        assert kept[2] is None and kept[1] is not None
        assert encode.embed(df, encoder=encoder, null_policy="drop").count() == 2
    with pytest.raises(ValueError):
        encode.embed(df, null_policy="other")


def test_user_models_run_in_workers(spark):
    def load():
        return lambda texts: [[float(len(t)), 3.0] for t in texts]

    df = spark.createDataFrame([("abcd",), ("x",)], "text string")
    rows = encode.embed(df, encoder=encode.CallableEncoder("lengths", 2, "dense", load), normalize=True)
    got = {r["text"]: r["embedding"] for r in rows.collect()}
    assert got["abcd"] == pytest.approx([0.8, 0.6])
    scores = encode.CallableEncoder("c", 0, "classifier", lambda: lambda ts: [[{"score": 1.0, "label": "l"}] for _ in ts])
    assert encode.predict(df, scores).first()["predictions"][0]["label"] == "l"
    pairs = spark.createDataFrame([(["a", "b"],), (["a"],), (None,)], "texts array<string>")
    sizes = encode.CallableEncoder("p", 0, "classifier", lambda: lambda ts: [[{"score": float(len(t)), "label": "n"}] for t in ts])
    got = [(r["error_code"], r["predictions"] and r["predictions"][0]["score"]) for r in encode.predict_pair(pairs, sizes).collect()]
    assert got == [(None, 2.0), ("INVALID_ARGUMENT", None), ("INVALID_ARGUMENT", None)]


def test_two_models_of_one_name_do_not_mix(spark):
    df = spark.createDataFrame([(9007199254740993, "a"), (None, "b")], "key long, text string").coalesce(1)
    for value in (1.0, 7.0):
        model = encode.CallableEncoder("same", 1, "dense", lambda value=value: lambda texts: [[value]] * len(texts))
        got = encode.embed(df, encoder=model, normalize=False).collect()
        assert [(r["key"], r["embedding"]) for r in got] == [(9007199254740993, [value]), (None, [value])]


def test_limits_of_a_model(spark):
    model = encode.CallableEncoder(
        "echo", 2, "dense", lambda: lambda ts: [[float(len(t)), float(len(ts))] for t in ts], max_input_length=3, max_batch_tokens=4,
        truncate=True,
    )
    texts = ["one two three four", "a b", "c d", "e", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = [tuple(r["embedding"]) for r in encode.embed(df, encoder=model, normalize=False).orderBy("id").collect()]
    assert got == [(13.0, 1.0), (3.0, 2.0), (3.0, 2.0), (1.0, 2.0), (0.0, 2.0)]


def error_of(df):
    with pytest.raises(Exception) as found:
        df.collect()
    return str(found.value)


def test_long_texts_are_errors_unless_they_may_be_cut(spark):
    model = encode.CallableEncoder("strict", 1, "dense", lambda: lambda ts: [[1.0]] * len(ts), max_input_length=3)
    df = spark.createDataFrame([(0, "one two three"), (1, "one two three four")], "id int, text string")
    assert encode.embed(df.filter("id = 0"), encoder=model).count() == 1
    assert "INPUT_TOO_LONG" in error_of(encode.embed(df, encoder=model))


@pytest.mark.parametrize("shift", [1, -1])
def test_a_wrong_number_of_results_is_an_error(spark, shift):
    """Of two batches the first has one result too many or too few; rows must not shift."""
    many = lambda ts: [[float(len(t))] for t in ts] + [[0.0]] * shift if shift > 0 else [[float(len(t))] for t in ts][:shift]
    model = encode.CallableEncoder(f"odd{shift}", 1, "dense", lambda: many, max_batch_tokens=2)
    df = spark.createDataFrame(list(enumerate(["a b", "c d", "e f"])), "id int, text string").coalesce(1)
    assert "results for" in error_of(encode.embed(df, encoder=model))

    class Plain:
        name, dim, kind, max_input_length = "plain", 1, "dense", 9

        def columns(self, text):
            return None

        def encode_batch(self, texts):
            return many(texts)

    assert "results for" in error_of(encode.embed(df, encoder=Plain()))


def test_cut_text_keeps_the_wanted_end():
    text = "One, two; three four!"
    assert calls.cut_text(text, 2, False) == "One, two"
    assert calls.cut_text(text, 2, True) == "three four!"
    assert calls.cut_text(text, 4, True) == text
    assert calls.cut_text(text, 0, True) == calls.cut_text(text, 0, False) == ""


def test_requests_with_a_model(spark):
    """Each request cut, refused or scaled by its own options; the model sees the cut texts."""
    rows = [(0, "one two three", None, None), (1, "one two three", True, "left"), (2, "one two three", True, "right"), (3, "one", None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, truncate boolean, direction string")
    sizes = encode.CallableEncoder("sizes", 2, "dense", lambda: lambda ts: [[float(len(t)), 3.0] for t in ts], max_input_length=2)
    found = {r["id"]: r for r in calls.embed_requests(df, {}, 512, sizes, normalize=False).collect()}
    assert [found[i]["error_code"] for i in range(5)] == ["INPUT_TOO_LONG", None, None, None, None]
    assert [found[i]["embedding"] for i in range(5)] == [None, [9.0, 3.0], [7.0, 3.0], [3.0, 3.0], None]
    assert found[0]["metadata"]["compute_tokens"] == 3 and found[4]["metadata"] is None
    scaled = calls.embed_requests(df.filter("id = 3"), {}, 512, sizes, dimensions=1).first()
    assert scaled["embedding"] == [1.0]
    labels = encode.CallableEncoder(
        "labels", 2, "classifier", lambda: lambda ts: [[{"score": 0.0, "label": "a"}, {"score": float(len(t)), "label": "b"}] for t in ts]
    )
    raw = calls.predict_requests(df.filter("id = 3"), labels, 5, raw_scores=True).first()["predictions"]
    soft = calls.predict_requests(df.filter("id = 3"), labels, 5).first()["predictions"]
    assert [p["score"] for p in raw] == [0.0, 3.0] and sum(p["score"] for p in soft) == pytest.approx(1)
    assert soft[1]["score"] == pytest.approx(np.exp(3) / (1 + np.exp(3)))


def test_pairs_share_the_limit(spark):
    rows = [(0, ["a b c d", "e"]), (1, ["a", "b c d e"]), (2, ["a b c", "d e f"]), (3, ["a", None]), (4, ["a"]), (5, None)]
    df = spark.createDataFrame(rows, "id int, texts array<string>")
    echo = encode.CallableEncoder("echo-pair", 0, "classifier", lambda: lambda ts: [[{"score": 0.0, "label": "|".join(t)}] for t in ts])
    got = {r["id"]: r for r in calls.predict_pair_requests(df, echo, 4, truncate=True).collect()}
    assert [got[i]["predictions"][0]["label"] for i in range(3)] == ["a b c|e", "a|b c d", "a b|d e"]
    assert [got[i]["error_code"] for i in range(6)] == [None] * 3 + ["INVALID_ARGUMENT"] * 3
    strict = {r["id"]: r["error_code"] for r in calls.predict_pair_requests(df, echo, 4).collect()}
    assert [strict[i] for i in range(3)] == ["INPUT_TOO_LONG"] * 3


def test_rerank_requests_of_a_model(spark):
    rows = [(1, 0, "q", "aa"), (1, 1, "q", "aaaa"), (1, 2, "q", "aa"), (2, 0, "q", "b c d"), (2, 1, "q", "b"), (3, 0, "q", None)]
    df = spark.createDataFrame(rows, "query_id long, index long, query string, text string")
    model = encode.CallableEncoder("size-rank", 1, "reranker", lambda: lambda ts: [float(len(t)) for _, t in ts])
    got = sorted(map(tuple, calls.rerank_requests(df, 3, model, raw_scores=True, return_text=True).collect()), key=str)
    assert got == [
        (1, 1, 1, 4.0, "aaaa", None), (1, 2, 0, 2.0, "aa", None), (1, 3, 2, 2.0, "aa", None),
        (2, None, None, None, None, "INPUT_TOO_LONG"), (3, None, None, None, None, "INVALID_ARGUMENT"),
    ]
    cut = calls.rerank_requests(df.filter("query_id = 2"), 3, model, truncate=True).orderBy("rank").collect()
    assert [(r["index"], round(r["score"], 6)) for r in cut] == [(0, round(1 / (1 + np.exp(-3)), 6)), (1, round(1 / (1 + np.exp(-1)), 6))]


def test_vectors_are_unit_and_equally_wide_and_related_texts_closer(spark):
    texts = ["the red boat on the bay", "a red boat in the bay", "tax law of the province"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vectors = [np.array(r["embedding"]) for r in encode.embed(df).orderBy("id").collect()]
    assert {len(v) for v in vectors} == {64}
    assert [np.linalg.norm(v) for v in vectors] == pytest.approx([1] * 3, abs=1e-6)
    assert vectors[0] @ vectors[1] > vectors[0] @ vectors[2]


def test_sparse_values(spark):
    df = spark.createDataFrame([(0, "a a b"), (1, "b c"), (2, "")], "id int, text string")
    got = {r["id"]: {s["index"]: s["value"] for s in r["sparse"]} for r in encode.embed_sparse(df).collect()}
    assert sorted(got[0].values()) == pytest.approx([np.log1p(1), np.log1p(2)])
    assert len(set(got[0]) & set(got[1])) == 1 and got[2] == {}
    assert all(0 <= i < 30522 for i in got[0])


def test_predict_sums_to_one_and_raw_does_not(spark):
    df = spark.createDataFrame([("some text",)], "text string")
    weights = {"a": [0.5] * 64, "b": [-0.5] * 64}
    p = encode.predict(df, encode.LinearClassifier(weights)).first()["predictions"]
    assert sum(x["score"] for x in p) == pytest.approx(1)
    raw = encode.predict(df, encode.LinearClassifier(weights, raw_scores=True)).first()["predictions"]
    assert raw[0]["score"] == pytest.approx(-raw[1]["score"])


def test_rerank_orders_by_score_then_index(spark):
    rows = [(1, i, "red boat", t) for i, t in enumerate(["red car", "red boat", "blue sky", "red boat"])]
    df = spark.createDataFrame(rows, "query_id int, index long, query string, text string")
    got = encode.rerank(df, return_text=True).orderBy("rank").collect()
    assert [r["index"] for r in got[:2]] == [1, 3] and got[0]["text"] == "red boat"
    assert [r["rank"] for r in got] == [1, 2, 3, 4]


def test_tokenize_and_decode(spark):
    df = spark.createDataFrame([(1, "Der Bär, the BEAR!"), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: r["tokens"] for r in encode.tokenize(df).collect()}
    assert [t["text"] for t in rows[1]] == ["<s>", "der", "bär", "the", "bear", "</s>"]
    assert [(t["start"], t["stop"]) for t in rows[1][1:-1]] == [(0, 3), (4, 7), (9, 12), (13, 17)]
    assert rows[2] is None and len(rows[3]) == 2
    vocab = encode.vocabulary(df)
    ids = encode.tokenize(df).select("id", F.transform("tokens", lambda t: t["id"]).alias("ids"))
    for skip, want in ((True, "der bär the bear"), (False, "<s> der bär the bear </s>")):
        assert encode.decode(ids, vocab, skip_special_tokens=skip).filter("id = 1").first()["text"] == want


def test_token_offsets_point_into_the_lower_cased_text(spark):
    texts = ["", "...", "ab", "  ab", "ab--", "x😀y z", "Ä 12,Ü" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = {r["text"]: r["tokens"] for r in encode.tokenize(df, offsets=False).collect()}
    for r in encode.tokenize(df).collect():
        if r["text"] is None:
            assert r["tokens"] is None and plain[None] is None
            continue
        inner = r["tokens"][1:-1]
        assert "".join(t["text"] for t in inner) == "".join(c for c in r["text"].lower() if c.isalnum())
        assert all(r["text"].lower()[t["start"] : t["stop"]] == t["text"] for t in inner)
        assert [(t["id"], t["text"], t["special"]) for t in plain[r["text"]]] == [(t["id"], t["text"], t["special"]) for t in r["tokens"]]


def test_raw_vectors_without_normalizing(spark):
    df = spark.createDataFrame([("a a b",)], "text string")
    assert sum(abs(x) for x in encode.embed(df, normalize=False).first()["embedding"]) in (1.0, 3.0)


def test_decode_with_a_joined_vocabulary(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "")], "id int, text string")
    ids = encode.tokenize(df).select("id", F.transform("tokens", lambda t: t["id"]).alias("ids"))
    got = {r["id"]: r["text"] for r in encode.decode(ids, encode.vocabulary(df), key="id", inline_bytes=0).collect()}
    assert got == {1: "one two two", 2: ""}
    full = encode.decode(ids, encode.vocabulary(df), key="id", skip_special_tokens=False, inline_bytes=0)
    assert {r["text"] for r in full.collect()} == {"<s> one two two </s>", "<s> </s>"}


def test_info_and_smoke(spark):
    def broken():
        raise OSError("no weights")

    good = encode.CallableEncoder("good", 2, "dense", lambda: lambda ts: [[0.0, 1.0]] * len(ts))
    bad = encode.CallableEncoder("bad", 2, "classifier", broken)
    info = {r["model_id"]: r for r in encode.encoder_info(spark, [good, bad]).collect()}
    assert len(info["good"].asDict()) == 13 and info["bad"]["model_type"] == "classifier"
    smoke = {r["name"]: (r["status"], r["error"]) for r in encode.encoder_smoke(spark, [good, bad]).collect()}
    assert smoke == {"good": ("verified", None), "bad": ("failed", "OSError: no weights")}


# --- retrieval against brute force ---------------------------------------------------


def vectors(n, dim=8, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if copies:
        v[-copies:] = v[0]
    return v.astype(np.float32)


def frame(spark, v, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, embedding array<float>")


@pytest.mark.parametrize("query_bytes", [1 << 20, 1])
def test_top_k_sent_and_in_blocks(spark, query_bytes, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    q, c = vectors(30, seed=2), vectors(100, seed=3, copies=20)
    c[5] = 0
    got = retrieval.top_k(frame(spark, q, "query_id"), frame(spark, c, "corpus_id"), 4, 8, query_bytes=query_bytes)
    got = {(r["query_id"], r["rank"]): (r["corpus_id"], r["score"]) for r in got.collect()}
    q64, c64 = q.astype(float), c.astype(float)
    for i in range(30):
        norms = np.sqrt((q64[i] ** 2).sum() * (c64**2).sum(1))
        s = np.divide(c64 @ q64[i], norms, out=np.full(100, -9.0), where=norms > 0)
        s = np.floor(s * 1e6 + 0.5) / 1e6
        order = sorted(range(100), key=lambda j: (-s[j], j))[:4]
        assert [got[(i, r + 1)][0] for r in range(4)] == order


@pytest.mark.parametrize("pivots, block", [(1, 10_000), (20, 30), (256, 7)])
def test_top_k_of_all_rows_among_clusters(spark, monkeypatch, pivots, block):
    """Cells that are skipped hold nothing; rows of clusters, copies, zeros and nulls among them."""
    monkeypatch.setattr(retrieval, "PIVOTS", pivots)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    centres = vectors(12, seed=5)
    v = np.vstack([centres[rng.integers(0, 12, 240)] + rng.normal(scale=0.05, size=(240, 8)), np.zeros((2, 8)), centres, centres]).astype(np.float32)
    both = [frame(spark, v, n).unionByName(spark.createDataFrame([(999, None)], f"{n} long, embedding array<float>")) for n in ("query_id", "corpus_id")]
    hits = [sorted(map(tuple, retrieval.top_k(*both, 5, 8, query_bytes=size).collect())) for size in (1 << 30, 1)]
    assert hits[0] == hits[1] and len(hits[0]) == 5 * (len(v) - 2)
    empty = both[1].filter("corpus_id = 999")
    assert retrieval.top_k(both[0], empty, 5, 8, query_bytes=1).count() == 0


def test_top_k_refuses_another_width_and_can_leave_out_itself(spark):
    v = vectors(20, seed=9)
    df = frame(spark, v, "query_id")
    corpus = frame(spark, v, "corpus_id")
    got = retrieval.top_k(df, corpus, 3, 8, exclude_self=True).collect()
    assert len(got) == 60 and all(r["query_id"] != r["corpus_id"] for r in got)
    odd = corpus.unionByName(spark.createDataFrame([(99, [1.0, 2.0])], "corpus_id long, embedding array<float>"))
    for size in (1 << 20, 1):
        with pytest.raises(Exception, match="not 8 wide"):
            retrieval.top_k(df, odd, 3, 8, query_bytes=size).collect()


def test_candidates_are_exact_pairs_and_find_most(spark):
    rng = np.random.default_rng(12)
    base = vectors(400, dim=16, seed=11)
    near = base[:150] + rng.normal(scale=0.05, size=(150, 16))
    v = np.vstack([base, near / np.linalg.norm(near, axis=1, keepdims=True), np.repeat(base[:1], 30, 0)]).astype(np.float32)
    df = frame(spark, v, "id")
    pairs = lambda x: {(r["id_a"], r["id_b"], r["copies_a"], r["copies_b"], r["score"]) for r in x.collect()}
    exact = pairs(retrieval.similarity_join(df, 0.9, "id"))
    found = pairs(retrieval.similarity_candidates(df, 0.9, "id"))
    assert found <= exact and len(found) >= 0.9 * len(exact) > 100
    assert pairs(retrieval.similarity_candidates(df, 0.9, "id", bucket_rows=1000, block_rows=40)) == exact
    assert retrieval.similarity_candidates(df.limit(0), 0.9, "id").count() == 0


@pytest.mark.parametrize("pivots, block", [(1, 7), (12, 10), (12, 4096)])
@pytest.mark.parametrize("threshold", [0.5, 0.95])
def test_similarity_join_is_exact_with_copies(spark, pivots, block, threshold):
    v = vectors(150, dim=4, seed=4, copies=50)
    df = frame(spark, v, "id")
    got = retrieval.similarity_join(df, threshold, "id", pivots=pivots, block_rows=block).collect()
    dots = v.astype(float) @ v.astype(float).T
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if dots[i, j] >= threshold}
    assert {(r["id_a"], r["id_b"]) for r in got} == want
    assert len(got) == len(want)
    assert all((r["copies_a"], r["copies_b"]) == (51 if r["id_a"] == 0 else 1, 1) for r in got)


def _clustered(seed: int = 11) -> np.ndarray:
    """120 bunches of 20 near copies, spread at random, and 100 directions that are alone."""
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(size=(120, 6)), 20, 0)
    v = np.vstack([centres + rng.normal(size=centres.shape) * 0.03, rng.normal(size=(100, 6))])
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("sent_bytes", [0, 16 << 20])
@pytest.mark.parametrize("threshold", [0.9, 0.99])
def test_similarity_join_by_split_cells(spark, sent_bytes, threshold):
    v = _clustered()
    df = frame(spark, v, "id")
    got = retrieval.similarity_join(df, threshold, "id", pivots=8, block_rows=60, sent_bytes=sent_bytes).collect()
    dots = v.astype(float) @ v.astype(float).T
    i, j = np.nonzero(np.triu(dots >= threshold, 1))
    assert sorted((r["id_a"], r["id_b"]) for r in got) == sorted(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("sent_bytes", [0, 16 << 20])
def test_cells_are_split_where_it_saves_work(spark, sent_bytes):
    v = _clustered()
    rows = frame(spark, v, "id").select("id", F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("copies"))
    for angle, share in ((0.05, 0.1), (3.2, 1)):
        placed = cells.metric_cells(rows, 6, angle, 60, 8, sent_bytes)
        sizes = placed.groupBy("cell").agg(F.count_if("home").alias("home"), F.count("*").alias("n")).collect()
        assert sum(r["home"] for r in sizes) == len(v)
        assert placed.where("home").select("id").distinct().count() == len(v)
        assert sum(r["home"] * r["n"] for r in sizes) <= share * len(v) ** 2
    assert len(sizes) == 1  # all within reach of all: no split saves anything


def test_similarity_links_are_the_pairs_counted(spark):
    v = np.vstack([_clustered(), _clustered()[:5]])
    df = frame(spark, v, "id")
    pairs = [r.asDict() for r in retrieval.similarity_join(df, 0.95, "id", pivots=8, block_rows=60).collect()]
    want = {}
    for r in pairs:
        for a, b in (("a", "b"), ("b", "a")):
            want.setdefault((r[f"id_{a}"], r[f"copies_{a}"]), []).append((-r["score"], r[f"id_{b}"], r[f"copies_{b}"]))
    got = retrieval.similarity_links(df, 0.95, "id", pivots=8, block_rows=60).collect()
    assert {(r["id"], r["copies"]): (r["links"], r["linked_copies"], r["best_id"], r["score"]) for r in got} == {
        k: (len(x), sum(c for *_, c in x), min(x)[1], -min(x)[0]) for k, x in want.items()
    }
    assert len(got) == len(want)
    assert retrieval.similarity_links(df.limit(0), 0.95, "id").count() == 0


def test_nearest_labelled_breaks_ties_by_label(spark):
    v = vectors(3, seed=6)
    df = frame(spark, np.vstack([v[:1], v[:1], v[1:2]]), "corpus_id").withColumn("label", F.lit(3) - F.col("corpus_id").cast("int"))
    got = retrieval.nearest_labelled(frame(spark, v[:1], "query_id"), df, 2, 8).first()
    assert (got["label"], got["votes"], got["score"]) == (2, 1, 0.5)


def test_random_pairs_of_sparse_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [(t, float(rng.randrange(1, 5))) for t in sorted(rng.sample(range(20), rng.randrange(8)))]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, sparse array<struct<index:bigint,value:float>>")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "id_a long, id_b long")
    by_id = {i: dict(p) for i, p in rows}
    for r in retrieval.sparse_pairs(pairs, df, df, "id").collect():
        a, b = by_id[r["id_a"]], by_id[r["id_b"]]
        assert r["overlap"] == len(a.keys() & b.keys())
        assert r["dot"] == pytest.approx(sum(a[t] * b[t] for t in a.keys() & b.keys()))


def test_tokens_of_few_texts_at_a_time(spark, monkeypatch):
    texts = ["ä b", None, "", "c" * 50, "d e", "f"] * 3
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts)}).slice(1)
    monkeypatch.setattr(encode, "TOKENIZED_BYTES", 8)
    pieces = list(encode._pieces(whole, "text"))
    assert [t for p in pieces for t in p["text"].to_pylist()] == texts[1:]
    assert len(pieces) > 6 and all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= 8 for p in pieces)
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [None if r["tokens"] is None else [t["text"] for t in r["tokens"]] for r in encode.tokenize(df).collect()]
    assert got[:6] == [["<s>", "ä", "b", "</s>"], None, ["<s>", "</s>"], ["<s>", "c" * 50, "</s>"], ["<s>", "d", "e", "</s>"], ["<s>", "f", "</s>"]]


def test_similarity_join_in_tiles(spark, monkeypatch):
    df = frame(spark, vectors(90, dim=4, seed=6), "id")
    whole = sorted(map(tuple, retrieval.similarity_join(df, 0.5, "id").collect()))
    monkeypatch.setattr(retrieval, "MET_CELLS", 200)
    assert sorted(map(tuple, retrieval.similarity_join(df, 0.5, "id").collect())) == whole and len(whole) > 100


@pytest.mark.parametrize("lengths", [(1, 1), (0.2, 3)])
@pytest.mark.parametrize("threshold", [0.95, 0.4, -0.1])
def test_blocks_are_compared_where_rows_are_in_reach(monkeypatch, lengths, threshold):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    v = middles[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 8))
    v *= rng.uniform(*lengths, (1500, 1)) / np.sqrt((v**2).sum(1))[:, None]
    v[700], v[701:703] = 0, v[703]
    monkeypatch.setattr(retrieval, "_SIDE", 37)
    shares = list(retrieval._reached(v[:1000], v[500:], threshold))
    assert sorted(np.concatenate([a for a, _ in shares])) == list(range(1000))
    if (threshold, lengths) == (0.95, (1, 1)):
        assert sum(len(a) * len(b) for a, b in shares) < 1000 * 1000 / 3
    table = lambda rows, first: pa.table({"id": np.arange(first, first + len(rows)), "vec": pa.array(list(rows))})
    for theirs, first, same in ((v[500:], 2000, False), (v[:1000], 0, True)):
        found = retrieval._met(table(v[:1000], 0), table(theirs, first), same, 8, threshold)
        dots = np.einsum("ad,bd->ab", v[:1000], theirs)
        near = dots >= threshold
        sure = np.abs(dots - threshold) > 1e-12
        got = np.zeros_like(near)
        for a, b, score in found:
            assert not got[a, b].any() and np.abs(score - dots[a, b]).max() < 1e-6
            got[a, b] = True
        assert ((got == (np.triu(near, 1) if same else near)) | ~sure).all() and got.any()


@pytest.mark.parametrize("held", [7, 40, 1 << 16])
def test_top_k_sends_a_query_once_to_the_rows_a_task_holds(spark, monkeypatch, held):
    v = vectors(300, dim=8, seed=13)
    v[7] = v[8] = v[9]
    both = [frame(spark, v, n) for n in ("query_id", "corpus_id")]
    want = sorted(map(tuple, retrieval.top_k(*both, 4, 8, exclude_self=True).collect()))
    monkeypatch.setattr(retrieval, "HELD_ROWS", held)
    monkeypatch.setattr(retrieval, "PIVOTS", 30)
    assert sorted(map(tuple, retrieval.top_k(*both, 4, 8, query_bytes=1, exclude_self=True).collect())) == want


def test_cells_share_bins():
    firsts, parts = retrieval._bins([0, 3, 4, 2, 25, 0, 5, 5, 1], 10)
    assert parts == [0, 1, 1, 1, 3, 0, 1, 1, 1]
    assert firsts[1:5] == [0, 0, 0, 1] and firsts[6:] == [4, 4, 5]


def test_blocks_meet_once(spark):
    """A row is sent out once for each block that its own meets, also to its own block."""
    rows = spark.createDataFrame([(n, n, 3, 2) for n in range(5)], "id long, block int, own int, others int")
    met = retrieval._to_blocks(rows.withColumn("cell", F.lit(7)), ["cell"], "own", "others").collect()
    pairs = {(lo, hi) for lo in range(3) for hi in range(lo, 5)}
    assert sorted((r["lo"], r["hi"], r["block"]) for r in met) == sorted((*p, b) for p in pairs for b in set(p))


@pytest.mark.parametrize("name", ["similarity_candidates", "similarity_join"])
def test_vectors_are_dealt_once_and_pairs_not_again(spark, name):
    """The comparison is the last step: a pair found in many buckets is given out by the first of them."""
    v = np.vstack([_clustered()[:400], _clustered()[:3]])
    df = frame(spark, v, "id")
    found = getattr(retrieval, name)(df, 0.95, "id", block_rows=5)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.startswith("FlatMapGroupsInArrow")
    pairs = [(r["id_a"], r["id_b"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) > 1000
    dots = v[:400].astype(float) @ v[:400].astype(float).T
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(dots >= 0.95, 1))), strict=True))
    assert set(pairs) <= want and len(pairs) >= 0.9 * len(want)


def test_pairs_near_the_threshold_are_decided_in_double_precision():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = pa.table({"id": np.arange(300), "vec": pa.array(v.tolist(), pa.list_(pa.float32()))})
    dots = np.einsum("nd,md->nm", v.astype(float), v.astype(float))
    for threshold in np.sort(dots[np.triu_indices(300, 1)])[[40000, 44000, 44800]].tolist():
        found = list(retrieval._met(rows, rows, True, 16, threshold))
        got = {(i, j) for a, b, _ in found for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        sure = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(dots >= threshold + 1e-14, 1))), strict=True)}
        assert sure <= got and len(got) <= len(sure) + 1
