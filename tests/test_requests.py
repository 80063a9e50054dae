import pytest
from pyspark.sql import functions as F

from textorbit.functions import formats as fm
from textorbit.functions import text as tx
from textorbit.functions import vectors as vec
from textorbit.operators import batch, requests


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_source_takes_first_column_and_refuses_other_types(spark):
    df = spark.createDataFrame([("a", 1)], "t string, k int")
    assert requests.text_source(df).collect() == [(1, "a")]
    with pytest.raises(TypeError, match="INVALID_ARGUMENT"):
        requests.text_source(spark.createDataFrame([(1,)], "data int"))


def test_targets(spark):
    rows = [
        (0, ("x", None, None)), (1, ("", None, None)), (2, None), (3, (None, None, None)),
        (4, (None, "m", None)), (5, (None, None, 0)),
    ]
    df = spark.createDataFrame(rows, "id int, target struct<name:string,model:string,index:long>")
    got = {r["id"]: (r["instance"], r["error_code"]) for r in requests.resolve_target(df).collect()}
    bad = (None, "INVALID_ARGUMENT")
    todo = (None, "UNIMPLEMENTED")
    assert got == {0: ("x", None), 1: bad, 2: bad, 3: bad, 4: todo, 5: todo}


def test_missing_requests_are_errors_in_calls_and_skipped_in_streams(spark):
    df = spark.createDataFrame([(1, "r"), (2, None)], "id int, request string")
    assert [r["error_code"] for r in requests.require_request(df).orderBy("id").collect()] == [None, "INVALID_ARGUMENT"]
    assert [r["id"] for r in requests.require_request(df, streaming=True).collect()] == [1]


def test_truncation(spark):
    toks = F.array(*[F.lit(t) for t in "abcd"])
    assert one(spark, tx.truncate_tokens(toks, 2, "right")) == ["a", "b"]
    assert one(spark, tx.truncate_tokens(toks, 2, "left")) == ["c", "d"]
    assert one(spark, tx.truncate_tokens(toks, 9, "left")) == list("abcd")
    df = spark.createDataFrame([("a b c d",), ("a b",)], "text string")
    codes = [(r["text"], r["error_code"]) for r in requests.truncated(df, 2, truncate=False).collect()]
    assert sorted(codes) == [("a b", None), ("a b c d", "INPUT_TOO_LONG")]


def test_normalize(spark):
    floats = lambda *xs: F.array(*[F.lit(x).cast("float") for x in xs])
    assert one(spark, vec.l2_normalize(floats(3.0, 4.0))) == pytest.approx([0.6, 0.8])
    assert one(spark, vec.l2_normalize(floats(0.0, 0.0))) == [0, 0]


def test_mean_pool(spark):
    rows = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    assert one(spark, vec.mean_pool(rows)) == [2, 4]
    assert one(spark, vec.mean_pool(rows, F.array(F.lit(1), F.lit(0)))) == [1, 2]


def test_splade_pool(spark):
    logits = F.array(F.array(F.lit(1.0), F.lit(-2.0)), F.array(F.lit(3.0), F.lit(0.5)))
    pooled = one(spark, vec.splade_pool(logits, F.array(F.lit(1), F.lit(1))))
    assert [(p["index"], round(p["value"], 6)) for p in pooled] == [(0, 1.386294), (1, 0.405465)]
    pooled = one(spark, vec.splade_pool(logits, F.array(F.lit(1), F.lit(0))))
    assert [(p["index"], round(p["value"], 6)) for p in pooled] == [(0, 0.693147)]


@pytest.mark.parametrize(
    "n, text", [(22713216, "23M"), (1_500_000_000, "1.5B"), (4416698, "4M"), (400, "0M"), (None, "?"), (2_500_000, "2M")]
)
def test_humanize_params(spark, n, text):
    assert one(spark, fm.humanize_params(F.lit(n).cast("long"))) == text


@pytest.mark.parametrize("ms, text", [(999.4, "999ms"), (1000.0, "1.0s"), (1150.0, "1.1s"), (None, "?"), (2.5, "2ms")])
def test_humanize_ms(spark, ms, text):
    assert one(spark, fm.humanize_ms(F.lit(ms).cast("double"))) == text


def test_fixed_agrees_with_exact_binary_rounding(spark):
    import random

    rng = random.Random(7)
    values = [rng.choice([rng.random(), rng.randrange(10**6) / 1000, rng.randrange(200) / 8, -rng.random() * 50]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        for row in df.select("v", fm.fixed(F.col("v"), digits).alias("t")).collect():
            assert row["t"].replace("-0" if float(row["t"]) == 0 else "\0", "0") == f"{row['v']:.{digits}f}".replace(
                "-0" if float(row["t"]) == 0 else "\0", "0"
            )


@pytest.mark.parametrize(
    "directory, model",
    [
        ("models--BAAI--bge-small-en-v1.5", "BAAI/bge-small-en-v1.5"),
        ("models--solo", "solo"),
        ("models--a--b--c", "a/b--c"),
        ("datasets--x", None),
    ],
)
def test_model_directories(spark, directory, model):
    assert one(spark, fm.model_id_from_dir(F.lit(directory))) == model
    if model and directory != "models--a--b--c":
        assert one(spark, fm.dir_from_model_id(F.lit(model))) == directory


def test_estimate_parameters(spark):
    lits = lambda *xs: [F.lit(x).cast("long") for x in xs]
    assert one(spark, fm.estimate_parameters(*lits(30522, 384, 6))) == 22_337_280
    assert one(spark, fm.estimate_parameters(*lits(30522, 384, None))) is None


def test_url_decoding(spark):
    decode = lambda s: one(spark, requests.url_decode(F.lit(s)))
    assert decode("BAAI%2Fbge-small") == "BAAI/bge-small"
    assert decode("a+b") == "a+b"
    assert decode("50%") == "50%"
    assert decode("%FFx") is None
    assert decode("%C3%A9") == "é"


def test_batches_and_offsets(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for step in (None, 3):
        sizes = batch.assign_batches(df, ["k"], 4, step=step).groupBy("batch_id").count().orderBy("batch_id").collect()
        assert [r["count"] for r in sizes] == [4, 4, 2]
    rows = spark.createDataFrame([(0, 0, 3), (0, 1, 0), (0, 2, 2)], "batch_id long, batch_pos long, n long")
    got = batch.sparse_offsets(rows, F.col("n")).orderBy("batch_pos").collect()
    assert [(r["start_offset"], r["stop_offset"]) for r in got] == [(0, 3), (3, 3), (3, 5)]


def test_packs_respect_the_budget_and_keep_all_rows(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 90 + 1).alias("n_tokens"))
    packs = batch.pack_by_tokens(df, 100, key=df.columns[0], buckets=4)
    again = batch.pack_by_tokens(df.repartition(7), 100, key=df.columns[0], buckets=4)
    assert sorted(map(tuple, packs.collect())) == sorted(map(tuple, again.collect()))
    rows = packs.groupBy("pack_id").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 500
    assert max(r["s"] for r in rows) <= 100


def test_stream_target(spark):
    df = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("s", 3, None), ("u", 1, None), ("u", 2, "x")], "stream_id string, seq int, target string")
    got = {(r["stream_id"], r["seq"]): r["bound_target"] for r in requests.stream_target(df).collect()}
    assert got == {("s", 1): "a", ("s", 2): "a", ("s", 3): "a", ("u", 1): None, ("u", 2): None}
