import json
import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textorbit import schemas
from textorbit.operators import catalog, encode
from textorbit.operators import latency as lt
from textorbit.plans import files, streams
from textorbit.plans.registry import Tables
from textorbit.sources import payload, report, snapshot, store, texts


def ipc(*batches, schema=None):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema or batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def text_batch(*values, name="text"):
    return pa.RecordBatch.from_pydict({name: pa.array(values, pa.string()), "other": pa.array(range(len(values)))})


def test_reading_payloads(spark):
    rows = [
        (0, ipc(text_batch("a", None, "ü"), text_batch("d"))),
        (1, b"junk"),
        (2, ipc(schema=text_batch("x").schema)),
        (3, ipc(pa.RecordBatch.from_pydict({"data": pa.array([1, 2], pa.int32())}))),
        (4, None),
    ]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in rows], "k int, payload binary")
    got = payload.read_arrow_payloads(df, "k").collect()
    good = sorted((r["position"], r["value"]) for r in got if r["k"] == 0)
    assert good == [(0, "a"), (1, None), (2, "ü"), (3, "d")]
    errors = {r["k"]: r["_error"] for r in got if r["_error"]}
    assert set(errors) == {1, 2, 3, 4} and all(e.startswith("INVALID_ARGUMENT") for e in errors.values())
    assert "string column" in errors[3]
    first = payload.read_arrow_payloads(df.filter("k = 0"), "k", all_batches=False)
    assert first.count() == 3


@pytest.mark.parametrize("order", [{}, {"order": ["id"]}, {"order": ["id"], "step": 64}])
def test_round_trips_keep_rows(spark, order):
    df = spark.range(250).withColumn("text", F.concat(F.lit("zeile ü "), F.col("id").cast("string")))
    back = payload.read_arrow_payloads(payload.text_payloads(df, 32, **order), "batch_id")
    assert sorted(r["value"] for r in back.collect()) == sorted(r["text"] for r in df.collect())
    dense = encode.embed(df)
    packed = payload.write_dense_payloads(dense, 32, **order)
    assert packed.agg(F.sum("n_rows")).first()[0] == 250 and packed.agg(F.max("n_rows")).first()[0] == 32
    back = payload.read_arrow_payloads(packed, "batch_id", kind="dense")
    key = lambda v: tuple(v)
    assert sorted(key(r["value"]) for r in back.collect()) == sorted(key(r["embedding"]) for r in dense.collect())
    sparse = encode.embed_sparse(df)
    back = payload.read_arrow_payloads(payload.write_sparse_payloads(sparse, 32, **order), "batch_id", kind="sparse")
    assert sorted(str(r["value"]) for r in back.collect()) == sorted(str(r["sparse"]) for r in sparse.collect())


def test_payload_types(spark):
    df = spark.createDataFrame([(0, [0.5, 1.0])], "id long, embedding array<float>")
    blob = payload.write_dense_payloads(df, 4, order=["id"]).first()["payload"]
    field = pa.ipc.open_stream(blob).read_all().schema.field(0)
    assert field.name == "embeddings" and not field.nullable
    assert field.type == pa.list_(pa.field("item", pa.float32(), False), 2)
    df = spark.createDataFrame([(0, [(3, 0.5)]), (1, [])], "id long, sparse array<struct<index:bigint,value:float>>")
    table = pa.ipc.open_stream(payload.write_sparse_payloads(df, 4, order=["id"]).first()["payload"]).read_all()
    assert table.schema.field(0).name == "sparse_embeddings"
    assert table.column(0).type.value_type.field("index").type == pa.uint32()
    assert table.column(0).to_pylist() == [[{"index": 3, "value": 0.5}], []]


def test_uneven_widths_fail_their_batch_only(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, [2.0])], "id long, embedding array<float>")
    got = payload.write_dense_payloads(df, 2, order=["id"]).orderBy("batch_id").collect()
    assert got[0]["payload"] is None and got[0]["error"].startswith("INTERNAL")
    assert got[1]["error"] is None


def test_table_function(spark):
    payload.register_udtf(spark)
    df = spark.createDataFrame([(bytearray(ipc(text_batch("a", "b"))),)], "payload binary")
    df.createOrReplaceTempView("blobs")
    rows = spark.sql("SELECT p.position, p.text FROM blobs, LATERAL explode_payload(payload) p ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(0, "a"), (1, "b")]


def test_generated_texts(spark):
    rows = [r["text"] for r in texts.generate_texts(spark, 7).orderBy("id").collect()]
    assert len(rows) == 7 and " - sample 1 and" in rows[0] and rows[1].endswith(" - sample 2")
    assert [("words" in r) for r in rows] == [i % 3 == 0 for i in range(7)]
    assert rows[5].startswith(texts.TEMPLATES[0])


# --- model store ------------------------------------------------------------------------


@pytest.fixture
def model_store(tmp_path):
    def put(path, text):
        f = pathlib.Path(tmp_path, path)
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("models--BAAI--small/refs/main", "r2\n")
    put("models--BAAI--small/snapshots/r1/config.json", '{"hidden_size": 10}')
    put("models--BAAI--small/snapshots/r2/config.json", '{"d_model": 768, "n_positions": 1024, "vocab_size": 7}')
    put("models--BAAI--small/snapshots/r2/tokenizer.json", "{}")
    put("models--BAAI--small/snapshots/r2/model.safetensors.index.json", '{"weight_map":{"a":"s1","b":"s2","c":"s1"}}')
    put("models--BAAI--small/snapshots/r2/s1", "12345")
    put("models--solo/refs/main", "gone")
    put("models--solo/snapshots/r9/config.json", "not json")
    put("models--solo/snapshots/r8/README.md", "x")
    put("models--empty/snapshots/r1/vocab.txt", "x")
    put("datasets--x/snapshots/r1/config.json", "{}")
    return f"file://{tmp_path}"


def test_store(spark, model_store):
    files = store.scan_model_store(spark, model_store)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert {r["model_id"] for r in catalog.cached_models(files).collect()} == {"BAAI/small", "solo"}
    sizes = {r["model_id"]: r["size_bytes"] for r in catalog.store_size(files).collect()}
    assert sizes["empty"] == 1 and sizes["solo"] == 4 + 8 + 1
    latest = {r["model_id"]: r["snapshot"].split("/")[-1] for r in catalog.latest_snapshot(files, store.read_refs(spark, model_store)).collect()}
    assert latest == {"BAAI/small": "r2", "solo": "r9"}
    stored = {r["model_id"]: r for r in store.read_store(spark, model_store).collect()}
    meta = stored["BAAI/small"]["metadata"]
    assert (meta["hidden_size"], meta["max_position_embeddings"], meta["vocab_size"]) == (768, 1024, 7)
    assert stored["solo"]["metadata"] is None
    need = {(r["model_id"], r["revision"]): r for r in catalog.required_files(files).collect()}
    r2 = need[("BAAI/small", "r2")]
    assert r2["missing"] == [] and r2["weights"] == "model.safetensors.index.json"
    assert need[("BAAI/small", "r1")]["missing"] == ["tokenizer.json"]
    assert need[("empty", "r1")]["extras"] == ["vocab.txt"]
    index = spark.read.text(f"{model_store}/models--BAAI--small/snapshots/r2/model.safetensors.index.json", wholetext=True)
    shards = catalog.required_shards(index.select(F.lit("BAAI/small").alias("model_id"), F.col("value").alias("content")))
    assert {r["shard"] for r in shards.collect()} == {"s1", "s2"}
    assert [r["shard"] for r in catalog.missing_shards(shards, files).collect()] == ["s2"]


def test_store_is_listed_in_tasks(spark, tmp_path, model_store):
    pathlib.Path(tmp_path, "models--solo/.hidden").write_text("x")
    pathlib.Path(tmp_path, "top").write_text("abc")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for root in (model_store, str(tmp_path)):
        found = store.scan_model_store(spark, root)
        assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(found.collect()) == sorted(reader.load(root).select("path", "length").collect())


def test_stores_on_disk_one_at_a_time(spark, tmp_path, monkeypatch):
    parts = spark.range(40).selectExpr("id AS p_partkey", "int(id % 20 + 1) AS p_size", "'b' AS p_brand")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    roots = []
    monkeypatch.setattr(files, "STORE_MODELS", 15)
    monkeypatch.setattr(files, "fresh_dir", lambda spark, label: roots.append(f"{tmp_path}/{label}-{len(roots)}") or roots[-1])
    found = files.in_stores(Tables(spark, str(tmp_path)), store.read_store)
    assert found.select("model_id").distinct().count() == found.count() == 40
    assert len(roots) == 3 and not any(pathlib.Path(r).exists() for r in roots)


def test_a_store_takes_over_the_folders_of_the_one_before(spark, tmp_path, monkeypatch):
    parts = spark.range(60).selectExpr("id AS p_partkey", "int(id * 7 % 20 + 1) AS p_size", "'b' AS p_brand")
    parts.union(parts.limit(5)).write.parquet(str(tmp_path / "part.parquet"))  # rows of one part share a folder
    removed, seen, remove = [], {}, files.remove_folders
    monkeypatch.setattr(files, "STORE_MODELS", 15)
    monkeypatch.setattr(files, "fresh_dir", lambda spark, label: f"{tmp_path}/{label}-{len(seen)}-{len(removed)}")
    monkeypatch.setattr(files, "remove_folders", lambda folders, root: removed.append(folders.count()) or remove(folders, root))

    def read(spark, root):
        base = pathlib.Path(root)
        for model in base.iterdir():
            assert model.name not in seen
            seen[model.name] = {str(p.relative_to(model)): p.read_text() if p.is_file() else None for p in model.rglob("*")}
        return store.scan_model_store(spark, root)

    assert files.in_stores(Tables(spark, str(tmp_path)), read).count() == sum(v is not None for m in seen.values() for v in m.values())
    assert sum(removed) < 60 and len(removed) == 5
    for i in range(60):
        size = i * 7 % 20 + 1
        config = f'{{"model_type": {size}}}' if i % 5 == 0 else f'{{"model_type": "b", "hidden_size": {size}}}'
        wanted = {"snapshots": None, "snapshots/r1": None, "snapshots/r1/config.json": '{"d_model": 7}', "snapshots/r2": None}
        wanted |= {"snapshots/r2/config.json": config, "snapshots/r2/weights.bin": "w" * size}
        assert seen.pop(f"models--org--m{i}") == wanted | ({"refs": None, "refs/main": "r2\n"} if size > 10 else {})
    assert not seen


def test_a_repeated_task_writes_the_same_store(spark, tmp_path):
    at = lambda folder: {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}
    rows = lambda name, before, files: spark.createDataFrame([(name, files, before)], "path string, files array<struct<path string, content string>>, before string")
    first, second = tmp_path / "first", tmp_path / "second"
    files.write_models(rows("m", None, [("/a/x", "long text"), ("/b/c/y", "1")]), str(first), None)
    for _ in range(2):
        files.write_models(rows("n", "m", [("/a/x", "text"), ("/d/z", "2")]), str(second), str(first))
        assert at(first) == {} and at(second) == {"n/a/x": "text", "n/d/z": "2"} and not (second / "n/b").exists()


def test_read_store_lists_it_once(spark, model_store, monkeypatch):
    listed, find = [], store._files
    monkeypatch.setattr(store, "_files", lambda *a, **k: listed.append(a) or find(*a, **k))
    assert {r["model_id"] for r in store.read_store(spark, model_store).collect()} == {"BAAI/small", "solo"}
    assert len(listed) == 1


@pytest.mark.parametrize(
    "text, hidden, longest",
    [
        ('{"d_model":768,"n_positions":1024}', 768, 1024),
        ('{"hidden_size":5,"d_model":768}', 5, None),
        ('{"hidden_size":null,"d_model":768}', 768, None),
        ("{}", None, None),
    ],
)
def test_metadata(spark, text, hidden, longest):
    r = catalog.parse_metadata(spark.createDataFrame([(text,)], "content string")).first()["metadata"]
    assert (r["hidden_size"], r["max_position_embeddings"]) == (hidden, longest)


@pytest.mark.parametrize("text", ["not json", None, "", '{"hidden_size":"x"}', '{"vocab_size":-1}', '{"model_type":3}', "[1]"])
def test_invalid_metadata_voids_the_record(spark, text):
    assert catalog.parse_metadata(spark.createDataFrame([(text,)], "content string")).first()["metadata"] is None


def test_refresh(spark):
    statuses = ["available", "downloading", "loading", "verified", "failed", "downloaded"]
    rows = [(f"{s}-{i}", s, ("/old", 1)) for s in statuses for i in (0, 1)]
    models = spark.createDataFrame([(m, s, c, None, None, None, None) for m, s, c in rows], schemas.MODEL)
    stored = spark.createDataFrame([(f"{s}-1", "/new", 2, None) for s in statuses], schemas.MODEL[:0].add("model_id", "string").add("path", "string").add("size_bytes", "long").add("metadata", schemas.METADATA))
    got = {r["model_id"]: r for r in catalog.refresh_catalog(models, stored).collect()}
    after = {"available": "downloaded", "downloading": "downloaded"}
    for s in statuses:
        assert got[f"{s}-1"]["status"] == after.get(s, s) and got[f"{s}-1"]["cache_info"]["path"] == "/new"
        assert got[f"{s}-0"]["status"] == "available" and got[f"{s}-0"]["cache_info"] is None


def test_logs(spark, tmp_path):
    (tmp_path / "inst-a.log").write_bytes(b"one\r\ntwo\n\nfour")
    (tmp_path / "inst-b.log").write_bytes(b"x\n")
    (tmp_path / "inst-c.log").write_bytes(b"")
    got = {}
    for r in store.read_logs(spark, f"{tmp_path}/*.log").orderBy("line_no").collect():
        got.setdefault(r["instance"], []).append((r["line_no"], r["line"]))
    assert got == {"inst-a": [(0, "one"), (1, "two"), (2, ""), (3, "four")], "inst-b": [(0, "x")]}


def test_logs_of_one_name_in_two_folders(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.log").write_text(f"{folder}\n")
    with pytest.raises(ValueError):
        store.read_logs(spark, f"{tmp_path}/*/*.log")
    got = {(r["instance"], r["line_no"], r["line"]) for r in store.read_logs(spark, f"{tmp_path}/*/*.log", root=str(tmp_path)).collect()}
    assert got == {("a/x", 0, "a"), ("b/x", 0, "b")}


def test_one_large_log_is_read_in_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = store.read_logs(spark, f"{tmp_path}/big.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["line"] == f"line {r['line_no']}" for r in rows) and len(rows) == 5000


# --- snapshots and reports ----------------------------------------------------------------


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert snapshot.load_snapshot(spark, path, schemas.INSTANCE).count() == 0
    df = spark.createDataFrame([("a", "m", 8080, 1, 2, None, None, None, None, ["--x"], None)], schemas.INSTANCE)
    snapshot.save_snapshot(df, path, 1, "2024-01-01 00:00:00")
    snapshot.save_snapshot(df.limit(0), path, 2, "2024-01-02 00:00:00")
    df.write.parquet(f"{path}/data/v=3")  # written, never committed
    assert snapshot.load_snapshot(spark, path, schemas.INSTANCE).count() == 0
    assert snapshot.load_snapshot(spark, path, schemas.INSTANCE, 1).collect() == df.collect()
    assert snapshot.snapshot_versions(spark, path).count() == 2


def test_unreadable_snapshot_fails(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    snapshot.save_snapshot(spark.range(3), path, 1, "2024-01-01 00:00:00")
    for f in (tmp_path / "state/data/v=1").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "state/data/v=1").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception, match="(?i)parquet|cannot read"):
        snapshot.load_snapshot(spark, path, spark.range(1).schema).collect()


@pytest.fixture
def comparison(spark):
    cols = "model string, size string, query_length string, device string, run_order int, mean_ms double, p50_ms double, p95_ms double, p99_ms double, load_time_ms double, embedding_dim int, num_parameters long"
    rows = [
        ("o/big", "large", "long", "cpu", 1, 10.0, 10.0, 11.0, 12.0, 1150.0, 1024, 335141888),
        ("o/big", "large", "short", "cpu", 1, 9.0, 9.0, 9.5, 9.75, 1150.0, 1024, 335141888),
        ("o/big", "large", "short", "cuda", 2, 2.0, 2.0, 2.25, 2.5, 300.0, 1024, 335141888),
        ("o/tiny", "small", "short", "cpu", 1, 1.0, 1.0, 1.125, 1.5, None, None, None),
    ]
    return lt.compare_devices(spark.createDataFrame(rows, cols))


def test_csv_report(spark, comparison, tmp_path):
    report.write_report_csv(comparison, f"file://{tmp_path}/csv")
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text().splitlines() == [
        ",".join(lt.CSV_COLUMNS),
        "o/tiny,small,,,,,,short,1.0000,1.0000,1.1250,1.5000,,,,,",
        "o/big,large,335141888,1024,,1150.0,300.0,short,9.0000,9.0000,9.5000,9.7500,2.0000,2.0000,2.2500,2.5000,4.50",
        "o/big,large,335141888,1024,,1150.0,,long,10.0000,10.0000,11.0000,12.0000,,,,,",
    ]


def test_json_report(spark, comparison, tmp_path):
    report.write_report_json(comparison, {"cpu_cores": 8}, {"iterations": 30}, {"run_timestamp": "t"}, f"file://{tmp_path}/json")
    (file,) = (tmp_path / "json").glob("*.json")
    doc = json.loads(file.read_text())
    assert [(c["model"], c["query_length"]) for c in doc["comparison"]] == [("o/tiny", "short"), ("o/big", "short"), ("o/big", "long")]
    assert doc["comparison"][0]["gpu_mean_ms"] is None and doc["comparison"][1]["params_str"] == "335M"
    assert [a["query_length"] for a in doc["aggregations_by_query_size"]] == ["short", "long"]
    assert doc["aggregations_by_query_size"][0]["avg_speedup"] == 2.5
    assert [a["model_size"] for a in doc["aggregations_by_model_size"]] == ["small", "large"]


def test_text_report(spark, comparison, tmp_path):
    report.write_report_text(comparison, f"file://{tmp_path}/text")
    (file,) = (tmp_path / "text").glob("*.txt")
    lines = file.read_text().splitlines()
    assert lines[0] == "| tiny | small | ? | ? | ? | ? | ? |"
    assert lines[1] == "| big | large | 335M | 1024 | ? | 1.1s | ? |"
    assert "| big | large | 335M | 1024 | short | 9.00 | 9.00 | 9.50 | 2.00 | 2.00 | 2.25 | 4.5x |" in lines
    assert "| long | 10.00 | 10.00 | 11.00 | N/A | N/A | N/A | N/A |" in lines


def test_run_records(spark, tmp_path):
    runs = spark.createDataFrame([(2, 1, 1.5, 1.33, 2, 0)], "num_texts long, num_requests long, total_duration_secs double, throughput_per_sec double, successful long, failed long")
    for _ in range(2):
        report.append_run_records(runs, f"file://{tmp_path}/runs", "arrow", "inst", 64)
    rows = spark.read.schema(schemas.RUN_RECORD).json(f"file://{tmp_path}/runs")
    assert rows.count() == 2 and rows.first()["batch_size"] == 64 and len(rows.columns) == 9


def test_tables_as_streams_are_files_or_folders(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.toPandas().to_parquet(tmp_path / "labels.parquet")
    t = Tables(spark, str(tmp_path))
    for name in ("documents", "labels"):
        assert streams.table(t, streams.stream(t, name)).count() == 10
