"""Files written from the given tables and read back: stores, logs, snapshots, run records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textorbit import schemas
from textorbit.functions.formats import round6
from textorbit.operators import latency as lt
from textorbit.plans.latency import _THROUGHPUT, r6, request_log
from textorbit.plans.registry import Tables, query
from textorbit.session import cut, fresh_dir, remove
from textorbit.sources import payload, report, snapshot, store


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    scheme, _, folder = root.rpartition(":")
    return fs.FileSystem.from_uri(root if "://" in root else f"{scheme or 'file'}:///{folder.lstrip('/')}")


def _fill(system: fs.FileSystem, path: str, content: bytes, there: bool) -> None:
    """Write a file; one that is there keeps its blocks on a local disk, as freeing them takes longer."""
    if there and isinstance(system, fs.LocalFileSystem):
        with open(path, "r+b") as out:
            out.write(content)
            out.truncate()
    else:
        with system.open_output_stream(path) as out:
            out.write(content)


def _folder(system: fs.FileSystem, folder: str, files: dict[str, bytes], old: str | None) -> None:
    """``folder`` with just these ``files``, made of the folder ``old`` if that can be moved."""
    known = {}
    if old is not None:
        if system.get_file_info(old).type == fs.FileType.Directory:  # not by an earlier attempt
            try:
                system.move(old, folder)
            except (OSError, NotImplementedError):  # an object store has no folders to move
                system.delete_dir(old)
        inside = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        known = {i.path: i.type for i in inside}
    made, kept = {path.rpartition("/")[0] for path in files}, {folder}
    for below in made:
        while below not in kept:
            kept.add(below)
            below = below.rpartition("/")[0]
    for path, kind in sorted(known.items(), reverse=True):  # a folder after what it holds
        if kind == fs.FileType.Directory and path not in kept:
            system.delete_dir(path)
        elif kind == fs.FileType.File and path not in files:
            system.delete_file(path)
    for below in made:
        if known.get(below) != fs.FileType.Directory:
            system.create_dir(below, recursive=True)
    for path, content in files.items():
        _fill(system, path, content, known.get(path) == fs.FileType.File)


def write_models(models: DataFrame, root: str, old: str | None) -> None:
    """Each row's ``files`` as the folder ``path`` below ``root``; a repeated task writes the same.

    A row with a folder ``before`` below ``old`` takes that over: its name is changed, its files are
    written over, and those that the model lacks are deleted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        system.create_dir(base, recursive=True)
        was = _opened(old)[1] if old else None
        for batch in batches:
            for path, files, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                contents = {f"{base}/{path}{f['path']}": f["content"].encode() for f in files}
                _folder(system, base + "/" + path, contents, f"{was}/{before}" if was and before else None)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    models.select("path", "files", "before").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row


def remove_folders(folders: DataFrame, root: str) -> None:
    """Delete the folders ``path`` below ``root``, each by the task that it falls to, then ``root``."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)

        def drop(path: str) -> None:
            if system.get_file_info(f"{base}/{path}").type == fs.FileType.Directory:  # not by an earlier attempt
                system.delete_dir(f"{base}/{path}")

        with ThreadPoolExecutor(4) as pool:  # deleting is waiting
            for batch in batches:
                list(pool.map(drop, batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    folders.select("path").mapInArrow(delete, "n long").agg(F.sum("n")).collect()  # one row
    remove(folders.sparkSession, root)


#: Models of a store that is on disk at a time; a model's files and folders take nine blocks or more.
STORE_MODELS = 100_000


def in_stores(t: Tables, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What ``read`` finds in the stores that hold the parts' models, one after the other.

    A store takes many times the disk of the table it is made of, so there is one at a time.  Making and
    deleting folders takes far longer than filling them, so a store takes over the folders of the one before.
    """
    spark = t.spark
    tasks, stores = spark.sparkContext.defaultParallelism, max(1, -(-t.part.count() // STORE_MODELS))
    models, found, old, gone = cut(in_turn(part_models(t), stores, 4 * tasks)), [], None, None
    for n in range(stores):
        here, root = models.filter(F.col("store") == n).repartition(tasks, "path"), fresh_dir(spark, "store")
        write_models(here, root, old)
        if old:
            remove_folders(gone, old)
        found.append(cut(read(spark, root)))
        old, gone = root, here.filter("last")
    remove_folders(gone, old)
    return reduce(DataFrame.unionByName, found)


def in_turn(models: DataFrame, stores: int, shares: int) -> DataFrame:
    """Models with the ``store`` that each is part of, the folder ``before`` it in the store before, and whether it is the ``last``.

    Models of a share follow each other, one for each store, so all stores have about as many.
    """
    dealt = models.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(shares)))
    line = Window.partitionBy("share").orderBy("path")
    turn = F.pmod(F.row_number().over(line) + F.col("share"), F.lit(stores)).cast("int")
    dealt = dealt.withColumns({"store": turn, "before": F.lag("path").over(line), "after": F.lead("path").over(line)})
    before = F.when(F.col("store") > 0, F.col("before")).alias("before")
    last = (F.col("store") == stores - 1) | F.col("after").isNull()
    return dealt.select("path", "files", "store", before, last.alias("last"))


def part_models(t: Tables) -> DataFrame:
    """The folder ``path`` of a model for each part, and its ``files``; some have a reference, some a broken record."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    model = F.concat(F.lit("models--org--m"), key)
    config = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('{"model_type": '), size, F.lit("}"))).otherwise(
        F.concat(F.lit('{"model_type": "'), F.col("p_brand"), F.lit('", "hidden_size": '), size, F.lit("}"))
    )
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    files = [
        file("/snapshots/r1/config.json", F.lit('{"d_model": 7}')),
        file("/snapshots/r2/config.json", config),
        file("/snapshots/r2/weights.bin", F.repeat(F.lit("w"), F.col("p_size"))),
        F.when(F.col("p_size") > 10, file("/refs/main", F.lit("r2\n"))),
    ]
    rows = t.part.select(model.alias("path"), F.array_compact(F.array(*files)).alias("files"))
    return rows.groupBy("path").agg(F.flatten(F.collect_list("files")).alias("files"))  # rows of one part share a folder


_STORE = """
    m AS (
      SELECT 'org/m' || p_partkey AS model_id, p_size, p_brand, p_partkey,
             CASE WHEN p_partkey % 5 = 0 THEN '{"model_type": ' || p_size || '}'
                  ELSE '{"model_type": "' || p_brand || '", "hidden_size": ' || p_size || '}' END AS config
      FROM part)
"""


@query(
    f"""
    WITH {_STORE}, f AS (
      SELECT p_partkey, unnest(['snapshots/r1/config.json', 'snapshots/r2/config.json', 'snapshots/r2/weights.bin', 'refs/main']) AS file,
             unnest([14, length(config), p_size, CASE WHEN p_size > 10 THEN 3 END])::BIGINT AS length FROM m)
    SELECT 'models--org--m' || p_partkey || '/' || file AS path, length FROM f WHERE length IS NOT NULL
    """
)
def scan_model_store(t: Tables):
    files = in_stores(t, store.scan_model_store)
    return files.select(F.regexp_extract("path", r"(models--.*)$", 1).alias("path"), "length")


@query(
    f"""
    WITH {_STORE}
    SELECT model_id, 'r1' AS revision, true AS valid, NULL AS model_type, 7::BIGINT AS hidden_size FROM m
    UNION ALL
    SELECT model_id, 'r2', p_partkey % 5 <> 0, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END,
           CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END FROM m
    """
)
def read_model_configs(t: Tables):
    configs = in_stores(t, store.read_model_configs)
    return configs.select(
        "model_id",
        F.regexp_extract("snapshot", r"([^/]+)/?$", 1).alias("revision"),
        F.col("metadata").isNotNull().alias("valid"),
        "metadata.model_type",
        "metadata.hidden_size",
    )


@query(
    f"""
    WITH {_STORE}
    SELECT model_id, CASE WHEN p_size > 10 THEN 'r2' ELSE 'r1' END AS revision,
           (14 + length(config) + p_size + CASE WHEN p_size > 10 THEN 3 ELSE 0 END)::BIGINT AS size_bytes,
           CASE WHEN p_size <= 10 THEN 7 WHEN p_partkey % 5 <> 0 THEN p_size END::BIGINT AS hidden_size
    FROM m
    """
)
def read_store(t: Tables):
    rows = in_stores(t, store.read_store)
    revision = F.regexp_extract("path", r"([^/]+)/?$", 1).alias("revision")
    return rows.select("model_id", revision, "size_bytes", "metadata.hidden_size")


@query(
    """
    SELECT event_type, event_id // 65536 AS chunk, props AS line,
           row_number() OVER (PARTITION BY event_type, event_id // 65536 ORDER BY event_id) - 1 AS line_no FROM events
    """
)
def read_logs(t: Tables):
    """Events as one log for each type and range of ids."""
    root = fresh_dir(t.spark, "logs")
    keys = ["event_type", "chunk"]
    rows = t.events.withColumn("chunk", F.expr("event_id div 65536")).repartition(*keys)
    rows = rows.sortWithinPartitions(*keys, "event_id").select(*keys, F.col("props").alias("value"))
    rows.write.partitionBy(*keys).text(root)
    lines = store.read_logs(t.spark, f"{root}/*/*/part-*", root=root)
    return lines.select(
        F.regexp_extract("instance", "event_type=([^/]+)/", 1).alias("event_type"),
        F.regexp_extract("instance", "chunk=([^/]+)/", 1).cast("long").alias("chunk"),
        "line_no",
        "line",
    )


@query(
    f"""
    SELECT 'first' AS wanted, c_custkey, {r6("c_acctbal")} AS balance FROM customer
    UNION ALL SELECT w, c_custkey, {r6("c_acctbal + 1")} FROM customer, (VALUES ('second'), ('latest')) v(w)
    """
)
def snapshot_round_trip(t: Tables):
    """Two committed versions and one that was written but never committed."""
    root = fresh_dir(t.spark, "snapshots")
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    raised = rows.withColumn("balance", F.col("balance") + 1)
    snapshot.save_snapshot(rows, root, 1, "2024-01-01 00:00:00")
    snapshot.save_snapshot(raised, root, 2, "2024-01-02 00:00:00")
    rows.withColumn("balance", F.lit(0.0)).write.parquet(f"{root}/data/v=3")
    load = lambda name, version: snapshot.load_snapshot(t.spark, root, rows.schema, version).withColumn("wanted", F.lit(name))
    found = load("first", 1).unionByName(load("second", 2)).unionByName(load("latest", None))
    return found.select("wanted", "c_custkey", round6(F.col("balance")).alias("balance"))


@query(
    f"""
    WITH a AS ({_THROUGHPUT.format(n="1")})
    SELECT mode, 'fleet' AS instance_name, num_texts, 64::BIGINT AS batch_size, num_requests, total_duration_secs,
           {r6("successful / total_duration_secs")} AS throughput_per_sec, successful, failed
    FROM a, (VALUES ('arrow'), ('plain')) v(mode)
    """
)
def run_records(t: Tables):
    root = fresh_dir(t.spark, "runs")
    runs = lt.throughput(request_log(t))
    for mode in ("arrow", "plain"):
        report.append_run_records(runs, root, mode, "fleet", 64)
    back = t.spark.read.schema(schemas.RUN_RECORD).json(root)
    return back.withColumn("throughput_per_sec", round6(F.col("throughput_per_sec")))


@query("SELECT text, count(*) AS n FROM documents GROUP BY 1")
def explode_payload(t: Tables):
    """Payloads taken apart by the SQL table function."""
    payload.register_udtf(t.spark)
    packed = payload.text_payloads(t.documents, 100)
    rows = t.spark.sql("SELECT p.text FROM {packed} b, LATERAL explode_payload(b.payload) p", packed=packed)
    return rows.groupBy("text").agg(F.count("*").alias("n"))
