"""Files of a model store and log files as DataFrames."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textorbit.operators.catalog import latest_snapshot, listing, parse_metadata, store_size
from textorbit.operators.scan import CHUNK, positions
from textorbit.session import cut


#: Rows of a listing, and bytes of contents, that a task holds at once.
_ROWS, _BYTES = 4096, 8 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    left_out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return left_out and not name.startswith(("_common_metadata", "_metadata"))


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path as Hadoop writes it."""
    return (fs.LocalFileSystem(), uri[5:]) if uri.startswith("file:/") else fs.FileSystem.from_uri(uri)


def _top(spark: SparkSession, root: str) -> str:
    """A folder's path as Hadoop writes it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    return re.sub("^file:/+", "file:/", top)


def _opens(top: str) -> bool:
    try:
        _system(top)
    except (pa.ArrowException, OSError):
        return False
    return True


def _files(spark: SparkSession, root: str, name: str | None = None, content: bool = False) -> DataFrame:
    """(path, length) of the files below a folder, or of those of a ``name``, with their ``content`` if wanted.

    One task lists the folder itself, and each folder in it is listed, and read, by the task that it
    falls to, so neither the driver nor a task ever holds all files.  A store that only Hadoop
    can open is listed by Spark's own reader, on the driver.
    """
    top = _top(spark, root)
    if not _opens(top):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        found = (reader.option("pathGlobFilter", name) if name else reader).load(root)
        return found.select("path", "length", *(["content"] if content else []))

    def listed(system: fs.FileSystem, below: str, deep: bool) -> Iterator[tuple[str, fs.FileInfo]]:
        for info in system.get_file_info(fs.FileSelector(below, recursive=deep)):
            path = info.path[len(below) :].lstrip("/")
            if not any(map(_hidden, path.split("/"))):
                yield path, info

    def folder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                system, base = _system(top)
                found = [(p, i.size if i.type == fs.FileType.File else None) for p, i in listed(system, base.rstrip("/"), False)]
                for at in range(0, len(found), _ROWS):
                    names, sizes = zip(*found[at : at + _ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(top)
        rows, held = [], 0
        for batch in batches:
            for entry, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                below = f"{base.rstrip('/')}/{entry}"
                inside = [("", size)] if size is not None else [
                    (f"/{p}", i.size) for p, i in listed(system, below, True) if i.type == fs.FileType.File
                ]
                for path, length in inside:
                    if name is None or f"{entry}{path}".rpartition("/")[2] == name:
                        text = system.open_input_stream(below + path).read() if content else None
                        rows.append((f"{top}/{entry}{path}", length, text))
                        held += len(text or b"")
                    if len(rows) >= _ROWS or held >= _BYTES:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        paths, lengths, texts = zip(*rows, strict=True)
        columns = {"path": pa.array(paths, pa.string()), "length": pa.array(lengths, pa.int64())}
        return pa.RecordBatch.from_pydict(columns | ({"content": pa.array(texts, pa.binary())} if content else {}))

    names = spark.range(0, 1, 1, 1).mapInArrow(folder, "name string, size long")
    dealt = names.repartition(4 * spark.sparkContext.defaultParallelism, "name")
    return dealt.mapInArrow(files, "path string, length long" + (", content binary" if content else ""))


def _contents(spark: SparkSession, root: str, name: str, files: DataFrame | None) -> DataFrame:
    """(path, length, content) of the files of a ``name``; those of a listing ``files``, if given, are not looked up again."""
    top = _top(spark, root)
    if files is None or not _opens(top):
        return _files(spark, root, name, content=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(top)
        for batch in batches:
            texts, held, start = [], 0, 0
            for n, path in enumerate(batch.column("path").to_pylist(), 1):
                texts.append(system.open_input_stream(base.rstrip("/") + path[len(top) :]).read())
                held += len(texts[-1])
                if held >= _BYTES or n == batch.num_rows:
                    yield batch.slice(start, n - start).append_column("content", pa.array(texts, pa.binary()))
                    texts, held, start = [], 0, n

    named = files.filter(F.substring_index("path", "/", -1) == name).select("path", "length")
    dealt = named.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(read, "path string, length long, content binary")


def scan_model_store(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file; nothing is opened."""
    return _files(spark, root)


def read_refs(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(model_id, revision) from each model's refs/main, of the listing ``files`` if given."""
    refs = _contents(spark, root, "main", files).filter(F.col("path").rlike("/models--[^/]+/refs/main$"))
    return listing(refs).select("model_id", F.trim(F.regexp_replace(_text(), "\\s+$", "")).alias("revision"))


def _text() -> Column:
    return F.decode(F.col("content"), "UTF-8")


def read_model_configs(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(model_id, snapshot, metadata) of every snapshot's config.json, of the listing ``files`` if given."""
    configs = listing(_contents(spark, root, "config.json", files)).filter(F.col("file") == "config.json")
    rows = configs.select("model_id", "snapshot", _text().alias("content"))
    return parse_metadata(rows).drop("content")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Stored models as the catalog wants them: (model_id, path, size_bytes, metadata)."""
    files = cut(scan_model_store(spark, root))  # listed once
    snapshots = latest_snapshot(files, read_refs(spark, root, files)).withColumnRenamed("snapshot", "path")
    configs = read_model_configs(spark, root, files).withColumnRenamed("snapshot", "path")
    return snapshots.join(store_size(files), "model_id").join(configs, ["model_id", "path"], "left")


def read_logs(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(instance, line_no, line): lines of log files, numbered from 0 per file.

    The instance is the file's name without its ending, or with ``root`` its path
    below that folder; two files of one instance are an error.

    Files are read in splits, so a log of any size is spread over tasks.  A
    split is the chunk of the numbering: its lines come in order inside the
    scan, and the lines of the splits before it are added.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    below = r"([^/]+?)(\.[^./]*)?$"
    if root is not None:
        below = "/" + re.escape(root.rstrip("/").rpartition("/")[2]) + r"/(.+?)(\.[^./]*)?$"
    names = Counter(m[1] if (m := re.search(below, f)) else f for f in read.inputFiles())
    if twice := [n for n, count in names.items() if count > 1]:
        raise ValueError(f"several logs of instance {twice[0]!r}; name the folder they lie in as root")
    lines = read.select(
        F.regexp_extract("_metadata.file_path", below, 1).alias("instance"),
        F.col("_metadata.file_block_start").alias(CHUNK),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    return positions(lines, ["instance"], [F.col("_at")], "line_no").select("instance", "line_no", "line")
