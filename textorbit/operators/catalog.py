"""Model catalog: store listings, metadata, status, gates, file completeness.

A store listing has one row per file: (path, length), with paths like
``<root>/models--org--name/snapshots/<revision>/<file>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textorbit import schemas
from textorbit.functions.formats import model_id_from_dir

# Files a model needs, weights in order of preference, and extras.
ESSENTIAL_FILES = ["config.json", "tokenizer.json"]
WEIGHT_FILES = ["model.safetensors", "pytorch_model.bin", "model.onnx", "model.safetensors.index.json"]
OPTIONAL_FILES = [
    "tokenizer_config.json",
    "special_tokens_map.json",
    "vocab.txt",
    "sentence_bert_config.json",
    "modules.json",
]

_MODEL_DIR = "(?:^|/)(models--[^/]+)/"
_SNAPSHOT = "(?:^|/)models--[^/]+/snapshots/([^/]+)/"
_SNAPSHOT_DIR = "^(.*?models--[^/]+/snapshots/[^/]+)/"
_SNAPSHOT_FILE = "(?:^|/)models--[^/]+/snapshots/[^/]+/(.+)$"


def _part(path: Column, pattern: str) -> Column:
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found)


def listing(files: DataFrame) -> DataFrame:
    """Add model_id, revision, snapshot directory and file name to a listing."""
    path = F.col("path")
    return files.withColumns(
        {
            "model_id": model_id_from_dir(_part(path, _MODEL_DIR)),
            "revision": _part(path, _SNAPSHOT),
            "snapshot": _part(path, _SNAPSHOT_DIR),
            "file": _part(path, _SNAPSHOT_FILE),
        }
    ).filter(F.col("model_id").isNotNull())


def store_size(files: DataFrame) -> DataFrame:
    """Bytes below each model directory, links and all."""
    return listing(files).groupBy("model_id").agg(F.sum("length").alias("size_bytes"))


def cached_models(files: DataFrame) -> DataFrame:
    """Models with at least one snapshot that holds config.json."""
    return listing(files).filter(F.col("file") == "config.json").select("model_id").distinct()


def latest_snapshot(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(model_id, snapshot): the revision ``refs`` names, if stored, else the smallest with config.json.

    ``refs`` has (model_id, revision), the trimmed text of refs/main.
    """
    snapshots = (
        listing(files)
        .filter(F.col("revision").isNotNull())
        .groupBy("model_id", "revision", "snapshot")
        .agg(F.max((F.col("file") == "config.json").cast("int")).alias("_config"))
    )
    named = refs.select("model_id", F.trim("revision").alias("_main"))
    picked = snapshots.join(named, "model_id", "left").groupBy("model_id").agg(
        F.max(F.when(F.col("revision") == F.col("_main"), F.col("snapshot"))).alias("_by_ref"),
        F.min(F.when(F.col("_config") == 1, F.struct("revision", "snapshot"))).alias("_first"),
    )
    return picked.select("model_id", F.coalesce("_by_ref", "_first.snapshot").alias("snapshot")).filter(
        F.col("snapshot").isNotNull()
    )


def parse_metadata(configs: DataFrame, content: str = "content") -> DataFrame:
    """Parse config.json texts into ``metadata``; one bad field voids the record.

    Two fields have an older name each, used when the newer one is missing.
    """
    raw = T.StructType(
        [
            T.StructField("model_type", T.StringType()),
            *[
                T.StructField(n, T.LongType())
                for n in (
                    "hidden_size", "max_position_embeddings", "vocab_size",
                    "num_hidden_layers", "num_attention_heads", "d_model", "n_positions",
                )
            ],
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    text = F.col(content)
    parsed = F.from_json(text, raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = configs.withColumn("_p", parsed)
    p = F.col("_p")
    unsigned = F.lit(True)
    for f in raw.fields[1:-1]:  # counts fit an unsigned 32-bit number
        unsigned = unsigned & (p[f.name].isNull() | p[f.name].between(0, (1 << 32) - 1))
    # The parser turns a number into a text where a text is declared.
    named = F.try_variant_get(F.try_parse_json(text), "$.model_type", "variant")
    quoted = F.coalesce(F.schema_of_variant(named).isin("STRING", "VOID"), F.lit(True))
    valid = p.isNotNull() & p["_corrupt"].isNull() & unsigned & quoted & text.rlike(r"^\s*\{")
    meta = F.struct(
        p["model_type"].alias("model_type"),
        F.coalesce(p["hidden_size"], p["d_model"]).alias("hidden_size"),
        F.coalesce(p["max_position_embeddings"], p["n_positions"]).alias("max_position_embeddings"),
        p["vocab_size"].alias("vocab_size"),
        p["num_hidden_layers"].alias("num_hidden_layers"),
        p["num_attention_heads"].alias("num_attention_heads"),
    )
    return rows.withColumn("metadata", F.when(valid, meta)).drop("_p")


def model_info(models: DataFrame) -> DataFrame:
    """Public view of a catalog row: the cache struct flattened, ``downloaded`` from its presence."""
    return models.select(
        "model_id",
        "status",
        F.col("cache_info").isNotNull().alias("downloaded"),
        F.col("cache_info.path").alias("cache_path"),
        F.col("cache_info.size_bytes").alias("cache_size_bytes"),
        "last_verified",
        "verification_error",
        "metadata",
        "added_at",
    )


def list_models(models: DataFrame) -> DataFrame:
    return models.orderBy("model_id")


def catalog_counts(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count("*").alias("total"), F.count_if(F.col("cache_info").isNotNull()).alias("downloaded")
    )


def undiscovered(store: DataFrame, models: DataFrame) -> DataFrame:
    """Stored models the catalog does not know yet."""
    return store.join(models.select("model_id"), "model_id", "left_anti")


def _new_entries(ids: DataFrame, store: DataFrame, added_at: Column) -> DataFrame:
    """Catalog rows for new ids: downloaded when stored, otherwise available.

    ``store`` has (model_id, path, size_bytes, metadata).
    """
    rows = ids.join(store.select("model_id", "path", "size_bytes", "metadata"), "model_id", "left")
    stored = F.col("path").isNotNull()
    return rows.select(
        "model_id",
        F.when(stored, "downloaded").otherwise("available").alias("status"),
        F.when(stored, F.struct("path", "size_bytes")).cast(schemas.CACHE_INFO).alias("cache_info"),
        F.col("metadata").cast(schemas.METADATA).alias("metadata"),
        F.lit(None).cast("timestamp").alias("last_verified"),
        F.lit(None).cast("string").alias("verification_error"),
        added_at.cast("timestamp").alias("added_at"),
    )


def init_catalog(configured: DataFrame, store: DataFrame, added_at: Column) -> DataFrame:
    """Configured models and everything found in the store, each once."""
    ids = configured.select("model_id").union(store.select("model_id")).distinct()
    return _new_entries(ids, store, added_at)


def register(models: DataFrame, new: DataFrame, store: DataFrame, added_at: Column) -> DataFrame:
    """Add unknown ids; known ones stay as they are."""
    unknown = new.select("model_id").distinct().join(models.select("model_id"), "model_id", "left_anti")
    return models.unionByName(_new_entries(unknown, store, added_at))


def refresh_catalog(models: DataFrame, store: DataFrame) -> DataFrame:
    """Bring cache facts and status in line with the store.

    Stored: facts refilled, available and downloading become downloaded, other
    statuses stay.  Gone: facts cleared, available.
    """
    found = store.select(
        "model_id",
        F.struct("path", "size_bytes").cast(schemas.CACHE_INFO).alias("_cache"),
        F.col("metadata").cast(schemas.METADATA).alias("_metadata"),
    )
    stored = F.col("_cache").isNotNull()
    status = F.when(
        stored,
        F.when(F.col("status").isin("available", "downloading"), "downloaded").otherwise(F.col("status")),
    ).otherwise("available")
    rows = models.join(found, "model_id", "left").withColumns(
        {"status": status, "cache_info": F.col("_cache"), "metadata": F.col("_metadata")}
    )
    return rows.select(*models.columns)


def apply_status_events(models: DataFrame, events: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Apply (model_id, kind, status, error, ts, seq) events: set, verified, failed.

    Verified stamps the time and clears the error; failed sets the error and
    keeps the older stamp; events of unknown models do nothing.
    """
    kind, order = F.col("kind"), F.struct(ts, seq)
    status = F.when(kind == "verified", "verified").when(kind == "failed", "failed").otherwise(F.col("status"))
    checked = kind.isin("verified", "failed")
    last = events.groupBy("model_id").agg(
        F.max_by(status, order).alias("_status"),
        F.max_by(F.when(kind == "verified", F.col(ts)), F.when(kind == "verified", order)).alias("_verified"),
        F.max_by(F.struct(F.when(kind == "failed", F.col("error")).alias("e")), F.when(checked, order)).alias("_error"),
        F.max(checked).alias("_checked"),
    )
    rows = models.join(last, "model_id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "last_verified": F.coalesce("_verified", "last_verified"),
            "verification_error": F.when(F.col("_checked"), F.col("_error.e")).otherwise(F.col("verification_error")),
        }
    )
    return rows.select(*models.columns)


def _gate(requests: DataFrame, models: DataFrame, store: DataFrame) -> DataFrame:
    known = models.select("model_id", F.col("status").alias("_status"))
    cached = store.select("model_id").distinct().withColumn("_stored", F.lit(True))
    return requests.join(known, "model_id", "left").join(cached, "model_id", "left")


def download_gate(requests: DataFrame, models: DataFrame, store: DataFrame) -> DataFrame:
    """What a download request does: ``noop`` when stored, MODEL_BUSY, or ``download``."""
    rows = _gate(requests, models, store)
    busy = F.col("_stored").isNull() & (F.col("_status") == "downloading")
    return rows.withColumn("error_code", F.when(busy, "MODEL_BUSY")).withColumn(
        "action", F.when(F.col("_stored"), "noop").when(F.col("error_code").isNull(), "download")
    ).drop("_status", "_stored")


def load_gate(requests: DataFrame, models: DataFrame, store: DataFrame) -> DataFrame:
    """First reason a load request is refused, or null."""
    rows = _gate(requests, models, store)
    error = (
        F.when(F.col("_status").isNull(), "MODEL_NOT_FOUND")
        .when(F.col("_status") == "loading", "MODEL_BUSY")
        .when(F.col("_stored").isNull(), "MODEL_LOAD_FAILED")
    )
    return rows.withColumn("error_code", error).drop("_status", "_stored")


def required_files(files: DataFrame) -> DataFrame:
    """Per snapshot: missing essential files, the weight file used, extras present."""
    wanted = [*ESSENTIAL_FILES, *WEIGHT_FILES, *OPTIONAL_FILES]
    have = (
        listing(files)
        .filter(F.col("revision").isNotNull())
        .groupBy("model_id", "revision")
        .agg(F.collect_set(F.when(F.col("file").isin(wanted), F.col("file"))).alias("_have"))
    )
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return have.select(
        "model_id",
        "revision",
        F.array_except(lits(ESSENTIAL_FILES), "_have").alias("missing"),
        F.get(F.array_intersect(lits(WEIGHT_FILES), F.col("_have")), F.lit(0)).alias("weights"),
        F.array_intersect(lits(OPTIONAL_FILES), F.col("_have")).alias("extras"),
    )


def required_shards(indexes: DataFrame, content: str = "content", keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """(keys, shard): distinct shard files an index file's weight map names."""
    parsed = F.from_json(F.col(content), "weight_map map<string,string>")
    shards = F.array_distinct(F.map_values(parsed["weight_map"]))
    return indexes.select(*keys, F.explode(shards).alias("shard")).filter(F.col("shard").isNotNull())


def missing_shards(shards: DataFrame, files: DataFrame) -> DataFrame:
    """Required shards that no snapshot of the model holds."""
    have = listing(files).select("model_id", F.col("file").alias("shard"))
    return shards.join(have, ["model_id", "shard"], "left_anti")
