"""Queries on a model catalog and store derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textorbit import schemas
from textorbit.functions import formats as fm
from textorbit.operators import catalog as cat
from textorbit.plans.registry import Tables, query

FILES = ["config.json", "tokenizer.json", "model.safetensors", "pytorch_model.bin", "vocab.txt", "model.onnx", "modules.json"]
ADDED = "2024-01-01 00:00:00"

# A part names a model by brand and name, and is one file of one of its snapshots.
_DIR = "'models--' || replace(p_brand, '#', '') || '--' || replace(p_name, ' ', '-')"
_ID = "replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '-')"
_REV = "'r' || (p_partkey % 3)"
_FILES = f"""
    files AS (
      SELECT {_ID} AS model_id, {_REV} AS revision, list_extract({FILES}, ((p_partkey // 3) % 7 + 1)::INT) AS file,
             '/store/' || {_DIR} || '/snapshots/' || {_REV} AS snapshot, (p_size * 1000 + p_partkey)::BIGINT AS length
      FROM part)
"""


def _model_dir():
    return F.concat(
        F.lit("models--"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("--"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
    )


def _model_id():
    return F.concat_ws(
        "/", F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    )


def store_files(t: Tables):
    file = F.get(F.array(*[F.lit(f) for f in FILES]), (F.floor(F.col("p_partkey") / 3) % 7).cast("int"))
    path = F.concat(
        F.lit("/store/"), _model_dir(), F.lit("/snapshots/r"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), file
    )
    return t.part.select(path.alias("path"), (F.col("p_size") * 1000 + F.col("p_partkey")).alias("length"))


@query(f"WITH {_FILES} SELECT model_id, sum(length)::BIGINT AS size_bytes FROM files GROUP BY 1")
def store_size(t: Tables):
    return cat.store_size(store_files(t))


@query(f"WITH {_FILES} SELECT DISTINCT model_id FROM files WHERE file = 'config.json'")
def cached_models(t: Tables):
    return cat.cached_models(store_files(t))


_REFS = f"refs AS (SELECT {_ID} AS model_id, max(CASE WHEN p_size > 10 THEN {_REV} ELSE '' END) AS revision FROM part GROUP BY 1)"


@query(
    f"""
    WITH {_FILES}, {_REFS},
    named AS (SELECT model_id, min(snapshot) AS s FROM files JOIN refs USING (model_id, revision) GROUP BY 1),
    first AS (SELECT model_id, arg_min(snapshot, revision) AS s FROM files WHERE file = 'config.json' GROUP BY 1),
    ids AS (SELECT DISTINCT model_id FROM files)
    SELECT model_id, coalesce(named.s, first.s) AS snapshot
    FROM ids LEFT JOIN named USING (model_id) LEFT JOIN first USING (model_id) WHERE coalesce(named.s, first.s) IS NOT NULL
    """
)
def latest_snapshot(t: Tables):
    own = F.when(F.col("p_size") > 10, F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string"))).otherwise("")
    refs = t.part.groupBy(_model_id().alias("model_id")).agg(
        F.concat(F.lit(" "), F.max(own), F.lit("\n")).alias("revision")
    )
    refs = refs.withColumn("revision", F.regexp_replace("revision", "\\s", ""))
    return cat.latest_snapshot(store_files(t), refs)


@query(
    f"""
    WITH {_FILES},
    h AS (SELECT model_id, revision, list(DISTINCT file) AS have FROM files GROUP BY 1, 2)
    SELECT model_id, revision,
           concat_ws(',', CASE WHEN NOT list_contains(have, 'config.json') THEN 'config.json' END,
                          CASE WHEN NOT list_contains(have, 'tokenizer.json') THEN 'tokenizer.json' END) AS missing,
           CASE WHEN list_contains(have, 'model.safetensors') THEN 'model.safetensors'
                WHEN list_contains(have, 'pytorch_model.bin') THEN 'pytorch_model.bin'
                WHEN list_contains(have, 'model.onnx') THEN 'model.onnx' END AS weights,
           concat_ws(',', CASE WHEN list_contains(have, 'vocab.txt') THEN 'vocab.txt' END,
                          CASE WHEN list_contains(have, 'modules.json') THEN 'modules.json' END) AS extras
    FROM h
    """
)
def required_files(t: Tables):
    rows = cat.required_files(store_files(t))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("missing", "extras")})


@query(
    f"""
    SELECT p_partkey, {_ID} AS model_id, {_DIR} AS dir,
           CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN replace(p_brand, '#', '')
                ELSE 'a/' || replace(p_brand, '#', '') || '--b' END AS odd
    FROM part
    """
)
def model_dir_names(t: Tables):
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    odd = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("datasets--"), brand))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("models--"), brand))
        .otherwise(F.concat(F.lit("models--a--"), brand, F.lit("--b")))
    )
    return t.part.select(
        "p_partkey",
        fm.model_id_from_dir(_model_dir()).alias("model_id"),
        fm.dir_from_model_id(_model_id()).alias("dir"),
        fm.model_id_from_dir(odd).alias("odd"),
    )


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN
             (p_partkey + 30000) * (p_size * 64)::BIGINT + 12 * (p_size % 30) * (p_size * 64)::BIGINT * (p_size * 64)::BIGINT END AS params
    FROM part
    """
)
def estimate_parameters(t: Tables):
    layers = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 30)
    return t.part.select(
        "p_partkey",
        fm.estimate_parameters(F.col("p_partkey") + 30000, F.col("p_size") * 64, layers).alias("params"),
    )


def configs(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit('{"model_type": "bert", "hidden_size": '), s, F.lit(', "vocab_size": 30522, "x": [1, {"y": 2}]}')))
        .when(k % 6 == 1, F.concat(F.lit('{"d_model": '), s, F.lit(', "n_positions": 1024, "num_hidden_layers": 6}')))
        .when(k % 6 == 2, F.concat(F.lit('{"hidden_size": '), s, F.lit(', "d_model": 1, "num_attention_heads": 12}')))
        .when(k % 6 == 3, F.lit("not json"))
        .when(k % 6 == 4, F.concat(F.lit('{"hidden_size": "'), s, F.lit('", "model_type": "bert"}')))
    )
    return t.part.select("p_partkey", text.alias("content"))


@query(
    """
    SELECT p_partkey, p_partkey % 6 < 3 AS parsed, CASE WHEN p_partkey % 6 = 0 THEN 'bert' END AS model_type,
           CASE WHEN p_partkey % 6 < 3 THEN p_size::BIGINT END AS hidden_size,
           CASE WHEN p_partkey % 6 = 1 THEN 1024::BIGINT END AS max_position_embeddings,
           CASE WHEN p_partkey % 6 = 0 THEN 30522::BIGINT END AS vocab_size,
           CASE WHEN p_partkey % 6 = 1 THEN 6::BIGINT END AS num_hidden_layers,
           CASE WHEN p_partkey % 6 = 2 THEN 12::BIGINT END AS num_attention_heads
    FROM part
    """
)
def parse_metadata(t: Tables):
    rows = cat.parse_metadata(configs(t))
    return rows.select("p_partkey", F.col("metadata").isNotNull().alias("parsed"), "metadata.*")


# --- catalog rows: one model per part key -----------------------------------------------

STATUSES = ["available", "downloading", "downloaded", "loading", "verified", "failed"]


def _id(n):
    return F.concat(F.lit("org/m-"), n.cast("string"))


def store(t: Tables):
    """Stored models: two of three part keys."""
    k = F.col("p_partkey")
    meta = F.struct(*[
        (F.lit("bert") if f.name == "model_type" else F.col("p_size").cast("long") if f.name == "hidden_size" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schemas.METADATA.fields
    ])
    return t.part.filter(k % 3 != 0).select(
        _id(k).alias("model_id"),
        F.concat(F.lit("/store/"), k.cast("string")).alias("path"),
        (F.col("p_size") * 1000).cast("long").alias("size_bytes"),
        meta.alias("metadata"),
    )


def models(t: Tables):
    """Known models: four of five part keys, with every status."""
    k = F.col("p_partkey")
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), (k % 6).cast("int"))
    cached = F.when(k % 2 == 0, F.struct(F.lit("/old").alias("path"), F.lit(1).cast("long").alias("size_bytes")))
    return t.part.filter(k % 5 != 0).select(
        _id(k).alias("model_id"),
        status.alias("status"),
        cached.cast(schemas.CACHE_INFO).alias("cache_info"),
        F.lit(None).cast(schemas.METADATA).alias("metadata"),
        F.when(k % 6 == 4, F.lit(ADDED).cast("timestamp")).alias("last_verified"),
        F.when(k % 6 == 5, F.lit("boom")).alias("verification_error"),
        F.lit(ADDED).cast("timestamp").alias("added_at"),
    )


_STORE = """
    store AS (SELECT 'org/m-' || p_partkey AS model_id, '/store/' || p_partkey AS path, (p_size * 1000)::BIGINT AS size_bytes, p_size::BIGINT AS hidden
              FROM part WHERE p_partkey % 3 <> 0)
"""
_MODELS = f"""
    models AS (
      SELECT 'org/m-' || p_partkey AS model_id, list_extract({STATUSES}, (p_partkey % 6 + 1)::INT) AS status,
             CASE WHEN p_partkey % 2 = 0 THEN '/old' END AS cache_path, CASE WHEN p_partkey % 2 = 0 THEN 1::BIGINT END AS cache_size_bytes,
             CASE WHEN p_partkey % 6 = 4 THEN '{ADDED}' END AS verified, CASE WHEN p_partkey % 6 = 5 THEN 'boom' END AS verification_error
      FROM part WHERE p_partkey % 5 <> 0)
"""


def _flat(df):
    """Scalars of the public model view; the verification stamp as text."""
    info = cat.model_info(df)
    return info.select(
        "model_id", "status", "downloaded", "cache_path", "cache_size_bytes",
        F.date_format("last_verified", "yyyy-MM-dd HH:mm:ss").alias("verified"),
        "verification_error", F.col("metadata.hidden_size").alias("hidden_size"),
    )


@query(
    f"""
    WITH {_MODELS}
    SELECT model_id, status, cache_path IS NOT NULL AS downloaded, cache_path, cache_size_bytes, verified, verification_error,
           NULL::BIGINT AS hidden_size FROM models
    """
)
def model_info(t: Tables):
    return _flat(models(t))


@query(f"WITH {_MODELS} SELECT model_id, status FROM models ORDER BY model_id")
def list_models(t: Tables):
    return cat.list_models(models(t)).select("model_id", "status")


@query(f"WITH {_MODELS} SELECT count(*) AS total, count(cache_path) AS downloaded FROM models")
def catalog_counts(t: Tables):
    return cat.catalog_counts(models(t))


@query(f"WITH {_MODELS}, {_STORE} SELECT model_id, path, size_bytes FROM store WHERE model_id NOT IN (SELECT model_id FROM models)")
def undiscovered(t: Tables):
    return cat.undiscovered(store(t), models(t)).drop("metadata")


_NEW = """
    SELECT i.model_id, CASE WHEN s.path IS NOT NULL THEN 'downloaded' ELSE 'available' END AS status, s.path IS NOT NULL AS downloaded,
           s.path AS cache_path, s.size_bytes AS cache_size_bytes, NULL::VARCHAR AS verified, NULL::VARCHAR AS verification_error, s.hidden AS hidden_size
    FROM ids i LEFT JOIN store s USING (model_id)
"""


@query(
    f"""
    WITH {_STORE},
    ids AS (SELECT 'org/m-' || (p_partkey % 500 + 1500) AS model_id FROM part UNION SELECT model_id FROM store)
    {_NEW}
    """
)
def init_catalog(t: Tables):
    configured = t.part.select(_id(F.col("p_partkey") % 500 + 1500).alias("model_id"))
    return _flat(cat.init_catalog(configured, store(t), F.lit(ADDED)))


@query(
    f"""
    WITH {_STORE}, {_MODELS},
    ids AS (
      SELECT DISTINCT 'org/m-' || (p_partkey % 700 + 1700) AS model_id FROM part
      EXCEPT SELECT model_id FROM models)
    {_NEW}
    UNION ALL
    SELECT model_id, status, cache_path IS NOT NULL, cache_path, cache_size_bytes, verified, verification_error, NULL FROM models
    """
)
def register(t: Tables):
    new = t.part.select(_id(F.col("p_partkey") % 700 + 1700).alias("model_id"))
    return _flat(cat.register(models(t), new, store(t), F.lit(ADDED)))


@query(
    f"""
    WITH {_STORE}, {_MODELS}
    SELECT m.model_id, CASE WHEN s.path IS NULL THEN 'available' WHEN status IN ('available', 'downloading') THEN 'downloaded' ELSE status END AS status,
           s.path IS NOT NULL AS downloaded, s.path AS cache_path, s.size_bytes AS cache_size_bytes, verified, verification_error, s.hidden AS hidden_size
    FROM models m LEFT JOIN store s USING (model_id)
    """
)
def refresh_catalog(t: Tables):
    return _flat(cat.refresh_catalog(models(t), store(t)))


@query(
    f"""
    WITH {_MODELS},
    e AS (
      SELECT 'org/m-' || (user_id * 7 % 300) AS model_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'verified' WHEN 'error' THEN 'failed' ELSE 'set' END AS kind,
             CASE event_type WHEN 'view' THEN 'verified' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'loading' ELSE 'downloading' END AS status,
             'reason ' || event_id AS error FROM events),
    l AS (SELECT model_id, arg_max(status, seq) AS s, max(ts) FILTER (kind = 'verified') AS v,
                 max(seq) FILTER (kind = 'verified') AS vs, max(seq) FILTER (kind = 'failed') AS fs,
                 arg_max(error, seq) FILTER (kind = 'failed') AS err FROM e GROUP BY 1)
    SELECT m.model_id, coalesce(l.s, m.status) AS status, cache_path IS NOT NULL AS downloaded, cache_path, cache_size_bytes,
           coalesce(strftime(l.v, '%Y-%m-%d %H:%M:%S'), m.verified) AS verified,
           CASE WHEN vs IS NULL AND fs IS NULL THEN verification_error WHEN fs > coalesce(vs, -1) THEN err END AS verification_error,
           NULL::BIGINT AS hidden_size
    FROM models m LEFT JOIN l USING (model_id)
    """
)
def apply_status_events(t: Tables):
    kind = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "error", "failed").otherwise("set")
    events = t.events.select(
        _id(F.col("user_id") * 7 % 300).alias("model_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "click", "loading").otherwise("downloading").alias("status"),
        F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("error"),
    )
    return _flat(cat.apply_status_events(models(t), events))


@query(
    f"""
    WITH {_STORE}, {_MODELS}
    SELECT event_id, r.model_id, CASE WHEN s.path IS NULL AND m.status = 'downloading' THEN 'MODEL_BUSY' END AS error_code,
           CASE WHEN s.path IS NOT NULL THEN 'noop' WHEN m.status = 'downloading' THEN NULL ELSE 'download' END AS action
    FROM (SELECT event_id, 'org/m-' || (event_id % 2500) AS model_id FROM events) r
    LEFT JOIN models m USING (model_id) LEFT JOIN store s USING (model_id)
    """
)
def download_gate(t: Tables):
    asked = t.events.select("event_id", _id(F.col("event_id") % 2500).alias("model_id"))
    return cat.download_gate(asked, models(t), store(t))


@query(
    f"""
    WITH {_STORE}, {_MODELS}
    SELECT event_id, r.model_id, CASE WHEN m.status IS NULL THEN 'MODEL_NOT_FOUND' WHEN m.status = 'loading' THEN 'MODEL_BUSY'
           WHEN s.path IS NULL THEN 'MODEL_LOAD_FAILED' END AS error_code
    FROM (SELECT event_id, 'org/m-' || (event_id % 2500) AS model_id FROM events) r
    LEFT JOIN models m USING (model_id) LEFT JOIN store s USING (model_id)
    """
)
def load_gate(t: Tables):
    asked = t.events.select("event_id", _id(F.col("event_id") % 2500).alias("model_id"))
    return cat.load_gate(asked, models(t), store(t))


def _indexes(t: Tables):
    shard = lambda n: F.concat(F.lit("s"), (F.col("p_size") % n).cast("string"), F.lit(".safetensors"))
    body = F.concat(
        F.lit('{"metadata": {}, "weight_map": {"a": "'), shard(5), F.lit('", "b": "'), shard(3), F.lit('", "c": "'), shard(5), F.lit('"}}')
    )
    content = F.when(F.col("p_partkey") % 7 == 0, F.lit('{"metadata": {}}')).otherwise(body)
    return t.part.select(_id(F.col("p_partkey")).alias("model_id"), content.alias("content"))


_SHARDS = """
    shards AS (
      SELECT DISTINCT 'org/m-' || p_partkey AS model_id, 's' || (p_size % n) || '.safetensors' AS shard
      FROM part CROSS JOIN (VALUES (5), (3)) v(n) WHERE p_partkey % 7 <> 0)
"""


@query(f"WITH {_SHARDS} SELECT * FROM shards")
def required_shards(t: Tables):
    return cat.required_shards(_indexes(t))


@query(f"WITH {_SHARDS} SELECT * FROM shards WHERE shard NOT IN ('s0.safetensors', 's2.safetensors')")
def missing_shards(t: Tables):
    files = t.part.select(
        F.explode(F.array(F.lit("s0.safetensors"), F.lit("s2.safetensors"))).alias("f"), "p_partkey"
    ).select(
        F.concat(F.lit("/store/models--org--m-"), F.col("p_partkey").cast("string"), F.lit("/snapshots/r0/"), F.col("f")).alias("path"),
        F.lit(1).alias("length"),
    )
    return cat.missing_shards(cat.required_shards(_indexes(t)), files)
