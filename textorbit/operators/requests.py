"""Request rows: text columns, parameters, targets, prompts, errors, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textorbit.functions.text import tokens, truncate_tokens

# Error kind, HTTP status, machine code, RPC status.
ERROR_KINDS = [
    ("InstanceNotFound", 404, "INSTANCE_NOT_FOUND", "NOT_FOUND"),
    ("ModelNotFound", 404, "MODEL_NOT_FOUND", "NOT_FOUND"),
    ("ModelDownloadFailed", 500, "MODEL_DOWNLOAD_FAILED", "INTERNAL"),
    ("ModelLoadFailed", 500, "MODEL_LOAD_FAILED", "INTERNAL"),
    ("ModelBusy", 409, "MODEL_BUSY", "ALREADY_EXISTS"),
    ("InstanceExists", 409, "INSTANCE_EXISTS", "ALREADY_EXISTS"),
    ("PortConflict", 409, "PORT_CONFLICT", "ALREADY_EXISTS"),
    ("MaxInstancesReached", 422, "MAX_INSTANCES_REACHED", "RESOURCE_EXHAUSTED"),
    ("InvalidInstanceState", 400, "INVALID_INSTANCE_STATE", "INVALID_ARGUMENT"),
    ("InvalidConfig", 400, "INVALID_CONFIG", "INVALID_ARGUMENT"),
    ("InvalidPort", 400, "INVALID_PORT", "INVALID_ARGUMENT"),
    ("InvalidGpuId", 400, "INVALID_GPU_ID", "INVALID_ARGUMENT"),
    ("InvalidInstanceName", 400, "INVALID_INSTANCE_NAME", "INVALID_ARGUMENT"),
    ("PortAllocationFailed", 422, "PORT_ALLOCATION_FAILED", "RESOURCE_EXHAUSTED"),
    ("Unauthenticated", 401, "UNAUTHENTICATED", "UNAUTHENTICATED"),
    ("Forbidden", 403, "FORBIDDEN", "PERMISSION_DENIED"),
    ("ValidationError", 400, "VALIDATION_ERROR", "INVALID_ARGUMENT"),
    ("MissingField", 400, "MISSING_FIELD", "INVALID_ARGUMENT"),
    ("BackendUnavailable", 503, "BACKEND_UNAVAILABLE", "UNAVAILABLE"),
    ("Timeout", 504, "TIMEOUT", "DEADLINE_EXCEEDED"),
    ("Internal", 500, "INTERNAL_ERROR", "INTERNAL"),
    ("IoError", 500, "IO_ERROR", "INTERNAL"),
]


def text_source(df: DataFrame, text_col: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Keys plus one text column; the first column when none is named.

    A column that is not a string raises before any job runs.
    """
    name = text_col or df.columns[0]
    if not isinstance(df.schema[name].dataType, T.StringType):
        raise TypeError(f"INVALID_ARGUMENT: column {name!r} must be a string column")
    kept = keys if keys is not None else [c for c in df.columns if c != name]
    return df.select(*kept, F.col(name).alias("text"))


def drop_null_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def request_params(
    df: DataFrame,
    truncate: bool = False,
    normalize: bool = True,
    direction: str = "right",
    prompt_name: str | None = None,
    dimensions: int | None = None,
) -> DataFrame:
    """Attach request parameters; a column already on the row wins over the argument."""
    defaults = {
        "truncate": F.lit(truncate),
        "normalize": F.lit(normalize),
        "direction": F.lit(direction),
        "prompt_name": F.lit(prompt_name).cast("string"),
        "dimensions": F.lit(dimensions).cast("int"),
    }
    return df.withColumns(
        {n: F.coalesce(F.col(n), v) if n in df.columns else v for n, v in defaults.items()}
    )


def target_struct(name: Column, model: Column, index: Column) -> Column:
    return F.struct(
        name.cast("string").alias("name"),
        model.cast("string").alias("model"),
        index.cast("long").alias("index"),
    )


def resolve_target(df: DataFrame, target: str = "target") -> DataFrame:
    """Add ``instance`` and ``error_code`` from a routing struct (name | model | index)."""
    t = F.col(target)
    error = (
        F.when(t.isNull(), "INVALID_ARGUMENT")
        .when(t["name"] == "", "INVALID_ARGUMENT")
        .when(t["name"].isNotNull(), F.lit(None).cast("string"))
        .when(t["model"].isNotNull() | t["index"].isNotNull(), "UNIMPLEMENTED")
        .otherwise("INVALID_ARGUMENT")
    )
    return df.withColumn("error_code", error).withColumn(
        "instance", F.when(F.col("error_code").isNull(), t["name"])
    )


def require_request(df: DataFrame, request: str = "request", streaming: bool = False) -> DataFrame:
    """Rows without an inner request: an error in a call, skipped inside a stream."""
    if streaming:
        return df.filter(F.col(request).isNotNull())
    return df.withColumn(
        "error_code", F.when(F.col(request).isNull(), F.lit("INVALID_ARGUMENT"))
    )


def truncated(
    df: DataFrame, max_len: int, truncate: bool = True, direction: str = "right", text_col: str = "text"
) -> DataFrame:
    """Add ``tokens`` cut to ``max_len``; over-long texts are errors when not truncating."""
    toks = df.withColumn("tokens", tokens(F.col(text_col)))
    if truncate:
        return toks.withColumn("tokens", truncate_tokens(F.col("tokens"), max_len, direction)).withColumn(
            "error_code", F.lit(None).cast("string")
        )
    too_long = F.size("tokens") > max_len
    return toks.withColumn("error_code", F.when(too_long, F.lit("INPUT_TOO_LONG"))).withColumn(
        "tokens", F.when(~too_long, F.col("tokens"))
    )


def apply_prompt(df: DataFrame, prompts: dict[str, str], text_col: str = "text") -> DataFrame:
    """Prefix the named prompt; a name that is not configured is an error.

    The prompts are encoder settings, a handful of literals, so a ``when``
    chain replaces a join.
    """
    name = F.col("prompt_name")
    prefix = F.when(name.isNull(), F.lit(""))
    for key, value in prompts.items():
        prefix = prefix.when(name == key, F.lit(value))
    return df.withColumn("_prefix", prefix).select(
        *[c for c in df.columns if c != text_col],
        F.concat(F.col("_prefix"), F.col(text_col)).alias(text_col),
        F.when(F.col("_prefix").isNull(), F.lit("UNKNOWN_PROMPT")).alias("error_code"),
    )


def call_metadata(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Characters, bytes and tokens a request costs."""
    text = F.col(text_col)
    return df.withColumns(
        {
            "compute_chars": F.length(text).cast("long"),
            "request_bytes": F.octet_length(text).cast("long"),
            "compute_tokens": F.size(tokens(text)).cast("long"),
        }
    )


def error_taxonomy(df: DataFrame, kind_col: str = "error_kind") -> DataFrame:
    """Attach HTTP status, code, RPC status and client/server class to error kinds."""
    lookup = df.sparkSession.createDataFrame(
        ERROR_KINDS, f"{kind_col} string, http_status int, code string, rpc_status string"
    )
    status = F.col("http_status")
    return (
        df.join(F.broadcast(lookup), kind_col, "left")  # 22 fixed rows
        .withColumn("is_client_error", status.between(400, 499))
        .withColumn("is_server_error", status.between(500, 599))
    )


def decode_model_ref(df: DataFrame, col: str = "model_ref") -> DataFrame:
    """URL-decode a model reference; a bad encoding is a validation error."""
    ref = F.col(col)
    return df.withColumn("model_id", url_decode(ref)).withColumn(
        "error_code",
        F.when(ref.isNotNull() & F.col("model_id").isNull(), F.lit("VALIDATION_ERROR")),
    )


def url_decode(ref: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone; null when the bytes are not UTF-8.

    A ``%`` that starts no two-digit escape stays as it is.
    """
    guarded = F.regexp_replace(F.replace(ref, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(guarded)
    return F.when(~decoded.contains("�") | ref.contains("%EF%BF%BD"), decoded)


def valid_device(df: DataFrame, devices: int, col: str = "gpu_id") -> DataFrame:
    """Flag GPU ids that exist; no id (all devices) is valid."""
    return df.withColumn("device_ok", F.col(col).isNull() | (F.col(col) < devices))


def route(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """Look the target instance up by name; request errors come before NOT_FOUND.

    ``requests`` went through ``resolve_target``.  Status is not consulted; a
    row whose instance has ``reachable = false`` gets UNAVAILABLE.  Requests
    without an instance are answered before the join, where their null key would
    bring them all to one task.
    """
    fleet = instances.select(
        F.col("name").alias("instance"),
        "port",
        (F.col("reachable") if "reachable" in instances.columns else F.lit(True)).alias("_up"),
        F.lit(True).alias("_known"),
    )
    error = F.coalesce(
        F.col("error_code"),
        F.when(F.col("_known").isNull(), "NOT_FOUND").when(~F.col("_up"), "UNAVAILABLE"),
    )
    routed = (
        requests.filter(F.col("instance").isNotNull())
        .join(fleet, "instance", "left")
        .withColumn("error_code", error)
        .withColumn("port", F.when(F.col("error_code").isNull(), F.col("port")))
        .drop("_up", "_known")
    )
    refused = requests.filter(F.col("instance").isNull()).withColumns(
        {
            "error_code": F.coalesce("error_code", F.lit("NOT_FOUND")),
            "port": F.lit(None).cast(fleet.schema["port"].dataType),
        }
    )
    return routed.unionByName(refused)


def stream_target(df: DataFrame, stream: str = "stream_id", seq: str = "seq", target: str = "target") -> DataFrame:
    """The target of a stream's first message binds all its messages.

    One ``min_by`` row per stream (combined map-side) is joined back, so a
    long stream is never gathered or sorted in one task.
    """
    bound = df.groupBy(stream).agg(F.min_by(F.struct(F.col(target).alias("t")), F.col(seq)).alias("_b"))
    return df.join(bound, stream).withColumn("bound_target", F.col("_b.t")).drop("_b")
