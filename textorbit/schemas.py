"""Declared schemas of the library's tables."""

from pyspark.sql import types as T

SPARSE_VALUE = T.StructType(
    [T.StructField("index", T.LongType(), False), T.StructField("value", T.FloatType(), False)]
)
DENSE = T.ArrayType(T.FloatType(), False)
SPARSE = T.ArrayType(SPARSE_VALUE, False)
TOKEN_VECTORS = T.ArrayType(DENSE, False)
TOKEN = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("special", T.BooleanType(), False),
        T.StructField("start", T.LongType()),
        T.StructField("stop", T.LongType()),
    ]
)
TOKENS = T.ArrayType(TOKEN, False)
PREDICTION = T.StructType(
    [T.StructField("score", T.FloatType(), False), T.StructField("label", T.StringType(), False)]
)
PREDICTIONS = T.ArrayType(PREDICTION, False)

INFO = T.StructType(
    [
        T.StructField("version", T.StringType(), False),
        T.StructField("sha", T.StringType()),
        T.StructField("docker_label", T.StringType()),
        T.StructField("model_id", T.StringType(), False),
        T.StructField("model_sha", T.StringType()),
        T.StructField("model_dtype", T.StringType(), False),
        T.StructField("model_type", T.StringType(), False),
        T.StructField("max_concurrent_requests", T.LongType(), False),
        T.StructField("max_input_length", T.LongType(), False),
        T.StructField("max_batch_tokens", T.LongType(), False),
        T.StructField("max_batch_requests", T.LongType()),
        T.StructField("max_client_batch_size", T.LongType(), False),
        T.StructField("tokenization_workers", T.LongType(), False),
    ]
)

INSTANCE = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("model_id", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("max_batch_tokens", T.LongType()),
        T.StructField("max_concurrent_requests", T.LongType()),
        T.StructField("pooling", T.StringType()),
        T.StructField("gpu_id", T.LongType()),
        T.StructField("prometheus_port", T.IntegerType()),
        T.StructField("startup_timeout_secs", T.LongType()),
        T.StructField("extra_args", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)
INSTANCE_DEFAULTS = {"max_batch_tokens": 16384, "max_concurrent_requests": 512}

METADATA = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("hidden_size", T.LongType()),
        T.StructField("max_position_embeddings", T.LongType()),
        T.StructField("vocab_size", T.LongType()),
        T.StructField("num_hidden_layers", T.LongType()),
        T.StructField("num_attention_heads", T.LongType()),
    ]
)
CACHE_INFO = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType())]
)
MODEL = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("cache_info", CACHE_INFO),
        T.StructField("metadata", METADATA),
        T.StructField("last_verified", T.TimestampType()),
        T.StructField("verification_error", T.StringType()),
        T.StructField("added_at", T.TimestampType()),
    ]
)

TIMING = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("size", T.StringType(), False),
        T.StructField("query_length", T.StringType(), False),
        T.StructField("device", T.StringType(), False),
        T.StructField("iteration", T.LongType(), False),
        T.StructField("ms", T.DoubleType(), False),
    ]
)
RUN_RECORD = T.StructType(
    [
        T.StructField("mode", T.StringType(), False),
        T.StructField("instance_name", T.StringType(), False),
        T.StructField("num_texts", T.LongType(), False),
        T.StructField("batch_size", T.LongType(), False),
        T.StructField("num_requests", T.LongType(), False),
        T.StructField("total_duration_secs", T.DoubleType(), False),
        T.StructField("throughput_per_sec", T.DoubleType()),
        T.StructField("successful", T.LongType(), False),
        T.StructField("failed", T.LongType(), False),
    ]
)
