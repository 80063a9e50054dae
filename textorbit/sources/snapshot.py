"""Versioned state snapshots: written first, committed after, read by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textorbit.session import exists


def save_snapshot(df: DataFrame, path: str, version: int, last_updated: str) -> None:
    """Write version ``version`` and commit it; a half-written version is never seen.

    The commit row carries the version and its time stamp.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data/v={version}")
    commit = spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(last_updated).cast("timestamp").alias("last_updated")
    )
    commit.write.mode("overwrite").parquet(f"{path}/commits/c={version}")


def snapshot_versions(spark: SparkSession, path: str) -> DataFrame:
    """Committed (version, last_updated)."""
    schema = "version long, last_updated timestamp"
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/commits").select("version", "last_updated")


def load_snapshot(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """Latest (or the given) committed version; empty when nothing was ever saved.

    A committed version that cannot be read fails, it is not taken for empty.
    """
    committed = snapshot_versions(spark, path)
    if version is not None:
        committed = committed.filter(F.col("version") == version)
    latest = committed.agg(F.max("version").alias("v")).first()["v"]  # one row
    if latest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(f"{path}/data/v={latest}")
