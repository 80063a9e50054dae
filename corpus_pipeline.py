"""A corpus from documents: quality rules, near duplicates, mixing and packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textorbit.llm import mixing, neardup, plans, quality
from textorbit.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of the documents has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands, each row by its text."""
    return quality.keep_quality(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, and that column's name; written once, so that every reader sees the same.

    Stages decide by row, whatever columns the documents have.
    """
    row = _free(docs, "pipeline_row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = neardup.PERCENT) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id.

    Links are those of op10_near_duplicates, from ``percent`` per cent; copies less alike stay.  Each
    row is judged by its own text, whatever rows share its id.  A row without an id is linked
    like others and is kept if no row of its group has one.  Of rows equal in id and text one
    stays.  Texts without words have no links.
    """
    rows, row = _numbered(docs)
    found = neardup.near_duplicates(rows, doc_id=row, percent=percent).select(F.col("doc_id").alias(row), "component_id")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    known = rows.select(row, "doc_id", blank.alias("blank"), F.when(blank, F.md5("text")).alias("blank_md5"))
    group = {
        "linked": F.when(~F.col("blank"), F.col("component_id")),
        "blank_id": F.when(F.col("blank"), F.col("doc_id")),
    }
    judged = cut(known.join(found, row).withColumns(group).select(row, "doc_id", "blank_md5", *group))
    by = ["linked", "blank_id", "blank_md5"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row]
    many = judged.groupBy(*by).agg(first.alias("first"), F.count("*").alias("members")).where("members > 1")
    same = [judged[c].eqNullSafe(many[c]) for c in by]
    dropped = judged.join(many, same).where(F.col(row) != F.col("first")).select(row)
    return rows.join(dropped, row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of the tree, as many tokens as there are, each twice at most.

    A document that is taken twice has two rows.  Each row is taken by itself, also where
    rows share an id; rows without an id are ordered by their numbers.
    """
    rows, row = _numbered(docs)
    copies, copy = _free(docs, "mixed_copies"), _free(docs, "mixed_copy")
    taken = mixing.mix(plans.with_leaves(rows, row), plans.TREE, row=row).where("copies > 0")
    rows = rows.join(taken.select(row, F.col("copies").alias(copies)), row)
    again = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)
    return rows.select("*", again).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the packed windows; rows without an id too."""
    return plans.packed_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Compression, signatures and token ids are not SQL; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
