"""Generated texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = (
    "A small boat crosses the quiet bay",
    "Maps of the old town hang in the hall",
    "The night train stops for water and coal",
    "Rain on the roof keeps the children awake",
    "Seven lamps light the road to the harbour",
)


def generated_text(i: Column, templates: Sequence[str] = TEMPLATES) -> Column:
    """Text of row ``i``: template i mod k, running number i + 1, a suffix on every third row."""
    base = F.get(F.array(*[F.lit(x) for x in templates]), (i % len(templates)).cast("int"))
    text = F.concat(base, F.lit(" - sample "), (i + 1).cast("string"))
    return F.when(i % 3 == 0, F.concat(text, F.lit(" and some more words to vary the length"))).otherwise(text)


def generate_texts(spark: SparkSession, n: int, templates: Sequence[str] = TEMPLATES) -> DataFrame:
    """(id, text) for ids 0 to n - 1."""
    return spark.range(n).select("id", generated_text(F.col("id"), templates).alias("text"))
