"""Queries on payload round trips, generated texts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textorbit.functions import text as tx
from textorbit.functions.formats import round6
from textorbit.operators import encode
from textorbit.plans import latency as latency_queries
from textorbit.plans.registry import Tables, query
from textorbit.plans.text import _SPARSE, r6
from textorbit.sources import payload, report, texts


@query(
    f"""
    WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS p, embedding FROM embeddings)
    SELECT p // 64 AS batch_id, p % 64 AS position, unnest(range(len(embedding))) AS d,
           {r6("unnest(embedding)::DOUBLE")} AS x, NULL::VARCHAR AS _error FROM p
    """
)
def dense_payload_round_trip(t: Tables):
    packed = payload.write_dense_payloads(t.embeddings, 64, order=["vec_id"], step=1 << 20)
    back = payload.read_arrow_payloads(packed, "batch_id", kind="dense")
    return tx.unroll(back, ["batch_id", "position", "_error"], "value", "x", "d").withColumn(
        "x", round6(F.col("x").cast("double"))
    )


@query(
    f"""
    WITH s AS ({_SPARSE}), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
    SELECT p // 100 AS batch_id, p % 100 AS position, index, {r6("value::DOUBLE")} AS value FROM s JOIN p USING (doc_id)
    """
)
def sparse_payload_round_trip(t: Tables):
    rows = encode.embed_sparse(t.spread("documents").select("doc_id", "text"))
    packed = payload.write_sparse_payloads(rows, 100, order=["doc_id"], step=1 << 20)
    back = payload.read_arrow_payloads(packed, "batch_id", kind="sparse")
    return tx.unroll(back, ["batch_id", "position"], "value", "s").select(
        "batch_id", "position", "s.index", round6(F.col("s.value").cast("double")).alias("value")
    )


@query("SELECT text AS value, count(*) AS n FROM documents GROUP BY 1")
def text_payload_round_trip(t: Tables):
    """Packed inside the partitions, without an order."""
    packed = payload.text_payloads(t.documents, 100)
    return payload.read_arrow_payloads(packed, "batch_id").groupBy("value").agg(F.count("*").alias("n"))


_LIST = "[" + ", ".join(f"'{x}'" for x in texts.TEMPLATES) + "]"


@query(
    f"""
    SELECT doc_id, list_extract({_LIST}, (doc_id % {len(texts.TEMPLATES)} + 1)::INT) || ' - sample ' || (doc_id + 1)
           || CASE WHEN doc_id % 3 = 0 THEN ' and some more words to vary the length' ELSE '' END AS text
    FROM documents
    """
)
def generate_texts(t: Tables):
    return t.documents.select("doc_id", texts.generated_text(F.col("doc_id")).alias("text"))


@query()
def report_document(t: Tables):
    config = {"iterations": 30, "warmup": 10, "gpu_available": True}
    run = {"run_timestamp": "2024-01-01T00:00:00", "total_runtime_seconds": 1.0}
    return report.report_document(latency_queries.comparison(t), {"cpu_cores": 8}, config, run)


@query(
    f"""
    WITH {latency_queries._COMPARE_SQL}
    SELECT model, size, query_length, embedding_dim, model_type, {", ".join(f"{r6(c)} AS {c}" for c in [*latency_queries._NUMBERS, "speedup"])}
    FROM cmp
    """
)
def report_document_rows(t: Tables):
    """The comparison inside the document, taken apart again."""
    rows = report_document(t).select(F.explode("comparison").alias("c")).select("c.*")
    numbers = [round6(F.col(c)).alias(c) for c in [*latency_queries._NUMBERS, "speedup"]]
    return rows.select("model", "size", "query_length", "embedding_dim", "model_type", *numbers)
