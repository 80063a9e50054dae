"""Requests with options of their own, for each encoder operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.functions import text as tx
from textorbit.functions.formats import round6
from textorbit.operators import calls, encode
from textorbit.plans.registry import Tables, query
from textorbit.plans.text import _LABELS, HASH, SIGN, TOKENS, label_weights, r6, rerank_requests

LIMIT = 200
PROMPTS = {"query": "query: ", "passage": "passage: "}


def document_requests(t: Tables, *more) -> DataFrame:
    i = F.col("doc_id")
    return t.spread("documents").select(
        "doc_id",
        "text",
        F.when(F.col("lang") == "en", "query").when(F.col("lang") == "fr", "passage").when(F.col("lang") != "de", "none").alias("prompt_name"),
        F.when(i % 3 == 0, False).alias("truncate"),
        F.when(i % 2 == 0, "left").alias("direction"),
        *more,
    )


def kept_sql(text: str) -> str:
    """(doc_id, error_code) as ``e`` and the tokens that are left, by place, as ``tk``."""
    return f"""
    r AS (SELECT doc_id, {text} AS text, doc_id % 3 <> 0 AS may_cut, doc_id % 2 = 0 AS from_left FROM documents),
    l AS (SELECT *, {TOKENS.format("text")} AS l FROM r),
    e AS (
      SELECT *, CASE WHEN text IS NULL THEN 'UNKNOWN_PROMPT' WHEN len(l) > {LIMIT} AND NOT may_cut THEN 'INPUT_TOO_LONG' END AS error_code,
        CASE WHEN len(l) <= {LIMIT} THEN l WHEN from_left THEN l[len(l) - {LIMIT - 1}:] ELSE l[1:{LIMIT}] END AS kept FROM l),
    tk AS (
      SELECT doc_id, unnest(kept) AS tok, generate_subscripts(kept, 1) - 1 AS place FROM e WHERE error_code IS NULL)
    """


_PROMPTED = "CASE lang WHEN 'en' THEN 'query: ' WHEN 'fr' THEN 'passage: ' WHEN 'de' THEN '' END || text"


@query(
    f"""
    WITH {kept_sql(_PROMPTED)},
    v AS (SELECT doc_id, {HASH.format("tok")} % 30522 AS index, ln(1 + count(*))::FLOAT::DOUBLE AS value FROM tk GROUP BY ALL)
    SELECT e.doc_id, error_code, len(l)::BIGINT AS compute_tokens, index, {r6("value")} AS value FROM e LEFT JOIN v USING (doc_id)
    """
)
def embed_sparse_options(t: Tables):
    found = calls.embed_sparse_requests(document_requests(t), PROMPTS, LIMIT, truncate=True)
    return found.select(
        "doc_id", "error_code", F.col("metadata.compute_tokens").alias("compute_tokens"), F.explode_outer("sparse").alias("s")
    ).select("doc_id", "error_code", "compute_tokens", "s.index", round6(F.col("s.value").cast("double")).alias("value"))


@query(
    f"""
    WITH {kept_sql(_PROMPTED)},
    chosen AS (SELECT doc_id, md5(tok) AS h, place FROM tk WHERE place % 50 = 0),
    v AS (SELECT doc_id, place, unnest(range(32)) AS d, h FROM chosen)
    SELECT e.doc_id, error_code, CASE WHEN error_code IS NULL THEN len(kept) END::BIGINT AS n_tokens, place, d,
           {r6("((2 * (instr('0123456789abcdef', substr(h, d::INTEGER + 1, 1)) - 1) - 15) / 15.0::DOUBLE)::FLOAT::DOUBLE")} AS x
    FROM e LEFT JOIN v USING (doc_id)
    """
)
def embed_all_options(t: Tables):
    """Vectors of each fiftieth token that is left of a request."""
    found = calls.embed_all_requests(document_requests(t), PROMPTS, LIMIT, truncate=True)
    size = F.when(F.col("token_embeddings").isNotNull(), F.size("token_embeddings").cast("long"))
    some = F.transform("token_embeddings", lambda v, i: F.struct(i.cast("long").alias("place"), v.alias("v")))
    some = F.filter(some, lambda s: s["place"] % 50 == 0)
    rows = found.select("doc_id", "error_code", size.alias("n_tokens"), F.explode_outer(some).alias("s"))
    return rows.select("doc_id", "error_code", "n_tokens", "s.place", F.posexplode_outer("s.v").alias("d", "x")).select(
        "doc_id", "error_code", "n_tokens", "place", F.col("d").cast("long").alias("d"), round6(F.col("x").cast("double")).alias("x")
    )


def _scores_sql(flag: str) -> str:
    """Raw scores of ``raw`` (doc_id, k, raw) or their softmax, and errors."""
    return f"""
    m AS (SELECT doc_id, max(raw) AS top FROM raw GROUP BY 1),
    z AS (SELECT doc_id, sum(exp(raw - top)) AS total FROM raw JOIN m USING (doc_id) GROUP BY 1)
    SELECT e.doc_id, error_code, 'label-' || k AS label,
           round((CASE WHEN {flag} THEN raw ELSE exp(raw - top) / total END)::FLOAT::DOUBLE, 4) AS score
    FROM e LEFT JOIN raw USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
    """


def _predictions(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "error_code", F.explode_outer("predictions").alias("p")).select(
        "doc_id", "error_code", "p.label", F.round(F.col("p.score").cast("double"), 4).alias("score")
    )


@query(
    f"""
    WITH {kept_sql("text")}, {_LABELS},
    w AS (SELECT doc_id, {HASH.format("tok")} % 64 AS d, sum({SIGN.format("tok")})::BIGINT AS w FROM tk GROUP BY ALL HAVING w <> 0),
    n AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM w GROUP BY 1),
    raw AS (
      SELECT e.doc_id, k, coalesce(sum((w / n)::FLOAT::DOUBLE * ((d * (k + 2)) % 7 - 3) / 10), 0) AS raw
      FROM e CROSS JOIN lab LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id) WHERE error_code IS NULL GROUP BY ALL),
    {_scores_sql("e.doc_id % 4 = 0")}
    """
)
def predict_options(t: Tables):
    rows = document_requests(t, (F.col("doc_id") % 4 == 0).alias("raw_scores")).drop("prompt_name")
    return _predictions(calls.predict_requests(rows, encode.LinearClassifier(label_weights()), LIMIT, truncate=True))


@query(
    f"""
    WITH {_LABELS},
    l AS (
      SELECT doc_id, doc_id % 3 <> 0 AS may_cut, doc_id % 2 = 0 AS from_left, doc_id % 13 = 0 AS single,
             {TOKENS.format("text")} AS la, {TOKENS.format("lang || ' ' || text")} AS lb FROM documents),
    sized AS (
      SELECT *, CASE WHEN len(la) <= {LIMIT // 2} THEN len(la) ELSE {LIMIT // 2} END AS na FROM l),
    e AS (
      SELECT *, least(len(lb), {LIMIT} - na) AS nb,
        CASE WHEN single THEN 'INVALID_ARGUMENT' WHEN len(la) + len(lb) > {LIMIT} AND NOT may_cut THEN 'INPUT_TOO_LONG' END AS error_code
      FROM sized),
    kept AS (
      SELECT doc_id, CASE WHEN len(la) + len(lb) <= {LIMIT} THEN la WHEN from_left THEN la[len(la) - na + 1:] ELSE la[1:na] END AS ka,
             CASE WHEN len(la) + len(lb) <= {LIMIT} THEN lb WHEN from_left THEN lb[len(lb) - nb + 1:] ELSE lb[1:nb] END AS kb
      FROM e WHERE error_code IS NULL),
    ta AS (SELECT doc_id, unnest(ka) AS tok FROM kept), tb AS (SELECT doc_id, unnest(kb) AS tok FROM kept),
    wa AS (SELECT doc_id, {HASH.format("tok")} % 64 AS d, sum({SIGN.format("tok")})::BIGINT AS w FROM ta GROUP BY ALL HAVING w <> 0),
    wb AS (SELECT doc_id, {HASH.format("tok")} % 64 AS d, sum({SIGN.format("tok")})::BIGINT AS w FROM tb GROUP BY ALL HAVING w <> 0),
    na AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM wa GROUP BY 1),
    nb AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM wb GROUP BY 1),
    prod AS (
      SELECT doc_id, d, ((wa.w / na.n)::FLOAT * (wb.w / nb.n)::FLOAT)::FLOAT::DOUBLE AS x
      FROM wa JOIN wb USING (doc_id, d) JOIN na USING (doc_id) JOIN nb USING (doc_id)),
    raw AS (
      SELECT e.doc_id, k, coalesce(sum(x * ((d * (k + 2)) % 7 - 3) / 10), 0) AS raw
      FROM e CROSS JOIN lab LEFT JOIN prod USING (doc_id) WHERE error_code IS NULL GROUP BY ALL),
    {_scores_sql("e.doc_id % 4 = 0")}
    """
)
def predict_pair_options(t: Tables):
    """Pairs that share a limit; each thirteenth request is no pair."""
    one, two = F.col("text"), F.concat("lang", F.lit(" "), "text")
    pair = F.when(F.col("doc_id") % 13 == 0, F.array(one)).otherwise(F.array(one, two)).alias("texts")
    rows = document_requests(t, pair, (F.col("doc_id") % 4 == 0).alias("raw_scores")).drop("prompt_name", "text")
    return _predictions(calls.predict_pair_requests(rows, encode.LinearClassifier(label_weights()), LIMIT, truncate=True))


_RANK_LIMIT = 60


@query(
    f"""
    WITH req AS (
      SELECT a.conv_id, a.text AS query, b.turn - 1 AS index, b.text, a.conv_id % 3 <> 0 AS may_cut, a.conv_id % 2 = 0 AS from_left
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn > 0),
    l AS (SELECT *, {TOKENS.format("query")} AS la, {TOKENS.format("text")} AS lb FROM req),
    sized AS (
      SELECT *, len(la) + len(lb) > {_RANK_LIMIT} AS long, least(len(la), CASE WHEN len(la) <= {_RANK_LIMIT // 2} THEN len(la)
        WHEN len(lb) <= {_RANK_LIMIT // 2} THEN {_RANK_LIMIT} - len(lb) ELSE {_RANK_LIMIT // 2} END) AS na FROM l),
    cut AS (SELECT *, least(len(lb), {_RANK_LIMIT} - na) AS nb FROM sized),
    failed AS (SELECT DISTINCT conv_id FROM cut WHERE long AND NOT may_cut),
    k AS (
      SELECT conv_id || '/' || index AS key, conv_id, index, text,
             CASE WHEN NOT long THEN la WHEN from_left THEN la[len(la) - na + 1:] ELSE la[1:na] END AS ka,
             CASE WHEN NOT long THEN lb WHEN from_left THEN lb[len(lb) - nb + 1:] ELSE lb[1:nb] END AS kb
      FROM cut ANTI JOIN failed USING (conv_id)),
    tq AS (SELECT key, unnest(ka) AS tok FROM k), tt AS (SELECT key, unnest(kb) AS tok FROM k),
    q AS (SELECT key, {HASH.format("tok")} % 64 AS d, sum({SIGN.format("tok")})::BIGINT AS w FROM tq GROUP BY ALL),
    c AS (SELECT key, {HASH.format("tok")} % 64 AS d, sum({SIGN.format("tok")})::BIGINT AS w FROM tt GROUP BY ALL),
    qn AS (SELECT key, sum(w * w) AS n FROM q GROUP BY 1), cn AS (SELECT key, sum(w * w) AS n FROM c GROUP BY 1),
    dots AS (SELECT key, sum(q.w * c.w) AS s FROM q JOIN c USING (key, d) GROUP BY 1),
    scored AS (
      SELECT conv_id, index, text, coalesce({r6("CASE WHEN qn.n * cn.n > 0 THEN s::DOUBLE / sqrt(qn.n::DOUBLE * cn.n::DOUBLE) END")}, 0) AS score
      FROM k LEFT JOIN qn USING (key) LEFT JOIN cn USING (key) LEFT JOIN dots USING (key))
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, index) AS rank, index,
           {r6("CASE WHEN conv_id % 2 = 0 THEN score ELSE (score + 1) / 2 END")} AS score,
           CASE WHEN conv_id % 5 = 0 THEN text END AS text, NULL::VARCHAR AS error_code
    FROM scored
    UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, 'INPUT_TOO_LONG' FROM failed
    """
)
def rerank_options(t: Tables):
    """Queries that share a limit with each text; the options of the first text hold."""
    i, first = F.col("conv_id"), F.col("index") == 0
    rows = rerank_requests(t).withColumns(
        {
            "truncate": F.when(i % 3 == 0, False),
            "direction": F.when(i % 2 == 0, "left"),
            "raw_scores": F.when(first, i % 2 == 0).otherwise(i % 2 != 0),
            "return_text": F.when(first, i % 5 == 0).otherwise(i % 5 != 0),
        }
    )
    found = calls.rerank_requests(rows, _RANK_LIMIT, query_id="conv_id", truncate=True)
    return found.withColumn("score", round6(F.col("score")))


def load_overlap():
    """A model from pairs of texts to a raw score: the distinct tokens that both have."""
    import re

    def score(pairs):
        sets = [[set(re.findall(tx.TOKEN, text.lower())) for text in pair] for pair in pairs]
        return [len(a & b) * 0.25 - 1 for a, b in sets]

    return score


@query(
    f"""
    WITH req AS (
      SELECT a.conv_id, b.turn - 1 AS index, {TOKENS.format("a.text")} AS la, {TOKENS.format("b.text")} AS lb
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn > 0),
    scored AS (SELECT conv_id, index, len(list_intersect(list_distinct(la), list_distinct(lb))) * 0.25::DOUBLE - 1 AS score FROM req)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, index) AS rank, index,
           {r6("CASE WHEN conv_id % 2 = 0 THEN score ELSE 1 / (1 + exp(-score)) END")} AS score
    FROM scored
    """
)
def rerank_model(t: Tables):
    """Ranks by a Python model of pairs."""
    model = encode.CallableEncoder("overlap", 1, "reranker", load_overlap, max_input_length=1 << 30)
    rows = rerank_requests(t).withColumn("raw_scores", F.col("conv_id") % 2 == 0)
    found = calls.rerank_requests(rows, 1 << 30, model, query_id="conv_id")
    return found.select("conv_id", "rank", "index", round6(F.col("score")).alias("score"))


@query("SELECT unnest(['lexical-dense', 'hashing', 'broken', 'short']) AS name, unnest(['verified', 'verified', 'failed', 'failed']) AS status")
def encoder_smoke(t: Tables):
    """Which of some encoders give one vector for a document's text."""
    text = t.documents.filter("text is not null").orderBy("doc_id").select("text").first()[0]
    models = [
        encode.LexicalDense(),
        encode.CallableEncoder("hashing", 64, "dense", load_hashing_once, max_input_length=1 << 30),
        encode.CallableEncoder("broken", 1, "dense", lambda: 1 / 0),
        encode.CallableEncoder("short", 1, "dense", lambda: lambda texts: texts[1:]),
    ]
    return encode.encoder_smoke(t.spark, models, text).select("name", "status")


def load_hashing_once():
    from textorbit.plans.text import load_hashing

    return load_hashing()
