"""Queries on text: requests, encoders, batching, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from textorbit.functions import text as tx
from textorbit.functions import vectors as vec
from textorbit.functions.formats import round6
from textorbit.operators import batch, calls, encode, requests, retrieval
from textorbit.plans.registry import Tables, query
from textorbit.session import cut

# SQL fragments of the checks.
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-zà-ÿß0-9]+'), lambda x: x <> '')"
HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
SIGN = "CASE WHEN ('0x' || substr(md5({0}), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END"


def toks(table: str, key: str, col: str = "text") -> str:
    return f"SELECT {key}, unnest({TOKENS.format(col)}) AS tok FROM {table}"


def weights(table: str, key: str, col: str = "text") -> str:
    """(key, d, w): non-zero signed weights."""
    return (
        f"SELECT {key}, {HASH.format('tok')} % 64 AS d, sum({SIGN.format('tok')})::BIGINT AS w"
        f" FROM ({toks(table, key, col)}) GROUP BY ALL HAVING w <> 0"
    )


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def exploded(df, key, vector):
    """(key, d, x): one row per vector entry, six decimals."""
    return tx.unroll(df, [key], vector, "x", "d").withColumn("x", round6(F.col("x").cast("double")))


# --- retrieval ---------------------------------------------------------------


@query(
    f"""
    WITH q AS ({weights("benchmark", "item_id")}), c AS ({weights("documents", "doc_id")}),
    qn AS (SELECT item_id, sum(w * w) AS n FROM q GROUP BY 1),
    cn AS (SELECT doc_id, sum(w * w) AS n FROM c GROUP BY 1),
    dots AS (SELECT item_id, doc_id, sum(q.w * c.w) AS s FROM q JOIN c USING (d) GROUP BY 1, 2),
    scored AS (
      SELECT qn.item_id, cn.doc_id,
             {r6("coalesce(s, 0)::DOUBLE / sqrt((qn.n * cn.n)::DOUBLE)")} AS score
      FROM qn CROSS JOIN cn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = cn.doc_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5
    """
)
def passage_top_k(t: Tables):
    encoder = encode.LexicalDense()
    queries = requests.drop_null_text(t.benchmark).select("item_id", encoder.weights(F.col("text")).alias("v"))
    corpus = requests.drop_null_text(t.spread("documents")).select("doc_id", encoder.weights(F.col("text")).alias("v"))
    return retrieval.top_k(queries, corpus, 5, encoder.dim, "item_id", "doc_id", "v")


_VECTOR_SCORES = f"""
    scored AS (
      SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, b.label,
             {r6('''list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))''')} AS score
      FROM e a CROSS JOIN e b),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM scored
      WHERE query_id <> corpus_id)
"""
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    f"""
    WITH {_E}, {_VECTOR_SCORES}
    SELECT query_id, corpus_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 3
    """
)
def vector_top_k(t: Tables):
    e = t.embeddings
    return retrieval.top_k(
        e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "corpus_id"), 3, 64, exclude_self=True
    )


def uneven(t: Tables):
    """Vectors of which every fiftieth lacks its last entry."""
    v = F.col("embedding")
    odd = F.col("vec_id") % 50 == 0
    return t.embeddings.select("vec_id", F.when(odd, F.slice(v, 1, 63)).otherwise(v).alias("embedding"))


@query(
    f"""
    WITH {_E}, {_VECTOR_SCORES.replace("FROM e a CROSS JOIN e b)", "FROM e a CROSS JOIN e b WHERE a.vec_id % 50 <> 0 AND b.vec_id % 50 <> 0)")}
    SELECT query_id, corpus_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 2
    UNION ALL SELECT vec_id, NULL, NULL, NULL FROM embeddings WHERE vec_id % 50 = 0
    """
)
def top_k_uneven(t: Tables):
    """Hits of the vectors of the common width; the others are listed without one."""
    rows = uneven(t)
    _, odd = retrieval.check_width(rows)
    even = rows.join(odd.select("vec_id"), "vec_id", "left_anti")
    hits = retrieval.top_k(
        even.withColumnRenamed("vec_id", "query_id"), even.withColumnRenamed("vec_id", "corpus_id"), 2, 64, exclude_self=True
    )
    return hits.unionByName(odd.select(F.col("vec_id").alias("query_id")), allowMissingColumns=True)


@query(
    f"""
    WITH {_E}, {_VECTOR_SCORES},
    votes AS (SELECT query_id, label, count(*) AS votes FROM ranked WHERE rank <= 5 GROUP BY 1, 2),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r,
             sum(votes) OVER (PARTITION BY query_id) AS n
      FROM votes)
    SELECT query_id, label, votes, {r6("votes / n::DOUBLE")} AS score FROM best WHERE r = 1
    """
)
def nearest_labelled(t: Tables):
    e = t.embeddings
    return retrieval.nearest_labelled(
        e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "corpus_id"), 5, 64, exclude_self=True
    )


@query(
    f"""
    WITH g AS (
      SELECT min(vec_id) AS id, count(*) AS copies, embedding::DOUBLE[] AS v
      FROM embeddings GROUP BY embedding)
    SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b,
           {r6("list_dot_product(a.v, b.v)")} AS score
    FROM g a JOIN g b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.4
    """
)
def similarity_join(t: Tables):
    return retrieval.similarity_join(t.embeddings, 0.4, "vec_id")


_DOC_PAIRS = f"""
    WITH w AS ({weights("documents", "doc_id")}),
    n AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM w GROUP BY 1),
    dims AS (SELECT unnest(range(64)) AS d),
    v AS (
      SELECT doc_id, list(CASE WHEN n > 0 THEN (coalesce(w, 0) / n)::FLOAT ELSE 0 END ORDER BY d)::DOUBLE[] AS v
      FROM documents CROSS JOIN dims LEFT JOIN w USING (doc_id, d) LEFT JOIN n USING (doc_id) GROUP BY 1),
    g AS (SELECT min(doc_id) AS id, count(*) AS copies, v FROM v GROUP BY v)
    SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b,
           {r6("list_dot_product(a.v, b.v)")} AS score
    FROM g a JOIN g b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.95
"""


@query(_DOC_PAIRS)
def similarity_join_documents(t: Tables):
    """Near copies among the documents, where pivots tell most of them apart."""
    return retrieval.similarity_join(encode.embed(t.documents.select("doc_id", "text")), 0.95, "doc_id")


@query(
    f"""
    WITH p AS ({_DOC_PAIRS}), e AS (
      SELECT id_a AS id, copies_a AS copies, id_b AS other, copies_b AS theirs, score FROM p UNION ALL
      SELECT id_b, copies_b, id_a, copies_a, score FROM p)
    SELECT id, copies, count(*) AS links, sum(theirs)::BIGINT AS linked_copies,
           arg_min(other, (-score, other)) AS best_id, max(score) AS score
    FROM e GROUP BY id, copies
    """
)
def similarity_links(t: Tables):
    """How many near copies each document has, and the nearest one."""
    return retrieval.similarity_links(encode.embed(t.documents.select("doc_id", "text")), 0.95, "doc_id")


@query()
def similarity_candidates(t: Tables):
    """The same pairs from random planes; some far ones are missed."""
    return retrieval.similarity_candidates(encode.embed(t.documents.select("doc_id", "text")), 0.95, "doc_id")


@query(
    f"""
    WITH {_E}
    SELECT a.vec_id AS id_a, b.vec_id AS id_b,
           {r6('''list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))''')} AS score
    FROM e a JOIN e b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 7)
    """
)
def pair_similarity(t: Tables):
    e = t.embeddings
    pairs = e.select(
        F.col("vec_id").alias("id_a"),
        F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("id_b"),
    )
    return retrieval.pair_similarity(pairs, e, e, "vec_id", "embedding")


_SPARSE = (
    f"SELECT doc_id, {HASH.format('tok')} % 30522 AS index, ln(1 + count(*))::FLOAT AS value"
    f" FROM ({toks('documents', 'doc_id')}) GROUP BY ALL"
)


def neighbours(t: Tables):
    """Each document with the next one by id, the last one with itself."""
    placed = batch.number_rows(t.documents.select("doc_id"), ["doc_id"], step=4096)
    after = placed.select((F.col("position") - 1).alias("position"), F.col("doc_id").alias("next_id"))
    pairs = placed.join(after, "position", "left")
    return pairs.select("doc_id", F.coalesce("next_id", "doc_id").alias("next_id"))


@query(
    f"""
    WITH s AS ({_SPARSE}), p AS (SELECT doc_id AS id_a, coalesce(lead(doc_id) OVER (ORDER BY doc_id), doc_id) AS id_b FROM documents),
    d AS (
      SELECT p.id_a, p.id_b, sum(a.value::DOUBLE * b.value::DOUBLE) AS dot, count(*) AS n
      FROM p JOIN s a ON a.doc_id = p.id_a JOIN s b ON b.doc_id = p.id_b AND a.index = b.index GROUP BY 1, 2)
    SELECT p.id_a, p.id_b, {r6("coalesce(dot, 0)")} AS dot, coalesce(n, 0) AS overlap
    FROM p LEFT JOIN d ON d.id_a = p.id_a AND d.id_b = p.id_b
    """
)
def sparse_pairs(t: Tables):
    # Both sides of the join read the encoded table; encode once.
    docs = cut(encode.embed_sparse(t.spread("documents").select("doc_id", "text")).drop("text"))
    return retrieval.sparse_pairs(neighbours(t).withColumnsRenamed({"doc_id": "id_a", "next_id": "id_b"}), docs, docs, "doc_id")


@query(
    """
    SELECT min(len(embedding))::INTEGER AS min_width, max(len(embedding))::INTEGER AS max_width,
           count(*) AS n_rows, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings
    """
)
def vector_width(t: Tables):
    return retrieval.check_width(t.embeddings)[0]


@query("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0")
def vector_width_violations(t: Tables):
    return retrieval.check_width(uneven(t))[1].select("vec_id")


# --- request rows --------------------------------------------------------------


@query("SELECT doc_id, text FROM documents")
def text_source(t: Tables):
    return requests.text_source(t.spread("documents"), "text", ["doc_id"])


_NULLED = "SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN text END AS text FROM documents"


def texts_with_nulls(t: Tables):
    return t.spread("documents").select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("text")).alias("text"))


@query(f"SELECT doc_id, text FROM ({_NULLED}) WHERE text IS NOT NULL")
def drop_null_text(t: Tables):
    return requests.drop_null_text(texts_with_nulls(t))


@query(
    """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN false ELSE true END AS truncate, true AS normalize,
           'right' AS direction, CASE WHEN lang = 'en' THEN 'query' ELSE 'passage' END AS prompt_name,
           32 AS dimensions
    FROM documents
    """
)
def request_params(t: Tables):
    rows = t.spread("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, False).alias("truncate"),
        F.when(F.col("lang") == "en", "query").alias("prompt_name"),
    )
    return requests.request_params(rows, truncate=True, prompt_name="passage", dimensions=32)


def routed_requests(t: Tables):
    """Requests whose target is a name, an empty name, nothing, a model or an index."""
    i = F.col("event_id")
    name = F.when(i % 97 == 0, "").when(
        (i % 89 != 0) & (i % 83 != 0) & (i % 79 != 0), F.concat(F.lit("inst-"), (F.col("user_id") % 200).cast("string"))
    )
    target = requests.target_struct(name, F.when(i % 89 == 0, "m"), F.when(i % 83 == 0, 0))
    return t.events.select("event_id", "user_id", "ts", F.when(i % 101 != 0, target).alias("target"))


ROUTED = """
    routed AS (
      SELECT event_id, user_id, ts, CASE WHEN event_id % 101 = 0 THEN 'INVALID_ARGUMENT'
             WHEN event_id % 97 = 0 THEN 'INVALID_ARGUMENT'
             WHEN event_id % 89 = 0 OR event_id % 83 = 0 THEN 'UNIMPLEMENTED'
             WHEN event_id % 79 = 0 THEN 'INVALID_ARGUMENT' END AS error_code,
             'inst-' || (user_id % 200) AS wanted
      FROM events)
"""


@query(
    f"""
    WITH {ROUTED}
    SELECT event_id, error_code, CASE WHEN error_code IS NULL THEN wanted END AS instance FROM routed
    """
)
def resolve_target(t: Tables):
    return requests.resolve_target(routed_requests(t)).drop("target", "user_id", "ts")


@query(
    """
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'INVALID_ARGUMENT' END AS error_code FROM events
    """
)
def require_request(t: Tables):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("request"))
    return requests.require_request(rows).drop("request")


_ALL_TOKENS = TOKENS.format("text")


@query(
    f"""
    WITH x AS (SELECT doc_id, {_ALL_TOKENS} AS l FROM documents)
    SELECT doc_id, array_to_string(l[1:16], ' ') AS head,
           array_to_string(l[greatest(len(l) - 15, 1):], ' ') AS tail,
           CASE WHEN len(l) > 16 THEN 'INPUT_TOO_LONG' END AS error_code FROM x
    """
)
def truncate_tokens(t: Tables):
    docs = t.spread("documents").select("doc_id", "text")
    rows = requests.truncated(docs, 16, truncate=False)
    toks_ = tx.tokens(F.col("text"))
    return rows.select(
        "doc_id",
        F.array_join(tx.truncate_tokens(toks_, 16, "right"), " ").alias("head"),
        F.array_join(tx.truncate_tokens(toks_, 16, "left"), " ").alias("tail"),
        "error_code",
    )


@query(
    f"""
    WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::FLOAT)::DOUBLE[] AS v FROM embeddings),
    u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s)
    SELECT vec_id, unnest(range(len(v))) AS d, {r6("(unnest(v) / n)::FLOAT::DOUBLE")} AS x FROM u
    """
)
def l2_normalize(t: Tables):
    scaled = t.embeddings.select(
        "vec_id", F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float")).alias("v")
    )
    return exploded(scaled, "vec_id", vec.l2_normalize(F.col("v")))


@query(
    f"""
    WITH s AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings),
    u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s)
    SELECT vec_id, unnest(range(16)) AS d, {r6("(unnest(v) / n)::FLOAT::DOUBLE")} AS x FROM u
    """
)
def cut_dimensions(t: Tables):
    return exploded(t.embeddings, "vec_id", vec.cut_dimensions(F.col("embedding"), 16))


@query(
    """
    SELECT doc_id, CASE WHEN lang = 'en' THEN 'query: ' || text WHEN lang = 'de' THEN text
           WHEN lang = 'fr' THEN 'passage: ' || text END AS text,
           CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'UNKNOWN_PROMPT' END AS error_code
    FROM documents
    """
)
def apply_prompt(t: Tables):
    name = F.when(F.col("lang") == "en", "query").when(F.col("lang") == "fr", "passage").when(
        F.col("lang") != "de", F.col("lang")
    )
    rows = t.spread("documents").select("doc_id", "text", name.alias("prompt_name"))
    return requests.apply_prompt(rows, {"query": "query: ", "passage": "passage: "}).drop("prompt_name")


@query(
    f"""
    SELECT doc_id, length(text) AS compute_chars, strlen(text) AS request_bytes,
           len({_ALL_TOKENS}) AS compute_tokens FROM documents
    """
)
def call_metadata(t: Tables):
    return requests.call_metadata(t.spread("documents").select("doc_id", "text")).drop("text")


# Written out, so that a wrong entry of the operator's table shows.
_KIND_VALUES = """
  (0, 'InstanceNotFound', 404, 'INSTANCE_NOT_FOUND', 'NOT_FOUND'), (1, 'ModelNotFound', 404, 'MODEL_NOT_FOUND', 'NOT_FOUND'),
  (2, 'ModelDownloadFailed', 500, 'MODEL_DOWNLOAD_FAILED', 'INTERNAL'), (3, 'ModelLoadFailed', 500, 'MODEL_LOAD_FAILED', 'INTERNAL'),
  (4, 'ModelBusy', 409, 'MODEL_BUSY', 'ALREADY_EXISTS'), (5, 'InstanceExists', 409, 'INSTANCE_EXISTS', 'ALREADY_EXISTS'),
  (6, 'PortConflict', 409, 'PORT_CONFLICT', 'ALREADY_EXISTS'),
  (7, 'MaxInstancesReached', 422, 'MAX_INSTANCES_REACHED', 'RESOURCE_EXHAUSTED'),
  (8, 'InvalidInstanceState', 400, 'INVALID_INSTANCE_STATE', 'INVALID_ARGUMENT'),
  (9, 'InvalidConfig', 400, 'INVALID_CONFIG', 'INVALID_ARGUMENT'), (10, 'InvalidPort', 400, 'INVALID_PORT', 'INVALID_ARGUMENT'),
  (11, 'InvalidGpuId', 400, 'INVALID_GPU_ID', 'INVALID_ARGUMENT'),
  (12, 'InvalidInstanceName', 400, 'INVALID_INSTANCE_NAME', 'INVALID_ARGUMENT'),
  (13, 'PortAllocationFailed', 422, 'PORT_ALLOCATION_FAILED', 'RESOURCE_EXHAUSTED'),
  (14, 'Unauthenticated', 401, 'UNAUTHENTICATED', 'UNAUTHENTICATED'), (15, 'Forbidden', 403, 'FORBIDDEN', 'PERMISSION_DENIED'),
  (16, 'ValidationError', 400, 'VALIDATION_ERROR', 'INVALID_ARGUMENT'), (17, 'MissingField', 400, 'MISSING_FIELD', 'INVALID_ARGUMENT'),
  (18, 'BackendUnavailable', 503, 'BACKEND_UNAVAILABLE', 'UNAVAILABLE'), (19, 'Timeout', 504, 'TIMEOUT', 'DEADLINE_EXCEEDED'),
  (20, 'Internal', 500, 'INTERNAL_ERROR', 'INTERNAL'), (21, 'IoError', 500, 'IO_ERROR', 'INTERNAL')
"""


@query(
    f"""
    WITH kinds(i, error_kind, http_status, code, rpc_status) AS (VALUES {_KIND_VALUES})
    SELECT event_id, error_kind, http_status, code, rpc_status,
           http_status < 500 AS is_client_error, http_status >= 500 AS is_server_error
    FROM events JOIN kinds ON i = event_id % 22
    """
)
def error_taxonomy(t: Tables):
    names = F.array(*[F.lit(k) for k, *_ in requests.ERROR_KINDS])
    rows = t.events.select("event_id", F.get(names, (F.col("event_id") % 22).cast("int")).alias("error_kind"))
    return requests.error_taxonomy(rows)


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN replace(p_name, ' ', '/') || '+' || p_brand END AS model_id,
           CASE WHEN p_partkey % 13 = 0 THEN 'VALIDATION_ERROR' END AS error_code FROM part
    """
)
def decode_model_ref(t: Tables):
    clean = F.concat(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("%2F")), F.lit("+"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("%23"))
    )
    ref = F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("%FF"), clean)).otherwise(clean)
    return requests.decode_model_ref(t.part.select("p_partkey", ref.alias("model_ref"))).drop("model_ref")


@query("SELECT p_partkey, p_size % 9 < 4 OR p_size % 9 = 8 AS device_ok FROM part")
def valid_device(t: Tables):
    gpu = F.col("p_size") % 9
    return requests.valid_device(t.part.select("p_partkey", F.when(gpu != 8, gpu).alias("gpu_id")), 4).drop("gpu_id")


# --- encoders --------------------------------------------------------------------

_UNIT = """
    n AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM w GROUP BY 1),
    dims AS (SELECT unnest(range(64)) AS d)
"""


@query(
    f"""
    WITH w AS ({weights("documents", "doc_id")}), {_UNIT}
    SELECT doc_id, d, CASE WHEN n > 0 THEN {r6("(coalesce(w, 0) / n)::FLOAT::DOUBLE")} ELSE 0.0 END AS x
    FROM documents CROSS JOIN dims LEFT JOIN w USING (doc_id, d) LEFT JOIN n USING (doc_id)
    """
)
def embed(t: Tables):
    return exploded(encode.embed(t.spread("documents").select("doc_id", "text")), "doc_id", "embedding")


_SHORT = "(SELECT conv_id * 1000 + turn AS key, text FROM conversations)"


@query(
    f"""
    WITH w AS ({weights(_SHORT, "key")}), n AS (SELECT key, sqrt(sum(w * w)::DOUBLE) AS n FROM w GROUP BY 1),
    dims AS (SELECT unnest(range(64)) AS d)
    SELECT key, d, CASE WHEN n > 0 THEN {r6("(coalesce(w, 0) / n)::FLOAT::DOUBLE")} ELSE 0.0 END AS x
    FROM {_SHORT} CROSS JOIN dims LEFT JOIN w USING (key, d) LEFT JOIN n USING (key)
    """
)
def embed_short_texts(t: Tables):
    """Turns of conversations: texts of a few hundred characters."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    return exploded(encode.embed(t.spread("conversations").select(key.alias("key"), "text")), "key", "embedding")


def load_hashing():
    """The lexical vector as a user's model would compute it, in Python."""
    import re
    from hashlib import md5

    def encode_texts(texts):
        out = []
        for text in texts:
            weights = [0] * 64
            for token in re.findall(tx.TOKEN, text.lower()):
                digest = md5(token.encode()).hexdigest()
                weights[int(digest[:8], 16) % 64] += 1 - 2 * (int(digest[8], 16) % 2)
            out.append([float(w) for w in weights])
        return out

    return encode_texts


@query(
    f"""
    WITH w AS ({weights("documents", "doc_id")}), {_UNIT}
    SELECT CASE WHEN doc_id % 50 <> 0 THEN doc_id + 9007199254740993 END AS key, doc_id, d,
           CASE WHEN doc_id % 7 = 0 THEN NULL WHEN n > 0 THEN {r6("(coalesce(w, 0) / n)::FLOAT::DOUBLE")} ELSE 0.0 END AS x
    FROM documents CROSS JOIN dims LEFT JOIN w USING (doc_id, d) LEFT JOIN n USING (doc_id)
    """
)
def embed_model(t: Tables):
    """A Python model beside nullable keys above 2^53; every seventh text is null."""
    key = F.when(F.col("doc_id") % 50 != 0, F.col("doc_id") + 9007199254740993)
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    model = encode.CallableEncoder("hashing", 64, "dense", load_hashing, max_input_length=1 << 30)
    rows = encode.embed(t.spread("documents").select(key.alias("key"), "doc_id", text.alias("text")), encoder=model)
    none = F.array_repeat(F.lit(None).cast("float"), 64)
    return tx.unroll(rows, ["key", "doc_id"], F.coalesce("embedding", none), "x", "d").withColumn(
        "x", round6(F.col("x").cast("double"))
    )


@query(
    f"""
    WITH r AS (
      SELECT doc_id, CASE lang WHEN 'en' THEN 'query: ' WHEN 'fr' THEN 'passage: ' WHEN 'de' THEN '' END || text AS text,
             doc_id % 3 <> 0 AS may_cut, doc_id % 2 = 0 AS from_left, doc_id % 5 <> 0 AS unit,
             CASE WHEN doc_id % 11 = 0 THEN 65 WHEN doc_id % 4 = 0 THEN 16 ELSE 64 END AS dims
      FROM documents),
    l AS (SELECT *, {TOKENS.format("text")} AS l FROM r),
    e AS (
      SELECT *, CASE WHEN text IS NULL THEN 'UNKNOWN_PROMPT' WHEN len(l) > 200 AND NOT may_cut THEN 'INPUT_TOO_LONG'
                     WHEN dims > 64 THEN 'INVALID_ARGUMENT' END AS error_code FROM l),
    tk AS (
      SELECT doc_id, unnest(CASE WHEN len(l) <= 200 THEN l WHEN from_left THEN l[len(l) - 199:] ELSE l[1:200] END) AS tok
      FROM e WHERE error_code IS NULL),
    w AS (SELECT doc_id, {HASH.format("tok")} % 64 AS d, sum({SIGN.format("tok")})::BIGINT AS w FROM tk GROUP BY ALL),
    x AS (
      SELECT e.doc_id, dims.d, coalesce(w, 0) AS w, unit, sqrt(sum(coalesce(w, 0) * coalesce(w, 0)) OVER (PARTITION BY e.doc_id)::DOUBLE) AS n
      FROM e JOIN (SELECT unnest(range(64)) AS d) dims ON dims.d < e.dims LEFT JOIN w ON w.doc_id = e.doc_id AND w.d = dims.d
      WHERE error_code IS NULL)
    SELECT e.doc_id, error_code, len(l)::BIGINT AS compute_tokens, x.d,
           {r6("(CASE WHEN x.d IS NULL THEN NULL WHEN NOT x.unit THEN w WHEN n > 0 THEN w / n ELSE 0 END)::FLOAT::DOUBLE")} AS x
    FROM e LEFT JOIN x ON x.doc_id = e.doc_id
    """
)
def embed_request_options(t: Tables):
    """Requests with prompts, cuts, widths and scaling of their own."""
    i = F.col("doc_id")
    rows = t.spread("documents").select(
        "doc_id",
        "text",
        F.when(F.col("lang") == "en", "query").when(F.col("lang") == "fr", "passage").when(F.col("lang") != "de", "none").alias("prompt_name"),
        F.when(i % 3 == 0, False).alias("truncate"),
        F.when(i % 2 == 0, "left").alias("direction"),
        F.when(i % 5 == 0, False).alias("normalize"),
        F.when(i % 11 == 0, 65).when(i % 4 == 0, 16).alias("dimensions"),
    )
    prompts = {"query": "query: ", "passage": "passage: "}
    found = calls.embed_requests(rows, prompts, 200, truncate=True, direction="right", normalize=True)
    entries = F.transform("embedding", lambda x, d: F.struct(d.cast("long").alias("d"), x.alias("x")))
    return found.select(
        "doc_id", "error_code", F.col("metadata.compute_tokens").alias("compute_tokens"), F.explode_outer(entries).alias("e")
    ).select("doc_id", "error_code", "compute_tokens", "e.d", round6(F.col("e.x").cast("double")).alias("x"))


@query(
    f"""
    WITH w AS ({weights("documents", "doc_id")}), {_UNIT}
    SELECT doc_id, d, CASE WHEN n > 0 THEN {r6("(coalesce(w, 0) / n)::FLOAT::DOUBLE")} ELSE 0.0 END AS x
    FROM documents CROSS JOIN dims LEFT JOIN w USING (doc_id, d) LEFT JOIN n USING (doc_id)
    WHERE doc_id % 50 <> 0
    """
)
def embed_drop_nulls(t: Tables):
    return exploded(encode.embed(texts_with_nulls(t), null_policy="drop"), "doc_id", "embedding")


@query(f"SELECT doc_id, index, {r6('value::DOUBLE')} AS value FROM ({_SPARSE})")
def embed_sparse(t: Tables):
    rows = encode.embed_sparse(t.spread("documents").select("doc_id", "text"))
    return tx.unroll(rows, ["doc_id"], "sparse", "s").select(
        "doc_id", "s.index", round6(F.col("s.value").cast("double")).alias("value")
    )


_POOLED = f"""
    WITH tk AS ({toks("documents", "doc_id")}),
    digits AS (SELECT doc_id, md5(tok) AS h, unnest(range(32)) AS d FROM tk),
    v AS (SELECT doc_id, d, ((2 * (instr('0123456789abcdef', substr(h, d::INTEGER + 1, 1)) - 1) - 15) / 15.0::DOUBLE)::FLOAT::DOUBLE AS x FROM digits)
    SELECT doc_id, d, count(*) AS n_tokens, {r6("sum(x) / count(*)")} AS x FROM v GROUP BY 1, 2
"""


@query(_POOLED)
def embed_all_mean_pool(t: Tables):
    rows = encode.embed_all(t.spread("documents").select("doc_id", "text"))
    pooled = rows.select(
        "doc_id",
        F.size("token_embeddings").cast("long").alias("n_tokens"),
        vec.mean_pool(F.col("token_embeddings")).alias("v"),
    )
    return tx.unroll(pooled, ["doc_id", "n_tokens"], "v", "x", "d").withColumn("x", round6(F.col("x")))


@query(
    f"""
    SELECT doc_id, unnest(range(len(l))) AS position, {r6("((2 * (instr('0123456789abcdef', substr(md5(unnest(l)), 1, 1)) - 1) - 15) / 15.0::DOUBLE)::FLOAT::DOUBLE")} AS first_x
    FROM (SELECT doc_id, {_ALL_TOKENS} AS l FROM documents)
    """
)
def embed_all_rows(t: Tables):
    rows = encode.embed_all(t.spread("documents").select("doc_id", "text"), explode_tokens=True)
    return rows.select(
        "doc_id",
        "position",
        round6(F.get("embedding", F.lit(0)).cast("double")).alias("first_x"),
    )


def label_weights(labels: int = 3, dim: int = 64) -> dict[str, list[float]]:
    return {f"label-{k}": [((d * (k + 2)) % 7 - 3) / 10 for d in range(dim)] for k in range(labels)}


_LABELS = "lab AS (SELECT unnest(range(3)) AS k)"
def _labelled(rows, key="doc_id"):
    return tx.unroll(rows, [key], "predictions", "p").select(
        key, "p.label", F.round(F.col("p.score").cast("double"), 4).alias("score")
    )


def _softmax_sql(raw: str) -> str:
    return f"""
    WITH {raw},
    m AS (SELECT key, max(raw) AS top FROM raw GROUP BY 1),
    z AS (SELECT key, sum(exp(raw - top)) AS total FROM raw JOIN m USING (key) GROUP BY 1)
    SELECT key AS doc_id, 'label-' || k AS label, round((exp(raw - top) / total)::FLOAT::DOUBLE, 4) AS score
    FROM raw JOIN m USING (key) JOIN z USING (key)
    """


@query(
    _softmax_sql(
        f"""
    w AS ({weights("documents", "doc_id")}), {_UNIT}, {_LABELS},
    raw AS (
      SELECT documents.doc_id AS key, k, coalesce(sum((w.w / n.n)::FLOAT::DOUBLE * ((w.d * (k + 2)) % 7 - 3) / 10), 0) AS raw
      FROM documents CROSS JOIN lab LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY ALL)
    """
    )
)
def predict(t: Tables):
    model = encode.LinearClassifier(label_weights())
    return _labelled(encode.predict(t.spread("documents").select("doc_id", "text"), model))


@query(
    _softmax_sql(
        f"""
    next AS (SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id), doc_id) AS next_id FROM documents),
    pairs AS (SELECT a.doc_id, a.text AS ta, b.text AS tb FROM documents a JOIN next USING (doc_id) JOIN documents b ON b.doc_id = next_id),
    wa AS ({weights("pairs", "doc_id", "ta")}), wb AS ({weights("pairs", "doc_id", "tb")}),
    na AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM wa GROUP BY 1),
    nb AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM wb GROUP BY 1), {_LABELS},
    prod AS (
      SELECT doc_id, d, ((wa.w / na.n)::FLOAT * (wb.w / nb.n)::FLOAT)::FLOAT::DOUBLE AS x
      FROM wa JOIN wb USING (doc_id, d) JOIN na USING (doc_id) JOIN nb USING (doc_id)),
    raw AS (
      SELECT pairs.doc_id AS key, k, coalesce(sum(x * ((d * (k + 2)) % 7 - 3) / 10), 0) AS raw
      FROM pairs CROSS JOIN lab LEFT JOIN prod USING (doc_id) GROUP BY ALL)
    """
    )
)
def predict_pair(t: Tables):
    d = t.spread("documents").select("doc_id", "text")
    other = d.select(F.col("doc_id").alias("next_id"), F.col("text").alias("other"))
    pairs = d.join(neighbours(t), "doc_id").join(other, "next_id").select("doc_id", F.array("text", "other").alias("texts"))
    return _labelled(encode.predict_pair(pairs, encode.LinearClassifier(label_weights())))


_RERANK_ROWS = """
    req AS (
      SELECT a.conv_id, a.text AS query, b.turn - 1 AS index, b.text
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn > 0)
"""


def rerank_requests(t: Tables):
    c = t.spread("conversations")
    first = c.filter("turn = 0").select("conv_id", F.col("text").alias("query"))
    return c.filter("turn > 0").join(first, "conv_id").select(
        "conv_id", (F.col("turn") - 1).alias("index"), "query", "text"
    )


@query(
    f"""
    WITH {_RERANK_ROWS},
    k AS (SELECT conv_id || '/' || index AS key, * FROM req),
    q AS ({weights("k", "key", "query")}), c AS ({weights("k", "key", "text")}),
    qn AS (SELECT key, sum(w * w) AS n FROM q GROUP BY 1), cn AS (SELECT key, sum(w * w) AS n FROM c GROUP BY 1),
    dots AS (SELECT key, sum(q.w * c.w) AS s FROM q JOIN c USING (key, d) GROUP BY 1),
    scored AS (
      SELECT conv_id, index, coalesce({r6("s::DOUBLE / sqrt(qn.n::DOUBLE * cn.n::DOUBLE)")}, 0) AS score
      FROM k LEFT JOIN qn USING (key) LEFT JOIN cn USING (key) LEFT JOIN dots USING (key))
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, index) AS rank, index, score
    FROM scored
    """
)
def rerank(t: Tables):
    return encode.rerank(rerank_requests(t), "conv_id")


_SEGMENTS = f"""
    seg AS (SELECT doc_id, regexp_extract_all(lower(text), '[^a-zà-ÿß0-9]*[a-zà-ÿß0-9]+') AS l FROM documents),
    pos AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS s FROM seg),
    ends AS (
      SELECT doc_id, i, regexp_extract(s, '[a-zà-ÿß0-9]+$') AS tok,
             sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM pos),
    body AS (
      SELECT doc_id, i + 1 AS position, {HASH.format("tok")} % 30522 AS id, tok AS token, false AS special,
             stop - length(tok) AS start, stop FROM ends),
    sizes AS (SELECT doc_id, len(l) AS n FROM seg)
"""


@query(
    f"""
    WITH {_SEGMENTS}
    SELECT * FROM body
    UNION ALL SELECT doc_id, 0, 30522, '<s>', true, NULL, NULL FROM sizes
    UNION ALL SELECT doc_id, n + 1, 30523, '</s>', true, NULL, NULL FROM sizes
    """
)
def tokenize(t: Tables):
    rows = encode.tokenize(t.spread("documents").select("doc_id", "text"))
    return tx.unroll(rows, ["doc_id"], "tokens", "t", "position").select(
        "doc_id", "position", "t.id", F.col("t.text").alias("token"),
        "t.special", "t.start", "t.stop",
    )


@query(
    f"""
    WITH tk AS (SELECT doc_id, {_ALL_TOKENS} AS l FROM documents),
    u AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS tok FROM tk),
    v AS (SELECT {HASH.format("tok")} % 30522 AS id, min(tok) AS token FROM u GROUP BY 1),
    d AS (
      SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS decoded
      FROM u JOIN v ON v.id = {HASH.format("tok")} % 30522 GROUP BY 1)
    SELECT doc_id, coalesce(decoded, '') AS decoded FROM documents LEFT JOIN d USING (doc_id)
    """
)
def decode(t: Tables):
    docs = t.spread("documents").select("doc_id", "text")
    ids = encode.tokenize(docs, offsets=False).select("doc_id", F.transform("tokens", lambda x: x["id"]).alias("ids"))
    return encode.decode(ids, encode.vocabulary(docs), out="decoded").drop("ids")


@query(
    """
    WITH v AS (
      SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a' || chr(10) || 'b' ELSE source END AS token FROM documents),
    n AS (SELECT max(doc_id) AS n FROM documents),
    d AS (SELECT doc_id, (SELECT token FROM v WHERE id = doc_id) AS one, (SELECT token FROM v WHERE id = doc_id + 1) AS two FROM documents)
    SELECT doc_id, form, CASE WHEN doc_id % 9 <> 0 THEN concat_ws(' ', one, two, one) END AS decoded
    FROM d CROSS JOIN (VALUES ('inline'), ('joined')) f(form)
    """
)
def decode_odd_tokens(t: Tables):
    """Empty tokens, line feeds and ids beyond any vocabulary, by both ways of decoding."""
    i = F.col("doc_id")
    token = F.when(i % 5 == 0, "").when(i % 5 == 1, "a\nb").otherwise(F.col("source"))
    vocab = t.documents.select(i.alias("id"), token.alias("token"))
    ids = F.array(i, F.lit(1 << 40), i + 1, F.lit(-3).cast("long"), F.lit(None).cast("long"), i)
    rows = t.documents.select("doc_id", F.when(i % 9 != 0, ids).alias("ids"))
    most = (t.documents.agg(F.max("doc_id")).first()[0] or 0) + 1
    forms = [
        encode.decode(rows, vocab, "doc_id", dim=most, out="decoded", inline_bytes=size).withColumn("form", F.lit(form))
        for form, size in (("inline", encode.INLINE_BYTES), ("joined", 0))
    ]
    return forms[0].unionByName(forms[1]).drop("ids")


@query("SELECT doc_id, 384::BIGINT AS width, 0.0::DOUBLE AS total FROM documents")
def embed_noop(t: Tables):
    rows = encode.embed(texts_with_nulls(t), noop=True)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("embedding").cast("long").alias("width"), total.alias("total"))


@query(
    """
    WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT doc_id, i + s.shift AS index, s.value FROM p
    CROSS JOIN (VALUES (0, 1.0::DOUBLE), (100, 0.5::DOUBLE), (200, 0.25::DOUBLE)) s(shift, value)
    """
)
def embed_sparse_noop(t: Tables):
    rows = encode.embed_sparse(texts_with_nulls(t), noop_order=["doc_id"], noop_step=1 << 20)
    return tx.unroll(rows, ["doc_id"], "sparse", "s").select(
        "doc_id", "s.index", F.col("s.value").cast("double").alias("value")
    )


@query(
    f"""
    WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    x AS (SELECT vec_id, unnest(range(64)) AS j, unnest(v) AS x FROM p),
    m AS (
      SELECT vec_id, j % 16 AS index,
             max(ln(1 + greatest(x, 0)) * CASE WHEN j // 16 = 3 AND vec_id % 2 = 1 THEN 0 ELSE 1 END)::FLOAT AS value
      FROM x GROUP BY 1, 2)
    SELECT vec_id, index, {r6("value::DOUBLE")} AS value FROM m WHERE value <> 0
    """
)
def splade_pool(t: Tables):
    rows = t.embeddings.select(
        "vec_id",
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice("embedding", p * 16 + 1, F.lit(16))).alias("logits"),
        F.when(F.col("vec_id") % 2 == 1, F.array(*[F.lit(i) for i in (1, 1, 1, 0)])).otherwise(
            F.array(*[F.lit(1)] * 4)
        ).alias("mask"),
    )
    pooled = tx.unroll(rows, ["vec_id"], vec.splade_pool(F.col("logits"), F.col("mask")), "s")
    return pooled.select("vec_id", "s.index", round6(F.col("s.value").cast("double")).alias("value"))


# --- batching ----------------------------------------------------------------------


@query(
    """
    SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id,
           (row_number() OVER (ORDER BY doc_id) - 1) % 64 AS batch_pos FROM documents
    """
)
def assign_batches(t: Tables):
    return batch.assign_batches(t.spread("documents").select("doc_id"), ["doc_id"], 64, step=256)


@query(
    """
    WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS p FROM documents)
    SELECT doc_id, lang, p // 16 AS batch_id, p % 16 AS batch_pos FROM p
    """
)
def assign_batches_by_length(t: Tables):
    rows = t.spread("documents").select("doc_id", "lang", "n_chars")
    return batch.assign_batches(rows, ["n_chars", "doc_id"], 16, ["lang"]).drop("n_chars")


@query(
    """
    SELECT user_id AS run_id, sum(CASE WHEN event_type <> 'error' THEN event_id % 64 ELSE 0 END)::BIGINT AS successful,
           sum(CASE WHEN event_type = 'error' THEN 64 ELSE 0 END)::BIGINT AS failed, count(*) AS num_requests
    FROM events GROUP BY 1
    """
)
def batch_outcomes(t: Tables):
    rows = t.events.select(
        F.col("user_id").alias("run_id"),
        F.lit(64).alias("batch_rows"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 64).alias("rows_returned"),
    )
    return batch.batch_outcomes(rows)


@query(
    f"""
    WITH RECURSIVE n AS (
      SELECT doc_id, len({_ALL_TOKENS})::INTEGER AS n_tokens, {HASH.format("doc_id::VARCHAR")} % 8 AS bucket FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n_tokens DESC, doc_id) AS i FROM n),
    p AS (
      SELECT o.*, 0 AS pack, n_tokens::BIGINT AS used FROM o WHERE i = 1
      UNION ALL
      SELECT o.*, CASE WHEN p.used > 0 AND p.used + o.n_tokens > 16384 THEN p.pack + 1 ELSE p.pack END,
             CASE WHEN p.used > 0 AND p.used + o.n_tokens > 16384 THEN o.n_tokens ELSE p.used + o.n_tokens END
      FROM p JOIN o ON o.bucket = p.bucket AND o.i = p.i + 1)
    SELECT doc_id, n_tokens, bucket || '-' || pack AS pack_id, used AS pack_tokens FROM p
    """
)
def pack_by_tokens(t: Tables):
    rows = t.spread("documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"))
    return batch.pack_by_tokens(rows, 16384, buckets=8)


@query(
    f"""
    WITH s AS (SELECT doc_id, count(DISTINCT {HASH.format("tok")} % 30522) AS n FROM ({toks("documents", "doc_id")}) GROUP BY 1),
    p AS (SELECT doc_id, coalesce(n, 0) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents LEFT JOIN s USING (doc_id))
    SELECT doc_id, p // 64 AS batch_id, p % 64 AS batch_pos,
           (sum(n) OVER (PARTITION BY p // 64 ORDER BY p))::BIGINT AS stop_offset,
           (sum(n) OVER (PARTITION BY p // 64 ORDER BY p) - n)::BIGINT AS start_offset
    FROM p
    """
)
def sparse_offsets(t: Tables):
    rows = t.spread("documents").select("doc_id", F.size(tx.sparse_counts(F.col("text"))).cast("long").alias("n"))
    batched = batch.assign_batches(rows, ["doc_id"], 64, step=1 << 20)
    return batch.sparse_offsets(batched, F.col("n")).drop("n")
