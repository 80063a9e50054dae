"""Encoder operators with each request's own options, for lexical encoders and user's models alike.

A row is a request.  Options are columns of the row where it has them and the value is not
null, else keyword arguments: ``truncate``, ``direction``, and where they apply
``prompt_name``, ``dimensions``, ``normalize``, ``raw_scores``, ``return_text``.  Each operator adds its
result, ``error_code`` and ``metadata`` (characters, bytes and tokens of the prompted text).  A row
with an error, or without a text, has no result; it never ends the job.

Errors: UNKNOWN_PROMPT; INPUT_TOO_LONG for more than ``max_len`` tokens that may not be cut;
INVALID_ARGUMENT for a width the encoder doesn't have, or no pair of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textorbit import schemas
from textorbit.functions import text as tx
from textorbit.functions import vectors as vec
from textorbit.operators import encode, requests
from textorbit.operators.scan import ranked


def token_spans(text: str, pattern: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(pattern, text, re.IGNORECASE)]


def cut_text(text: str, limit: int, left: bool, pattern: str = tx.TOKEN) -> str:
    """The part of a text with its first or last ``limit`` tokens, otherwise as it was."""
    spans = token_spans(text, pattern)
    if len(spans) <= limit:
        return text
    if limit == 0:
        return ""
    return text[spans[-limit][0] :] if left else text[: spans[limit - 1][1]]


def _cutter(pattern: str) -> Callable[..., Column]:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, limits: pd.Series, lefts: pd.Series) -> pd.Series:
        rows = zip(texts, limits, lefts, strict=True)
        return pd.Series([None if t is None else cut_text(t, int(n), bool(b), pattern) for t, n, b in rows], dtype=object)

    return cut


def _option(df: DataFrame, name: str, default: Any) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def _metadata(texts: list[Column], tokens: Column) -> Column:
    total = lambda f: sum((f(t) for t in texts[1:]), f(texts[0])).cast("long")
    costs = F.struct(
        total(F.length).alias("compute_chars"), total(F.octet_length).alias("request_bytes"), tokens.cast("long").alias("compute_tokens")
    )
    return F.when(F.coalesce(*[F.when(t.isNull(), True) for t in texts], F.lit(False)), None).otherwise(costs)


def _limits(encoder: Any, max_len: int) -> tuple[int, str]:
    """The tighter of both limits, and the pattern that counts tokens."""
    return min(max_len, getattr(encoder, "max_input_length", max_len)), getattr(encoder, "tokens", tx.TOKEN)


def _prepared(df: DataFrame, encoder: Any, max_len: int, text_col: str, prompts: dict[str, str], defaults: dict) -> DataFrame:
    """Rows with ``_kept``, the text within the limit or null, and ``error_code`` and ``metadata``."""
    limit, pattern = _limits(encoder, max_len)
    rows = requests.apply_prompt(requests.request_params(df, **defaults), prompts, text_col)
    text = F.col(text_col)
    rows = rows.withColumn("_tokens", _count(text, pattern))
    long = F.col("_tokens") > limit
    error = F.coalesce("error_code", F.when(long & ~F.col("truncate"), "INPUT_TOO_LONG"))
    rows = rows.withColumn("error_code", error)
    cut = _cutter(pattern)(F.when(long & F.col("error_code").isNull(), text), F.lit(limit), F.col("direction") == "left")
    kept = F.when(F.col("error_code").isNull(), F.coalesce(cut, text))
    return rows.withColumns({"_kept": kept, "metadata": _metadata([text], F.col("_tokens"))}).drop("_tokens")


def _encoded(rows: DataFrame, encoder: Any, out: str, kind: T.DataType) -> DataFrame:
    return encode._apply(rows, encoder, F.col("_kept"), out, kind, "keep").drop("_kept")


def embed_requests(
    df: DataFrame,
    prompts: dict[str, str],
    max_len: int,
    encoder: encode.Encoder | None = None,
    text_col: str = "text",
    **defaults: Any,
) -> DataFrame:
    """Dense vectors: ``embedding``, of the first ``dimensions`` components, scaled to unit length if ``normalize``."""
    encoder = encoder or encode.LexicalDense()
    rows = _prepared(df, encoder, max_len, text_col, prompts, defaults)
    wide = F.col("dimensions").isNotNull() & ~F.col("dimensions").between(1, encoder.dim)
    rows = rows.withColumn("error_code", F.coalesce("error_code", F.when(wide, "INVALID_ARGUMENT")))
    rows = rows.withColumn("_kept", F.when(F.col("error_code").isNull(), F.col("_kept")))

    def vector(weights: Column) -> Column:
        head = F.slice(weights, F.lit(1), F.coalesce("dimensions", F.lit(encoder.dim)))
        plain = F.transform(head, lambda w: w.cast("float"))
        return F.when(F.col("normalize"), vec.l2_normalize(head)).otherwise(plain)

    if isinstance(encoder, encode.LexicalDense):
        found = F.when(F.col("_kept").isNotNull(), tx.let(encoder.weights(F.col("_kept")), vector))
        return rows.withColumn("embedding", found).drop("_kept")
    rows = _encoded(rows, encoder, "embedding", schemas.DENSE)
    return rows.withColumn("embedding", F.when(F.col("embedding").isNotNull(), tx.let(F.col("embedding"), vector)))


def embed_sparse_requests(
    df: DataFrame,
    prompts: dict[str, str],
    max_len: int,
    encoder: encode.Encoder | None = None,
    text_col: str = "text",
    **defaults: Any,
) -> DataFrame:
    """(index, value) pairs: ``sparse``."""
    encoder = encoder or encode.LexicalSparse()
    return _encoded(_prepared(df, encoder, max_len, text_col, prompts, defaults), encoder, "sparse", schemas.SPARSE)


def embed_all_requests(
    df: DataFrame,
    prompts: dict[str, str],
    max_len: int,
    encoder: encode.Encoder | None = None,
    text_col: str = "text",
    **defaults: Any,
) -> DataFrame:
    """A vector per token: ``token_embeddings``."""
    encoder = encoder or encode.LexicalTokens()
    rows = _prepared(df, encoder, max_len, text_col, prompts, defaults)
    return _encoded(rows, encoder, "token_embeddings", schemas.TOKEN_VECTORS)


def _scored(rows: DataFrame, classifier: Any, out: str, raw_scores: Column, scores: Column | None) -> DataFrame:
    """Raw scores, or their softmax; ``scores`` is the expression of a lexical classifier."""
    if scores is None:
        rows = encode._apply(rows, classifier, F.col("_kept"), "_raw", schemas.PREDICTIONS, "keep")
    else:
        rows = rows.withColumn("_raw", F.when(F.col("_kept").isNotNull(), scores))
    cast = lambda c: F.transform(c, lambda s: F.struct(s["score"].cast("float").alias("score"), s["label"].alias("label")))
    double = F.transform("_raw", lambda s: F.struct(s["score"].cast("double").alias("score"), s["label"].alias("label")))
    found = F.when(raw_scores, cast(F.col("_raw"))).otherwise(cast(encode.softmax(double)))
    return rows.withColumn(out, F.when(F.col("_raw").isNotNull(), found)).drop("_raw", "_kept")


def predict_requests(
    df: DataFrame,
    classifier: Any,
    max_len: int,
    text_col: str = "text",
    raw_scores: bool = False,
    out: str = "predictions",
    **defaults: Any,
) -> DataFrame:
    """Scored labels: the classifier's own scores, or their softmax unless ``raw_scores``.

    A user's model gives raw scores.
    """
    raw = _option(df, "raw_scores", raw_scores)
    rows = _prepared(df.withColumn("prompt_name", F.lit(None).cast("string")), classifier, max_len, text_col, {}, defaults)
    lexical = isinstance(classifier, encode.LinearClassifier)
    scores = classifier.raw(F.col("_kept")) if lexical else None
    return _scored(rows.drop("prompt_name"), classifier, out, raw, scores)


def _pair_limits(first: Column, second: Column, limit: int) -> tuple[Column, Column]:
    """Tokens that each text of a pair keeps: a short one all, and the longer one the rest."""
    half = limit // 2
    a = F.when(first <= half, first).when(second <= limit - half, F.lit(limit) - second).otherwise(half)
    a = F.least(first, a)
    return a, F.least(second, F.lit(limit) - a)


def _prepared_pairs(df: DataFrame, encoder: Any, max_len: int, pair: Column, defaults: dict) -> DataFrame:
    """Rows with ``_kept``, the pair within the limit or null, and ``error_code`` and ``metadata``."""
    limit, pattern = _limits(encoder, max_len)
    rows = requests.request_params(df, **defaults)
    one, two = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    rows = rows.withColumns({"_a": one, "_b": two, "_whole": F.coalesce(F.size(pair) == 2, F.lit(False))})
    rows = rows.withColumns({"_na": _count(F.col("_a"), pattern), "_nb": _count(F.col("_b"), pattern)})
    long = F.col("_na") + F.col("_nb") > limit
    missing = ~F.col("_whole") | F.col("_a").isNull() | F.col("_b").isNull()
    error = F.when(missing, "INVALID_ARGUMENT").when(long & ~F.col("truncate"), "INPUT_TOO_LONG")
    rows = rows.withColumn("error_code", error)
    keep_a, keep_b = _pair_limits(F.col("_na"), F.col("_nb"), limit)
    left, cut = F.col("direction") == "left", _cutter(pattern)
    some = long & F.col("error_code").isNull()
    a = F.coalesce(cut(F.when(some, F.col("_a")), F.coalesce(keep_a, F.lit(0)), left), "_a")
    b = F.coalesce(cut(F.when(some, F.col("_b")), F.coalesce(keep_b, F.lit(0)), left), "_b")
    costs = _metadata([F.col("_a"), F.col("_b")], F.col("_na") + F.col("_nb"))
    rows = rows.withColumns({"_kept": F.when(F.col("error_code").isNull(), F.array(a, b)), "metadata": costs})
    return rows.drop("_a", "_b", "_na", "_nb", "_whole", *{"prompt_name", "dimensions", "normalize"} - set(df.columns))


def predict_pair_requests(
    df: DataFrame,
    classifier: Any,
    max_len: int,
    pair_col: str = "texts",
    raw_scores: bool = False,
    out: str = "predictions",
    **defaults: Any,
) -> DataFrame:
    """Scored labels of pairs of texts; both together may have ``max_len`` tokens.

    Of a pair that is cut, a text of half the limit or less stays whole, and the other gets the rest.
    """
    raw = _option(df, "raw_scores", raw_scores)
    rows = _prepared_pairs(df, classifier, max_len, F.col(pair_col), defaults)
    scores = classifier.raw_pair(F.col("_kept")) if isinstance(classifier, encode.LinearClassifier) else None
    return _scored(rows, classifier, out, raw, scores)


def rerank_requests(
    rows: DataFrame,
    max_len: int,
    encoder: Any | None = None,
    query_id: str = "query_id",
    raw_scores: bool = False,
    return_text: bool = False,
    **defaults: Any,
) -> DataFrame:
    """Rank the texts of each query: rows (query_id, index, query, text[, options]) in.

    ``encoder`` is a user's model of kind ``reranker``, from pairs (query, text) to a raw score; without
    it the lexical cosine scores.  Unless ``raw_scores``, a model's score goes through the
    logistic function and the cosine from [-1, 1] to [0, 1].  ``raw_scores`` and ``return_text`` of a query's
    lowest index hold for all of it.  A text that is too long, or missing, and may not be
    cut makes the whole query an error: one row (query_id, error_code) without ranks.

    Out: (query_id, rank, index, score, text, error_code), rank 1 is best, ties by index; a query
    with very many texts is ranked by many tasks.
    """
    rows = rows.withColumns(
        {"_raw": _option(rows, "raw_scores", raw_scores), "_return": _option(rows, "return_text", return_text)}
    )
    kept = _prepared_pairs(rows, encoder, max_len, F.array("query", "text"), defaults)
    if encoder is None:
        score = encode.pair_score(F.col("_kept")[0], F.col("_kept")[1])
        kept = kept.withColumn("_score", F.when(F.col("_kept").isNotNull(), score))
    else:
        kept = encode._apply(kept, encoder, F.col("_kept"), "_score", T.DoubleType(), "keep")
    kept = kept.withColumn("_score", F.floor(F.col("_score") * 1e6 + 0.5) / F.lit(1e6))
    kept = encode.cut(kept.select(query_id, "index", "text", "_score", "_raw", "_return", "error_code"))
    queries = kept.groupBy(query_id).agg(
        F.min_by(F.struct("_raw", "_return"), "index").alias("_o"),
        F.min_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("index"))).alias("_error"),
    )
    failed = queries.filter(F.col("_error").isNotNull())
    sound = kept.join(failed.select(query_id), query_id, "left_anti").withColumn("_down", -F.col("_score"))
    placed = ranked(sound.select(query_id, "index", "text", "_score", "_down"), [query_id], [F.col("_down"), F.col("index")], "rank")
    logistic = 1 / (1 + F.exp(-F.col("_score")))
    shown = logistic if encoder is not None else (F.col("_score") + 1) / 2
    none = F.lit(None)
    good = placed.join(queries.select(query_id, "_o"), query_id).select(
        query_id,
        (F.col("rank") + 1).alias("rank"),
        F.col("index").cast("long").alias("index"),
        F.when(F.col("_o._raw"), F.col("_score")).otherwise(shown).alias("score"),
        F.when(F.col("_o._return"), F.col("text")).alias("text"),
        none.cast("string").alias("error_code"),
    )
    bad = failed.select(
        query_id, none.cast("long").alias("rank"), none.cast("long").alias("index"), none.cast("double").alias("score"),
        none.cast("string").alias("text"), F.col("_error").alias("error_code"),
    )
    return good.unionByName(bad)
