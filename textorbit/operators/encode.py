"""Model operators: embed, sparse-embed, tokenize, classify, rerank.

Every operator is narrow (no shuffle) unless it ranks, keeps the input columns
and works on streams too.  Lexical encoders are Catalyst expressions; a model
of the user's runs in Python workers, loaded once per worker, on Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textorbit import schemas
from textorbit.functions import text as tx
from textorbit.functions import vectors as vec
from textorbit.operators.batch import number_rows
from textorbit.operators.scan import ranked
from textorbit.session import cut

NOOP_DIM = 384  # fixed value: vector width of the no-op encoder


class Encoder(Protocol):
    """What an embedding operator needs from an encoder.

    ``columns`` returns a Catalyst expression, or None when only
    ``encode_batch`` (called with a list of non-null inputs) can do the work.
    """

    name: str
    dim: int
    kind: str  # dense | sparse | token | classifier | reranker
    max_input_length: int

    def columns(self, text: Column) -> Column | None: ...

    def encode_batch(self, texts: list[Any]) -> list[Any]: ...


@dataclass
class _Expression:
    name: str
    dim: int
    kind: str
    max_input_length: int = 1 << 31

    def encode_batch(self, texts: list[Any]) -> list[Any]:
        raise NotImplementedError(f"{self.name} is an expression")


class LexicalDense(_Expression):
    """Signed feature hashing of tokens, scaled to unit length unless told otherwise."""

    def __init__(self, dim: int = tx.DENSE_DIM, normalize: bool = True):
        super().__init__("lexical-dense", dim, "dense")
        self.normalize = normalize

    def weights(self, text: Column) -> Column:
        return tx.signed_weights(text, self.dim)

    def columns(self, text: Column) -> Column:
        weights = self.weights(text)
        return vec.l2_normalize(weights) if self.normalize else F.transform(weights, lambda w: w.cast("float"))


class LexicalSparse(_Expression):
    """log1p of hashed term counts: a bag-of-words stand-in, not a trained model."""

    def __init__(self, dim: int = tx.SPARSE_DIM):
        super().__init__("lexical-sparse", dim, "sparse")

    def columns(self, text: Column) -> Column:
        return tx.sparse_values(text, self.dim)


class LexicalTokens(_Expression):
    """One fixed vector per token."""

    def __init__(self, dim: int = tx.TOKEN_DIM):
        super().__init__("lexical-tokens", dim, "token")

    def columns(self, text: Column) -> Column:
        return F.transform(tx.tokens(text), lambda t: tx.token_vector(t, self.dim))


@dataclass
class CallableEncoder:
    """A user's model.  ``load`` runs once per Python worker and returns list -> list.

    A text of more than ``max_input_length`` tokens is an error, unless ``truncate`` says to cut it
    after so many.  The model gets lists of at most ``max_batch_tokens`` tokens, or one text, and
    must give as many results; ``tokens`` is the pattern of a token.
    """

    name: str
    dim: int
    kind: str
    load: Callable[[], Callable[[list[Any]], list[Any]]]
    max_input_length: int = 512
    max_batch_tokens: int = 16384
    tokens: str = tx.TOKEN
    truncate: bool = False
    identity: str = field(default="", repr=False)

    def __post_init__(self):
        # Workers outlive an encoder, and another one may have its name.
        self.identity = sha256(cloudpickle.dumps(self.load)).hexdigest()

    def columns(self, text: Column) -> None:
        return None

    def encode_batch(self, texts: list[Any]) -> list[Any]:
        identity, model = _LOADED.get(self.name, (None, None))
        if identity != self.identity:
            model = self.load()
            _LOADED[self.name] = self.identity, model
        return model(texts)

    def fit(self, text: Any) -> tuple[Any, int]:
        """An input (a text or a list of texts) within the length limit, and its tokens."""
        if not isinstance(text, str):
            parts = [self.fit(t) for t in text]
            return [t for t, _ in parts], sum(n for _, n in parts)
        count, end = 0, 0
        for found in re.finditer(self.tokens, text, re.IGNORECASE):
            if count == self.max_input_length:
                if not self.truncate:
                    raise ValueError(f"INPUT_TOO_LONG: a text has more than {count} tokens, and {self.name} may not cut it")
                return text[:end], count
            count, end = count + 1, found.end()
        return text, count

    def encode_all(self, texts: list[Any]) -> Iterator[Any]:
        """Results of any number of inputs, in batches within the token limit."""
        held, used = [], 0
        for text, n in map(self.fit, texts):
            if held and used + n > self.max_batch_tokens:
                yield from checked(self, held)
                held, used = [], 0
            held.append(text)
            used += n
        if held:
            yield from checked(self, held)


def checked(encoder: Encoder, inputs: list[Any]) -> list[Any]:
    """One result for each input; another number would shift results between rows."""
    results = list(encoder.encode_batch(inputs))
    if len(results) != len(inputs):
        raise ValueError(f"{encoder.name} gave {len(results)} results for {len(inputs)} inputs")
    return results


_LOADED: dict[str, tuple[str, Callable]] = {}  # per Python worker, by name: identity and model


def _apply(
    df: DataFrame, encoder: Encoder, inputs: Column, out: str, out_type: T.DataType, null_policy: str
) -> DataFrame:
    """Add ``out`` from the encoder; null inputs keep their row or are dropped.

    Only the input column goes through Python.
    """
    if null_policy not in ("keep", "drop"):
        raise ValueError("null_policy must be 'keep' or 'drop'")
    rows = df.filter(inputs.isNotNull()) if null_policy == "drop" else df
    expression = encoder.columns(inputs)
    if expression is not None:
        return rows.withColumn(out, F.when(inputs.isNotNull(), expression))

    @F.pandas_udf(out_type)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = getattr(encoder, "encode_all", lambda texts: checked(encoder, texts))
        for column in batches:
            present = column.notna()
            texts = [v if isinstance(v, str) else list(v) for v in column[present]]
            results = iter(run(texts) if texts else [])
            yield pd.Series([next(results) if p else None for p in present], index=column.index, dtype=object)

    return rows.withColumn(out, encode(inputs))


def embed(
    df: DataFrame,
    text_col: str = "text",
    encoder: Encoder | None = None,
    dimensions: int | None = None,
    normalize: bool = True,
    null_policy: str = "keep",
    noop: bool = False,
    out: str = "embedding",
) -> DataFrame:
    """One dense vector per text.  ``noop`` yields zeros and counts null texts as rows."""
    if noop:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), NOOP_DIM)
        return df.withColumn(out, zeros)
    rows = _apply(df, encoder or LexicalDense(normalize=normalize), F.col(text_col), out, schemas.DENSE, null_policy)
    if dimensions is not None:
        rows = rows.withColumn(out, vec.cut_dimensions(F.col(out), dimensions, normalize))
    elif normalize and encoder is not None and encoder.columns(F.col(text_col)) is None:
        rows = rows.withColumn(out, vec.l2_normalize(F.col(out)))
    return rows


def embed_sparse(
    df: DataFrame,
    text_col: str = "text",
    encoder: Encoder | None = None,
    null_policy: str = "keep",
    noop_order: Sequence[str] | None = None,
    noop_step: int | None = None,
    out: str = "sparse",
) -> DataFrame:
    """(index, value) pairs per text.

    ``noop_order`` selects the no-op encoder: row i of that order gets
    (i, 1.0), (i + 100, 0.5), (i + 200, 0.25).
    """
    if noop_order is not None:
        placed = number_rows(df, noop_order, step=noop_step, name="_i")
        i = F.col("_i").cast("long")
        pairs = F.array(
            *[
                F.struct((i + shift).alias("index"), F.lit(v).cast("float").alias("value"))
                for shift, v in ((0, 1.0), (100, 0.5), (200, 0.25))
            ]
        )
        return placed.withColumn(out, pairs).drop("_i")
    return _apply(df, encoder or LexicalSparse(), F.col(text_col), out, schemas.SPARSE, null_policy)


def embed_all(
    df: DataFrame,
    text_col: str = "text",
    encoder: Encoder | None = None,
    explode_tokens: bool = False,
    null_policy: str = "keep",
    out: str = "token_embeddings",
) -> DataFrame:
    """One vector per token; ``explode_tokens`` gives one row per token."""
    rows = _apply(
        df, encoder or LexicalTokens(), F.col(text_col), out, schemas.TOKEN_VECTORS, null_policy
    )
    if not explode_tokens:
        return rows
    return tx.unroll(rows, [c for c in rows.columns if c != out], out, "embedding", "position")


@dataclass
class LinearClassifier(_Expression):
    """Linear scores over the lexical dense vector: one weight list and bias per label."""

    weights: dict[str, list[float]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    raw_scores: bool = False

    def __init__(self, weights: dict[str, list[float]], bias: dict[str, float] | None = None, raw_scores: bool = False):
        super().__init__("lexical-linear", len(next(iter(weights.values()))), "classifier")
        self.weights, self.bias, self.raw_scores = weights, bias or {}, raw_scores

    def raw_score(self, features: Column) -> Column:
        def scores(v: Column) -> Column:
            raw = [
                (vec.dot(v, F.array(*[F.lit(float(x)) for x in w])) + self.bias.get(label, 0.0), label)
                for label, w in self.weights.items()
            ]
            return F.array(*[F.struct(s.alias("score"), F.lit(n).alias("label")) for s, n in raw])

        return tx.let(features, scores)

    def score(self, features: Column) -> Column:
        scored = self.raw_score(features)
        return F.transform(
            scored if self.raw_scores else softmax(scored),
            lambda s: F.struct(s["score"].cast("float").alias("score"), s["label"].alias("label")),
        )

    def columns(self, text: Column) -> Column:
        """A text column, or an array column holding a pair of texts.

        A pair is compared through the product of its two unit vectors; an
        array that is no pair has no prediction.
        """
        return self.score(vec.l2_normalize(tx.signed_weights(text, self.dim)))

    def _product(self, texts: Column) -> Column:
        unit = lambda t: vec.l2_normalize(tx.signed_weights(t, self.dim))
        return F.zip_with(unit(F.get(texts, F.lit(0))), unit(F.get(texts, F.lit(1))), lambda a, b: a * b)

    def pair(self, texts: Column) -> Column:
        return F.when(F.size(texts) == 2, self.score(self._product(texts)))

    def raw(self, text: Column) -> Column:
        """Scores before any softmax."""
        return self.raw_score(vec.l2_normalize(tx.signed_weights(text, self.dim)))

    def raw_pair(self, texts: Column) -> Column:
        return F.when(F.size(texts) == 2, self.raw_score(self._product(texts)))


def softmax(scored: Column) -> Column:
    """Turn raw ``array<struct<score, label>>`` into probabilities."""

    def shares(rows: Column, top: Column) -> Column:
        exp = lambda s: F.exp(s["score"] - top)
        return tx.let(
            F.aggregate(rows, F.lit(0.0), lambda acc, s: acc + exp(s)),
            lambda total: F.transform(
                rows, lambda s: F.struct((exp(s) / total).alias("score"), s["label"].alias("label"))
            ),
        )

    return tx.let(
        scored,
        lambda rows: tx.let(
            F.array_max(F.transform(rows, lambda s: s["score"])), lambda top: shares(rows, top)
        ),
    )


def predict(
    df: DataFrame, classifier: Encoder, text_col: str = "text", null_policy: str = "keep", out: str = "predictions"
) -> DataFrame:
    """Scored labels per text."""
    return _apply(df, classifier, F.col(text_col), out, schemas.PREDICTIONS, null_policy)


def predict_pair(
    df: DataFrame, classifier: Encoder, pair_col: str = "texts", out: str = "predictions"
) -> DataFrame:
    """Scored labels per pair of texts; another number of texts is an error."""
    pair = F.col(pair_col)
    wrong = F.size(pair) != 2
    if isinstance(classifier, LinearClassifier):
        rows = df.withColumn(out, classifier.pair(pair))
    else:
        rows = _apply(
            df, classifier, F.when(~wrong, pair), out, schemas.PREDICTIONS, "keep"
        )
    return rows.withColumn("error_code", F.when(pair.isNull() | wrong, F.lit("INVALID_ARGUMENT")))


def pair_score(query: Column, text: Column, dim: int = tx.DENSE_DIM) -> Column:
    """Lexical relevance of a text to a query: exact integer cosine."""

    def score(q: Column, t: Column) -> Column:
        norms = vec.squared_norm(q) * vec.squared_norm(t)
        return F.when(norms > 0, vec.dot(q, t) / F.sqrt(norms)).otherwise(0.0)

    return tx.let(
        tx.signed_weights(query, dim),
        lambda q: tx.let(tx.signed_weights(text, dim), lambda t: score(q, t)),
    )


def rerank(
    rows: DataFrame,
    query_id: str = "query_id",
    scorer: Callable[[Column, Column], Column] = pair_score,
    return_text: bool = False,
) -> DataFrame:
    """Rank the texts of each query: rows (query_id, index, query, text) in.

    Out: (query_id, rank, index, score[, text]), rank 1 is best, ties by index.
    Ranks are numbered over range pieces, so a query with very many texts does
    not become one task.
    """
    scored = rows.withColumn(
        "score", F.floor(scorer(F.col("query"), F.col("text")) * 1e6 + 0.5) / F.lit(1e6)
    )
    kept = [query_id, "index", "score", *(["text"] if return_text else [])]
    placed = ranked(
        scored.select(*kept).withColumn("_down", -F.col("score")),
        [query_id],
        [F.col("_down"), F.col("index")],
        "rank",
    )
    return placed.select(query_id, (F.col("rank") + 1).alias("rank"), *kept[1:])


# Names of the two special tokens; their ids follow the hashed ones.
SPECIAL_TOKENS = ("<s>", "</s>")


#: Bytes of text whose tokens a task holds at once, and tokens whose ids it remembers.
TOKENIZED_BYTES, KNOWN_IDS = 1 << 20, 1 << 18


def _pieces(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of up to ``TOKENIZED_BYTES`` of text together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch[text_col]), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > TOKENIZED_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def tokenize(
    df: DataFrame,
    text_col: str = "text",
    add_special_tokens: bool = True,
    encoder: Encoder | None = None,
    dim: int = tx.SPARSE_DIM,
    out: str = "tokens",
    offsets: bool = True,
) -> DataFrame:
    """Token structs (id, text, special, start, stop) per text.

    Offsets count characters of the lower-cased text.  Running offsets are a
    fold over a text's tokens; one Arrow pass in Python was measured at twice
    the speed of the array expressions that can state it.  Without ``offsets``
    (start and stop null) the tokens stay a Catalyst expression.
    """
    if encoder is not None:
        return _apply(df, encoder, F.col(text_col), out, schemas.TOKENS, "keep")
    if not offsets:
        return df.withColumn(out, F.when(F.col(text_col).isNotNull(), _plain_tokens(F.col(text_col), add_special_tokens, dim)))
    token = re.compile(tx.TOKEN)
    schema = T.StructType([*df.schema.fields, T.StructField(out, schemas.TOKENS)])
    first, last = SPECIAL_TOKENS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        ids: dict[str, int] = {first: dim, last: dim + 1}

        def token_id(t: str) -> int:
            i = ids.get(t)
            if i is None:
                if len(ids) > KNOWN_IDS:  # bounded memory of a long-lived worker
                    ids.clear()
                    ids.update({first: dim, last: dim + 1})
                i = ids[t] = int(md5(t.encode()).hexdigest()[:8], 16) % dim
            return i

        for batch in (piece for whole in batches for piece in _pieces(whole, text_col)):
            offsets, words, starts, stops = [0], [], [], []
            empty = []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                empty.append(text is None)
                if text is not None:
                    found = [(m.group(), *m.span()) for m in token.finditer(text.lower())]
                    if add_special_tokens:
                        found = [(first, None, None), *found, (last, None, None)]
                    if found:
                        w, a, b = zip(*found, strict=True)
                        words += w
                        starts += a
                        stops += b
                offsets.append(len(words))
            special = pa.array([w == first or w == last for w in words], pa.bool_())
            items = pa.StructArray.from_arrays(
                [
                    pa.array([token_id(w) for w in words], pa.int64()),
                    pa.array(words, pa.string()),
                    special,
                    pa.array(starts, pa.int64()),
                    pa.array(stops, pa.int64()),
                ],
                names=["id", "text", "special", "start", "stop"],
            )
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=pa.array(empty))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return df.mapInArrow(split, schema)


def _plain_tokens(text: Column, add_special_tokens: bool, dim: int) -> Column:
    def token(i: Column, t: Column, special: bool) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(
            i.cast("long").alias("id"), t.alias("text"), F.lit(special).alias("special"),
            none.alias("start"), none.alias("stop"),
        )

    found = F.transform(tx.tokens(text), lambda t: token(tx.token_bucket(t, dim), t, False))
    if not add_special_tokens:
        return found
    first, last = (F.array(token(F.lit(dim + i), F.lit(t), True)) for i, t in enumerate(SPECIAL_TOKENS))
    return F.concat(first, found, last)


def vocabulary(df: DataFrame, text_col: str = "text", dim: int = tx.SPARSE_DIM) -> DataFrame:
    """(id, token) of the tokens in a text column; the smallest token names a shared id."""
    toks = tx.unroll(df, [], F.array_distinct(tx.tokens(F.col(text_col))), "token")
    return (
        toks.groupBy("token").agg(F.lit(1).alias("_one"))
        .groupBy(tx.token_bucket(F.col("token"), dim).alias("id"))
        .agg(F.min("token").alias("token"))
    )


# Vocabularies up to this many bytes travel inside the plan as one array.
INLINE_BYTES = 4 << 20


def decode(
    df: DataFrame,
    vocab: DataFrame,
    key: str | None = None,
    ids_col: str = "ids",
    skip_special_tokens: bool = True,
    dim: int = tx.SPARSE_DIM,
    out: str = "text",
    inline_bytes: int = INLINE_BYTES,
) -> DataFrame:
    """Token ids back to text through a vocabulary table (id, token).

    Tokens are any texts, empty ones and line feeds included, joined by spaces.
    Ids that are neither below ``dim`` and in the table nor special are left out; of
    tokens that share an id the smallest counts.

    A vocabulary of up to ``inline_bytes`` becomes one constant array, and decoding is
    narrow, on streams too; its size is summed before it is fetched.  A larger one
    is joined per token, then gathered per ``key``, which must tell the rows apart.
    Both give the same texts.
    """
    # Written once: it is sized, fetched or joined, and mostly costs a pass over a corpus.
    known = cut(
        vocab.filter((F.col("id") >= 0) & (F.col("id") < dim) & F.col("token").isNotNull())
        .groupBy("id").agg(F.min("token").alias("token"))
    )
    names = [F.lit(t) for t in SPECIAL_TOKENS]
    slots = F.coalesce(F.max("id") + 1, F.lit(0)).alias("slots")
    size = known.agg(slots, F.coalesce(F.sum(F.octet_length("token") + 3), F.lit(0)).alias("bytes")).first()
    if 5 * size["slots"] + size["bytes"] <= inline_bytes:
        held = [None] * size["slots"]
        for row in known.collect():  # inline_bytes at most
            held[row["id"]] = row["token"]
        table = F.from_json(F.lit(json.dumps(held)), "array<string>")

        def name(i: Column) -> Column:
            token = F.get(table, i.try_cast("int"))
            if skip_special_tokens:
                return token
            return F.when(i >= dim, F.get(F.array(*names), (i - dim).try_cast("int"))).otherwise(token)

        words = F.filter(F.transform(ids_col, name), lambda t: t.isNotNull())
        return df.withColumn(out, F.array_join(words, " "))
    if key is None:
        raise ValueError("a vocabulary this large needs a unique key column")
    special = df.sparkSession.createDataFrame(
        [(dim + i, t) for i, t in enumerate(SPECIAL_TOKENS) if not skip_special_tokens], "id long, token string"
    )
    words = known.unionByName(special).withColumnRenamed("id", "_id")
    texts = (
        df.select(key, F.posexplode(ids_col).alias("_pos", "_id"))
        .join(words, "_id")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "token"))).alias("_t"))
        .select(key, F.array_join(F.transform("_t", lambda s: s["token"]), " ").alias(out))
    )
    return df.join(texts, key, "left").withColumn(
        out, F.when(F.col(ids_col).isNotNull(), F.coalesce(out, F.lit("")))
    )


def encoder_info(spark, encoders: Sequence[Encoder], version: str = "1") -> DataFrame:
    """Model card per encoder."""
    kinds = {"classifier": "classifier", "reranker": "reranker"}
    rows = [
        (
            version, None, None, e.name, None, "float32", kinds.get(e.kind, "embedding"),
            512, e.max_input_length, getattr(e, "max_batch_tokens", 16384), None, 32, 1,
        )
        for e in encoders
    ]
    return spark.createDataFrame(rows, schemas.INFO)


def encoder_smoke(spark, encoders: Sequence[Encoder], text: str = "smoke test") -> DataFrame:
    """Try every encoder once on a text; failures become rows with their reason.

    Models are loaded and run in workers, and must give one result; expressions are planned
    and run by Spark.
    """
    reason = lambda exc: f"{type(exc).__name__}: {exc}"
    by_name, rows = {}, []
    for encoder in encoders:
        expression = encoder.columns(F.lit(text))
        if expression is None:
            by_name[encoder.name] = encoder
            continue
        try:
            spark.range(1).select(expression).first()
            rows.append((encoder.name, "verified", None))
        except Exception as exc:  # the reason is the result
            rows.append((encoder.name, "failed", reason(exc)))
    schema = "name string, status string, error string"
    names = spark.createDataFrame([(n,) for n in by_name], "name string")

    def attempt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for name in frame["name"]:
                try:
                    checked(by_name[name], [text])
                    found.append((name, "verified", None))
                except Exception as exc:  # the reason is the result
                    found.append((name, "failed", reason(exc)))
            yield pd.DataFrame(found, columns=["name", "status", "error"])

    tried = names.repartition(max(len(by_name), 1)).mapInPandas(attempt, schema)
    return tried.unionByName(spark.createDataFrame(rows, schema))
