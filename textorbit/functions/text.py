"""Column functions on text: tokens, hashes, lexical features, payload sizes.

Everything here is a Catalyst expression without a shuffle, so the same
function serves tables and streams.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the code-point ranges of a token, so that every engine agrees.
TOKEN = "[a-zà-ÿß0-9]+"

SPARSE_DIM = 30522
DENSE_DIM = 64
TOKEN_DIM = 32

HEX_DIGITS = "0123456789abcdef"
# Value of a hex digit by its character code.
_DIGIT_VALUES = np.zeros(103, dtype=np.float32)
_DIGIT_VALUES[[ord(c) for c in HEX_DIGITS]] = [(2 * d - 15) / 15 for d in range(16)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Without it Catalyst may inline a costly expression into a lambda and
    compute it once per array element.
    """
    return F.transform(F.array(value), body)[0]


def unroll(
    df: DataFrame, keep: list[str | Column], array: str | Column, value: str, position: str | None = None
) -> DataFrame:
    """One row per array entry.

    An inner ``explode`` makes the optimizer add ``size(array) > 0`` filters and
    push them to the scan, which would compute a costly array twice more, before
    any repartitioning.  The outer form with a filter on its output does not.
    """
    at = position or "_position"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())
    return rows.withColumn(at, F.col(at).cast("long")) if position else rows.drop(at)


def tokens(text: Column) -> Column:
    """Lower-case lexical tokens of a text, in order.

    Extracting is about six times as fast as splitting on the other characters.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_bucket(token: Column, dim: int = SPARSE_DIM) -> Column:
    """Index of a token: leading 32 bits of its MD5 modulo ``dim``."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % F.lit(dim)


def value_counts(values: Column) -> Column:
    """``array<struct<key, n>>`` of an array's values, by key; O(n log n), no shuffle.

    The sorted array is cut where neighbours differ; a run's length is the
    distance to the next cut.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("key"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    return let(
        F.sort_array(values),
        lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(
            F.array().cast("array<struct<key:bigint,n:int>>")
        ),
    )


def sparse_counts(text: Column, dim: int = SPARSE_DIM) -> Column:
    """``array<struct<key bigint, n int>>``: term counts per hashed index."""
    return value_counts(F.transform(tokens(text), lambda t: token_bucket(t, dim)))


def sparse_values(text: Column, dim: int = SPARSE_DIM) -> Column:
    """``array<struct<index, value>>`` with value = log1p(term count), by index."""
    return F.transform(
        sparse_counts(text, dim),
        lambda c: F.struct(
            c["key"].alias("index"), F.log1p(c["n"].cast("double")).cast("float").alias("value")
        ),
    )


def signed_weights(text: Column, dim: int = DENSE_DIM) -> Column:
    """Integer feature-hashing weights ``array<bigint>`` of width ``dim``.

    Dimension and sign come from the token's MD5: eight hex digits modulo
    ``dim``, and the parity of the ninth.  Integers keep sums exact.
    """

    def code(token: Column) -> Column:
        return let(
            F.md5(token),
            lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim * 2
            + (F.instr(F.lit(HEX_DIGITS), F.substring(h, 9, 1)) - 1) % 2,
        )

    def spread(counts: Column) -> Column:
        def n(m: Column, key: Column) -> Column:
            return F.coalesce(F.try_element_at(m, key), F.lit(0)).cast("long")

        return let(
            F.map_from_entries(counts),
            lambda m: F.transform(
                F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
                lambda d: n(m, d * 2) - n(m, d * 2 + 1),
            ),
        )

    return spread(value_counts(F.transform(tokens(text), code)))


def token_vector(token: Column, dim: int = TOKEN_DIM) -> Column:
    """Vector of one token: MD5 hex digits mapped linearly onto [-1, 1]."""
    digits = F.split(F.substring(F.md5(token), 1, dim), "")
    return F.transform(digits, lambda c: F.get(F.lit(_DIGIT_VALUES), F.ascii(c)))


def truncate_tokens(toks: Column, max_len: int, direction: str = "right") -> Column:
    """Keep the head (``right`` cuts the tail) or the tail (``left``) of a token array."""
    if direction == "right":
        return F.slice(toks, 1, max_len)
    if direction == "left":
        return F.slice(toks, F.greatest(F.size(toks) - F.lit(max_len - 1), F.lit(1)), F.lit(max_len))
    raise ValueError(f"direction must be 'right' or 'left', not {direction!r}")
