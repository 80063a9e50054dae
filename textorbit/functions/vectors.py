"""Column functions on dense and sparse vectors; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textorbit.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def squared_norm(v: Column) -> Column:
    return F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def l2_normalize(v: Column) -> Column:
    """Unit vector as ``array<float>``; a zero vector stays zero."""

    def scaled(u: Column) -> Column:
        return let(
            F.sqrt(squared_norm(u)),
            lambda norm: F.transform(
                u, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0).cast("float")
            ),
        )

    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of any two vectors; null when one of them is zero."""

    def ratio(x: Column, y: Column) -> Column:
        norms = F.sqrt(squared_norm(x) * squared_norm(y))
        return F.when(norms > 0, dot(x, y) / norms)

    return let(a, lambda x: let(b, lambda y: ratio(x, y)))


def cut_dimensions(v: Column, dimensions: int, normalize: bool = True) -> Column:
    """First ``dimensions`` entries, unit length again when ``normalize``."""
    head = F.slice(v, 1, dimensions)
    return l2_normalize(head) if normalize else head


def mean_pool(token_vectors: Column, mask: Column | None = None) -> Column:
    """Per-dimension mean over token vectors; padding counts unless ``mask`` is given."""
    if mask is not None:
        token_vectors = F.transform(
            F.filter(F.arrays_zip(token_vectors.alias("v"), mask.alias("m")), lambda z: z["m"] > 0),
            lambda z: z["v"],
        )

    def pooled(rows: Column) -> Column:
        zeros = F.transform(F.get(rows, F.lit(0)), lambda _: F.lit(0.0))
        total = F.aggregate(
            rows, zeros, lambda acc, r: F.zip_with(acc, r, lambda s, x: s + x.cast("double"))
        )
        return F.transform(total, lambda s: s / F.size(rows))

    return let(token_vectors, lambda rows: F.when(F.size(rows) > 0, pooled(rows)))


def splade_pool(token_logits: Column, mask: Column) -> Column:
    """Sparse vector: per term the largest ``log1p(relu(logit)) * mask`` over positions.

    Terms whose pooled value is 0 are left out.
    """

    def pooled(rows: Column, m: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        values = F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda t: F.struct(
                t.cast("long").alias("index"),
                F.array_max(
                    F.zip_with(
                        rows,
                        m,
                        lambda r, keep: F.log1p(F.greatest(F.get(r, t).cast("double"), F.lit(0.0)))
                        * keep,
                    )
                )
                .cast("float")
                .alias("value"),
            ),
        )
        return F.filter(values, lambda s: s["value"] != 0)

    return let(token_logits, lambda rows: let(mask, lambda m: pooled(rows, m)))


def sparse_meeting(a: Column, b: Column) -> Column:
    """``struct<dot, overlap>`` of two ``array<struct<index, value>>`` with unique indices.

    Both vectors are sorted together; a shared index makes two neighbours.
    Linear in the entries after the sort, where a map would be scanned for
    every index.
    """

    def result(total: Column, n: Column) -> Column:
        return F.struct(total.alias("dot"), n.cast("long").alias("overlap"))

    nothing = result(F.lit(0.0), F.lit(0))

    def fold(c: Column) -> Column:
        def meet(acc: Column, i: Column) -> Column:
            x, y = F.get(c, i - 1), F.get(c, i)
            gain = x["value"].cast("double") * y["value"].cast("double")
            return F.when(x["index"] == y["index"], result(acc["dot"] + gain, acc["overlap"] + 1)).otherwise(acc)

        return F.when(
            F.size(c) > 1, F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), nothing, meet)
        ).otherwise(nothing)

    return let(F.sort_array(F.concat(a, b)), fold)


def sparse_dot(a: Column, b: Column) -> Column:
    return sparse_meeting(a, b)["dot"]


def sparse_overlap(a: Column, b: Column) -> Column:
    return sparse_meeting(a, b)["overlap"]
