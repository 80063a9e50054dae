"""Column functions for identifiers, numbers and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = "models--"


def model_id_from_dir(name: Column) -> Column:
    """``models--org--name`` -> ``org/name``; only the first ``--`` is the slash."""
    rest = F.substr(name, F.lit(len(_PREFIX) + 1))
    at = F.instr(rest, "--")
    return F.when(
        name.startswith(_PREFIX),
        F.when(
            at > 0,
            F.concat(F.substr(rest, F.lit(1), at - 1), F.lit("/"), F.substr(rest, at + 2)),
        ).otherwise(rest),
    )


def dir_from_model_id(model_id: Column) -> Column:
    return F.concat(F.lit(_PREFIX), F.replace(model_id, F.lit("/"), F.lit("--")))


def short_name(model: Column, length: int | None = None) -> Column:
    """Part after the last ``/``, optionally its first ``length`` characters."""
    name = F.element_at(F.split(model, "/"), -1)
    return name if length is None else F.substring(name, 1, length)


def fixed(value: Column, digits: int) -> Column:
    """Number text with fixed digits, rounding the exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal text of a double instead, so
    1.15 would become 1.2 although the stored number is below 1.15.  The
    fraction is taken as an exact multiple of 2**-60 and rounded in integers.
    """
    ten = 10**digits
    unit = 2**60
    x = F.abs(value.cast("double"))
    whole = F.floor(x)
    scaled = ((x - whole) * float(unit)).cast("long").cast("decimal(19,0)") * F.lit(ten).cast(
        "decimal(10,0)"
    )
    rest = scaled % F.lit(unit).cast("decimal(19,0)")
    kept = ((scaled - rest) / F.lit(unit).cast("decimal(19,0)")).cast("long")
    twice = rest * 2
    up = (twice > unit) | ((twice == unit) & ((kept + whole * ten) % 2 == 1))
    total = whole * ten + kept + F.when(up, 1).otherwise(0)
    text = (
        total.cast("string")
        if digits == 0
        else F.concat(
            F.floor(total / ten).cast("string"),
            F.lit("."),
            F.lpad((total % ten).cast("string"), digits, "0"),
        )
    )
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def humanize_params(n: Column, missing: str = "?") -> Column:
    """Parameter count as ``1.5B`` or ``23M``; there is no smaller unit."""
    number = n.cast("double")
    return F.when(n.isNull(), F.lit(missing)).otherwise(
        F.when(n >= 1_000_000_000, F.concat(fixed(number / 1e9, 1), F.lit("B"))).otherwise(
            F.concat(fixed(number / 1e6, 0), F.lit("M"))
        )
    )


def humanize_ms(ms: Column, missing: str = "?") -> Column:
    """Duration as ``1.0s`` from 1000 ms on, else ``999ms``."""
    return F.when(ms.isNull(), F.lit(missing)).otherwise(
        F.when(ms >= 1000, F.concat(fixed(ms / 1000, 1), F.lit("s"))).otherwise(
            F.concat(fixed(ms.cast("double"), 0), F.lit("ms"))
        )
    )


def number_or(value: Column, digits: int, missing: str, suffix: str = "") -> Column:
    """Fixed-digit text; null and zero count as missing."""
    return F.when(
        value.isNotNull() & (value != 0), F.concat(fixed(value, digits), F.lit(suffix))
    ).otherwise(F.lit(missing))


def estimate_parameters(vocab: Column, hidden: Column, layers: Column) -> Column:
    """Embedding table plus twelve hidden-squared blocks per layer; null if one is missing."""
    h = hidden.cast("long")
    return vocab.cast("long") * h + layers.cast("long") * F.lit(12).cast("long") * h * h


def round6(value: Column) -> Column:
    """Six decimals by floor(x * 1e6 + 0.5), the same arithmetic in every engine."""
    return F.floor(value * 1e6 + 0.5) / F.lit(1e6)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, with or without a time zone on the column."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))
