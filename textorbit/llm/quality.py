"""Quality rules on whole texts: word and line counts, and compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.llm import words
from textorbit.llm.arrow import raw_texts

SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Band:
    """Allowed ratios of raw to compressed bytes, for texts of fewer than ``below`` bytes."""

    below: float
    least: float
    most: float


#: Short texts hardly compress, long ones find more to repeat, so limits rise with length.
#: Ratios of clean prose (sf0.1, label 1, four languages): 1.38-1.84 under 512 bytes, 1.47-2.15
#: under 2,048, 1.92-2.34 under 8,192, 2.22-2.48 above.  Upper limits are about a tenth above those,
#: lower ones a tenth to a sixth below, as other scripts compress less.  Texts above 65,536 bytes
#: were few there; prose of some megabytes packs better, so their upper limit is wider.
BANDS = (
    Band(128, 0.7, 1.6),
    Band(512, 1.15, 2.05),
    Band(2_048, 1.3, 2.35),
    Band(8_192, 1.6, 2.6),
    Band(65_536, 1.85, 2.75),
    Band(float("inf"), 1.85, 3.3),
)


@dataclass(frozen=True)
class Rules:
    bands: tuple[Band, ...] = BANDS
    level: int = 3
    chunk_bytes: int = 4_096
    #: Share of a text's bytes that may stand in chunks outside their bands.
    bad_share: float = 0.25
    least_words: int = 50
    repeat_words: int = 3
    repeat_percent: int = 50


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, bad_chunks long, reason string"
)


def repeated_words(hashes: np.ndarray, size: int) -> int:
    """Words that stand in a window of ``size`` words found twice or more."""
    found = words.windows(hashes, size)
    if not len(found):
        return 0
    _, which, count = np.unique(found, return_inverse=True, return_counts=True)
    again = (count > 1)[which]
    covered = np.zeros(len(hashes), bool)
    for i in range(size):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def _verdict(ratio: float, n_bytes: int, bands: tuple[Band, ...]) -> str | None:
    band = next(b for b in bands if n_bytes < b.below)
    return "incompressible" if ratio < band.least else "repetitive" if ratio > band.most else None


def _measure(data: bytes, rules: Rules, packer: zstandard.ZstdCompressor) -> tuple:
    hashes = words.word_hashes(data)
    n_words = len(hashes)
    inside = data.translate(None, words.SEPARATORS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeats = repeated_words(hashes, rules.repeat_words)
    failed = n_words < rules.least_words or 100 * repeats > rules.repeat_percent * n_words
    ratio, chunks, bad, bad_bytes, reason = 0.0, 0, 0, 0, None
    if data:
        ratio = len(data) / len(packer.compress(data))
        reason = _verdict(ratio, len(data), rules.bands)
        for at in range(0, len(data), rules.chunk_bytes):
            chunk = data[at : at + rules.chunk_bytes]
            chunks += 1
            if _verdict(len(chunk) / len(packer.compress(chunk)), len(chunk), rules.bands):
                bad += 1
                bad_bytes += len(chunk)
        if reason is None and bad_bytes > rules.bad_share * len(data):
            reason = "chunks"
    if failed:
        reason = "base"
    return (
        n_words,
        len(inside.translate(None, _CONTINUED)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        reason is None,
        len(data),
        ratio,
        chunks,
        bad,
        reason,
    )


def _checked(rules: Rules) -> Rules:
    bands = tuple(sorted(rules.bands, key=lambda b: b.below))
    if bands[-1].below != float("inf"):
        raise ValueError("the last band must have no upper length")
    return replace(rules, bands=bands)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts, compression ratios and verdict for each row of ``docs``; no shuffle.

    Words are runs of other than ASCII white space.  A text fails the base rules with
    fewer than ``least_words`` words, or more than ``repeat_percent`` per cent of words in
    repeated windows.  Otherwise its zstandard ratio must lie in the band of its length,
    and at most ``bad_share`` of its bytes may be in fixed chunks outside theirs.
    ``reason`` says which rule rejected it: base, incompressible, repetitive or chunks.

    A null or empty text has no words, ratio 0 and fails the base rules.  Repeated rows
    are judged one by one, a null id stays null, other columns don't matter, and an
    empty table gives an empty result.  A long text is hashed in pieces; only one text
    of a batch is worked on at a time.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rules = _checked(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [_measure(data, rules, packer) for data in raw_texts(batch.column(1))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(measure, SCHEMA)


def keep_quality(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; no shuffle."""
    rules = _checked(rules)

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for column in batches:
            yield pd.Series([_measure(t.encode() if t else b"", rules, packer)[6] for t in column], dtype=bool)

    return docs.where(kept(F.col(text).cast("string")))
