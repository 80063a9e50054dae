import base64
import random
import re
from collections import Counter

import pytest
import zstandard

from textorbit.llm import quality

from .conftest import PROSE


def plain(text):
    """The counts by their definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def plain_kept(text, rules=quality.Rules()):
    data = (text or "").encode()
    if plain(text)[-1]:
        return False

    def bad(part):
        ratio = len(part) / len(zstandard.ZstdCompressor(level=rules.level).compress(part))
        band = next(b for b in rules.bands if len(part) < b.below)
        return not band.least <= ratio <= band.most

    parts = [data[i : i + rules.chunk_bytes] for i in range(0, len(data), rules.chunk_bytes)]
    return not bad(data) and sum(len(p) for p in parts if bad(p)) <= rules.bad_share * len(data)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_counts_and_verdicts(table, request):
    docs = request.getfixturevalue(table)
    want = Counter((r.doc_id, *plain(r.text), plain_kept(r.text)) for r in docs.select("doc_id", "text").collect())
    got = Counter((r.doc_id, *(r[c] for c in COUNTS), r.kept) for r in quality.quality(docs).collect())
    assert got == want


def test_compression_bands(spark):
    rng = random.Random(4)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4)) for _ in range(2000))
    names = [f"item{i}" for i in range(60)]
    lists = "\n".join(" ".join(names[:i] + [str(i)] + names[i:]) for i in range(60))
    mixed = " ".join(rng.choice(PROSE.split()) + str(rng.randrange(9)) for _ in range(1500))
    mixed += "\n" + "".join(chr(rng.randrange(0x4E00, 0x9FA5)) + (" " if i % 5 == 0 else "") for i in range(3000))
    docs = spark.createDataFrame([(1, noise), (2, lists), (3, mixed), (4, PROSE), (5, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.reason) for r in quality.quality(docs).collect()}
    assert got[1] == (False, "incompressible")
    assert got[2][0] is False
    assert got[4] == (True, None)
    assert got[5] == (False, "base")
    kept = {r.doc_id for r in quality.keep_quality(docs.selectExpr("*", "1 as kept")).collect()}
    assert kept == {k for k, v in got.items() if v[0]}


def test_chunks_outside_their_band(spark):
    rng = random.Random(5)
    unlike = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4000))
    rules = quality.Rules(bands=(quality.Band(5_000, 0.0, 1.0), quality.Band(float("inf"), 0.0, 100.0)))
    docs = spark.createDataFrame([(1, unlike)], "doc_id long, text string")
    (row,) = quality.quality(docs, rules=rules).collect()
    assert (row.kept, row.reason, row.bad_chunks) == (False, "chunks", row.n_chunks)


def test_empty_table_and_bands(no_docs):
    assert quality.quality(no_docs).count() == 0
    assert quality.keep_quality(no_docs).columns == no_docs.columns
    with pytest.raises(ValueError):
        quality.quality(no_docs, rules=quality.Rules(bands=(quality.Band(10, 0, 1),)))


def test_bands_part_prose_from_repeats_and_encodings(spark):
    rng = random.Random(6)
    letters = "etaoinshrdlucmfwyp"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    def repeats(n):  # 45 in 100 words stand in repeated lines
        line = prose(30)
        return "\n".join([prose(n - n * 9 // 20), *[line] * (n * 9 // 20 // 30)])

    def encoded(n):
        return " ".join(base64.b64encode(rng.randbytes(12)).decode() for _ in range(n))

    rows, want = [], {}
    for n in (200, 800, 3000, 20_000):
        for text, reasons in ((prose(n), {None}), (repeats(n), {"repetitive", "chunks"}), (encoded(n), {"incompressible"})):
            want[len(rows)] = reasons
            rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality.quality(docs).collect():
        assert not r.base_failed
        assert r.reason in want[r.doc_id], (r.doc_id, r.n_bytes, r.ratio, r.reason)
