import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textorbit.llm import packing, plans, token_output
from textorbit.llm.vocabulary import load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_vocabulary(library):
    rng = random.Random(3)
    letters = "abcdefghij the in 's 'll on er  \n\t\r 　.,=-_/é日🤗ñ0123\x1c\x85"
    texts = ["", "  hello   world ", "x<|endoftext|>y <|endoftext|>  <|endoftext|> z", "a\n b", "don't I'll", "tail "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(load(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def ours(text):
    return np.frombuffer(load(PATH).encode(text), "<u4").tolist()


def test_white_space_of_millions(library):
    for run in (" " * 2_000_000, "\n" * 2_000_000, "\u3000" * 1_100_000, " \n\t" * 700_000):
        for text in (run, f"a{run}b", f"it's {run}\n", f"x{run}<|endoftext|>y"):
            assert ours(text) == library.encode(text, add_special_tokens=False).ids


def test_cut_runs_change_no_id(library, monkeypatch):
    monkeypatch.setattr("textorbit.llm.vocabulary.LONG_RUN", 2)
    rng = random.Random(4)
    parts = ["a", "it's", "9", "=", " ", "  ", "\n", "\t", "\r", "\u3000", "\x85", "\x1c", "\u200b", "é", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert ours(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_white_space_ends_no_job(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "two words")], "doc_id long, text string")
    assert {r.doc_id for r in plans.packed_pieces(docs).select("doc_id").collect()} == {1, 2}
    rows = token_output.packed_matrices(docs, PATH).select("doc_ids").collect()
    assert {d for r in rows for d in r.doc_ids} == {1, 2}


def itemwise(lengths, window):
    """Windows and their free places by best fit decreasing, one piece after another."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [c for c in free if c >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(window - length)
    return sorted(free)


@pytest.mark.parametrize("seed", range(12))
def test_moves_equal_itemwise_best_fit(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 7, 64, 100])
    lengths = [rng.randrange(1, window + 1) for _ in range(rng.randrange(300))]
    used = Counter()
    for m in packing.best_fit_moves(dict(Counter(lengths)), window):
        for i in range(m.count):
            place, offset = m.window + i // m.each, m.offset + i % m.each * m.length
            assert used[place] == offset
            used[place] += m.length
    assert sorted(window - u for u in used.values()) == itemwise(lengths, window)
    assert not used or len(used) == max(used) + 1
    got = token_output._best_fit(lengths, window)
    assert sorted(window - sum(lengths[i] for i in part) for part in got) == itemwise(lengths, window)


def test_number_of_moves_does_not_follow_the_data():
    counts = {length: 7 + length % 5 for length in range(1, 513)}
    few = packing.best_fit_moves(counts, 512)
    many = packing.best_fit_moves({k: 1000 * v for k, v in counts.items()}, 512)
    assert len(many) < 2 * len(few) + 512


def test_bad_length():
    with pytest.raises(ValueError):
        packing.best_fit_moves({9: 1}, 8)


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_pieces(table, request, library, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 60)
    docs = request.getfixturevalue(table)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(ids_of(library, r.text))
    rows = plans.packed_pieces(docs).collect()
    want, got = Counter(), Counter()
    for doc, many in texts.items():
        for ids in many:
            for start in range(0, len(ids), 2048):
                part = np.array(ids[start : start + 2048], "<u4")
                want[doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    windows = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        windows[r.sequence_id].append((r.offset, r.length))
    assert got == want
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(windows) == len(itemwise([r.length for r in rows], 2048))


def test_empty_table(no_docs):
    assert plans.packed_pieces(no_docs).count() == 0
    assert token_output.packed_matrices(no_docs, PATH).count() == 0


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_matrices_round_trip(table, request, library, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "SHARD_DOCS", 70)
    docs = request.getfixturevalue(table)
    want = Counter((r.doc_id, tuple(ids_of(library, r.text))) for r in docs.select("doc_id", "text").collect())
    token_output.write_matrices(token_output.packed_matrices(docs, PATH), str(tmp_path / "m"))
    rows = token_output.read_matrices(spark, str(tmp_path / "m"))
    for r in rows.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 2048 and (ids[r.n_tokens :] == 0).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] + [r.n_tokens] * (r.n_tokens < 2048)
        assert len(r.doc_ids) == len(r.doc_starts) == len(r.cu_seqlens) - 1
    places = Counter((r.shard, r.row) for r in rows.collect())
    assert max(places.values()) == 1
    parts = defaultdict(list)
    for r in token_output.segments(rows, PATH).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
        assert len(parts[r.doc_id][-1][1]) == r.length
    got = Counter()
    for doc, many in parts.items():
        if len([s for s, _ in many if s == 0]) == 1:
            got[doc, tuple(i for _, ids in sorted(many) for i in ids)] += 1
        else:  # repeated ids: these texts fit in a window
            for _, ids in many:
                got[doc, tuple(ids)] += 1
    assert got == want


def test_rests_of_a_shard_are_bounded(spark, library, monkeypatch):
    """Rows equal in id and text fall into one shard; it never holds more than a few of their rests."""
    monkeypatch.setattr(token_output, "RESTS", 10)
    held = []
    close = token_output._Shard.close
    monkeypatch.setattr(token_output._Shard, "close", lambda self: held.append(len(self.rests)) or close(self))
    shard = token_output._Shard(0, 64, b"\0\0", 2)
    rows = [row for i in range(95) for row in shard.add(7, bytes(2 * (3 + i % 50)))] + list(shard.close())
    assert max(held) <= 10 and sum(held) == 95
    assert [r[1] for r in rows] == list(range(len(rows)))
    assert sum(r[3] for r in rows) == sum(3 + i % 50 for i in range(95))
