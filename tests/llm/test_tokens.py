import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from textorbit.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = [
    "", " ", "   ", "  hello   world ", "a\tb\nc", "x</s>y <s> <unk> <0x0A>", "ﬁ ½ 　x", "\u0000a", "a▁b", "a ▁ b",
    "日本語🤗🤗 テスト", "ababababa" * 30, "a" * 3000, " " * 100, "\n\n\n\n    x", "1234567890.12", "=" * 77, "ААААа́́",
]


def test_odd_texts(library):
    rng = random.Random(3)
    letters = "abcdefghij the in on er  ▁\n\t.,=-_/é日🤗ñ0123"
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000, 7)]
    many = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(1500)]
    many += ["".join(rng.choice(pieces) for _ in range(10)) for _ in range(1500)]
    assert tokens.count_tokens(many, PATH) == [len(i) for i in library.encode(many)]


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_documents(table, request, library):
    docs = request.getfixturevalue(table)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or ""))
        want[r.doc_id, len((r.text or "").encode()), n, n > 4096] += 1
    got = Counter(tuple(r) for r in tokens.token_counts(docs, PATH).collect())
    assert got == want


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "CHARACTERS", 50)
    texts = [f"some words {i} to count, again and again" for i in range(50)]
    assert tokens.count_tokens(texts, PATH) == [len(i) for i in library.encode(texts)]


def test_empty_table(no_docs):
    assert tokens.token_counts(no_docs, PATH).count() == 0


def test_memory_is_bounded_by_characters(monkeypatch):
    """Texts without spaces are long pre-tokens, which are never remembered; short ones are, up to a size."""
    monkeypatch.setattr(tokens, "REMEMBERED", 50_000)
    tokens._memory.cache_clear()
    path = PATH
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    for k in range(30):
        column = [chr(0x4E00 + (7 * k + i) % 900) * 5 + "\u6f22\u5b57\u3042" * 700 + str(i) for i in range(5)]
        column += [" ".join(f"w{k}x{j}" for j in range(80)), "a b " + "long" * 40 + " a b"]
        assert tokens.count_tokens(column, path) == [len(whole.encode(t)) for t in column]
        memory = tokens._memory(path)
        assert memory.size == sum(map(len, memory)) + tokens.ENTRY * len(memory)
        assert memory.size < 50_000 + 100 * 120 and max(map(len, memory)) <= tokens.WORD
