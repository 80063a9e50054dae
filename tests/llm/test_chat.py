import hashlib
import random
from collections import defaultdict

import pytest

from textorbit.llm import chat

ODD = [
    (1, 0, "system", "be [INST] kind </s>"),
    (1, 1, "user", "\\ [/INST] \\\\ <\\s> < s>"),
    (1, 2, "assistant", "ok</s>\\"),
    (2, 0, "assistant", "first"),
    (2, 1, "assistant", None),
    (3, 0, "tool", "a[:]b [/ROLE]"),
    (3, None, "to[:]ol", "x"),
    (4, 0, None, "no role"),
    (5, 0, "user", ""),
    (5, 1, "assistant", ""),
    (6, 0, "user", "again"),
    (6, 0, "user", "again"),
    (7, 0, "user", "y" * 500_000),
    (7, 1, "assistant", "[ANS] " * 50_000),
    (None, 0, "user", "lost"),
]


def order(row):
    return (row[1] is not None, row[1] or 0), (row[2] is not None, row[2] or ""), (row[3] is not None, row[3] or "")


def plain(rows):
    chats = defaultdict(list)
    for row in rows:
        chats[row[0]].append(row)
    out = {}
    for conv, turns in chats.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=order)]
        every = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def read(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_chats(table.selectExpr("*", "1 as segment", "2 as loss", "3 as problem").repartition(4))
    return segments, {r.conv_id: tuple(r)[1:] for r in chat.read_back(segments).collect()}


def test_odd_turns_read_back(spark):
    segments, got = read(spark, ODD)
    assert {k: v[:4] for k, v in got.items()} == plain(ODD)
    text = defaultdict(str)
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id or 0, r.segment)):
        text[r.conv_id] += r.text
    assert {k: len(v) for k, v in text.items()} == {k: v[4] for k, v in got.items()}
    assert text[1].count("[INST]") == 1 and text[1].count("</s>") == 1
    problems = {k: v[5] for k, v in got.items()}
    assert problems[1] is None and problems[5] is None and problems[7] is None
    assert problems[2] == "assistant after the start"
    assert problems[4] == "no role after the start"
    assert problems[6] == "user after user"
    assert problems[None] == "ends after user"


def test_quote_is_reversible():
    rng = random.Random(8)
    form = chat.BRACKETS
    bits = [*form.controls, "\\", "<", "[", "/", "s>", "]", "INST", " ", "x"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        quoted = form.quote(text)
        assert form.unquote(quoted) == text
        assert not any(c in quoted for c in form.controls)


def test_templates_that_cannot_be_read_back():
    user = {"user": chat.Turn("[A] ", " [/A]")}
    rest = {"other": chat.Turn("[B] ", " [/B]"), "between": "[:]", "order": {}, "final": ()}
    good = ("[A]", "[/A]", "[B]", "[/B]", "[:]")
    chat.Template("", user, controls=good, **rest)
    for controls in (good[1:], (*good, "x["), (*good, "y"), (*good, "a\\b")):
        with pytest.raises(ValueError):
            chat.Template("", user, controls=controls, **rest)
    with pytest.raises(ValueError):
        chat.Template("", {**user, "also": chat.Turn("[A] ", " [/A]")}, controls=good, **rest)


def test_text_that_is_no_chat(spark):
    rows = spark.createDataFrame([(1, 0, "<s>", False, None), (1, 1, "loose", False, None)], chat.SEGMENTS)
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(rows).collect()


def test_empty_table(spark):
    segments, got = read(spark, [])
    assert segments.count() == 0 and got == {}
