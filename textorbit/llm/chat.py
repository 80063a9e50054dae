"""Chat formatting from a declarative template, with a loss flag per text segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """What stands before and after a text, and whether the text counts for the loss."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role and the state machine of roles.

    The state is the last role (``start`` stands for none yet); ``order`` has the roles that may
    follow it and ``final`` the states a conversation may end in.  ``controls`` are the
    strings that must not stand inside a text.
    """

    opening: str
    roles: Mapping[str, Turn]
    other: Turn
    between: str
    order: Mapping[str, tuple[str, ...]]
    final: tuple[str, ...]
    controls: tuple[str, ...]
    escape: str = "\\"
    start: str = "^"
    _marks: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c for c in self.controls):
            raise ValueError("controls need two characters or more, none of them the escape")
        firsts = {c[0] for c in self.controls}
        if any(f in c[1:] for f in firsts for c in self.controls):
            raise ValueError("a control must not begin inside another one")
        opens = [self.other.opens, *(t.opens for t in self.roles.values())]
        if any(a != b and a.startswith(b) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("opening marks must tell the roles apart")
        closes = [self.between, self.other.closes, *(t.closes for t in self.roles.values())]
        if any(not any(c in mark for c in self.controls) for mark in [*opens, *closes]):
            raise ValueError("every mark must hold a control")
        begins = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        object.__setattr__(self, "_marks", re.compile(f"({begins})|{re.escape(self.escape)}"))

    def quote(self, text: str) -> str:
        """Break every control by an escape after its first character; double the escape."""
        return self._marks.sub(lambda m: m[0] + self.escape, text)

    def unquote(self, text: str) -> str:
        mark = re.escape(self.escape)
        return re.sub(f"{mark}({mark}?)", lambda m: m[1], text)


#: Marks in square brackets around system and user turns, an end mark after answers.
BRACKETS = Template(
    opening="<s>",
    roles={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[ANS] ", "</s>", loss=True),
    },
    other=Turn("[ROLE] ", " [/ROLE]"),
    between="[:]",
    order={"^": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[:]"),
)

SEGMENTS = "conv_id long, segment long, text string, loss boolean, problem string"


def _segment_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "segment", "text", "loss", "problem"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        size += len(row[2])
        if len(held) >= 10_000 or size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def format_chats(conversations: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """Segments of every conversation's formatted text, in order, with loss flags.

    ``conversations`` has a row per turn: ``conv_id, turn, role, text``.  A task walks its
    conversations turn by turn, so a conversation of any length takes the memory of one
    turn.  Returns ``conv_id``, ``segment`` (from 0), ``text``, ``loss`` and ``problem``: on the
    segment that opens a turn the state machine does not allow there, and on the closing
    empty segment of a conversation that ends where it must not.  Faulty conversations
    are formatted like others.

    Turns follow one another by turn, role and text, nulls first, so repeated rows are
    turns of their own.  A null text is empty; a role without marks, or null (the empty
    role), gets the template's general ones; rows with a null id form one conversation.
    Other columns don't matter; an empty table gives no row.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state, number = None, None, 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                role, text = role or "", text or ""
                if state is None or conv != current:
                    if state is not None:
                        yield current, number, "", False, _ending(template, state)
                    yield conv, 0, template.opening, False, None
                    current, state, number = conv, template.start, 1
                allowed = role in template.order.get(state, ())
                problem = None if allowed else f"{role or 'no role'} after {'the start' if state == template.start else state or 'no role'}"
                turn = template.roles.get(role)
                opens = turn.opens if turn else template.other.opens + template.quote(role) + template.between
                turn = turn or template.other
                yield conv, number, opens, False, problem
                yield conv, number + 1, template.quote(text), turn.loss, None
                yield conv, number + 2, turn.closes, False, None
                state, number = role, number + 3
        if state is not None:
            yield current, number, "", False, _ending(template, state)

    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(lambda batches: _segment_batches(walk(batches)), SEGMENTS)


def _ending(template: Template, state: str) -> str | None:
    return None if state in template.final else f"ends after {state or 'no role'}"


class _Reader:
    """Reads one formatted conversation back, piece by piece."""

    def __init__(self, template: Template):
        self.template = template
        self.text, self.opened = "", False
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        self.problem = None

    def feed(self, text: str, loss: bool, problem: str | None) -> None:
        self.chars += len(text)
        self.problem = self.problem or problem
        if loss:
            plain = self.template.unquote(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.text += text
        while self._turn():
            pass

    def _turn(self) -> bool:
        """Take one whole turn off the text read so far."""
        form = self.template
        if not self.opened:
            if len(self.text) < len(form.opening):
                return False
            if not self.text.startswith(form.opening):
                raise ValueError("the text does not open a conversation")
            self.text, self.opened = self.text[len(form.opening) :], True
        marks = [*form.roles.items(), (None, form.other)]
        role, turn = next(((r, t) for r, t in marks if self.text.startswith(t.opens)), (None, None))
        if turn is None:
            return False
        end = self.text.find(turn.closes, len(turn.opens))
        if end < 0:
            return False
        inside = self.text[len(turn.opens) : end]
        if role is None:
            role, _, inside = inside.partition(form.between)
            role = form.unquote(role)
        for part in (role, "\n", form.unquote(inside), "\n"):
            self.digest.update(part.encode("utf-8", "surrogatepass"))
        self.turns += 1
        self.text = self.text[end + len(turn.closes) :]
        return True

    def row(self, conv: int | None) -> tuple:
        if self.text:
            raise ValueError(f"conversation {conv}: text left over that is no turn")
        found = (self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.problem)
        return conv, *found


READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
    " problem string"
)


def read_back(segments: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """What the formatted text alone says: turns found in it, and the text under the mask.

    Digests are of each turn's role and plain text with a line feed after each, and of the
    plain text of all loss segments.  ``problem`` is the first one of the conversation.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        current, reader, rows = None, None, []
        for part in batches:
            for conv, text, loss, problem in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        rows.append(reader.row(current))
                    current, reader = conv, _Reader(template)
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
                reader.feed(text, loss, problem)
        if reader is not None:
            rows.append(reader.row(current))
        if rows:
            yield batch(rows)

    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(walk, READ)
