r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Name: `` + text + `` </turn>`` and a line feed. Names are those of ``ROLES``; any other role
is written ``@`` and its UTF-8 bytes, percent-encoded but for letters and digits. Control strings are a header's text and
the turn's end. A backslash before a backslash or a control string escapes it; elsewhere it is an ordinary character.

A text is rendered as it is, then parsed; unless exactly the turn comes back, its control strings are escaped, then its
backslashes as well, and each form is parsed again, until the result is identical. The parser is deterministic: at each
place it takes an escape, else the turn's end, else one character.

Turns are rendered one by one; a conversation is the segments of its turns in order of (turn, segment), nulls first. Beside
a segment lies its part of the loss mask, a span of code points: the escaped text of an assistant's turn, else nothing.
The formatted output is a table of segments and spans. Reading back streams over its sorted rows and nothing else: it holds a
turn and running digests, never a conversation. What the mask covers is digested by the mask, whatever the parser says
of roles; where the two disagree, reading raises.

Null texts and null roles are empty. Rows that repeat are turns of their own. Rows with a null conv_id are one
conversation. Other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, checked, written

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
END = " </turn>\n"
_HEADER = r"### (?:System|User|Assistant|@[A-Za-z0-9%]*): "
_CONTROL = re.compile(rf"{_HEADER}|###|</turn>")
_TOKEN = re.compile(rf"\\(\\|{_HEADER}|###|</turn>)| </turn>\n|</turn>|###")
_START = re.compile(r"### (System|User|Assistant|@[A-Za-z0-9%]*): ")
LOSS = "assistant"

SEGMENTS = arrow_schema(conv_id=pa.int64(), turn=pa.int64(), segment=pa.string(), loss_start=pa.int64(), loss_end=pa.int64())
DIGESTS = arrow_schema(conv_id=pa.int64(), n_turns=pa.int64(), turns_sha256=pa.string(), loss_chars=pa.int64(), loss_sha256=pa.string(), formatted_chars=pa.int64())


class Broken(ValueError):
    """The text isn't of the grammar."""


def name_of(role: str) -> str:
    return ROLES.get(role) or "@" + "".join(c if c.isascii() and c.isalnum() else quote(c, safe="") if not c.isascii() else f"%{ord(c):02X}" for c in role)


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that starts at a place: role, text, start and end of its escaped text, and where the next one starts."""
    head = _START.match(text, at)
    if not head:
        raise Broken(f"no header at {at}")
    name, begin = head[1], head.end()
    parts, last = [], begin
    for token in _TOKEN.finditer(text, begin):
        if token[1] is not None:
            parts += [text[last : token.start()], token[1]]
            last = token.end()
        elif token[0] == END:
            parts.append(text[last : token.start()])
            return NAMES.get(name) or unquote(name[1:]), "".join(parts), begin, token.start(), token.end()
        else:
            raise Broken(f"a control string at {token.start()}")
    raise Broken("a turn without an end")


def unescaped(form: str) -> str:
    """The text of an escaped form that holds no control string."""
    parts, last = [], 0
    for token in _TOKEN.finditer(form):
        if token[1] is None:
            raise Broken(f"a control string at {token.start()}")
        parts += [form[last : token.start()], token[1]]
        last = token.end()
    return "".join(parts) + form[last:]


def escapes(text: str) -> Iterator[str]:
    """The text as it is, with control strings escaped, and with backslashes escaped as well."""
    yield text
    yield _CONTROL.sub(lambda m: "\\" + m[0], text)
    yield _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the start and end of its text there, that parse to exactly this role and text."""
    head = f"### {name_of(role)}: "
    for form in escapes(text):
        segment = head + form + END
        try:
            if parse(segment) == (role, text, len(head), len(head) + len(form), len(segment)):
                return segment, len(head), len(head) + len(form)
        except Broken:
            pass
    raise Broken(f"no form of {text[:80]!r} comes back")


def masked(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the span of it that is learnt: of an assistant the escaped text, of others nothing."""
    segment, start, end = render(role, text)
    return (segment, start, end) if role == LOSS else (segment, 0, 0)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [masked(role or "", text or "") for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        arrays = [pa.array(x) for x in zip(*done)] if done else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=SEGMENTS)


def segments(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, segment, loss_start, loss_end (code points in the segment; equal: no loss)."""
    df = checked(conversations, "conv_id", "turn", "role", "text")
    return arrow_map(df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), _rendered, SEGMENTS)


def in_order(parts: DataFrame) -> DataFrame:
    """Conversations whole in a partition, turns in order."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


class _Reading:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int, end: int) -> None:
        role, text, a, b, after = parse(segment)
        if after != len(segment):
            raise Broken(f"more than a turn in {segment[:80]!r}")
        if (start, end) != (a, b) if role == LOSS else start != end:
            raise Broken(f"the mask {start}:{end} isn't that of the turn {segment[:80]!r}")
        learnt = unescaped(segment[start:end])
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(learnt.encode())
        self.n_turns += 1
        self.loss_chars += len(learnt)
        self.chars += len(segment)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Reading | None = None
    for batch in batches:
        out = []
        for conv_id, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Reading(conv_id)
            now.add(segment, start, end)
        yield pa.RecordBatch.from_pylist(out, schema=DIGESTS)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema=DIGESTS)


def formatted(conversations: DataFrame) -> DataFrame:
    """The formatted output, read from the table in the shared folder to which it is written: segments and their mask."""
    return written(segments(conversations), "chat")


def read_back(output: DataFrame) -> DataFrame:
    """Parse formatted segments again: a row for each conversation, of digests of what was read."""
    return arrow_map(in_order(output).select("conv_id", "segment", "loss_start", "loss_end"), _read, DIGESTS)


PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9(conversations: DataFrame) -> DataFrame:
    extra = conversations.sparkSession.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(formatted(checked(conversations, "conv_id", "turn", "role", "text").unionByName(extra)))
