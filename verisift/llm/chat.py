"""Chat formatting by a grammar round trip.

Grammar of the output, one segment per turn::

    <|im_start|>ROLE \\n TEXT <|im_end|> \\n

A segment is rendered with the text as it is, read back by the parser and compared with its turn. Where they differ,
the text (or the role) holds something the grammar uses; it is escaped and rendered again until both are the same.
The escape puts one more backslash between ``<`` and ``|`` of a control string, and in a role also writes line ends
and backslashes as ``\\n`` and ``\\\\``; the parser takes it away again, so texts with escapes of their own survive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role), flags=re.S)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


class ChatParser:
    """Deterministic parser of the grammar; ``feed`` takes the output in pieces and gives the turns that are complete.

    A turn is (role, text, start of the text, end of the text), with offsets from the beginning of the output. Anything
    outside the grammar raises ValueError.
    """

    def __init__(self) -> None:
        self._open, self._offset = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        buffer, at = self._open + piece, 0
        while True:
            if not (START.startswith(buffer[at : at + len(START)])):
                raise ValueError(f"no turn starts at {self._offset + at}")
            line = buffer.find("\n", at)
            close = buffer.find(END, line + 1) if line >= 0 else -1
            if close < 0 or len(buffer) < close + len(END) + 1:
                break
            role, text = buffer[at + len(START) : line], buffer[line + 1 : close]
            if buffer[close + len(END)] != "\n" or START in text or START in role or END in role:
                raise ValueError(f"a control string stands inside the turn at {self._offset + at}")
            yield unescape_role(role), unescape_text(text), self._offset + line + 1, self._offset + close
            at = close + len(END) + 1
        self._open, self._offset = buffer[at:], self._offset + at

    def close(self) -> None:
        if self._open:
            raise ValueError("the output ends inside a turn")


def _read(segment: str) -> list[tuple[str, str]]:
    parser = ChatParser()
    try:
        turns = [(role, text) for role, text, _, _ in parser.feed(segment)]
        parser.close()
    except ValueError:
        return []
    return turns


def format_turn(role: str, text: str) -> str:
    """The first rendering that reads back as the turn: plain, text escaped, text and role escaped."""
    for r, t in ((role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))):
        if _read(segment := render(r, t)) == [(role, text)]:
            return segment
    raise AssertionError("the escaped form always reads back")


def format_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: conv_id, turn, role, segment, loss_start, loss_end (offsets of the text in the segment).

    The segments of a conversation, in order of (turn, role, segment) with nulls first, are its formatted text. A null
    role or text is empty; repeated rows stay repeated turns; a null conversation is one conversation. Only assistant
    turns are under the loss mask: others have null offsets. Other columns are not carried.
    """

    def render_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            segments = [format_turn(r, t) for r, t in zip(batch["role"], batch["text"], strict=True)]
            starts, ends = [], []
            for role, segment in zip(batch["role"], segments, strict=True):
                masked = role == "assistant"
                starts.append(segment.index("\n") + 1 if masked else None)
                ends.append(len(segment) - len(END) - 1 if masked else None)
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"],
                    "turn": batch["turn"],
                    "role": batch["role"],
                    "segment": segments,
                    "loss_start": pd.array(starts, dtype="Int64"),
                    "loss_end": pd.array(ends, dtype="Int64"),
                }
            )

    turns = conversations.select(
        F.col(conv_col).cast("string").alias("conv_id"),
        F.col(turn_col).cast("string").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Ids travel as strings, so that nulls and long ids come back as they were.
    out = turns.mapInPandas(
        render_batches,
        "conv_id string, turn string, role string, segment string, loss_start long, loss_end long",
    )
    return out.select(
        F.col("conv_id").cast(conversations.schema[conv_col].dataType).alias("conv_id"),
        F.col("turn").cast(conversations.schema[turn_col].dataType).alias("turn"),
        *("role segment loss_start loss_end".split()),
    )


class _Digest:
    """Running digests of one conversation read back from its segments; holds no text beyond an open segment."""

    def __init__(self) -> None:
        self.parser = ChatParser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, segment: str, loss_start: float, loss_end: float) -> None:
        """The next segment, with the offsets of what is under its mask, or no numbers."""
        self.formatted_chars += len(segment)
        for role, text, _, _ in self.parser.feed(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if not pd.isna(loss_start):
            text = unescape_text(segment[int(loss_start) : int(loss_end)])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv_id: str | None) -> tuple:
        self.parser.close()
        return (
            conv_id,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.formatted_chars,
        )


_DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text reads back as: turns, their digest, and the text that the loss mask cuts.

    The parser streams over the sorted segments, so a conversation of any length takes the memory of one segment. The
    digest of a conversation goes over its turns in order, so they all pass through one task.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        current, digest = None, None
        for batch in batches:
            done = []
            columns = (batch[c] for c in ("conv_id", "segment", "loss_start", "loss_end"))
            for conv, segment, start, end in zip(*columns, strict=True):
                conv = None if pd.isna(conv) else conv
                if digest is None or conv != current:
                    if digest is not None:
                        done.append(digest.row(current))
                    current, digest = conv, _Digest()
                digest.add(segment, start, end)
            yield pd.DataFrame(done, columns=names)
        if digest is not None:
            yield pd.DataFrame([digest.row(current)], columns=names)

    kind = formatted.schema["conv_id"].dataType
    ordered = (
        formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "segment")
        .select(F.col("conv_id").cast("string").alias("conv_id"), "segment", "loss_start", "loss_end")
    )
    return ordered.mapInPandas(read, _DIGEST).withColumn("conv_id", F.col("conv_id").cast(kind))
