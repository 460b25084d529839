"""Chat formatting with typed content parts, and reading the format back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
TOKENS = {"image": 576, "audio": 250, "document": 1_024}  # expanded tokens of a part that names no number
PART = "struct<type:string,text:string,ref:string,tokens:long>"
SEGMENT = (
    "segment string, loss_start long, loss_end long, expanded_tokens long, "
    "attachments array<struct<position:long,type:string,ref:string,tokens:long>>"
)

_control = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<(\\*)\\\|")
_placeholder = re.compile(r"<\|(?:image|audio|document):(\d+)\|>")
_turn = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    r"""Break every ``<|`` with a backslash; one more where backslashes already stand between."""
    return _control.sub(lambda m: "<" + m[1] + "\\|", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "<" + m[1] + "|", text)


class Flattener:
    """Visits the parts of one turn in order; a method per type of part."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.texts: list[str] = []  # adjoining texts, escaped as one: a control string may span them
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part: {kind}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def body(self) -> str:
        self._flush()
        return "".join(self.pieces)

    def _flush(self) -> None:
        self.pieces.append(escape("".join(self.texts)))
        self.texts = []

    def _attach(self, part: dict) -> None:
        kind = part["type"]
        tokens = part.get("tokens")
        tokens = TOKENS[kind] if tokens is None else int(tokens)
        position = len(self.attachments)
        self.attachments.append({"position": position, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens
        self._flush()
        self.pieces.append(f"<|{kind}:{position}|>")

    visit_image = visit_audio = _attach

    def visit_document(self, part: dict) -> None:
        self._attach(part)
        self.visit_text(part)


def format_turn(role: str | None, parts: list[dict] | None) -> dict:
    """One turn as marked text, its loss span, and what its placeholders stand for.

    A line break in a role would end it, so roles may have none.
    """
    role = role or ""
    if "\n" in role:
        raise ValueError("a role has no line breaks")
    flat = Flattener()
    for part in parts if parts is not None else ():
        flat.visit(part)
    body = flat.body()
    head = f"{OPEN}{escape(role)}\n"
    start = len(head) if role == LOSS_ROLE else None
    return {
        "segment": f"{head}{body}{CLOSE}\n", "loss_start": start, "loss_end": None if start is None else start + len(body),
        "expanded_tokens": flat.tokens, "attachments": flat.attachments,
    }


def read_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn without placeholders."""
    found = _turn.fullmatch(segment)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def read_parts(segment: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """(role, parts) of a formatted turn, its placeholders replaced by what was recorded.

    Adjoining texts come back as one part, and the text of a document as a text part.
    """
    found = _turn.fullmatch(segment)
    if found is None:
        raise ValueError("not a formatted turn")
    known, parts = {x["position"]: x for x in attachments}, []
    for i, piece in enumerate(_placeholder.split(found[2])):
        if i % 2:
            held = known[int(piece)]
            parts.append({"type": held["type"], "ref": held["ref"], "tokens": held["tokens"]})
        elif piece:
            parts.append({"type": "text", "text": unescape(piece)})
    return unescape(found[1]), parts


def read_conversation(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a whole formatted conversation."""
    ends = text.split(CLOSE + "\n")
    if ends.pop():
        raise ValueError("text after the last turn")
    return [read_turn(turn + CLOSE + "\n") for turn in ends]


def text_parts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts): plain texts as one text part each; NULL text is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    return turns.select("conv_id", "turn", "role", F.array(part).cast(f"array<{PART}>").alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role) plus the formatted segment of each turn; nothing is shuffled.

    Segments of a conversation, put together by turn, are its formatted text; spans
    and placeholders count from the start of the segment, so a conversation of any
    length is spread over tasks. Attachments are numbered per turn. NULL roles and
    parts are empty; an unknown type of part raises.
    """

    @F.pandas_udf(SEGMENT)
    def formatted(roles: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = [
            format_turn(role, None if items is None else [x if isinstance(x, dict) else x.asDict() for x in items])
            for role, items in zip(roles, parts)
        ]
        columns = ["segment", "loss_start", "loss_end", "expanded_tokens", "attachments"]
        made = pd.DataFrame(rows, columns=columns)
        for name in ("loss_start", "loss_end"):
            made[name] = made[name].astype("Int64")
        return made

    return turns.withColumn("_made", formatted("role", "parts")).select("conv_id", "turn", "role", "_made.*")


DIGEST = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "expanded_tokens long, n_attachments long"
)


class _Reader:
    """Reads one conversation's segments in order; keeps digests, no text."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = self.attachments = 0

    def add(self, segment: str, start, end, tokens: int, attachments: int) -> None:
        role, text = read_turn(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.chars += len(segment)
        self.tokens += tokens
        self.attachments += attachments
        if not pd.isna(start):
            learned = unescape(segment[int(start) : int(end)])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def result(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens,
                self.attachments)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted segments say: digests of turns and of text under the loss mask.

    Segments are sorted by conversation and turn and stream through; a task holds
    one batch and two digests, however long a conversation is. Turns with equal
    numbers go by role and text; a turn without a number comes last; a NULL
    conv_id is a conversation of its own.
    """
    kind = segments.schema["conv_id"].dataType

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", *(c.split()[0] for c in DIGEST.split(", "))]
        current, reader, done = None, None, []
        for frame in frames:
            for key, segment, start, end, tokens, attachments in zip(
                frame["_id"], frame["segment"], frame["loss_start"], frame["loss_end"], frame["expanded_tokens"],
                frame["_attached"],
            ):
                if reader is None or key != current:
                    if reader is not None:
                        done.append((current, *reader.result()))
                    current, reader = key, _Reader()
                reader.add(segment, start, end, tokens, attachments)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if reader is not None:
            yield pd.DataFrame([(current, *reader.result())], columns=columns)

    ordered = (
        segments.withColumn("_id", F.col("conv_id").cast("string"))
        .withColumn("_attached", F.size("attachments"))
        .select("conv_id", "_id", "turn", "role", "segment", "loss_start", "loss_end", "expanded_tokens", "_attached")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "segment")
    )
    read = ordered.drop("conv_id", "turn", "role").mapInPandas(digest, f"conv_id string, {DIGEST}")
    return read.withColumn("conv_id", F.col("conv_id").cast(kind))
