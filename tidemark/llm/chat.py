"""Chat formatting with typed content parts, and its exact reader.

Method.  A turn has a role and content parts: text, image, audio or document.  A visitor walks the
parts in order: text is escaped and written, every other part becomes one placeholder in its place,
with an attachment record (kind, reference, place in the text, expanded tokens).  A turn is

    <s>[INST]role[/INST]content</s>

Control strings inside a role or text get a backslash behind their first character, and backslashes
are doubled, so the template's own strings never occur in content and reading back is exact.  The
loss mask covers the content of assistant turns, as code point offsets in the formatted turn.

Turns are formatted one by one without a shuffle.  A conversation is its turns in order; what needs
them together (digests) reads them as a stream sorted by conversation and turn, so a conversation of
any length takes constant memory.  Its digest is sequential by nature, so one task reads it.

Edge cases: null text is empty, null role is an empty role, turns of equal number are ordered by
their content, a null turn comes first, null conv_id is a conversation of its own, a null list of
parts is empty, parts of an unknown kind are kept as text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template.
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", *PLACEHOLDERS.values())
LOSS_ROLE = "assistant"

PART_TYPE = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
TURN_TYPE = "formatted string, loss_from long, loss_to long, attachments array<struct<kind:string,ref:string,place:long,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""

    patch: int = 14
    audio_per_second: float = 25.0
    per_page: int = 256

    def image(self, width: int | None, height: int | None) -> int:
        return max(1, math.ceil((width or 0) / self.patch) * math.ceil((height or 0) / self.patch))

    def audio(self, seconds: float | None) -> int:
        return max(1, math.ceil((seconds or 0) * self.audio_per_second))

    def document(self, pages: int | None) -> int:
        return max(1, (pages or 0) * self.per_page)


@dataclass
class PartVisitor:
    """Flattens the parts of one turn into a text with placeholders and its attachments."""

    expansion: Expansion = Expansion()
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    length: int = 0
    #: Text not written yet: texts that follow each other are escaped as one, as control strings may form between them.
    text: str = ""

    def visit(self, part: dict) -> None:
        {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part.get("kind"), self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.text += part.get("text") or ""

    def finish(self) -> str:
        """Everything visited, as one text."""
        self._flush()
        return "".join(self.pieces)

    def _flush(self) -> None:
        self._write(escape(self.text))
        self.text = ""

    def visit_image(self, part: dict) -> None:
        self._attach(part, self.expansion.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, self.expansion.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self._attach(part, self.expansion.document(part.get("pages")))

    def _attach(self, part: dict, tokens: int) -> None:
        self._flush()
        self.attachments.append((part["kind"], part.get("ref"), self.length, tokens))
        self._write(PLACEHOLDERS[part["kind"]])

    def _write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def format_turn(role: str | None, parts: Iterable[dict] | None, expansion: Expansion = Expansion()) -> tuple:
    """(formatted, loss_from, loss_to, attachments, expanded_tokens) of one turn."""
    head = f"{OPEN}{escape(role or '')}{ROLE_END}"
    visitor = PartVisitor(expansion, length=len(head))
    for part in parts if parts is not None else ():
        if part is not None:
            visitor.visit(part)
    content = visitor.finish()
    masked = role == LOSS_ROLE
    start, end = (len(head), len(head) + len(content)) if masked else (0, 0)
    attached = [{"kind": k, "ref": r, "place": p, "tokens": t} for k, r, p, t in visitor.attachments]
    return f"{head}{content}{CLOSE}", start, end, attached, sum(t for *_, t in visitor.attachments)


TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(ROLE_END) + r"(.*?)" + re.escape(CLOSE), re.DOTALL)
HOLDER = re.compile("(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")")


def read_turns(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn in a formatted text; a part is (kind, text), attachments without text."""
    kinds = {holder: kind for kind, holder in PLACEHOLDERS.items()}
    for found in TURN.finditer(formatted):
        pieces = [(kinds[p], "") if p in kinds else ("text", unescape(p)) for p in HOLDER.split(found[2]) if p]
        yield unescape(found[1]), pieces


def format_column(role: Column, parts: Column, expansion: Expansion = Expansion()) -> Column:
    """Struct of TURN_TYPE from a role and an array of parts."""

    @F.pandas_udf(TURN_TYPE)
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = [format_turn(r if isinstance(r, str) else None, p, expansion) for r, p in zip(rows["role"], rows["parts"], strict=True)]
        return pd.DataFrame(made, columns=["formatted", "loss_from", "loss_to", "attachments", "expanded_tokens"])

    return build(F.struct(role.alias("role"), parts.alias("parts")))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    empty = {"ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()]))


def format_turns(df: DataFrame, parts: Column | None = None, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", expansion: Expansion = Expansion()) -> DataFrame:
    """One row per turn: conv_id, turn and TURN_TYPE; ``parts`` defaults to the text as one part."""
    parts = text_part(F.col(f"`{text_column}`")) if parts is None else parts
    made = format_column(F.col(f"`{role_column}`"), parts, expansion)
    return df.select(F.col(f"`{conv_column}`").alias("conv_id"), F.col(f"`{turn_column}`").alias("turn"), made.alias("_t")).select("conv_id", "turn", "_t.*")


class _Digest:
    """What is known of the conversation being read."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_from: int, loss_to: int) -> None:
        self.chars += len(formatted)
        for role, parts in read_turns(formatted):
            self.turns += 1
            self.text.update(f"{role}\n{''.join(text for _, text in parts)}\n".encode("utf-8", "replace"))
        if loss_to > loss_from:
            masked = unescape(HOLDER.sub("", formatted[loss_from:loss_to]))
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST_TYPE = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns in order."""
    ordered = turns.select("conv_id", "turn", "formatted", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", F.col("conv_id").isNull().alias("_none"), "formatted", "loss_from", "loss_to").mapInPandas(_fold, DIGEST_TYPE)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in DIGEST_TYPE.split(", ")]
    current = None
    for frame in frames:
        done = []
        for conv_id, none, formatted, start, end in zip(*(frame[c] for c in ("conv_id", "_none", "formatted", "loss_from", "loss_to")), strict=True):
            conv_id = None if none else int(conv_id)
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(formatted, start, end)
        yield _rows(done, names)
    if current is not None:
        yield _rows([current.row()], names)


def _rows(done: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(done, columns=names)
    return frame.astype({"conv_id": "Int64"})
