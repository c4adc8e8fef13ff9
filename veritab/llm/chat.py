"""Chat formatting of conversations with typed content parts.

Method: a visitor flattens the parts of a turn (text, image, audio, document) into one string with
ordered placeholders, records a reference for each attachment and how many tokens it expands to.
Marks of the template are the only control strings: ``### Role:`` begins a turn, ``</turn>`` ends
it, ``<image:1>`` and the like stand for attachments. Inside texts they are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("image", "audio", "document")
#: Tokens per unit of an attachment: a tile of an image, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"
TRAINED = "assistant"

_ESCAPE = re.compile(r"\\|(?<=#)#|(?<=<)(?=/turn>|(?:image|audio|document):)")
_UNESCAPE = re.compile(r"\\(.?)", re.S)
_TURN = re.compile(r"### ((?:(?!:\n).)*):\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    """No two adjacent '#', no ``</turn>`` and no placeholder is left; ``unescape`` takes it back."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role stands within one line of the template, before a colon."""
    return escape(role).replace(":", "\\:").replace("\n", "\\\n")


@dataclass
class Visitor:
    """Flattens one conversation; attachments are numbered in the order they come."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    mask: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int, int]] = field(default_factory=list)
    turns: int = 0

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def turn(self, role: str | None, parts: list[dict]) -> None:
        role = role or ""
        self.write(f"### {escape_role(role)}:\n")
        start = self.length
        for part in parts:
            kind = part["type"] or "text"
            getattr(self, f"visit_{kind if kind in KINDS else 'text'}")(part)
        if role == TRAINED:
            self.mask.append((start, self.length))
        self.write("\n</turn>\n")
        self.turns += 1

    def visit_text(self, part: dict) -> None:
        self.write(escape(part["text"] or ""))

    def _attach(self, part: dict) -> None:
        kind = part["type"]
        tokens = TOKENS_PER_UNIT[kind] * max(1, part["units"] or 1)
        self.attachments.append((kind, part["ref"], self.turns, self.length, tokens))
        self.write(f"<{kind}:{len(self.attachments)}>")

    visit_image = visit_audio = visit_document = _attach


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


FORMATTED = (
    "formatted string, n_turns long, loss_mask array<struct<start:long,end:long>>, "
    "attachments array<struct<type:string,ref:string,turn:long,at:long,tokens:long>>"
)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: its id, the formatted text, loss mask and attachments.

    Rows go by turn; rows with equal turns by role and content, a null turn first. Null roles,
    texts and part lists count as empty; rows without an id form one conversation. Repeated rows
    are repeated turns. A task reads sorted rows as a stream and holds one conversation at a time.
    """
    id_type = rows.schema[conv_col].dataType.simpleString()
    ordered = (
        rows.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).cast(PARTS).alias("parts"))
        .repartition("id")
        .sortWithinPartitions("id", "turn", "role", F.to_json("parts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, visitor = none, Visitor()
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            ids, visitors = zip(*done)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_arrow),
                    pa.array(["".join(v.out) for v in visitors]),
                    pa.array([v.turns for v in visitors], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in v.mask] for v in visitors], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(
                        [[dict(zip(("type", "ref", "turn", "at", "tokens"), x)) for x in v.attachments] for v in visitors],
                        pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("at", pa.int64()), ("tokens", pa.int64())])),
                    ),
                ],
                ["id", "formatted", "n_turns", "loss_mask", "attachments"],
            )

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for row in batch.to_pylist():
                if current is none or row["id"] != current:
                    if current is not none:
                        done.append((current, visitor))
                    current, visitor = row["id"], Visitor()
                visitor.turn(row["role"], row["parts"] or [])
            if done:
                yield batch_of()
                done = []
        if current is not none:
            done.append((current, visitor))
            yield batch_of()

    return ordered.mapInArrow(run, f"id {id_type}, {FORMATTED}").withColumnRenamed("id", conv_col)


def formatting_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from the formatted texts alone: turns, and the text under the mask."""
    id_type = formatted.schema[conv_col].dataType.simpleString()

    def digest(parts: Iterator[str]) -> str:
        out = hashlib.sha256()
        for part in parts:
            out.update(part.encode("utf-8", "surrogatepass"))
        return out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns = read_back(row["formatted"])
                loss = [unescape(row["formatted"][m["start"] : m["end"]]) for m in row["loss_mask"]]
                rows.append((
                    row["id"], len(turns), digest(f"{r}\n{t}\n" for r, t in turns),
                    sum(map(len, loss)), digest(iter(loss)), len(row["formatted"]),
                ))
            types = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    schema = f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col(conv_col).alias("id"), "formatted", "loss_mask").mapInArrow(run, schema).withColumnRenamed("id", conv_col)
