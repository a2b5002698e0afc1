"""Chat formatting with typed content parts.

A visitor turns each part of a turn into text: text is escaped, and an image, audio or document becomes a placeholder whose attachment
and number of tokens are recorded in order. Turns are `<|turn|>role<|text|>content<|end|>` and a newline.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that steer this template or other common ones; fixed values.
STEERS = r"(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
JOINER = "\u2060"
OPEN = re.compile(rf"([<\[])({JOINER}*){STEERS}")
OPENED = re.compile(rf"([<\[]){JOINER}({JOINER}*){STEERS}")


def escape(text: str) -> str:
    """Puts a word joiner behind the first character of each control string, one more where there are some already."""
    return OPEN.sub(rf"\1{JOINER}\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return OPENED.sub(r"\1\2", text) if JOINER in text else text


@dataclass
class Flattener:
    """Visitor of content parts. attachments: (kind, reference, tokens, place in the text), in order."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)
    out: list[str] = field(default_factory=list)
    size: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"on_{part.get('type', 'text')}", self.on_unknown)(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, str(part.get("ref") or ""), tokens, self.size))
        self.put(f"<|{kind}|>")

    def on_text(self, part: dict) -> None:
        self.put(escape(str(part.get("text") or "")))

    def on_image(self, part: dict) -> None:
        w, h = (max(1, int(part.get(k) or 224)) for k in ("width", "height"))
        self.attach("image", part, math.ceil(w / self.patch) * math.ceil(h / self.patch))

    def on_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(max(0.0, float(part.get("seconds") or 0)) * self.audio_rate))

    def on_document(self, part: dict) -> None:
        self.attach("document", part, max(1, int(part.get("pages") or 1)) * self.page_tokens)

    def on_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[tuple[str, str, int, int]]]:
    """The turn's text, the span of its content and its attachments, with places in the turn's text."""
    head = TURN + escape(role) + TEXT
    v = Flattener(size=len(head))
    for p in parts:
        v.visit(p)
    return head + "".join(v.out) + END, len(head), v.size, v.attachments


#: One row for each turn: `piece`s of a conversation follow each other in order; offsets count code points from the conversation's start.
FORMATTED = "conv_id long, seq long, piece string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,tokens:long,at:long>>"


def format_conversations(rows: DataFrame, parts: str | None = None) -> DataFrame:
    """FORMATTED, in order of conv_id and seq within partitions.

    Turns go by turn, then role and text (null first), so repeated turns are all kept in a fixed order. Null role or text is empty, a null
    conv_id is a conversation of its own. parts: a column with a JSON list of typed parts, used where it isn't null. A conversation is read
    turn by turn, never held as a whole; loss covers the content of assistants.
    """
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), (F.col(parts).cast("string") if parts else F.lit(None).cast("string")).alias("parts"))
    sorted_ = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")

    def run(batches):
        conv, seq, at = object(), 0, 0
        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())])))])
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for c, role, text, own_parts in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if c != conv:
                    conv, seq, at = c, 0, 0
                listed = json.loads(own_parts) if own_parts is not None else [{"type": "text", "text": text}]
                piece, a, z, attached = format_turn(role or "", listed)
                loss = (at + a, at + z) if role == "assistant" else (None, None)
                for to, x in zip(out, (c, seq, piece, *loss, [{"kind": k, "ref": r, "tokens": n, "at": at + p} for k, r, n, p in attached]), strict=True):
                    to.append(x)
                seq, at = seq + 1, at + len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return sorted_.mapInArrow(run, FORMATTED)


class Reader:
    """Reads a formatted conversation back, piece by piece, with the digests that the report returns."""

    def __init__(self):
        self.turns = hashlib.sha256()
        self.loss = hashlib.sha256()
        self.n_turns = self.chars = self.loss_chars = 0
        self.rest = ""

    def feed(self, piece: str, start: int | None, end: int | None) -> None:
        if start is not None:
            under = unescape(piece[start - self.chars : end - self.chars])
            self.loss.update(under.encode())
            self.loss_chars += len(under)
        self.chars += len(piece)
        data = self.rest + piece
        while (stop := data.find(END)) >= 0:
            if not data.startswith(TURN):
                raise ValueError("a turn has no beginning")
            role, mark, text = data[len(TURN) : stop].partition(TEXT)
            if not mark:
                raise ValueError("a turn has no text")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.n_turns += 1
            data = data[stop + len(END) :]
        self.rest = data


def chat_report(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted conversations."""

    def run(batches):
        conv, reader = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done():
            if reader.rest:
                raise ValueError("a turn has no end")
            return (conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)

        def batch(made):
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=names)

        for b in batches:
            made = []
            for c, piece, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if reader is None or c != conv:
                    if reader is not None:
                        made.append(done())
                    conv, reader = c, Reader()
                reader.feed(piece, start, end)
            yield batch(made)
        if reader is not None:
            yield batch([done()])

    return format_conversations(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
