"""Chat formatting of typed content parts, and reading the format back.

A message is a list of parts: ``struct<type, text, ref, tokens>`` with type text, image,
audio or document.  A visitor flattens the parts in order: text is escaped, any other part
becomes a placeholder with its number, while its reference and the tokens it stands for
are recorded.  Attachments are numbered through a conversation.  One turn is::

    <|turn|>role<|text|>content<|end|>\\n

A backslash is doubled, and a ``<`` before ``|`` or at the end becomes ``\\l``: no escaped string holds ``<|`` or ends in
``<``, so none forms a mark with what follows it, be it another part, and all come back as they were.  The loss mask is the
text of the assistant's parts.

A conversation is a run of sorted rows, formatted and read as a stream, so a
conversation of any length needs the memory of a single turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import SLICE_ROWS

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
KINDS = ("text", "image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
#: Tokens of an attachment that does not state its own number.
TOKENS = {"image": 256, "audio": 128, "document": 512}
_PLACE = re.compile(r"<\|(image|audio|document) (\d+)\|>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings, nor the beginning of one at its end."""
    text = text.replace("\\", "\\\\").replace("<|", "\\l|")
    return f"{text[:-1]}\\l" if text.endswith("<") else text


def unescape(text: str) -> str:
    """What :func:`escape` was given."""
    return _ESCAPED.sub(lambda m: "<" if m[1] == "l" else m[1], text) if "\\" in text else text


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; ``first`` is the number of its first attachment."""

    first: int = 0
    out: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        """One part; a null part is an empty text, an unknown type is refused."""
        kind = (part or {}).get("type") or "text"
        if kind not in KINDS:
            raise ValueError(f"unknown part type {kind!r}")
        getattr(self, f"visit_{kind}")(part or {})

    def _add(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def visit_text(self, part: dict) -> None:
        begin = self.size
        self._add(escape(part.get("text") or ""))
        self.spans.append((begin, self.size))

    def _attach(self, kind: str, part: dict) -> None:
        number = self.first + len(self.attachments)
        tokens = part.get("tokens")
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": TOKENS[kind] if tokens is None else tokens})
        self._add(f"<|{kind} {number}|>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def format_turn(role: str | None, parts: list[dict] | None, trained: str = "assistant", first: int = 0) -> dict:
    """Formatted text of a turn, its loss spans (code points, end exclusive), attachments (numbered from ``first``) and their tokens."""
    visitor = PartVisitor(first)
    for part in parts or []:
        visitor.visit(part)
    head = f"{TURN}{escape(role or '')}{TEXT}"
    loss = [{"start": len(head) + a, "end": len(head) + b} for a, b in visitor.spans] if role == trained else []
    return {"formatted": head + "".join(visitor.out) + END, "loss": loss, "attachments": visitor.attachments, "expanded_tokens": sum(x["tokens"] for x in visitor.attachments)}


def read_turns(formatted: str) -> Iterator[tuple[str, list[dict]]]:
    """Role and parts of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        middle = formatted.index(TEXT, at)
        end = formatted.index(END, middle)
        content, parts, done = formatted[middle + len(TEXT) : end], [], 0
        for m in _PLACE.finditer(content):
            if m.start() > done:
                parts.append({"type": "text", "text": unescape(content[done : m.start()])})
            parts.append({"type": m[1], "number": int(m[2])})
            done = m.end()
        if done < len(content) or not parts:
            parts.append({"type": "text", "text": unescape(content[done:])})
        yield unescape(formatted[at + len(TURN) : middle]), parts
        at = end + len(END)


FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())]))),
    T.StructField("expanded_tokens", T.LongType()),
])


def text_part(text: Column) -> Column:
    """A message's only part, from a text column."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, trained: str = "assistant") -> DataFrame:
    """One row per turn: conv, turn, formatted, loss spans, attachments, expanded_tokens.

    ``parts`` is an array of :data:`PART`; without it the column ``text`` is the only part.  Null
    texts, parts and part lists are empty, a null role is the empty role, a null conversation id
    is an id like any other.  Repeated rows are turns of their own.  Other columns are not kept.

    Every conversation is one run of rows: by turn (null ones first), then role and parts.  Attachments are numbered in
    this order from 0, so no two of a conversation share a placeholder.
    """
    text = text_part(F.coalesce(F.col("text").cast("string"), F.lit(""))) if parts is None else parts
    source = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("parts"))
    source = source.repartition("conv").sortWithinPartitions("conv", "turn", "role", "parts")
    schema = T.StructType([*source.select("conv", "turn").schema.fields, *FORMATTED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])
        now, first = (), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(begin, SLICE_ROWS)
                made = []
                for conv, role, own in zip(*(rows.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if now != (conv,):
                        now, first = (conv,), 0
                    made.append(format_turn(role, own, trained, first))
                    first += len(made[-1]["attachments"])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *pa.array(made, kind).flatten()], schema.fieldNames())

    return source.mapInArrow(run, schema)


def in_order(turns: DataFrame) -> DataFrame:
    """Formatted turns from a table with each conversation as one run of rows, by turn; equal turns by their text."""
    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")


def read_back(turns: DataFrame, conv_col: str = "conv_id", ordered: bool = False) -> DataFrame:
    """One row per conversation, from its formatted text alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens.

    Digests are of role, newline, text, newline of every turn, and of the unescaped text under the
    loss mask; attachments are not part of a turn's text.  A null conversation id is an id like any other, a repeated
    row a turn of its own, an empty table gives no rows, and other columns are not read.  ``ordered``: the turns are what
    :func:`format_chats` returned, neither reread nor rearranged, so its runs are read where they lie.
    """
    source = turns if ordered else in_order(turns)
    source_names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = out.fieldNames()
        state, done = None, []
        places = [source_names.index(x) for x in ("conv", "formatted", "loss", "attachments", "expanded_tokens")]

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6], state[7]))

        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(begin, SLICE_ROWS)
                for conv, formatted, loss, attachments, tokens in zip(*(rows.column(at).to_pylist() for at in places), strict=True):
                    if state is None or state[0] != conv:
                        close()
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                    for role, parts in read_turns(formatted):
                        text = "".join(p.get("text", "") for p in parts)
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                    for span in loss:
                        text = unescape(formatted[span["start"] : span["end"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                    state[5] += len(formatted)
                    state[6] += len(attachments)
                    state[7] += tokens
            if done:
                yield _rows(done, names, batch.schema.field(places[0]).type)
                done = []
        close()
        if done:
            yield _rows(done, names, batch.schema.field(places[0]).type)

    out = T.StructType([T.StructField("conv", source.schema["conv"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("formatted_chars", "n_attachments", "expanded_tokens"))])
    return source.mapInArrow(run, out).withColumnRenamed("conv", conv_col)


def _rows(rows: list[tuple], names: list[str], first: pa.DataType) -> pa.RecordBatch:
    kinds = [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
