"""Chat formatting over typed content parts.

Each turn's content is a list of typed parts. A visitor flattens them in order: text is escaped and
written out; an image, audio or document part becomes a placeholder with its running number, and its
reference and expanded token count are recorded. A turn becomes one segment of its conversation's
formatted text, and the assistant's content in it is under the loss mask.

    [INST]role\\ncontent[/INST]      any role but assistant
    [ANS]content</s>                assistant

`\\`, `[` and `<` in roles and texts, and line ends in roles, are escaped by a backslash, so no
control string can come from a text and the segments can be parsed back exactly.

Segments are stored in order of (conv_id, turn); reading back streams them per conversation and
digests piece by piece, so a conversation of any length needs no more memory than its longest turn.

Defined cases: a null text is empty, a null role is '', a null turn sorts first; turns with the same
number are ordered by role, then text; a null conv_id is a conversation of its own; conv_ids are exact
over the whole range of a long; a turn of any length is formatted and parsed in memory in proportion to
it; conv_id and turn have to be of whole-number types, others are refused; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_number_ids, width

ASSISTANT = "assistant"
#: Expanded token counts: an image by tiles of 512 with a base, audio by seconds, a document by pages.
IMAGE_BASE, IMAGE_TILE, AUDIO_SECOND, DOCUMENT_PAGE = 85, 170, 25, 560

_ESCAPED = re.compile(r"[\\\[<]")
#: What a content may hold: plain text, escaped characters, placeholders; each by the run, so that parsing is linear.
_CONTENT = re.compile(r"([^\\\[<]++)|((?:\\.){1,1000}+)|\[(?:IMG|AUD|DOC):\d+:\d+\]", re.S)
_ROLE = re.compile(r"(?:[^\\\n\[<]++|\\.)*+", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(content: str) -> str:
    """The text of a content: escapes undone, placeholders left out; anything else is an error."""
    out, at = io.StringIO(newline=""), 0
    for m in _CONTENT.finditer(content):
        if m.start() != at:
            break
        out.write(m[1] or (m[2] or "")[1::2])  # an escaped run is pairs of a backslash and its character
        at = m.end()
    if at != len(content):
        raise ValueError("a control character stands alone")
    return out.getvalue()


@dataclass
class Flattened:
    """What the visitor makes of one turn's parts."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)


class PartVisitor:
    """Flattens typed parts in order; a part is a mapping with 'kind' and the fields of its kind."""

    def __init__(self) -> None:
        self.out = Flattened()

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 512) / 512) * math.ceil((part.get("height") or 512) / 512)
        self._attach("IMG", part, IMAGE_BASE + IMAGE_TILE * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("AUD", part, math.ceil((part.get("seconds") or 0) * AUDIO_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("DOC", part, (part.get("pages") or 1) * DOCUMENT_PAGE)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part kind {part['kind']!r}")

    def _attach(self, mark: str, part: dict, tokens: int) -> None:
        number = len(self.out.attachments)
        self.out.pieces.append(f"[{mark}:{number}:{tokens}]")
        self.out.attachments.append({"number": number, "kind": part["kind"], "uri": part.get("uri"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The segment, the loss mask in it (start and end, equal if none) and the attachments."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    content = "".join(visitor.out.pieces)
    if role == ASSISTANT:
        return f"[ANS]{content}</s>", 5, 5 + len(content), visitor.out.attachments
    name = escape(role or "").replace("\n", "\\\n")
    return f"[INST]{name}\n{content}[/INST]", 0, 0, visitor.out.attachments


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment; attachments leave no text."""
    if segment.startswith("[ANS]") and segment.endswith("</s>"):
        return ASSISTANT, unescape(segment[5:-4])
    if segment.startswith("[INST]") and segment.endswith("[/INST]"):
        role = _ROLE.match(segment, 6, len(segment) - 7)
        if segment[role.end()] == "\n":
            return unescape(role[0]), unescape(segment[role.end() + 1 : -7])
    raise ValueError("not a segment")


_SEGMENTS = (
    "conv_id long, turn long, role string, segment string, mask_start int, mask_end int,"
    " attachments array<struct<number:int,kind:string,uri:string,tokens:int>>"
)
_ATTACHMENT = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())])
_SEGMENT_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
    ("mask_start", pa.int32()), ("mask_end", pa.int32()), ("attachments", pa.list_(_ATTACHMENT)),
])


def format_turns(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """A segment per row of turns (conv_id, turn, role, text); parts: a column of typed parts to take instead of text."""
    content = parts or "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, turn, role, _ = b.columns
            rows = []
            for r, x in zip(role, b.column(3)):
                x = x.as_py()
                rows.append(format_turn(r.as_py(), (x or []) if parts else [{"kind": "text", "text": x}]))
            made = list(zip(*rows)) or [[]] * 4
            kinds = _SEGMENT_SCHEMA.types[3:]
            yield pa.RecordBatch.from_arrays([conv, turn, role, *[pa.array(x, k) for x, k in zip(made, kinds)]], schema=_SEGMENT_SCHEMA)

    whole_number_ids(turns, "conv_id", "turn")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), content]
    return turns.select(*columns).mapInArrow(run, _SEGMENTS)


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


class _Digest:
    """What is reported of one conversation, fed segment by segment."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.formatted_chars = conv, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, lo: int, hi: int) -> None:
        role, text = parse_segment(segment)
        self.turns += 1
        for x in (role, "\n", text, "\n"):
            self.said.update(x.encode())
        if hi > lo:
            under = unescape(segment[lo:hi])
            self.loss_chars += len(under)
            self.loss.update(under.encode())
        self.formatted_chars += len(segment)

    def row(self) -> dict:
        values = (self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)
        return dict(zip(_DIGESTS.names, values))


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, streamed from segments in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for b in batches:
            rows = []
            convs, lows, highs = (b.column(k).to_pylist() for k in (0, 2, 3))
            for conv, segment, lo, hi in zip(convs, b.column(1), lows, highs):
                if current is None or conv != current.conv:
                    if current is not None:
                        rows.append(current.row())
                    current = _Digest(conv)
                current.add(segment.as_py(), lo, hi)
            yield pa.RecordBatch.from_pylist(rows, _DIGESTS)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row()], _DIGESTS)

    # turns with one number and role go by their text: the segment without its end mark, escapes undone
    bare = F.expr(f"left(segment, length(segment) - if(role = '{ASSISTANT}', 4, 7))")
    text = F.regexp_replace(bare, r"(?s)\\(.)", "$1")
    ordered = segments.repartition(width(segments.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "turn", F.coalesce("role", F.lit("")), text
    )
    return ordered.select("conv_id", "segment", "mask_start", "mask_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chat_digests(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """Format all turns, write them out, and report on each conversation from the output."""
    return read_back(materialise(format_turns(turns, parts), "chat-segments"))
