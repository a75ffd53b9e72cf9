"""Chat formatting with typed content parts.

Each turn is one content: a plain text or an ordered list of typed parts (text,
image, audio, document).  :class:`Flatten` visits the parts in order and gives
one string with placeholders, the attachments it met, and the number of tokens
that each placeholder will be expanded to.  A turn becomes one *segment*

    <|im_start|>role LF text <|im_end|> LF

and the formatted conversation is the concatenation of its segments in turn
order.  Segments stay rows: no task ever holds a whole conversation, however
long it is.

Escaping.  A control string starts with ``<|``.  Inside texts and roles every
``<``, backslashes*, ``|`` gets one more backslash; taking one away restores the
text exactly.  In roles, backslash and line feed are written ``\\\\`` and
``\\n`` first, so that the first line feed of a segment always ends the role.

Defined cases: null role or text is empty; null turns come first; equal turns
are ordered by role, then text; repeated rows are repeated turns; rows without a
conversation id are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class TextPart:
    text: str

    def accept(self, visitor):
        return visitor.text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str
    width: int
    height: int

    def accept(self, visitor):
        return visitor.image(self)


@dataclass(frozen=True)
class AudioPart:
    ref: str
    seconds: float

    def accept(self, visitor):
        return visitor.audio(self)


@dataclass(frozen=True)
class DocumentPart:
    ref: str
    pages: int

    def accept(self, visitor):
        return visitor.document(self)


def part(row: dict):
    """A typed part from a row of ``PARTS_TYPE``; unknown types are an error."""
    kind, ref = row.get("type"), row.get("ref") or ""
    if kind == "text":
        return TextPart(row.get("text") or "")
    if kind == "image":
        return ImagePart(ref, row.get("width") or 0, row.get("height") or 0)
    if kind == "audio":
        return AudioPart(ref, row.get("seconds") or 0.0)
    if kind == "document":
        return DocumentPart(ref, row.get("pages") or 0)
    raise ValueError(f"unknown content part type: {kind!r}")


@dataclass
class Flatten:
    """Visitor: text with placeholders, attachment references, expanded tokens.

    An image takes one token for each ``patch`` x ``patch`` square begun, audio
    ``audio_rate`` tokens a second, a document ``page_tokens`` a page; each
    takes one token at least.
    """

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 512
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": ref, "tokens": max(1, tokens)})
        self.out.append(f"<|{kind}|>")

    def text(self, p: TextPart) -> None:
        self.out.append(escape(p.text))

    def image(self, p: ImagePart) -> None:
        self._attach("image", p.ref, math.ceil(p.width / self.patch) * math.ceil(p.height / self.patch))

    def audio(self, p: AudioPart) -> None:
        self._attach("audio", p.ref, math.ceil(p.seconds * self.audio_rate))

    def document(self, p: DocumentPart) -> None:
        self._attach("document", p.ref, p.pages * self.page_tokens)


def segment(role: str, parts: list) -> tuple[str, int, int, list[dict]]:
    """Segment, start and end of its text in it, attachments."""
    visitor = Flatten()
    for p in parts:
        p.accept(visitor)
    head, body = f"{START}{escape_role(role)}\n", "".join(visitor.out)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body), visitor.attachments


_SEGMENTS = pa.schema(
    [
        ("conv", pa.int64()),
        ("turn", pa.int64()),
        ("segment", pa.string()),
        ("loss_from", pa.int32()),
        ("loss_to", pa.int32()),
        ("attachments", pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
    ]
)
SEGMENTS_DDL = "conv bigint, turn bigint, segment string, loss_from int, loss_to int, attachments array<struct<ordinal:int,kind:string,ref:string,tokens:bigint>>"


def _format(trained_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            segs, lo, hi, att = [], [], [], []
            for role, text, parts in zip(*cols[2:5]):
                items = [part(p) for p in parts] if parts is not None else [TextPart(text)]
                s, x, y, a = segment(role, items)
                if role != trained_role:
                    x = y = 0
                segs.append(s)
                lo.append(x)
                hi.append(y)
                att.append(a)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(v, f.type) for v, f in zip((segs, lo, hi, att), list(_SEGMENTS)[2:]))], schema=_SEGMENTS)

    return run


def format_conversations(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", parts_col: str | None = None, trained_role="assistant") -> DataFrame:
    """One row per turn (``SEGMENTS_DDL``), a conversation's rows together and in order.

    ``loss_from``..``loss_to`` is the loss mask in code points of the segment:
    the text of a turn of ``trained_role``, otherwise empty.  The sort spills,
    and what follows it streams, so one conversation may be of any length.
    """
    parts = F.col(f"`{parts_col}`").cast(PARTS_TYPE) if parts_col else F.lit(None).cast(PARTS_TYPE)
    rows = df.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"),
        F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        parts.alias("parts"),
    ).where("conv IS NOT NULL")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_format(trained_role), SEGMENTS_DDL)


def read_segment(text: str) -> tuple[str, str]:
    """Role and text of a segment; a malformed one is an error."""
    if not text.startswith(START) or not text.endswith(f"{END}\n"):
        raise ValueError("not a segment")
    role, _, body = text[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])
DIGEST_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None

    def done():
        n, turns, chars, loss, total, n_att, att = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, n_att, att

    for b in batches:
        rows = []
        for c, seg, lo, hi, att in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
            if c != conv:
                if state is not None:
                    rows.append(done())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, text = read_segment(seg)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            masked = unescape(seg[lo:hi])
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += len(seg)
            state[5] += len(att)
            state[6] += sum(a["tokens"] for a in att)
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * 8, _DIGEST)], schema=_DIGEST)
    if state is not None:
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(done(), _DIGEST)], schema=_DIGEST)


def digest(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row per conversation.

    ``segments`` is the result of :func:`format_conversations`, whose order it
    relies on; it keeps two running hashes and counts, nothing else.
    """
    return segments.mapInArrow(_read, DIGEST_DDL)
