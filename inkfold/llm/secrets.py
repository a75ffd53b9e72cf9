"""Secret scans with a recursive decoding worklist.

Three patterns are searched in the whole text.  Then layers are unwrapped until
nothing new appears: URL escapes, ``\\u`` and ``\\x`` escapes, base64 runs (also
over line breaks), and compressed data (gzip, zlib, bz2, xz; all members) in any
of them.  Each new layer is searched again and every find is mapped to the span
of the original text that it came from.  A layer that was seen before at the same
place is not entered again, so cycles end; escapes and base64 shrink their input,
so the worklist is finite.

Bytes are read as UTF-8 or else byte by byte, and as UTF-16 and UTF-32 if a
zero byte stands beside an ASCII character; no layer is passed over for what it looks like.  Compressed
layers are read to their end, in windows of about ``WINDOW`` bytes that end where
no secret, base64 run or escape can continue.

Defined cases: null text is empty; an empty text has no spans; spans are code
points, end exclusive, ordered by start, kind, end; repeated rows repeat.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkfold.llm.common import keyed, mapped, trim

#: The kinds in the order in which they are listed, with their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+")
#: 16 base64 digits hold 12 bytes, the shortest assignment that is reported.
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
_BREAK = r"[ \t]*(?:\r?\n|\r|\\r\\n|\\n)[ \t]*"
#: Runs over line breaks: every line after the first is base64 up to its end or a closing mark.
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\n))[A-Za-z0-9+/_-]{4,}+(?:" + _BREAK + r"[A-Za-z0-9+/_-]++(?==*[ \t]*(?:[\r\n\\\"'`<)\]};,]|\Z)))+={0,2}")
_BREAKS = re.compile(_BREAK)
_MAYBE = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]{4}[ \t]*(?:\r|\n|\\r|\\n)[ \t]*[A-Za-z0-9+/_-]|\x1f\x{8b}|BZh[1-9]"
_URLSAFE = str.maketrans("-_", "+/")
#: Compressed data in a text: as characters, URL escapes, or backslash escapes.
_x = lambda *codes: "".join(rf"(?:%{c}|\\x{c}|\\u00{c}|{re.escape(chr(int(c, 16)))})" for c in codes)
_MAGIC = re.compile("(?i:" + _x("1f", "8b") + "|" + _x("78") + "(?:" + "|".join(_x(c) for c in ("01", "5e", "9c", "da")) + ")|" + _x("fd", "37", "7a", "58", "5a", "00") + "|" + _x("42", "5a", "68") + ")")
#: What follows is one byte of such data, or more where nothing is escaped; group 1 is the code of an escape.
_BYTES = {
    "%": re.compile(r"%([0-9A-Fa-f]{2})|[!-$&-~]"),
    "\\": re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\[abfnrtv0\\/\"']|[^\\\u0100-\U0010ffff]"),
    "": re.compile(r"[\0-\xff]"),
}
_SHORT = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0}
#: Compressed layers are searched in windows of about so many bytes.
WINDOW = 8 << 20
_STEP = 1 << 20
#: A byte at which nothing that is searched for can continue.
_CUT = re.compile(rb"[^\0\t\n\r A-Za-z0-9+/_.=:\"'%\\-]|\0{8}")
#: Characters of UTF-16 and UTF-32 that all secrets, escapes and base64 runs have.
_WIDE = re.compile(rb"[!-~]\0|\0[!-~]")
_WIDER = re.compile(rb"[!-~]\0\0\0|\0\0\0[!-~]")
_ERRORS = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three patterns in one layer."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _opener(head: bytes):
    """What inflates data that begins so, None if it is not compressed."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


def _sound(head: bytes) -> bool:
    """Whether these bytes begin compressed data, and do not only look like it: the text "x " does."""
    d = _opener(head)
    if d is None:
        return False
    try:
        return bool(d.decompress(head, 64)) or d.eof or len(head) >= _STEP
    except _ERRORS:
        return False


def _pull(d, data: bytes) -> Iterator[bytes]:
    """All that ``d`` gives for ``data``, in steps."""
    while True:
        out = d.decompress(data, _STEP)
        data = getattr(d, "unconsumed_tail", b"")
        if out:
            yield out
        if d.eof or (d.needs_input if hasattr(d, "needs_input") else not data and len(out) < _STEP):
            return


def _inflate(chunks: Iterator[bytes], tail: bool = True, used: list[int] | None = None) -> Iterator[bytes]:
    """The content of all members, as far as they are sound, and of ``tail`` what follows them.

    ``used[0]`` is set to the length of the members.
    """
    buf, fed = b"", 0

    def more(n: int) -> None:
        nonlocal buf, fed
        while len(buf) < n and (c := next(chunks, b"")):
            buf, fed = buf + c, fed + len(c)

    more(6)
    d = _opener(buf)
    while d is not None:
        try:
            while not d.eof:
                yield from _pull(d, buf)
                buf = d.unused_data if d.eof else b""
                if not d.eof:
                    more(1)
                    if not buf:
                        break
        except _ERRORS:
            buf = b""
        if used is not None:
            used[0] = fed - len(buf)
        if not d.eof:
            return
        more(6)
        while buf[:1] == b"\0" and not buf.strip(b"\0") and len(buf) < _STEP:
            before = len(buf)
            more(before + 1)
            if len(buf) == before:
                break
        more(len(buf) - len(buf.lstrip(b"\0")) + 6)
        d = _opener(buf.lstrip(b"\0"))
        buf = buf.lstrip(b"\0") if d is not None else buf
    if tail:
        if buf:
            yield buf
        yield from chunks


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes, cut only where nothing that is searched for can continue."""
    parts, size = [], 0
    for c in chunks:
        parts.append(c)
        size += len(c)
        if size < WINDOW:
            continue
        cut = 0
        for at in (max(len(c) - 4096, 0), 0):
            for m in _CUT.finditer(c, at):
                cut = m.end()
            if cut:
                break
        if cut:
            yield b"".join(parts)[: size - len(c) + cut]
            parts = [c[cut:]]
            size = len(parts[0])
    if size:
        yield b"".join(parts)


def _readings(data: bytes) -> Iterator[str]:
    """The texts that the bytes can be."""
    try:
        yield data.decode("utf-8")
    except UnicodeDecodeError:
        yield data.decode("latin-1")
    if _WIDE.search(data):
        for part in (data, data[1:]):
            yield part.decode("utf-16-le", "replace")
            yield part.decode("utf-16-be", "replace")
    if _WIDER.search(data):
        yield data.decode("utf-32-le", "replace")
        yield data.decode("utf-32-be", "replace")


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    """The texts in these bytes, through any compressed layers."""
    heads: set[bytes] = set()
    while True:
        head = b""
        while len(head) < _STEP and (c := next(chunks, b"")):
            head += c
        key = hashlib.sha1(head).digest()
        chunks = itertools.chain([head] if head else [], chunks)
        if key in heads or not _sound(head):
            break
        heads.add(key)
        chunks = _inflate(chunks)
    for window in _windows(chunks):
        if window.strip(b"\0"):
            yield from _readings(window)


def _bytes_of(run: str) -> bytes:
    """The bytes of base64 digits, without a last digit that is none of a byte."""
    run = run.translate(_URLSAFE)
    run = run[: len(run) - 1] if len(run) % 4 == 1 else run
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def _placed(data: bytes) -> Iterator[tuple[str, array]]:
    """The texts that the bytes can be, and where the bytes of each character end."""
    for text in _readings(data):
        if len(text) == len(data):
            yield text, array("q", range(1, len(data) + 1))
    try:
        if len(text := data.decode("utf-8")) < len(data):
            yield text, array("q", itertools.accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text))
    except UnicodeDecodeError:
        pass
    for wide, name, width in ((_WIDE, "utf-16", 2), (_WIDER, "utf-32", 4)):
        if wide.search(data):
            for skip in range(2 if width == 2 else 1):
                for order in ("-le", "-be"):
                    part = data[skip : skip + (len(data) - skip) // width * width]
                    ends, out, at = array("q"), [], skip
                    # Units one by one: what is no character stands as one.
                    for k in range(0, len(part), width):
                        out.append(part[k : k + width].decode(name + order, "replace")[:1] or "\ufffd")
                        ends.append(at := at + width)
                    yield "".join(out), ends


def _escaped_bytes(text: str, start: int, mode: str, ends: array, plus: bool) -> Iterator[bytes]:
    """The bytes that the text holds from ``start`` on; ``ends`` gets where each ends."""
    out, pattern, pos = bytearray(), _BYTES[mode], start
    while m := pattern.match(text, pos):
        c = m[0]
        out.append(int(m[1], 16) if len(c) > 2 else _SHORT.get(c[1], ord(c[1])) if len(c) == 2 else 32 if plus and c == "+" else ord(c))
        pos = m.end()
        ends.append(pos)
        if len(out) == 1024:
            yield bytes(out)
            out.clear()
    if out:
        yield bytes(out)


def compressed(text: str) -> Iterator[tuple[int, int, Iterator[str]]]:
    """(start, end, texts) of the compressed data that stand in a text, escaped or not."""
    done = 0
    for m in _MAGIC.finditer(text):
        if m.start() < done:
            continue
        for mode, plus in (("%", False), ("%", True), ("\\", False), ("", False)):
            ends, used, some = array("q"), [0], False
            for _ in _inflate(_escaped_bytes(text, m.start(), mode, ends, plus), False, used):
                some = True
            if some:
                end = ends[used[0] - 1]
                yield m.start(), end, _texts(_escaped_bytes(text[:end], m.start(), mode, array("q"), plus))
                done = max(done, end)



class Layer:
    """A decoded text and, for each of its characters, the original span.

    ``at`` and ``to`` are None while character i is original character i, or a
    pair of ints where all characters come from one span.
    """

    __slots__ = ("text", "at", "to")

    def __init__(self, text: str, at=None, to=None):
        self.text, self.at, self.to = text, at, to

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.at is None:
            return start, end
        if isinstance(self.at, int):
            return self.at, self.to
        return self.at[start], self.to[end - 1]


def unescaped(layer: Layer) -> Layer | None:
    """The layer with its escapes decoded, None if it has none that can be."""
    out: list[str] = []
    at, to = array("q"), array("q")
    last, changed = 0, False

    def keep(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        for i in range(a, b):
            x, y = layer.origin(i, i + 1)
            at.append(x)
            to.append(y)

    for m in _ESCAPED.finditer(layer.text):
        run, step = m[0], {"%": 3, "u": 6, "x": 4}["%" if m[0][0] == "%" else m[0][1]]
        units = [int(run[i + step - (4 if step == 6 else 2) : i + step], 16) for i in range(0, len(run), step)]
        try:
            if step == 6:
                chars = b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "surrogatepass")
                width = [2 if ord(c) > 0xFFFF else 1 for c in chars]
            else:
                chars = bytes(units).decode("utf-8")
                width = [len(c.encode()) for c in chars]
        except UnicodeDecodeError:
            chars, width = bytes(units).decode("latin-1"), [1] * len(units)
        keep(last, m.start())
        pos = m.start()
        for c, w in zip(chars, width):
            x, y = layer.origin(pos, pos + w * step)
            out.append(c)
            at.append(x)
            to.append(y)
            pos += w * step
        last, changed = m.end(), True
    if not changed:
        return None
    keep(last, len(layer.text))
    return Layer("".join(out), at, to)


def _decoded(layer: Layer, run: str, place: Sequence[int], span: tuple[int, int]) -> Iterator[Layer]:
    """The layers in a run of base64 digits, whose places in the layer are given.

    Digits may stand before the data that are none of them (a path, a word), so the
    run is read from each of its first four digits.  A byte comes from the two
    digits that hold its bits; compressed data come from the whole run.
    """
    for skip in range(4):
        if len(run) - skip < 16:
            return
        data = _bytes_of(run[skip:])
        if _sound(data[:_STEP]):
            for inner in _texts(iter([data])):
                yield Layer(inner, *layer.origin(*span))
        for inner, ends in _placed(data):
            at, to, last = array("q"), array("q"), 0
            for end in ends:
                first, final = skip + last // 3 * 4 + last % 3, skip + (end - 1) // 3 * 4 + (end - 1) % 3 + 1
                x, y = layer.origin(place[first], place[min(final, len(run) - 1)] + 1)
                at.append(x)
                to.append(y)
                last = end
            yield Layer(inner, at, to)


def children(layer: Layer) -> Iterator[Layer]:
    """The layers inside a layer, one at a time."""
    text = layer.text
    if ("%" in text or "\\" in text) and (child := unescaped(layer)):
        yield child
    for m in _BASE64.finditer(text):
        yield from _decoded(layer, m[1], range(m.start(1), m.end(1)), m.span())
    for m in _WRAPPED.finditer(text):
        gaps = [g.span() for g in _BREAKS.finditer(m[0])]
        run = _BREAKS.sub("", m[0]).rstrip("=")
        if len(run) >= 16:
            place = array("q")
            for x, y in zip([0, *(g[1] for g in gaps)], [*(g[0] for g in gaps), len(m[0])]):
                place.extend(range(m.start() + x, m.start() + y))
            yield from _decoded(layer, run, place, m.span())
    for start, end, texts in compressed(text):
        for inner in texts:
            yield Layer(inner, *layer.origin(start, end))


def scan_text(text: str) -> list[tuple[int, int, int, bool]]:
    """Ordered (start, kind index, end, base): base finds and those of decoded layers."""
    found = {x: True for x in find(text)}

    def key(layer: Layer) -> tuple[bytes, tuple[int, int]]:
        return hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.origin(0, len(layer.text))

    root = Layer(text)
    seen = {key(root)}
    work = [children(root)]
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        if not child.text or (k := key(child)) in seen:
            continue
        seen.add(k)
        for x, kind, y in find(child.text):
            a, b = child.origin(x, y)
            found.setdefault((a, kind, b), False)
        work.append(children(child))
    return sorted((a, k, b, is_base) for (a, k, b), is_base in found.items())


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SCAN_DDL = "id bigint, spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maybe = pc.match_substring_regex(b.column(1), _MAYBE)
        spans = [[{"kind": KINDS[k], "start": a, "end": e, "base": is_base} for a, k, e, is_base in scan_text(t)] if m else [] for t, m in zip(b.column(1).to_pylist(), maybe.to_pylist())]
        yield pa.record_batch([b.column(0), pa.array(spans, _SPAN)], ["id", "spans"])
    trim()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: ``SCAN_DDL``, without a shuffle."""
    return keyed(df, id_col, text_col).mapInArrow(_scan, SCAN_DDL)


def redact(text: str) -> str:
    """The text with each secret replaced by its kind; overlapping spans merge."""
    out, last, open_kind, open_at, open_to = [], 0, None, 0, 0
    for a, k, b, _ in scan_text(text):
        if open_kind is not None and a < open_to:
            open_to = max(open_to, b)
            continue
        if open_kind is not None:
            out += [text[last:open_at], f"[{KINDS[open_kind]} removed]"]
            last = open_to
        open_kind, open_at, open_to = k, a, b
    if open_kind is not None:
        out += [text[last:open_at], f"[{KINDS[open_kind]} removed]"]
        last = open_to
    return "".join(out) + text[last:]


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, with the secrets cut out of the text; null stays null."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            maybe = pc.fill_null(pc.match_substring_regex(col, _MAYBE), False).to_pylist()
            texts = [redact(t) if m else t for t, m in zip(col.to_pylist(), maybe)]
            yield pa.record_batch([pa.array(texts, col.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)
        trim()

    return mapped(df, run, df.schema)
