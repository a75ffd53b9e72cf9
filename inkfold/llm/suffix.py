"""Repeated byte strings between documents, by suffix order built column by column.

A byte of a document goes if a string of ``window`` bytes that covers it also
starts in a document with a smaller id.  Strings are judged on the input.

1. Texts are packed into blocks and cut by content into pieces.  Each string of
   ``window`` bytes belongs to the one ``GRAM``-gram in it with the least hash; a
   piece is a run of such strings that belong to the same gram, so equal strings
   are in pieces of equal keys wherever they stand.  Pieces are ``window`` to
   ``2 * window - GRAM`` bytes long and overlap, so that every string is whole in
   exactly one of them.
2. Each block asks once for each key (sorted, cut into shards by value, sent as
   differences).  A shard answers which keys occur in two documents or more.  All
   other pieces cannot share a string and end here.
3. Pieces of shared keys go to the collection of their key, equal ones of a block
   once, with their smallest id; a collection puts equal ones of all blocks
   together.  Of a key with more than ``HOT`` different pieces (a very common line
   between different surroundings), the strings of ``window`` bytes are pieces of
   their own, with keys of their own, so no collection grows with a common line.
4. :func:`column_wise` builds the collection's Burrows-Wheeler transform and the
   common prefixes of its rows: each round inserts one symbol of every piece, reads
   the last round's file of symbols and prefixes in order and writes the next one.  Rows whose common
   prefix reaches ``window`` bytes are one string; it takes the smallest id of all
   pieces that hold it.  A key with one piece is a collection of its own, whose
   order is that of one string: its strings take the piece's smallest id.
5. A collection answers each block with one bit a string, and the block cuts its
   texts.

The rounds' files are byte streams in the worker's memory: a collection is bounded
(``COLLECTION`` pieces and one key more), and a task must not depend on a folder of
its own machine.  Inserting whole documents would take as many rounds as the longest
one has bytes; pieces take ``2 * window - GRAM``.

Rows of the exchanges are sent only where a block has keys in a shard, so there are
never more rows than keys, however large the input is.

Defined cases: null text is empty; a text shorter than ``window`` loses nothing;
long texts are cut like any other and lie in a block of their own; rows without id
are dropped; rows that repeat an id are one document twice, so they do not shorten
each other, and both are in the result; of equal texts the smallest id keeps its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import drop, keyed, release, trim, written
from inkfold.llm.lm import _pack, _pack_keys, _unpack, _unpack_keys
from inkfold.llm.minhash import _MUL, mix

#: Bytes of a gram: 16 to 24.
GRAM = 20
#: Bytes and documents of a block.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 100_000
#: Keys a shard answers; pieces in a group of collections, in a collection, of one key.
SHARD_KEYS, GROUP, COLLECTION, HOT = 1_000_000, 100_000, 4_000, 2_000
#: Bits of a position in a slice of a block; the other bits of 64 are a key's.
_PLACE = 18
_KEY_BITS = 64 - _PLACE


# --- the collection's order -----------------------------------------------------------


def column_wise(strings: np.ndarray, size: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, length and common prefix with the row before (``cap`` at most) of all suffixes in order.

    ``strings`` has a string in each row, ``size`` its bytes.  Round j inserts the
    suffix of length j of every string: the rows of the last round, stably sorted by
    the symbol before them, are the rows of this one.  Symbols are bytes + 1; 0 ends
    a string and sorts first.  Common prefixes change only at inserted rows and
    behind them: one more than the least of the last round's between the two rows
    that they come from.
    """
    m, rounds = len(strings), int(size.max(initial=0))
    wide = strings.size and strings.max() == 255 or cap > 255  # UTF-8 has no byte 255
    kind = np.uint16 if wide else np.uint8
    record, whole = np.dtype([("symbol", kind), ("prefix", kind)]), np.uint32 if wide else np.uint16

    def before(owner: np.ndarray, length: int) -> np.ndarray:
        """The symbol in front of the suffix of that length of each owner."""
        at = size[owner] - length - 1
        return np.where(at >= 0, strings[owner, at].astype(kind) + kind(1), kind(0))

    rows = np.zeros(m, record)
    rows["symbol"] = before(np.arange(m), 0)
    file = io.BytesIO(rows.data)
    # The rows inserted last, and whose they are: the only rows with a new symbol before them.
    tip, whose = np.arange(m), np.arange(m)
    most = m + int(size.sum())
    name, mark, stays = np.empty(most, np.int32), np.zeros(most, bool), np.ones(most, bool)
    for length in range(1, rounds + 1):
        last = np.frombuffer(file.getbuffer(), record)
        symbol, prefix = np.ascontiguousarray(last["symbol"]), np.ascontiguousarray(last["prefix"])
        source = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]
        name[tip], mark[tip] = whose, True
        at = np.flatnonzero(mark[source])
        mark[tip] = False
        whose, tip = name[source[at]], m + at
        rows = np.empty(m + len(source), record)
        stays[tip] = False
        rows.view(whole)[stays[: len(rows)]] = last.view(whole)
        stays[tip] = True
        out = rows["prefix"]
        rows["symbol"][tip] = before(whose, length)
        # Rows that are new, or have a new one above: their prefixes are another.
        touched = np.repeat(at, 2)
        touched[1::2] += 1
        once = np.ones(len(touched), bool)
        once[1:-1:2] = touched[1:-1:2] != touched[2::2]
        touched = touched[once & (touched < len(source))]
        first = (touched == 0) | (symbol[source[touched]] != symbol[source[touched - 1]])
        out[m + touched[first]] = 0
        touched = touched[~first]
        if len(touched):
            out[m + touched] = np.minimum(_least(prefix, source[touched - 1] + 1, source[touched] + 1).astype(np.int64) + 1, cap)
        file = io.BytesIO(rows.data)

    # Owners and lengths: one step of the last-to-first mapping per symbol, from the empty suffixes.
    last = np.frombuffer(file.getbuffer(), record)
    symbol, prefix = np.ascontiguousarray(last["symbol"]), np.ascontiguousarray(last["prefix"])
    source = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]
    follow = np.full(len(symbol), -1, np.int64)
    follow[source] = m + np.arange(len(source))
    owner, lengths = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    row, own, length = np.arange(m), np.arange(m), 0
    while len(row):
        owner[row], lengths[row] = own, length
        row = follow[row]
        row, own, length = row[row >= 0], own[row >= 0], length + 1
    return owner, lengths, prefix


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a:b] for each pair, by minima of doubling widths."""
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    table = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
    return np.minimum(table[level, a], table[level, b - (1 << level)])


def first_ids(strings: np.ndarray, size: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """(strings, starts) smallest id of all strings that hold what starts there and is ``window`` long."""
    owner, length, prefix = column_wise(strings, size, window)
    run = np.cumsum(prefix < window) - 1
    ids = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(ids, run, least[owner])
    out = np.full((len(strings), strings.shape[1] - window + 1), np.iinfo(np.int64).max)
    long = length >= window
    owner = owner[long]
    out[owner, size[owner] - length[long]] = ids[run[long]]
    return out


# --- pieces ---------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position of the last axis."""
    n = data.shape[-1] - GRAM + 1
    # The 8 bytes from each position: every eighth of them lie side by side.
    word = np.empty((*data.shape[:-1], data.shape[-1] - 7), np.uint64)
    for k in range(min(8, word.shape[-1])):
        part = data[..., k : k + (data.shape[-1] - k) // 8 * 8]
        word[..., k::8] = np.ascontiguousarray(part).view("<u8")
    with np.errstate(over="ignore"):
        # Three words, which may overlap.
        h = word[..., :n] * _MUL
        h += word[..., 8 : 8 + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += word[..., GRAM - 8 : GRAM - 8 + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h


def string_keys(rows: np.ndarray) -> np.ndarray:
    """Keys of whole strings, one in each row."""
    out = np.zeros(len(rows), np.uint64)
    wide = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view("<u8")
    with np.errstate(over="ignore"):
        for k in range(wide.shape[1]):
            out = mix(out * _MUL + wide[:, k])
    return out >> np.uint64(_PLACE)


def _even(least: np.ndarray) -> np.ndarray:
    """Keys of grams' hashes: the least of many hashes are small, their keys are spread evenly."""
    with np.errstate(over="ignore"):
        return mix(least >> np.uint64(_PLACE) << np.uint64(_PLACE)) >> np.uint64(_PLACE)


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of each ``w`` neighbours."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == w else np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1])


class Pieces(NamedTuple):
    start: np.ndarray  # first byte in the block
    run: np.ndarray  # strings of ``window`` bytes in it
    key: np.ndarray
    doc: np.ndarray  # number of the document in the block


def cut(data: np.ndarray, sizes: np.ndarray, window: int) -> Pieces:
    """The pieces of a block's texts, which stand end to end in ``data``."""
    n = len(data) - window + 1
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Pieces(none, none, none.astype(np.uint64), none)
    # Strings that would reach over a document's end are none.
    inside = np.ones(n, bool)
    for a, b in zip(np.maximum(ends - sizes, ends - window + 1).tolist(), ends.tolist()):
        inside[a:b] = False
    place, step = np.uint64((1 << _PLACE) - 1), (1 << _PLACE) - window
    number = np.arange(1 << _PLACE, dtype=np.uint64)
    parts: list[tuple[np.ndarray, ...]] = []
    for a in range(0, n, step):
        b = min(a + step, n)
        h = gram_hashes(data[a : b + window - 1])
        least = _slide((h & ~place) | number[: len(h)], window - GRAM + 1)
        good = inside[a:b]
        turn = np.ones(b - a + 1, bool)
        turn[1:-1] = least[1:] != least[:-1]
        begin, end = good & turn[:-1], good & turn[1:]
        begin[1:] |= good[1:] & ~good[:-1]
        end[:-1] |= good[:-1] & ~good[1:]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        parts.append((a + begin, end - begin + 1, _even(least[begin])))
    start, run, key = (np.concatenate(x) for x in zip(*parts))
    return Pieces(start, run, key, np.searchsorted(ends, start, side="right"))


def rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """(pieces, width + 2) bytes: each piece, zeros, and its size, so that equal rows are equal pieces."""
    out = np.zeros((len(start), width + 2), np.uint8)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    column = np.arange(width)
    for a in range(0, len(start), 20_000):
        b = a + 20_000
        out[a:b, :width] = view[start[a:b]]
        out[a:b, :width] *= column < size[a:b, None]
    out[:, width:] = size.astype("<u2")[:, None].view(np.uint8).reshape(-1, 2)
    return out


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the number of each row among them."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    width = rows.shape[1]
    coded = pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode()
    kinds = coded.dictionary
    flat = np.frombuffer(kinds.buffers()[1], np.uint8)[kinds.offset * width : (kinds.offset + len(kinds)) * width]
    return flat.reshape(-1, width), coded.indices.to_numpy().astype(np.int64)


class Shared(NamedTuple):
    """A block's pieces of one sort whose keys are shared."""

    start: np.ndarray  # of each piece: first byte,
    run: np.ndarray  # strings,
    doc: np.ndarray  # document,
    of: np.ndarray  # and number among the different ones
    rows: np.ndarray  # the different ones,
    least: np.ndarray  # their smallest ids
    group: np.ndarray  # and groups


def shared(data: np.ndarray, ids: np.ndarray, pieces: Pieces, hot: bool, window: int, groups: int) -> Shared:
    width = window if hot else 2 * window - GRAM
    start, run, key, doc = pieces
    if hot:  # each string is a piece
        place = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
        start, doc, run = np.repeat(start, run) + place, np.repeat(doc, run), np.ones(len(place), np.int64)
    rows, of = distinct(rows_of(data, start, run + (window - 1), width))
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, of, ids[doc])
    own = np.zeros(len(rows), np.uint64)
    if hot:
        own = string_keys(rows[:, :width])
    else:
        own[of] = key
    return Shared(start, run, doc, of, rows, least, _range(own, groups))


def _range(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of keys each is in."""
    return ((keys >> np.uint64(_KEY_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _opened(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and ids of a block."""
    import zstandard

    sizes, ids = (row.column(c).combine_chunks().values.to_numpy().astype(np.int64) for c in ("sizes", "ids"))
    data = zstandard.ZstdDecompressor().decompress(row.column("texts")[0].as_py()) if sizes.sum() else b""
    return np.frombuffer(data, np.uint8), sizes, ids


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes, dtype=np.uint8) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


BLOCKS = "block string, ids array<bigint>, sizes array<int>, texts binary, keys binary, pieces binary, many binary"


def blocks(docs: DataFrame, window: int) -> DataFrame:
    """Packed texts, their distinct keys in order, the different pieces of each, and whether two documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, made = [], 0, 0, 0
        low = np.uint64((1 << _PLACE) - 1)

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count, made
            ids = np.concatenate([b[0] for b in held])
            sizes = np.concatenate([b[1] for b in held])
            data = np.concatenate([b[2] for b in held])
            held, size, count, made = [], 0, 0, made + 1
            start, run_, key, doc = cut(data, sizes, window)
            # Sorted by key and, within it, by document or by a hash of the piece.
            by_doc = np.sort(key << np.uint64(_PLACE) | doc.astype(np.uint64))
            by_piece = np.sort(key << np.uint64(_PLACE) | (_sums(data, start, run_ + window - 1) & low))
            keys, many = _per_key(by_doc)
            _, kinds = _per_key(by_piece)
            parts = [_squeeze(data.tobytes()), _pack_keys(keys), _pack(kinds.astype(np.uint32)), _squeeze(np.packbits(many > 1).tobytes())]
            return pa.record_batch(
                [pa.array([f"{TaskContext.get().partitionId()}-{made}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in parts)],
                ["block", "ids", "sizes", "texts", "keys", "pieces", "many"],
            )

        for b in batches:
            length = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            # No slice holds more than a block's bytes unless one text does.
            part = (np.cumsum(length) - length) // BLOCK_BYTES + np.arange(len(length)) // BLOCK_DOCS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for x, y in zip(cuts[:-1], cuts[1:]):
                text = b.column(1).slice(x, y - x)
                offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
                raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                if held and (size + len(raw) > BLOCK_BYTES or count + len(text) > BLOCK_DOCS):
                    yield flush()
                held.append((b.column(0).slice(x, y - x).to_numpy(), length[x:y], raw))
                size, count = size + len(raw), count + len(text)
        if held:
            yield flush()
        trim()

    return docs.mapInArrow(run, BLOCKS)


def _per_key(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sorted key-and-value pairs, and the different values of each."""
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] >> np.uint64(_PLACE)
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[first], np.diff(np.append(first, len(pairs)))


def _sums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece, from running sums of its bytes' own powers: good enough to count by."""
    out = np.zeros(len(start), np.uint64)
    step, widest = 1 << 18, int(size.max(initial=0))
    base = 0xD6E8FEB86659FD93
    power = np.cumprod(np.full(step + widest + 1, base, np.uint64))
    back = np.cumprod(np.full(step + 1, pow(base, -1, 1 << 64), np.uint64))
    cuts = np.searchsorted(start, np.arange(0, len(data) + step, step))
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                part = data[k * step : (k + 1) * step + widest].astype(np.uint64) + np.uint64(1)
                part *= power[: len(part)]
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
                at = start[a:b] - k * step
                out[a:b] = mix((total[at + size[a:b]] - total[at]) * back[at])
    return out


# --- the operator ---------------------------------------------------------------------

RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
#: What a block is told: the keys' answers of a shard, or the strings' of a group.
TOLD = "block string, sort int, part int, data binary"


def _none(names: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.table({c: pa.array([], kinds[t]) for c, t in (x.split() for x in names.split(", "))})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``RESULT``: the bytes that stay of each document, and what went.

    ``window`` is at least ``GRAM`` + 1.
    """
    spark = df.sparkSession
    packed = written(blocks(keyed(df, id_col, text_col), window), "suffix-blocks")
    size = packed.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).head()[0]
    shards = max(1, -(-int(size * 2 / (window - GRAM + 2)) // SHARD_KEYS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys, kinds, many in zip(*(b.column(c) for c in range(4))):
                keys, kinds = _unpack_keys(keys.as_py()), _unpack(kinds.as_py(), np.uint32)
                many = np.unpackbits(_expand(many.as_py()))[: len(keys)]
                cuts = np.searchsorted(_range(keys, shards), np.arange(1, shards))
                parts = [(s, *x) for s, x in enumerate(zip(*(np.split(v, cuts) for v in (keys, kinds, many)))) if len(x[0])]
                columns = [pa.array([p[0] for p in parts], pa.int32()), pa.array([block.as_py()] * len(parts), pa.string())]
                columns += [pa.array([f(p[k]) for p in parts], pa.binary()) for k, f in ((1, _pack_keys), (2, _pack), (3, lambda x: _squeeze(x.tobytes())))]
                yield pa.record_batch(columns, ["shard", "block", "keys", "pieces", "many"])
        trim()

    def answer(table: pa.Table) -> pa.Table:
        """0: one document has the key, 1: more have it, 2: and with many different pieces."""
        keys = [_unpack_keys(x.as_py()) for x in table.column("keys")]
        kinds = np.concatenate([_unpack(x.as_py(), np.uint32) for x in table.column("pieces")]).astype(np.int64)
        many = np.concatenate([_expand(x.as_py()) for x in table.column("many")])
        lengths = np.cumsum([len(k) for k in keys])[:-1]
        flat, back = np.unique(np.concatenate(keys), return_inverse=True)
        docs = np.bincount(back, 1 + many, len(flat))
        code = np.where(docs > 1, np.where(np.bincount(back, kinds, len(flat)) > HOT, 2, 1), 0).astype(np.uint8)[back]
        sums = [int(kinds[code == c].sum()) for c in (1, 2)]
        rows = [(b.as_py(), c) for b, c in zip(table.column("block"), np.split(code, lengths))]
        shard = table.column("shard")[0].as_py()
        out = pa.table(
            {
                "block": pa.array([b for b, _ in rows] + [None], pa.string()),
                "sort": pa.array([0] * (len(rows) + 1), pa.int32()),
                "part": pa.array([shard] * (len(rows) + 1), pa.int32()),
                "data": pa.array([_squeeze(c.tobytes()) for _, c in rows] + [None], pa.binary()),
                "sums": pa.array([None] * len(rows) + [sums], pa.list_(pa.int64())),
            }
        )
        del keys, flat, back, kinds, many, docs, code, rows
        trim()
        return out

    asked = packed.select("block", "keys", "pieces", "many").mapInArrow(ask, "shard int, block string, keys binary, pieces binary, many binary")
    codes = written(asked.groupBy("shard").applyInArrow(answer, f"{TOLD}, sums array<bigint>"), "suffix-codes")
    release(spark)
    n, n_hot = (int(x) for x in codes.where("block IS NULL").select(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(2))).head())
    groups = {False: max(1, -(-n // GROUP)), True: max(1, -(-n_hot * (window - GRAM + 2) // 2 // GROUP))}
    codes = codes.where("block IS NOT NULL").select("block", "sort", "part", "data")
    texts = packed.select("block", "ids", "sizes", "texts")

    def of_block(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[bool, Shared]]:
        """Bytes, sizes, ids, and the pieces whose keys are shared."""
        data, sizes, ids = _opened(left)
        right = right.filter(pc.equal(right.column("sort"), 0)).sort_by("part")
        code = np.concatenate([np.zeros(0, np.uint8), *(_expand(x.as_py()) for x in right.column("data"))])
        if not code.any():
            return data, sizes, ids, {}
        pieces = cut(data, sizes, window)
        # The answers are in the order of the block's different keys.
        order = np.argsort(pieces.key, kind="stable")
        ordered = pieces.key[order]
        turn = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        told, code = code, np.empty(len(order), np.uint8)
        code[order] = told[turn]
        out = {}
        for hot in (False, True):
            some = code == 1 + hot
            if some.any():
                out[hot] = shared(data, ids, Pieces(*(x[some] for x in pieces)), hot, window, groups[hot])
        return data, sizes, ids, out

    SENT = "block string, sort int, part int, rows binary, least binary"

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none(SENT)
        block, rows = left.column("block")[0].as_py(), []
        for hot, s in of_block(left, right)[3].items():
            order = np.argsort(s.group, kind="stable")
            cuts = np.flatnonzero(np.diff(s.group[order])) + 1
            rows += [(block, 1 + hot, int(s.group[at[0]]), _squeeze(s.rows[at].tobytes()), _pack(s.least[at])) for at in np.split(order, cuts)]
        trim()
        return pa.table({c: pa.array(v, f.type) for c, v, f in zip(_none(SENT).column_names, zip(*rows), _none(SENT).schema)}) if rows else _none(SENT)

    def collect(table: pa.Table) -> pa.Table:
        """One bit for each string of each piece: whether a smaller id than the block's has it."""
        sort = table.column("sort")[0].as_py()
        width = window if sort == 2 else 2 * window - GRAM
        parts = [_expand(x.as_py()).reshape(-1, width + 2) for x in table.column("rows")]
        least = [_unpack(x.as_py(), np.int64) for x in table.column("least")]
        lengths = np.cumsum([len(x) for x in least])[:-1]
        rows, of = distinct(np.concatenate(parts))
        del parts
        least = np.concatenate(least)
        first = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(first, of, least)
        strings, length = rows[:, :width], rows[:, width:].copy().view("<u2")[:, 0].astype(np.int64)
        if sort == 2:
            key = string_keys(strings)
        else:
            key = np.empty(len(rows), np.uint64)
            column = np.arange(width - GRAM + 1)
            for a in range(0, len(rows), 10_000):
                h = gram_hashes(np.ascontiguousarray(strings[a : a + 10_000]))
                h[column > (length[a : a + 10_000, None] - GRAM)] = np.iinfo(np.uint64).max
                key[a : a + 10_000] = _even(h.min(1))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        count = np.diff(np.append(start, len(order)))
        gone = np.empty((len(of), (width - window + 8) // 8), np.uint8)
        # The order of a key's only piece says nothing: all its strings are its own.
        found = np.where(np.arange(width - window + 1) <= (length - window)[:, None], first[:, None], np.iinfo(np.int64).max)
        several = np.repeat(count > 1, count)
        order, count = order[several], count[count > 1]
        # Collections of about one size end where a key ends.
        start = np.cumsum(count) - count
        cuts = start[1:][np.diff(start // COLLECTION) > 0]
        for at in np.split(order, cuts) if len(order) else []:
            found[at] = first_ids(strings[at], length[at], first[at], window)
        for a in range(0, len(of), 50_000):
            gone[a : a + 50_000] = np.packbits(found[of[a : a + 50_000]] < least[a : a + 50_000, None], axis=1, bitorder="little")
        told = [_squeeze(x.tobytes()) for x in np.split(gone, lengths)]
        out = pa.table({"block": table.column("block"), "sort": table.column("sort"), "part": table.column("part"), "data": pa.array(told, pa.binary())})
        del rows, of, strings, found, gone, order
        trim()
        return out

    sent = texts.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(send, SENT)
    # A task for each group: its work is far greater than its bytes.
    sent = sent.repartition(sum(groups.values()), "sort", "part")
    marks = written(sent.groupBy("sort", "part").applyInArrow(collect, TOLD), "suffix-marks")
    release(spark)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _none(RESULT)
        data, sizes, ids, pieces = of_block(left, right)
        begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for hot, s in pieces.items():
            answers = right.filter(pc.equal(right.column("sort"), 1 + hot)).sort_by("part")
            width = (window if hot else 2 * window - GRAM) - window + 1
            bits = np.empty((len(s.rows), (width + 7) // 8), np.uint8)
            bits[np.argsort(s.group, kind="stable")] = np.concatenate([_expand(x.as_py()) for x in answers.column("data")]).reshape(bits.shape)
            # A document behind the first one of its block that has the piece loses all of it.
            later = ids[s.doc] > s.least[s.of]
            begins.append(s.start[later])
            ends.append(s.start[later] + s.run[later] + window - 1)
            some = np.flatnonzero(~later & bits.any(1)[s.of])
            for a in range(0, len(some), 50_000):
                at = some[a : a + 50_000]
                piece, string = np.nonzero(np.unpackbits(bits[s.of[at]], axis=1, count=width, bitorder="little"))
                begins.append(s.start[at][piece] + string)
                ends.append(begins[-1] + window)
        # Spans of a document that meet are one.
        begin, end, stop = np.concatenate(begins), np.concatenate(ends), np.cumsum(sizes)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        doc = np.searchsorted(stop, begin, side="right")
        first = np.flatnonzero(np.concatenate((np.ones(min(len(begin), 1), bool), (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1]))))
        begin, end, doc = begin[first], end[np.append(first[1:] - 1, len(end) - 1)] if len(first) else end, doc[first]
        stays = np.ones(len(data), bool)
        for a, b in zip(begin.tolist(), end.tolist()):
            stays[a:b] = False
        kept = data[stays]
        removed, spans = (np.bincount(doc, w, len(ids)).astype(np.int64) for w in (end - begin, None))
        offsets = np.concatenate(([0], np.cumsum(sizes - removed))).astype(np.int32)
        texts_ = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        out = pa.table({"id": ids, "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept": texts_})
        del begins, ends, stays, pieces
        trim()
        return out

    told = codes.unionByName(marks)
    out = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, RESULT)
    return out
