"""Token-id output in shards that are compressed by a grammar (Re-Pair).

Documents are put in ascending order of their ids and encoded; an end id follows
each.  A partition of that order is cut into shards of about ``SHARD_IDS`` ids.
In each shard, frequent adjacent pairs are repeatedly replaced by nonterminals
until no pair occurs ``LEAST`` times.  A round replaces every pair that is more
frequent than all pairs it could overlap, so no replacement takes another one's
symbols.  Pairs are counted once; from then on only positions whose pair was still
frequent, and the neighbours of what was replaced, are looked at.

Where it ends: a rule costs 12 bytes and each replacement saves one symbol of 2
bytes, so a pair that occurs fewer than ``LEAST`` times would cost more than it
saves.  A grammar also ends when it has used up its 16-bit symbols, since a third
byte for every symbol would cost more than further rules save; vocabularies that
do not fit 16 bits have symbols of 32 bits and no such end.

File format, one binary value per shard (little-endian)
    4 bytes  IKRP
    u32      version 1, first nonterminal, documents, rules, symbols, bytes a symbol
    i64[]    document ids
    u32[]    first id of each document within the shard, and the end
    u32[]    rules: left and right symbol
    u32[]    rules: ids that the nonterminal expands to
    u16/u32  symbols
With the expansion lengths, any range of ids is found by a search in their running
sum and decoded without the rest: :meth:`Shard.ids`.

Shards are rows of a Parquet table in the shared folder, so that any store Spark
can reach will do, and a lost executor only repeats its own shards.

Defined cases: null text is empty; an empty text is its end id; a document longer
than a shard is a shard of its own; rows without id are dropped; rows that repeat
an id stand one after the other, by text; an empty table gives no shards and no
rows; other columns, whatever their names, are not read.  A text that holds the
string of an added token (an end mark, say) is encoded as the library does it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import keyed, trim, written

SHARD_IDS = 2_000_000
#: Texts tokenized at a time: about so many bytes.
BLOCK_BYTES = 12_000_000
#: Occurrences from which a rule saves more than it costs.
LEAST = 8
#: Pairs down to this part of the highest frequency are replaced in one round.
NEAR = 32
#: Whitespace next to whitespace or to an end of the text: such a text is encoded as a whole.
_ODD = r"(?s)^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$|[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
#: A stop that the pre-tokenizer parts from the letter before it: such pieces share the word's ids.
_STOPPED = r"[A-Za-zÀ-ÖØ-öø-ɏ][.,]$"
#: Stands before the first piece of a text, a private character; a text that holds it is encoded as a whole.
_FIRST = "\ue000"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.model._resize_cache(0)  # every piece is asked for once
    return t


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    """Bytes that each id stands for: a byte-level vocabulary writes one letter for a byte."""
    vocab = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def _encoded(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that are encoded one by one, and how many each has."""
    lists = [e.ids for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n


def _chars(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string array."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1], memoryview(data or b"")


class Pieces:
    """Ids of the pieces met so far by this worker, end to end; about ``most`` of them stay."""

    def __init__(self, path: str, most: int = 1_200_000):
        self.path, self.most = path, most
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces, each of which begins with its space or line feed."""
        if len(self.known) > self.most:
            self._empty()
        at = pc.index_in(pieces, self.known)
        missing = at.is_null()
        new = pieces.filter(missing)
        # Encoded end to end: ids stand for bytes, so the bytes tell where each piece ends.
        offsets, data = _chars(new)
        width, flats, sizes = _token_bytes(self.path), [self.flat], [self.size]
        for k in range(0, len(new), 500):
            edge = offsets[k : k + 501]
            text = str(data[edge[0] : edge[-1]], "utf-8")
            ids = np.array(_tokenizer(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            stop = np.searchsorted(np.cumsum(width[ids]), edge[1:] - edge[0]) + 1
            flats.append(ids)
            sizes.append(np.diff(stop, prepend=0))
        out = at.fill_null(0).to_numpy().astype(np.int64)
        out[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        return out


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def spread(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``at``, end to end, and the length of each; ``flat`` and ``size`` hold all lists."""
    start, n = np.cumsum(size) - size, size[at]
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for a in range(0, len(at), 200_000):
        b = min(a + 200_000, len(at))
        first, last = ends[a] - n[a], ends[b - 1]
        where = np.repeat(start[at[a:b]] - ends[a:b] + n[a:b], n[a:b])
        where += np.arange(first, last)
        out[first:last] = flat[where]
    return out, n


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (without nulls) end to end, and ids per text.

    The pre-tokenizer never joins what a single space or line feed parts, so each
    distinct piece between them is encoded once.  Texts in which whitespace meets
    whitespace or an end, or that hold an added token, are encoded as a whole.
    """
    odd = pc.match_substring_regex(texts, _ODD)
    for mark in (_FIRST, *(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())):
        odd = pc.or_(odd, pc.match_substring(texts, mark))
    whole = pc.or_(odd, pc.equal(pc.binary_length(texts), 0))
    # A piece follows a space unless it begins a text or starts with a line feed.
    rows = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", pc.binary_join_element_wise(_FIRST, texts, "")), "\n", " \n"), " ")
    sizes = np.diff(rows.offsets.to_numpy()).astype(np.int64)
    coded = rows.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    first = pc.starts_with(words, _FIRST).to_numpy(zero_copy_only=False).astype(bool)
    bare = pc.or_(pa.array(first), pc.starts_with(words, "\n"))
    inner = np.flatnonzero(~first & (pc.binary_length(words).to_numpy() > 0))
    spaced = pc.if_else(bare, words, pc.binary_join_element_wise(" ", words, "")).take(pa.array(inner))
    ended = pc.match_substring_regex(spaced, _STOPPED)
    stems = pc.if_else(ended, pc.utf8_slice_codeunits(spaced, 0, -1), spaced).dictionary_encode()
    known = _pieces(path)
    number = np.zeros(len(words), np.int64)
    number[inner] = known.add(stems.dictionary)[stems.indices.to_numpy()]
    stop = np.zeros(len(words), np.int64)  # 1 and 2: the piece ends with one of the stops
    stop[inner] = pc.if_else(ended, pc.if_else(pc.ends_with(spaced, "."), 1, 2), 0).to_numpy(zero_copy_only=False)
    begins, alone = np.flatnonzero(first), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    more, n = _encoded(path, [".", ",", *(w[1:] for w in words.take(pa.array(begins)).to_pylist()), *texts.take(pa.array(alone)).to_pylist()])
    base = len(known.size)
    number[begins] = base + 2 + np.arange(len(begins))
    keep = np.repeat(~whole.to_numpy(zero_copy_only=False).astype(bool), sizes)
    sizes[whole.to_numpy(zero_copy_only=False).astype(bool)] = 0
    codes = codes[keep] if len(codes) else codes
    # A stop is a piece of its own behind its word.
    tail = stop[codes]
    ends = np.cumsum(1 + (tail > 0))
    at = np.repeat(number[codes], 1 + (tail > 0))
    at[ends[tail > 0] - 1] = base - 1 + tail[tail > 0]
    edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
    sizes = np.diff(edge)
    del rows, coded, codes, keep, spaced, stems, ended, words, tail, ends
    if len(alone):
        at = np.insert(at, edge[alone], base + 2 + len(begins) + np.arange(len(alone)))
        sizes[alone] = 1
    ids, n = spread(np.concatenate([known.flat, more]), np.concatenate([known.size, n]), at)
    edge = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
    return ids, np.diff(edge)


#: Cells of a table of pairs.
_CELLS = 18


def _cell(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key * key.dtype.type(0x9E3779B1)) >> key.dtype.type(key.itemsize * 8 - _CELLS)


def _among(pairs: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which keys, given by their cells, are one of the pairs, and perhaps a few more."""
    some = np.zeros(1 << _CELLS, bool)
    some[_cell(pairs)] = True
    return some[cells]


def _counted(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur ``least`` times or more, in order, and how often."""
    ordered = np.sort(key)
    edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)])) if len(key) else np.zeros(1, np.int64)
    n = np.diff(edge)
    often = n >= least
    return ordered[edge[:-1][often]], n[often]


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and the ids that each rule expands to; symbols from ``base`` on are nonterminals."""
    narrow = base < 1 << 16
    kind, shift, most = (np.uint32, 16, 1 << 16) if narrow else (np.uint64, 32, 1 << 32)
    count, top, made, length = len(ids), base, [], np.ones(base, np.int64)
    # Positions are linked: what was replaced stays in place, without neighbours.
    s = np.append(ids, 0).astype(kind)
    place = np.int32 if count < (1 << 31) - 2 else np.int64
    after, before = np.arange(1, count + 2, dtype=place), np.arange(-1, count, dtype=place)
    look = np.ones(count + 1, bool)  # positions whose pair may be frequent; the last one is none
    look[max(count - 1, 0) :] = False

    def keys(at: np.ndarray) -> np.ndarray:
        return (s[at] << kind(shift)) | s[after[at]]

    while top < most:
        live = np.flatnonzero(look)
        key = keys(live)
        pair, n = _counted(key, least)
        if not len(pair):
            break
        # Down to a part of the highest frequency, pairs are replaced until none is left.
        level = max(least, int(n.max()) // NEAR)
        cells = _cell(key)
        look[live[~_among(pair, cells)]] = False
        pair, n = pair[n >= level], n[n >= level]
        while len(pair) and top < most:
            some = _among(pair, cells)
            live, key, cells = live[some], key[some], cells[some]
            # Of chosen pairs in one cell of the table, the first stays; the others wait for the next round.
            chosen = _apart(pair, n, shift, top)[: most - top]
            slot = np.full(1 << _CELLS, -1, np.int32)
            slot[_cell(pair[chosen[::-1]])] = np.arange(len(chosen), dtype=np.int32)[::-1]
            chosen = chosen[slot[_cell(pair[chosen])] == np.arange(len(chosen))]
            table = pair[chosen]
            slot[_cell(table)] = np.arange(len(table), dtype=np.int32)
            found = slot[cells]
            hit = np.flatnonzero(found >= 0)
            hit = hit[table[found[hit]] == key[hit]]
            hit, found = live[hit], found[hit]
            # A run of one symbol is paired from its start.
            twin = np.flatnonzero(s[hit] == s[after[hit]])
            if len(twin):
                at = hit[twin]
                start = np.concatenate(([True], (at[1:] != after[at[:-1]]) | (s[at[1:]] != s[at[:-1]])))
                place = np.arange(len(at))
                odd = (place - place[start][np.cumsum(start) - 1]) % 2 == 1
                hit, found = np.delete(hit, twin[odd]), np.delete(found, twin[odd])
            gone = after[hit]
            s[hit] = (top + found).astype(kind)
            after[hit] = after[gone]
            before[after[gone]] = hit
            after[gone] = -1
            # Positions beside a new symbol have new pairs.
            look[gone] = False
            look[hit] = look[before[hit]] = True
            look[before[count]] = look[count] = False
            own = np.zeros(count + 1, bool)
            own[live] = own[hit] = own[before[hit]] = True
            live = np.flatnonzero(own & look)
            a, b = (table >> kind(shift)).astype(np.int64), (table & kind((1 << shift) - 1)).astype(np.int64)
            length = np.concatenate([length, length[a] + length[b]])
            made.append(np.stack([a, b], 1))
            top += len(table)
            key = keys(live)
            cells = _cell(key)
            pair, n = _counted(key, level)
    rules = np.concatenate(made) if made else np.zeros((0, 2), np.int64)
    return s[:-1][after[:-1] >= 0], rules, length[base:]


def _apart(pair: np.ndarray, n: np.ndarray, shift: int, top: int) -> np.ndarray:
    """Pairs, most frequent first, none of which could overlap one taken before it."""
    x, y = (pair >> pair.dtype.type(shift)).astype(np.int64), (pair & pair.dtype.type((1 << shift) - 1)).astype(np.int64)
    left, right = np.zeros(top, bool), np.zeros(top, bool)
    order = np.lexsort((pair, -n))
    taken, rank = np.zeros(len(order), bool), np.arange(len(order))
    while len(rank):
        # The first of all that could overlap: each symbol's first pair at either end.
        a, b = x[order[rank]], y[order[rank]]
        ends, begins = np.full(top, len(order)), np.full(top, len(order))
        ends[b[::-1]] = begins[a[::-1]] = rank[::-1]
        first = (rank <= ends[a]) & (rank <= begins[b])
        taken[rank[first]] = True
        left[a[first]] = right[b[first]] = True
        rank = rank[~first & ~right[a] & ~left[b]]
    return order[taken]


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all nonterminals end to end, and how many each has: all are opened level by level."""
    flat, owner = rules.reshape(-1).astype(np.int64), np.repeat(np.arange(len(rules)), 2)
    while (more := flat >= base).any():
        n = np.where(more, 2, 1)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        out[at[~more]] = flat[~more]
        pairs = rules[flat[more] - base]
        out[at[more]], out[at[more] + 1] = pairs[:, 0], pairs[:, 1]
        flat, owner = out, np.repeat(owner, n)
    return flat, np.bincount(owner, minlength=len(rules))


_HEAD = struct.Struct("<4s6I")


def write_shard(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    symbols, rules, lengths = compress(ids, base)
    width = 2 if base < 1 << 16 else 4
    head = _HEAD.pack(b"IKRP", 1, base, len(docs), len(rules), len(symbols), width)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    parts = [docs.astype("<i8"), starts.astype("<u4"), rules.astype("<u4"), lengths.astype("<u4"), symbols.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard that was read: its documents and any range of its ids."""

    def __init__(self, data: bytes):
        magic, version, self.base, n, rules, symbols, width = _HEAD.unpack_from(data)
        if magic != b"IKRP" or version != 1:
            raise ValueError("not a shard of version 1")
        at = _HEAD.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.docs, self.starts = take(n, "<i8"), take(n + 1, "<u4").astype(np.int64)
        self.rules, self.lengths = take(2 * rules, "<u4").reshape(-1, 2).astype(np.int64), take(rules, "<u4").astype(np.int64)
        self.symbols = take(symbols, f"<u{width}")
        size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        self.ends = np.cumsum(size[self.symbols])
        self._size = size
        # Symbols below ``base`` stand for themselves.
        self._flat = np.concatenate([np.arange(self.base), expansions(self.rules, self.base)[0]]).astype("<u4")

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``: only the symbols that reach into the range are expanded."""
        if end <= start:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.ends, [start, end - 1], side="right")
        skip = start - (self.ends[a - 1] if a else 0)
        return spread(self._flat, self._size, self.symbols[a : b + 1])[0][skip : skip + end - start]


SHARDS = "part int, shard int, n_ids bigint, data binary"
#: Documents whose ids are decoded together when all of a shard is read.
RANGE = 64


def write(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """``SHARDS`` as a written table; (part, shard) is the order of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
        part, made = TaskContext.get().partitionId(), 0

        def shards(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            docs = np.concatenate([b.column(0).to_numpy() for b in held])
            texts = pa.concat_arrays([b.column(1) for b in held])
            held.clear()
            flat, n = encode_texts(tokenizer_path, texts)
            del texts
            flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
            ends = np.cumsum(n)
            # A shard ends with the document that reaches its size.
            number = (ends - n) // SHARD_IDS
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(docs)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                made += 1
                ids = flat[ends[a] - n[a] : ends[b - 1]]
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([write_shard(docs[a:b], n[a:b], ids, base)], pa.binary())], ["part", "shard", "n_ids", "data"])

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(1))).as_py()
            if size >= BLOCK_BYTES:
                yield from shards(held)
                size = 0
                trim(cycles=False)
        if held:
            yield from shards(held)
        trim(cycles=False)

    ordered = keyed(df, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(run, SHARDS), "repair-shards")


def read(shards: DataFrame) -> DataFrame:
    """``id, start, n_ids, ids_crc32`` of every document, decoded from the shards by ranges of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s, crc = Shard(data.as_buffer()), []
                for k in range(0, len(s.docs), RANGE):
                    edge = s.starts[k : k + RANGE + 1]
                    raw = memoryview(s.ids(edge[0], edge[-1])).cast("B")
                    crc += [zlib.crc32(raw[x:y]) for x, y in zip((4 * (edge[:-1] - edge[0])).tolist(), (4 * (edge[1:] - edge[0])).tolist())]
                n = len(s.docs)
                yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(s.docs), pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())], ["part", "shard", "id", "at", "n_ids", "ids_crc32"])
        trim(cycles=False)

    rows = shards.select("part", "shard", "data").mapInArrow(run, "part int, shard int, id bigint, at bigint, n_ids bigint, ids_crc32 bigint")
    # Ids before each shard: a running sum over partitions (one row each), then within each.
    sums = shards.select("part", "shard", "n_ids")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.join(parts, "part").select("part", "shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))
    return rows.join(base, ["part", "shard"]).select("id", (F.col("base") + F.col("at")).cast("bigint").alias("start"), "n_ids", "ids_crc32")
