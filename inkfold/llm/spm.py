"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text is marked (spaces become U+2581, one is put in front) and cut into marked
words: no piece of such a vocabulary reaches over a word's mark.  The distinct
words of a block are sorted; walking them in that order is a depth-first walk of
their trie.  The forward state of each prefix stays on a stack, and the next
word goes on from the longest common prefix with its predecessor, so what words
share is computed once.

Forward state of a prefix
* unigram model: best score of a segmentation, and its last piece (Viterbi).
* BPE model: the piece that ends the encoding of the prefix.  A sum of scores is
  not what such a model maximises, so plain Viterbi would give other ids than
  the model's own encoder.  The step is therefore admissible only where the
  previous prefix's last piece and the new piece stay two pieces when they are
  merged alone; exactly one piece is admissible for each prefix, and the path of
  admissible steps is the encoding.  Tests hold both against the library.

Words that start with several marks (BPE models) are merged whole; texts with
double spaces, marks of their own or a leading space are cut into words one by one
instead of all at once.  Both give the library's ids.

Defined cases: null or empty text has no ids; characters without a piece become
byte pieces (or the unknown piece where the model has none); decoding restores
the text, except that a literal U+2581 comes back as a space, as in the library;
of segmentations with equal scores (unigram models) the one whose last piece is
longest is taken, where the library's choice hangs on its rounding; memory grows
with a word's length, not with its square; rows without id are dropped, repeated
rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import keyed, trim

MARK = "▁"
#: Texts of one trie: about so many characters, a bound on a worker's memory.
BLOCK_CHARS = 3_000_000
#: Judgements of piece pairs that a worker remembers: about 100 bytes each.
REMEMBERED = 300_000


class Model:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.ids, self.score, self.byte_ids = {}, {}, [None] * 256
        self.bytes_of: list[bytes] = []
        self.unk = p.unk_id()
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i):
                self.bytes_of.append(b"")
            elif p.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if not p.is_unused(i):
                    self.ids[piece], self.score[piece] = i, p.get_score(i)
        self.longest = max(map(len, self.ids))
        self.merges = not self._is_unigram(p)
        joined = {c for piece in self.ids if len(piece) > 1 for c in piece}
        self.cuts = "".join(c for c in "\n\t\r" if c not in joined)
        self.whole = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        ordered = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: k for k, p in enumerate(ordered, 1)}
        self._stable: dict[str, bool] = {}
        self._halves: dict[str, tuple[str, str]] = {}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.fitting: dict[int, bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        """Aho-Corasick over the pieces: ``ending[state]`` has those that end there, longest first."""
        self.next: list[dict[str, int]] = [{}]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        self._back = [0]
        for piece in self.ids:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ending.append(())
                    self._back.append(0)
                at = to
            self.ending[at] = ((self.ids[piece], len(piece)),)
        queue = list(self.next[0].values())
        for at in queue:
            for c, to in list(self.next[at].items()):
                back = self._back[at]
                while back and c not in self.next[back]:
                    back = self._back[back]
                self._back[to] = self.next[back].get(c, 0)
                queue.append(to)
            self.ending[at] += self.ending[self._back[at]]
        self._deep = len(self.next)

    def step(self, at: int, c: str) -> int:
        back = at
        while back and c not in self.next[back]:
            back = self._back[back]
        to = self.next[back].get(c, 0)
        if to and at < self._deep:
            self.next[at][c] = to
        return to

    @staticmethod
    def _is_unigram(p) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(p.serialized_model_proto())
        return proto.trainer_spec.model_type == 1

    def merge(self, word: str) -> list[str]:
        """BPE by its definition: join the best-scored adjacent pair, leftmost first."""
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := self.score.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, joined))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two pieces that the last join on the way to ``piece`` put together."""
        known = self._halves.get(piece)
        if known is None:
            at = [(self.rank.get(piece[:k], 0), self.rank.get(piece[k:], 0), k) for k in range(1, len(piece))]
            # Scores only fall along a piece's own joins: forbid the last one.
            top = self.score.pop(piece)
            parts = self.merge(piece)
            self.score[piece] = top
            known = self._halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else (piece[: at[0][2]], piece[at[0][2] :])
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when merged alone.

        Goes back through the joins that made them, latest first, and asks
        whether a join over the border would have come earlier.
        """
        rank, bound = self.rank, float("inf")
        while True:
            over = rank.get(left + right)
            if over is not None and over < bound:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if a > b:
                bound, left = a, self.halves(left)[1]
            elif b:
                bound, right = b + 1, self.halves(right)[0]
            else:
                return True

    def stable(self, piece: str) -> bool:
        """Whether the encoding of the piece is that piece."""
        known = self._stable.get(piece)
        if known is None:
            known = self._stable[piece] = self.merge(piece) == [piece]
        return known

    def judge(self, left: int, right: int) -> bool:
        """:meth:`fits` by ids and remembered; -1 on the left is nothing, or a character without a piece."""
        if len(self.fitting) > REMEMBERED:
            self.fitting.clear()
        piece = self.pieces[right]
        good = self.stable(piece) and (left < 0 or self.fits(self.pieces[left], piece))
        self.fitting[left << 32 | right] = good
        return good

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if self.byte_ids[0] is None:
            return [self.unk]
        return [self.byte_ids[b] for b in piece.encode()]


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def words_of(m: Model, text: str) -> list[str]:
    """Marked words whose concatenation is the marked text."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return [marked] if m.whole else _splitter(m.cuts).findall(marked)


@lru_cache(maxsize=8)
def _splitter(cuts: str) -> re.Pattern:
    c = re.escape(cuts)
    return re.compile(f"{MARK}*[^{MARK}{c}]+|{MARK}+" + (f"|[{c}]" if cuts else ""))


def encode_words(m: Model, words: list[str]) -> tuple[list[int], list[int], list[int]]:
    """Ids of the distinct ``words`` end to end, where each begins and how many it has, by one depth-first walk of their trie.

    For each prefix of the current word the stack holds the automaton's state, the
    piece that ends there (-1: a character without one), where that piece begins,
    and its forward score.  The ids of a word are read from its end backwards, so
    memory is a few numbers for each character of one word, however long it is.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list[int] = []
    start, count = [0] * len(words), [0] * len(words)
    last = ""
    states, ends, back, best = [0], [-1], [0], [0.0]
    following, ending, fitting, merges = m.next, m.ending, m.fitting, m.merges
    floor = min(m.score.values(), default=0.0) - 10.0
    for at_word in order:
        word, first = words[at_word], len(out)
        start[at_word] = first
        if merges and word.startswith(MARK + MARK):
            # Equal scores of pieces of marks are joined leftmost first, which is
            # not a property of prefixes: such a word is merged as a whole.
            for p in m.merge(word):
                out += m.piece_ids(p)
            count[at_word] = len(out) - first
            continue
        n, most, keep = len(word), min(len(word), len(last)), 0
        if n > 64 and last.startswith(word[:64]):
            keep = len(os.path.commonprefix((word, last)))
        else:
            while keep < most and word[keep] == last[keep]:
                keep += 1
        del states[keep + 1 :], ends[keep + 1 :], back[keep + 1 :], best[keep + 1 :]
        last, at = word, states[keep]
        for i in range(keep + 1, n + 1):
            c = word[i - 1]
            to = following[at].get(c)
            at = m.step(at, c) if to is None else to
            states.append(at)
            if merges:
                for piece, size in ending[at]:
                    k = i - size
                    left = ends[k] if k else -1
                    good = fitting.get(left << 32 | piece)
                    if good is None:
                        good = m.judge(left, piece)
                    if good:
                        ends.append(piece)
                        back.append(k)
                        break
                else:
                    ends.append(-1)
                    back.append(i - 1)
            else:
                top, end, begin, some = best[i - 1] + floor, -1, i - 1, False
                for piece, size in ending[at]:
                    s = best[i - size] + m.score[m.pieces[piece]]
                    if s > top or not some and s >= top:
                        top, end, begin, some = s, piece, i - size, True
                ends.append(end)
                back.append(begin)
                best.append(top)
        while n:
            if ends[n] >= 0:
                out.append(ends[n])
            else:
                out += m.piece_ids(word[n - 1])[::-1]
            n = back[n]
        out[first:] = out[:first - 1 if first else None:-1]
        count[at_word] = len(out) - first
    return out, start, count


def indexed(m: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked words, the words of all texts as indexes into them, words per text."""
    plain = "\n" in m.cuts and not m.whole
    odd = {i: words_of(m, t) for i, t in enumerate(texts) if t and not (plain and "  " not in t and t[0] != " " and MARK not in t)}
    # A line feed starts a word without a mark; any other word starts with one.
    rows = pc.split_pattern(pc.replace_substring(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string()), "\n", " \n"), " ")
    coded = rows.flatten().dictionary_encode()
    words = [w if w.startswith("\n") else MARK + w for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy()
    sizes = np.diff(rows.offsets.to_numpy())
    empty = np.fromiter((not t or i in odd for i, t in enumerate(texts)), bool, len(texts))
    codes, sizes = codes[np.repeat(~empty, sizes)], np.where(empty, 0, sizes)
    if odd:
        index = {w: i for i, w in enumerate(words)}
        starts, parts, done = np.cumsum(sizes) - sizes, [], 0
        for i, own in odd.items():
            parts += [codes[done : starts[i]], np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own))]
            done, sizes[i] = starts[i], len(own)
        codes, words = np.concatenate([*parts, codes[done:]]), list(index)
    return words, codes, sizes


def encode_texts(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and offsets; the distinct words of all share one trie."""
    words, codes, sizes = indexed(m, texts)
    flat, start, n = (np.array(x, np.int64) for x in encode_words(m, words))
    n = n[codes] if len(codes) else codes.astype(np.int64)
    ends = np.cumsum(n)
    where = np.repeat(start[codes] - ends + n, n) if len(codes) else codes.astype(np.int64)
    where += np.arange(len(where))
    edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
    return flat[where].astype(np.int32), edge


def decode_ids(m: Model, ids) -> str:
    text = b"".join([m.bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts, about ``BLOCK_CHARS`` characters at a time."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for ids, texts in _blocks(batches):
            values, ends = encode_texts(m, texts)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], schema=ENCODED)
        trim()

    return run


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id bigint, ids array<int>`` for each row, without a shuffle."""
    return keyed(df, id_col, text_col).mapInArrow(_encode(model_path), "id bigint, ids array<int>")


DECODED = "id bigint, text string, n_ids bigint, ids_crc32 bigint"


def _decoded(m: Model, ids: pa.Array, flat: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of ``DECODED`` from ids that stand end to end, row k from ``at[k]`` to ``at[k + 1]``."""
    parts = list(zip(at[:-1].tolist(), at[1:].tolist()))
    texts = [decode_ids(m, flat[x:y].tolist()) for x, y in parts]
    raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in parts]
    return pa.record_batch([ids, pa.array(texts, pa.string()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["id", "text", "n_ids", "ids_crc32"])


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            col = b.column(1)
            yield _decoded(m, b.column(0), col.values.to_numpy(), col.offsets.to_numpy())
        trim()

    return run


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DECODED`` of each row: what :func:`decode` gives for :func:`encode`, in one worker, so that ids do not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for ids, texts in _blocks(batches):
            values, ends = encode_texts(m, texts)
            texts.clear()
            yield _decoded(m, pa.array(ids, pa.int64()), values, ends)
        trim()

    return keyed(df, id_col, text_col).mapInArrow(run, DECODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``id, text, n_ids, ids_crc32`` (crc32 of the ids as little-endian unsigned 32-bit integers)."""
    rows = encoded.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(model_path), DECODED)
