"""Language-model scoring by deleted interpolation.

    P(w | h) = sum over k of weight[b][k] * count(h_k w) / count(h_k) + weight[b][0] / (V + 1)

with maximum-likelihood estimates of every order and weights per bucket ``b`` of
the context's frequency.  The weights come from expectation-maximisation on the
tuning part of the training documents, for which the estimates are counted on the
rest of them; the final estimates are counted on all training documents.

How counts meet tokens.  Documents are packed into blocks: the distinct word
hashes, and the tokens as indexes into them.  A block asks for each n-gram that
occurs in it once; the sorted 64-bit keys are cut by value into shards and sent as
differences.  A shard adds up what all blocks report and answers each in the
order of its question, which takes a few bits a key.  A frequent n-gram costs one
entry in each block, however often it occurs.  The number of shards follows the
number of tokens, so a shard stays of one size; a block has a row for a shard only
where it has keys there, so there are never more rows than keys.

Held-out statistics reach the driver as a histogram over (bucket, probability of
each order in ``STEPS`` of an octave), whose size the resolution bounds.  Its price is
some thousandths of a token's log10 probability against weights learned token by
token, more for words that were never seen.

Defined cases: null text is empty; an empty text is one end token; without
training documents N = V = 0; without tuning tokens in a bucket its weights are
even; rows without id are dropped; repeated rows count and repeat; a long text or
word is a token sequence like any other, in one block; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import release, small_batches, trim, written
from inkfold.llm.minhash import _MUL, mix, word_hashes

BLOCK_TOKENS, SHARD_KEYS = 1_000_000, 1_000_000
#: Fixed hashes of the end token and of what stands before a text.
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547)
#: Histogram cells an octave for each order: with three orders, cells have three sides.
STEPS = {1: 8, 2: 8, 3: 3}
_TOP = 250  # cells of a probability: 2**-31 and less share the last one


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: planes of small numbers vanish."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
    width = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes(), dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


BLOCKS = "block string, tuning boolean, ids array<bigint>, sizes array<int>, trained array<boolean>, vocabulary binary, tokens binary"


def blocks(docs: DataFrame) -> DataFrame:
    """``BLOCKS`` of rows ``id, text, trained, tuning``; tuning documents have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        made = 0

        def flush(tuning: bool) -> pa.RecordBatch:
            nonlocal made
            parts, held[tuning] = held[tuning], []
            hashes = np.concatenate([p[1] for p in parts])
            vocabulary, tokens = np.unique(hashes, return_inverse=True)
            made += 1
            lists = [np.concatenate([p[k] for p in parts]) for k in (0, 2, 3)]
            return pa.record_batch(
                [[f"{TaskContext.get().partitionId()}-{made}"], [tuning], pa.array([lists[0]], pa.list_(pa.int64())), pa.array([lists[1]], pa.list_(pa.int32())), pa.array([lists[2]], pa.list_(pa.bool_())), pa.array([_pack_keys(vocabulary)], pa.binary()), pa.array([_pack(tokens.astype(np.uint32))], pa.binary())],
                ["block", "tuning", "ids", "sizes", "trained", "vocabulary", "tokens"],
            )

        for b in batches:
            for tuning in (False, True):
                part = b.filter(pc.equal(b.column(3), tuning))
                for start in range(0, part.num_rows, 200):
                    some = part.slice(start, 200)
                    words, n = word_hashes(some.column(1))
                    hashes = np.full(len(words) + len(n), END, np.uint64)
                    ends = np.cumsum(n + 1) - 1
                    is_word = np.ones(len(hashes), bool)
                    is_word[ends] = False
                    hashes[is_word] = words
                    held[tuning].append((some.column(0).to_numpy(), hashes, (n + 1).astype(np.int32), some.column(2).to_numpy(zero_copy_only=False)))
                    if sum(len(p[1]) for p in held[tuning]) >= BLOCK_TOKENS:
                        yield flush(tuning)
        for tuning in (False, True):
            if held[tuning]:
                yield flush(tuning)

    return docs.select("id", "text", "trained", "tuning").mapInArrow(run, BLOCKS)


def _group(order: int) -> int:
    """Keys are asked for in groups, one after the other: words and pairs, then longer n-grams."""
    return 0 if order <= 2 else order - 2


class Block:
    """A block's n-gram keys: ``keys[g]`` sorted and distinct, ``at[k]`` the key of each token's k-gram in its group.

    The two lowest bits of a key are its order.  ``context[k]`` is the key of the
    k words before a token.  With ``only``, the other groups stay empty.
    """

    def __init__(self, sizes, vocabulary: bytes, tokens: bytes, order: int, only: int | None = None):
        self.sizes = np.asarray(sizes, np.int64)
        hashes = _unpack_keys(vocabulary)[_unpack(tokens, np.uint32)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.keys, self.at, self.context = [], {}, {}
        with np.errstate(over="ignore"):
            before = [np.where(self.place >= k, np.roll(hashes, k), BEGIN) for k in range(1, order)]
            for g in range(_group(order) + 1):
                parts, starts = [], []
                for k in (k for k in range(1, order + 1) if _group(k) == g and only in (None, g)):
                    h, begin = hashes, np.array([BEGIN])
                    for w in before[: k - 1]:
                        h, begin = mix(h * _MUL + w), mix(begin * _MUL + BEGIN)
                    parts.append((k, self._tag(h, k)))
                    starts.append(self._tag(begin, k))
                keys, back = np.unique(np.concatenate([*(p for _, p in parts), *starts]), return_inverse=True) if parts else (np.zeros(0, np.uint64), None)
                self.keys.append(keys)
                for j, (k, _) in enumerate(parts):
                    self.at[k] = back[j * len(hashes) : (j + 1) * len(hashes)]
                    if k < order:  # the k words before a token are the k-gram of the token before, but at a text's start
                        self.context[k] = np.roll(self.at[k], 1)
                        self.context[k][self.place == 0] = back[len(parts) * len(hashes) + j]

    @staticmethod
    def _tag(h: np.ndarray, order: int) -> np.ndarray:
        return (h & ~np.uint64(3)) | np.uint64(order)

    def counts(self, docs: np.ndarray) -> list[np.ndarray]:
        """How often each key of each group occurs in the chosen documents.

        A context that ends at a text's start has no token of its own: it counts
        once for each text.
        """
        chosen = docs[self.doc]
        n = [np.zeros(len(keys), np.int64) for keys in self.keys]
        for k, at in self.at.items():
            n[_group(k)] += np.bincount(at[chosen], minlength=len(n[_group(k)]))
        for k, at in self.context.items():
            n[_group(k)] += np.bincount(at[chosen & (self.place == 0)], minlength=len(n[_group(k)]))
        return n


def _bucket(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the integer part of the binary logarithm."""
    return np.where(n > 0, np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) + 1, 24), 0)


class Estimates:
    """Probabilities of each order for the tokens of a block, from its keys' counts."""

    def __init__(self, block: Block, n: list[np.ndarray], total: int, order: int):
        self.p = np.zeros((order, len(block.doc)))
        self.p[0] = n[0][block.at[1]] / max(total, 1)
        context = np.full(len(block.doc), total, np.int64)
        for k in range(2, order + 1):
            context = n[_group(k - 1)][block.context[k - 1]]
            self.p[k - 1] = n[_group(k)][block.at[k]] / np.maximum(context, 1)
        self.bucket = _bucket(context)


def _cells(e: Estimates) -> np.ndarray:
    cell = e.bucket.copy()
    for p in e.p:
        level = np.where(p > 0, 1 + np.minimum(np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS[len(e.p)]), _TOP - 1), 0).astype(np.int64)
        cell = cell * 256 + level
    return cell


def weights(cells: np.ndarray, counts: np.ndarray, uniform: float, order: int, rounds: int = 60) -> np.ndarray:
    """(bucket, 1 + order) mixture weights by expectation-maximisation."""
    out = np.full((25, order + 1), 1.0 / (order + 1))
    out[0] = [1.0 / order if k < order else 0.0 for k in range(order + 1)] if order > 1 else out[0]
    level = np.stack([(cells >> (8 * (order - 1 - k))) & 255 for k in range(order)]) if len(cells) else np.zeros((order, 0), np.int64)
    p = np.concatenate([np.full((1, len(cells)), uniform), np.where(level > 0, 2.0 ** (-(level - 1) / STEPS[order]), 0.0)])
    bucket = cells >> (8 * order)
    for b in np.unique(bucket):
        own = bucket == b
        q, n, w = p[:, own], counts[own], np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            share = w[:, None] * q
            w = (share / share.sum(0) * n).sum(1)
            w = np.maximum(w / w.sum(), 1e-9)
            w[0] = max(w[0], 1e-6)
            w /= w.sum()
        out[b] = w
    return out


def score(df: DataFrame, id_col: str, text_col: str, trained: Column, tuning: Column, *, order: int = 2) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``trained`` marks what is learned from; ``tuning`` the part of it from which
    the weights are learned.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"), F.coalesce(trained & tuning, F.lit(False)).alias("tuning")).where("id IS NOT NULL")
    packed = written(blocks(docs), "lm-blocks")
    tokens = packed.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).head()[0]
    shards = max(1, -(-tokens * min(order, 2) // SHARD_KEYS))
    width = np.uint64((1 << 64) // shards + 1) if shards > 1 else np.uint64((1 << 64) - 1)

    def ask(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, tuning_, sizes, trained_, vocabulary, toks = (batch.column(c)[i].as_py() for c in ("block", "tuning", "sizes", "trained", "vocabulary", "tokens"))
                block = Block(sizes, vocabulary, toks, order, group)
                n = block.counts(np.asarray(trained_, bool))[group].astype(np.uint32)
                cuts = np.searchsorted(block.keys[group], np.arange(1, shards, dtype=np.uint64) * width)
                keys, n = np.split(block.keys[group], cuts), np.split(n, cuts)
                del block
                full = [s for s in range(shards) if len(keys[s])]
                yield pa.record_batch(
                    [pa.array(full, pa.int32()), pa.array([name] * len(full)), pa.array([tuning_] * len(full)), pa.array([_pack_keys(keys[s]) for s in full], pa.binary()), pa.array([_pack(n[s]) for s in full], pa.binary())],
                    ["shard", "block", "tuning", "keys", "n"],
                )
            trim()

    def answer(table: pa.Table) -> pa.Table:
        keys = [_unpack_keys(k.as_py()) for k in table.column("keys")]
        n = [_unpack(x.as_py(), np.uint32) for x in table.column("n")]
        tuned = table.column("tuning").to_pylist()
        flat, owner = np.unique(np.concatenate(keys), return_inverse=True)
        parts = np.split(owner, np.cumsum([len(k) for k in keys])[:-1])
        every, early = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for at, x, t in zip(parts, n, tuned):
            every[at] += x
            if not t:
                early[at] += x
        begin = Block._tag(np.array([BEGIN]), 1)[0]
        words = ((flat & np.uint64(3)) == 1) & (flat != begin)
        sums = [int(x) for n_ in (every, early) for x in (n_[words].sum(), (n_[words] > 0).sum())]
        rows = [(b.as_py(), _pack(every[at].astype(np.uint64)), _pack(early[at].astype(np.uint64)) if t else None) for b, at, t in zip(table.column("block"), parts, tuned)]
        shard = table.column("shard")[0].as_py()
        del keys, n, flat, owner, parts, every, early
        trim(cycles=False)
        return pa.table(
            {
                "block": pa.array([r[0] for r in rows] + [None], pa.string()),
                "shard": pa.array([shard] * (len(rows) + 1), pa.int32()),
                "every": pa.array([r[1] for r in rows] + [None], pa.binary()),
                "early": pa.array([r[2] for r in rows] + [None], pa.binary()),
                "sums": pa.array([None] * len(rows) + [sums], pa.list_(pa.int64())),
            }
        )

    # One group's questions are answered, and its exchange is gone, before the next one's.
    groups = []
    for g in range(_group(order) + 1):
        asked = packed.select("block", "tuning", "sizes", "trained", "vocabulary", "tokens").mapInArrow(partial(ask, group=g), "shard int, block string, tuning boolean, keys binary, n binary")
        told = written(asked.groupBy("shard").applyInArrow(answer, "block string, shard int, every binary, early binary, sums array<bigint>"), "lm-replies")
        release(df.sparkSession)
        groups.append(told.withColumn("grp", F.lit(g)))
    replies = reduce(DataFrame.unionByName, groups)
    N, V, n_early, v_early = (int(x) for x in replies.where("block IS NULL AND grp = 0").select(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(4))).head())

    def joined(left: pa.Table, right: pa.Table, column: str) -> tuple[Block, np.ndarray]:
        row = {c: left.column(c)[0].as_py() for c in ("sizes", "vocabulary", "tokens")}
        block = Block(**row, order=order)
        right = right.sort_by("shard")
        n = []
        for g in range(len(block.keys)):
            own = right.filter(pc.equal(right.column("grp"), g))
            n.append(np.concatenate([np.zeros(0, np.uint64), *(_unpack(x.as_py(), np.uint64) for x in own.column(column))]).astype(np.int64))
        return block, n

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        block, n = joined(left, right, "early")
        cell, count = np.unique(_cells(Estimates(block, n, n_early, order)), return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(count)})

    tune = packed.where("tuning").select("block", "sizes", "vocabulary", "tokens")
    held = tune.groupBy("block").cogroup(replies.where("early IS NOT NULL").select("block", "grp", "shard", "early").groupBy("block")).applyInArrow(histogram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    mixture = weights(held["cell"].to_numpy(np.int64), held["n"].to_numpy(float), 1.0 / (v_early + 1), order)
    if not N:  # there is nothing to estimate from
        mixture[:] = [1.0] + [0.0] * order

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, [pa.int64()] * 3 + [pa.float64()] * 2)})
        block, n = joined(left, right, "every")
        e = Estimates(block, n, N, order)
        w = mixture[e.bucket]
        p = w[:, 0] / (V + 1)
        for k in range(order):
            p = p + w[:, k + 1] * e.p[k]
        c = n[0][block.at[1]]
        docs_ = len(block.sizes)
        return pa.table(
            {
                "id": pa.array(left.column("ids")[0].as_py(), pa.int64()),
                "n_tokens": pa.array(block.sizes),
                "n_known": pa.array(np.bincount(block.doc, c > 0, docs_).astype(np.int64)),
                "base_score": pa.array(np.bincount(block.doc, np.log10((c + 1) / (N + V + 1)), docs_)),
                "score": pa.array(np.bincount(block.doc, np.log10(p), docs_)),
            }
        )

    out = packed.select("block", "ids", "sizes", "vocabulary", "tokens").groupBy("block").cogroup(replies.where("block IS NOT NULL").select("block", "grp", "shard", "every").groupBy("block")).applyInArrow(final, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(N).cast("bigint"))
