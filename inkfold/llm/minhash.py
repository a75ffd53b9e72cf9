"""MinHash near-duplicate detection with exact confirmation.

1. Row by row: the set of word shingles of the whole text, ``bands * rows``
   minima of universal hashes (multiply-add-shift), one key per band, and one bit
   of each minimum as a signature.  Equal sets share a digest; from here on each
   different set takes part once, under a number of its own (combined before the
   shuffle).
2. Band keys with two or more sets are buckets.  A bucket never makes all its
   pairs: first every member meets the bucket's smallest number.
3. Pairs whose signatures agree well enough are confirmed on their full sets.
   Confirmed pairs are links; large-star and small-star join them to components.
4. Only pairs in different components still matter.  The members of a bucket
   outside its largest component meet the members of that component, and one
   another, in blocks of bounded size.  A task keeps its own components and skips
   what its links have joined, most similar signatures first, so it returns a
   forest and never the pairs of a group.

With 32 bands of 4 rows a pair of similarity 0.8 shares no band with probability
5e-8; the signature test drops one with probability below 1e-9.

Defined cases: a text with fewer words than a shingle is one shingle of all its
words; a text that is null or has no words has an empty set and is linked with
nothing; rows without id are dropped; rows that repeat an id repeat in the
result, each with the component of its own text; very long texts only make blocks
of fewer sets; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import drop, keyed, release, trim, written
from inkfold.llm.components import components

#: Bytes of text whose words are in memory at a time.
BLOCK_BYTES = 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(ids: pa.Array, texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of about ``most`` bytes of text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield ids.slice(a, b - a), texts.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and words per text.

    A-Z are lower-cased; words are what stands between spaces and \\t..\\r.
    """
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    at = coded.indices.to_numpy()
    real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[at] > 0 if len(at) else np.zeros(0, bool)
    seen = np.concatenate(([0], np.cumsum(real)))
    return (own[at] if len(at) else np.zeros(0, np.uint64))[real], np.diff(seen[offsets - offsets[0]])


def shingle_sets(words: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text."""
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        chain = [np.full(len(words), 0x51ED270B, np.uint64)]
        for k in range(1, n + 1):  # chain[k][i]: hash of words i .. i+k-1
            chain.append(mix(chain[-1][: len(words) - k + 1] * _MUL + words[k - 1 :]) if len(words) >= k else np.zeros(0, np.uint64))
    out = []
    for start, end in zip(ends - sizes, ends):
        k = min(n, end - start)
        out.append(np.unique(chain[k][start : end - k + 1]) if k else np.zeros(0, np.uint64))
    return out


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, count, np.uint64, endpoint=False) | np.uint64(1), rng.integers(0, 1 << 64, count, np.uint64, endpoint=False)


def minima(sets: list[np.ndarray], family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(texts, hashes) minima; the sets must not be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(family[0])), np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(*family)):
            out[:, k] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
    return out


SIGNATURES = "id bigint, n bigint, digest binary, bands array<bigint>, sketch array<bigint>"


def _digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, smallest: int, seed: int) -> DataFrame:
    """``SIGNATURES`` of ``id, text`` rows; sets below ``smallest`` have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(bands * rows, seed)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for ids, texts in text_blocks(batch.column(0), batch.column(1)):
                sets = shingle_sets(*word_hashes(texts), shingle)
                digest = [_digest(s) for s in sets]
                big = [i for i, s in enumerate(sets) if len(s) >= smallest]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if big:
                    m = minima([sets[i] for i in big], family)
                    with np.errstate(over="ignore"):
                        key = np.repeat(salt[None, :], len(big), 0)
                        for r in range(rows):
                            key = mix(key * _MUL + m[:, r::rows])
                    bits = np.packbits((m & 1).astype(np.uint8), axis=1)
                    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view("<i8")
                    for i, k, b in zip(big, key.view(np.int64), bits):
                        keys[i], sketch[i] = k, b
                yield pa.record_batch(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["id", "n", "digest", "bands", "sketch"],
                )
        trim()

    return docs.mapInArrow(run, SIGNATURES)


def set_bytes(docs: DataFrame, shingle: int) -> DataFrame:
    """``digest, items``: the full set of each text as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch.column(0), batch.column(1)):
                sets = shingle_sets(*word_hashes(texts), shingle)
                yield pa.record_batch([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "items"])
        trim()

    return docs.mapInArrow(run, "digest binary, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``u, v`` with den * intersection >= num * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(b.column(2), b.column(3))]
            mask = pa.array(good, pa.bool_())
            yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], ["u", "v"])
        trim()

    left = sets.select(F.col("rep").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("rep").alias("v"), F.col("items").alias("y"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4, seed: int = 7) -> DataFrame:
    """``id, n, component`` for each row: set size and smallest id reachable by links.

    A link is a pair with ``den * |intersection| >= num * |union|``.
    """
    docs, spark = keyed(df, id_col, text_col), df.sparkSession
    # Different sets can only be linked when the larger has num / (den - num) + 1 items.
    smallest = -(-num // (den - num)) if num < den else 1 << 62
    signed = written(signatures(docs, shingle, bands, rows, smallest, seed), "minhash-signatures")
    far = _farthest(bands * rows, num / den)

    kinds = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    kinds = written(kinds, "minhash-digests")
    # Different sets are numbered: an id may stand for several of them.
    reps = signed.where("bands IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "bands", "sketch")).alias("r"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "digest", "r.*"), "minhash-representatives")
    keys = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    # Written first, so that a join by bucket is one of two plain exchanges, of which a large part can be split.
    shared = written(shared, "minhash-shared")
    members = written(keys.join(shared, "bucket").select("bucket", "rep", "size", "pivot"), "minhash-buckets")
    drop(shared)

    met = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "digest", "id")
    each = set_bytes(docs.join(met.select("id").distinct(), "id", "left_semi"), shingle)
    sets = written(each.join(met.select("rep", "digest"), "digest").dropDuplicates(["rep"]).select("rep", "items"), "minhash-sets")
    release(spark)
    sketches = reps.select("rep", *(F.col("sketch")[k].alias(f"s{k}") for k in range(-(-bands * rows // 64))))

    def apart(a: str, b: str):
        return sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(1, -(-bands * rows // 64))), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))

    first = members.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()
    near = first.join(sketches.alias("a"), F.col("u") == F.col("a.rep")).join(sketches.alias("b"), F.col("v") == F.col("b.rep")).where(apart("a", "b") <= far).select("u", "v")
    edges = written(_confirmed(near, sets, num, den), "minhash-links")
    label = components(edges, "minhash-components")

    # Buckets of two are settled; so is every bucket within one component.
    placed = members.where("size > 2").select("bucket", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = placed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = written(placed.join(main, "bucket").select("main", "rep", "component").distinct(), "minhash-open")
    drop(members)
    across, used = _across(open_, sets, shingle_family=(bands, rows, seed), num=num, den=den)
    more = written(across, "minhash-links")
    release(spark)
    # What they join are whole components.
    joined = components(more, "minhash-joined").select(F.col("id").alias("component"), F.col("component").alias("whole"))
    label = label.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    label = label.unionByName(joined.join(label.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component")))
    drop(sets, open_, edges, *used)

    # Numbers become ids: a component is named by the smallest id of all its sets.
    named = written(label.select(F.col("id").alias("rep"), "component").join(reps.select("rep", "digest", "id"), "rep"), "minhash-named")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component").select("digest", F.col("least").alias("component"))
    placed = kinds.join(named, "digest", "left").where("copies > 1 OR component IS NOT NULL").select("digest", F.coalesce("component", "id").alias("component"))
    alone = signed.where("digest IS NULL").select("id", "n", F.col("id").alias("component"))
    known = signed.where("digest IS NOT NULL").select("id", "n", "digest").join(placed, "digest", "left")
    return known.select("id", "n", F.coalesce("component", "id").alias("component")).unionByName(alone)


#: Sets of a component, and sets outside it, that meet in one task: so many, and about so many bytes of each.
BLOCK, BLOCK_SETS = 1000, 32 << 20


def _across(open_: DataFrame, sets: DataFrame, shingle_family: tuple[int, int, int], num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links ``u, v`` between components, not one pair more than joins them; and the tables that they are read from.

    ``open_`` has ``main, rep, component``: the sets that share a bucket with
    component ``main``, its own and others.  Every other set meets every set of the
    same ``main``, in blocks of ``BLOCK`` by ``BLOCK``, fewer where sets are large.
    A task takes the most similar signatures first and skips pairs that its links
    have joined already.  ``u`` and ``v`` are components.
    """
    bands, rows, seed = shingle_family
    need = bands * rows - _farthest(bands * rows, num / den, 1)
    outside = F.col("component") != F.col("main")
    # Written first: what joins by component are plain exchanges, of which a large part can be split.
    full = written(open_.join(sets, "rep"), "minhash-open-sets")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SETS)).cast("int")
    sized = full.select("main", outside.alias("outside"), F.length("items").cast("bigint").alias("bytes"))
    size = sized.groupBy("main").agg(blocks(F.count("*"), F.sum("bytes")).alias("parts"), blocks(F.count_if("outside"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("bytes"))), F.lit(0))).alias("turns"))
    used = [full, written(size, "minhash-sizes")]
    full = full.join(used[1], "main")
    part = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    held = full.select("main", part("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "rep", "component", "items", F.lit(False).alias("outside"))
    asked = full.where(outside).select("main", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), part("turns").alias("turn"), "rep", "component", "items", F.lit(True).alias("outside"))

    def compare(table: pa.Table) -> pa.Table:
        flag = table.column("outside").to_numpy()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        label = table.column("component").to_numpy()
        own, other = np.flatnonzero(flag), np.flatnonzero(~flag)
        names, node = np.unique(label, return_inverse=True)
        root, found = np.arange(len(names)), []
        if len(own) and len(other):
            sig = minima(items, hash_family(bands * rows, seed))
            theirs = sig[other]
            for i in own:
                same = theirs == sig[i]
                alike = same.sum(1)
                good = (alike >= need) & same.reshape(len(other), bands, rows).all(2).any(1) & (root[node[other]] != root[node[i]])
                for j in np.flatnonzero(good)[np.argsort(-alike[good], kind="stable")]:
                    j = other[j]
                    if root[node[j]] != root[node[i]] and linked(items[i], items[j], num, den):
                        a, b = sorted((root[node[i]], root[node[j]]))
                        root[root == b] = a
                        found.append((names[node[i]], names[node[j]]))
        u, v = zip(*found) if found else ([], [])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return held.unionByName(asked).groupBy("main", "part", "turn").applyInArrow(compare, "u bigint, v bigint"), used


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |x and y| >= num * |x or y| for sorted distinct arrays that are not empty."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _farthest(bits: int, similarity: float, bits_each: int = 2) -> int:
    """Minima (or their lowest bits) in which such a pair differs at most, but for 1 in 1e9.

    Different minima differ in their lowest bit half of the time (``bits_each`` 2).
    """
    from math import comb

    p, tail, k = (1 - similarity) / bits_each, 1.0, 0
    while tail > 1e-9:
        tail -= comb(bits, k) * p**k * (1 - p) ** (bits - k)
        k += 1
    return k
