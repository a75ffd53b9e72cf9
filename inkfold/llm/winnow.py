"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, lower-case letters and non-ASCII characters of the
lower-cased text.  Fingerprints of a word sequence are the minima of its k-gram
hashes over every sliding window of ``w`` k-grams.  A span of ``k + w - 1`` words
that two texts share contains one whole window, so its minimum is a fingerprint
of both: with ``k + w - 1 = window`` every shared window of ``window`` words is
met.  Fingerprints are joined by hash; each hit is then extended word by word in
both directions, which also rules out hash collisions.  Items shorter than
``window`` are one window: their whole length is one k-gram (w = 1).

Rows: the first pass explodes fingerprints only (id, hash), which the items'
distinct hashes keep or drop: broadcast where their counted number is below
``BROADCAST_HASHES``, otherwise a shuffled semi join.  The second pass takes up
the words of the documents that have a fingerprint in common with an item.

Defined cases: null or empty text has no words and is never contaminated; an
item without words has no window; rows without an id are dropped; repeated items
count once, and items with one window are all reported; repeated documents repeat
in the result; long texts and items are read whole; an empty table of either kind
gives no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import keyed, written

#: Hashes of the items that are broadcast at most: 16 bytes each.
BROADCAST_HASHES = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(words: Column, k: int) -> Column:
    """Hashes of all k-grams, by position; empty where there are fewer words."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.lit(k), *(F.get(words, i + j) for j in range(k))))).otherwise(none)


def minima(hashes: Column, w: int) -> Column:
    """Distinct minima of the sliding windows of ``w`` hashes."""
    if w == 1:
        return F.array_distinct(hashes)
    none = F.array().cast("array<bigint>")
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - w), lambda i: F.least(*(F.get(hashes, i + j) for j in range(w))))
    return F.array_distinct(F.when(F.size(hashes) >= w, each).otherwise(none))


def fingerprints(words: Column, k: int, w: int) -> Column:
    return let(grams(words, k), lambda g: minima(g, w))


def anchors(df: DataFrame, k: int, around: int, wanted: str | None, prefix: str) -> DataFrame:
    """Positions of k-grams with their hash, the words before (nearest first) and after.

    ``df`` has ``id`` and ``words``; ``wanted`` names an array column of hashes
    to which the positions are limited.
    """
    at = F.filter(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.array_contains(wanted, F.get("g", i))) if wanted else F.sequence(F.lit(0), F.size("words") - k)
    rows = df.where(F.size("words") >= k).withColumn("g", let(F.col("words"), lambda v: grams(v, k)))
    one = F.transform(
        at,
        lambda i: F.struct(
            i.alias("pos"),
            F.get("g", i).alias("hash"),
            F.slice("words", i + 1, k).alias("gram"),
            F.reverse(F.slice("words", F.greatest(i + 1 - around, F.lit(1)), F.least(i, F.lit(around)))).alias("before"),
            F.slice("words", i + 1 + k, around).alias("after"),
        ),
    )
    return rows.select(F.col("id").alias(f"{prefix}id"), F.explode(one).alias("a")).select(f"{prefix}id", "a.hash", *(F.col(f"a.{c}").alias(f"{prefix}{c}") for c in ("pos", "gram", "before", "after")))


def same_from_start(a: Column, b: Column, most: int) -> Column:
    """How many leading elements of two arrays are equal, ``most`` at most."""
    out = F.lit(most)
    for j in reversed(range(most)):
        out = F.when(F.coalesce(F.get(a, F.lit(j)) == F.get(b, F.lit(j)), F.lit(False)), out).otherwise(F.lit(j))
    return out


def covered(spans: Column) -> Column:
    """How many positions the sorted (from, to) spans cover."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["to"], s["to"]).alias("to"), (acc["n"] + F.greatest(s["to"] - F.greatest(acc["to"], s["from"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Hit spans of documents: ``id, item, from, to`` in words, ``to`` exclusive.

    ``docs`` and ``items`` have ``id`` and ``text``.
    """
    items = items.select("id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    short = [r[0] for r in items.select(F.size("words")).where(F.size("words") < window).distinct().collect()]  # fewer than ``window`` values
    kinds = [(k, window - k + 1, window)] + [(n, 1, n) for n in sorted(short)]
    of_kind = lambda n: items.where(F.size("words") >= window if n == window else F.size("words") == n)

    wanted = None
    for size, w, need in kinds:
        part = of_kind(need).select(F.explode(fingerprints(F.col("words"), size, w)).alias("hash"))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = wanted.distinct()
    few = wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES

    words = docs.select("id", words_of(F.col("text")).alias("words"))
    prints = let(F.col("words"), lambda v: F.concat(*(fingerprints(v, size, w) for size, w, _ in kinds)))
    met = words.select("id", F.explode(prints).alias("hash")).join(F.broadcast(wanted) if few else wanted, "hash", "left_semi")
    met = met.groupBy("id").agg(F.collect_set("hash").alias("met"))
    # Written: each length of items reads these few documents' words again.
    again = written(docs.join(met, "id").select("id", words_of(F.col("text")).alias("words"), "met"), "winnow-met")

    out = None
    for size, _, need in kinds:
        around = need - size
        left = anchors(again, size, around, "met", "d_")
        right = anchors(of_kind(need), size, around, None, "i_")
        right = right.join(F.broadcast(wanted) if few else wanted, "hash", "left_semi")
        both = left.join(right, (left["hash"] == right["hash"]) & (F.col("d_gram") == F.col("i_gram")))
        a, b = same_from_start(F.col("d_before"), F.col("i_before"), around), same_from_start(F.col("d_after"), F.col("i_after"), around)
        run = both.select(F.col("d_id").alias("id"), F.col("i_id").alias("item"), "d_pos", a.alias("a"), b.alias("b"))
        run = run.where(F.col("a") + F.col("b") + size >= need).select("id", "item", (F.col("d_pos") - F.col("a")).alias("from"), (F.col("d_pos") + size + F.col("b")).alias("to"))
        out = run if out is None else out.unionByName(run)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, doc_col="doc_id", item_col="item_id", text_col="text", window: int = 10, k: int = 5) -> DataFrame:
    """Per document: ``id, n_words, n_hit, items`` (sorted as strings)."""
    docs = keyed(docs, doc_col, text_col)
    items = keyed(items, item_col, text_col)
    found = (
        hits(docs, items, window, k)
        .groupBy("id")
        .agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"), F.collect_set("item").alias("found"))
        .select("id", covered(F.col("spans")).alias("n_hit"), F.array_sort(F.transform("found", lambda x: x.cast("string"))).alias("items"))
    )
    return (
        docs.select("id", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
        .join(found, "id", "left")
        .select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
