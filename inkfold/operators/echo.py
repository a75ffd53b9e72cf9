"""Echoes: maximal word sequences that two documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import ngram_text


#: Distinct hashes that are broadcast at most.
BROADCAST_HASHES = 500_000


def _words(docs: DataFrame, n: int) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.split(ngram_text(F.col("text")), " ").alias("w")).where(F.size("w") >= n)


def gram_hashes(docs: DataFrame, n: int) -> DataFrame:
    """``*, pos, h`` for each n-gram of ``text``: 64-bit hashes, never the words; the other columns stay."""
    keep = [c for c in docs.columns if c != "text"]
    at = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.slice("w", i + 1, n)))
    return _words(docs, n).select(*keep, F.posexplode(at).alias("pos", "h"))


def _met(grams: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The grams that occur on the other side: its distinct hashes are broadcast if they are few."""
    wanted = other.select(*keys, "h").distinct()
    few = wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    return grams.join(F.broadcast(wanted) if few else wanted, [*keys, "h"], "left_semi")


def shared_phrases(left: DataFrame, right: DataFrame, n: int = 6) -> DataFrame:
    """``a, b, n_words, phrase``: maximal shared sequences of ``n`` words or more.

    Both sides have ``doc`` and ``text``, and the keys they must agree on (all
    other common columns); ``left`` is the smaller side.  n-grams are joined by
    hash, after each side dropped what the other one does not have; consecutive
    matches on one diagonal are one island, and an island inside a longer one of
    the same pair is dropped.  No lengths are enumerated.  Words come back at the
    end, once for each island, and must be equal on both sides.
    """
    keys = [c for c in left.columns if c in right.columns and c not in ("doc", "text")]
    left, right = left.select(*keys, "doc", "text"), right.select(*keys, "doc", "text")
    b = _met(gram_hashes(right, n), gram_hashes(left, n), keys)
    a = gram_hashes(left, n).withColumnRenamed("doc", "a").withColumnRenamed("pos", "i")
    met = a.join(b.withColumnRenamed("doc", "b").withColumnRenamed("pos", "j"), [*keys, "h"]).withColumn("diagonal", F.col("i") - F.col("j"))
    line = Window.partitionBy("a", "b", "diagonal").orderBy("i")
    met = met.withColumn("island", F.col("i") - F.row_number().over(line))
    runs = met.groupBy(*keys, "a", "b", "diagonal", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count("*") + n - 1).alias("n_words"))
    wa, wb = (_words(x, n).select(F.col("doc").alias(c), F.col("w").alias(f"w{c}")).dropDuplicates([c]) for x, c in ((left, "a"), (right, "b")))
    text = lambda w, at: F.array_join(F.slice(w, F.col(at) + 1, F.col("n_words").cast("int")), " ")
    told = runs.join(wa, "a").withColumn("phrase", text("wa", "i")).drop("wa").join(wb, "b").where(F.col("phrase") == text("wb", "j"))
    found = told.select(*keys, "a", "b", "phrase", "n_words").distinct()
    inside = found.alias("s").join(found.alias("l"), (F.col("s.a") == F.col("l.a")) & (F.col("s.b") == F.col("l.b")) & (F.col("l.n_words") > F.col("s.n_words")) & F.concat(F.lit(" "), F.col("l.phrase"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("s.phrase"), F.lit(" "))), "left_anti")
    return inside


def formulaic(phrases: DataFrame, family: str = "family") -> DataFrame:
    """A phrase that is maximal in two families or more is formulaic."""
    spread = phrases.groupBy("phrase").agg(F.countDistinct(family).alias("families"))
    return phrases.join(spread, "phrase").withColumn("formulaic", F.col("families") >= 2).drop("families")
