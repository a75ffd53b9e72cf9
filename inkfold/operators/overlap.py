"""Pairs of sets by what they share: an inverted index where values are rare, blocked products where they are not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.sources.shared import stored

#: Sets and values of one block at most, pairs a batch holds, and values spread out at a time.
BLOCK, BLOCK_VALUES, STRIP, SPREAD = 4096, 1 << 20, 1 << 18, 1 << 22
#: A pair met through the index costs as much as so many cells of a product.
INDEX_COST = 16


def shared_values(df: DataFrame, least: int = 1, block: int = BLOCK) -> DataFrame:
    """``source, target, weight`` (source < target) of rows ``id, value``: how many values two ids share, if ``least`` (1 or more).

    Exact either way.  The index makes a row for each value that a pair shares, which
    are counted first; where they are many beside the pairs, each task of a product
    counts the pairs of two blocks, and no pair is ever exchanged.
    """
    id_, value = df.columns
    ids = df.select(F.col(id_).cast("bigint").alias("id"), F.col(value).alias("value")).where("id IS NOT NULL AND value IS NOT NULL").distinct()
    sets = stored(ids.groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("values")), "sets")
    size = sets.agg(F.count("*").alias("n"), F.sum(F.size("values")).alias("values")).head()
    member = sets.select("id", F.explode("values").alias("value"))
    of = F.col("count").cast("double")
    met = member.groupBy("value").count().agg(F.sum(of * (of - 1) / 2)).head()[0] or 0
    if met * INDEX_COST < size["n"] * (size["n"] - 1) / 2:
        return _indexed(member, least)
    parts = min(size["n"], max(-(-size["n"] // block), -(-(size["values"] or 0) // BLOCK_VALUES), 8))
    return _multiplied(sets, least, max(1, parts))


def _indexed(member: DataFrame, least: int) -> DataFrame:
    other = member.select(F.col("id").alias("target"), "value")
    pairs = member.withColumnRenamed("id", "source").join(other, "value").where("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def _multiplied(sets: DataFrame, least: int, parts: int) -> DataFrame:
    """Sets are dealt into ``parts`` blocks; a group ``p, q`` holds both sides of one pair of blocks."""
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    row_sides = F.transform(F.sequence(F.col("part"), F.lit(parts - 1)), lambda q: F.struct(F.col("part").alias("p"), q.alias("q"), F.lit(0).alias("side")))
    column_sides = F.transform(F.sequence(F.lit(0), F.col("part")), lambda p: F.struct(p.alias("p"), F.col("part").alias("q"), F.lit(1).alias("side")))
    grid = dealt.select("id", "values", F.explode(F.concat(row_sides, column_sides)).alias("s")).select("s.*", "id", "values")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        inner = t.column("p")[0].as_py() == t.column("q")[0].as_py()
        side = t.column("side").to_numpy()
        rows, columns = (_side(t.filter(pa.array(side == k))) for k in (0, 1))
        for source, target, weight in _counted(rows, columns, least, inner):
            yield pa.record_batch([pa.array(source), pa.array(target), pa.array(weight)], ["source", "target", "weight"])

    # The number is given, so that groups whose input is small and whose output is not stay apart.
    spread = grid.repartition(min(parts * (parts + 1) // 2, 2000), "p", "q")
    return spread.groupBy("p", "q").applyInArrow(product, "source bigint, target bigint, weight bigint")


def _side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, and the place of the id and the value of each member."""
    t = t.sort_by("id")
    sets = t.column("values").combine_chunks()
    return t.column("id").to_numpy(), np.repeat(np.arange(len(t)), np.diff(sets.offsets.to_numpy())), sets.flatten().to_numpy(zero_copy_only=False)


def _counted(rows, columns, least: int, inner: bool):
    """``source, target, weight`` of two blocks, in batches; of one block with itself, each pair once.

    Values that many have on both sides go through a matrix product, and the
    others from a member of one side to those of the other.
    """
    (a, at_a, value_a), (b, at_b, value_b) = rows, columns
    common = np.intersect1d(value_a, value_b)
    if not len(common):
        return
    keep_a, keep_b = np.isin(value_a, common), np.isin(value_b, common)
    at_a, at_b = at_a[keep_a], at_b[keep_b]
    code_a, code_b = np.searchsorted(common, value_a[keep_a]), np.searchsorted(common, value_b[keep_b])
    n_a, n_b = np.bincount(code_a, minlength=len(common)), np.bincount(code_b, minlength=len(common))
    dense = n_a * n_b * 100 > len(a) * len(b)
    column = np.cumsum(dense) - 1
    kind = np.float32 if len(common) < 1 << 24 else np.float64  # whole numbers are exact up to there
    left, right = np.zeros((len(a), dense.sum()), kind), np.zeros((dense.sum(), len(b)), kind)
    left[at_a[dense[code_a]], column[code_a[dense[code_a]]]] = 1
    right[column[code_b[dense[code_b]]], at_b[dense[code_b]]] = 1
    rare_a, rare_code = at_a[~dense[code_a]], code_a[~dense[code_a]]  # by id
    by_code = np.argsort(code_b, kind="stable")
    holders, first = at_b[by_code], np.cumsum(n_b) - n_b
    step = max(1, STRIP // len(b))
    for i in range(0, len(a), step):
        weight = left[i : i + step] @ right
        flat = weight.reshape(-1)
        lo, hi = np.searchsorted(rare_a, [i, i + step])
        ends = np.cumsum(n_b[rare_code[lo:hi]])
        while lo < hi:
            done = ends[-(hi - lo) - 1] if hi - lo < len(ends) else 0
            upto = max(lo + 1, hi - len(ends) + int(np.searchsorted(ends, done + SPREAD, "right")))
            code, n = rare_code[lo:upto], n_b[rare_code[lo:upto]]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cell = np.repeat((rare_a[lo:upto] - i) * len(b), n) + holders[np.repeat(first[code], n) + within]
            met, times = np.unique(cell, return_counts=True)
            flat[met] += times
            lo = upto
        enough = weight >= least
        if inner:  # both sides are the same ids in the same order
            enough &= np.arange(len(b)) > np.arange(i, i + len(weight))[:, None]
        x, y = np.nonzero(enough)
        if len(x):
            u, v = a[i + x], b[y]
            yield np.minimum(u, v), np.maximum(u, v), weight[x, y].astype(np.int64)
