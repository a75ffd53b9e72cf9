"""Aggregates with a defined order: first-seen modes, spines, pivots, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.sources.shared import stored


def first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent ``value`` of each group; a tie goes to the one met first in ``order``."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(*keys, f"m.{value}", "m.n")


def zero_filled(spine: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the spine, with zeros where ``df`` has none."""
    return spine.join(df, keys, "left").na.fill(0)


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and column; absent cells are 0, not null.  Plain conditional sums: one pass."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(str(v)) for v in values))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last one in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_n(df: DataFrame, keys: list[str], value: Column, order: str, n: int, name: str) -> DataFrame:
    """``*keys, name``: the first ``n`` values of each group in order, as an array.

    Groups are limited before the exchange, so no task collects more of one than ``n``
    rows from each of its inputs.
    """
    top = top_per_group(df.select(*keys, F.col(order).alias("_o"), value.alias("_v")), keys, [F.col("_o")], n, "_k")
    per = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return per.select(*keys, F.transform("_l", lambda x: x["_v"]).alias(name))


def numbered(df: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """Position of each row within its group, however few groups there are.

    Rows are sorted by ranges of all keys; a range counts its rows of each group,
    and the counts of the ranges before are what its first row goes on from.  Only
    those counts, one for each range and group, meet in one place.
    """
    ranged = stored(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    start = sums.select(group, "_range", before.alias("_start"))
    return ranged.withColumn("_k", within).join(start, [group, "_range"]).withColumn(name, (F.col("_start") + F.col("_k")).cast("bigint")).drop("_range", "_start", "_k")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
