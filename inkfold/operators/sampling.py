"""Stratified samples with exact quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.sources.shared import broadcast_if_small


def stratified(df: DataFrame, group: str, key: str, k: int, diverse: str | None = None) -> DataFrame:
    """``k`` rows over the groups: at least one each, else in proportion (rounded half to even).

    A surplus is taken from, and a lack given to, the largest groups, one each in
    turn.  Within a group rows come in the order of a hash of ``key``: a sample
    that any engine can repeat, unlike a seeded shuffle.  With ``diverse`` every
    value of that column has its first row before any has its second.  The quotas
    are a table of one row per group, which one task orders.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    quota = sizes.crossJoin(total).withColumn("quota", F.greatest(F.bround(F.col("n") / F.col("total") * k, 0).cast("int"), F.lit(1)))
    by_size = Window.orderBy(F.desc("n"), group)
    quota = quota.withColumn("place", F.row_number().over(by_size)).withColumn("over", F.sum("quota").over(Window.partitionBy()) - k)
    # Round-robin by size: each full turn over the groups moves every quota by one.
    turns = F.floor(F.abs("over") / F.col("groups")) + F.when(F.col("place") <= F.abs("over") % F.col("groups"), 1).otherwise(0)
    quota = quota.withColumn("quota", F.greatest(F.col("quota") - F.signum("over").cast("int") * turns, F.lit(1)))
    order = [F.xxhash64(key), F.col(key)]
    if diverse is not None:  # no more than k rows of a value, or of a group, can be taken
        turn = F.row_number().over(Window.partitionBy(group, diverse).orderBy(*order))
        df, order = df.withColumn("turn", turn).where(F.col("turn") <= k), [F.col("turn"), *order]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("turn")
    return ranked.join(broadcast_if_small(quota.select(group, "quota")), group).where("rank <= quota").drop("rank", "quota")
