"""Graph operators on edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.sources.shared import discard, stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) by propagation of the smallest label with shortcuts.

    Each round takes the least label of the neighbours, then the label of that
    label, so a path shrinks by half; rounds are written, which cuts the lineage.
    """
    a, b = edges.columns[:2]
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    label = stored(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        heard = both.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("heard"))
        near = label.join(heard, F.col("id") == F.col("u"), "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("next"), "component")
        up = near.select(F.col("id").alias("at"), F.col("next").alias("above"))
        after = near.join(up, F.col("next") == F.col("at"), "left").select("id", F.least("next", F.coalesce("above", "next")).alias("component"), F.col("component").alias("was"))
        after = stored(after, "labels")
        changed = after.where("component <> was").limit(1).count()
        discard(label)
        label = after
        if not changed:
            discard(both)
            return label.select("id", "component")


def undirected_pairs(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b, weight``: directions collapsed and summed, without loops and unknown ends."""
    ids = known.select(F.col(known.columns[0]).alias("known"))
    e = edges.where("source <> target").join(ids, F.col("source") == F.col("known"), "left_semi").join(ids, F.col("target") == F.col("known"), "left_semi")
    return e.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


def label_propagation(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, community``: synchronous, weighted, deterministic (a tie goes to the smallest label).

    A node also hears itself, with the weight of its strongest tie, so that two
    nodes do not swap labels for ever.  It ends when no label moves; after ``rounds``
    (the reference's 100 sweeps) the labels of the last round are returned.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))
    both = stored(both.unionByName(both.groupBy("u").agg(F.max("weight").alias("weight")).select("u", F.col("u").alias("v"), "weight")), "ties")
    label = stored(both.select(F.col("u").alias("id"), F.col("u").alias("community")).distinct(), "communities")
    for _ in range(rounds):
        votes = both.join(label, F.col("v") == F.col("id")).groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("u").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("next"))
        after = stored(label.join(best, F.col("id") == F.col("u")).select("id", F.col("next").alias("community"), F.col("community").alias("was")), "communities")
        moved = after.where("community <> was").limit(1).count()
        discard(label)
        label = after
        if not moved:
            break
    discard(both)
    return label.select("id", "community")


def greedy_modularity(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, community`` (its smallest id) of rows ``a, b, weight`` with a < b: merges that raise modularity.

    In a round each community chooses the neighbour whose merger gains most (a tie
    goes to the smallest id), and those who choose each other merge.  Gains of
    disjoint mergers add up, so modularity rises with each round; it ends when no
    merger gains anything.  Only the graph of communities is kept between rounds,
    and it shrinks.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    total = pairs.agg(F.sum("weight").cast("double")).head()[0]
    if not total:
        return pairs.select(F.col("a").alias("id"), F.col("a").alias("community")).limit(0)
    edges = stored(pairs.select("a", "b", F.col("weight").cast("double").alias("weight")), "communities")
    degree = stored(both(edges).groupBy("a").agg(F.sum("weight").alias("degree")).select(F.col("a").alias("id"), "degree"), "degrees")
    label = stored(degree.select("id", F.col("id").alias("community")), "labels")
    for _ in range(rounds):
        da, db = degree.select(F.col("id").alias("a"), F.col("degree").alias("x")), degree.select(F.col("id").alias("b"), F.col("degree").alias("y"))
        gain = F.round(F.col("weight") / total - F.col("x") * F.col("y") / (2 * total * total), 12)
        gains = stored(edges.join(da, "a").join(db, "b").select("a", "b", gain.alias("weight")).where("weight > 0"), "gains")
        choice = both(gains).groupBy("a").agg(F.min_by("b", F.struct(-F.col("weight"), "b")).alias("b"))
        merged = stored(choice.alias("p").join(choice.alias("q"), (F.col("p.a") == F.col("q.b")) & (F.col("p.b") == F.col("q.a"))).where("p.a > p.b").select(F.col("p.a").alias("old"), F.col("p.b").alias("new")), "merged")
        discard(gains)
        if not merged.limit(1).count():
            break
        to = lambda df, c: df.join(merged, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        moved = to(to(edges, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("weight").alias("weight"))
        after = stored(moved.select(F.col("x").alias("a"), F.col("y").alias("b"), "weight"), "communities"), stored(to(degree, "id").groupBy("id").agg(F.sum("degree").alias("degree")), "degrees"), stored(to(label, "community"), "labels")
        for df in (edges, degree, label, merged):
            discard(df)
        edges, degree, label = after
    return label.select("id", "community")


def modularity(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """One row ``modularity``: sum of inner weight over m, less squared shares of degree."""
    la, lb = label.select(F.col("id").alias("a"), F.col("community").alias("ca")), label.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    p = pairs.join(la, "a").join(lb, "b")
    ends = p.select(F.col("ca").alias("c"), "weight", (F.col("ca") == F.col("cb")).alias("inner")).unionByName(p.select(F.col("cb").alias("c"), "weight", F.lit(False).alias("inner")))
    per = ends.groupBy("c").agg(F.sum("weight").cast("double").alias("degree"), F.sum(F.when(F.col("inner"), F.col("weight")).otherwise(0)).cast("double").alias("inside"))
    m2 = F.sum("degree")
    return per.agg((2 * F.sum("inside") / m2 - F.sum(F.col("degree") * F.col("degree")) / (m2 * m2)).alias("modularity"))


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``; degenerate labelings give 1 when equal in effect, else 0."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("rij"), F.sum("n").alias("total"))
    one = both.crossJoin(rows).crossJoin(cols)  # three relations of one row each
    expected, top = F.try_divide(F.col("ra") * F.col("rb"), pairs(F.col("total"))), (F.col("ra") + F.col("rb")) / 2
    return one.select(F.when(F.coalesce(top - expected, F.lit(0.0)) == 0, F.when(F.col("rij") == top, 1.0).otherwise(0.0)).otherwise((F.col("rij") - expected) / (top - expected)).alias("ari"))


def isolated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    return nodes.join(ends, "id", "left_anti")
