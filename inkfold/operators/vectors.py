"""Vector similarity and threshold clustering over an exact, blocked comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.operators.graph import components


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at length one, in double precision; a zero vector stays null."""
    w = v.cast("array<double>")
    norm = F.sqrt(dot(w, w))
    return F.when(norm > 0, F.transform(w, lambda x: x / norm))


def _grid(df: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Vectors dealt into blocks: one group ``p, q`` for each unordered pair of blocks, with both sides.

    Each vector goes to n / ``block`` groups; that exchange, and the n * n / 2 products,
    are the price of an exact comparison without an index.
    """
    parts = max(1, -(-df.count() // block))
    unit = df.select(F.col(key).cast("bigint").alias("id"), normalised(F.col(vector)).alias("v")).where("v IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    # Block p meets every block q: once as the row side (p <= q), once as the column side.
    sides = F.concat(F.transform(F.sequence(F.col("part"), F.lit(parts - 1)), lambda q: F.struct(F.col("part").alias("p"), q.alias("q"), F.lit(0).alias("side"))), F.transform(F.sequence(F.lit(0), F.col("part")), lambda p: F.struct(p.alias("p"), F.col("part").alias("q"), F.lit(1).alias("side"))))
    return unit.select("id", "v", F.explode(sides).alias("s")).select("s.*", "id", "v")


def _near(t, least: float):
    """``a, b, cosine`` (a < b) of one group of :func:`_grid`."""
    import numpy as np

    side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
    v = t.column("v").combine_chunks()
    m = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(len(ids), -1)
    cos = m[side == 0] @ m[side == 1].T
    i, j = np.nonzero(cos >= least)
    x, y, c = ids[side == 0][i], ids[side == 1][j], cos[i, j]
    keep = x < y if t.column("p")[0].as_py() == t.column("q")[0].as_py() else x != y
    return np.minimum(x, y)[keep], np.maximum(x, y)[keep], c[keep]


def similar_pairs(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """``a, b, cosine`` with a < b and cosine >= ``least``, exactly; vectors have one length.

    Each group of blocks is one task of a matrix product: the dense n x n matrix
    exists nowhere, and only pairs above the threshold leave a task.
    """
    import pyarrow as pa

    def product(t: pa.Table) -> pa.Table:
        a, b, c = _near(t, least)
        return pa.table({"a": pa.array(a), "b": pa.array(b), "cosine": pa.array(c)})

    return _grid(df, key, vector, block).groupBy("p", "q").applyInArrow(product, "a bigint, b bigint, cosine double")


def similar_forest(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """``a, b``: links that join what :func:`similar_pairs` joins, fewer than the vectors of each task."""
    import numpy as np
    import pyarrow as pa

    def product(t: pa.Table) -> pa.Table:
        a, b, _ = _near(t, least)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:  # the least label of the neighbours, then the label of that label
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            low = low[low]
            if (low == root).all():
                break
            root = low
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[root[tied]], pa.int64()), "b": pa.array(nodes[tied], pa.int64())})

    return _grid(df, key, vector, block).groupBy("p", "q").applyInArrow(product, "a bigint, b bigint")


def threshold_clusters(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Single-link clusters: ``id, component`` for every vector, the smallest id of its cluster."""
    return components(df.select(F.col(key).cast("bigint").alias("id")), similar_forest(df, least, key, vector))


def max_similarity(df: DataFrame, probes: list[list[float]], vector: str = "embedding") -> Column:
    """The greatest cosine with any of a few fixed probes: literals, so no join at all."""
    own = normalised(F.col(vector))
    each = [dot(own, F.array(*map(F.lit, p))) for p in probes]
    return each[0] if len(each) == 1 else F.greatest(*each)
