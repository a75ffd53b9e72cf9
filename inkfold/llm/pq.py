"""Near-duplicate vectors by product quantisation.

Coarse inverted lists (k-means) hold, for each vector, the product-quantised code
of its residual and the length of what the code leaves over.  A vector looks up
every list that can hold a neighbour: with radius ``r = sqrt(2 - 2 cos)`` between
unit vectors, a list is left out only if the plane between its centre and the
vector's own centre is further than ``r`` away.  In a list, asymmetric
table-lookup distances decide: a vector stays a candidate unless its distance is
above ``r`` by more than its own left-over.  Both bounds are exact, so the lookup
misses nothing.  Candidates are reranked by exact cosine in double precision.

Equal vectors of one label are one entry with a multiplicity.  Lists are cut into
blocks of ``block`` entries and their visitors likewise, so no task holds more
than one block of each, however large a list or a label is.  A task returns a
count for each visitor and a spanning forest of its links: never the pairs.

Bound: centres and code books are fitted on at most ``sample`` vectors, those with
the smallest hashes, and on ``SAMPLE_BYTES`` of them at most; every vector is indexed
and looked up.  Lists grow with the vectors until a list has too few of the sample to
be fitted on.

Defined cases: a vector that is null, zero, empty, or holds a null or non-finite
component, or whose label is null, is linked with nothing; vectors of different
length are not compared; a pair at the threshold is linked, and of equally near
vectors all are; rows without id are dropped; rows that repeat an id are vectors of
their own and repeat in the result; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import drop, written
from inkfold.llm.components import components


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = ((centres * centres).sum(1) - 2 * x[a : a + 4096] @ centres.T).argmin(1)
    return out


#: Bytes of vectors that reach the driver; vectors of the sample for each list.
SAMPLE_BYTES, PER_LIST = 64 << 20, 16


@dataclass
class Index:
    """Centres and code books; ``at`` cuts a vector into its subspaces."""

    centres: np.ndarray
    books: list[np.ndarray]
    at: list[slice]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and left-over length of each vector."""
        own = nearest(unit, self.centres)
        rest = unit - self.centres[own]
        code = np.stack([nearest(rest[:, s], b) for s, b in zip(self.at, self.books)], 1).astype(np.uint8)
        for j, (s, b) in enumerate(zip(self.at, self.books)):
            rest[:, s] -= b[code[:, j]]
        return own, code, np.sqrt((rest * rest).sum(1))

    def probes(self, unit: np.ndarray, own: np.ndarray, r: float) -> list[np.ndarray]:
        """The lists that can hold a vector within ``r`` of each vector."""
        out = []
        size = (self.centres * self.centres).sum(1)
        for a in range(0, len(unit), 1024):
            u, c = unit[a : a + 1024], own[a : a + 1024]
            homes, home = np.unique(c, return_inverse=True)
            # Distances between the centres of these vectors and all others, by products.
            gaps = np.sqrt(np.maximum(size[homes][:, None] + size - 2 * self.centres[homes] @ self.centres.T, 1e-24))
            d = size - 2 * u @ self.centres.T
            beyond = (d - np.take_along_axis(d, c[:, None], 1)) / (2 * gaps[home])
            out += [np.flatnonzero(x) for x in beyond <= r + 1e-6]
        return out

    def candidates(self, queries: np.ndarray, centre: int, code: np.ndarray, left_over: np.ndarray, r: float) -> np.ndarray:
        """(queries, entries) table-lookup distances that are small enough."""
        rest = queries - self.centres[centre]
        far = np.zeros((len(queries), len(code)), np.float32)
        for j, (s, b) in enumerate(zip(self.at, self.books)):
            part = rest[:, s]
            look = (part * part).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * part @ b.T
            far += look.astype(np.float32)[:, code[:, j]]
        return far <= ((r + left_over) ** 2 + 1e-4).astype(np.float32)[None]


def fit(unit: np.ndarray, lists: int, subspaces: int, codes: int, seed: int) -> Index:
    rng = np.random.default_rng(seed)
    centres = kmeans(unit, lists, 10, rng)
    rest = unit - centres[nearest(unit, centres)]
    edges = np.linspace(0, unit.shape[1], min(subspaces, unit.shape[1]) + 1).astype(int)
    at = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    return Index(centres, [kmeans(rest[:, s], min(codes, 256), 8, rng) for s in at], at)


def _units(col: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision, None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for v in col:
        v = v.values
        if v is None or len(v) == 0 or v.null_count:
            out.append(None)
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt((x * x).sum()))
    return out


def near_vectors(df: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", *, cosine: float = 0.93, lists: int | None = None, subspaces: int = 8, codes: int = 256, sample: int = 40_000, block: int = 2048, seed: int = 11) -> DataFrame:
    """``id, n_links, component`` for each vector, compared within its label."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").cast("string").alias("label")).where("id IS NOT NULL")

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = _units(b.column(1))
            labels = b.column(2).to_pylist()
            keep = [u is not None and name is not None for u, name in zip(units, labels)]
            raw = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0 if ok else None for v, ok in zip(b.column(1), keep)]
            key = [hashlib.blake2b(x.tobytes(), digest_size=16, key=name.encode()[:64]).digest() if ok else None for x, ok, name in zip(raw, keep, labels)]
            unit = [u.tobytes() if ok else None for u, ok in zip(units, keep)]
            # Only vectors of one length are compared: it is part of the label.
            group = [f"{len(u)}:{name}" if ok else None for u, ok, name in zip(units, keep, labels)]
            yield pa.record_batch([b.column(0), pa.array(key, pa.binary()), pa.array(group, pa.string()), pa.array(unit, pa.binary())], ["id", "key", "label", "unit"])

    checked = written(rows.mapInArrow(valid, "id bigint, key binary, label string, unit binary"), "pq-vectors")
    kinds = checked.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    kinds = written(kinds, "pq-distinct")
    n, width = kinds.agg(F.count("*"), F.max(F.length("unit"))).head()
    if not n:
        return checked.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    dims, radius = width // 8, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sample = max(256, min(sample, SAMPLE_BYTES // width))

    def matrix(blobs) -> np.ndarray:
        out = np.zeros((len(blobs), dims))
        for i, x in enumerate(blobs):
            x = np.frombuffer(x, np.float64)
            out[i, : len(x)] = x
        return out

    reach = 1 << 31 if n <= 2 * sample else int((1 << 31) * 1.3 * sample / n) + 1
    order = F.pmod(F.xxhash64("key", "label"), F.lit(1 << 31))
    taken = kinds.where(order < reach).orderBy(order, "id").limit(sample).select("unit").toPandas()["unit"]
    index = fit(matrix(taken), lists or int(np.clip(n // 4000, 1, max(1, sample // PER_LIST))), subspaces, codes, seed)
    shared = df.sparkSession.sparkContext.broadcast(index)  # sample / PER_LIST centres at most, and 256 codes a subspace: some MB

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = matrix(b.column(3).to_pylist())
            own, code, left = shared.value.encode(unit)
            probes = shared.value.probes(unit, own, radius)
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(left, pa.float64()), pa.array(probes, pa.list_(pa.int32()))],
                ["label", "id", "copies", "unit", "list", "code", "left_over", "probes"],
            )

    entries = written(kinds.select("label", "id", "copies", "unit").mapInArrow(indexed, "label string, id bigint, copies bigint, unit binary, list int, code binary, left_over double, probes array<int>"), "pq-index")
    visits = entries.select("label", "id", "unit", F.explode("probes").alias("list"))
    # Blocks of each list's entries and of its visitors, of about ``block`` rows.
    size = entries.groupBy("label", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    size = size.join(visits.groupBy("label", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("turns")), ["label", "list"])
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    held = entries.join(size, ["label", "list"]).select("label", "list", part("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "copies", "unit", "code", "left_over", F.lit(False).alias("visitor"))
    asked = visits.join(size, ["label", "list"]).select("label", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), part("turns").alias("turn"), "id", F.lit(0).cast("bigint").alias("copies"), "unit", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("left_over"), F.lit(True).alias("visitor"))

    def compare(table: pa.Table) -> pa.Table:
        flag = table.column("visitor").to_numpy()
        entry, query = table.filter(pa.array(~flag)), table.filter(pa.array(flag))
        none = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not entry.num_rows or not query.num_rows:
            return none
        centre = entry.column("list")[0].as_py()
        eid, copies = entry.column("id").to_numpy(), entry.column("copies").to_numpy()
        e, q, qid = matrix(entry.column("unit").to_pylist()), matrix(query.column("unit").to_pylist()), query.column("id").to_numpy()
        code = np.frombuffer(b"".join(entry.column("code").to_pylist()), np.uint8).reshape(len(eid), -1)
        left = entry.column("left_over").to_numpy()
        nodes, back = np.unique(np.concatenate([eid, qid]), return_inverse=True)
        at_e, at_q, root = back[: len(eid)], back[len(eid) :], np.arange(len(nodes))
        n = np.zeros(len(qid), np.int64)
        for a in range(0, len(qid), 256):
            near = shared.value.candidates(q[a : a + 256], centre, code, left, radius)
            for i in np.flatnonzero(near.any(1)):
                some = np.flatnonzero(near[i])
                some = some[(e[some] @ q[a + i] >= cosine) & (eid[some] != qid[a + i])]
                if not len(some):
                    continue
                n[a + i] = copies[some].sum()
                roots = np.unique(root[np.append(at_e[some], at_q[a + i])])
                if len(roots) > 1:
                    root[np.isin(root, roots[1:])] = roots[0]
        met = np.flatnonzero(n)
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table(
            {
                "id": pa.array(np.concatenate([qid[met], nodes[tied]])),
                "other": pa.array([None] * len(met) + nodes[root[tied]].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([n[met], np.zeros(len(tied), np.int64)])),
            }
        )

    found = written(held.unionByName(asked).groupBy("label", "list", "part", "turn").applyInArrow(compare, "id bigint, other bigint, n bigint"), "pq-links")
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    label = components(found.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")).distinct(), "pq-components")
    drop(entries)
    linked = kinds.join(counts, "id", "left").join(label, "id", "left").where("copies > 1 OR n IS NOT NULL")
    linked = linked.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return checked.select("id", "label", "key").join(linked, ["label", "key"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
