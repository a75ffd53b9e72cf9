"""Language identification: sparse multinomial logistic regression.

Features are character 1- to 3-grams of the lower-cased text (runs of anything
that is no letter become one space), hashed into ``2**bits`` bins and weighted by
TF-IDF, with unit length.  Document frequencies are counted over every training
document.  The weights are learned by follow-the-regularised-leader (per-weight
adaptive rates) with L1 and L2 penalties, so most of them are exactly zero.  The
last step fits one temperature on calibration rows that the weights never saw.

Bound: the classifier is fitted on at most ``max_rows`` labelled rows (2 for each
label, if those are more), those of each label with the smallest hashes of their
id and text.  Labels are counted over all rows and each has its quota, in
proportion to its rows but ``LEAST_ROWS`` at least or all that it has.  All else
covers all rows, and texts are always whole.  What comes to the driver of a text is its features, at most
``2**bits`` of them.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; a
model without training rows gives ``und`` for every text; ties between classes
go to the first in sorted order; repeated rows repeat; long texts are read whole,
a block at a time; an empty table gives no rows.  :func:`identify` keeps all columns
of its input but those that have the names of its two results, which it replaces:
choose other names where a table has them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkfold.llm.common import mapped, small_batches, trim

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_HASH = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]
#: Texts whose features are in memory at a time: about so many characters.
BLOCK_CHARS = 1_000_000
#: So many rows of each label are in the sample, or all that there are.
LEAST_ROWS = 50


def letters(text: str | None) -> str:
    """Lower case, one space for each run without letters; empty if there is no letter."""
    out = _OTHER.sub(" ", text.lower()) if text else ""
    if not out.isascii() and not out.replace(" ", "").isalpha():  # numerals such as ² and Ⅷ are no letters
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return out if out.strip() else ""


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, count) triples of the n-gram bins of each text, sorted by row and bin."""
    joined = "\0\0".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes + 2)[: len(codes)]
    keys = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint32)
        for n in range(3):
            h = h[: len(codes) - n] if n == 0 else h[:-1]
            if len(h) == 0:
                break
            h = (h ^ codes[n:]) * _HASH[n]
            h ^= h >> np.uint32(15)
            inside = codes[n:] != 0
            if n:
                inside &= codes[: len(h)] != 0
            if n == 2:
                inside &= codes[1:-1] != 0
            mixed = (h * _HASH[0]) >> np.uint32(32 - bits)
            keys.append((row[: len(h)][inside].astype(np.uint64) << np.uint64(32)) | mixed[inside])
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count


def blocks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 2
        if size >= BLOCK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


@dataclass
class Model:
    """What a prediction needs; its size depends on ``bits`` and the labels only."""

    labels: list[str]
    bits: int
    idf: np.ndarray  # float32, 2**bits
    weights: np.ndarray  # float32, (2**bits, labels)
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        row, col, count = features(texts, self.bits)
        value = (1 + np.log(count)) * self.idf[col]
        norm = np.sqrt(np.bincount(row, value * value, len(texts)))
        out = np.stack([np.bincount(row, value * self.weights[col, k], len(texts)) for k in range(len(self.labels))], 1)
        return out / np.where(norm > 0, norm, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cleaned = [letters(t) for t in texts]
        langs, scores = [], []
        for part in blocks(cleaned):
            own = cleaned[part]
            if not self.labels:
                langs += [UNDETERMINED] * len(own)
                scores.append(np.zeros(len(own)))
                continue
            p = softmax(self.logits(own) / self.temperature)
            best = p.argmax(1)
            known = np.fromiter(map(bool, own), bool, len(own))
            langs += [self.labels[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
            scores.append(np.where(known, p[np.arange(len(own)), best], 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, bits: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int, batch: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over mini-batches of (bins, values) rows."""
    size = 1 << bits
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))  # the last row is the bias

    def weights(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            if not len(part):
                continue
            bins = [np.append(rows[i][0], size) for i in part]
            flat, values = np.concatenate(bins), np.concatenate([np.append(rows[i][1], 1.0) for i in part])
            owner = np.repeat(np.arange(len(part)), [len(b) for b in bins])
            at, where = np.unique(flat, return_inverse=True)
            w = weights(at)
            scores = np.stack([np.bincount(owner, values * w[where, k], len(part)) for k in range(n_labels)], 1)
            error = softmax(scores)
            error[np.arange(len(part)), y[part]] -= 1
            for k in range(n_labels):
                g = np.bincount(where, values * error[owner, k], len(at)) / len(part)
                before = n[at, k]
                after = before + g * g
                z[at, k] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w[:, k]
                n[at, k] = after
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame, bits: int) -> tuple[np.ndarray, int, dict[str, int]]:
    """In how many of all rows of ``text`` each bin occurs, the number of rows, and
    that of the rows with a letter by ``label``.

    Each task sends one count per bin and label that it met; the result has
    ``2**bits`` rows and the labels at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, per = np.zeros(1 << bits, np.int64), 0, Counter()
        for b in batches:
            cleaned = [letters(t) for t in b.column(0).to_pylist()]
            n += len(cleaned)
            per.update(x for t, x in zip(cleaned, b.column(1).to_pylist()) if t)
            for part in blocks(cleaned):
                df += np.bincount(features(cleaned[part], bits)[1], minlength=1 << bits)
        at = np.flatnonzero(df)
        trim()
        bins = np.concatenate((at, [-1], np.full(len(per), -2)))
        sums = np.concatenate((df[at], [n], np.fromiter(per.values(), np.int64, len(per))))
        yield pa.record_batch([pa.array(bins, pa.int64()), pa.array([None] * (len(at) + 1) + list(per), pa.string()), pa.array(sums, pa.int64())], ["bin", "label", "n"])

    sums = texts.select("text", "label").mapInArrow(count, "bin bigint, label string, n bigint").groupBy("bin", "label").agg(F.sum("n").alias("n")).toPandas()
    at, n = sums["bin"].to_numpy(), sums["n"].to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at == -1].sum()), dict(zip(sums["label"][at == -2], map(int, n[at == -2])))


def quotas(per: dict[str, int], max_rows: int) -> dict[str, int]:
    """How many rows of each label are in the sample."""
    floor = max(2, min(LEAST_ROWS, max_rows // max(len(per), 1)))
    least = {x: min(n, floor) for x, n in per.items()}
    left, rest = sum(per.values()) - sum(least.values()), max(0, max_rows - sum(least.values()))
    return {x: least[x] + (min(left, rest) * (n - least[x]) // left if left else 0) for x, n in per.items()}


def calibrates(names: list[str]) -> np.ndarray:
    """Each fifth row of a label, or its last if there are two to four."""
    total, seen, out = Counter(names), Counter(), np.zeros(len(names), bool)
    for i, x in enumerate(names):
        seen[x] += 1
        out[i] = seen[x] % 5 == 0 or 1 < total[x] < 5 and seen[x] == total[x]
    return out


def _packed(batches: Iterator[pa.RecordBatch], bits: int, reach: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Label, hash and packed features of the rows within their label's reach that have a letter."""
    for b in batches:
        names, hashes = b.column("label").to_pylist(), b.column("h").to_numpy()
        inside = [i for i, (x, h) in enumerate(zip(names, hashes % (1 << 31))) if h < reach.get(x, 0)]
        cleaned = dict(zip(inside, map(letters, b.column("text").take(pa.array(inside, pa.int64())).to_pylist())))
        keep = [i for i in inside if cleaned[i]]
        packed: list[bytes] = []
        texts = [cleaned[i] for i in keep]
        for part in blocks(texts):
            row, col, count = features(texts[part], bits)
            cut = np.searchsorted(row, np.arange(1, part.stop - part.start))
            packed += [zlib.compress(np.concatenate((np.diff(c, prepend=0), n)).astype("<u4").tobytes(), 1) for c, n in zip(np.split(col, cut), np.split(count, cut))]
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([b.column("label").take(at), b.column("h").take(at), pa.array(packed, pa.binary())], ["label", "h", "features"])
    trim()


def _weighted(packed: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and TF-IDF values of unit length."""
    step, count = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, -1)
    col = np.cumsum(step, dtype=np.int32)
    value = (1 + np.log(count)) * idf[col]
    return col, (value / (np.sqrt(value @ value) or 1)).astype(np.float32)


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", *, key: Column | None = None, bits: int = 16, max_rows: int = 6000, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 6, batch: int = 16, seed: int = 1) -> Model:
    """Fit on the labelled rows of ``df``; ``key`` orders the bounded sample (default: the text).

    Each fifth row of a label is kept from the weights and fits the temperature.
    """
    small_batches(df.sparkSession)
    labelled = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"), F.xxhash64(key if key is not None else F.col(f"`{text_col}`")).alias("h")).where("text IS NOT NULL AND label IS NOT NULL")
    df_counts, n_docs, per_label = document_frequencies(labelled, bits)
    idf = np.log((1 + n_docs) / (1 + df_counts)).astype(np.float32) + 1
    quota = quotas(per_label, max_rows)
    # Only little more than the sample leaves the scan, whatever the table's size.
    reach = {x: 1 << 31 if per_label[x] <= 2 * q else int((1 << 31) * min(1, (q + 8 * q**0.5 + 40) / per_label[x])) + 1 for x, q in quota.items()}
    near = labelled.mapInArrow(lambda b: _packed(b, bits, reach), "label string, h bigint, features binary").toPandas()
    near = near.sort_values(["h", "label", "features"])
    near = near[near.groupby("label").cumcount() < near["label"].map(quota)]
    names = list(near["label"])
    labels = sorted(set(names))
    if not labels:
        return Model([], bits, idf, np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    y = np.array([labels.index(x) for x in names])
    rows = [_weighted(x, idf) for x in near["features"]]
    held = calibrates(names)
    weights, bias = ftrl([r for r, h in zip(rows, held) if not h], y[~held], len(labels), bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs, batch=batch, seed=seed)
    model = Model(labels, bits, idf, weights, bias)
    if held.any():
        model.temperature = temperature(np.stack([v @ weights[c] + bias for (c, v), h in zip(rows, held) if h]), y[held])
    return model


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` and the predicted language and its probability, row by row.

    The model (``2**bits`` rows, a fixed size) goes to the executors once, as a
    broadcast variable.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)
    kept = [i for i, c in enumerate(df.columns) if c not in (lang_col, score_col)]
    schema = StructType([df.schema[i] for i in kept]).add(lang_col, "string").add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(b.schema.names[i] for i in kept), lang_col, score_col])
        trim()

    return mapped(df, run, schema)
