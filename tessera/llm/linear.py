"""Hashed n-gram features and sparse linear models in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_texts
from .textkernel import PLAIN_FOLDED, Block, U, as_bytes, blocks, mix

#: Bits of a slot; words take the first half of the slots, characters the second.
BITS = 15
HALF = 1 << (BITS - 1)


def least_hashed(rows: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n rows whose doc_id has the smallest hash.

    Of a large table only rows below a hash that leaves some n eight times over
    go into the sort; should they be too few, all do. The result is the same.
    """
    h, total = F.xxhash64("doc_id"), rows.count()
    if total > 50 * n:
        near = rows.where(h < F.lit(-(2**63) + 2**64 * 8 * n // total))
        rows = near if near.count() >= n else rows
    return rows.orderBy(h, "doc_id", *ties).limit(n)


def bounded_sample(labels: DataFrame, label: str, rows: int, train: Column | None = None) -> DataFrame:
    """At most ``rows`` labelled doc_ids, those of the smallest hash, as (doc_id, label). Rows with nulls are none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known if train is None else known.where(train)
    return least_hashed(known, rows, "label")


def slots(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words and word pairs, and of all byte trigrams, each with the bounds of the documents."""
    shift = U(64 - BITS + 1)
    one = (block.words >> shift).astype(np.int32)
    grams, whole = block.ngrams(2)
    doc = np.concatenate([block.doc, block.doc[: len(grams)][whole]])
    word = np.concatenate([one, (grams[whole] >> shift).astype(np.int32)])
    order = np.argsort(doc, kind="stable")
    word, doc = word[order], doc[order]
    word_at = np.searchsorted(doc, np.arange(len(block.texts) + 1))
    raw = block.raw.astype(np.uint32)
    tri = ((raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS + 1)
    begin = block.offset
    end = np.maximum(begin + block.lengths - 2, begin)
    return word, word_at, tri.astype(np.int32), np.stack([begin, np.minimum(end, len(tri))])


def means(weights: np.ndarray, block: Block) -> np.ndarray:
    """Sum of weight times relative frequency, words and characters each by their own number, for each document."""
    word, word_at, tri, bounds = slots(block)

    def mean(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        n = end - begin
        return (total[end] - total[begin]) / np.maximum(n, 1)

    return mean(weights[:HALF][word], word_at[:-1], word_at[1:]) + mean(weights[HALF:][tri], np.minimum(bounds[0], bounds[1]), bounds[1])


def sparse(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, relative frequencies) of each document."""
    word, word_at, tri, bounds = slots(block)
    out = []
    for d in range(len(block.texts)):
        a, na = np.unique(word[word_at[d] : word_at[d + 1]], return_counts=True)
        b, nb = np.unique(tri[bounds[0][d] : bounds[1][d]], return_counts=True)
        out.append((np.concatenate([a, b + HALF]).astype(np.int32), np.concatenate([na / max(na.sum(), 1), nb / max(nb.sum(), 1)]).astype(np.float32)))
    return out


@dataclass
class Matrix:
    """Sparse rows; each has at most 2**BITS entries, whatever its text's length."""

    at: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    width: int = 1 << BITS

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int = 1 << BITS) -> Matrix:
        at = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])]).astype(np.int64)
        empty = np.zeros(0, np.int32), np.zeros(0, np.float32)
        return cls(at, np.concatenate([empty[0], *[s for s, _ in rows]]), np.concatenate([empty[1], *[v for _, v in rows]]), width)

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Matrix:
        n = self.at[rows + 1] - self.at[rows]
        at = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(self.at[rows] - at[:-1], n) + np.arange(at[-1])
        return Matrix(at, self.slot[index], self.value[index], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * w[self.slot], dtype=np.float64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def back(self, rows: np.ndarray) -> np.ndarray:
        """Sum over rows of a number for the row times the row."""
        return np.bincount(self.slot, self.value * np.repeat(rows, np.diff(self.at)), self.width)

    def mean(self) -> np.ndarray:
        return self.back(np.full(len(self), 1 / max(len(self), 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(w: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: Matrix, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias. Features are scaled by their mean's root while training."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    scale = 1 / np.sqrt(x.mean() + 1e-4)
    scaled = Matrix(x.at, x.slot, (x.value * scale[x.slot]).astype(np.float32), x.width)

    def gradient(w: np.ndarray) -> np.ndarray:
        error = weight * (sigmoid(scaled.dot(w[:-1]) + w[-1]) - y)
        return np.append(scaled.back(error) + decay * w[:-1], error.sum())

    w = adam(np.zeros(x.width + 1), gradient, steps, rate)
    return np.append(w[:-1] * scale, w[-1])


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is calibrated; targets are smoothed as Platt has it."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = score.mean(), score.std() + 1e-9
    z = (score - mean) / spread

    def gradient(w: np.ndarray) -> np.ndarray:
        error = (sigmoid(w[0] * z + w[1]) - target) / len(z)
        return np.array([(error * z).sum(), error.sum()])

    a, b = adam(np.array([1.0, 0.0]), gradient, 800, 0.05)
    a = max(a, 1e-3)  # a higher score never means less
    return a / spread, b - a * mean / spread


#: Bytes of features that the driver takes at most; documents beyond, the last by hash of their id, are not trained on.
SAMPLE_BYTES = 200 << 20


def within(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Ids in the order of their mixed numbers, as many as their sizes fit the limit; the least of each label at any size."""
    order = np.argsort(mix(ids.astype(np.int64).view(np.uint64)), kind="stable")
    fits = np.cumsum(sizes[order]) <= limit
    fits[np.unique(labels[order], return_index=True)[1]] = True
    return np.sort(ids[order][fits])


def collect_features(docs: DataFrame, sample: DataFrame, extra: str | None = None, limit: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, Matrix, list]:
    """Features of the sampled documents on the driver, by doc_id: ids, labels, matrix, and an extra column.

    The sample is bounded by its parameter, one row for a doc_id (the least of
    its texts), and by the bytes of its features, which are written before any
    of them is collected.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(extra) if extra else F.lit(None)).cast("string").alias("extra"))
    picked = picked.join(F.broadcast(sample), "doc_id")

    def work(batches):
        for batch in batches:
            for lo, hi, block in blocks(as_bytes(batch.column("text")), PLAIN_FOLDED):
                rows = sparse(block)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), batch.column("extra").slice(lo, hi - lo), pa.array([s.tobytes() for s, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["doc_id", "label", "extra", "slots", "shares"])

    space = Workspace(docs.sparkSession, "features")
    made = space.write(map_texts(picked, work, "doc_id long, label int, extra string, slots binary, shares binary"), "sample")
    columns = ("slots", "shares", "extra")
    one = made.groupBy("doc_id", "label").agg(F.min(F.struct(*columns)).alias("r")).select("doc_id", "label", *[F.col("r")[c].alias(c) for c in columns])
    sizes = one.select("doc_id", "label", (F.length("slots") + F.length("shares")).alias("n")).toArrow()
    if sizes["n"].to_numpy().sum() > limit:
        kept = within(*[sizes[c].to_numpy() for c in ("doc_id", "label", "n")], limit)
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in kept], "doc_id long")), "doc_id", "left_semi")
    got = one.toArrow()
    space.drop("sample")
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("slots", "ascending")])
    ids, labels = got["doc_id"].to_numpy(), got["label"].to_numpy()
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(got["slots"].to_pylist(), got["shares"].to_pylist())]
    return ids, labels, Matrix.of(rows), got["extra"].to_pylist()
