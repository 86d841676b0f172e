"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic examples; everything else the model sees is
unlabelled text. With the class prior pi, the risk of a scorer g is

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

with the logistic loss l: unlabelled text counts as negative, corrected for the
share of positives in it, and where the corrected term would go below zero -
which only overfitting does - the step goes back up instead.

Features are hashed words (ASCII letters folded) and their beginnings, so that
inflected and compounded forms meet; a feature's value is its occurrences in a
hundred words, up to ``MOST``, so that a chance word in a long text weighs
little. Those go into the model that are in clearly more positives than
unlabelled texts; near copies in the samples count once.

The model is fitted on the driver from bounded samples (``POSITIVE_ROWS``,
``UNLABELLED_ROWS``), of which executors count the features and only the chosen
ones are collected; the prior is that of all training labels. Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels
are never read for training. All documents are scored in one pass over Arrow
batches without a shuffle.

Defined results: null or empty texts have no features and score by the bias
alone; rows with a null doc_id are scored and not held out; repeated rows are
scored each; without a positive label every score is 0; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_texts
from .linear import Matrix, adam, bounded_sample, least_hashed, sigmoid
from .textkernel import ALNUM_FOLDED, BASE, Block, U, as_bytes, blocks, mix, powers

POSITIVE_ROWS = 3000
UNLABELLED_ROWS = 6000
FOLDS = 5
THRESHOLD = 0.5
BITS = 18
#: Bytes of the beginnings that count as features, besides the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: A feature's excess among positives: ratio of rates, and log-likelihood ratio.
LEAST_LIFT, LEAST_EVIDENCE = 3.0, 24.0
#: Documents that a feature must be in among the positives.
LEAST_SUPPORT = 3
#: Occurrences in a hundred words beyond which a feature's value stays.
MOST = 2.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def word_slots(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, slots) for whole words and for each length of beginning."""
    shift = U(64 - BITS)
    total = block.byte_sums()
    _, down = powers(BASE, len(block.buf) + 1)
    out = [(np.arange(len(block)), (block.words >> shift).astype(np.int64))]
    for n in BEGINNINGS:
        long = np.flatnonzero(block.end - block.start >= n)
        at = block.start[long]
        out.append((long, (mix((total[at + n] - total[at]) * down[at] + U(n)) >> shift).astype(np.int64)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, block: Block) -> np.ndarray:
        docs, slots = [], []
        for word, slot in word_slots(block):
            some = np.flatnonzero(self.weights[slot] != 0)
            docs.append(block.doc[word[some]])
            slots.append(slot[some])
        pair, n = np.unique(np.concatenate(docs) << BITS | np.concatenate(slots), return_counts=True)
        doc = pair >> BITS
        value = np.minimum(100 * n / block.counts[doc], MOST)
        return sigmoid(self.bias + np.bincount(doc, self.weights[pair & (1 << BITS) - 1] * value, len(block.texts)))


def _present(batches):
    """Slots of each sampled document and their values, as bytes, and a mark that near copies mostly share."""
    for batch in batches:
        for lo, hi, block in blocks(as_bytes(batch.column("text")), ALNUM_FOLDED):
            found = word_slots(block)
            pair, n = np.unique(np.concatenate([block.doc[w] << BITS | s for w, s in found]), return_counts=True)
            value = np.minimum(100 * n / block.counts[pair >> BITS], MOST).astype(np.float32)
            at = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
            slot = (pair & (1 << BITS) - 1).astype(np.int32)
            bounds = list(zip(at[:-1], at[1:]))
            marks = np.array([_mark(slot[a:z]) for a, z in bounds], U)
            ids, kind = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "positive"))
            yield pa.RecordBatch.from_arrays([ids, kind, pa.array(marks.view(np.int64)), pa.array([slot[a:z].tobytes() for a, z in bounds], pa.binary()), pa.array([value[a:z].tobytes() for a, z in bounds], pa.binary())], names=["doc_id", "positive", "mark", "slots", "shares"])


def _mark(slot: np.ndarray) -> np.uint64:
    """One number from the least of eight hashes each of a document's slots."""
    out = np.zeros(1, U)
    for salt in range(1, 9):
        out = mix(out + (mix(slot.astype(U) ^ U(salt)).min() if len(slot) else U(0)))
    return out[0]


def _support(batches):
    """(slot, positives, unlabelled): in how many documents of a batch each slot is."""
    for batch in batches:
        kind = np.asarray(batch.column("positive"))
        many = [np.frombuffer(v, np.int32) for v in batch.column("slots").to_pylist()]
        counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *[m for m, k in zip(many, kind) if k == side]]), minlength=1 << BITS) for side in (True, False)]
        some = np.flatnonzero(counts[0] + counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["slot", "p", "u"])


def _narrowed(chosen: np.ndarray):
    """Rows with the chosen slots only, numbered by their place among the chosen."""
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen), dtype=np.int32)

    def work(batches):
        for batch in batches:
            slots, shares = [], []
            for s, v in zip(batch.column("slots").to_pylist(), batch.column("shares").to_pylist()):
                place = index[np.frombuffer(s, np.int32)]
                slots.append(place[place >= 0].tobytes())
                shares.append(np.frombuffer(v, np.float32)[place >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(slots, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "positive", "slots", "shares"])

    return work


def choose(slot: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The slots that stand out among the positives."""
    keep = (in_p >= LEAST_SUPPORT) & ((in_p / n_p) >= LEAST_LIFT * (in_u + 0.5) / (n_u + 1)) & (_evidence(in_p, n_p, in_u, n_u) >= LEAST_EVIDENCE)
    return np.sort(slot[keep])


def fit(p: Matrix, u: Matrix, chosen: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """The non-negative risk minimiser over the chosen slots."""
    n_p, n_u = len(p), len(u)

    def gradient(w: np.ndarray) -> np.ndarray:
        g_p, g_u = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
        loss = lambda x: np.logaddexp(0, -x)
        negative = loss(-g_u).mean() - prior * loss(-g_p).mean()
        as_positive = -prior * sigmoid(-g_p) / n_p
        d_u, d_p = sigmoid(g_u) / n_u, -prior * sigmoid(g_p) / n_p
        if negative >= 0:
            rows_p, rows_u = as_positive + d_p, d_u
        else:
            rows_p, rows_u = -d_p, -d_u
        return np.append(p.back(rows_p) + u.back(rows_u) + decay * prior * w[:-1], rows_p.sum() + rows_u.sum())

    w = adam(np.append(np.zeros(len(chosen)), np.log(prior / (1 - prior))), gradient, steps, rate)
    weights = np.zeros(1 << BITS)
    weights[chosen] = w[:-1]
    return Model(weights, float(w[-1]))


def _evidence(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """Log-likelihood ratio of two rates against one."""
    both = (a + b) / (n_a + n_b)

    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, both) - part(b, n_b, both))


def train(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = labels.where(~held_out(F.col("doc_id"))).dropna(subset=["doc_id", "toxic"])
    prior = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return None
    picked = bounded_sample(own.where("toxic = 1"), "toxic", positive_rows).select("doc_id", F.lit(True).alias("positive"))
    rest = least_hashed(docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id"), unlabelled_rows).select("doc_id", F.lit(False).alias("positive"))
    sample = docs.join(F.broadcast(picked.unionByName(rest).distinct()), "doc_id").select("doc_id", "positive", "text")
    work = Workspace(docs.sparkSession, "toxicity")
    rows = work.write(map_texts(sample, _present, "doc_id long, positive boolean, mark long, slots binary, shares binary"), "sample")
    alike = rows.groupBy("positive", "mark").agg(F.min(F.struct("doc_id", "slots", "shares")).alias("r")).select("positive", "mark", "r.*")
    named = alike.groupBy("positive", "doc_id").agg(F.min(F.struct("mark", "slots", "shares")).alias("r")).select("positive", "doc_id", "r.slots", "r.shares")
    rows = work.write(named, "chosen")  # one of near copies, and one of a repeated doc_id
    sizes = {r.positive: r.n for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    work.drop("sample")
    if len(sizes) < 2:
        work.drop("chosen")
        return None
    support = map_texts(rows.select("positive", "slots"), _support, "slot long, p long, u long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    found = support.where(F.col("p") >= LEAST_SUPPORT).toArrow()
    chosen = choose(*[found[c].to_numpy() for c in ("slot", "p", "u")], sizes[True], sizes[False])
    got = map_texts(rows.select("doc_id", "positive", "slots", "shares"), _narrowed(chosen), "doc_id long, positive boolean, slots binary, shares binary").toArrow()
    work.drop("chosen")
    got = got.sort_by([("doc_id", "ascending"), ("slots", "ascending"), ("shares", "ascending")])
    kind, pairs = np.asarray(got["positive"]), list(zip(got["slots"].to_pylist(), got["shares"].to_pylist()))
    sides = [Matrix.of([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for (s, v), k in zip(pairs, kind) if k == side], len(chosen)) for side in (True, False)]
    return fit(*sides, chosen, min(prior, 0.95))


OUT = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (higher: toxic likelier) and predicted (score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, positive_rows, unlabelled_rows))

    def work(batches):
        trained = model.value
        for batch in batches:
            for lo, hi, block in blocks(as_bytes(batch.column("text")), ALNUM_FOLDED):
                score = np.zeros(hi - lo) if trained is None else trained.score(block)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return map_texts(chosen, work, OUT)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def work(batches):
        trained = model.value
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi, block in blocks(texts, ALNUM_FOLDED):
                score = np.zeros(hi - lo) if trained is None else trained.score(block)
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return map_texts(docs, work, docs.schema)
