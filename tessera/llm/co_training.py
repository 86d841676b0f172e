"""Quality by co-training two views.

The content view is a logistic regression over hashed word and character
n-grams of the text; the page view one over the row's metadata: source,
language, length class and pairs of them. Both start from the labelled rows.
In each round either view labels the unlabelled documents it is surest of, in
the proportion of the labels, and hands them to the *other* view, which is
trained again on what it has. Each view is calibrated on labelled rows that
neither has seen, and their log-odds, less the prior that both contain, are
added up for the final score.

Training runs on the driver over bounded samples (``LABELLED_ROWS``,
``UNLABELLED_ROWS``, and ``SAMPLE_BYTES`` of features); all documents are scored
in one pass over Arrow batches without a shuffle.

Defined results: null or empty texts and null metadata are values like others;
rows with a null doc_id are scored; repeated rows are scored each; with labels
of one kind only, or none, every score is 1; an empty table gives no rows;
columns of the input besides doc_id, text, lang, source and n_chars are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .linear import Matrix, bounded_sample, collect_features, least_hashed, logistic, means, platt, sigmoid
from .textkernel import PLAIN_FOLDED, as_bytes, blocks

LABELLED_ROWS = 2000
UNLABELLED_ROWS = 2000
ROUNDS = 3
#: Documents that a view hands over in a round, as a share of the unlabelled ones, if it is at least so sure.
HANDED = 0.1
SURE = 0.9
THRESHOLD = 0.5
META_BITS = 12

def _meta() -> Column:
    """Source, language and the bits of n_chars, which tell its length class."""
    parts = F.col("source").cast("string"), F.col("lang").cast("string"), F.length(F.bin(F.col("n_chars").cast("long"))).cast("string")
    return F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])


def page_features(meta: str) -> np.ndarray:
    """Slots of source, language, length class and their pairs."""
    source, lang, size = (meta.split("\x1f") + ["", "", ""])[:3]
    names = [f"s={source}", f"l={lang}", f"n={size}", f"sl={source}|{lang}", f"ln={lang}|{size}"]
    return np.unique([zlib.crc32(n.encode()) % (1 << META_BITS) for n in names]).astype(np.int32)


def _pages(metas: list[str]) -> Matrix:
    rows = [page_features(m) for m in metas]
    return Matrix.of([(r, np.ones(len(r), np.float32)) for r in rows], 1 << META_BITS)


@dataclass
class View:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, x: Matrix) -> np.ndarray:
        return self.scale * (x.dot(self.weights) + self.bias) + self.shift

    @classmethod
    def fit(cls, x: Matrix, y: np.ndarray, weight: np.ndarray) -> View:
        w = logistic(x, y, weight, steps=80)
        return cls(w[:-1], float(w[-1]))

    def calibrated(self, x: Matrix, y: np.ndarray) -> View:
        a, b = platt(x.dot(self.weights) + self.bias, y)
        return View(self.weights, self.bias, a, b)


@dataclass
class Model:
    text: View
    page: View
    prior: float

    def combine(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        return sigmoid(text + page - np.log(self.prior / (1 - self.prior)))


def co_train(text: Matrix, page: Matrix, y: np.ndarray, labelled: np.ndarray, rounds: int = ROUNDS) -> tuple[View, View]:
    """The two views after the rounds; y counts where labelled."""
    views = (text, page)
    own = [y.astype(float).copy(), y.astype(float).copy()]
    known = [labelled.copy(), labelled.copy()]
    share = y[labelled].mean()
    fitted: list[View] = []
    for r in range(rounds + 1):
        fitted = []
        for x, target, has in zip(views, own, known):
            rows = np.flatnonzero(has)
            weight = np.where(labelled[rows], 1.0, 0.5)
            fitted.append(View.fit(x.take(rows), target[rows], weight))
        if r == rounds:
            break
        for k in (0, 1):
            other = 1 - k
            free = np.flatnonzero(~labelled & ~known[other])
            if not len(free):
                continue
            p = sigmoid(fitted[k].logit(views[k].take(free)))
            n = HANDED * len(free)
            order = np.argsort(p, kind="stable")
            low = order[: max(1, int(n * (1 - share)))]
            high = order[::-1][: max(1, int(n * share))]
            for rows, value in ((low[p[low] <= 1 - SURE], 0.0), (high[p[high] >= SURE], 1.0)):
                own[other][free[rows]] = value
                known[other][free[rows]] = True
    return fitted[0], fitted[1]


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    docs = docs.withColumn("_meta", _meta())
    given = bounded_sample(labels, "quality", labelled_rows)
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").join(F.broadcast(given), "doc_id", "left_anti")
    free = least_hashed(free, unlabelled_rows).distinct().select("doc_id", F.lit(-1).alias("label"))
    ids, y, x, metas = collect_features(docs, given.unionByName(free), "_meta")
    labelled = y >= 0
    if len(set(y[labelled])) < 2:
        return None
    apart = labelled & np.array([zlib.crc32(b"calibrate:%d" % i) % 5 == 0 for i in ids])
    if len(set(y[apart])) < 2 or len(set(y[labelled & ~apart])) < 2:
        apart = np.zeros(len(y), bool)
    pages = _pages([m or "" for m in metas])
    rows = np.flatnonzero(~apart)
    text, page = co_train(x.take(rows), pages.take(rows), y[rows], labelled[rows])
    held = np.flatnonzero(apart if apart.any() else labelled)
    return Model(text.calibrated(x.take(held), y[held]), page.calibrated(pages.take(held), y[held]), float(np.clip(y[labelled].mean(), 0.01, 0.99)))


OUT = "doc_id long, text_score double, page_score double, score double, kept boolean"


def quality(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Calibrated scores of both views, their combination, and whether it reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, labelled_rows, unlabelled_rows))

    def work(batches):
        trained = model.value
        for batch in batches:
            metas = batch.column("_meta").to_pylist()
            for lo, hi, block in blocks(as_bytes(batch.column("text")), PLAIN_FOLDED):
                if trained is None:
                    one = np.ones(hi - lo)
                    columns = one, one, one
                else:
                    t = trained.text.scale * (means(trained.text.weights, block) + trained.text.bias) + trained.text.shift
                    p = trained.page.logit(_pages([m or "" for m in metas[lo:hi]]))
                    columns = sigmoid(t), sigmoid(p), trained.combine(t, p)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, columns), pa.array(columns[2] >= threshold)], names=["doc_id", "text_score", "page_score", "score", "kept"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _meta().alias("_meta")), work, OUT)
