"""Quality rules: counted rules and a calibrated n-gram classifier.

Base rules are counts over whole texts. The verdict on what they pass is a
logistic regression over hashed word and character n-grams (words, word pairs,
byte trigrams, by relative frequency), trained on labelled rows, calibrated on
a fifth of them that the weights have not seen, and held against a fixed
threshold. It is trained on the driver from a bounded sample (``TRAIN_ROWS``
labelled rows and ``SAMPLE_BYTES`` of features); all documents are scored in Arrow
batches in one pass without a shuffle.

Defined results: null or empty texts have no words and fail the base rules;
rows with a null doc_id are scored like others; repeated rows are scored each;
with no labels, or of one kind only, the classifier passes everything; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .linear import bounded_sample, collect_features, logistic, means, platt, sigmoid
from .textkernel import PLAIN, PLAIN_FOLDED, Block, as_bytes, blocks, covered, mix, per_doc, powers, BASE, U

TRAIN_ROWS = 3000
THRESHOLD = 0.5
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_SHARE = 30
# The symbols that are counted.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, block: Block) -> np.ndarray:
        return sigmoid(self.scale * (means(self.weights, block) + self.bias) + self.shift)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A classifier of quality = 1; None where there is nothing to tell apart."""
    ids, y, x, _ = collect_features(docs, bounded_sample(labels, "quality", rows))
    if len(y) == 0 or y.min() == y.max():
        return None
    apart = np.array([zlib.crc32(b"calibrate:%d" % i) % 5 == 0 for i in ids])
    if apart.all() or len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    own = np.flatnonzero(~apart)
    w = logistic(x.take(own), y[own])
    held = np.flatnonzero(apart) if apart.any() else own
    a, b = platt(x.take(held).dot(w[:-1]) + w[-1], y[held])
    return Model(w[:-1].astype(np.float64), float(w[-1]), a, b)


def counts(block: Block, raw_words: bool = True) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    n = len(block.texts)
    chars = np.concatenate([[0], np.cumsum((block.raw & 0xC0) != 0x80)])
    by_word = np.concatenate([[0], np.cumsum(chars[block.end] - chars[block.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.raw])])
    begin, end = block.offset, block.offset + block.lengths
    grams, whole = block.ngrams(REPEAT_WINDOW)
    at = np.flatnonzero(whole)
    again = np.zeros(len(at), bool)
    order = np.lexsort((grams[at], block.doc[at]))
    doc, gram = block.doc[at][order], grams[at][order]
    same = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1])
    again[order[1:]] |= same
    again[order[:-1]] |= same
    repeat = per_doc(block, covered(len(block), at[again], REPEAT_WINDOW))
    return {
        "n_words": block.counts,
        "word_chars": by_word[block.first[1:]] - by_word[block.first[:-1]],
        "n_symbols": symbols[end] - symbols[begin],
        "n_dup_lines": _duplicate_lines(block, n),
        "n_repeat_words": repeat,
    }


def _duplicate_lines(block: Block, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    stop = np.flatnonzero(block.raw == 0x0A)
    start = np.concatenate([[0], stop[:-1] + 1])
    words = np.concatenate([[0], np.cumsum(np.bincount(block.start, minlength=len(block.raw) + 1))])
    some = words[stop] > words[start]
    start, stop = start[some], stop[some]
    total = block.byte_sums()
    _, down = powers(BASE, len(block.buf) + 1)
    # bytes of white space count as zero in a block, so where they stand has to count too
    space = np.zeros(len(block.raw) + 1, U)
    up, _ = powers(BASE, len(block.buf) + 1)
    np.cumsum(mix(block.raw.astype(U) + U(7)) * up[: len(block.raw)], out=space[1:])
    line = mix((total[stop] - total[start]) * down[start]) ^ mix((space[stop] - space[start]) * down[start] + (stop - start).astype(U))
    doc = np.searchsorted(block.offset, start, "right") - 1
    order = np.lexsort((line, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (line[order][1:] == line[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=n)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, their verdict, the calibrated probability of quality, and whether a document is kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def work(batches):
        trained = model.value
        for batch in batches:
            for lo, hi, block in blocks(as_bytes(batch.column("text")), PLAIN):
                got = counts(block)
                failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEAT_SHARE * got["n_words"])
                p = np.ones(hi - lo) if trained is None else trained.probability(Block(block.texts, PLAIN_FOLDED))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(v, pa.int64()) for v in got.values()], pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=["doc_id", *got, "base_failed", "kept", "quality"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, OUT)
