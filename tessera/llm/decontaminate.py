"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``window`` consecutive words of each benchmark
item; an item with fewer words, but not none, is one window of its own length.
For each length L the search uses blocks of B = 2 words (1 where L is 1):

* SHIFT: hash of a block -> how far its rightmost place in any test string is
  from the string's end; L - B + 1, "in none", for all others. The text is
  looked at in steps of L - B + 1 words, the longest jump that can't pass over
  a whole string: a step that lands on a block of no string skips all window
  ends up to the next step, which is nearly all of the text.
* HASH: where a block does occur, the window ends that it allows are tried:
  their last block must have SHIFT 0, and the bucket of last and first block
  (suffix and prefix hash) names the test strings to try.
* Comparison: those are compared with the text, first by word hashes and what
  agrees then byte by byte, so that no two words pass for one another.

All steps run for a whole block of documents at once in numpy. The strings are
broadcast only up to ``MAX_ITEM_BYTES`` of benchmark text; beyond it the
benchmark is searched in slabs of that size and the hits are put together by
document. Documents are read once, with no shuffle, on the main path.

Defined results: null or empty texts have no words and are not contaminated;
items without an id, without words or null are no test strings; repeated items
count once; repeated rows of documents are judged each for itself; an empty
benchmark contaminates nothing; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .textkernel import ALNUM_FOLDED, WORD_BASE, Block, U, as_bytes, blocks, covered, mix, per_doc

WINDOW = 10
#: Benchmark text that is searched for at once, in bytes.
MAX_ITEM_BYTES = 8 << 20
#: Slots of a shift table for each block that the strings hold, so that most slots stay empty at any size.
_SLOTS = 8

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
_ARROW_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))])


class Searcher:
    """Tables of all test strings of one length."""

    def __init__(self, length: int, source: Block, start: np.ndarray, item: np.ndarray):
        """source: the items' words; start: where each string begins in it; item: the item it is from."""
        self.length, self.size = length, min(2, length)
        self.step = length - self.size + 1
        words = source.words
        rows = words[start[:, None] + np.arange(length)]
        order = np.lexsort(rows.T[::-1])
        rows, start, item = rows[order], start[order], item[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        # one string may be from several items
        pattern = np.cumsum(fresh) - 1
        self.strings = rows[fresh]
        self.text = [source.joined(a, a + length) for a in start[fresh].tolist()]
        self.bits = int(np.clip(np.ceil(np.log2(_SLOTS * self.step * max(len(self.strings), 1))), 16, 26))
        pairs = np.unique(np.stack([pattern, item]), axis=1)
        self.items = pairs[1]
        self.items_at = np.searchsorted(pairs[0], np.arange(len(self.strings) + 1))
        self.shift = np.full(1 << self.bits, self.step, np.int16)
        for j in range(self.step):  # from the far end, so that the least shift stays
            at = self._slot(self._block(self.strings, j))
            self.shift[at] = np.minimum(self.shift[at], self.step - 1 - j)
        bucket = self._bucket(self.strings)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.strings_of = bucket[order], order

    def _block(self, rows: np.ndarray, j: int) -> np.ndarray:
        h = rows[:, j]
        return mix(h * U(WORD_BASE) + rows[:, j + 1]) if self.size == 2 else mix(h)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def _bucket(self, rows: np.ndarray) -> np.ndarray:
        return mix(self._block(rows, self.step - 1) + self._block(rows, 0) * U(WORD_BASE))

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(first word, string) of each occurrence in a document."""
        w, b = block.words, self.size
        # block ends looked at; a window has self.step block ends, so one of them is here
        q = np.arange(b - 1, len(w), self.step)
        if not len(q):
            return q, q
        shift = self.shift[self._slot(self._ends(w, q))].astype(np.int64)
        live = shift < self.step
        q, shift = q[live], shift[live]
        count = self.step - shift
        end = np.repeat(q + shift, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        end = end[(end < len(w)) & (end >= self.length - 1)]
        end = end[self.shift[self._slot(self._ends(w, end))] == 0]
        start = end - self.length + 1
        start = start[block.doc[start] == block.doc[end]]
        rows = w[start[:, None] + np.arange(self.length)]
        key = self._bucket(rows)
        lo, hi = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        many = hi - lo
        each = np.repeat(np.arange(len(start)), many)
        string = self.strings_of[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        same = (rows[each] == self.strings[string]).all(axis=1)
        start, string = start[each[same]], string[same]
        same = np.fromiter((block.joined(a, a + self.length) == self.text[k] for a, k in zip(start.tolist(), string.tolist())), bool, len(start))
        return start[same], string[same]

    def _ends(self, w: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(w[end - 1] * U(WORD_BASE) + w[end]) if self.size == 2 else mix(w[end])


def compile_items(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> tuple[list[str], list[Searcher]]:
    """Item ids as strings, and a searcher for each length of test string."""
    known = [(str(i), (t or "").encode()) for i, t in items if i is not None]
    block = Block([t for _, t in known], ALNUM_FOLDED)
    names = sorted({i for i, _ in known})
    number = {i: k for k, i in enumerate(names)}
    by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for d, (i, _) in enumerate(known):
        n = int(block.counts[d])
        if n:
            length = min(n, window)
            start = block.first[d] + np.arange(n - length + 1)
            by.setdefault(length, []).append((start, np.full(len(start), number[i])))
    return names, [Searcher(n, block, np.concatenate([s for s, _ in v]), np.concatenate([k for _, k in v])) for n, v in sorted(by.items())]


def scan(block: Block, searchers: list[Searcher]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit words as a mask, document of each found item, number of that item), pairs once."""
    hit = np.zeros(len(block), bool)
    docs, items = [], []
    for s in searchers:
        start, string = s.find(block)
        if len(start):
            hit |= covered(len(block), start, s.length)
            many = s.items_at[string + 1] - s.items_at[string]
            at = np.repeat(s.items_at[string], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            docs.append(np.repeat(block.doc[start], many))
            items.append(s.items[at])
    if not docs:
        none = np.zeros(0, np.int64)
        return hit, none, none
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
    return hit, pairs[0], pairs[1]


def _report(ids: pa.Array, words: np.ndarray, hits: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(hits > 0, pa.bool_()), pa.array(items, pa.list_(pa.string()))], schema=_ARROW_OUT)


def _named(n: int, docs: np.ndarray, items: np.ndarray, names: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(n)]
    for d, i in zip(docs.tolist(), items.tolist()):  # names are sorted, so each list is
        out[d].append(names[i])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """For each document: its words, those in an occurrence of a test string, and the items hit.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= max_item_bytes:
        tables = spark.sparkContext.broadcast(compile_items(items.toLocalIterator(), window))

        def work(batches):
            names, searchers = tables.value
            for batch in batches:
                for lo, hi, block in blocks(as_bytes(batch.column("text")), ALNUM_FOLDED):
                    hit, doc, item = scan(block, searchers)
                    yield _report(batch.column("doc_id").slice(lo, hi - lo), block.counts, per_doc(block, hit), _named(hi - lo, doc, item, names))

        return map_texts(docs, work, OUT)
    return _by_slabs(docs, items, window, int(size // max_item_bytes) + 1)


def _by_slabs(docs: DataFrame, items: DataFrame, window: int, slabs: int) -> DataFrame:
    """The same where the benchmark is too large to send to every executor at once."""
    spark = docs.sparkSession
    docs = docs.withColumn("tag", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    found = None
    for k in range(slabs):
        slab = items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(slabs)) == k)
        tables = spark.sparkContext.broadcast(compile_items(slab.toLocalIterator(), window))

        def work(batches, tables=tables):
            names, searchers = tables.value
            for batch in batches:
                for lo, hi, block in blocks(as_bytes(batch.column("text")), ALNUM_FOLDED):
                    hit, doc, item = scan(block, searchers)
                    listed = _named(hi - lo, doc, item, names)
                    at = [np.flatnonzero(hit[a:z]) for a, z in zip(block.first[:-1], block.first[1:])]
                    some = np.flatnonzero([len(x) > 0 for x in listed])
                    take = pa.array(some + lo)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array([at[i] for i in some], pa.list_(pa.int64())), pa.array([listed[i] for i in some], pa.list_(pa.string()))], names=["doc_id", "tag", "at", "found"])

        part = map_texts(docs, work, "doc_id long, tag long, at array<long>, found array<string>")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "tag").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))

    def count(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi, block in blocks(texts, ALNUM_FOLDED):
                hits = np.array([len(x or ()) for x in batch.column("at").slice(lo, hi - lo).to_pylist()])
                yield _report(batch.column("doc_id").slice(lo, hi - lo), block.counts, hits, [x or [] for x in batch.column("found").slice(lo, hi - lo).to_pylist()])

    both = docs.alias("d").join(merged.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.tag = m.tag"), "left")
    return map_texts(both.select("d.doc_id", "d.text", "m.at", "m.found"), count, OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test string."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slabs = int(size // max_item_bytes) + 1
    for k in range(slabs):  # one unless the benchmark is large
        slab = items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(slabs)) == k)
        tables = docs.sparkSession.sparkContext.broadcast(compile_items(slab.toLocalIterator(), window))

        def work(batches, tables=tables):
            _, searchers = tables.value
            for batch in batches:
                for lo, hi, block in blocks(as_bytes(batch.column("text")), ALNUM_FOLDED):
                    hit, _, _ = scan(block, searchers)
                    yield batch.slice(lo, hi - lo).filter(pa.array(per_doc(block, hit) == 0))

        docs = map_texts(docs, work, docs.schema)
    return docs
