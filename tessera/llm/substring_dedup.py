"""Substring dedup by seed and extend.

Seeds. A window is ``window`` consecutive words. From the word ``seed``-grams
that begin in a window, the one with the smallest hash is its anchor
(winnowing): the choice depends on the window's words alone, so equal windows
have equal anchors wherever they stand. About one in four positions is an
anchor. Only anchors that stand in two documents can carry a repeat.

Extension. The windows of one anchor form a *run* of consecutive starts; the
words of the run are the anchor extended both ways as far as the windows with
this anchor go. Documents are joined on anchors through a *context*: the hash
of all words of a run. Documents of one context agree over the whole run, so
the smallest doc_id of the context settles all of them at once, however many
copies there are, and no pair of documents is ever built. Where several
contexts share an anchor, the match ends inside the run: there one document
for each context stands for the others, and its windows are compared singly.
Runs and windows that adjoin are merged, which gives the maximal repeats.

Equality of contexts and windows is that of two independent 64-bit hashes of
their word sequences; an anchor's hash only brings candidates together.

Data flow: two narrow shuffles over anchors (one with map-side combine to find
those that are shared, one semi-join to keep them), then work that grows with
the repeated text only. Hot passages are joined by sort-merge joins, which AQE
splits where one anchor holds a large share of the rows.

Defined results: null text has no words; empty texts have none; a row with a
null doc_id neither is a source nor loses words; rows that repeat a doc_id are
judged each by its own text and never against each other; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, map_texts
from .textkernel import PLAIN, WORD_BASE, Block, U, as_bytes, blocks, covered, mix, per_doc, range_hash

WINDOW = 13
SEED = 7
OTHER_BASE = 0xC2B2AE3D27D4EB4F | 1


def _runs(block: Block, window: int, seed: int):
    """Anchors of a block: hash, context's two hashes, document, first window, number of windows."""
    grams, _ = block.ngrams(seed)
    n = len(block) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none.view(U), none, none, none
    choices = window - seed + 1
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, choices):
        other = grams[j : j + n]
        less = other < least
        least[less] = other[less]
        at[less] = j
    at += np.arange(n)
    valid = block.doc[:n] == block.doc[window - 1 : window - 1 + n]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    start = np.flatnonzero(begins)
    # a run ends where the next one begins or the document's windows end
    last = valid.copy()
    last[:-1] &= ~valid[1:] | begins[1:]
    count = np.flatnonzero(last) - start + 1
    shape = (count * 64 + at[start] - start).astype(U)
    bodies = (range_hash(w, start, start + count + window - 1, base) for w, base in ((block.words, WORD_BASE), (_other(block.words), OTHER_BASE)))
    context, check = (mix(mix(body) + shape) for body in bodies)
    return least[start], context, check, block.doc[start], start, count


def _other(words: np.ndarray) -> np.ndarray:
    """Another number for each word, so that sequences get a second hash which is independent of the first."""
    return mix(words ^ U(0x8A5CD789635D2DFF))


def _tags(block: Block) -> np.ndarray:
    """One number for each text, to tell apart rows that repeat a doc_id."""
    import zlib

    return np.fromiter((zlib.crc32(t) for t in block.texts), np.int64, len(block.texts))


def _rows(batches, lut) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    """(doc_ids, valid, block) of the rows with a doc_id."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), as_bytes(batch.column("text"))
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [t for t, k in zip(texts, known) if k]
        ids = ids[known]
        for lo, hi, block in blocks(texts, lut):
            yield ids[lo:hi], known, block


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SEEN = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])
_RUN = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("e", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
_WINDOW = pa.schema([("w", pa.int64()), ("x", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("s", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _seen(window: int, seed: int):
    def work(batches):
        for ids, _, block in _rows(batches, PLAIN):
            h, _, _, doc, _, _ = _runs(block, window, seed)
            yield _batch(_SEEN, h.view(np.int64), ids[doc])

    return work


def _run_rows(window: int, seed: int):
    def work(batches):
        for ids, _, block in _rows(batches, PLAIN):
            h, c, e, doc, s, n = _runs(block, window, seed)
            yield _batch(_RUN, h.view(np.int64), c.view(np.int64), e.view(np.int64), ids[doc], _tags(block)[doc], s - block.first[doc], n)

    return work


def _window_rows(window: int):
    """Hash of each window of the runs that a document has listed in ``runs``."""

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            tags = batch.column("tag").to_numpy()
            texts, runs = as_bytes(batch.column("text")), batch.column("runs")
            for lo, hi, block in blocks(texts, PLAIN):
                part = runs.slice(lo, hi - lo)
                packed = part.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                first, count = packed >> 8, packed & 255
                each = np.repeat(np.arange(len(packed)), count)
                s = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                grams, _ = block.ngrams(window)
                at = s + block.first[doc[each]]
                check = mix(range_hash(_other(block.words), at, at + window, OTHER_BASE))
                yield _batch(_WINDOW, grams[at].view(np.int64), check.view(np.int64), ids[lo + doc[each]], tags[lo + doc[each]], s)

    return work


def _apply(with_text: bool):
    """Words that remain, given the repeats of each document as packed start << 8 | length."""

    def work(batches):
        for batch in batches:
            texts, spans = as_bytes(batch.column("text")), batch.column("spans")
            for lo, hi, block in blocks(texts, PLAIN):
                part = spans.slice(lo, hi - lo)
                packed = part.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                gone = covered(len(block), (packed >> 8) + block.first[doc], packed & 255)
                shas, kept = [], []
                for d in range(hi - lo):
                    text = _join(block, d, gone)
                    shas.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode("utf-8", "replace") if with_text else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(block.counts, pa.int64()), pa.array(per_doc(block, gone), pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], schema=_KEPT)

    return work


def _join(block: Block, d: int, gone: np.ndarray) -> bytes:
    """The words of a document that are not gone, joined by one space."""
    a, z = block.first[d], block.first[d + 1]
    if a == z:
        return b""
    keep = ~gone[a:z]
    lo = block.offset[d]
    inside = block.inside[lo : lo + block.lengths[d]].copy()
    step = np.zeros(len(inside) + 1, np.int8)
    start, end = block.start[a:z] - lo, block.end[a:z] - lo
    np.add.at(step, start[keep], 1)
    np.add.at(step, end[keep], -1)
    inside = np.cumsum(step[:-1]).astype(bool)
    # each kept word with the byte behind it, which becomes the space
    out_end = np.minimum(end[keep], len(inside) - 1)
    text = block.raw[lo : lo + block.lengths[d]].copy()
    text[out_end[end[keep] < len(inside)]] = 0x20
    inside[out_end] = True
    out = text[inside].tobytes()
    return out[:-1] if len(start[keep]) and end[keep][-1] < len(text) else out


_LONG2 = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeats(spark: SparkSession, docs: DataFrame, work: Workspace, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Repeated windows that a smaller doc_id has too, as (doc_id, tag, s, len): word spans, not merged yet.

    tag is the CRC-32 of the text, which tells apart rows that repeat a doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = map_texts(docs, _seen(window, seed), "h long, doc_id long")
    shared = seen.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    shared = work.write(shared, "shared")

    runs = map_texts(docs, _run_rows(window, seed), "h long, c long, e long, doc_id long, tag long, s int, n int")
    runs = work.write(runs.join(shared, "h", "left_semi"), "runs")

    contexts = work.write(runs.groupBy("c", "e").agg(F.min("doc_id").alias("lowest"), F.min("h").alias("h")), "contexts")
    split = contexts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # written first: a join straight behind its aggregation can't be split where one anchor is hot
    split = work.write(split, "split")
    settled = runs.join(contexts.select("c", "e", "lowest"), ["c", "e"])
    whole = settled.where("doc_id > lowest").select("doc_id", "tag", "s", (F.col("n") + window - 1).alias("len"))
    part = settled.where("doc_id = lowest").join(split, "h", "left_semi")
    part = part.groupBy("doc_id", "tag").agg(F.collect_set(F.col("s").cast("long") * 256 + F.col("n")).alias("runs"))
    tagged = docs.withColumn("tag", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    windows = map_texts(tagged.join(part, ["doc_id", "tag"]), _window_rows(window), "w long, x long, doc_id long, tag long, s int")
    windows = work.write(windows, "windows")
    lowest = windows.groupBy("w", "x").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest")
    lowest = work.write(lowest.select("w", "x", "lowest"), "lowest")
    single = windows.join(lowest, ["w", "x"]).where("doc_id > lowest").select("doc_id", "tag", "s", F.lit(window).alias("len"))
    return work.write(whole.unionByName(single), "repeats")


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """Each document without the words of windows that a document with a smaller doc_id has too.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text:
    the remaining words joined by one space. Windows are judged on the input.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring-dedup")
    found = repeats(spark, docs, work, window, seed)
    work.drop("shared", "runs", "contexts", "split", "windows", "lowest")
    spans = found.groupBy("doc_id", "tag").agg(F.collect_list(F.col("s").cast("long") * 256 + F.col("len")).alias("spans"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tagged = docs.withColumn("tag", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    none = F.array().cast("array<long>")
    joined = tagged.where("doc_id IS NOT NULL").join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    # rows without a doc_id have no spans and would all meet in one task of the join
    joined = joined.unionByName(docs.where("doc_id IS NULL").withColumn("spans", none))
    out = map_texts(joined, _apply(with_text), _LONG2)
    return out if with_text else out.drop("kept_text")
