"""Phrase collocations: which words stand together more often than their parts would.

Texts are cut at stops and line ends into pieces, pieces into words. Phrases
of 1 to MOST words become rows (lang, phrase, f), added up for some MB of texts
before they leave a task, and are counted by language and phrase. Candidates
are phrases of two words and more that occur often enough. A candidate is cut
after each of its words; the counts of both parts are joined to it, and the
cut of the lowest score counts. Candidates that a one-word extension nearly
always surrounds are anti-joined: a longer candidate that contains a phrase
also has a part, one word longer than the phrase, that contains it and occurs
at least as often, so extensions by one word are enough. The rest is ranked
for each language.

A phrase occurs no more often than any pair of words in it. Words and pairs
are counted first; phrases of three words and more become rows only where all
their pairs may be frequent, by a bitmap of the frequent pairs' hashes. It
errs on the side of frequent, so no candidate is lost, and its size is at most
FILTER_BITS whatever the corpus; a fuller one lets more rows through. A part
of a candidate occurs at least as often as the candidate, so only phrases that
reach the least count are written, and all joins are among these.

Words are dealt with in buffers of FLUSH words that overlap by MOST - 1, so a
text of any length is held in part only. A language with a third of all rows
is no hot key: counts go by phrase, and ranking keeps the first rows of each of
many shares of a language before they meet.

Defined results: null text is empty; null lang is ``und``; empty texts add
nothing; words are compared after lower-casing A-Z alone; repeated rows count
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_texts

#: Words of the longest phrase, least count, rows for each language.
MOST, LEAST, FIRST = 4, 30, 2000
#: Percent of a candidate's count from which an extension takes its place.
SURROUNDED = 80
SCALE = 2_000_000
#: Words that a task holds, bytes of a text that are cut at once, candidates of a share in the ranking.
FLUSH, SLICE, SHARE = 1 << 21, 1 << 22, 50_000
#: Bits of the bitmap of frequent pairs, at least and at most.
FILTER_BITS = 1 << 20, 1 << 28
UNKNOWN_LANGUAGE = "und"
ROWS = "lang string, phrase string, f long"
_TOKENS = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
_BETWEEN = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_STOPS = frozenset(b".,;:!?\n\x0b\x0c\r")


class _Numbers(dict):
    """Numbers of tokens in order of their first use."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _mixed(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The place of a pair in a bitmap, from its words' hashes."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(20)) % np.uint64(bits)


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class _Buffer:
    """The tokens of one language's texts, counted as phrases when they are many."""

    def __init__(self, lang: str, sizes: range, frequent: np.ndarray | None):
        self.lang, self.sizes, self.frequent = lang, sizes, frequent
        self.numbers, self.parts, self.held = _Numbers(), [], 0

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(text):
            stop = min(at + SLICE, len(text))
            if stop < len(text):
                m = _BETWEEN.search(text, stop)
                stop = m.start() if m else len(text)
            tokens = _TOKENS.findall(text[at:stop].lower())
            self._put(tokens)
            at = stop
            if self.held > FLUSH:
                yield from self.flush(False)
        self._put([b"\n"])

    def _put(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.held += len(tokens)

    def flush(self, whole: bool = True) -> Iterator[pa.RecordBatch]:
        """Rows of all phrases that begin in the buffer; but for the last words, whose phrases may go on, unless it is whole."""
        words, a = list(self.numbers), np.concatenate([np.zeros(0, np.int64), *self.parts])
        over = self.sizes[-1] - 1
        starts = len(a) if whole else max(0, len(a) - over)
        rest = [] if whole else [words[i] for i in a[starts:]]
        self.numbers, self.parts, self.held = _Numbers(), [], 0
        self._put(rest)
        if not starts:
            return
        stop = np.fromiter((w[0] in _STOPS for w in words), bool, len(words))
        spelled = pa.array(words, pa.binary())
        word = ~stop[a]
        rank, fits = a, word
        if 1 in self.sizes:
            yield from self._rows(spelled, a, np.flatnonzero(word[:starts]), 1, rank)
            yield self._batch(pa.nulls(1, pa.string()), np.array([word[:starts].sum()]))
        pairs = None
        for k in range(2, self.sizes[-1] + 1):
            if len(a) < k:
                return
            fits = fits[: len(a) - k + 1] & word[k - 1 :]
            if pairs is not None:
                fits &= pairs[k - 2 : k - 2 + len(fits)]
            at = np.flatnonzero(fits)
            kinds, of = np.unique(rank[at] * len(words) + a[at + k - 1], return_inverse=True)
            rank = np.full(len(fits), -1, np.int64)
            rank[at] = of
            if k == 2 and self.frequent is not None:
                h = _hashes(words, self.lang)
                place = _mixed(h[kinds // len(words)], h[kinds % len(words)], len(self.frequent) * 8)
                may = (self.frequent[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                pairs = np.zeros(len(fits), bool)
                pairs[at] = may[of]
                fits = pairs
            if k in self.sizes:
                yield from self._rows(spelled, a, at[at < starts], k, rank)

    def _rows(self, spelled: pa.Array, a: np.ndarray, at: np.ndarray, k: int, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, first, n = np.unique(rank[at], return_index=True, return_counts=True)
        for i in range(0, len(first), 100_000):
            begin = at[first[i : i + 100_000]]
            some = [spelled.take(pa.array(a[begin + j])) for j in range(k)]
            phrase = some[0] if k == 1 else pc.binary_join_element_wise(*some, b" ")
            yield self._batch(phrase.cast(pa.string()), n[i : i + 100_000])

    def _batch(self, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "f"])


def phrases(docs: DataFrame, sizes: range, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): phrases of these sizes, added up within buffers; with single words also the number of words, as phrase null.

    frequent is a bitmap of pairs: a phrase of three words and more has only pairs that it holds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def work(batches):
        buffers: dict[str, _Buffer] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for i, lang in enumerate(langs):
                text = texts[i].as_py()
                if text:
                    if lang not in buffers:
                        buffers[lang] = _Buffer(lang, sizes, sent and sent.value)
                    yield from buffers[lang].add(text)
            if sum(b.held for b in buffers.values()) > FLUSH:
                for b in buffers.values():
                    yield from b.flush()
                buffers.clear()
        for b in buffers.values():
            yield from b.flush()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang")
    return map_texts(docs.select(lang, F.col("text").cast("string").cast("binary").alias("text")), work, ROWS)


def bitmap(pairs: DataFrame) -> np.ndarray:
    """A bitmap of pairs of words (lang, phrase), of a size that their number asks for within FILTER_BITS."""
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (8 * pairs.count()).bit_length()))

    def work(batches):
        for batch in batches:
            langs, both = batch.column("lang").to_pylist(), [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            h = np.array([[xxhash.xxh64_intdigest(w, xxhash.xxh32_intdigest(lang.encode())) for w in two] for lang, two in zip(langs, both)], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(h[:, 0], h[:, 1], bits).astype(np.int64))], names=["place"])

    places = map_texts(pairs.select("lang", "phrase"), work, "place long")
    # the bitmap comes in parts of 4 kB, most / 8 bytes in all
    parts = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("held"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():
        begin = (row["part"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(bytes(row["held"]), np.uint8)
    return out


def frequent_phrases(docs: DataFrame, work: Workspace, most: int = MOST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k) of the phrases that occur at least so often, and (lang, n), the words of each language; written."""
    counted = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())
    short = work.write(counted(phrases(docs, range(1, min(most, 2) + 1))).withColumn("k", F.size(F.split("phrase", " "))), "short")
    totals = short.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    out = short.where("phrase IS NOT NULL")
    if most > 2:
        held = bitmap(short.where("k = 2"))
        out = out.unionByName(work.write(counted(phrases(docs, range(3, most + 1), held)).withColumn("k", F.size(F.split("phrase", " "))), "long"))
    return out, totals


def _score(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts) without rounding: products may pass 64 bits, quotients don't."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)"), parts.cast("decimal(20,0)"))


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score: the best phrases of each language.

    a counts the phrase, l and r the parts of the cut that counts, n the
    language's words. Score, then count, then phrase in order of bytes rank.
    """
    work = Workspace(docs.sparkSession, "collocations")
    frequent, totals = frequent_phrases(docs, work, most, least)
    split = F.split("phrase", " ")
    part = lambda begin, size: F.array_join(F.slice(split, begin, size), " ")

    candidates = frequent.where("k > 1").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "cut", "l", "r")).alias("c"))

    inner = [candidates.where("k > 2").select("lang", part(F.lit(begin), F.col("k") - 1).alias("phrase"), F.col("a").alias("f")) for begin in (1, 2)]
    around = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    own = (F.col("b.lang") == F.col("x.lang")) & (F.col("b.phrase") == F.col("x.phrase")) & (100 * F.col("x.f").cast("decimal(20,0)") >= SURROUNDED * F.col("b.a").cast("decimal(20,0)"))
    kept = work.write(best.alias("b").join(around.alias("x"), own, "left_anti").select("lang", "phrase", "a", "c.l", "c.r", "c.score"), "kept")

    # the first rows of each share of a language, then of the language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = kept.count() // SHARE + 1
    within = Window.partitionBy("lang", "_share").orderBy(*order)
    shared = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("_at", F.row_number().over(within)).where(F.col("_at") <= first)
    ranked = shared.drop("_share", "_at").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
