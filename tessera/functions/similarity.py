"""Vector and trigram similarity."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the query's trigrams that a content must reach.
WORD_THRESHOLD = 0.6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine similarity in double; null where a vector is null, empty or zero."""
    return F.try_divide(dot(a, b), (norm(a) if na is None else na) * (norm(b) if nb is None else nb))


_WORD = re.compile(r"[^\W_]+")


def trigram_list(text: str) -> list[str]:
    """Trigrams of each word in lower case, padded with two blanks before and one behind, in order."""
    out = []
    for w in _WORD.findall(text.lower()):
        padded = f"  {w} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text, as an array; the same as trigram_list."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def word_similarity(query: str, content: str) -> float:
    """The greatest similarity of the query's trigrams and a stretch of the content's.

    One pass over the content's trigrams: at each one that the query has, the
    stretch that ends there is cut from the left to where it scores best.
    """
    wanted = set(trigram_list(query))
    if not wanted:
        return 0.0
    return sweep(wanted, trigram_list(content))


def sweep(wanted: set[str], grams: list[str]) -> float:
    """word_similarity of a query's trigrams, not empty, and a content's in order."""
    last: dict[str, int] = {}
    lower, hits, kinds, best = -1, 0, 0, 0.0
    total = len(wanted)
    for i, g in enumerate(grams):
        found = g in wanted
        if lower < 0 and not found:
            continue
        if g not in last:
            kinds += 1
            hits += found
        last[g] = i
        if not found:
            continue
        if lower < 0:
            lower, kinds = i, 1
        score = hits / (total + kinds - hits)
        top, top_at, top_hits, top_kinds = score, lower, hits, kinds
        h, k = hits, kinds
        for at in range(lower, i + 1):
            s = h / (total + k - h)
            if s > top:
                top, top_at, top_hits, top_kinds = s, at, h, k
            if last[grams[at]] == at:
                k -= 1
                h -= grams[at] in wanted
        for at in range(lower, top_at):
            if last.get(grams[at]) == at:
                del last[grams[at]]
        lower, hits, kinds = top_at, top_hits, top_kinds
        best = max(best, top)
    return best


@F.pandas_udf(T.DoubleType())
def similarity_udf(query: pd.Series, content: pd.Series) -> pd.Series:
    """word_similarity over columns; a text's trigrams are taken once for each batch."""
    query, content = query.fillna(""), content.fillna("")
    queries = {q: set(trigram_list(q)) for q in query.unique()}
    contents = {c: trigram_list(c) for c in content.unique()}
    return pd.Series([sweep(queries[q], contents[c]) if queries[q] else 0.0 for q, c in zip(query, content)], dtype="float64")
