"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding. The
table ``last`` stores that token for each prefix: token t is the last one of
prefix i if the encoding of the prefix before t ends in a token after which t
may stand, that is, if BPE would not merge across their boundary. Whether two
tokens may stand side by side follows from the ranks alone: the merges that
made both are undone from the latest on, and at no step may the two parts that
touch form a token that BPE would have merged earlier.

The table gives the encoding of *every* prefix, so appending bytes goes on
from the table's end, and an edit in a text re-encodes the pieces near it.

A text is split by the vocabulary's pattern first and each piece is encoded
alone, as the vocabulary asks; a piece that is a token as a whole is that
token. Pieces recur, so each task keeps a bounded cache of them, and new ones
are encoded in sorted order on one table, so that common prefixes are done once.

Defined results: null text is empty; an empty text has no tokens; documents of
any length are encoded whole; repeated rows are encoded each; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts


VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that one task keeps; when they are more it starts anew.
CACHE_PIECES = 200_000
#: Texts whose pieces are encoded together, up to so many characters.
TOGETHER = 1 << 20


_SHORT = (3, 2, 1)


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.size_of = {r: len(b) for b, r in ranks.items()}
        # lengths of the tokens that end in four given bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= 4:
                ends.setdefault(token[-4:], {1, 2, 3}).add(len(token))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in rows})

    def merge(self, piece: bytes) -> list[int]:
        """BPE by definition: merge the adjacent pair of the lowest rank, leftmost first. For short pieces."""
        return self._merged([bytes([b]) for b in piece], 1)

    def _merged(self, parts: list[bytes], least: int) -> list[int]:
        while len(parts) > least:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            ranked = [x for x in ranked if x[0] is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; a single byte twice; None if BPE never makes it."""
        if token not in self._parts:
            b = self.bytes_of[token]
            if len(b) == 1:
                self._parts[token] = (token, token)
            else:
                two = self._merged([bytes([x]) for x in b], 2)
                self._parts[token] = (two[0], two[1]) if len(two) == 2 else None
        return self._parts[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side."""
        key = left << 32 | right
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 250_000:
                self._fits.clear()
            found = self._fits[key] = self.parts(right) is not None and self._stand(left, right)
        return found

    def extend(self, piece: bytes, last: list[int], begin: int = 0) -> None:
        """Go on with the table of last tokens from the prefix of ``begin`` bytes; -2 where a prefix has none."""
        rank, ends, known, fits = self.ranks.get, self.ends.get, self._fits.get, self.fits
        add = last.append
        for end in range(begin + 1, len(piece) + 1):
            for n in ends(piece[end - 4 : end], _SHORT) if end > 3 else _SHORT[3 - end :]:
                if n > end:
                    continue
                token = rank(piece[end - n : end])
                if token is None:
                    continue
                before = last[end - n]
                if before >= 0:
                    stands = known(before << 32 | token)
                    if stands or stands is None and fits(before, token):
                        add(token)
                        break
                elif before == -1 and self.parts(token) is not None:
                    add(token)
                    break
            else:
                add(-2)

    def encode_piece(self, piece: bytes) -> list[int]:
        last = [-1]
        self.extend(piece, last)
        sizes, out, at = self.size_of, [], len(piece)
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _stand(self, left: int, right: int) -> bool:
        """Undo merges, the latest first, and look for a pair at the boundary that would have gone first.

        Among equal ranks BPE merges the leftmost place first, so a pair at the
        boundary goes before a merge of the same rank in the right token, but
        after one in the left token.
        """
        bound = None  # (rank, 1 if of the right token): the merge undone last
        bytes_of, ranks = self.bytes_of, self.ranks
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and (bound is None or (joined, 0.5) < bound):
                return False
            left_made, right_made = len(bytes_of[left]) > 1, len(bytes_of[right]) > 1
            if not left_made and not right_made:
                return True
            if right_made and (not left_made or (right, 1) > (left, 0)):
                bound = (right, 1)
                right = self.parts(right)[0]
            else:
                bound = (left, 0)
                left = self.parts(left)[1]


class PrefixTable:
    """Encoding of one piece and of all its prefixes; bytes can be appended."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, bytearray(), [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        begin = len(self.piece)
        self.piece += more
        self.vocabulary.extend(bytes(self.piece), self.last, begin)

    def tokens(self, end: int | None = None) -> list[int]:
        """Tokens of the first ``end`` bytes, by default of all."""
        at = len(self.piece) if end is None else end
        out = []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.bytes_of_name = {str(r): b for r, b in vocabulary.bytes_of.items()}
        self._cache: dict[str, str] = {}

    def piece(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(piece)
        return [whole] if whole is not None else self.vocabulary.encode_piece(piece)

    def encode(self, text: str) -> list[int]:
        return [t for p in self.pattern.findall(text) for t in self.piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        of = self.vocabulary.bytes_of
        return b"".join([of[i] for i in ids])

    def encode_joined(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas.

        New pieces are encoded in sorted order on one table: each keeps the
        entries of the prefix that it has in common with the one before.
        """
        split = [self.pattern.findall(t) for t in texts]
        if len(self._cache) > CACHE_PIECES:
            self._cache = {}
        cache = self._cache
        fresh = sorted({p for pieces in split for p in pieces if p not in cache})
        v = self.vocabulary
        ranks, extend, sizes = v.ranks, v.extend, v.size_of
        before, last = b"", [-1]
        for piece in fresh:
            b = piece.encode()
            whole = ranks.get(b)
            if whole is not None:
                cache[piece] = str(whole)
                continue
            n = 0
            for x, y in zip(before, b):
                if x != y:
                    break
                n += 1
            del last[n + 1 :]
            extend(b, last, n)
            before, at, out = b, len(b), []
            while at:
                token = last[at]
                out.append(token)
                at -= sizes[token]
            out.reverse()
            cache[piece] = ",".join(map(str, out))
        return [",".join(map(cache.__getitem__, p)) for p in split]

    def forget(self) -> None:
        """Free the cache; executors keep their Python processes for other work."""
        self._cache = {}

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of_name.__getitem__, joined.split(","))) if joined else b""


class EncodedText:
    """A text with its tokens, kept exact under appends and edits without encoding it all again."""

    #: A match depends on no more characters behind its end than the longest contraction has.
    REACH = 4

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.pieces: list[str] = encoder.pattern.findall(text)
        self.ids: list[list[int]] = [encoder.piece(p.encode()) for p in self.pieces]
        self.encoded = len(self.pieces)  # pieces encoded so far in all, to show how little an edit costs

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def tokens(self) -> list[int]:
        return [t for x in self.ids for t in x]

    def append(self, more: str) -> None:
        n = sum(map(len, self.pieces))
        self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of text[start:end]; only pieces near the edit are encoded again."""
        lo, at = 0, 0
        while lo < len(self.pieces) and at + len(self.pieces[lo]) < start - self.REACH:
            at += len(self.pieces[lo])
            lo += 1
        hi, upto = lo, at
        while hi < len(self.pieces) and upto < end:
            upto += len(self.pieces[hi])
            hi += 1
        head = "".join(self.pieces[lo:hi])
        tail = head[: start - at] + new + head[end - at :]
        edited = at + (start - at) + len(new)
        # split on until a boundary behind the edit falls on an old one; old pieces stay from there
        while True:
            more = "".join(self.pieces[hi : hi + 8])
            fresh, pos, found = [], at, None
            bounds, b = {}, at + len(tail)
            for k in range(hi, min(hi + 8, len(self.pieces)) + 1):
                bounds[b] = k
                b += len(self.pieces[k]) if k < len(self.pieces) else 0
            stop = len(tail) + len(more) - self.REACH
            for m in self.encoder.pattern.finditer(tail + more):
                fresh.append(m.group())
                pos += len(m.group())
                if pos >= edited and pos in bounds and (pos - at <= stop or hi + 8 >= len(self.pieces)):
                    found = bounds[pos]
                    break
            if found is not None or hi + 8 >= len(self.pieces):
                break
            tail, hi = tail + more, hi + 8
        found = len(self.pieces) if found is None else found
        self.encoded += len(fresh)
        self.ids[lo:found] = [self.encoder.piece(p.encode()) for p in fresh]
        self.pieces[lo:found] = fresh


@lru_cache(maxsize=2)
def encoder(name_or_path: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file: a path, or a name that the public_tokenizers package knows."""
    import os

    import public_tokenizers

    path = name_or_path if os.path.sep in name_or_path else public_tokenizers.path(name_or_path)
    return Encoder(Vocabulary.load(path), public_tokenizers.PATTERN)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Tokens of each text and, as a check of the round trip, a digest of the bytes they decode to.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.
    """

    def work(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= TOGETHER):
                    size += len(texts[hi] or "")
                    hi += 1
                joined = enc.encode_joined([t or "" for t in texts[lo:hi]])
                n = [j.count(",") + 1 if j else 0 for j in joined]
                shas = [hashlib.sha256(j.encode()).hexdigest() for j in joined]
                back = [hashlib.sha256(enc.decode_joined(j)).hexdigest() for j in joined]
                ids = [list(map(int, j.split(","))) if j else [] for j in joined] if with_ids else [None] * len(joined)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                lo = hi
        enc.forget()

    out = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, OUT)
    return out if with_ids else out.drop("ids")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the text whose bytes the ids stand for."""

    def work(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [enc.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), work, "doc_id long, text string")
