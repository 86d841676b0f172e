"""Vectorised word and n-gram hashing over UTF-8 bytes.

Everything here works on a *block*: the texts of some documents joined by one
separator byte. Word boundaries and hashes of a whole block are computed with
a fixed number of numpy passes, so no Python code runs per word.

Word hash: sum(T[byte] * B**i) modulo 2**64 over the bytes of the word, T a
fixed random table and B odd (hence invertible), followed by a bijective mix.
Sequences of words are hashed the same way over their word hashes. Equal
sequences always get equal hashes, on every executor and at every block size;
different ones collide with probability about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text in a block. A document is never cut: a longer one is a block of its own.
BLOCK_BYTES = 1 << 19

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x7E55E2A))
BYTE_TABLE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1


def _lut(is_word, fold: bool) -> np.ndarray:
    """Byte to itself (folded) if it is part of a word, else 0."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if is_word(b):
            out[b] = b + 32 if fold and 0x41 <= b <= 0x5A else b
    return out


#: Words are runs of anything but ASCII white space.
PLAIN = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D), fold=False)
PLAIN_FOLDED = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D), fold=True)
#: Words are runs of ASCII digits, ASCII letters and all code points from U+0080.
ALNUM_FOLDED = _lut(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80, fold=True)
_NUL_IS_WORD = 0x00


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    inverse = pow(base, -1, 2**64)

    def table(b: int) -> np.ndarray:
        out = np.ones(1, U)
        step = b % 2**64
        while len(out) < size:
            out = np.concatenate([out, out * U(step)])
            step = step * step % 2**64
        return out[:size]

    return table(base), table(inverse)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(base, size)


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """Unmixed hash of values[start:end] for each pair of bounds."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


class Block:
    """Words of some documents.

    start, end: byte bounds of each word in ``buf``; doc: index of its document
    in the block; first: index of each document's first word, with a last entry
    for the end, so that document d has the words first[d]:first[d+1].
    """

    def __init__(self, texts: list[bytes], lut: np.ndarray):
        self.texts = texts
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.raw, self.lengths = raw, lengths
        self.offset = np.cumsum(lengths + 1) - lengths - 1
        buf = lut[raw]
        inside = buf != 0
        if lut[0x4E] and lut[0x23]:  # NUL is a word character where only white space separates
            inside |= raw == _NUL_IS_WORD
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        self.buf, self.inside = buf, inside
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(self.offset, len(raw)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self._hash: np.ndarray | None = None
        self._folded: bytes | None = None

    def __len__(self) -> int:
        return len(self.start)

    def byte_sums(self) -> np.ndarray:
        """Running sums that give the hash of any byte range; see bytes_hash."""
        up, _ = powers(BASE, len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, U)
        np.cumsum(BYTE_TABLE[self.buf] * up[: len(self.buf)], out=total[1:])
        return total

    @property
    def words(self) -> np.ndarray:
        """Hash of each word."""
        if self._hash is None:
            total = self.byte_sums()
            _, down = powers(BASE, len(self.buf) + 1)
            h = (total[self.end] - total[self.start]) * down[self.start]
            self._hash = mix(h + (self.end - self.start).astype(U) * U(0xA24BAED4963EE407))
        return self._hash

    def joined(self, a: int, z: int) -> bytes:
        """The words a:z, folded, joined by one space."""
        if self._folded is None:
            self._folded = self.buf.tobytes()
        return b" ".join([self._folded[x:y] for x, y in zip(self.start[a:z].tolist(), self.end[a:z].tolist())])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether one document has them all."""
        w, m = self.words, len(self) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        h = w[:m].copy()
        for j in range(1, n):
            h *= U(WORD_BASE)
            h += w[j : j + m]
        return mix(h), self.doc[:m] == self.doc[n - 1 : n - 1 + m]


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], lut: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(from, to, block) for consecutive rows, whole documents only."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > block_bytes:
            yield lo, i, Block(texts[lo:i], lut)
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts), Block(texts[lo:], lut)


def covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Boolean mask of n positions: those in any start:start+length."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(block: Block, mask: np.ndarray) -> np.ndarray:
    """How many words of each document are in the mask."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[block.first[1:]] - total[block.first[:-1]]
