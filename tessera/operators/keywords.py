"""Word similarity of many queries and many contents: bounds in numpy, the sweep itself for what they leave.

A stretch of a content with h of a query's n trigrams and k different ones scores
h / (n + k - h). To reach a score of f it needs f * n hits, and it has n / f
different trigrams at most. A content is cut into blocks that hold K different
trigrams each, the first of the next block being another one: a stretch of K
different ones can't hold a whole block and the place behind it, so it lies in two
blocks that adjoin. The hits in all pairs of adjoining blocks are counted for all
queries of about one K by a product of matrices; where they suffice, the best
stretch between two hits is found exactly, which bounds the sweep from above. Only
contents that could still be among a query's k best are swept.

The k best are held by score and then by id, and the last of them is the query's
floor for all that follows.
"""

from __future__ import annotations

import functools
import sys
from bisect import bisect_right, insort

import numpy as np

from tessera.functions.similarity import sweep, trigram_list

#: Contents that are counted at once, their characters but for one content, and numbers in a matrix.
BATCH, LETTERS, NUMBERS = 512, 1 << 20, 1 << 22
NONE = -(1 << 30)
#: Hits of a content whose pairs are counted at once.
PAIRS = 512
#: Places of the shortest blocks, numbers in the table of trigrams, and classes of the trigrams that no query has.
WIDTH, TABLE, OTHERS = 64, 1 << 22, 1021
_WIDTH, _BLANK = np.uint64(21), np.uint64(32)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point belongs to words."""
    return np.fromiter(map(str.isalnum, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


def code(trigram: str) -> int:
    a, b, c = map(ord, trigram)
    return a << 42 | b << 21 | c


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts as numbers, those of trigram_list in order, and where each text's begin."""
    low = [t.lower() + "\0" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _letters()[points]
    third = np.where(word, points, 32).astype(np.uint64)
    second = np.concatenate([[_BLANK], third])[: len(third)]
    first = np.where(second == _BLANK, _BLANK, np.concatenate([[_BLANK, _BLANK], third])[: len(third)])
    at = np.flatnonzero(word | (second != _BLANK))
    begin = np.searchsorted(at, np.cumsum([0, *map(len, low)]))
    return (first[at] << np.uint64(42)) | (second[at] << _WIDTH) | third[at], begin


def _before(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The place within its text where each trigram stood last, far below 0 if it is the first one."""
    out = np.full(len(grams), NONE, np.int32)
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
        order = np.argsort(grams[a:z], kind="stable")
        own = grams[a:z][order]
        same = np.flatnonzero(own[1:] == own[:-1])
        out[a + order[same + 1]] = order[same]
    return out


def _grid(row: np.ndarray, number: np.ndarray, rows: int, known: int) -> np.ndarray:
    """1 for each known trigram that a row has; the last column is of all others."""
    grid = np.zeros((rows, known + 1), np.float32)
    grid.ravel()[row * (known + 1) + number] = 1
    return grid


def swept(hit: np.ndarray, before: np.ndarray, n: int) -> float:
    """The same as sweep, for the places of a query's n trigrams and where each place's trigram stood before.

    A stretch that scores best begins at a hit, or at places that change nothing before one, so the hits
    and different trigrams between all pairs of hits are counted at once: a place counts for the stretches
    that begin behind its trigram's last place.
    """
    upto = np.cumsum(hit)
    m = int(upto[-1]) if len(upto) else 0
    if not m:
        return 0.0
    begin = np.where(before >= 0, upto[np.maximum(before, 0)], 0)
    on = np.flatnonzero((begin < upto) & (upto - hit < m))

    def counted(on: np.ndarray) -> np.ndarray:
        end = upto[on] - hit[on]
        size = (m + 1) * m
        grid = np.bincount(begin[on] * m + end, minlength=size) - np.bincount(upto[on] * m + end, minlength=size)
        return np.cumsum(np.cumsum(grid.reshape(m + 1, m)[:m], axis=0), axis=1)

    hits, kinds = counted(on[hit[on]]), counted(on)
    score = np.ascontiguousarray((hits / (n + kinds - hits)).T)
    lower, best = 0, 0.0
    for i in range(m):
        row = score[i, lower : i + 1]
        j = int(row.argmax())
        best = max(best, float(row[j]))
        lower += j
    return best


class Search:
    """The k best contents of each query among those that are added."""

    def __init__(self, queries: list[str], k: int, threshold: float, floors: list[tuple[float, object] | None]):
        self.k, self.threshold = k, threshold
        self.wanted = [set(trigram_list(q)) for q in queries]
        known = sorted(set().union(*self.wanted))
        at = {g: i for i, g in enumerate(known)}
        self.known = len(known)
        self.n = np.array([len(w) for w in self.wanted])
        self.has = np.zeros((len(queries), self.known + 1), bool)  # the last column is of trigrams that no query has
        for i, w in enumerate(self.wanted):
            self.has[i, [at[g] for g in w]] = True
        self._letters(known)
        self.floor = np.array([max(threshold, f[0]) if f else threshold for f in floors])
        self.last = [_key(f[1]) if f and f[0] >= threshold else None for f in floors]
        self.held: list[list] = [[] for _ in queries]

    def _letters(self, known: list[str]) -> None:
        """Classes of characters: 0 stands between words, 1 is of words but in no query, each other one is a query's letter."""
        letters = sorted(set("".join(known)) - {" "})
        self.kind = _letters().astype(np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.base = len(letters) + 2
        kinds = {c: i for i, c in enumerate(letters, 2)} | {" ": 0}
        self.codes = np.array([(kinds[a] * self.base + kinds[b]) * self.base + kinds[c] for a, b, c in known], np.int64)
        self.table = None
        if self.base**3 <= TABLE:
            self.table = np.full(self.base**3, self.known, np.int32)
            self.table[self.codes] = np.arange(self.known)
        else:
            self.order = np.argsort(self.codes)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The known trigram that stands at each place, what tells it from others, and where each text's begin.

        Trigrams that no query has are told apart by a few bits only, so two of them can pass for one.
        """
        low = [t.lower() + "\0" for t in texts]
        third = self.kind[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
        second = np.concatenate([[0], third[:-1]]).astype(np.int32)
        at = np.flatnonzero(third | second)
        begin = np.searchsorted(at, np.cumsum([0, *map(len, low)]))
        kind = np.int32 if self.base < 1290 else np.int64
        first = np.concatenate([[0], second[:-1]]).astype(kind)
        second, third = second[at], third[at]
        code = (np.where(second > 0, first[at], 0) * kind(self.base) + second) * kind(self.base) + third
        if self.table is not None:
            number = self.table[code]
        else:
            place = np.minimum(np.searchsorted(self.codes, code, sorter=self.order), self.known - 1)
            number = np.where(self.codes[self.order[place]] == code, self.order[place], self.known).astype(np.int32)
        apart = np.where(number < self.known, number, self.known + code % OTHERS)
        return number, apart.astype(np.uint16 if self.known + OTHERS < 1 << 16 else np.uint32), begin

    def add(self, ids: list, contents: list[str]) -> None:
        lo = size = 0
        for i, text in enumerate(contents):
            if i > lo and (i - lo == BATCH or size + len(text) > LETTERS):
                self._add(ids[lo:i], contents[lo:i])
                lo, size = i, 0
            size += len(text)
        self._add(ids[lo:], contents[lo:])

    def _add(self, ids: list, contents: list[str]) -> None:
        if not self.known or not ids:
            return
        keys = [_key(i) for i in ids]
        number, apart, begin = self.numbers(contents)
        c, q, bound = self._possible(number, apart, begin, keys)
        grams: dict[int, tuple] = {}
        for i in np.lexsort((c, q, -bound)).tolist():
            at, asked, b = int(c[i]), int(q[i]), bound[i]
            if b < self.floor[asked] - 1e-9:
                continue
            if self.last[asked] is not None and b <= self.floor[asked] and keys[at] > self.last[asked]:
                continue
            if at not in grams:
                own = codes([contents[at]])
                grams[at] = number[begin[at] : begin[at + 1]], _before(*own)
            here, before = grams[at]
            hit = self.has[asked, here]
            score = swept(hit, before, int(self.n[asked])) if np.count_nonzero(hit) <= PAIRS else sweep(self.wanted[asked], trigram_list(contents[at]))
            self._hold(asked, score, keys[at])

    def _possible(self, number: np.ndarray, apart: np.ndarray, begin: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content, query, bound) of what may reach the floors, each pair once."""
        texts, need = len(begin) - 1, np.ceil(self.floor * self.n - 1e-6).astype(np.float32)
        has = self.has.T.astype(np.float32)
        owner = np.repeat(np.arange(texts), np.diff(begin))
        hits = _grid(owner, number, texts, self.known) @ has
        # by all trigrams of a content
        order = sorted(range(texts), key=keys.__getitem__)
        place = np.empty(texts, np.int64)
        place[order] = np.arange(texts)
        ordered = [keys[i] for i in order]
        end = np.array([texts if last is None else bisect_right(ordered, last) for last in self.last])
        may = (hits >= need) & (self.n > 0) & ((place[:, None] < end) | (hits > self.floor * self.n + 1e-9))
        some, queries = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        keep = may.any(axis=1)[owner]
        number, apart, sizes = number[keep], apart[keep], np.diff(begin)[some]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        before = _before(apart, begin)
        most = (self.n / self.floor + 1e-9).astype(np.int64)
        found, width = [], WIDTH
        left = queries
        while len(left):
            part, left = left[2 * most[left] <= width], left[2 * most[left] > width]
            if len(part):
                on = np.flatnonzero(may[some][:, part].any(axis=1))
                those = np.zeros(len(some), bool)
                those[on] = True
                those = np.repeat(those, sizes)
                c, q, bound = self._in_blocks(part, may[some[on]], hits[some[on]], number[those], before[those], sizes[on], width, most, need)
                found.append((on[c], q, bound))
            width *= 2
        c, q, bound = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-bound, q, c))
        c, q, bound = c[order], q[order], bound[order]
        new = np.append(True, (c[1:] != c[:-1]) | (q[1:] != q[:-1]))[: len(c)]
        return some[c[new]], q[new], bound[new]

    def _in_blocks(self, part: np.ndarray, may: np.ndarray, hits: np.ndarray, number: np.ndarray, before: np.ndarray, sizes: np.ndarray, width: int, most: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content, query, bound) of what may reach the floors of some queries, by stretches of blocks of ``width`` places."""
        begin = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = (np.arange(len(number)) - begin[owner]).astype(np.int32)
        # a stretch that is longer than a block and has few different trigrams: only where all its parts have few
        lower = begin[owner] + np.maximum(np.maximum(before + 1, inside - width + 1), 0)
        kinds = np.cumsum(np.bincount(lower, minlength=len(number))) - np.arange(len(number))
        kinds[inside > sizes[owner] - width] = width + 1
        least = np.minimum.reduceat(kinds, begin[:-1])
        long = may[:, part] & (most[part] >= least[:, None])
        c, q = np.nonzero(long)
        q = part[q]
        found = [(c, q, np.minimum(hits[c, q] / self.n[q], 1.0))]
        # all others lie in two blocks that adjoin
        rest = may[:, part] & ~long
        blocks = -(-sizes // width)
        first = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(sizes)), blocks)
        start = begin[text] + (np.arange(len(text)) - first[text]) * width
        end = np.minimum(start + 2 * width, begin[text + 1])
        block = first[owner] + inside // width
        step = max(2, NUMBERS // (self.known + 1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        columns = [np.flatnonzero(self.has[i]) for i in part.tolist()]
        count = np.uint8 if self.n[part].max() < 256 else np.int64
        for lo in range(0, len(start), step):
            hi = min(lo + step, len(start))
            a, z = np.searchsorted(block, [lo, hi + 1])
            grid = np.zeros((self.known + 1, hi - lo + 1), np.uint8)
            grid.ravel()[number[a:z] * np.int64(hi - lo + 1) + block[a:z] - lo] = 1
            goes_on = np.append(text[lo + 1 : hi + 1] == text[lo : min(hi, len(text) - 1)], [False])[: hi - lo].astype(np.uint8)
            grid = grid[:, :-1] | grid[:, 1:] * goes_on
            for j, i in enumerate(part.tolist()):
                w = np.flatnonzero(np.add.reduce(grid[columns[j]], axis=0, dtype=count) >= need[i])
                w = w[rest[text[w + lo], j]]
                out.append((w + lo, np.full(len(w), i)))
        w, q = (np.concatenate(x) for x in zip(*out))
        places, of = self._begins(w, q, start, end, width, number, before < inside - width)
        bound = self._from(places, q[of], end[w[of]], width, number, before, inside)
        keep = bound >= self.floor[q[of]] - 1e-9
        found.append((text[w[of[keep]]], q[of[keep]], bound[keep]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _begins(self, w: np.ndarray, q: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, number: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pair) of the hits in first blocks from where hits, less the floor for each place that is none, can reach the floor's share of the query.

        A place whose trigram stands within a block before is not fresh and costs nothing, as it may be no new one.
        """
        fresh = np.append(fresh, False).astype(np.float32)
        number = np.append(number, self.known)
        span = np.arange(2 * width, dtype=np.int32)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, (NUMBERS >> 3) // width)
        for lo in range(0, len(w), step):
            on = slice(lo, lo + step)
            place = start[w[on]].astype(np.int32)[:, None] + span
            np.minimum(place, len(fresh) - 1, out=place)
            hit = self.has.ravel()[(q[on] * (self.known + 1)).astype(np.int32)[:, None] + number[place]]
            hit &= place < end[w[on]][:, None]
            floor = self.floor[q[on]].astype(np.float32)[:, None]
            gain = np.where(hit, np.float32(1), -floor * fresh[place])
            total = np.cumsum(gain, axis=1, dtype=np.float32)
            most = np.maximum.accumulate(total[:, ::-1], axis=1)[:, : width - 1 : -1]
            i, j = np.nonzero((most - total[:, :width] + 1 >= floor * self.n[q[on]][:, None] - 1e-3) & hit[:, :width])
            out.append((place[i, j], i + lo))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _from(self, places: np.ndarray, q: np.ndarray, end: np.ndarray, width: int, number: np.ndarray, before: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The best score of a stretch that begins at each place and is at most a block and one place long."""
        bound = np.zeros(len(places))
        span = np.arange(width + 1, dtype=np.int32)
        step = max(1, (NUMBERS >> 3) // width)
        for lo in range(0, len(places), step):
            on = slice(lo, lo + step)
            place = places[on].astype(np.int32)[:, None] + span
            real = place < end[on][:, None]
            np.minimum(place, len(before) - 1, out=place)
            new = (before[place] < inside[places[on]][:, None]) & real
            hit = self.has.ravel()[(q[on] * (self.known + 1)).astype(np.int32)[:, None] + number[place]]
            hits = np.cumsum(new & hit, axis=1, dtype=np.int32)
            misses = np.cumsum(new & ~hit, axis=1, dtype=np.int32)
            bound[on] = (hits / (self.n[q[on]][:, None] + misses)).max(axis=1)
        return bound

    def _hold(self, asked: int, score: float, key: tuple) -> None:
        if score < self.threshold - 1e-7:
            return
        held = self.held[asked]
        insort(held, (-score, key))
        if len(held) >= self.k:
            del held[self.k :]
            if not held:
                return
            worst, last = held[-1]
            if self.last[asked] is None or (worst, last) < (-self.floor[asked], self.last[asked]):
                self.floor[asked], self.last[asked] = max(-worst, self.threshold), last

    def results(self) -> tuple[list[int], list, list[float]]:
        """query, content's id and score of all that is held."""
        rows = [(i, key[1], -score) for i, held in enumerate(self.held) for score, key in held]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [])


def _key(x) -> tuple:
    """Sorts as Spark does: nulls first."""
    return (x is not None, x)
