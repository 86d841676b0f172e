"""MinHash near-dedup with bottom-k sketches from one hash function.

A document is the set of its distinct word shingles. Documents whose sets are
equal form a *class* and are linked by that; all further work is on classes.

Sketch: the ``SKETCH`` smallest hashes of a set, its retained values.

Inverted lists, without a lost link. Let r = (1 - t) / (1 + t) for threshold
t, a ninth at 0.8. Two sets of a and b shingles with similarity >= t differ in
at most (a + b) * r shingles. The range of the hash is cut into P equal parts;
a part's list is named by the values that a set retains in it, all of them, and
a shingle that differs spoils one part only. A set that differs from any
partner in at most H shingles stands in the H + s lists that come first
in one global order, those with most values first: of the lists that two
similar sets share, the first s are among these in both sets, since at
most H other lists can come before them. So every pair shares s lists or more,
2 at least, by counting and not by chance. P goes by *levels* of
set size, a factor of two wide; a set also visits the level below where it can
have a partner there. Sets so small that similar ones differ in one shingle
stand under the whole set and under each subset that lacks one shingle.
(Lists of single retained values would be exact too, but one frequent word pair
would list a third of a corpus; a list of several values holds sets that agree
in all of them and lack all others of the part.)

Overlaps: (1) each class meets the lowest member of its lists, of these the
one that it meets most often. (2) In lists that still hold classes of different
components, each class meets the *hub*, which has most company over all its
lists, as the origin of a group of copies does. (3) In lists that are still not
of one component, all pairs of different components meet, so that no link
between those is lost. Before that each class leaves the s - 1 longest of its
lists, s that of its smallest partner: the shortest list that a pair shares is
not among them. So a passage that is common to many different texts makes no
pairs of them. Short lists are joined with themselves; what is still long is a
crowd near the threshold and meets in blocks of bounded size: a pair in the
lowest of the lists that it shares, decided there on full sets, and of the links
only as many become rows as connect what they all connect.

Filter: the similarity is estimated from the union's sketch; pairs five
standard deviations (of a draw without replacement) below the threshold go.
Exact: the Jaccard similarity of the others is computed on full sets, and it
alone makes a link. Equal sets are told by two independent 64-bit sums and the
number of shingles.

Defined results: null or empty texts have no shingles and are linked with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat
a doc_id are one node; a row with a null doc_id is linked with nothing, its
component_id is null and it is kept; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_texts
from .components import components
from .textkernel import PLAIN_FOLDED, Block, U, as_bytes, blocks, mix

SHINGLE = 2
THRESHOLD = (80, 100)
SKETCH = 512
#: Lists that a set stands in beyond the shingles in which it can differ: two, and this share of them.
SPARE = 0.15
#: Lists up to this length are joined with themselves; longer ones meet in blocks of BLOCK members, fewer if their sets are large.
SHORT_LIST = 32
BLOCK = 2048
#: Shingles of the members of a block.
BLOCK_SHINGLES = 4_000_000
#: Shared values of a block that are counted at once.
COLUMNS = 2048
#: Rows of three numbers that are sent to every executor at most.
BROADCAST_ROWS = 250_000

_TOP = np.uint64(2**64 - 1)


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, by document and then hash, and where each document's begin."""
    grams, whole = block.ngrams(size)
    doc = block.doc[: len(grams)][whole]
    grams = grams[whole]
    short = np.flatnonzero((block.counts > 0) & (block.counts < size))
    if len(short):
        one = np.array([_sequence(block.words[block.first[d] : block.first[d + 1]]) for d in short], U)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, one])
        order = np.argsort(doc, kind="stable")
        doc, grams = doc[order], grams[order]
    ends = np.searchsorted(doc, np.arange(len(block.texts) + 1))
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):  # small sorts of one document each are the fastest way
        grams[a:z].sort()
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[fresh], grams[fresh]
    return grams, np.searchsorted(doc, np.arange(len(block.texts) + 1))


def _sequence(words: np.ndarray) -> int:
    h = np.zeros(1, U)
    for w in words:
        h = mix(h + w)
    return int(mix(h + U(len(words)))[0])


def _class_ids(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers for each set."""
    out = []
    for salt, step in ((0x5851F42D4C957F2D, 0x14057B7EF767814F), (0x2B7E151628AED2A7, 0x9E6C63D0676A9A99)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams * U(salt) ^ U(step)))])
        out.append(mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(U) * U(step)).view(np.int64))
    return out[0], out[1]


def _describe(shingle: int):
    """tag, n and class of each document."""

    def work(batches):
        for batch in batches:
            for lo, hi, block in blocks(as_bytes(batch.column("text")), PLAIN_FOLDED):
                grams, at = shingles(block, shingle)
                n = np.diff(at)
                c, d = (pa.array(x, pa.int64(), mask=n == 0) for x in _class_ids(grams, at))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "tag")), pa.array(n, pa.int64()), c, d], names=["doc_id", "tag", "n", "c", "d"])

    return work


def small_size(threshold: tuple[int, int]) -> int:
    """The largest size up to which similar sets differ in one shingle at most."""
    part, of = threshold
    return (of + part - 1) // (of - part) if of > part else 0


class Levels:
    """The levels of set size: which lists a set of n shingles stands in."""

    def __init__(self, threshold: tuple[int, int]):
        self.part, self.of = threshold
        self.small = small_size(threshold)

    def begin(self, level):
        """Smallest home size of a level."""
        return max(self.small, 1) << level

    def home(self, n: np.ndarray) -> np.ndarray:
        """Level of each size >= begin(0)."""
        return np.floor(np.log2(n / self.begin(0)) + 1e-12).astype(np.int64)

    def largest_partner(self, n):
        return n * self.of // self.part

    def differ(self, both):
        """How many shingles similar sets of this total size can differ in."""
        return both * (self.of - self.part) // (self.of + self.part)

    def spare(self, n: np.ndarray) -> np.ndarray:
        """Lists beyond the shingles in which sets can differ: similar sets share the smaller one's number at least."""
        return 2 + (SPARE * self.differ(n + self.largest_partner(n))).astype(np.int64)

    def may_leave(self, n: np.ndarray) -> np.ndarray:
        """How many of its lists a set may leave and still share one with each partner."""
        smallest = -(-n * self.part // self.of)
        return np.where(n > self.small, self.spare(smallest) - 1, 0)

    def parts(self, level: np.ndarray) -> np.ndarray:
        """Parts of the hash range: some more than any set of the level needs lists."""
        top = (self.begin(0) << (level + 1)) - 1
        most = self.differ(top + self.largest_partner(top)) + self.spare(top)
        return most + np.maximum(3, most // 7)

    def stands(self, n: np.ndarray):
        """(row, level, lists) for each level that sets of these sizes stand in."""
        row = np.flatnonzero(n >= self.begin(0))
        level = self.home(n[row])
        yield row, level, self.differ(n[row] + self.largest_partner(n[row])) + self.spare(n[row])
        below = (self.begin(0) << level) - 1  # the largest home size of the level below
        visits = (level > 0) & (n[row] <= self.largest_partner(below))
        row, level, below = row[visits], level[visits], below[visits]
        yield row, level - 1, self.differ(n[row] + below) + self.spare(n[row])


def list_keys(grams: np.ndarray, at: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the lists that sets stand in; grams sorted within each set."""
    n = np.diff(at)
    levels = Levels(threshold)
    rows, keys = [], []
    if levels.of == levels.part:
        return np.zeros(0, np.int64), np.zeros(0, U)
    mixed = mix(grams ^ U(0x2545F4914F6CDD1D))
    total = np.concatenate([np.zeros(1, U), np.cumsum(mixed)])
    high = grams >> U(32)
    for row, level, lists in levels.stands(n):
        if not len(row):
            continue
        parts = levels.parts(level)
        size = n[row]
        own = np.repeat(np.arange(len(row)), size)
        value = np.arange(len(own)) + np.repeat(at[row] - (np.cumsum(size) - size), size)
        part = ((high[value] * parts.astype(U)[own]) >> U(32)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])])
        end = np.r_[begin[1:], len(own)]
        held, own, part = end - begin, own[begin], part[begin]
        name = total[value[end - 1] + 1] - total[value[begin]]
        key = _name(name, part, level[own])
        used = np.bincount(own, minlength=len(row))
        lacks = np.flatnonzero(used < lists)
        if len(lacks):  # so few parts with values that empty ones have to be listed
            first, more = np.searchsorted(own, lacks), []
            for r, f in zip(lacks, first):
                empty = np.setdiff1d(np.arange(parts[r]), part[f : f + used[r]])
                more.append(np.sort(_name(np.zeros(len(empty), U), empty, np.full(len(empty), level[r])))[: lists[r] - used[r]])
            own, key = np.concatenate([own, np.repeat(lacks, [len(m) for m in more])]), np.concatenate([key, *more])
            held = np.concatenate([held, np.zeros(len(own) - len(held), held.dtype)])
        # by set, then most values first, then name: one sort of packed numbers
        packed = (own.astype(U) << U(44)) | ((U(255) - np.minimum(held, 255).astype(U)) << U(36)) | (key >> U(28))
        order = np.argsort(packed)
        own, key = own[order], key[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own, "left")
        keep = rank < lists[own]
        rows.append(row[own[keep]])
        keys.append(key[keep])
    whole = total[at[1:]] - total[at[:-1]]
    few = np.flatnonzero((n > 0) & (n < levels.small) & (levels.largest_partner(n) > n))
    rows.append(few)
    keys.append(mix(whole[few] ^ U(0x27D4EB2F165667C5)))
    few = np.flatnonzero((n > 1) & (n <= levels.small) & (levels.largest_partner(n - 1) >= n))
    size = n[few]
    own = np.repeat(few, size)
    value = np.arange(len(own)) + np.repeat(at[few] - (np.cumsum(size) - size), size)
    rows.append(own)
    keys.append(mix((whole[own] - mixed[value]) ^ U(0x27D4EB2F165667C5)))
    return np.concatenate(rows), np.concatenate(keys)


def _name(values: np.ndarray, part: np.ndarray, level: np.ndarray) -> np.ndarray:
    return mix(values + part.astype(U) * U(0x9E3779B97F4A7C15) + level.astype(U) * U(0xD1342543DE82EF95))


def _listed(shingle: int, threshold: tuple[int, int]):
    """(key, c) for each list of each different set of a block."""

    def work(batches):
        for batch in batches:
            for _, _, block in blocks(as_bytes(batch.column("text")), PLAIN_FOLDED):
                grams, at = shingles(block, shingle)
                c, _ = _class_ids(grams, at)
                row, key = list_keys(grams, at, threshold)
                first = np.zeros(len(c), bool)
                first[np.unique(c, return_index=True)[1]] = True
                keep = first[row]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(c[row[keep]])], names=["key", "c"])

    return work


def _may_leave(threshold: tuple[int, int]):
    def work(batches):
        for batch in batches:
            may = Levels(threshold).may_leave(batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(may, pa.int64())], names=["c", "may"])

    return work


def _sets(shingle: int, sketch: int):
    """c, rep, the retained values and the other shingles of the documents that stand for classes."""

    def work(batches):
        for batch in batches:
            for lo, hi, block in blocks(as_bytes(batch.column("text")), PLAIN_FOLDED):
                grams, at = shingles(block, shingle)
                middle = np.minimum(at[:-1] + sketch, at[1:])
                packed = [pa.array([grams[a:z].tobytes() for a, z in zip(x, y)], pa.binary()) for x, y in ((at[:-1], middle), (middle, at[1:]))]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in ("c", "doc_id")), *packed], names=["c", "rep", "sketch", "rest"])

    return work


def _packed_keys(batches):
    """The keys of each class as bytes."""
    for batch in batches:
        keys = pa.array([np.array(k, np.int64).tobytes() for k in batch.column("keys").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("c", "n", "doc_id", "tag")), keys], names=["c", "n", "doc_id", "tag", "keys"])


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarity by the bottom-k sketch of the union, and how many values it has.

    a, b: a row of k retained values for each pair, filled up with the largest number.
    """
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _TOP)
    real = both != _TOP
    rank = np.cumsum(real & ~same, axis=1)
    size = np.minimum(rank[:, -1], k)
    return (same & (rank <= k)).sum(axis=1) / np.maximum(size, 1), size


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.full((len(packed), width), _TOP)
    for i, v in enumerate(packed):
        got = np.frombuffer(v, U)
        out[i, : len(got)] = got
    return out


def _passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, sketch: int, threshold: float) -> np.ndarray:
    """Whether the estimate of pairs of sketches leaves the threshold possible."""
    keep = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1024):
        part = slice(lo, lo + 1024)
        got, size = estimate(a[part], b[part], sketch)
        union = (na[part] + nb[part]) / (1 + threshold)
        spread = np.sqrt(threshold * (1 - threshold) / np.maximum(size, 1) * np.clip(1 - size / union, 0.02, 1))
        keep[part] = got + 1e-9 >= threshold - np.where(size < sketch, 0.0, 5 * spread)
    return keep


def _likely(sketch: int, threshold: float):
    """Pairs whose estimate does not rule the threshold out."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                a, b = (_matrix(part.column(x).to_pylist(), sketch) for x in ("sa", "sb"))
                keep = pa.array(_passes(a, b, part.column("na").to_numpy(), part.column("nb").to_numpy(), sketch, threshold))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return work


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of links that connect all that the links x - y connect, without a circle."""
    names, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = both[: len(x)], both[len(x) :]
    at, kept = np.flatnonzero(x != y), [np.zeros(0, np.int64)]
    x, y = x[at], y[at]
    while len(at):
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        first = order[np.r_[True, np.diff(high[order]) > 0]]
        kept.append(at[first])
        above = np.arange(len(names))
        above[high[first]] = low[first]
        while (above[above] != above).any():
            above = above[above]
        x, y = above[x], above[y]
        go = x != y
        x, y, at = x[go], y[go], at[go]
    return np.concatenate(kept)


def _together(own: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """How many values rows of left and right both hold, by products of matrices; own: the row of each value."""
    _, number, times = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    own, column = own[times[number] > 1], place[number[times[number] > 1]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [lo, lo + COLUMNS])
        grid = np.zeros((rows, min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        grid[own[a:z], column[a:z] - lo] = 1
        out += grid[left] @ grid[right].T
    return out


def _meet(sketch: int, threshold: tuple[int, int]):
    """Links between two blocks of a list, or of one block with itself, that connect all components which any link of theirs connects.

    A pair meets in the lowest list that it shares. Retained values that both hold are counted for all pairs at
    once. Sets that are retained whole are decided by that; of others, those pairs that the count leaves possible
    and no link so far connects are compared on full sets.
    """
    part, of = threshold

    def work(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(x)[0].as_py() for x in ("key", "i", "j"))
        table = table.combine_chunks()
        own, comp, c, n = (table.column(x).to_numpy() for x in ("own", "comp", "c", "n"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        lists = [np.frombuffer(k, np.int64) for k in table.column("keys").to_pylist()]
        lists = [k[k < key] for k in lists]
        wanted = _together(np.repeat(np.arange(len(c)), [len(k) for k in lists]), np.concatenate(lists), left, right, len(c)) == 0
        wanted &= comp[left][:, None] != comp[right][None]
        small, large = (f(n[left][:, None], n[right][None]) for f in (np.minimum, np.maximum))
        wanted &= of * small >= part * large
        if i == j:
            wanted &= c[left][:, None] < c[right][None]
        rows, columns = wanted.any(axis=1), wanted.any(axis=0)
        left, right, wanted = left[rows], right[columns], wanted[rows][:, columns]
        used = np.unique(np.concatenate([left, right]))
        packed = {k: table.column("sketch")[k].as_py() for k in used.tolist()}
        held = np.zeros(len(c), np.int64)
        held[used] = [len(packed[k]) // 8 for k in used.tolist()]
        common = _together(np.repeat(used, held[used]), np.frombuffer(b"".join(packed.values()), U), left, right, len(c))
        whole = held == n
        sure, maybe = [], []
        least = part / of - 5 * np.sqrt(part * (of - part)) / of / np.sqrt(sketch)
        for lo in range(0, len(left), 64):
            l, both = left[lo : lo + 64], common[lo : lo + 64]
            total = n[l][:, None] + n[right][None]
            exact = whole[l][:, None] & whole[right][None]
            x, y = np.nonzero(wanted[lo : lo + 64] & exact & (of * both >= part * (total - both)))
            x, y = l[x], right[y]
            tree = _forest(comp[x], comp[y])
            sure.append((x[tree], y[tree]))
            union = np.minimum(held[l][:, None] + held[right][None] - both, sketch)
            x, y = np.nonzero(wanted[lo : lo + 64] & ~exact & (both >= least * union - 1e-3))
            maybe.append((l[x], right[y]))
        none = np.zeros(0, np.int64)
        x, y = (np.concatenate([none, *v]) for v in (zip(*sure) if sure else ((), ())))
        p, q = (np.concatenate([none, *v]) for v in (zip(*maybe) if maybe else ((), ())))
        full = {k: np.frombuffer(packed[k] + table.column("rest")[k].as_py(), U) for k in np.unique(np.concatenate([p, q])).tolist()}
        label = _labels(comp, x, y)
        for at in range(0, len(p), 4096):
            apart = label[p[at : at + 4096]] != label[q[at : at + 4096]]
            a, b = p[at : at + 4096][apart], q[at : at + 4096][apart]
            linked = np.array([_similar(full[k], full[m], threshold) for k, m in zip(a.tolist(), b.tolist())], bool)
            if linked.any():
                x, y = np.concatenate([x, a[linked]]), np.concatenate([y, b[linked]])
                label = _labels(comp, x, y)
        tree = _forest(comp[x], comp[y])
        return pa.table({"a": pa.array(c[x[tree]], pa.int64()), "b": pa.array(c[y[tree]], pa.int64())})

    return work


def _labels(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The component of each row, as links between rows x and y join them."""
    names, out = np.unique(comp, return_inverse=True)
    while True:
        above = np.arange(len(names))
        np.minimum.at(above, np.maximum(out[x], out[y]), np.minimum(out[x], out[y]))
        if (above[out] == out).all():
            return out
        while (above[above] != above).any():
            above = above[above]
        out = above[out]


def _similar(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether two sorted sets reach the threshold."""
    part, of = threshold
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return of * common >= part * (len(both) - common)


def _confirmed(threshold: tuple[int, int]):
    """Pairs whose full sets reach the threshold."""

    def work(batches):
        for batch in batches:
            a, b = batch.column("ga").to_pylist(), batch.column("gb").to_pylist()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                keep[i] = _similar(np.frombuffer(x, U), np.frombuffer(y, U), threshold)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("ra").filter(keep), batch.column("rb").filter(keep)], names=["u", "v"])

    return work


class _Texts:
    """Texts of the documents that stand for classes, one row for each."""

    def __init__(self, docs: DataFrame, described: DataFrame, work: Workspace):
        self.docs, self.work = docs.where("doc_id IS NOT NULL"), work
        twins = described.where("doc_id IS NOT NULL").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
        self.repeated = not twins.isEmpty()

    def of(self, classes: DataFrame, name: str) -> DataFrame:
        """classes (c, doc_id, tag) -> (c, doc_id, text)."""
        needed = self.work.write(classes, f"{name}-needed")
        # the texts of all others need not be shuffled where the table of those needed is small
        found = self.docs.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, ["doc_id", "tag"])
        if self.repeated:
            found = found.groupBy("doc_id", "tag", "c").agg(F.first("text").alias("text"))
        return found.select("doc_id", "c", "text")


def _verify(pairs: DataFrame, docs: _Texts, classes: DataFrame, work: Workspace, name: str, shingle: int, sketch: int, threshold: tuple[int, int]) -> DataFrame:
    """pairs (a, b) of classes -> links (u, v) between the documents that stand for them."""
    part, of = threshold
    a = classes.select(F.col("c").alias("a"), F.col("n").alias("na"))
    b = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"))
    sized = work.write(pairs.join(a, "a").join(b, "b").where(f"{of} * least(na, nb) >= {part} * greatest(na, nb)").distinct(), f"{name}-sized")
    # sets of the classes in these pairs only, one text for each
    needed = sized.select(F.col("a").alias("c")).union(sized.select("b")).distinct().join(classes.select("c", F.col("rep").alias("doc_id"), "tag"), "c")
    sets = work.write(map_texts(docs.of(needed, name), _sets(shingle, sketch), "c long, rep long, sketch binary, rest binary"), f"{name}-sets")
    a = sets.select(F.col("c").alias("a"), F.col("sketch").alias("sa"))
    b = sets.select(F.col("c").alias("b"), F.col("sketch").alias("sb"))
    likely = work.write(map_texts(sized.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb"), _likely(sketch, part / of), "a long, b long"), f"{name}-likely")
    whole = F.concat("sketch", "rest")
    a = sets.select(F.col("c").alias("a"), F.col("rep").alias("ra"), whole.alias("ga"))
    b = sets.select(F.col("c").alias("b"), F.col("rep").alias("rb"), whole.alias("gb"))
    links = work.write(map_texts(likely.join(a, "a").join(b, "b").select("ra", "rb", "ga", "gb"), _confirmed(threshold), "u long, v long"), f"{name}-links")
    work.drop(f"{name}-sized", f"{name}-needed", f"{name}-likely", f"{name}-sets")
    return links


def candidates(docs: DataFrame, work: Workspace, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The inverted lists with two classes or more: (key, c, low), low the lowest class of the list."""
    listed = map_texts(docs.select("text"), _listed(shingle, threshold), "key long, c long")
    shared = work.write(listed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").drop("high"), "shared")
    lists = work.write(listed.join(shared, "key").groupBy("key", "c").agg(F.first("low").alias("low")), "lists")
    work.drop("shared")
    return lists


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, sketch: int = SKETCH) -> DataFrame:
    """Groups of documents that links of similarity >= threshold connect.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links
    reach) and kept (whether it is the document itself).
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    described = work.write(map_texts(docs.select("doc_id", "tag", "text"), _describe(shingle), "doc_id long, tag long, n long, c long, d long"), "described")
    known = described.where("c IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("c", "d", "n").agg(F.min(F.struct("doc_id", "tag")).alias("x"))
    classes = work.write(classes.select("c", "d", "n", F.col("x.doc_id").alias("rep"), "x.tag"), "classes")
    texts = _Texts(docs, described, work)

    lists = candidates(docs.where("doc_id IS NOT NULL"), work, shingle, threshold)

    # (1) each class and the lowest member of its lists that it meets most often
    def best(met: DataFrame) -> DataFrame:
        met = met.where("c <> b").groupBy("c", "b").agg(F.count("*").alias("n"))
        met = met.groupBy("c").agg(F.max(F.struct("n", "b")).alias("x"))
        return met.select(F.least("c", "x.b").alias("a"), F.greatest("c", "x.b").alias("b")).distinct()

    links = _verify(best(lists.withColumnRenamed("low", "b")), texts, classes, work, "stars", shingle, sketch, threshold)
    stands = known.join(classes.select("c", "d", "n", "rep"), ["c", "d", "n"])
    same = stands.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    # rows that repeat a doc_id with different sets are one node
    repeated = stands.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select(F.col("doc_id").alias("u"))
    links = work.write(links.unionByName(same.join(repeated, "u", "left_semi")), "links")
    comp = components(links, work, "round-1")

    def opened(lists: DataFrame, comp: DataFrame, name: str) -> DataFrame:
        """(key, c, comp) of the lists that hold several components."""
        of = classes.select("c", "rep").join(comp.withColumnRenamed("u", "rep"), "rep", "left").select("c", F.coalesce("m", "rep").alias("comp"))
        member = work.write(lists.select("key", "c").join(work.write(of, f"{name}-of"), "c"), f"{name}-members")
        keys = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low < high")
        out = work.write(member.join(work.write(keys.select("key", "members"), f"{name}-keys"), "key"), name)
        work.drop(f"{name}-of", f"{name}-members", f"{name}-keys")
        return out

    # (2) each class and the hubs of its open lists
    left = opened(lists, comp, "open-1")
    work.drop("lists")
    degree = work.write(left.groupBy("c").agg(F.sum("members").alias("degree")), "degree")
    ranked = work.write(left.join(degree, "c"), "ranked")
    hubs = work.write(ranked.groupBy("key").agg(F.max(F.struct("degree", "c", "comp")).alias("x")).select("key", F.col("x.c").alias("b"), F.col("x.comp").alias("other")), "hubs")
    met = left.join(hubs, "key").where("comp <> other")
    def joined(comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components with more links; a component stands for the links that made it."""
        if links.isEmpty():
            return comp
        return components(links.unionByName(comp.withColumnRenamed("m", "v")), work, name)

    comp = joined(comp, _verify(best(met), texts, classes, work, "hub", shingle, sketch, threshold), "round-2")
    work.drop("degree", "ranked", "hubs")

    # (3) all pairs of different components that share a list; of lists with the same members one is enough
    left = opened(left, comp, "open-2")

    def once(keys: DataFrame, name: str) -> DataFrame:
        alike = keys.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members")
        return work.write(alike, name)

    def alike(lists: DataFrame) -> DataFrame:
        of = [F.bit_xor(F.xxhash64("c", F.lit(salt))).alias(name) for salt, name in ((1, "x"), (2, "y"))]
        return lists.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"), *of).where("low < high")

    def leave(lists: DataFrame) -> DataFrame:
        """lists without the longest ones that a class may leave."""
        sizes = work.write(map_texts(classes.select("c", "n"), _may_leave(threshold), "c long, may long"), "may")
        ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("members"), F.desc("key"))))
        return ranked.join(sizes, "c").where("rank > may").select("key", "c", "comp", "members")

    def pairs(lists: DataFrame) -> DataFrame:
        a = lists.select("key", F.col("c").alias("a"), F.col("comp").alias("ca"))
        b = lists.select("key", F.col("c").alias("b"), F.col("comp").alias("cb"))
        return a.join(b, "key").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = work.write(leave(left), "left")
    short = left.where(F.col("members") <= SHORT_LIST).drop("members")
    few = pairs(short.join(once(alike(short), "short"), "key"))
    long_ = left.where(F.col("members") > SHORT_LIST).drop("members")
    hot = work.write(long_.join(once(alike(long_), "long"), "key"), "hot")
    # blocks of a list are bounded by members and by bytes of their sets
    sizes = hot.join(classes.select("c", "n"), "c").groupBy("key").agg(F.sum("n").alias("shingles"))
    count = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = hot.join(sizes, "key").select("key", "c", "comp", F.pmod(F.xxhash64("c"), count).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    dealt = dealt.select("key", "c", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    mine = hot.groupBy("c").agg(F.collect_list("key").alias("keys")).join(classes.select("c", "n", F.col("rep").alias("doc_id"), "tag"), "c")
    mine = work.write(map_texts(mine, _packed_keys, "c long, n long, doc_id long, tag long, keys binary"), "hot-keys")
    sets = map_texts(texts.of(mine.select("c", "doc_id", "tag"), "hot"), _sets(shingle, sketch), "c long, rep long, sketch binary, rest binary").select("c", "sketch", "rest")
    sets = work.write(sets.join(mine.select("c", "n", "keys"), "c"), "hot-sets")
    many = dealt.join(sets, "c").groupBy("key", "i", "j").applyInArrow(_meet(sketch, threshold), "a long, b long")
    rest = work.write(few.unionByName(many.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "rest")
    comp = joined(comp, _verify(rest, texts, classes, work, "rest", shingle, sketch, threshold), "round-3")
    work.drop("links", "stars-links", "hub-links", "rest-links", "open-1", "open-2", "left", "may", "short", "long", "hot", "hot-needed", "hot-keys", "hot-sets", "rest")

    reach = classes.select("c", "d", "n", "rep").join(comp.withColumnRenamed("u", "rep"), "rep", "left").select("c", "d", "n", F.coalesce("m", "rep").alias("component_id"))
    out = described.select("doc_id", "n", "c", "d").join(reach, ["c", "d", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group; rows with a null doc_id stay."""
    gone = near_dedup(docs, shingle).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
