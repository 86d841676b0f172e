"""SentencePiece encoding and decoding that keeps every piece's place in the source text.

A text is normalised from left to right: the longest key of the model's
compiled character map (a double array) that begins at a place is replaced,
any other character stays. Each replacement is recorded as (source offset,
source length, normalised length), spaces that become the space mark too.
These records are the alignment: a place in the normalised text maps back to a
source byte by one search among them, for all pieces of a text at once, so
each piece has the byte span of the original text that it stands for.

Pieces come from byte-pair merges in order of score, equal scores from the
left; characters that no piece holds fall back to bytes. Where no piece of the
model has the space mark behind another character, merges can't cross the
place before a space mark, so a text is cut there, and also between characters
that no chain of pieces joins, such as letters and stops in most models. Such
segments recur; each task keeps a bounded
cache of them. Models that have such pieces are encoded
uncut. Both ways handle byte-pair models only; others are refused.

Defined results: null text is empty; an empty text has no pieces; texts of any
length are encoded whole, in blocks of segments; repeated rows are encoded
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MODEL = "piece_bpe_32k.model"
#: Segments of late that one task keeps, and as many of before.
CACHE_SEGMENTS = 150_000
#: Longer segments are encoded each time and not kept.
CACHE_LENGTH = 64
#: Up to so many characters the pairs of a segment are looked through for each merge; longer ones are held in order.
SHORT, WORST = 32, float("-inf")
#: Groups of characters that segments tell apart; smaller ones are one.
MOST_GROUPS = 16
#: Characters of a normalised text whose segments are held together.
BLOCK = 1 << 20

# Fixed values of the model format: kinds of pieces, the space mark, the mark of a byte that is no text.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK, BROKEN, UNKNOWN_SURFACE = "▁", "�", " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double array from byte strings to places among the replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]
        self._known: dict[int, str] = {}
        first = [b for b in range(256) if self._step(0, b) is not None] if self.units else []
        #: bytes that begin a key
        self.first = frozenset(first)

    def _offset(self, node: int) -> int:
        unit = self.units[node]
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        child = node ^ self._offset(node) ^ byte
        return child if child < len(self.units) and self.units[child] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest key that begins at a place, and its replacement."""
        node, found = 0, None
        for i in range(at, len(data)):
            step = self._step(node, data[i])
            if step is None:
                break
            node = step
            if self.units[node] >> 8 & 1:
                found = i + 1 - at, self.units[node ^ self._offset(node)] & 0x7FFFFFFF
        if found is None:
            return None
        if found[1] not in self._known:
            self._known[found[1]] = self.replacements[found[1] : self.replacements.index(b"\0", found[1])].decode("utf-8", "replace")
        return found[0], self._known[found[1]]


class Alignment:
    """From byte places in the normalised text to byte places in the source."""

    def __init__(self, base: int, prefix: int, offsets: np.ndarray, taken: np.ndarray, given: np.ndarray):
        self.base, self.prefix, self.offsets, self.taken, self.given = base, prefix, offsets, taken, given
        grown = np.cumsum(given - taken)
        self.starts = prefix + offsets - base + (grown - (given - taken))

    def source(self, places: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.starts, places, "right") - 1
        plain = self.base + np.maximum(places - self.prefix, 0)
        if not len(self.starts):
            return plain
        j = np.maximum(k, 0)
        behind = places - self.starts[j] - self.given[j]
        return np.where(k < 0, plain, np.where(behind < 0, self.offsets[j], self.offsets[j] + self.taken[j] + behind))


def _segments(pieces: list[str]) -> str:
    """A pattern of segments that no merge crosses: space marks, then characters that chains of pieces join."""
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.setdefault(c, c) != c:
            c = group[c]
        return c

    for p in pieces:
        inner = p.strip(MARK)
        for c in inner:
            group[root(c)] = root(inner[0])
    of: dict[str, list[str]] = {}
    for c in group:
        of.setdefault(root(c), []).append(c)
    parts = sorted(map(sorted, of.values()), key=len, reverse=True)
    parts[MOST_GROUPS:] = [sum(parts[MOST_GROUPS:], [])] if len(parts) > MOST_GROUPS else []
    classes = [f"[{''.join(map(re.escape, chars))}]" for chars in parts]
    all_chars = "".join(re.escape(c) for chars in parts for c in chars)
    return "|".join([f"{MARK}*(?:{'|'.join(c + '+' for c in classes)})"] * bool(classes) + [f"{MARK}+", f"[^{all_chars}{MARK}]+"])


class Model:
    """A byte-pair model: pieces, scores, normalisation."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normalizer, denormalizer = {}, {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number in (2, 3, 5):
                {2: trainer, 3: normalizer, 5: denormalizer}[number].update(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or denormalizer.get(2):
            raise ValueError("only byte-pair models with the space mark in front, without a denormaliser")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1))
        self.unknown_surface = trainer.get(44, UNKNOWN_SURFACE.encode()).decode()
        self.fallback = bool(trainer.get(35, 0))
        #: pieces that merges can make, with score and id
        self.found = {p: (s, i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.scores = {p: s for p, (s, _) in self.found.items()}
        self.id_of = {p: i for p, (_, i) in self.found.items()}
        self.bytes_in = [len(p.encode()) for p in self.pieces]
        self.unused = {p for p, k in zip(self.pieces, self.kinds) if k == UNUSED}
        self.unknown = self.kinds.index(UNKNOWN)
        self.reserved = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (UNKNOWN, CONTROL, BYTE)}
        self.byte_ids = [self.reserved.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i != self.unknown}
        own = sorted((p for p, k in zip(self.pieces, self.kinds) if k == USER_DEFINED and p), key=len, reverse=True)
        self.own = regex.compile("|".join(map(regex.escape, own))) if own else None
        #: no merge crosses the place before a space mark
        self.cuts = self.escape and not any(MARK in p.lstrip(MARK) for p in self.found)
        self.segment = re.compile(_segments([p for p in self.found if len(p) > 1]))
        #: what each id adds to a text behind its front; none for bytes
        self.surfaces = [{BYTE: None, CONTROL: "", UNKNOWN: self.unknown_surface}.get(k, p.replace(MARK, " ")) for p, k in zip(self.pieces, self.kinds)]
        starts = "".join(sorted({bytes([b]).decode("latin-1") for b in self.map.first if b < 128}))
        high = any(b >= 128 for b in self.map.first)
        self.special = regex.compile("|".join(filter(None, [self.own and self.own.pattern, f"[{regex.escape(starts, special_only=False)}]" if starts else "", "[^\x00-\x7f]" if high else "", " "])))

    # Normalisation

    def normalise(self, text: str) -> tuple[str, Alignment]:
        """The normalised text and its alignment with the source's bytes."""
        if not self.map.first and self.own is None and not self.squeeze:
            return self._marked(text)
        data = text.encode("utf-8", "replace")
        out: list[str] = []
        records: list[tuple[int, int, int]] = []
        at = chars = base = 0
        space = MARK if self.escape else " "
        width = len(space.encode())
        after_space = self.squeeze
        lead = True
        while chars < len(text):
            m = self.special.search(text, chars)
            stop = m.start() if m else len(text)
            if stop > chars:
                plain = text[chars:stop]
                out.append(plain)
                at += len(plain.encode())
                chars, after_space, lead = stop, False, False
                if m is None:
                    break
            own = self.own.match(text, chars) if self.own is not None else None
            key = None if own else self.map.longest(data, at) if self.map.first else None
            if own:
                taken, new = len(own.group().encode()), own.group()
            elif key:
                taken, new = key
            else:
                taken, new = len(text[chars].encode()), text[chars]
            old = data[at : at + taken].decode("utf-8", "replace")
            if lead and self.squeeze and new == " ":
                base += taken
            else:
                kept = new.lstrip(" ") if after_space else new
                shown = kept.replace(" ", space)
                if shown != old:
                    records.append((at, taken, len(shown.encode())))
                out.append(shown)
                if kept:
                    after_space = self.squeeze and kept.endswith(" ")
                lead = False
            at += taken
            chars += len(old)
        if (lead and self.squeeze) or not text:
            return "", Alignment(base, 0, *np.zeros((3, 0), np.int64))
        prefix = space if self.dummy else ""
        normal = prefix + "".join(out)
        if self.squeeze:
            normal = normal.rstrip(space)
        records = np.array(records, np.int64).reshape(-1, 3)
        aligned = Alignment(base, len(prefix) * width, records[:, 0], records[:, 1], records[:, 2])
        if self.squeeze:  # what trails is gone: nothing behind the end moves the end
            total = len(normal.encode())
            keep = aligned.starts < total
            aligned = Alignment(base, len(prefix) * width, *(x[keep] for x in (records[:, 0], records[:, 1], records[:, 2])))
        return normal, aligned

    def _marked(self, text: str) -> tuple[str, Alignment]:
        """Without a map and dropped spaces only the spaces change."""
        none = np.zeros(0, np.int64)
        if not text:
            return "", Alignment(0, 0, none, none, none)
        space = MARK if self.escape else " "
        prefix = space if self.dummy else ""
        if self.escape:
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            offsets = np.flatnonzero(raw == 32)
            aligned = Alignment(0, 3 * len(prefix), offsets, np.ones(len(offsets), np.int64), np.full(len(offsets), 3))
        else:
            aligned = Alignment(0, len(prefix), none, none, none)
        return prefix + text.replace(" ", space), aligned

    # Merging

    def merge(self, segment: str) -> list[str]:
        """Pieces of a segment: best score first, equal ones from the left."""
        if self.own is None and not self.unused and len(segment) <= SHORT:
            return self._merge_short(segment)
        if self.own is None:
            parts, frozen = list(segment), [False] * len(segment)
        else:
            parts, frozen, at = [], [], 0
            for m in self.own.finditer(segment):
                for p, f in [(c, False) for c in segment[at : m.start()]] + [(m.group(), True)]:
                    parts.append(p)
                    frozen.append(f)
                at = m.end()
            parts += list(segment[at:])
            frozen += [False] * (len(segment) - at)
        found, n = self.found, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int]] = []
        undo: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b >= n or frozen[a] or frozen[b]:
                return
            joined = parts[a] + parts[b]
            hit = found.get(joined)
            if hit is not None:
                heapq.heappush(agenda, (-hit[0], a, b, len(joined)))
                if joined in self.unused:
                    undo[joined] = parts[a], parts[b]

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[str] = []
        stack = [p for p in reversed(parts) if p]
        while stack:
            p = stack.pop()
            if p in undo:
                stack += reversed(undo[p])
            else:
                out.append(p)
        return out

    def _merge_short(self, segment: str) -> list[str]:
        """The same for a few characters, whose pairs are looked through again for each merge."""
        parts, score = list(segment), self.scores.get
        scores = [score(segment[i : i + 2], WORST) for i in range(len(segment) - 1)]
        while scores:
            best = max(scores)
            if best == WORST:
                break
            i = scores.index(best)
            new = parts[i] = parts[i] + parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + new, WORST)
            if i < len(scores):
                scores[i] = score(new + parts[i + 1], WORST)
        return parts

    def encode_segment(self, segment: str) -> tuple[list[int], list[int]]:
        """Ids of a segment, and the normalised bytes of each: of a character in bytes, the last one holds all."""
        parts = self.merge(segment)
        ids = [self.id_of.get(p) for p in parts]
        if None not in ids:
            return ids, [self.bytes_in[i] for i in ids]
        ids, sizes = [], []
        after_unknown = False
        for p in parts:
            raw = p.encode()
            hit = self.found.get(p)
            at = hit[1] if hit is not None else self.reserved.get(p, self.unknown)
            if at != self.unknown:
                ids.append(at)
                sizes.append(len(raw))
            elif self.fallback:
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            elif after_unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(at)
                sizes.append(len(raw))
            after_unknown = at == self.unknown and not self.fallback
        return ids, sizes

    def segments(self, normal: str) -> Iterator[list[str]]:
        """The segments of a normalised text, in blocks."""
        if not self.cuts:
            yield [normal] if normal else []
            return
        at = 0
        while at < len(normal):
            stop = at + BLOCK
            if stop < len(normal):
                while stop < len(normal) and not (normal[stop] == MARK and normal[stop - 1] != MARK):
                    stop = normal.find(MARK, stop + 1)
                    stop = len(normal) if stop < 0 else stop
            yield self.segment.findall(normal[at:stop])
            at = stop

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the source's byte span of each."""
        normal, aligned = self.normalise(text)
        ids: list[int] = []
        sizes: list[int] = []
        for block in self.segments(normal):
            for segment in block:
                some, lengths = self.encode_segment(segment)
                ids += some
                sizes += lengths
        places = aligned.source(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        return ids, list(zip(places[:-1].tolist(), places[1:].tolist()))

    # Decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the one that normalisation puts in front goes, runs of bytes are text."""
        out: list[str] = []
        run = bytearray()
        front, seen = True, False

        def flush() -> None:
            if run:
                out.append(_text(bytes(run)))
                run.clear()

        for i in ids:
            if not 0 <= i < len(self.pieces):
                raise ValueError(f"no piece has the id {i}")
            if self.kinds[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            if seen or any(out):
                front = False
            seen = False
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] == UNKNOWN:
                out.append(self.unknown_surface)
                continue
            piece = self.pieces[i]
            if front and (self.dummy or self.squeeze) and piece.startswith(MARK):
                piece, seen = piece[1:], not self.squeeze
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)


def _text(raw: bytes) -> str:
    """Bytes as text; each byte that is no part of a character becomes one mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
            except UnicodeDecodeError:
                continue
            if len(out[-1]) == 1:
                at += n
                break
            out.pop()
        else:
            out.append(BROKEN)
            at += 1
    return "".join(out)


class Encoder:
    """A model with a bounded cache of segments, for many texts."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        """Free the cache; executors keep their Python processes for other work."""
        #: (ids joined by commas, sizes as bytes, text behind the front) of segments: of late, and of before
        self.known: dict[str, tuple[str, bytes, str]] = {}
        self.before: dict[str, tuple[str, bytes, str]] = {}

    def _learn(self, block: list[str]) -> None:
        if len(self.known) > CACHE_SEGMENTS:
            self.known, self.before = {}, self.known
        known, before, surfaces = self.known, self.before, self.model.surfaces
        for s in set(block).difference(known):
            hit = before.get(s)
            if hit is None:
                ids, sizes = self.model.encode_segment(s)
                some = [surfaces[i] for i in ids]
                text = self._in_bytes(ids) if None in some else "".join(some)
                hit = ",".join(map(str, ids)), array("I", sizes).tobytes(), text
            known[s] = hit

    def _in_bytes(self, ids: list[int]) -> str:
        """What ids with bytes among them decode to behind the front of a text: a run of bytes ends with the segment."""
        out, run = [], bytearray()
        for i in ids:
            if self.model.surfaces[i] is None:
                run.append(self.model.byte_of[i])
                continue
            out += [_text(bytes(run)), self.model.surfaces[i]]
            run.clear()
        return "".join([*out, _text(bytes(run))])

    def encode(self, text: str, keep: bool) -> tuple[int, str, str, str, list[int] | None, np.ndarray | None]:
        """(n, digest of ids, digest of the decoded text, digest of the spans' ends, ids, places) of a text."""
        model = self.model
        normal, aligned = model.normalise(text)
        if not model.cuts or not model.dummy or model.squeeze:
            ids, spans = model.encode(text)
            places = np.array([spans[0][0] if spans else 0, *(b for _, b in spans)], np.int64)
            return len(ids), _hex(",".join(map(str, ids))), _hex(model.decode(ids)), _digest(places[1:]), ids if keep else None, places if keep else None
        n = end = 0
        of_ids, of_text, of_spans = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        all_ids: list[int] = []
        all_places = [aligned.source(np.zeros(1, np.int64))]
        for block in model.segments(normal):
            self._learn(block)
            ids, sizes, texts = zip(*map(self.known.__getitem__, block))
            joined, decoded = ",".join(ids), "".join(texts)
            sizes = np.frombuffer(b"".join(sizes), "u4")
            ends = end + np.cumsum(sizes, dtype=np.int64)
            places = aligned.source(ends)
            of_ids.update(("," + joined if n else joined).encode())
            of_text.update((decoded if n else decoded[1:]).encode())
            of_spans.update(places.astype("<i8").tobytes())
            n += len(sizes)
            end = int(ends[-1])
            if keep:
                all_ids += map(int, joined.split(","))
                all_places.append(places)
            for s in {s for s in block if len(s) > CACHE_LENGTH}:
                del self.known[s]
        return n, of_ids.hexdigest(), of_text.hexdigest(), of_spans.hexdigest(), all_ids if keep else None, np.concatenate(all_places) if keep else None


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digest(places: np.ndarray) -> str:
    return hashlib.sha256(places.astype("<i8").tobytes()).hexdigest()


@lru_cache(maxsize=2)
def encoder(name_or_path: str = MODEL) -> Encoder:
    """The encoder of a model file: a path, or a name that the public_tokenizers package knows."""
    import os

    import public_tokenizers

    path = name_or_path if os.path.sep in name_or_path else public_tokenizers.path(name_or_path)
    with open(path, "rb") as f:
        return Encoder(Model(f.read()))


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, ids array<int>, begins array<long>, ends array<long>"
LISTS = ("ids", "begins", "ends")


def piece_encode(docs: DataFrame, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Pieces of each text with the source's byte spans, and digests of ids, decoded text and spans.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of the
    spans' ends as little-endian 64-bit numbers) and, if wanted, ids, begins
    and ends. A span begins where the one before ends; the pieces of a
    character in bytes but its last have empty spans.
    """

    def work(batches):
        enc = encoder(model)
        for batch in batches:
            rows = [enc.encode(t or "", with_ids) for t in batch.column("text").to_pylist()]
            n, ids_sha, text_sha, spans_sha, ids, places = zip(*rows) if rows else ((),) * 6
            lists = [pa.array(ids, pa.list_(pa.int32()))] + [pa.array([None if p is None else p[a:b] for p in places], pa.list_(pa.int64())) for a, b in ((0, -1), (1, None))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(spans_sha, pa.string()), *lists], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", *LISTS])
        enc.forget()

    out = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, OUT)
    return out if with_ids else out.drop(*LISTS)


def piece_decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give an empty text."""

    def work(batches):
        of = encoder(model).model
        for batch in batches:
            texts = [of.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), work, "doc_id long, text string")
