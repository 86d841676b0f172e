"""Recursive text splitting with overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", "。", ".", "？", "！", "?", "!", "；", ";", " ")
SIZE, OVERLAP = 1024, 64


def pieces(text: str, size: int, level: int = 0) -> list[str]:
    """Parts of at most ``size`` characters, cut behind the coarsest separators that are there; blank ones go."""
    if len(text) <= size:
        return [text] if text.strip() else []
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        cut = [text[i : i + size] for i in range(0, len(text), size)]
        return [c for c in cut if c.strip()]
    mark = SEPARATORS[level]
    *heads, tail = text.split(mark)
    out: list[str] = []
    for part in [h + mark for h in heads] + [tail]:
        if part.strip():
            out += pieces(part, size, level + 1)
    return out


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces put together up to ``size``; each chunk begins with the last whole pieces of the one before, up to ``overlap``.

    A chunk can be longer than ``size`` by the overlap it begins with.
    """
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in pieces(text, size) if text.strip() else []:
        if held and length + len(piece) > size:
            out.append("".join(held).strip())
            keep, kept = len(held), 0
            while keep and kept + len(held[keep - 1]) <= overlap:
                keep -= 1
                kept += len(held[keep])
            held, length = held[keep:], kept
        held.append(piece)
        length += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, kb_id, content) -> (chunk_id, doc_id, kb_id, chunk_index, content).

    chunk_id is a hash of doc_id and index: indexing a document again replaces
    its chunks instead of doubling them.
    """

    def work(batches):
        for batch in batches:
            ids, kbs, texts = (batch.column(n).to_pylist() for n in ("doc_id", "kb_id", "content"))
            rows = [(i, kb, k, c) for i, kb, t in zip(ids, kbs, texts) for k, c in enumerate(chunks(t or "", size, overlap))]
            for lo in range(0, len(rows), 4096):
                part = list(zip(*rows[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.string())], names=["doc_id", "kb_id", "chunk_index", "content"])

    picked = docs.select(F.col("doc_id").cast("string"), F.col("kb_id").cast("string"), F.col("content").cast("string"))
    out = picked.mapInArrow(work, "doc_id string, kb_id string, chunk_index int, content string")
    return out.select(F.sha2(F.concat_ws(":", "doc_id", "chunk_index"), 256).alias("chunk_id"), "*")
