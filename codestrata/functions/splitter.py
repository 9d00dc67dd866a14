"""Text chunking: a native fixed window and an Arrow helper for the separator-aware splitter."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk size, overlap and separators from coarse to fine.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
SEPARATORS = ["\n\n", "\n", " ", ""]


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text, each starting with its separator; an empty separator cuts into characters."""
    if not separator:
        return list(text)
    parts = text.split(separator)
    return [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]


def _windows(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy runs of pieces of at most ``size`` characters; a run starts with up to ``overlap`` of the last one."""
    out, run, length = [], deque(), 0
    for piece in pieces:
        if run and length + len(piece) > size:
            out.append("".join(run))
            while run and (length > overlap or length + len(piece) > size):
                length -= len(run.popleft())
        run.append(piece)
        length += len(piece)
    out.append("".join(run))
    return out


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Chunks of a text: split at the coarsest separator present, merge short pieces, recurse into long ones."""
    level = SEPARATORS if separators is None else separators
    chosen = next(i for i, s in enumerate(level) if s in text)
    finer = level[chosen + 1 :] if level[chosen] else []
    out, short = [], []

    def flush():
        if short:
            out.extend(c for c in (w.strip() for w in _windows(short, size, overlap)) if c)
            short.clear()

    for piece in _cut(text, level[chosen]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    flush()
    return out


def chunk_recursive(content: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of separator-aware chunks."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, size, overlap) for t in texts], dtype=object)

    return chunks(content)


def chunk_fixed(content: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of fixed windows, native; an empty text gives one empty chunk."""
    step = size - overlap
    last = F.greatest(F.length(content) - overlap, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.substring(content, i, F.lit(size)))
