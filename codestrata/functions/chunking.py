"""The separator-aware splitter as column expressions: no Python in the plan.

A text is cut at the coarsest separator it holds; pieces of ``size`` characters or more are cut again at finer ones, and every
run of shorter pieces between them is merged greedily into windows of at most ``size`` characters.  A window begins with up to
``overlap`` characters, whole pieces, of the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .splitter import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS
from .text import strip

_NONE = "array<string>"


def _cut(text: Column, separator: str) -> Column:
    """Pieces of a text, each starting with its separator; an empty separator cuts into characters."""
    parts = F.split(text, separator)
    if separator:
        parts = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p)))
    return F.filter(parts, lambda p: p != "")


def _kept(run: Column, length: Column, limit: Column) -> Column:
    """The longest tail of a run of at most ``limit`` characters."""
    start = F.struct(F.lit(1).alias("first"), length.alias("rest"))
    drop = F.aggregate(
        run, start, lambda s, x: F.when(s["rest"] > limit, F.struct((s["first"] + 1).alias("first"), (s["rest"] - F.length(x)).alias("rest"))).otherwise(s)
    )
    return F.slice(run, drop["first"], F.size(run))


def windows(pieces: Column, size: int, overlap: int) -> Column:
    """Merged windows of short pieces, stripped, without empty ones.

    The fold keeps the pieces of the open window only; a window is joined once, when the next piece no longer fits.
    """

    def add(state: Column, piece: Column) -> Column:
        n = F.length(piece)
        room = state["length"] + n <= size
        tail = _kept(state["run"], state["length"], F.least(F.lit(overlap), F.lit(size) - n))
        new_run = F.when(room, state["run"]).otherwise(tail)
        done = F.when(room | (F.size(state["run"]) == 0), state["done"]).otherwise(F.concat(state["done"], F.array(F.array_join(state["run"], ""))))
        run = F.concat(new_run, F.array(piece))
        length = F.when(room, state["length"] + n).otherwise(F.aggregate(run, F.lit(0), lambda s, x: s + F.length(x)))
        return F.struct(done.alias("done"), run.alias("run"), length.alias("length"))

    start = F.struct(F.array().cast(_NONE).alias("done"), F.array().cast(_NONE).alias("run"), F.lit(0).alias("length"))
    merged = F.aggregate(pieces, start, add, lambda s: F.concat(s["done"], F.array(F.array_join(s["run"], ""))))
    return F.filter(F.transform(merged, strip), lambda c: c != "")


def chunk_recursive(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> Column:
    """Array of separator-aware chunks; null for a null text."""
    return F.when(text.isNotNull(), _chunks(text, size, overlap, SEPARATORS if separators is None else separators))


def _chunks(text: Column, size: int, overlap: int, level: list[str]) -> Column:
    out = None
    for i, separator in enumerate(level):
        body = _split_at(text, separator, level[i + 1 :], size, overlap)
        if separator == "":
            return body if out is None else out.otherwise(body)
        has = F.contains(text, F.lit(separator))
        out = F.when(has, body) if out is None else out.when(has, body)
    return out


def _split_at(text: Column, separator: str, finer: list[str], size: int, overlap: int) -> Column:
    """Chunks of a text cut at one separator; long pieces go on with the finer ones."""
    # One-element arrays stand in for variables: what a lambda takes from them is computed once.
    def of_pieces(pieces: Column) -> Column:
        long = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.length(F.get(pieces, i)) >= size)
        bounds = F.concat(F.array(F.lit(-1)), F.when(F.size(pieces) > 0, long).otherwise(F.array().cast("array<int>")), F.array(F.size(pieces)))
        return F.flatten(F.transform(F.array(bounds), lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: between(pieces, F.get(b, k), F.get(b, k + 1))))))

    def between(pieces: Column, before: Column, at: Column) -> Column:
        run = F.slice(pieces, before + 2, at - before - 1)
        short = F.when(at - before > 1, windows(run, size, overlap)).otherwise(F.array().cast(_NONE))
        if not finer:
            return short
        return F.concat(short, F.when(at < F.size(pieces), _chunks(F.get(pieces, at), size, overlap, finer)).otherwise(F.array().cast(_NONE)))

    return F.flatten(F.transform(F.array(_cut(text, separator)), of_pieces))
