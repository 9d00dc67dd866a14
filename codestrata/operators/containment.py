"""Which short texts occur in which long ones: an inverted index of character runs instead of a nested loop.

Long texts are cut into segments that overlap by the longest short text, so work and rows are linear in the text.  Each
short text is filed under one run of ``Q`` characters it holds, the one that fewest short texts share; a segment meets only the
short texts filed under its own runs, and those pairs are verified on the segment's text.  Runs are long enough to tell numbered
names apart; a segment's runs that begin like no filed one are dropped before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, counted_join, stage

Q = 8
# First characters by which runs are told apart before the join.
LEAD = 4
SEGMENT_CHARS = 1024


def runs(text: Column, n: Column | int = Q) -> Column:
    """Distinct runs of ``n`` characters (1 to ``Q``).  Characters are taken from an array: a substring would walk the text anew each time."""
    most = n if isinstance(n, int) else Q
    n = F.lit(n) if isinstance(n, int) else n
    # The one-element array binds the characters: inside the lambda they are there, not split anew for each run.
    run = lambda chars, i: F.concat_ws("", *[F.when(n > k, F.get(chars, i + k)) for k in range(most)])
    every = F.flatten(F.transform(F.array(F.split(text, "")), lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: run(chars, i))))
    return F.array_distinct(F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>")))


def segments(longs: DataFrame, text: str, overlap: int) -> DataFrame:
    """Each long text as segments ``_seg, _text``; every run of up to ``overlap`` + 1 characters lies whole in one of them."""
    size = max(SEGMENT_CHARS, overlap)
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = longs.withColumn("_parts", parts)
    whole = F.transform("_parts", lambda p, i: F.concat(p, F.left(F.coalesce(F.get("_parts", i + 1), F.lit("")), F.lit(overlap))))
    return rows.select(*[c for c in longs.columns if c != text], F.posexplode(whole).alias("_seg", "_text"))


def filed(shorts: DataFrame, text: str) -> DataFrame:
    """Short texts with the run they are filed under, ``_run``: of their runs the one in fewest short texts, first by name in a tie."""
    n = F.least(F.length(text), F.lit(Q))
    texts = shorts.select(text).distinct()
    rows = stage(texts.select(text, F.explode(runs(F.col(text), n)).alias("_run")))
    shared = broadcast_if_small(stage(rows.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))))
    rarest = rows.join(shared, "_run").groupBy(text).agg(F.min(F.struct("_n", "_run")).alias("_rarest"))
    return shorts.join(rarest.select(text, F.col("_rarest._run").alias("_run")), text)


def contained(longs: DataFrame, ids: list[str], text: str, shorts: DataFrame, short_text: str) -> DataFrame:
    """Pairs of a long and a short text that occurs in it, each once: ``ids`` of the one and all columns of the other.

    ``ids`` tell long rows apart; column names of the two sides differ.  An empty short text occurs nowhere here.
    """
    shorts = shorts.where(F.length(short_text) > 0)
    longest = shorts.agg(F.max(F.length(short_text))).first()[0] or 1
    pieces = stage(segments(longs.select(*ids, text), text, longest - 1))
    index = stage(filed(shorts, short_text))
    lengths = [r[0] for r in index.select(F.length("_run").alias("n")).distinct().collect()]  # Q at most
    own = F.flatten(F.array(*[runs(F.col("_text"), n) for n in sorted(lengths) or [Q]]))
    at = pieces.select(*ids, "_seg", F.explode(own).alias("_run")).withColumn("_lead", F.left("_run", F.lit(LEAD)))
    leads = broadcast_if_small(stage(index.select(F.left("_run", F.lit(LEAD)).alias("_lead")).distinct()))
    at = stage(at.join(leads, "_lead", "left_semi").drop("_lead"))
    met = counted_join(at, index, ["_run"], ids[0]).drop("_run")
    # Verified on the segment's text, which moves once however many short texts it meets.
    return met.join(pieces, [*ids, "_seg"]).where(F.contains("_text", F.col(short_text))).drop("_seg", "_text").distinct()
