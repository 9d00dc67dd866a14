"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

The size of a document is its number of words.  Sources in code point order, null last, weigh 5, 2, 1, repeating, and share
``total_share`` of all words; a target stops at ``most_passes`` times its source's words, and the excess is shared again by
weight among the others until none is above.

Each source's documents, in an order shuffled by a hash of ``doc_id``, form a stream that is cut into blocks of
``block_words`` words.  Slot ``k`` of the schedule has the point ``frac(k * golden ratio)``; the cumulative slot shares of
the sources map it to a source, and the slot's rank within its source picks the block (ranks go round as often as the
target asks).  Where the finite schedule gives a source too few slots, the rest follow at its end; slots beyond a source's
need stay empty; the last slot of a source takes the words that its target leaves.  So each source's taken words are its
target without the fraction, and no document is taken more than ``most_passes`` times.

Null text: size 0.  Documents without words, and all documents of an empty table, take no slot and have ``taken`` 0.
Repeated ids are documents of their own.  Orders over a whole source are sums over hash buckets and then within each, so
a source that owns most rows is spread over many tasks.  Only the catalogue of sources is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
# Fractional part of GOLDEN * 2**20: long slot numbers keep their precision in two halves.
GOLDEN_HIGH = 0.607787409740351
CELLS = 4096
CHUNK = 4096


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of each document, staged: the text is read once."""
    rows = documents(docs, "doc_id", "source", "text")
    return staged(rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")


def targets(sizes: DataFrame, total_share: float = 1.5, most_passes: float = 2.0) -> DataFrame:
    """``source, sid, source_size, weight, target, words`` of each source; ``words`` is the target without its fraction."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    everything = Window.partitionBy()
    below = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("sid", sid).withColumn("weight", weight)
    per = per.withColumn("cap", most_passes * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("all_words", total_share * F.sum("source_size").over(everything))
    per = per.withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(below))
    # A source is at its cap if, with the shares just large enough to fill it, all sources together don't pass the total.
    per = per.withColumn("full", F.sum("cap").over(below) + F.col("ratio") * F.col("left") <= F.col("all_words"))
    capped = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    per = per.withColumn("capped", capped).withColumn("free", free)
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("all_words") - F.col("capped")) * F.col("weight") / F.col("free"))
    per = per.withColumn("target", target)
    return per.select("source", "sid", "source_size", "weight", "target", F.floor(F.col("target") + 1e-6).cast("long").alias("words"))


def placed(sizes: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, source_id, size, start``: place of each document with words in the shuffled stream of its source."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.join(sources.select("source", "sid"), sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "sid", "size", key.alias("key"))
    rows = rows.where("size > 0").withColumn("bucket", F.pmod(F.conv(F.substring("key", 1, 6), 16, 10).cast("long"), F.lit(1 << 24)) * buckets / (1 << 24))
    rows = rows.withColumn("bucket", F.floor("bucket").cast("int"))
    per = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    per = per.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(per, ["sid", "bucket"])
    return rows.select("doc_id", "sid", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


def schedule(spark: SparkSession, sources: DataFrame, block_words: int) -> DataFrame:
    """``position, sid, rank, block, words``: the slots of the mix, each with the block it takes and how many of its words."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    passes = F.floor(F.col("words") / F.col("source_size")).cast("long")
    need = F.when(F.col("source_size") > 0, passes * blocks + F.ceil((F.col("words") - passes * F.col("source_size")) / block_words).cast("long"))
    plan = sources.select("sid", "source_size", F.col("words").alias("goal"), blocks.alias("blocks"), F.coalesce(need, F.lit(0)).alias("need"))
    plan = plan.withColumn("lo", F.sum("need").over(Window.orderBy("sid")) - F.col("need"))
    n = plan.agg(F.sum("need").alias("n")).first()["n"] or 0
    plan = plan.where("need > 0")

    k = F.col("position")
    point = (F.floor(k / (1 << 20)) * GOLDEN_HIGH) % 1.0 + ((k % (1 << 20)) * GOLDEN) % 1.0
    slots = spark.range(n).select(F.col("id").alias("position")).withColumn("point", (point % 1.0) * float(n))
    cells = plan.select("sid", "lo", (F.col("lo") + F.col("need")).alias("hi"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS / max(n, 1)).cast("int"), F.floor(F.col("hi") * CELLS / max(n, 1)).cast("int"))))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS / max(n, 1)).cast("int")).join(cells, "cell")
    slots = slots.where("lo <= point and point < hi").select("position", "sid", F.floor(k / CHUNK).alias("chunk"))

    per = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    per = per.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("position")) - 1
    ranked = slots.withColumn("within", within).join(per, ["sid", "chunk"]).select("position", "sid", (F.col("before") + F.col("within")).alias("rank"))

    hits = slots.groupBy("sid").agg(F.count(F.lit(1)).alias("hits"))
    late = plan.join(hits, "sid", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).where("hits < need")
    late = late.select("sid", F.explode(F.sequence("hits", F.col("need") - 1)).alias("rank"), "hits")
    late = late.select((F.lit(n) + F.col("rank") - F.col("hits")).alias("position"), "sid", "rank")

    full = ranked.union(late).join(plan, "sid").where("rank < need")
    full = full.withColumn("block", F.col("rank") % F.col("blocks"))
    before = F.floor(F.col("rank") / F.col("blocks")).cast("long") * F.col("source_size") + F.col("block") * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.col("goal") - before)
    return full.select("position", "sid", "rank", "block", words.alias("words"))


def mix(docs: DataFrame, total_share: float = 1.5, most_passes: float = 2.0, block_words: int = 1024, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Documents with what the mix takes of each (``doc_id, source, size, source_size, target, taken``), and the schedule."""
    spark = docs.sparkSession
    sizes = sized(docs)
    sources = staged(targets(sizes, total_share, most_passes), "sources")
    slots = schedule(spark, sources, block_words)
    at = placed(sizes, sources, buckets)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = at.withColumn("block", F.explode(F.sequence(first, last)))
    # Within its block a part covers the words from ``low`` to ``high``; a slot takes the block's first ``words`` words.
    low = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    parts = parts.withColumn("low", low).withColumn("high", high)
    taken = parts.join(slots.select("sid", "block", "words"), ["sid", "block"], "left")
    words = F.greatest(F.least("high", "words") - F.col("low"), F.lit(0))
    taken = taken.groupBy("sid", "start", "doc_id", "size").agg(F.sum(F.coalesce(F.when(F.col("words").isNotNull(), words), F.lit(0))).alias("taken"))
    told = sources.select("sid", "source", "source_size", "target")
    columns = ("doc_id", "source", "size", "source_size", "target", "taken")
    with_words = taken.join(told, "sid").select(*columns)
    empty = sizes.where("size = 0").alias("d").join(told.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    empty = empty.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", F.lit(0).cast("long").alias("taken"))
    return with_words.union(empty.select(*columns)), slots
