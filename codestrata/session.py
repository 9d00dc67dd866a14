"""Session settings and staging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the jobs rely on; a cluster sets its own sizes on top.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows of the text tables are whole files: batches to Python are limited by size, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, as a table in the shared folder named by ``spark.checkpoint.dir``.

    Used where one expensive result feeds several joins.  The data is on shared storage, so it survives the loss of
    executors; Parquet keeps columns apart, so later reads take only what they need.  A session on a local master may
    leave the setting out and gets a folder in its warehouse; on a cluster that is an error.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return f"{folder.rstrip('/')}/codestrata/{uuid.uuid4().hex}"


# Rows of a narrow table (keys and short values) that may be broadcast: some tens of megabytes at most.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table when a count proves it small; a larger one takes the shuffle join.

    The count stops at the bound.  Call it on staged or cheap tables.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], salt_by: str, salts: int = 16) -> DataFrame:
    """Inner join in which one key may own a large share of ``many``.

    Rows of ``many`` are spread by ``salt_by`` over ``salts`` copies of the matching rows of ``few``, so the rows of a
    hot key reach that many tasks.  ``few`` should be narrow and have few rows per key.
    """
    salt = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", salt).join(copies, [*keys, "_salt"]).drop("_salt")


# Rows of one key that one task of a join may hold; a key with more is dealt over more tasks.
ROWS_A_TASK = 4096


def counted_join(many: DataFrame, few: DataFrame, keys: list[str], spread_by: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """Inner join in which any key may own a large share of ``many``, however large.

    Keys are counted first.  The rows of a key with more than ``rows`` are dealt by ``spread_by`` over as many parts as its count
    asks for, and its rows of ``few`` go to each of them; all other keys are joined as they are.  ``many`` is read twice:
    pass a staged or cheap one.
    """
    hot = many.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_parts")).where("_parts > 1")
    hot = broadcast_if_small(stage(hot))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("_parts")
    copies = few.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


# Joined rows that one task of a join of pairs should make, and the most parts such a join is cut into.
PAIRS_A_TASK, MOST_PARTS = 16_000_000, 10_000


def pair_join(many: DataFrame, few: DataFrame, keys: list[str], spread_by: str, pairs: int = PAIRS_A_TASK) -> DataFrame:
    """Inner join with far more rows than its sides: rows are dealt over tasks by the rows they make, not by their own number.

    A key that makes more than ``pairs`` rows has its rows of ``many`` dealt by ``spread_by``, with its rows of ``few`` in each part.  The number
    of parts is told from exact counts, as small sides would else be drawn together into a few tasks.  Pass staged tables.
    """
    n = F.count(F.lit(1))
    met = many.groupBy(*keys).agg(n.alias("_n")).join(few.groupBy(*keys).agg(n.alias("_m")), keys)
    rows = F.col("_n").cast("double") * F.col("_m")
    met = stage(met.select(*keys, rows.alias("_rows"), F.least("_n", F.ceil(rows / pairs)).cast("int").alias("_parts")))
    total = met.agg(F.sum("_rows")).first()[0] or 0
    spark = many.sparkSession
    number = int(min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // pairs + 1)))
    hot = broadcast_if_small(met.where("_parts > 1").select(*keys, "_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("_parts")
    copies = few.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    key = [*keys, "_part"]
    return dealt.repartition(number, *key).join(copies.repartition(number, *key), key).drop("_part")
