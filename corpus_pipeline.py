"""Corpus pipeline: quality rules, near duplicates, personal data, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns a DataFrame; every result is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm import common, jaccard, mixing, packing, pii, quality
from codestrata.llm.queries import BYTE_BPE, END_OF_PACKED_DOCUMENT

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier learns from ``labels``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "lang", "source", "n_chars", "text")
    kept = quality.score(rows, model, ("doc_id", "lang", "source", "n_chars"), with_text=True).where("kept")
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one whose id and text are the class's; exact repeats of it count once.

    Rows that repeat an id with another text are documents of their own.  A null id takes part under a stand-in made of the
    text, above usual ids, and stays null.
    """
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("row_id"), F.xxhash64("text").alias("text_key"))
    chosen = jaccard.representatives(rows.select(F.col("row_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row_id")
    # Texts move once: the merge join deals them by id and text hash, and the ranking of exact repeats needs no other order.
    rows = rows.join(chosen.hint("merge"), ["row_id", "text_key"], "left_semi")
    once = F.row_number().over(Window.partitionBy("row_id", "text_key").orderBy("text", F.col("doc_id").asc_nulls_last(), "lang", "source", "n_chars"))
    return rows.withColumn("nth", once).where("nth = 1").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and ``n_chars`` counted anew."""
    found = pii.find(docs, keep=("doc_id", "lang", "source"), mask=True)
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: at least once if any of its words is taken, else the nearest number.

    A row is told by the hash of all it holds, so rows that repeat an id are taken each for itself, and rows equal in everything
    alike.  The schedule takes whole blocks but for the last of a source, so only documents at that block's end are rounded.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    mixed, _ = mixing.mix(rows.select(F.col("row_key").alias("doc_id"), "source", "text"))
    times = F.when(F.col("taken") > 0, F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))).otherwise(0)
    times = mixed.groupBy(F.col("doc_id").alias("row_key")).agg(F.max(times).alias("times")).where("times > 0")
    return rows.join(times, "row_key").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece in the packed training sequences."""
    cut = packing.pieces(docs, public_tokenizers.path(BYTE_BPE), END_OF_PACKED_DOCUMENT)
    told = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(told, keep=("ids_crc32",))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("best-fit packing", packed),
]

# The stages hold trained models and tokenizers, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
