"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, licenses, lm, mixing, packing, phrases, pii, quality, rans, toxicity, trie, warc

REGISTRY = {}

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
END_OF_FILE_DOCUMENT, END_OF_PACKED_DOCUMENT = 1, 0


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_hash_prefix_forest(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


@query
def op2_lm_scores(spark, sf_dir):
    found = lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


@query
def op3_token_files(spark, sf_dir):
    blocks, frequencies = rans.token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_OF_FILE_DOCUMENT)
    return rans.read_blocks(blocks, frequencies).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


@query
def op5_source_mix(spark, sf_dir):
    found, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_personal_data(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op7_sequence_packing(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_OF_PACKED_DOCUMENT)
    told = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(told, keep=("ids_crc32",))


@query
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(*trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations"))))


@query
def op12_warc_revisits(spark, sf_dir):
    return warc.resolve(warc.read(spark, warc.archive(table(spark, sf_dir, "pages"))))


@query
def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
