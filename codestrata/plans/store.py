"""A stored index: written once, read back, and brought up to date by parsing only the files that changed.

Tables under ``path``: ``manifest`` (path and content hash of every file), ``parsed``, ``edges`` and ``chunks`` (with vectors), each
partitioned by corpus and by a bucket of the file's path.  An update compares hashes with the manifest, parses, chunks and
embeds changed files alone, and replaces the buckets they lie in by dynamic overwrite; other buckets and other corpora are not
touched.  The manifest is written last and every read goes through it: an update that broke off leaves the rows of files
whose hash it holds, and running it again repeats what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, entities
from ..session import broadcast_if_small, stage
from .index import Embedder, Index

BUCKETS = 64
TABLES = ("parsed", "edges", "chunks")
MANIFEST = "file_path string, file_hash string, bucket int"


def _bucket(path: str, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str, name: str, corpus_id: str) -> DataFrame | None:
    """Rows of one corpus in a stored table; None where there is no table yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{name}").where(F.col("corpus_id") == corpus_id).drop("corpus_id")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _manifest(spark: SparkSession, path: str, corpus_id: str) -> DataFrame:
    rows = _table(spark, path, "manifest", corpus_id)
    return spark.createDataFrame([], MANIFEST) if rows is None else rows.select("file_path", "file_hash", "bucket")


def _write(rows: DataFrame, path: str, name: str, corpus_id: str) -> None:
    out = rows.withColumn("corpus_id", F.lit(corpus_id)).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_id", "bucket").parquet(f"{path}/{name}")


def _live(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of files as the manifest knows them."""
    return rows.join(manifest.where("file_hash is not null").select("file_path", "file_hash"), ["file_path", "file_hash"], "left_semi")


def update_index(files: DataFrame, path: str, corpus_id: str, embed: Embedder, chunker: str = "recursive", buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the stored index of ``files`` up to date; returns the numbers of new, changed, gone and unchanged files.

    ``embed`` must not depend on the other files of the corpus (see ``index.hashed_embedder`` and ``index.model_embedder``).
    Files without readable text are not part of the index.
    """
    spark = files.sparkSession
    told = files.where(F.col("content").isNotNull()).select(F.col("path").alias("file_path"), F.md5("content").alias("new_hash"))
    known = _manifest(spark, path, corpus_id).where("file_hash is not null").select("file_path", F.col("file_hash").alias("old_hash"))
    both = told.join(known, "file_path", "full_outer").withColumn("bucket", _bucket("file_path", buckets))
    kind = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("new_hash") != F.col("old_hash"), "changed").otherwise("unchanged")
    )
    listing = stage(both.withColumn("kind", kind))
    counts = {r["kind"]: r["n"] for r in listing.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {k: counts.get(k, 0) for k in ("new", "changed", "gone", "unchanged")}
    if out["unchanged"] == sum(out.values()):
        return out
    differs = listing.where("kind <> 'unchanged'")
    todo = broadcast_if_small(differs.where("new_hash is not null").select(F.col("file_path").alias("path"), F.col("new_hash").alias("file_hash")))
    hashes = differs.where("new_hash is not null").select("file_path", F.col("new_hash").alias("file_hash"), "bucket")

    parsed = stage(entities.entity_files(files.join(todo.select("path"), "path", "left_semi")))
    found = parsed.select("path", F.posexplode("entities").alias("pos", "e")).select(F.col("path").alias("file_path"), "pos", "e.*")
    edges = entities.edges(found)
    chunks = embed(documents.chunks(documents.code_documents(parsed), chunker), "text")
    built = {"parsed": parsed.withColumn("file_path", F.col("path")), "edges": edges, "chunks": chunks.withColumn("file_path", F.col("source"))}

    touched = [r[0] for r in differs.select("bucket").distinct().collect()]  # as many as there are buckets at most
    gone = differs.select("file_path")
    for name in TABLES:
        rows = built[name].join(hashes, "file_path")
        old = _table(spark, path, name, corpus_id)
        if old is not None:
            rows = rows.unionByName(old.where(F.col("bucket").isin(touched)).join(gone, "file_path", "left_anti"))
        _write(stage(rows), path, name, corpus_id)
    # A file that is gone stays as a row without hash, so that its bucket is replaced even if nothing else is in it.
    manifest = listing.where(F.col("bucket").isin(touched)).select("file_path", F.col("new_hash").alias("file_hash"), "bucket")
    _write(stage(manifest), path, "manifest", corpus_id)
    return out


def read_index(spark: SparkSession, path: str, corpus_id: str) -> Index:
    """The stored index as the tables ``index.build_index`` gives."""
    manifest = _manifest(spark, path, corpus_id)
    tables = {}
    for name in TABLES:
        rows = _table(spark, path, name, corpus_id)
        if rows is None:
            raise ValueError(f"no index under {path}")
        tables[name] = _live(rows, manifest).drop("bucket", "file_hash")
    parsed = tables["parsed"].drop("file_path")
    found = parsed.select("path", F.posexplode("entities").alias("pos", "e")).select(F.col("path").alias("file_path"), "pos", "e.*")
    return Index(parsed, parsed, found, tables["edges"], documents.code_documents(parsed), tables["chunks"].drop("file_path"))
