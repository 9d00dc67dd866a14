"""Files table from any DataFrame of (path, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text


def files_from_table(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adapt ``(path, text)`` rows to the files schema.

    Binary content is validated as UTF-8; a row that is not valid gets ``read_error`` and null content,
    so one bad file never fails a job.
    """
    raw = F.col(content)
    if dict(df.dtypes)[content] == "binary":
        # A binary-to-string cast keeps the bytes, so the check sees the original encoding.
        as_text = raw.cast("string")
        valid = F.is_valid_utf8(as_text)
    else:
        as_text, valid = raw, raw.isNotNull()
    out = df.select(
        F.col(path).alias("path"),
        paths.name_of(F.col(path)).alias("name"),
        paths.parent_of(F.col(path)).alias("parent"),
        F.octet_length(raw).cast("bigint").alias("size"),
        F.when(valid, text.normalize_newlines(as_text)).alias("content"),
        F.when(valid, F.lit(None)).otherwise(F.lit("content is not valid UTF-8")).cast("string").alias("read_error"),
    )
    return with_path_parts(out)


def with_path_parts(df: DataFrame) -> DataFrame:
    name = F.col("name")
    ext = paths.ext_of(name)
    return df.select(
        "path",
        "name",
        "parent",
        paths.stem_of(name).alias("stem"),
        ext.alias("ext"),
        paths.detect_language(ext).alias("language"),
        "size",
        "content",
        "read_error",
    )


def analysable(files: DataFrame) -> DataFrame:
    """Readable files in a supported language."""
    return files.where(F.col("language").isNotNull() & F.col("content").isNotNull())


def select_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the files named in ``selection(path)``; the planner picks broadcast or shuffle by size."""
    return files.join(selection.select("path").distinct(), "path", "left_semi")


def limit_size(files: DataFrame, max_file_size_mb: int = 10) -> DataFrame:
    """Optional size filter, off unless called."""
    return files.where(F.col("size") <= max_file_size_mb * 1024 * 1024)


def limit_languages(files: DataFrame, languages: list[str]) -> DataFrame:
    return files.where(F.col("language").isin(languages))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core when the input has fewer splits than the cluster has cores.

    Large inputs already have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
