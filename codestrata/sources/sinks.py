"""Sinks for results, reports and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_issues_json(issues: DataFrame, path: str) -> None:
    """Findings as JSON lines, one folder per category; no category passes through one task."""
    issues.write.mode("overwrite").partitionBy("category").json(path)


def result_json(summary: DataFrame, categories: DataFrame) -> DataFrame:
    """One JSON text with the run summary and the category headings; the findings stay in their own files."""
    heads = categories.agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("category", F.struct("name", "description", "issues").alias("v"))))
        ).alias("categories")
    )
    total = summary.select(F.struct("files_analyzed", "lines_of_code", "total_issues").alias("summary"), F.lit(1).alias("one"))
    return total.join(heads.withColumn("one", F.lit(1)), "one").select(F.to_json(F.struct("summary", "categories")).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """Report lines as one text file; a report has a fixed number of lines plus one per category."""
    ordered = report.orderBy("ord", "line").select(F.col("line").alias("value"))
    ordered.coalesce(1).write.mode("overwrite").text(path)


def write_chunks(chunks: DataFrame, path: str, corpus_id: str) -> None:
    """Chunk and vector table, one folder per corpus; writing a corpus replaces only its own folder."""
    (
        chunks.withColumn("corpus_id", F.lit(corpus_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("corpus_id")
        .parquet(path)
    )
