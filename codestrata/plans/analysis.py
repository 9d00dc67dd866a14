"""End-to-end analysis of a files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import line_count
from ..operators import coverage, duplicates, rollups, rules, severity
from ..session import stage


def issues(
    files: DataFrame,
    mode: str = "basic",
    gate_on_parse: bool = True,
    rule_set: list[rules.Rule] | None = None,
    duplication: bool = True,
) -> DataFrame:
    """All findings of a corpus.

    ``basic`` applies the language rules; ``enhanced`` adds performance, testing, documentation and duplication.
    """
    if mode not in ("basic", "enhanced"):
        raise ValueError(f"unknown mode: {mode}")
    out = rules.rule_issues(files, rule_set, mode, gate_on_parse)
    if mode == "enhanced":
        ids = {r.id for r in (rule_set or rules.default_rules(mode))}
        if ids & {"TP-01", "TJ-01"}:
            out = out.unionByName(coverage.untested_issues(files))
        if duplication:
            out = out.unionByName(duplicates.duplication_issues(duplicates.blocks(files)))
    return out


def scored_issues(files: DataFrame, mode: str = "basic", **options) -> DataFrame:
    return severity.score_issues(issues(files, mode, **options))


def analyse_selection(files: DataFrame, selection: DataFrame, mode: str = "basic", **options) -> DataFrame:
    """Findings of a chosen list of files; every row names its file in ``file_path`` too."""
    from ..sources.tables import select_files

    return issues(select_files(files, selection), mode, **options).withColumn("file_path", F.col("file"))


def dashboard(files: DataFrame, scored: DataFrame, generated_at: str | None = None) -> dict[str, DataFrame]:
    """The dashboard as tables."""
    summary = rollups.run_summary(files, scored)
    return {
        "issues_by_category": rollups.category_counts(scored),
        "severity_distribution": rollups.severity_counts(scored),
        "files_complexity": rollups.top_files(scored),
        "priority_matrix": rollups.priority_matrix(scored),
        "summary_report": rollups.summary_report(summary, scored, generated_at),
    }


def dashboard_pass(files: DataFrame, mode: str = "basic", generated_at: str | None = None, **options) -> dict[str, DataFrame]:
    """The dashboard of a files table from one pass: findings are scored and counted once, and files and lines as they go by.

    The counted findings (category, severity, priority, file name) are written once; every table is made of them.
    """
    seen = Observation()
    there = F.col("language").isNotNull() & F.col("content").isNotNull()
    watched = files.observe(
        seen, F.count(F.when(there, 1)).alias("files_analyzed"), F.coalesce(F.sum(F.when(there, line_count(F.col("content")))), F.lit(0)).cast("long").alias("lines_of_code")
    )
    counted = stage(rollups.cells(scored_issues(watched, mode, **options)))
    sizes = files.sparkSession.createDataFrame([(seen.get["files_analyzed"], seen.get["lines_of_code"])], "files_analyzed long, lines_of_code long")
    found = counted.agg(F.coalesce(F.sum("findings"), F.lit(0)).cast("decimal(38,0)").alias("total_issues"))
    summary = sizes.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one").drop("one")
    return {
        "run_summary": summary,
        "issues_by_category": rollups.category_counts(counted),
        "severity_distribution": rollups.severity_counts(counted),
        "files_complexity": rollups.top_files(counted),
        "priority_matrix": rollups.priority_matrix(counted),
        "summary_report": rollups.summary_report(summary, counted, generated_at),
    }


def with_run_metadata(df: DataFrame, url: str, owner: str, name: str, branch: str = "main", version: str = "1.0.0") -> DataFrame:
    """Attach repository and run columns to any result."""
    return df.withColumns(
        {
            "repository_url": F.lit(url),
            "repository_owner": F.lit(owner),
            "repository_name": F.lit(name),
            "analyzed_branch": F.lit(branch),
            "analysis_timestamp": F.current_timestamp(),
            "analyzer_version": F.lit(version),
        }
    )
