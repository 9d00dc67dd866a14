"""Rollups over issues.  All of them sum ``findings``, so a class row counts for every pair it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import name_of
from ..functions.text import line_count
from ..sources.tables import analysable
from .severity import PRIORITIES

# Weights and level bounds of the dashboard.
COMPLEXITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
CATEGORY_LEVELS = [(10, "critical"), (5, "high"), (2, "medium")]
FILE_LEVELS = [(15, "critical"), (10, "high"), (5, "medium")]
SEVERITIES = ["critical", "high", "medium", "low"]
REPORT_ADVICE = [
    "- Focus on critical and high-priority issues first",
    "- Implement automated code quality checks",
    "- Consider code review processes for complex files",
    "- Regular monitoring of code quality metrics",
]


def _total() -> Column:
    return F.coalesce(F.sum("findings"), F.lit(0)).cast("decimal(38,0)")


def _level(value: Column, bounds: list[tuple[int, str]]) -> Column:
    chain = None
    for bound, label in bounds:
        chain = F.when(value > bound, label) if chain is None else chain.when(value > bound, label)
    return chain.otherwise("low")


def cells(scored: DataFrame) -> DataFrame:
    """Findings by category, severity, priority and file name: a small table of issues that all rollups below give the same on."""
    file = name_of(F.coalesce("file", F.lit("unknown"))).alias("file")
    return scored.groupBy("category", "severity", "priority", file).agg(_total().alias("findings"))


def run_summary(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Files analysed, lines of code and total issues, in one row.

    Lines are counted on the text, before anything is exploded.
    """
    zero = F.lit(0).cast("bigint")
    sizes = analysable(files).agg(
        F.count(F.lit(1)).alias("files_analyzed"), F.sum(line_count(F.col("content"))).alias("lines_of_code")
    ).select("files_analyzed", F.coalesce("lines_of_code", zero).alias("lines_of_code"), F.lit(0).cast("decimal(38,0)").alias("total_issues"))
    found = issues.agg(_total().alias("total_issues")).select(
        zero.alias("files_analyzed"), zero.alias("lines_of_code"), "total_issues"
    )
    return sizes.unionByName(found).agg(
        F.sum("files_analyzed").alias("files_analyzed"),
        F.sum("lines_of_code").alias("lines_of_code"),
        F.sum("total_issues").cast("decimal(38,0)").alias("total_issues"),
    )


def category_counts(issues: DataFrame) -> DataFrame:
    """Issues per category with title, description and level."""
    c = F.coalesce("category", F.lit("general"))
    title = F.initcap("category")
    return issues.groupBy(c.alias("category")).agg(_total().alias("issues")).select(
        "category",
        title.alias("name"),
        F.concat(title, F.lit(" related issues")).alias("description"),
        "issues",
        _level(F.col("issues"), CATEGORY_LEVELS).alias("level"),
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.coalesce("severity", F.lit("low")).alias("severity")).agg(_total().alias("issues"))


def console_counts(issues: DataFrame) -> DataFrame:
    """The short summary: total and the three named severities."""
    def of(s: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("findings"))), F.lit(0)).cast("decimal(38,0)").alias(f"{s}_priority")

    return issues.agg(_total().alias("total_issues"), of("high"), of("medium"), of("low"))


def file_complexity(issues: DataFrame) -> DataFrame:
    """Severity-weighted score per file name; issues without a file count as "unknown"."""
    weights = F.create_map(*[F.lit(x) for kv in COMPLEXITY_WEIGHT.items() for x in kv])
    weight = F.coalesce(weights[F.coalesce("severity", F.lit("low"))], F.lit(1))
    score = F.sum(weight * F.col("findings")).cast("decimal(38,0)")
    return issues.groupBy(name_of(F.coalesce("file", F.lit("unknown"))).alias("file_name")).agg(
        score.alias("score"), _total().alias("issues")
    ).withColumn("level", _level(F.col("score"), FILE_LEVELS))


def top_files(issues: DataFrame, n: int = 10) -> DataFrame:
    return file_complexity(issues).orderBy(F.desc("score"), "file_name").limit(n)


def priority_matrix(scored: DataFrame) -> DataFrame:
    """Issues per category and priority, one column per priority."""
    p = F.coalesce("priority", F.lit("P3 - Low"))
    level = F.lit(PRIORITIES[-1])
    for label in reversed(PRIORITIES[:-1]):
        level = F.when(p.startswith(label[:2]), label).otherwise(level)
    cells = [
        F.coalesce(F.sum(F.when(F.col("level") == label, F.col("findings"))), F.lit(0)).cast("decimal(38,0)").alias(label)
        for label in PRIORITIES
    ]
    return scored.select(F.coalesce("category", F.lit("general")).alias("category"), level.alias("level"), "findings").groupBy(
        "category"
    ).agg(*cells)


def selection_rollup(issues: DataFrame) -> DataFrame:
    """Counters of a chosen set of files by category and by severity, in long form."""
    by_category = issues.groupBy(F.coalesce("category", F.lit("Other")).alias("value")).agg(_total().alias("issues"))
    by_severity = issues.groupBy(F.coalesce("severity", F.lit("Medium")).alias("value")).agg(_total().alias("issues"))
    return by_category.select(F.lit("category").alias("counter"), "value", "issues").unionByName(
        by_severity.select(F.lit("severity").alias("counter"), "value", "issues")
    )


def summary_report(summary: DataFrame, issues: DataFrame, generated_at: str | None = None) -> DataFrame:
    """Report lines ``(ord, line)``: totals, severities, categories and the standing advice."""
    # Headings and labels of the report.
    stamp = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")

    def rows(*lines: Column, first: int) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(first + i).alias("ord"), c.alias("line")) for i, c in enumerate(lines)]))

    head = summary.select(
        rows(
            F.lit("# Code Quality Analysis Report"),
            F.concat(F.lit("Generated on: "), stamp),
            F.lit(""),
            F.lit("## Summary"),
            F.concat(F.lit("- **Files Analyzed**: "), F.col("files_analyzed").cast("string")),
            F.concat(F.lit("- **Lines of Code**: "), F.format_number("lines_of_code", 0)),
            F.concat(F.lit("- **Total Issues**: "), F.col("total_issues").cast("string")),
            F.lit(""),
            F.lit("## Issues by Severity"),
            first=0,
        )
    )
    per_severity = issues.agg(
        *[F.coalesce(F.sum(F.when(F.coalesce("severity", F.lit("low")) == s, F.col("findings"))), F.lit(0)).cast("decimal(38,0)").alias(s) for s in SEVERITIES]
    ).select(
        rows(
            *[F.concat(F.lit(f"- **{s.title()}**: "), F.col(s).cast("string")) for s in SEVERITIES],
            F.lit(""),
            F.lit("## Issues by Category"),
            first=20,
        )
    )
    per_category = category_counts(issues).select(
        F.lit(30).alias("ord"), F.concat(F.lit("- **"), F.col("name"), F.lit("**: "), F.col("issues").cast("string")).alias("line")
    )
    tail = summary.select(rows(F.lit(""), F.lit("## Recommendations"), *[F.lit(x) for x in REPORT_ADVICE], first=40))
    return head.unionByName(per_severity).unionByName(per_category).unionByName(tail)
