"""Source files without a sibling test file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from ..functions.text import SPACE, WORD
from ..sources.tables import analysable
from .rules import rule_by_id, to_issues

# Sibling names that count as a test of ``stem``, as patterns that give the stem back.
TEST_NAME_PATTERNS = [
    r"(?s)^test_(.+)\.py$", r"(?s)^(.+)_test\.py$", r"(?s)^test_(.+)\.js$", r"(?s)^(.+)\.test\.js$", r"(?s)^(.+)\.spec\.js$",
]

_BLANK = SPACE.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")  # white space inside a line
PY_TESTABLE = rf"(?md)^{_BLANK}*(?:def{_BLANK}+[\p{{L}}\p{{N}}]|class{_BLANK}+{WORD})"
JS_TESTABLE = rf"function{_BLANK}+{WORD}|const{_BLANK}+{WORD}+{_BLANK}*={_BLANK}*\(|class{_BLANK}+{WORD}"


def covered_stems(files: DataFrame) -> DataFrame:
    """``(parent, stem)`` pairs that have a test file beside them, from all files, read or not."""
    stems = F.array(*[F.nullif(F.regexp_extract("name", p, 1), F.lit("")) for p in TEST_NAME_PATTERNS])
    return (
        files.where(F.col("name").rlike(r"(?:^test_.*\.(?:py|js)|_test\.py|\.test\.js|\.spec\.js)$"))
        .select("parent", F.explode(F.filter(stems, lambda s: s.isNotNull())).alias("stem"))
        .distinct()
    )


def is_testable() -> Column:
    """The text defines something public that a test could call."""
    py = F.col("language") == "python"
    return F.when(py, F.col("content").rlike(PY_TESTABLE)).otherwise(F.col("content").rlike(JS_TESTABLE))


def untested_files(files: DataFrame, all_files: DataFrame | None = None) -> DataFrame:
    """Analysable non-test files with testable content and no test file in the same directory.

    Only names take part in the join, so the text is never shuffled; both sides are keyed by
    ``(parent, stem)``, which is as selective as the path itself.
    """
    candidates = (
        analysable(files)
        .where(~is_test_path(F.col("path"), F.col("language")) & is_testable())
        .select("path", "parent", "stem", "language")
    )
    return candidates.join(covered_stems(files if all_files is None else all_files), ["parent", "stem"], "left_anti")


def untested_issues(files: DataFrame, all_files: DataFrame | None = None) -> DataFrame:
    hits = untested_files(files, all_files).select(
        F.col("path").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("int").alias("n"),
        F.when(F.col("language") == "python", "TP-01").otherwise("TJ-01").alias("rule_id"),
    )
    return to_issues(hits, [rule_by_id("TP-01"), rule_by_id("TJ-01")])
