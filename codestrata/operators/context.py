"""Neighbourhood predicates: what the lines around a definition say about it.

Every predicate works on the file's array of lines with higher-order functions, so a file is looked at
in place and only definition lines pay for it.  ``i`` is the 0-based index of the definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed_once, contains_any, lstrip, split_lines, strip

# Quotes that open a docstring, words that count as a branch, window sizes and limits.
DOC_QUOTES = "\"\"\"|'''"
BRANCH_WORDS = ["if", "elif", "else", "for", "while", "try", "except"]
DOC_WINDOW, JSDOC_WINDOW, MODULE_WINDOW, COMPLEX_WINDOW = 5, 5, 10, 50
MAX_FUNCTION_LINES, MAX_BRANCHES = 20, 5


def _is_code(stripped: Column) -> Column:
    return (stripped != "") & ~F.startswith(stripped, F.lit("#"))


def window(lines: Column, start: Column, n: int) -> Column:
    """Up to ``n`` lines from the 0-based ``start``.  Costs the window only; slice() would copy the whole file."""
    last = F.least(start + (n - 1), F.size(lines) - 1)
    return F.when(
        start < F.size(lines), F.transform(F.sequence(start, last), lambda j: F.get(lines, j))
    ).otherwise(F.array().cast("array<string>"))


def documented_after(lines: Column, i: Column) -> Column:
    """A docstring is the first thing, other than blanks and comments, in the five lines after the definition."""
    telling = F.filter(
        window(lines, i + 1, DOC_WINDOW), lambda t: t.rlike(DOC_QUOTES) | _is_code(lstrip(t))
    )
    return F.coalesce(F.get(telling, F.lit(0)).rlike(DOC_QUOTES), F.lit(False))


def has_jsdoc(lines: Column, i: Column) -> Column:
    """A doc comment on the line itself or on one of the four above."""
    above = F.sequence(F.greatest(i - (JSDOC_WINDOW - 1), F.lit(0)), i)
    return F.exists(F.transform(above, lambda j: F.get(lines, j)), lambda t: F.contains(t, F.lit("/**")) | F.contains(t, F.lit("* @")))


def has_module_docstring(lines: Column) -> Column:
    code = F.filter(F.transform(F.slice(lines, 1, MODULE_WINDOW), lstrip), _is_code)
    return F.coalesce(F.get(code, F.lit(0)).rlike(f"^(?:{DOC_QUOTES})"), F.lit(False))


def function_body(lines: Column, i: Column) -> Column:
    """Code lines after a definition, without indentation, up to the next ``def`` and at most fifty lines ahead."""
    head = F.lit("def ")

    def body(ahead: Column) -> Column:
        # A line of "def" and nothing but white space is no definition.
        heads = F.transform(ahead, lambda t, k: (k > 0) & F.startswith(t, head) & F.startswith(strip(t), head))
        upto = computed_once(F.array_position(heads, F.lit(True)), lambda stop: F.when(stop > 0, F.slice(ahead, F.lit(1), (stop - 1).cast("int"))).otherwise(ahead))
        return F.filter(upto, _is_code)

    return computed_once(F.transform(window(lines, i + 1, COMPLEX_WINDOW), lstrip), body)


def is_complex_function(lines: Column, i: Column) -> Column:
    def over(body: Column) -> Column:
        return (F.size(body) > MAX_FUNCTION_LINES) | (F.size(F.filter(body, lambda t: contains_any(t, BRANCH_WORDS))) > MAX_BRANCHES)

    return computed_once(function_body(lines, i), over)


def function_sizes(files: DataFrame) -> DataFrame:
    """Lines and branches of every Python ``def``, as the complexity rule counts them."""
    from .rules import DEFINITION

    def sizes(t: Column, i: Column) -> Column:
        body = function_body(lines, i)
        return F.when(
            F.regexp_extract(t, DEFINITION, 1) == "def",
            F.struct(
                (i + 1).alias("line"),
                F.regexp_extract(t, DEFINITION, 2).alias("name"),
                F.size(body).alias("function_lines"),
                F.size(F.filter(body, lambda b: contains_any(b, BRANCH_WORDS))).alias("branches"),
                documented_after(lines, i).alias("has_docstring"),
            ),
        )

    lines = F.col("lines")
    py = files.where((F.col("language") == "python") & F.col("content").isNotNull())
    return (
        py.select("path", split_lines(F.col("content")).alias("lines"))
        .select("path", F.explode_outer(F.filter(F.transform(lines, sizes), lambda s: s.isNotNull())).alias("f"))
        .where(F.col("f").isNotNull())
        .select("path", "f.*")
    )
