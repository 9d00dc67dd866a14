"""Column helpers with the exact text semantics the analyser needs.

Line rules are defined on Unicode text: white space, word characters and trimming follow
Python's ``str`` rules.  Java's ``\\w``/``\\s`` and Spark's ``trim`` are narrower, so the
classes are spelled out once here and reused by every rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and word characters, as regex classes and as a trim set.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
WHITE_SPACE = "".join(
    chr(c)
    for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE_SPACE))


def normalize_newlines(content: Column) -> Column:
    """Universal newlines; the regex only runs on rows that contain a carriage return."""
    return F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, "\r\n?", "\n")).otherwise(content)


def split_lines(content: Column) -> Column:
    """Lines of a text; a trailing empty line counts."""
    return F.split(content, "\n")


def line_count(content: Column) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def indent_width(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def count_of(line: Column, needle: str) -> Column:
    """Occurrences of a one-character needle."""
    return F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))


def truncate(c: Column, n: int) -> Column:
    """First ``n`` characters plus "..." when the text is longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when any needle occurs as a substring (one compiled pattern, no word boundaries)."""
    return c.rlike("|".join(needles))


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it; inside a lambda nothing else shares a value."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def list_repr(c: Column) -> Column:
    """``['a', 'b']`` for an array of strings."""
    return F.concat(F.lit("['"), F.replace(F.array_join(c, "', '"), F.lit("\\"), F.lit("\\\\")), F.lit("']"))
