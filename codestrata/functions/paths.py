"""Path parts and language detection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Analysed languages by lower-cased suffix.
LANGUAGE_BY_EXT = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
}

# Display names used in document texts.
DISPLAY_BY_EXT = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "JavaScript",
    ".tsx": "TypeScript",
    ".md": "Markdown",
    ".txt": "Text",
    ".json": "JSON",
    ".yaml": "YAML",
    ".yml": "YAML",
}

# Extension sets of the source scan, the text scan and the plain question scan.
CODE_EXTS = [".py", ".js", ".ts", ".jsx", ".tsx"]
TEXT_EXTS = CODE_EXTS + [".md", ".txt", ".json", ".yaml", ".yml"]
QA_EXTS = CODE_EXTS + [".md", ".txt"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ext_of(name: Column) -> Column:
    """Suffix with its dot; a leading dot or a trailing dot gives none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem_of(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(ext_of(name)))


def detect_language(ext: Column) -> Column:
    return _lookup(LANGUAGE_BY_EXT, F.lower(ext))


def display_language(ext: Column) -> Column:
    return F.coalesce(_lookup(DISPLAY_BY_EXT, F.lower(ext)), F.lit("Unknown"))


def is_test_path(path: Column, language: Column) -> Column:
    """Python: path mentions "test"; scripts: "test" or "spec"."""
    low = F.lower(path)
    return F.contains(low, F.lit("test")) | ((language != "python") & F.contains(low, F.lit("spec")))
