"""Arrow helper for script entities: functions, arrow functions, classes and imports with their uses."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

# Entity patterns in result order, words that are not dependencies.
ENTITY_PATTERNS = [
    ("function", r"function\s+(\w+)\s*\([^)]*\)\s*\{"),
    ("function", r"const\s+(\w+)\s*=\s*\([^)]*\)\s*=>"),
    ("class", r"class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{"),
    ("import", r"import\s+(?:\{[^}]*\}|\w+)\s+from\s+['\"]([^'\"]+)['\"]"),
]
NOT_DEPENDENCIES = {"var", "let", "const", "function", "if", "else", "for", "while", "return"}


class _Braces:
    """Running brace depth of a text, indexed so each block end is found by binary search."""

    def __init__(self, source: str):
        self.at, self.opens, self.after = [], [], []
        self.closes_to = defaultdict(list)
        depth = 0
        for m in re.finditer(r"[{}]", source):
            depth += 1 if m.group() == "{" else -1
            if m.group() == "{":
                self.opens.append(len(self.at))
            else:
                self.closes_to[depth].append(len(self.at))
            self.at.append(m.start())
            self.after.append(depth)
        self.end_of_text = len(source)

    def block_end(self, start: int) -> int:
        """Position of the brace that closes the first block after ``start``, or the end of the text."""
        first = bisect_left(self.at, start)
        base = self.after[first - 1] if first else 0
        o = bisect_left(self.opens, first)
        if o == len(self.opens):
            return self.end_of_text
        closes = self.closes_to.get(base, [])
        c = bisect_right(closes, self.opens[o])
        return self.at[closes[c]] if c < len(closes) else self.end_of_text


def script_entities(source: str) -> list[dict]:
    braces = _Braces(source)
    newlines = [m.start() for m in re.finditer("\n", source)]
    found = []
    for kind, pattern in ENTITY_PATTERNS:
        for m in re.finditer(pattern, source):
            if kind == "import":
                deps = [m.group(1)]
            else:
                body = source[m.start() : braces.block_end(m.start())]
                calls = set(re.findall(r"(\w+)\s*\(", body))
                deps = sorted(calls | (set(re.findall(r"\w+", body)) - NOT_DEPENDENCIES))
            found.append(
                {
                    "name": m.group(1),
                    "type": kind,
                    "line_number": bisect_left(newlines, m.start()) + 1,
                    "content": m.group(0),
                    "docstring": None,
                    "parameters": None,
                    "dependencies": deps,
                }
            )
    return found
