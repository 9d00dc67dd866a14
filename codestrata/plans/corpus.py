"""A source-code corpus derived from the ``documents`` table.

One SQL text builds the files: every document becomes one source file whose size is the size of the real
text, with code lines chosen by ``doc_id`` so that every rule, entity kind and sibling-test case occurs.
The text is standard SQL, so the same statement can be run elsewhere to check results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import files_from_table, spread

NL = "chr(10)"


def _lines(*parts: str) -> str:
    """SQL concatenation of line expressions, each closed by a newline."""
    return " || ".join(f"{p} || {NL}" for p in parts)


def _when(cond: str, *parts: str) -> str:
    return f"(CASE WHEN {cond} THEN {_lines(*parts)} ELSE '' END)"


def _python_code() -> str:
    q3 = "repeat(chr(34), 3)"
    return " || ".join(
        [
            _when("doc_id % 3 = 0", f"{q3} || 'Module m' || id || '.' || {q3}"),
            _when("doc_id % 3 = 1", "'# notes; no docstring here'"),
            _lines("'import os'", "'from json import dumps'", "'import m' || CAST(doc_id + 5 AS STRING)"),
            _when("doc_id % 4 = 0", "'password = ' || chr(34) || 'k' || id || chr(34)"),
            _lines("'def run_' || id || '(a, b):'"),
            _when("doc_id % 4 < 2", f"'    # first'", f"'    ' || {q3} || 'Run.' || {q3}"),
            _lines("'    c = helper_' || id || '(a)'", "'    for i in range(len(a)):'", "'        b = b + 1'"),
            _when("doc_id % 7 = 0", "'    eval(a)'"),
            _when("doc_id % 11 = 0", "'    global counter'"),
            _when("doc_id % 6 = 0", "'    cursor.execute(' || chr(34) || 'select %s' || chr(34) || ' % a)'"),
            _lines("'    return dumps(c); b'", "''"),
            _lines("'def helper_' || id || '(x):'", "'    s = [[i for i in x] for j in x if j]'"),
            _when("doc_id % 8 = 0", "'    for k in x: s = s + [' || chr(39) || 'q' || chr(39) || ']'"),
            _lines("'    return os.path.join(x)'", "''"),
            _when(
                "doc_id % 9 = 0",
                "'def branchy_' || id || '(x):'",
                "'    if x:'", "'        pass'", "'    elif a:'", "'        pass'", "'    else:'",
                "'        pass'", "'    for y in x:'", "'        pass'", "'    while x:'", "'        pass'",
            ),
            _when("doc_id % 17 = 0", "'def long_' || id || '():'", f"repeat('    z = 1' || {NL}, 55)"),
            _lines("'class Widget_' || id || '(Base):'"),
            _when("doc_id % 2 = 0", f"'    ' || {q3} || 'A widget.' || {q3}"),
            _lines("'    def __init__(self, a, b, c, d, e, f, g):'", "'        self.run = run_' || id || '(a, b)'", "''"),
            _when("doc_id % 15 = 0", "'class _Hidden:'", "'    pass'"),
        ]
    )


def _script_code() -> str:
    return " || ".join(
        [
            _lines("'import { load } from ' || chr(39) || './m' || CAST(doc_id + 5 AS STRING) || chr(39) || chr(59)"),
            _when("doc_id % 4 = 2", "'const fs = require(' || chr(39) || 'fs' || chr(39) || ')' || chr(59)"),
            _when("doc_id % 3 = 0", "'/**'", "' * @param a input'", "' */'"),
            _lines("'function load_' || id || '(a, b) {'", "'  var t = a == b' || chr(59)"),
            _when("doc_id % 4 = 3", "'  console.log(t)' || chr(59)"),
            _when("doc_id % 6 = 2", "'  el.innerHTML = t' || chr(59)"),
            _when("doc_id % 7 = 3", "'  eval(t)' || chr(59)"),
            _lines("'  return go_' || id || '(t === b)' || chr(59)", "'}'", "''"),
            _lines("'const go_' || id || ' = (x) => {'", "'  for (let i = 0' || chr(59) || ' i < x.length' || chr(59) || ' i++) {'"),
            _when("doc_id % 5 = 3", "repeat(' ', 24) || 'deep(x, i)' || chr(59)"),
            _lines("'  }'", "'  return load_' || id || '(x, 1)' || chr(59)", "'}' || chr(59)"),
            _when("doc_id % 8 = 4", "'document.getElementById(1).getElementById(2)' || chr(59)"),
            _when("doc_id % 9 = 4", "'el.addEventListener(1, go_' || id || ')' || chr(59)"),
            _when("doc_id % 18 = 4", "'el.removeEventListener(1, go_' || id || ')' || chr(59)"),
            _lines("'class View_' || id || ' extends Base {'", "'  draw() { return go_' || id || '(1)' || chr(59) || ' }'", "'}'"),
        ]
    )


_BARS = f"'| ' || replace(replace(text, chr(92), '/'), {NL}, {NL} || '| ')"
_COMMENTS = f"'# ' || replace(text, {NL}, {NL} || '# ')"
_Q3 = "repeat(chr(34), 3)"

BASE_COLUMNS = [
    "doc_id",
    "text",
    "CAST(doc_id AS STRING) AS id",
    "source || '/' || lang AS dir",
    """CASE doc_id % 13 WHEN 0 THEN 'config_' WHEN 1 THEN 'main_' WHEN 2 THEN 'small_' ELSE '' END
       || 'm' || CAST(doc_id AS STRING) AS stem""",
    """CASE WHEN doc_id % 5 < 2 THEN '.py' WHEN doc_id % 5 = 2 THEN '.js' WHEN doc_id % 5 = 3 THEN '.ts'
       WHEN doc_id % 10 = 4 THEN '.jsx' ELSE '.tsx' END AS ext""",
]
SOURCE_COLUMNS = [
    "doc_id",
    "dir || '/' || stem || ext AS path",
    f"""COALESCE(CASE WHEN doc_id % 5 = 0 THEN {_python_code()} || 'NOTES = ' || {_Q3} || {NL} || {_BARS} || {NL} || {_Q3} || {NL}
        WHEN doc_id % 5 = 1 THEN 'def broken_' || id || '(:' || {NL} || {_python_code()} || {_COMMENTS}
        ELSE {_script_code()} || text END, '') AS content""",
]
TEST_COLUMNS = [
    "doc_id",
    """dir || '/' || CASE doc_id % 3 WHEN 0 THEN 'test_' || stem || '.py' WHEN 1 THEN stem || '.spec.js'
       ELSE stem || '_test.py' END AS path""",
    f"""COALESCE(CASE doc_id % 3 WHEN 1 THEN
          'import {{ load }} from ' || chr(39) || './' || stem || chr(39) || chr(59) || {NL}
          || 'function check_' || id || '() {{ return load_' || id || '(1, 2) }}' || {NL}
        ELSE 'from ' || stem || ' import run_' || id || {NL}
          || 'def check_' || id || '():' || {NL} || '    assert run_' || id || '(1, 2)' || {NL} END, '') AS content""",
]
TEST_FILTER = "doc_id % 7 < 2"


def corpus_sql(documents: str = "documents") -> str:
    """The same corpus as one SQL statement: ``(doc_id, path, content)``."""
    return f"""WITH base AS (SELECT {", ".join(BASE_COLUMNS)} FROM {documents})
SELECT {", ".join(SOURCE_COLUMNS)} FROM base
UNION ALL
SELECT {", ".join(TEST_COLUMNS)} FROM base WHERE {TEST_FILTER}"""


def derived_corpus(documents: DataFrame) -> DataFrame:
    """Files table of the derived corpus."""
    base = spread(documents, "doc_id").selectExpr(*BASE_COLUMNS)
    rows = base.selectExpr(*SOURCE_COLUMNS).unionByName(base.where(TEST_FILTER).selectExpr(*TEST_COLUMNS))
    return files_from_table(rows)
