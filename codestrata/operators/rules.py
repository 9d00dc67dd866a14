"""Issue rules as data, and the single pass that applies them.

A rule is a boolean column over one exploded line (or over a file-level finding), plus fixed texts.  The
pass is: files -> one array of line records per file (with the few values that need neighbouring lines)
-> explode -> one array of matching rule ids per line -> explode.  No shuffle, and no Python
except the parser call that gates Python files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pyparse
from ..functions.text import SPACE, WORD, count_of, lstrip, split_lines
from ..functions.paths import is_test_path
from .context import documented_after, has_jsdoc, has_module_docstring, is_complex_function

ISSUE_COLUMNS = [
    "rule_id", "category", "severity", "file", "line", "column", "message", "suggestion", "impact", "test_type",
    "file1", "file2", "lines1", "lines2", "similarity", "findings",
]


@dataclass(frozen=True)
class Rule:
    """One rule.  ``condition`` is evaluated per line; a rule without one is raised from a file-level finding."""

    id: str
    languages: tuple[str, ...]
    category: str
    severity: str
    message: Column | str
    suggestion: str | None = None
    condition: Callable[[], Column] | None = None
    impact: str | None = None
    test_type: str | None = None
    modes: tuple[str, ...] = ("basic", "enhanced")
    default: bool = True


PY = ("python",)
JS = ("javascript", "typescript")
ENHANCED = ("enhanced",)


def _has(needle: str) -> Column:
    return F.contains(F.col("text"), F.lit(needle))


def _match(pattern: str, *needed: str) -> Column:
    """Regex search behind the substrings every match must contain, which are far cheaper to test."""
    cond = F.lit(True)
    for needle in needed:
        cond = cond & _has(needle)
    return cond & F.col("text").rlike(pattern)


def _any_of(c: Column, *needles: str) -> Column:
    """True when any needle occurs; plain searches, cheaper than a pattern on lines that mostly hold none."""
    return reduce(or_, [F.contains(c, F.lit(n)) for n in needles])


def _parsed(cond: Column) -> Column:
    return F.col("parsed") & cond


def _quote() -> Column:
    return _has('"') | _has("'")


def _fmt(template: str) -> Callable[[], Column]:
    """Message with ``{name}``, ``{n}`` and ``{file}`` placeholders."""

    def build() -> Column:
        parts, rest = [], template
        while rest:
            head, brace, tail = rest.partition("{")
            if head:
                parts.append(F.lit(head))
            if not brace:
                break
            key, _, rest = tail.partition("}")
            parts.append(F.coalesce(F.col(key).cast("string"), F.lit("")))
        return F.concat(*parts)

    return build


# Rule ids, categories, severities, messages and suggestions.
RULES = [
    Rule("PY-01", PY, "syntax", "critical", _fmt("Syntax error: {name}")),
    Rule("PY-02", PY, "analysis", "high", _fmt("Analysis error: {name}")),
    Rule("PY-03", PY, "complexity", "medium", _fmt("Function '{name}' is too long ({n} lines)"),
         "Consider breaking this function into smaller functions"),
    Rule("PY-04", PY, "complexity", "medium", _fmt("Function '{name}' has too many parameters ({n})"),
         "Consider using a data class or dictionary for parameters"),
    Rule("PY-05", PY, "complexity", "medium", "Deeply nested loop detected",
         "Consider extracting nested logic into separate functions", default=False),
    Rule("PY-06", PY, "security", "high", "Hardcoded password detected",
         "Use environment variables or secure configuration management",
         lambda: _parsed(_has("=") & _quote() & F.col("text").rlike(rf"""(?iu)password{SPACE}*={SPACE}*["'][^"']+["']"""))),
    Rule("PY-07", PY, "security", "high", "Potential SQL injection vulnerability",
         "Use parameterized queries or ORM methods",
         lambda: _parsed(_match(rf"""(?s)execute{SPACE}*\({SPACE}*["'].*%s.*["']""", "%s", "execute"))),
    Rule("PY-08", PY, "security", "critical", "Use of eval() detected",
         "Avoid eval() as it can execute arbitrary code", lambda: _parsed(_has("eval("))),
    Rule("PY-09", PY, "style", "low", _fmt("Line too long ({n} characters)"),
         "Break long lines for better readability", lambda: _parsed(F.length("text") > 120)),
    Rule("PY-10", PY, "style", "low", "Multiple statements on one line",
         "Use separate lines for each statement",
         lambda: _parsed(_has(";") & ~F.startswith(lstrip(F.col("text")), F.lit("#")))),
    Rule("PY-11", PY, "documentation", "low", _fmt("Function '{name}' missing docstring"),
         "Add a docstring describing the function's purpose",
         lambda: _parsed((F.col("kind") == "def") & ~F.col("documented"))),
    Rule("JS-01", JS, "security", "critical", "Use of eval() detected",
         "Avoid eval() as it can execute arbitrary code", lambda: _has("eval(")),
    Rule("JS-02", JS, "security", "high", "Direct innerHTML assignment detected",
         "Use textContent or proper DOM manipulation to prevent XSS", lambda: _has(".innerHTML") & _has("=")),
    Rule("JS-03", JS, "style", "low", "Console.log statement found",
         "Remove or replace with proper logging in production", lambda: _has("console.log(")),
    Rule("JS-04", JS, "style", "low", _fmt("Line too long ({n} characters)"),
         "Break long lines for better readability", lambda: F.length("text") > 120),
    Rule("JS-05", JS, "complexity", "medium", "Deeply nested code detected",
         "Consider extracting nested logic into separate functions", lambda: _match(f"^{SPACE}{{21}}")),
    Rule("JS-06", JS, "style", "low", "Use of 'var' detected", "Use 'let' or 'const' instead of 'var'",
         lambda: _match(rf"(?<!{WORD})var{SPACE}+{WORD}", "var")),
    Rule("JS-07", JS, "style", "low", "Use of loose equality (==) detected", "Use strict equality (===) instead",
         lambda: _has("==") & ~_has("===") & ~_has("!=")),
    Rule("PP-01", PY, "performance", "medium", "Inefficient loop using range(len())",
         "Use enumerate() or direct iteration",
         lambda: _match(rf"for{SPACE}+{WORD}+{SPACE}+in{SPACE}+range\(len\(", "range(len("), "medium", modes=ENHANCED),
    Rule("PP-02", PY, "performance", "medium", "String concatenation in loop detected",
         "Use join() or f-strings for better performance",
         lambda: _has("for") & _has("+") & _quote(), "high", modes=ENHANCED),
    Rule("PP-03", PY, "performance", "low", "Complex nested list comprehension",
         "Consider breaking into multiple steps for readability",
         lambda: _has("[") & _has("for") & _has("if") & (count_of(F.col("text"), "[") > 1), "low", modes=ENHANCED),
    Rule("PP-04", PY, "performance", "medium", "Global variable access in function",
         "Pass variables as parameters instead of using global",
         lambda: _has("def ") & F.col("has_global"), "medium", modes=ENHANCED),
    Rule("JP-01", JS, "performance", "medium", "Chained DOM queries detected",
         "Cache DOM elements or use querySelector",
         lambda: _match(r"(?s)getElementById\(.*\)\.getElementById\(", ").getElementById("), "medium", modes=ENHANCED),
    Rule("JP-02", JS, "performance", "low", "Traditional for loop with length check",
         "Consider using for...of or array methods",
         lambda: _has("for") & _has("length") & _has("i++"), "low", modes=ENHANCED),
    Rule("JP-03", JS, "performance", "high", "Synchronous operation detected",
         "Use async/await or promises for better performance",
         lambda: _has("XMLHttpRequest") | _has("fs.readFileSync") | _has("require("), "high", modes=ENHANCED),
    Rule("JP-04", JS, "performance", "medium", "Potential memory leak: event listener without cleanup",
         "Ensure event listeners are properly removed",
         lambda: _has("addEventListener") & ~F.col("has_cleanup"), "medium", modes=ENHANCED),
    Rule("TP-01", PY, "testing", "high", _fmt("No test files found for {file}"),
         "Create test files to ensure code quality", test_type="unit", modes=ENHANCED),
    Rule("TP-02", PY, "testing", "medium", _fmt("Complex function '{name}' may need comprehensive testing"),
         "Add unit tests for edge cases and error conditions",
         lambda: F.col("complex"), test_type="unit", modes=ENHANCED),
    Rule("TJ-01", JS, "testing", "high", _fmt("No test files found for {file}"),
         "Create test files using Jest, Mocha, or similar framework", test_type="unit", modes=ENHANCED),
    Rule("DP-01", PY, "documentation", "low", "Module missing docstring",
         "Add a module docstring describing the file's purpose", modes=ENHANCED),
    Rule("DP-02", PY, "documentation", "low", _fmt("Function '{name}' missing docstring"),
         "Add a docstring describing parameters, return value, and behavior",
         lambda: (F.col("kind") == "def") & ~F.col("documented") & ~F.startswith(F.col("name"), F.lit("_")), modes=ENHANCED),
    Rule("DP-03", PY, "documentation", "low", _fmt("Class '{name}' missing docstring"),
         "Add a class docstring describing purpose and usage",
         lambda: (F.col("kind") == "class") & ~F.col("documented") & ~F.startswith(F.col("name"), F.lit("_")), modes=ENHANCED),
    Rule("DJ-01", JS, "documentation", "low", "Function missing JSDoc documentation",
         "Add JSDoc comments describing parameters and return value",
         lambda: (F.col("kind") == "function") & ~F.col("documented"), modes=ENHANCED),
]

MAX_STATEMENTS, MAX_PARAMETERS, MAX_LOOP_DEPTH = 50, 7, 3

DEFINITION = rf"^{SPACE}*(def|class){SPACE}+({WORD}+)"
SCRIPT_FUNCTION = rf"function{SPACE}+{WORD}|const{SPACE}+{WORD}+{SPACE}*={SPACE}*\("

_CTX_TYPE = "struct<kind:string,name:string,documented:boolean,complex:boolean>"
_FINDING_TYPE = "struct<rule_id:string,line:int,name:string,n:int>"


def default_rules(mode: str = "basic") -> list[Rule]:
    return [r for r in RULES if r.default and mode in r.modes]


def _contexts(lines: Column, with_complexity: bool) -> Callable[[Column, Column], Column]:
    """Per-line values that need neighbouring lines; null for lines that define nothing."""

    def build(text: Column, i: Column) -> Column:
        kind = F.regexp_extract(text, DEFINITION, 1)
        name = F.regexp_extract(text, DEFINITION, 2)
        complex_ = (
            (kind == "def") & ~F.startswith(name, F.lit("_")) & ~F.col("test_like") & is_complex_function(lines, i)
            if with_complexity
            else F.lit(False)
        )
        python = F.struct(
            kind.alias("kind"), name.alias("name"), documented_after(lines, i).alias("documented"), complex_.alias("complex")
        )
        script = F.struct(
            F.lit("function").alias("kind"),
            F.lit("").alias("name"),
            has_jsdoc(lines, i).alias("documented"),
            F.lit(False).alias("complex"),
        )
        is_py = F.col("language") == "python"
        return F.when(
            is_py & _any_of(text, "def", "class") & text.rlike(DEFINITION), python
        ).when(~is_py & _any_of(text, "function", "const") & text.rlike(SCRIPT_FUNCTION), script)

    return build


def _oversized(functions: Column, field: str, limit: int, finding: Callable[..., Column]) -> Column:
    over = F.filter(functions, lambda f: f[field] > limit)
    return F.transform(over, lambda f: finding(f["line"], f["name"], f[field]))


def _file_findings(rules: list[Rule], lines: Column) -> Column:
    """File-level findings as an array, from parse facts and the head of the file."""
    ids = {r.id for r in rules}

    def one(rule_id: str, line: Column, name: Column, n: Column) -> Column:
        return F.struct(F.lit(rule_id).alias("rule_id"), line.cast("int").alias("line"), name.alias("name"), n.cast("int").alias("n"))

    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    facts = F.col("facts")
    parts = []
    for rule_id, kind in [("PY-01", "syntax"), ("PY-02", "analysis")]:
        if rule_id in ids:
            hit = one(rule_id, facts["error_line"], facts["error_message"], none_i)
            parts.append(F.when(facts["error_kind"] == kind, F.array(hit)))
    for rule_id, field, limit in [("PY-03", "body", MAX_STATEMENTS), ("PY-04", "args", MAX_PARAMETERS)]:
        if rule_id in ids:
            parts.append(_oversized(facts["functions"], field, limit, partial(one, rule_id)))
    if "PY-05" in ids:
        deep = F.filter(facts["loops"], lambda f: f["depth"] > MAX_LOOP_DEPTH)
        parts.append(F.transform(deep, lambda f: one("PY-05", f["line"], none_s, none_i)))
    if "DP-01" in ids:
        missing = (F.col("language") == "python") & ~has_module_docstring(lines)
        parts.append(F.when(missing, F.array(one("DP-01", F.lit(1), none_s, none_i))))
    empty = F.array().cast(f"array<{_FINDING_TYPE}>")
    return F.concat(empty, *[F.coalesce(p, empty) for p in parts])


def rule_issues(
    files: DataFrame, rules: list[Rule] | None = None, mode: str = "basic", gate_on_parse: bool = True
) -> DataFrame:
    """Issues of all line and file rules, one row per finding.

    ``gate_on_parse=False`` runs the Python line rules on files that do not parse and skips parse rules,
    which leaves a plan without any Python.
    """
    rules = default_rules(mode) if rules is None else rules
    if not gate_on_parse:
        rules = [r for r in rules if r.id not in ("PY-01", "PY-02", "PY-03", "PY-04", "PY-05")]
    ids = {r.id for r in rules}
    known = "facts" in files.columns  # parsed before
    base = files.where(F.col("language").isNotNull() & F.col("content").isNotNull()).select(
        F.col("path").alias("file"), "language", "content", *([F.col("facts").alias("_facts")] if known else [])
    )
    needs_facts = any(r.id.startswith("PY-") for r in rules) and gate_on_parse
    if not needs_facts:
        facts = F.lit(None).cast(pyparse.FACTS_TYPE)
    elif known:
        facts = F.col("_facts")
    else:
        facts = pyparse.parse_facts(F.when(F.col("language") == "python", F.col("content")))
    per_file = base.select("*", facts.alias("facts"), is_test_path(F.col("file"), F.col("language")).alias("test_like")).select(
        "file",
        "language",
        "facts",
        "test_like",
        F.contains("content", F.lit("global ")).alias("has_global"),
        F.contains("content", F.lit("removeEventListener")).alias("has_cleanup"),
        split_lines(F.col("content")).alias("lines"),
    )
    lines = F.col("lines")
    needs_context = bool(ids & {"PY-11", "DP-02", "DP-03", "DJ-01", "TP-02"})
    context = _contexts(lines, "TP-02" in ids) if needs_context else (lambda t, i: F.lit(None))
    line_entries = F.transform(
        lines,
        lambda t, i: F.struct(
            (i + 1).alias("line"), t.alias("text"), context(t, i).cast(_CTX_TYPE).alias("ctx"),
            F.lit(None).cast(_FINDING_TYPE).alias("finding"),
        ),
    )
    finding_entries = F.transform(
        _file_findings(rules, lines),
        lambda f: F.struct(
            f["line"].alias("line"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(_CTX_TYPE).alias("ctx"),
            f.alias("finding"),
        ),
    )
    entries = per_file.select(
        "file",
        "language",
        F.col("facts.error_kind").isNull().alias("parsed"),
        "has_global",
        "has_cleanup",
        F.explode_outer(F.concat(line_entries, finding_entries)).alias("e"),
    ).select(
        "file", "language", "parsed", "has_global", "has_cleanup", "e.line", "e.text", "e.finding",
        F.coalesce("e.finding.name", "e.ctx.name").alias("name"),
        F.col("e.ctx.kind").alias("kind"),
        F.col("e.ctx.documented").alias("documented"),
        F.col("e.ctx.complex").alias("complex"),
    )
    matched = F.when(F.col("finding.rule_id").isNotNull(), F.array("finding.rule_id")).otherwise(_matched(rules))
    # The ids are computed inside the explode: as a column of their own a filter on it would compute them twice.
    hits = entries.select("file", "line", "name", "text", F.col("finding.n").alias("n"), F.explode(matched).alias("rule_id"))
    return to_issues(hits.select("file", "line", "name", F.coalesce("n", F.length("text")).alias("n"), "rule_id"), rules)


def _matched(rules: list[Rule]) -> Column:
    """Ids of the line rules that hold; a line meets the rules of its language only.

    The array filter keeps the conditions out of the one generated method of the stage: with all of them in it the method
    passes the size up to which the JVM compiles, and every line is interpreted.
    """
    by_language: dict[str, list[Rule]] = {}
    for r in rules:
        for language in r.languages if r.condition is not None else ():
            by_language.setdefault(language, []).append(r)
    shared: dict[tuple[str, ...], list[str]] = {}
    for language, some in by_language.items():
        shared.setdefault(tuple(r.id for r in some), []).append(language)
    chain = F.when(F.lit(False), F.array().cast("array<string>"))
    for languages in shared.values():
        ids = F.array(*[F.when(r.condition(), F.lit(r.id)) for r in by_language[languages[0]]])
        chain = chain.when(F.col("language").isin(languages), F.filter(ids, lambda x: x.isNotNull()))
    return chain


FIXED = ("category", "severity", "message", "suggestion", "impact", "test_type")


def _fixed(rules: list[Rule]) -> Column:
    """The fixed texts of a row's rule, from one literal map; a message that holds names or numbers is null in it."""
    def texts(r: Rule) -> Column:
        return F.struct(*[F.lit(v if isinstance(v := getattr(r, k), str) else None).cast("string").alias(k) for k in FIXED])

    empty = F.create_map().cast(f"map<string,struct<{','.join(f'{k}:string' for k in FIXED)}>>")
    return (F.create_map(*[x for r in rules for x in (F.lit(r.id), texts(r))]) if rules else empty)[F.col("rule_id")]


def _message(rules: list[Rule]) -> Column:
    """The message of a row's rule; rules that share a form share one branch."""
    groups: dict[str, tuple[Column, list[str]]] = {}
    for r in rules:
        if not isinstance(r.message, str):
            c = r.message if isinstance(r.message, Column) else r.message()
            groups.setdefault(str(c), (c, []))[1].append(r.id)
    chain = F.when(F.lit(False), F.lit(""))
    for c, ids in groups.values():
        chain = chain.when(F.col("rule_id").isin(ids), c)
    return chain.otherwise(F.col("fixed.message"))


def to_issues(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Issue record from ``(file, line, name, n, rule_id)`` hits."""
    none = F.lit(None)
    return hits.withColumn("fixed", _fixed(rules)).select(
        "rule_id",
        "fixed.category",
        "fixed.severity",
        "file",
        F.col("line").cast("int").alias("line"),
        none.cast("int").alias("column"),
        _message(rules).alias("message"),
        "fixed.suggestion",
        "fixed.impact",
        "fixed.test_type",
        none.cast("string").alias("file1"),
        none.cast("string").alias("file2"),
        none.cast("string").alias("lines1"),
        none.cast("string").alias("lines2"),
        none.cast("double").alias("similarity"),
        F.lit(1).cast("decimal(38,0)").alias("findings"),
    )


def family_rules(mode: str, **enabled: bool) -> list[Rule]:
    """Rule subset by category switches, e.g. ``family_rules("enhanced", testing=False)``."""
    return [r for r in default_rules(mode) if enabled.get(r.category, True)]


def rule_by_id(rule_id: str) -> Rule:
    return next(r for r in RULES if r.id == rule_id)
